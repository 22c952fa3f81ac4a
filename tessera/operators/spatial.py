"""Spatial operators on image rectangles: predicates, bounds, viewports, tile ranges, selections and overlaps."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.image_exprs import THUMBNAIL
from tessera.operators import geometry as geo
from tessera.plans.dialect import Family, fixture, run

FAMILY = Family()
same, own = FAMILY.same, FAMILY.own


#: Rows of equal rectangles that go as one through the joins.
BLOCK = 256


def _overlapping_blocks(rects: DataFrame, cell: float) -> DataFrame:
    """Pairs of blocks of rows (i_ords, i_l, i_t, i_r, i_b, and j_...) whose rectangles overlap strictly, each pair once; a block with
    itself (``same``) too. A block is up to BLOCK rows with one rectangle, by ascending ord."""
    place = F.row_number().over(Window.partitionBy("l", "t", "r", "b").orderBy("ord")) - 1
    blocks = rects.where("ord is not null").withColumn("block", F.floor(place / BLOCK)).groupBy("l", "t", "r", "b", "block").agg(F.sort_array(F.collect_list("ord")).alias("ords"))
    # each axis' whole cell numbers that the rectangle touches
    cells = blocks.withColumn("cx", F.explode(F.sequence(F.floor(F.col("l") / cell), F.floor(F.col("r") / cell)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("t") / cell), F.floor(F.col("b") / cell))))
    # a number of partitions of its own: the cells are few bytes, which says nothing about how many pairs come of them
    spark = rects.sparkSession
    cells = cells.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "cx", "cy")
    left, right = (cells.select(*[F.col(c).alias(f"{p}_{c}") for c in ("ords", "l", "t", "r", "b", "block")], "cx", "cy") for p in ("i", "j"))
    pairs = left.join(right, ["cx", "cy"]).where("i_l < j_r and j_l < i_r and i_t < j_b and j_t < i_b")
    here = (F.floor(F.greatest("i_l", "j_l") / cell) == F.col("cx")) & (F.floor(F.greatest("i_t", "j_t") / cell) == F.col("cy"))
    i, j = (F.struct(*[f"{p}_{c}" for c in ("l", "t", "r", "b", "block")]) for p in ("i", "j"))
    return pairs.where(here).where(i <= j).withColumn("same", i == j)


def overlapping_pairs(rects: DataFrame, cell: float = 1024.0) -> DataFrame:
    """(a, b) of rectangles (ord, l, t, r, b) that overlap strictly, a < b, by a grid of cells and an equi-join.

    Rows with one rectangle go through the join as one, in blocks, and are told apart behind it. A block stands in every cell it touches;
    a pair is reported only in the cell that holds the upper left corner of its intersection, so no pair comes twice and no distinct is
    needed. Cells about as large as a typical rectangle keep the copies to about four.
    """
    pairs = _overlapping_blocks(rects, cell).withColumn("x", F.explode("i_ords")).withColumn("y", F.explode("j_ords")).where("x < y or (y < x and not same)")
    swapped = F.col("y") < F.col("x")
    columns = [F.when(swapped, F.col(f"{q}_{c}")).otherwise(F.col(f"{p}_{c}")).alias(f"{p}_{c}") for p, q in ("ij", "ji") for c in ("l", "t", "r", "b")]
    return pairs.select(F.least("x", "y").alias("i_ord"), F.greatest("x", "y").alias("j_ord"), *columns)


_PAIRS = "select i.ord as a, j.ord as b from img_rects i join img_rects j on i.ord < j.ord and i.l < j.r and j.l < i.r and i.t < j.b and j.t < i.b"


@own("overlap_pairs", _PAIRS)
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlapping_pairs(fixture(spark, sf_dir, "img_rects")).select(F.col("i_ord").alias("a"), F.col("j_ord").alias("b"))


@own("overlap_pairs_grid", _PAIRS)
def overlap_pairs_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlapping_pairs(fixture(spark, sf_dir, "img_rects"), 4096.0).select(F.col("i_ord").alias("a"), F.col("j_ord").alias("b"))


_CLIP = "select i.ord as a, j.ord as b, least(i.r, j.r) - greatest(i.l, j.l) as w, least(i.b, j.b) - greatest(i.t, j.t) as h from img_rects i join img_rects j on i.ord < j.ord and i.l < j.r and j.l < i.r and i.t < j.b and j.t < i.b"
_PUSH = "with c as ({clip}), m as (select a as ord, case when w > h then 0d else -(w / 2d + 16d) end as dx, case when w > h then -(h / 2d + 16d) else 0d end as dy from c union all select b, case when w > h then 0d else w / 2d + 16d end, case when w > h then h / 2d + 16d else 0d end from c), s as (select ord, sum(dx) as dx, sum(dy) as dy, count(*) as n from m group by ord) select r.ord, round((r.l + r.r) / 2d + coalesce(s.dx, 0d), 6) as x, round((r.t + r.b) / 2d + coalesce(s.dy, 0d), 6) as y, coalesce(s.n, 0) as pushes from img_rects r left join s on s.ord = r.ord"


def _pusher() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for overlap_push; made here, it goes to the workers whole, and they need not find this package."""

    def pushes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(ord, dx, dy, n) of pairs of blocks with what a pair of their rows pushes: a row is pushed forth by each row of the other block with
        a smaller ord and back by each with a larger one, so it takes no more than its place among the other block's ords."""
        for batch in batches:
            sides = [batch.column(c).combine_chunks() if isinstance(batch.column(c), pa.ChunkedArray) else batch.column(c) for c in ("i_ords", "j_ords")]
            dx, dy, same = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dx", "dy", "same"))
            counts = [s.value_lengths().to_numpy().astype(np.int64) for s in sides]
            ords, rank = np.unique(np.concatenate([s.flatten().to_numpy() for s in sides]), return_inverse=True)
            if not len(ords):
                continue
            ranks = np.split(rank, [int(counts[0].sum())])
            pairs = [np.repeat(np.arange(batch.num_rows), c) for c in counts]
            # ascending in each block and over the batch
            keys = [p * len(ords) + r for p, r in zip(pairs, ranks)]
            total = np.zeros((3, len(ords)))
            for own, other in ((0, 1), (1, 0)):
                upto = np.cumsum(counts[other])
                less = np.searchsorted(keys[other], keys[own], "left") - (upto - counts[other])[pairs[own]]
                more = upto[pairs[own]] - np.searchsorted(keys[other], keys[own], "right")
                if own:  # a block with itself is looked at from one side
                    less, more = (np.where(same[pairs[own]], 0, x) for x in (less, more))
                for k, weight in enumerate(((less - more) * dx[pairs[own]], (less - more) * dy[pairs[own]], less + more)):
                    total[k] += np.bincount(ranks[own], weight, len(ords))
            pushed = total[2] > 0
            yield pa.RecordBatch.from_arrays([pa.array(ords[pushed].astype(np.int64)), pa.array(total[0][pushed]), pa.array(total[1][pushed]), pa.array(total[2][pushed].astype(np.int64))], ["ord", "dx", "dy", "n"])

    return pushes


def overlap_push(rects: DataFrame, cell: float = 1024.0) -> DataFrame:
    """One step of the overlap solver in which all pairs push at once (the sequential sweep moves as it goes): half of the
    intersection and a margin, along its smaller side. Repeat until no row has pushes, or for a bounded number of steps.
    Pairs of rows are not made: copies of a rectangle go as one, and a row is told only how many copies come before and behind it."""
    w, h = F.least("i_r", "j_r") - F.greatest("i_l", "j_l"), F.least("i_b", "j_b") - F.greatest("i_t", "j_t")
    clip = _overlapping_blocks(rects, cell).select(F.col("i_ords").cast("array<long>"), F.col("j_ords").cast("array<long>"), "same", w.alias("w"), h.alias("h"))
    clip = clip.selectExpr("i_ords", "j_ords", "same", "case when w > h then 0D else w / 2D + 16D end as dx", "case when w > h then h / 2D + 16D else 0D end as dy")
    moves = clip.mapInArrow(_pusher(), "ord long, dx double, dy double, n long")
    total = moves.groupBy("ord").agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"), F.sum("n").alias("n"))
    total = total.withColumn("ord", F.col("ord").cast(rects.schema["ord"].dataType))
    return rects.join(total, "ord", "left").selectExpr("ord", "round((l + r) / 2D + coalesce(dx, 0D), 6) as x", "round((t + b) / 2D + coalesce(dy, 0D), 6) as y", "coalesce(n, 0L) as pushes")


def solved(rects: DataFrame, most: int = 1000, saved: int = 2) -> tuple[DataFrame, int]:
    """rects(ord, l, t, r, b) pushed apart until no two overlap, and the number of steps; after ``most`` steps what
    still overlaps stays so. Every ``saved`` steps the places are written to the checkpoint folder, which cuts the plan."""
    sizes = rects.select("ord", (F.col("r") - F.col("l")).alias("w"), (F.col("b") - F.col("t")).alias("h"))
    for step in range(most):
        pushed = overlap_push(rects)
        rects = pushed.join(sizes, "ord").selectExpr("ord", "x - w / 2 as l", "y - h / 2 as t", "x + w / 2 as r", "y + h / 2 as b", "pushes")
        if step % saved == 0:
            rects = rects.checkpoint()
            if rects.where("pushes > 0").isEmpty():
                return rects.drop("pushes"), step
        rects = rects.drop("pushes")
    return rects, most


@own("overlap_step", _PUSH.format(clip=_CLIP))
def overlap_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_push(fixture(spark, sf_dir, "img_rects"))


@own("image_rects", "select fileid, ord, l, t, r, b, (l + r) / 2d as x, (t + b) / 2d as y from img_rects")
def image_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.centre()
    return fixture(spark, sf_dir, "img_rects").withColumns({"x": x, "y": y})


@own("rect_contains_point", "select ord, l <= 5000d and 5000d <= r and t <= 4000d and 4000d <= b as closed, l <= 5000d and 5000d < r and t <= 4000d and 4000d < b as half_open from img_rects")
def rect_contains_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "img_rects").select("ord", geo.contains_point(5000.0, 4000.0).alias("closed"), geo.contains_point(5000.0, 4000.0, closed=False).alias("half_open"))


@own("images_in_rect", "select ord from img_rects where l >= 1000d and t >= 1000d and r <= 9000d and b <= 8000d")
def images_in_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "img_rects").where(geo.contains_in(1000.0, 1000.0, 9000.0, 8000.0)).select("ord")


@own("visible_images", "with v as (select -0d / 0.25d as l, 0d as t, 800d / 0.25d as r, 600d / 0.25d as b) select i.ord from img_rects i join v on i.l < v.r and v.l < i.r and i.t < v.b and v.t < i.b")
def visible_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "img_rects").where(geo.overlaps(0.0, 0.0, 800.0 / 0.25, 600.0 / 0.25)).select("ord")


@own("rect_clip", "select ord, greatest(l, 2000d) as l, greatest(t, 2000d) as t, least(r, 6000d) as r, least(b, 6000d) as b from img_rects where l < 6000d and 2000d < r and t < 6000d and 2000d < b")
def rect_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.clipped(fixture(spark, sf_dir, "img_rects"), 2000.0, 2000.0, 6000.0, 6000.0).select("ord", "l", "t", "r", "b")


@own("rect_ops", "select ord, l - 8d as grown_l, r + 8d as grown_r, t - 4d as grown_t, b + 4d as grown_b, least(l, 0d) as union_l, greatest(r, 100d) as union_r, (l + r) / 2d as cx, (t + b) / 2d as cy, round(sqrt((r - l) * (r - l) + (b - t) * (b - t)), 6) as diagonal, least(l, r) as norm_l, l <= r and t <= b as is_normal from img_rects")
def rect_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rects = fixture(spark, sf_dir, "img_rects")
    x, y = geo.centre()
    larger = geo.grown(rects, 8.0, 4.0).select("ord", *(F.col(c).alias(f"grown_{c}") for c in "lrtb"))
    both = rects.select("ord", F.least("l", F.lit(0.0)).alias("union_l"), F.greatest("r", F.lit(100.0)).alias("union_r"), x.alias("cx"), y.alias("cy"), F.round(geo.diagonal(), 6).alias("diagonal"), F.least("l", "r").alias("norm_l"), geo.is_normal().alias("is_normal"))
    return larger.join(both, "ord")


# The nine anchors of alignment and their halves of width and height.
_ANCHORS = [
    ("top_left", 0, 0),
    ("top_center", 1, 0),
    ("top_right", 2, 0),
    ("center_left", 0, 1),
    ("center", 1, 1),
    ("center_right", 2, 1),
    ("bottom_left", 0, 2),
    ("bottom_center", 1, 2),
    ("bottom_right", 2, 2),
]


@own("rect_align", f"select i.ord, a.anchor, i.l - (i.r - i.l) * a.x / 2d as l, i.t - (i.b - i.t) * a.y / 2d as t from img_rects i cross join (values {', '.join(f"('{n}', {x}, {y})" for n, x, y in _ANCHORS)}) as a(anchor, x, y)")
def rect_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.aligned(fixture(spark, sf_dir, "img_rects"), _ANCHORS).select("ord", "anchor", "l", "t")


@own("bounding_rect", "select coalesce(min(l), 0d) as l, coalesce(min(t), 0d) as t, coalesce(max(r), 0d) as r, coalesce(max(b), 0d) as b from img_rects where not (isnan(l) or isnan(t) or isnan(r) or isnan(b))")
def bounding_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.bounds(fixture(spark, sf_dir, "img_rects"))


@own("selection_center", "select round(coalesce(avg((l + r) / 2d), 0d), 6) as x, round(coalesce(avg((t + b) / 2d), 0d), 6) as y from img_rects where ord % 5 = 0")
def selection_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.middle(fixture(spark, sf_dir, "img_rects").where("ord % 5 = 0")).select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@own("vec2_ops", "select ord, round(l * cos(0.2451d) - t * sin(0.2451d), 6) as rx, round(l * sin(0.2451d) + t * cos(0.2451d), 6) as ry, round(sqrt(l * l + t * t), 6) as magnitude, round(l * r + t * b, 6) as dot, case when l = 0d and t = 0d then 0d else round(l / sqrt(l * l + t * t), 6) end as unit_x from img_rects")
def vec2_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, t, r, b = (F.col(c) for c in "ltrb")
    x, y = geo.rotated(l, t, 0.2451)
    six = lambda c, n: F.round(c, 6).alias(n)
    return fixture(spark, sf_dir, "img_rects").select("ord", six(x, "rx"), six(y, "ry"), six(geo.length(l, t), "magnitude"), six(l * r + t * b, "dot"), six(geo.unit(l, t)[0], "unit_x"))


same("vec3_ops", "select ord, l + r as sx, t + b as sy, l - r as dx, round(sqrt((l - r) * (l - r) + (t - b) * (t - b) + 4d), 6) as distance, l + (r - l) * 0.25d as lerp_x, t + (b - t) * 0.25d as lerp_y, round(t * cos(0.5d) - l * sin(0.5d), 6) as rot_y from img_rects")
same("mat2_ops", "select ord, l * b - t * r as det, case when l * b - t * r = 0d then null else round(b / (l * b - t * r), 9) end as inv00, l * l + t * r as sq00, l * t + t * b as sq01, r * l + b * r as sq10, r * t + b * b as sq11 from img_rects")


@own("screen_to_world", "select ord, (l - 100d) / 0.25d as x, (t - 50d) / 0.25d as y from img_rects")
def screen_to_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.to_world(F.col("l"), F.col("t"), 0.25, 100.0, 50.0)
    return fixture(spark, sf_dir, "img_rects").select("ord", x.alias("x"), y.alias("y"))


def turned(x: str, y: str, degrees: float, width: float, height: float) -> tuple[str, str]:
    """SQL: a point on a display turned back about the display's middle."""
    c, s, mx, my = (f"{v!r}D" for v in (math.cos(-math.radians(degrees)), math.sin(-math.radians(degrees)), width / 2, height / 2))
    return f"(({x}) - {mx}) * {c} - (({y}) - {my}) * {s} + {mx}", f"(({x}) - {mx}) * {s} + (({y}) - {my}) * {c} + {my}"


def zoomed(views: DataFrame, factor: float, x: float, y: float, degrees: float, width: float, height: float) -> DataFrame:
    """views(scale, ox, oy) after zooming by a factor about a point of a display that is turned by some degrees."""
    px, py = turned(f"{x!r}D", f"{y!r}D", degrees, width, height)
    return views.withColumns({"scale": F.expr(f"scale * {factor!r}D"), "ox": F.expr(f"{px} - ({px} - ox) * {factor!r}D"), "oy": F.expr(f"{py} - ({py} - oy) * {factor!r}D")})


def moved(views: DataFrame, dx: float, dy: float, degrees: float) -> DataFrame:
    """views(ox, oy) after moving by a way on a display that is turned by some degrees."""
    x, y = turned(f"{dx!r}D", f"{dy!r}D", degrees, 0.0, 0.0)
    return views.withColumns({"ox": F.expr(f"ox + ({x})"), "oy": F.expr(f"oy + ({y})")})


@own(
    "camera_zoom",
    "with a as (select radians(-30d) as a), p as (select 400d + (10d - 400d) * cos(a) - (20d - 300d) * sin(a) as px, 300d + (10d - 400d) * sin(a) + (20d - 300d) * cos(a) as py, 5d * cos(a) + 7d * sin(a) as dx, 5d * sin(a) - 7d * cos(a) as dy from a) select ord, 0.375d as scale, round(px - (px - l) * 1.5d, 5) as ox, round(py - (py - t) * 1.5d, 5) as oy, round(l + dx, 5) as mx, round(t + dy, 5) as my from img_rects cross join p",
)
def camera_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = run(spark, sf_dir, "select ord, 0.25d as scale, l as ox, t as oy, l, t from img_rects")
    zoom = zoomed(views, 1.5, 10.0, 20.0, 30.0, 800.0, 600.0).select("ord", "scale", "ox", "oy", "l", "t")
    both = moved(zoom.withColumnsRenamed({"ox": "zx", "oy": "zy", "l": "ox", "t": "oy"}), 5.0, -7.0, 30.0)
    return both.select("ord", "scale", F.round("zx", 5).alias("ox"), F.round("zy", 5).alias("oy"), F.round("ox", 5).alias("mx"), F.round("oy", 5).alias("my"))


@own("zoom_to_fit", "with r as (select min(l) as l, min(t) as t, max(r) as r, max(b) as b from img_rects), z as (select *, case when (r - l) / (b - t) > 800d / 600d then 800d / (r - l) else 600d / (b - t) end as zoom from r) select round(zoom, 9) as zoom, round(400d - (l + r) / 2d * zoom, 6) as ox, round(300d - (t + b) / 2d * zoom, 6) as oy from z")
def zoom_to_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = geo.fitted(geo.bounds(fixture(spark, sf_dir, "img_rects")), 800.0, 600.0)
    return view.select(F.round("zoom", 9).alias("zoom"), F.round("ox", 6).alias("ox"), F.round("oy", 6).alias("oy"))


def enlarged(views: DataFrame) -> DataFrame:
    """views(l, t, r, b) so large that they hold their view however it is turned: the middle and the whole diagonal to each side."""
    wide = views.withColumns({"_x": F.expr("(l + r) / 2"), "_y": F.expr("(t + b) / 2"), "_d": F.expr("round(sqrt((r - l) * (r - l) + (b - t) * (b - t)), 6)")})
    return wide.withColumns({"l": F.expr("_x - _d"), "t": F.expr("_y - _d"), "r": F.expr("_x + _d"), "b": F.expr("_y + _d")}).drop("_x", "_y", "_d")


@own("viewport_rotated", "with q as (select ord, [l + (r - l) / 2d, t + (b - t) / 2d] as middle, round(sqrt(pow(r - l, 2) + pow(b - t, 2)), 6) as far from img_rects) select ord, middle[1] - far as l, middle[2] - far as t, middle[1] + far as r, middle[2] + far as b from q")
def viewport_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enlarged(fixture(spark, sf_dir, "img_rects").select("ord", "l", "t", "r", "b"))


def level_for(zoom: str, most: str = "top") -> str:
    """SQL: the level of tiles for a zoom; a whole number of halvings, not below 0 and not above the least level there is."""
    return f"cast(greatest(0, least({most}, case when ln(1D / ({zoom})) >= 0 then floor(round(ln(1D / ({zoom})) / ln(2D), 9)) else ceil(round(ln(1D / ({zoom})) / ln(2D), 9)) end)) as int)"


def tiles_in_view(images: DataFrame, zoom: float, left: float, top: float, right: float, bottom: float, size: int = 256) -> DataFrame:
    """(fileid, scale, x, y) of the tiles that a view shows of images(fileid, width, height, l, t, r, b, image_scale, top): at the level that
    the zoom asks for, those that the visible part of the image touches; the only one of an image that is smaller than a tile."""
    seen = images.where(f"l < {right}D and r > {left}D and t < {bottom}D and b > {top}D").withColumn("scale", F.expr(level_for(f"{zoom!r}D * image_scale")))
    sized = seen.withColumn("factor", F.expr("shiftleft(1L, scale)")).withColumn("single", F.expr(f"width div factor < {size} and height div factor < {size}"))
    part = {n: f"cast(({clip}({c}, {v!r}D) - {o}) / image_scale as double)" for n, clip, c, v, o in (("x0", "greatest", "l", left, "l"), ("y0", "greatest", "t", top, "t"), ("x1", "least", "r", right, "l"), ("y1", "least", "b", bottom, "t"))}
    tile = f"({size} * factor)"
    ranged = sized.selectExpr(
        "fileid", "scale",
        *(f"case when single then 0 else cast(floor({part[n]} / {tile}) as bigint) end as {n}" for n in ("x0", "y0")),
        *(f"case when single then 1 else (cast(floor({part[n]}) as bigint) + {tile} - 1) div {tile} end as {n}" for n in ("x1", "y1")),
    )
    grid = ranged.where("x1 > x0 and y1 > y0").withColumn("x", F.expr("explode(sequence(x0, x1 - 1))")).withColumn("y", F.expr("explode(sequence(y0, y1 - 1))"))
    return grid.select("fileid", "scale", "x", "y")


#: Images at a quarter of their size, with the least level of each.
_PLACED = f"select f.fileid, f.width, f.height, r.l, r.t, r.r, r.b, 0.25d as image_scale, f.ts as top from (select *, {THUMBNAIL} as ts from img_files) f join img_rects r on r.fileid = f.fileid"
_HALVINGS = "(case when width > height then width else height end)"


@own("tile_level", f"with f as (select r.ord, f.width, f.height, (r.ord + 1) / 700d as z from img_rects r join img_files f on f.fileid = r.fileid), n as (select *, list_filter(range(0, 31), lambda k : {_HALVINGS} // (cast(1 as bigint) << k) <= 8)[1] as top, list_filter(range(1, 40), lambda k : 1d / z >= (cast(1 as bigint) << k)) as ks from f) select ord, cast(least(top, len(ks)) as int) as level from n")
def tile_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    zooms = run(spark, sf_dir, f"select r.ord, (r.ord + 1) / 700d as z, f.ts as top from img_rects r join (select fileid, {THUMBNAIL} as ts from img_files) f on f.fileid = r.fileid")
    return zooms.select("ord", F.expr(level_for("z")).alias("level"))


@own(
    "visible_tiles",
    f"""with p as (select f.fileid, f.width, f.height, r.l, r.t, r.r, r.b, least(3, list_filter(range(0, 31), lambda k : {_HALVINGS} // (cast(1 as bigint) << k) <= 8)[1]) as scale from img_files f join img_rects r on r.fileid = f.fileid where r.l < 3200 and r.r > 0 and r.t < 2400 and r.b > 0),
q as (select *, 256 * (cast(1 as bigint) << scale) as size, width // (cast(1 as bigint) << scale) < 256 and height // (cast(1 as bigint) << scale) < 256 as single from p),
g as (select q.*, unnest(range(0, 17)) as x from q), h as (select g.*, unnest(range(0, 17)) as y from g)
select fileid, cast(scale as int) as scale, x, y from h where case when single then x = 0 and y = 0 else (x + 1) * size > greatest(0, -l) * 4 and (y + 1) * size > greatest(0, -t) * 4 and x * size < floor((least(r, 3200) - l) * 4) and y * size < floor((least(b, 2400) - t) * 4) end""",
)
def visible_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles_in_view(run(spark, sf_dir, _PLACED), 0.5, 0.0, 0.0, 3200.0, 2400.0)


same("tile_vertices", "select fileid, least(width, 512) as right_edge, least(height, 512) as bottom_edge, greatest(0, width - 256) as left_over from img_files")
_MISS = "(select distinct fileid, scale, x, y from img_requests where kind = 'request') q"


def fallback_parents(missing: DataFrame, tiles: DataFrame) -> DataFrame:
    """For missing(fileid, scale, x, y, top) the nearest ancestor that is there, up to fewer than ``top`` levels higher, and which part
    of it shows the missing tile."""
    probed = missing.where("top > 1").withColumn("up", F.expr("explode(sequence(1, top - 1))")).withColumn("factor", F.expr("shiftleft(1, up)"))
    keys = {"ps": "scale + up", "px": "x div factor", "py": "y div factor"}
    probed = probed.withColumns({n: F.expr(f"cast({e} as int)") for n, e in keys.items()})
    first = tiles.groupBy("fileid", F.col("scale").alias("ps"), F.col("x").alias("px"), F.col("y").alias("py")).agg(F.min("rowid").alias("rowid"))
    hits = probed.join(first, ["fileid", "ps", "px", "py"])
    best = hits.groupBy("fileid", "scale", "x", "y").agg(F.expr("min(struct(up, rowid, x % factor as sub_x, y % factor as sub_y))").alias("m"))
    return best.select("fileid", "scale", "x", "y", "m.up", "m.rowid", "m.sub_x", "m.sub_y")


@own(
    "tile_fallback_parent",
    f"""with q as (select q.*, list_filter(range(0, 31), lambda k : {_HALVINGS} // (cast(1 as bigint) << k) <= 8)[1] as top from {_MISS} join img_files f on f.fileid = q.fileid),
t as (select fileid, scale, x, y, min(rowid) as rowid from img_tiles group by all),
h as (select q.*, t.scale - q.scale as up, t.rowid, row_number() over (partition by q.fileid, q.scale, q.x, q.y order by t.scale) as n from q join t on t.fileid = q.fileid and t.scale > q.scale and t.scale - q.scale < q.top and t.x = q.x >> (t.scale - q.scale) and t.y = q.y >> (t.scale - q.scale))
select fileid, scale, x, y, up, rowid, cast(x % (1 << up) as int) as sub_x, cast(y % (1 << up) as int) as sub_y from h where n = 1""",
)
def tile_fallback_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = run(spark, sf_dir, f"select q.*, f.ts as top from {_MISS} join (select fileid, cast({THUMBNAIL} as int) as ts from img_files) f on f.fileid = q.fileid")
    return fallback_parents(missing, fixture(spark, sf_dir, "img_tiles"))


same("tile_fallback_children", f"select q.fileid, q.scale, q.x, q.y, cast(count(t.rowid) as bigint) as children from {_MISS} cross join (values (0, 0), (0, 1), (1, 0), (1, 1)) as c(dx, dy) left join (select fileid, scale, x, y, min(rowid) as rowid from img_tiles group by fileid, scale, x, y) t on t.fileid = q.fileid and t.scale = q.scale - 1 and t.x = q.x * 2 + c.dx and t.y = q.y * 2 + c.dy group by q.fileid, q.scale, q.x, q.y")


@own("pick_image", "select max_by(fileid, ord) as fileid from img_rects where l <= 5000d and 5000d <= r and t <= 4000d and 4000d <= b")
def pick_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "img_rects").where(geo.contains_point(5000.0, 4000.0)).agg(F.max_by("fileid", "ord").alias("fileid"))


def inside(images: DataFrame, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """images(l, t, r, b) that a rectangle holds whole, borders included: what a rubber band selects, in place of what was selected."""
    return images.where(f"l >= {left!r}D and r <= {right!r}D and t >= {top!r}D and b <= {bottom!r}D")


@own("select_images", "select ord from img_rects where least(l, r) between 2000 and 8000 and greatest(l, r) between 2000 and 8000 and t between 2000 and 8000 and b between 2000 and 8000")
def select_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inside(fixture(spark, sf_dir, "img_rects"), 2000.0, 2000.0, 8000.0, 8000.0).select("ord")


_SELECTED = "with s as (select ord from img_rects where ord % 5 = 0)"


@own("delete_selection", f"{_SELECTED} select i.* from img_rects i where not exists (select 1 from s where s.ord = i.ord)")
def delete_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rects = fixture(spark, sf_dir, "img_rects")
    return rects.join(rects.where("ord % 5 = 0").select("ord"), "ord", "left_anti").select(*rects.columns)


@own("isolate_selection", f"{_SELECTED} select i.* from img_rects i where exists (select 1 from s where s.ord = i.ord)")
def isolate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rects = fixture(spark, sf_dir, "img_rects")
    return rects.join(rects.where("ord % 5 = 0").select("ord"), "ord", "left_semi").select(*rects.columns)


@own("move_selection", f"{_SELECTED} select i.ord, i.l + case when s.ord is null then 0d else 40d end as l, i.t + case when s.ord is null then 0d else -25d end as t from img_rects i left join s on s.ord = i.ord")
def move_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rects = fixture(spark, sf_dir, "img_rects")
    return geo.moved_by(rects, rects.where("ord % 5 = 0"), "ord", 40.0, -25.0).select("ord", "l", "t")


def scaled_selection(selected: DataFrame, factor: float) -> DataFrame:
    """selected(x, y, scale) made larger about their middle: places move away from it and each image grows."""
    middle = selected.agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    both = selected.crossJoin(F.broadcast(middle))  # one row
    return both.withColumns({"x": F.expr(f"_mx + (x - _mx) * {factor!r}D"), "y": F.expr(f"_my + (y - _my) * {factor!r}D"), "scale": F.expr(f"scale * {factor!r}D")}).drop("_mx", "_my")


@own("scale_selection", "with s as (select ord, (l + r) / 2d as x, (t + b) / 2d as y from img_rects where ord % 5 = 0) select ord, round(2 * x - avg(x) over (), 5) as x, round(2 * y - avg(y) over (), 5) as y, 0.5d as scale from s")
def scale_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = run(spark, sf_dir, "select ord, (l + r) / 2d as x, (t + b) / 2d as y, 0.25d as scale from img_rects where ord % 5 = 0")
    return scaled_selection(selected, 2.0).select("ord", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), "scale")


@own("resize_factor", "select ord, round(sqrt((l - 10d) * (l - 10d) + (t - 10d) * (t - 10d)) / greatest(1d, sqrt((r - 10d) * (r - 10d) + (b - 10d) * (b - 10d))), 6) as factor from img_rects")
def resize_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, t, r, b = (F.col(c) for c in "ltrb")
    return fixture(spark, sf_dir, "img_rects").select("ord", F.round(geo.stretch(l, t, r, b, 10.0, 10.0), 6).alias("factor"))


def lines_of_grids(grids: DataFrame, extent: int) -> DataFrame:
    """grids(off, size) with the number and place of each line on a display of some extent."""
    lines = grids.withColumn("i", F.expr(f"explode(sequence(0L, {extent} div size))"))
    return lines.withColumn("at", F.expr("cast(off % size + i * size as bigint)")).where(f"at < {extent}")


@own("grid_lines", "with n as (select c_custkey, c_custkey * 37 % 400 % 64 as first from customer) select q.c_custkey, (q.at - q.first) // 64 as i, q.at from (select c_custkey, first, unnest(range(first, 800, 64)) as at from n) q")
def grid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = run(spark, sf_dir, "select c_custkey, (c_custkey * 37) % 400 as off, 64 as size from customer")
    return lines_of_grids(grids, 800).select("c_custkey", "i", "at")


@own("animate_positions", "select ord, l + (r - l) * p as x, t + (b - t) * p as y, 1d + (2d - 1d) * p as scale from (select ord, l, t, r, b, least(1d, (ord % 10) * 0.125d) as p from img_rects) q")
def animate_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.least(F.lit(1.0), (F.col("ord") % 10) * 0.125)
    l, t, r, b = (F.col(c) for c in "ltrb")
    return fixture(spark, sf_dir, "img_rects").select("ord", geo.between(l, r, share).alias("x"), geo.between(t, b, share).alias("y"), geo.between(F.lit(1.0), F.lit(2.0), share).alias("scale"))


same("rescale_provider", "select fileid, round(0.25d * width / greatest(1, width ~/ 2), 9) as scale from img_files")
