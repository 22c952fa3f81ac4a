"""Raster operators over pixel relations (img, x, y, channels), and the tile pyramid.

Each level of a pyramid is made from the one before, because every halving truncates; averages over more levels at once
would differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.image_exprs import THUMBNAIL
from tessera.plans.dialect import Family, fixture, run

FAMILY = Family()
same, own = FAMILY.same, FAMILY.own


def halve(pixels: DataFrame, channels: list[str]) -> DataFrame:
    """A box of two by two pixels becomes one, truncating; an odd last row or column goes."""
    box = pixels.groupBy("img", F.expr("x div 2").cast("int").alias("x"), F.expr("y div 2").cast("int").alias("y"))
    full = box.agg(F.count("*").alias("_n"), *(F.expr(f"cast(sum({c}) div 4 as int)").alias(c) for c in channels))
    return full.where("_n = 4").drop("_n")


def pyramid(pixels: DataFrame, channels: list[str], levels: int) -> DataFrame:
    """All levels (scale 0 is the image) by repeated halving; the loop is over levels, of which there are few."""
    level = pixels.select("img", "x", "y", *channels)
    out = level.withColumn("scale", F.lit(0))
    for scale in range(1, levels + 1):
        level = halve(level, channels)
        out = out.unionByName(level.withColumn("scale", F.lit(scale)))
    return out


def tile_grid(files: DataFrame, min_scale: str = "0", max_scale: str = THUMBNAIL, size: int = 256) -> DataFrame:
    """(fileid, scale, x, y, w, h) of every tile: widths at scale s are w >> s, and levels of no extent have no tiles."""
    levels = files.selectExpr("fileid", "width", "height", f"explode(sequence({min_scale}, {max_scale})) as scale".replace("~/", "div"))
    sized = levels.selectExpr("fileid", "cast(scale as int) as scale", "shiftright(width, cast(scale as int)) as w", "shiftright(height, cast(scale as int)) as h").where("w > 0 and h > 0")
    tiles = sized.withColumn("x", F.explode(F.expr(f"sequence(0, (w + {size - 1}) div {size} - 1)"))).withColumn("y", F.explode(F.expr(f"sequence(0, (h + {size - 1}) div {size} - 1)")))
    return tiles.selectExpr("fileid", "scale", "cast(x as int) as x", "cast(y as int) as y", f"cast(least({size}, w - {size} * x) as int) as w", f"cast(least({size}, h - {size} * y) as int) as h")


_GRID = f"""with lv as (select fileid, width, height, [[0 : {THUMBNAIL}]] as scale from img_files), sz as (select fileid, cast(scale as int) as scale, cast(width ~/ pow2(cast(scale as int)) as int) as w, cast(height ~/ pow2(cast(scale as int)) as int) as h from lv),
tx as (select *, [[0 : (w + 255) ~/ 256 - 1]] as x from sz where w > 0 and h > 0), ty as (select *, [[0 : (h + 255) ~/ 256 - 1]] as y from tx)"""


@own("tile_pyramid", f"{_GRID} select fileid, scale, cast(x as int) as x, cast(y as int) as y, cast(least(256, w - 256 * x) as int) as w, cast(least(256, h - 256 * y) as int) as h from ty")
def tile_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_grid(fixture(spark, sf_dir, "img_files"))


@own("pyramid_counts", f"{_GRID} select scale, count(*) as tiles, count(distinct fileid) as files, cast(sum(cast(least(256, w - 256 * x) as bigint) * least(256, h - 256 * y)) as bigint) as pixels from ty group by scale")
def pyramid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = tile_grid(fixture(spark, sf_dir, "img_files"))
    return grid.groupBy("scale").agg(F.count("*").alias("tiles"), F.countDistinct("fileid").alias("files"), F.sum(F.col("w").cast("long") * F.col("h")).alias("pixels"))


@own("halve", "select img, cast(x ~/ 2 as int) as x, cast(y ~/ 2 as int) as y, cast(sum(r) ~/ 4 as int) as r, cast(sum(g) ~/ 4 as int) as g, cast(sum(b) ~/ 4 as int) as b from img_colours group by img, x ~/ 2, y ~/ 2")
def halved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return halve(fixture(spark, sf_dir, "img_colours"), ["r", "g", "b"])


@own("pyramid_pixels", "with a as (select 0 as scale, img, x, y, g from img_pixels), b as (select 1 as scale, img, x ~/ 2 as x, y ~/ 2 as y, sum(g) ~/ 4 as g from a group by img, x ~/ 2, y ~/ 2), c as (select 2 as scale, img, x ~/ 2 as x, y ~/ 2 as y, sum(g) ~/ 4 as g from b group by img, x ~/ 2, y ~/ 2) select cast(scale as int) as scale, img, cast(x as int) as x, cast(y as int) as y, cast(g as int) as g from (select * from a union all select * from b union all select * from c)")
def pyramid_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid(fixture(spark, sf_dir, "img_pixels"), ["g"], 2).select("scale", "img", "x", "y", "g")


@own("scale_nearest", "with d as (select dx, [[0 : 4]] as dy from (select [[0 : 4]] as dx) q) select p.img, cast(d.dx as int) as x, cast(d.dy as int) as y, p.g from img_pixels p join d on p.x = d.dx * 8 ~/ 5 and p.y = d.dy * 8 ~/ 5")
def scale_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled(fixture(spark, sf_dir, "img_pixels"), ["g"], 8, 8, 5, 5)


@own("crop", "select img, x - 2 as x, y - 3 as y, r, g, b from img_colours where x >= 2 and x < 7 and y >= 3 and y < 8")
def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cropped(fixture(spark, sf_dir, "img_colours"), ["r", "g", "b"], 2, 3, 7, 8)


def blit(target: DataFrame, source: DataFrame, x: int, y: int, source_alpha: bool, target_alpha: bool) -> DataFrame:
    """target(img, x, y, r, g, b, a) after source is drawn into it at a place; what does not meet the target is cut off. Alpha is copied if both
    surfaces have it; a source without makes the target opaque; a target without takes colours times the source's alpha."""
    over = source.selectExpr("img", f"x + {x} as x", f"y + {y} as y", "r as sr", "g as sg", "b as sb", "a as sa", "true as met")
    drawn = [f"cast(coalesce({f's{c} * sa div 255' if source_alpha and not target_alpha else f's{c}'}, {c}) as int) as {c}" for c in ("r", "g", "b")]
    alpha = "255" if not target_alpha else f"case when met then {'sa' if source_alpha else '255'} else a end"
    return target.join(over, ["img", "x", "y"], "left").selectExpr("img", "x", "y", *drawn, f"cast({alpha} as int) as a")


def blend(target: DataFrame, source: DataFrame) -> DataFrame:
    """source(img, x, y, r, g, b, a) drawn over target(img, x, y, r, g, b) by its alpha, rounded to the nearest value."""
    over = source.selectExpr("img", "x", "y", "r as sr", "g as sg", "b as sb", "a as sa")
    mixed = [f"cast((2 * ({c} * (255 - sa) + s{c} * sa) + 255) div 510 as int) as {c}" for c in ("r", "g", "b")]
    return target.join(over, ["img", "x", "y"]).selectExpr("img", "x", "y", *mixed)


#: Each colour image with its successor as the source; alpha falls with the red plane.
_SURFACES = "select img, x, y, r, g, b, 255 - r as a from img_colours"


def _pictures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    target = run(spark, sf_dir, _SURFACES)
    return target, target.withColumn("img", F.col("img") - 1)


_PAIRS = [("rgb_rgb", False, False), ("rgba_rgba", True, True), ("rgb_rgba", False, True), ("rgba_rgb", True, False)]


@own(
    "blit",
    f"""with c as ({_SURFACES}), j as (select d.*, s.r as sr, s.g as sg, s.b as sb, s.a as sa from c d left join c s on s.img = d.img + 1 and s.x + 3 = d.x and s.y + 2 = d.y)
select 'rgb_rgb' as pair, img, x, y, ifnull(sr, r) as r, ifnull(sg, g) as g, ifnull(sb, b) as b, 255 as a from j
union all select 'rgba_rgba', img, x, y, ifnull(sr, r), ifnull(sg, g), ifnull(sb, b), ifnull(sa, a) from j
union all select 'rgb_rgba', img, x, y, ifnull(sr, r), ifnull(sg, g), ifnull(sb, b), if(sr is null, a, 255) from j
union all select 'rgba_rgb', img, x, y, cast(ifnull(sr * sa // 255, r) as int), cast(ifnull(sg * sa // 255, g) as int), cast(ifnull(sb * sa // 255, b) as int), 255 from j""",
)
def blits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four pairs of formats, named source first."""
    target, source = _pictures(spark, sf_dir)
    drawn = [blit(target, source, 3, 2, a, b).select(F.lit(name).alias("pair"), "*") for name, a, b in _PAIRS]
    return drawn[0].unionAll(drawn[1]).unionAll(drawn[2]).unionAll(drawn[3])


@own("alpha_blend", f"with c as ({_SURFACES}) select d.img, d.x, d.y, cast(floor((s.r * s.a + d.r * (255 - s.a)) / 255d + 0.5d) as int) as r, cast(floor((s.g * s.a + d.g * (255 - s.a)) / 255d + 0.5d) as int) as g, cast(floor((s.b * s.a + d.b * (255 - s.a)) / 255d + 0.5d) as int) as b from c d join c s on s.img = d.img + 1 and s.x = d.x and s.y = d.y")
def blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, source = _pictures(spark, sf_dir)
    return blend(target.drop("a"), source)


def scaled(pixels: DataFrame, channels: list[str], width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Surfaces of one size at another one: each place takes the pixel that it falls on."""
    places = [(dx, dy, dx * width // to_width, dy * height // to_height) for dx in range(to_width) for dy in range(to_height)]
    table = F.broadcast(pixels.sparkSession.createDataFrame(places, "dx int, dy int, x int, y int"))  # of the target's size
    return pixels.join(table, ["x", "y"]).select("img", F.col("dx").alias("x"), F.col("dy").alias("y"), *channels)


def cropped(pixels: DataFrame, channels: list[str], left: int, top: int, right: int, bottom: int) -> DataFrame:
    inside = pixels.where(f"x >= {left} and x < {right} and y >= {top} and y < {bottom}")
    return inside.select("img", (F.col("x") - left).alias("x"), (F.col("y") - top).alias("y"), *channels)


def averages(pixels: DataFrame, channels: list[str]) -> DataFrame:
    """The mean of each channel of each surface, truncated."""
    return pixels.groupBy("img").agg(*(F.expr(f"cast(sum({c}) div count(*) as int)").alias(c) for c in channels))


def put_pixels(pixels: DataFrame, new: DataFrame, channels: list[str]) -> DataFrame:
    """pixels with the values of new(img, x, y, channels) in their places; places that no surface has are passed over."""
    named = new.select("img", "x", "y", *(F.col(c).alias(f"_{c}") for c in channels))
    return pixels.join(named, ["img", "x", "y"], "left").select("img", "x", "y", *(F.coalesce(f"_{c}", c).alias(c) for c in channels))


@own("pixel_put", "select img, x, y, case when x = img % 8 and y = img % 5 then 7 else g end as g from img_pixels")
def pixel_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = fixture(spark, sf_dir, "img_pixels")
    return put_pixels(pixels, pixels.select("img").distinct().selectExpr("img", "cast(img % 8 as int) as x", "cast(img % 5 as int) as y", "7 as g"), ["g"])


@own("pixel_get", "select vec_id as img, cast(least(255, greatest(0, floor((cast(embedding[vec_id % 5 * 8 + vec_id % 8 + 1] as double) + 1) * cast(127.5 as double)))) as int) as g from embeddings")
def pixel_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = fixture(spark, sf_dir, "img_pixels")
    points = pixels.select("img").distinct().selectExpr("img", "cast(img % 8 as int) as x", "cast(img % 5 as int) as y")
    return points.join(pixels, ["img", "x", "y"]).select("img", "g")


same("transform_rot90", "select img, 7 - y as x, x as y, g from img_pixels")
_TURNS = """select p.img, m.name, case m.name when 'Rot0' then x when 'Rot90' then 7 - y when 'Rot180' then 7 - x when 'Rot270' then y when 'Rot0Flip' then x when 'Rot90Flip' then 7 - y when 'Rot180Flip' then 7 - x else y end as x,
 case m.name when 'Rot0' then y when 'Rot90' then x when 'Rot180' then 7 - y when 'Rot270' then 7 - x when 'Rot0Flip' then 7 - y when 'Rot90Flip' then 7 - x when 'Rot180Flip' then y else x end as y, g
from img_pixels p cross join (values ('Rot0'), ('Rot90'), ('Rot180'), ('Rot270'), ('Rot0Flip'), ('Rot90Flip'), ('Rot180Flip'), ('Rot270Flip')) as m(name)"""


same("transform_all", _TURNS)


@own("to_rgb", "select img, x, y, r, g, b from (select *, 255 - r as a from img_colours) q")
def to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, _SURFACES).drop("a")


@own("average_color", "select img, cast(sum(r) ~/ count(*) as int) as r, cast(sum(g) ~/ count(*) as int) as g, cast(sum(b) ~/ count(*) as int) as b from img_colours group by img")
def average_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return averages(fixture(spark, sf_dir, "img_colours"), ["r", "g", "b"])


same("merge_images", "select x, y, cast(floor(round(255d * greatest(0d, least(1d, power(s / n, 2.2d))), 6)) as int) as v from (select x, y, sum(power(g / 255d, 0.4545d)) as s, count(*) as n from img_pixels group by x, y) q")
_NEAR = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
#: Pairs of neighbours that, both dark, darken the pixel between them: opposite ones and knight's moves.
_BRIDGES = [(a, b) for i, a in enumerate(_NEAR) for b in _NEAR[i + 1 :] if a[0] + b[0] == 0 == a[1] + b[1] or sorted((abs(a[0] - b[0]), abs(a[1] - b[1]))) == [1, 2]]
_FLAG = "max(case when q.dx = {} and q.dy = {} then q.dark end) = 1"
same(
    "blackfill",
    f"""with c as (select img, x, y, r, g, b, case when r < 128 or g < 128 or b < 128 then 1 else 0 end as dark from img_colours), q as (select c.img, c.x + o.dx as x, c.y + o.dy as y, -o.dx as dx, -o.dy as dy, c.dark from c cross join (values {", ".join(str(o) for o in _NEAR)}) as o(dx, dy)),
f as (select img, x, y, {" or ".join(f"({_FLAG.format(*a)} and {_FLAG.format(*b)})" for a, b in _BRIDGES)} as fill from q where x between 1 and 6 and y between 1 and 6 group by img, x, y)
select c.img, c.x, c.y, case when f.fill then 0 else c.r end as r, case when f.fill then 0 else c.g end as g, case when f.fill then 0 else c.b end as b from c left join f on f.img = c.img and f.x = c.x and f.y = c.y""",
)
same("extract_channel", "with h as (select img, x ~/ 2 as x, y ~/ 2 as y, sum(r) ~/ 4 as r, sum(g) ~/ 4 as g, sum(b) ~/ 4 as b from img_colours group by img, x ~/ 2, y ~/ 2) select img, cast(x as int) as x, cast(y as int) as y, cast(case when y % 2 = 0 then r else 0 end as int) as r, cast(case when y % 2 = 0 then r else g end as int) as g, cast(case when y % 2 = 0 then r else b end as int) as b from h")


@own("bit_plane", "select img, x, y, case when (r ~/ 8) % 2 = 1 then 255 else 0 end as r, case when (g ~/ 8) % 2 = 1 then 255 else 0 end as g, case when (b ~/ 8) % 2 = 1 then 255 else 0 end as b from img_colours")
def bit_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda c: F.when(F.col(c).bitwiseAND(F.lit(8)) != 0, 255).otherwise(0).alias(c)
    return fixture(spark, sf_dir, "img_colours").select("img", "x", "y", bit("r"), bit("g"), bit("b"))


_CORNER = "max(case when x = {} and y = {} then g end)"
_PATCHES = f"with h as (select img, x ~/ 2 as x, y ~/ 2 as y, sum(g) ~/ 4 as g from img_pixels group by img, x ~/ 2, y ~/ 2), p as (select img, {_CORNER.format(0, 0)} as tl, {_CORNER.format(1, 0)} as tr, {_CORNER.format(0, 1)} as bl, {_CORNER.format(1, 1)} as br from h group by img)"


def nearest(patches: DataFrame, tiles: DataFrame, blocks: int = 64) -> DataFrame:
    """(query, tile, dist) of each patch (img, tl, tr, bl, br) and the tile at the least squared distance; of ties the last tile.

    A patch with an equal tile takes it by an equality join. All others are compared with all different tiles,
    which are dealt into blocks for it.
    """
    corners = ["tl", "tr", "bl", "br"]
    tiles = tiles.groupBy(*corners).agg(F.max("img").alias("tile"))
    found = patches.withColumnRenamed("img", "query").join(tiles, corners, "left").withColumn("dist", F.lit(0).cast("long"))
    rest = found.where("tile is null").select("query", *(F.col(c).alias(f"q{c}") for c in corners))
    dist = "cast(" + " + ".join(f"(q{c} - {c}) * (q{c} - {c})" for c in corners) + " as bigint)"
    rest = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = tiles.withColumn("block", F.pmod(F.hash(*corners), F.lit(blocks)))
    least = rest.join(dealt, "block").groupBy("query").agg(F.expr(f"min(struct({dist} as dist, -tile as last))").alias("m"))
    return found.where("tile is not null").select("query", "tile", "dist").unionByName(least.selectExpr("query", "-m.last as tile", "m.dist"))


@own(
    "nearest_patch",
    f"""with h as (select img, x ~/ 2 as x, y ~/ 2 as y, sum(g) ~/ 4 as g from img_pixels group by img, x ~/ 2, y ~/ 2), p as (select img, {_CORNER.format(0, 0)} as tl, {_CORNER.format(1, 0)} as tr, {_CORNER.format(0, 1)} as bl, {_CORNER.format(1, 1)} as br from h group by img),
d as (select q.img as query, t.img as tile, cast((q.tl - t.tl) * (q.tl - t.tl) + (q.tr - t.tr) * (q.tr - t.tr) + (q.bl - t.bl) * (q.bl - t.bl) + (q.br - t.br) * (q.br - t.br) as bigint) as dist from p q cross join p t),
r as (select *, row_number() over (partition by query order by dist, tile desc) as n from d) select query, tile, dist from r where n = 1""",
)
def nearest_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every patch is matched against all patches as tiles, so each finds itself or an equal one behind it."""
    patches = run(spark, sf_dir, f"{_PATCHES} select * from p")
    return nearest(patches, patches)


def escape_times(points: DataFrame, most: int = 160) -> DataFrame:
    """points(x, y, a, b) with the gray value of each: the iterations until escape, by a fold."""
    start = "named_struct('u', 0D, 'v', 0D, 'n', 0)"
    step = "case when s.u * s.u + s.v * s.v <= 4D then named_struct('u', s.u * s.u - s.v * s.v + a, 'v', 2D * s.u * s.v + b, 'n', s.n + 1) else s end"
    return points.selectExpr("x", "y", f"cast(255 * aggregate(sequence(1, {most}), {start}, (s, i) -> {step}, s -> s.n) div {most} as int) as gray")


def mandelbrot(spark: SparkSession, scale: int, x: int, y: int, size: int = 256, unit: int = 256 << 20) -> DataFrame:
    """A tile of the set's image, which is 4 by 3 units large."""
    w, h = float((4 * unit) >> scale), float((3 * unit) >> scale)
    grid = spark.range(size * size).selectExpr(f"cast(id % {size} as int) as x", f"cast(id div {size} as int) as y")
    return escape_times(grid.selectExpr("x", "y", f"({size * x} + x) / {w}D * 4D - 2.5D as a", f"({size * y} + y) / {h}D * 3D - 1.5D as b"))


@own("mandelbrot_tile", "with recursive p as (select cast(px as int) as x, cast(py as int) as y, (256 + px) / 1024d * 4d - 2.5d as a, (256 + py) / 768d * 3d - 1.5d as b from (select px, [[0 : 255]] as py from (select [[0 : 255]] as px) q)), m as (select x, y, a, b, 0d as u, 0d as v, 0 as n from p union all select x, y, a, b, u * u - v * v + a, 2d * u * v + b, n + 1 from m where u * u + v * v <= 4d and n < 160) select x, y, cast(255 * max(n) ~/ 160 as int) as gray from m group by x, y")
def mandelbrot_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle tile of the level at which the set is four tiles wide."""
    return mandelbrot(spark, 20, 1, 1)


# -- planning of tile generation -----------------------------------------------------------------------------------------
#: Files of which some lie on other machines.
_SOURCES = "select *, case when fileid % 6 = 5 then replace(url, 'file:///', 'http://host.example/') else url end as place from img_files"
_REMOTE, _JPEG = "place not like 'file:%'", "rx(lower(place), '[.]jpe?g$')"
_TS = f"select fileid, place, {_JPEG} and not ({_REMOTE}) as jpeg, {THUMBNAIL} as ts from ({_SOURCES}) q"
_HAVE = "select fileid, min(scale) as lo, max(scale) as hi from img_tiles group by fileid"


#: SQL: by how much a JPEG decoder scales down, from the level of the thumbnail.
DENOMINATOR = "least(shiftleft(1, greatest(0, cast(ts as int) - 3)), 8)"


def generated_levels(jpeg: F.Column, ts: F.Column) -> tuple[F.Column, F.Column]:
    """The levels that are made of a file: of JPEG files on this machine not those that its decoder gives, of others all."""
    return F.when(jpeg, F.least(F.greatest(F.lit(0), ts - 3), F.lit(3))).otherwise(0).cast("int"), ts.cast("int")


def incremental(files: DataFrame, stored: DataFrame) -> DataFrame:
    """The levels of files(fileid, low, high) that stored(fileid, lo, hi) still lacks, and whether there are any."""
    known = files.join(stored, "fileid", "left")
    low, high = F.least("low", F.coalesce("lo", "low")), F.least("high", F.coalesce(F.col("lo") - 1, F.col("high")))
    return known.select("fileid", low.cast("int").alias("min_scale"), high.cast("int").alias("max_scale"), (F.col("lo").isNull() | (F.col("low") < F.col("lo"))).alias("runs"))


@own("jpeg_decode_scale", f"with f as ({_TS}) select fileid, cast(least(pow2(cast(greatest(0, ts - 3) as int)), 8) as int) as denominator from f where jpeg")
def jpeg_decode_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = run(spark, sf_dir, f"with f as ({_TS}) select * from f").where("jpeg")
    return files.select("fileid", F.expr(DENOMINATOR).cast("int").alias("denominator"))


@own("generation_range", f"with f as ({_TS}) select fileid, cast(case when jpeg then least(greatest(0, ts - 3), 3) else 0 end as int) as min_scale, cast(ts as int) as max_scale from f")
def generation_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = run(spark, sf_dir, f"with f as ({_TS}) select * from f")
    low, high = generated_levels(F.col("jpeg"), F.col("ts"))
    return files.select("fileid", low.alias("min_scale"), high.alias("max_scale"))


same("thumbgen_plan", f"with f as ({_TS}) select fileid, cast(greatest(0, ts - 3) as int) as min_scale, cast(ts as int) as max_scale, 0 as min_scale_all from f")


@own("incremental_plan", f"with f as ({_TS}), h as ({_HAVE}), p as (select f.fileid, greatest(0, f.ts - 3) as a, f.ts as b, h.lo, h.hi from f left join h on h.fileid = f.fileid) select fileid, cast(case when lo is null then a else least(a, lo) end as int) as min_scale, cast(case when lo is null then b else least(b, lo - 1) end as int) as max_scale, lo is null or a < lo as runs from p")
def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = run(spark, sf_dir, f"with f as ({_TS}) select fileid, greatest(0, ts - 3) as low, ts as high from f")
    return incremental(files, run(spark, sf_dir, _HAVE))


def on_demand_ranges(files: DataFrame, stored: DataFrame, requests: DataFrame) -> DataFrame:
    """The levels that a job makes for files(fileid, jpeg, ts) with requests(fileid, scale) of levels that stored(fileid, lo, hi) lacks.

    All levels of what is not a JPEG file on this machine. Of one that is, from the level asked for, or the one below the stored ones
    if that is less, up to that one; where this gives no range, as with level 0 stored, all levels as well.
    """
    missing = requests.join(stored, "fileid", "left").where("lo is null or scale < lo or scale > hi")
    wanted = missing.groupBy("fileid").agg(F.min("scale").alias("wanted"), F.first("lo").alias("lo"))
    ranged = files.join(wanted, "fileid").withColumn("high", F.expr("case when jpeg then coalesce(lo - 1, ts) else ts end"))
    ranged = ranged.withColumn("low", F.expr("case when jpeg then least(high, wanted) else 0 end"))
    odd = "high = -1 or low = -1"
    return ranged.selectExpr("fileid", f"cast(case when {odd} then 0 else low end as int) as min_scale", f"cast(case when {odd} then ts else high end as int) as max_scale")


@own(
    "ondemand_plan",
    f"""with f as (select fileid, fileid % 6 <> 5 and regexp_matches(url, '[.](jpg|JPEG)$') as jpeg, list_filter(range(0, 31), lambda k : greatest(width, height) // (cast(1 as bigint) << k) <= 8)[1] as ts from img_files), h as ({_HAVE}),
a as (select f.*, h.lo, list(q.scale) filter (where h.lo is null or not q.scale between h.lo and h.hi) as asked from f join img_requests q on q.fileid = f.fileid and q.kind = 'request' left join h on h.fileid = f.fileid group by f.fileid, jpeg, ts, lo, hi),
r as (select fileid, jpeg, ts, if(lo is null, ts, lo - 1) as top, list_min(list_append(asked, cast(if(lo is null, ts, lo - 1) as int))) as low from a where len(asked) > 0)
select fileid, cast(if(not jpeg or top < 0 or low < 0, 0, low) as int) as min_scale, cast(if(not jpeg or top < 0 or low < 0, ts, top) as int) as max_scale from r""",
)
def ondemand_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, stored = run(spark, sf_dir, f"with f as ({_TS}) select fileid, jpeg, ts from f"), run(spark, sf_dir, _HAVE)
    return on_demand_ranges(files, stored, fixture(spark, sf_dir, "img_requests").where("kind = 'request'").select("fileid", "scale"))
