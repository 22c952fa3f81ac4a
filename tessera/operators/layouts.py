"""Layouts: ordered images(fileid, width, height) to places and scales.

A layout takes the images in order of their ids and gives (fileid, x, y, scale), the place of each image's middle. Numbers come
from ranges of ids; only the tight layout, where each place depends on the one before, is a fold over the order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ordering import numbered, running
from tessera.plans.dialect import Family, fixture

FAMILY = Family()
own = FAMILY.own

PITCH, EXTENT, SPACING = 1024.0, 1000.0, 24.0
_ORDERED = "select fileid, width, height, row_number() over (order by fileid) - 1 as i, count(*) over () as n from img_files"
_SCALE = "round(least(1000d / width, 1000d / height), 9) as scale"


def regular(images: DataFrame, aspect: float = 4 / 3) -> DataFrame:
    """Rows of equal cells, every other one from right to left; as wide as the aspect asks for."""
    width = max(1, int((aspect * images.count()) ** 0.5))
    placed = numbered(images, "fileid", "n").withColumn("i", F.col("n") - 1)
    column = f"case when (i div {width}) % 2 = 0 then i % {width} else {width} - i % {width} - 1 end"
    return placed.selectExpr("fileid", f"{column} * {PITCH}D as x", f"(i div {width}) * {PITCH}D as y", f"round(least({EXTENT}D / width, {EXTENT}D / height), 9) as scale")


@own("layout_regular", f"with o as ({_ORDERED}), w as (select *, greatest(1, cast(floor(sqrt(4d * n / 3d)) as bigint)) as w from o) select fileid, case when (i ~/ w) % 2 = 0 then (i % w) * 1024d else (w - (i % w) - 1) * 1024d end as x, (i ~/ w) * 1024d as y, {_SCALE} from w")
def layout_regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular(fixture(spark, sf_dir, "img_files"))


def vertical(images: DataFrame, gap: int = 10) -> DataFrame:
    """One below the other at their own size."""
    stacked = running(images, "fileid", {"below": F.col("height") + gap})
    return stacked.select("fileid", F.lit(0.0).alias("x"), (F.col("below") - F.col("height") - gap).cast("double").alias("y"), F.lit(1.0).alias("scale"))


@own("layout_vertical", "select fileid, 0d as x, coalesce(sum(height + 10) over (order by fileid rows between unbounded preceding and 1 preceding), 0) * 1d as y, 1d as scale from img_files")
def layout_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertical(fixture(spark, sf_dir, "img_files"))


def spiral(images: DataFrame) -> DataFrame:
    """Cells around the first image, ring by ring; ring g begins at number 4 g g + 1."""
    placed = numbered(images, "fileid", "n").withColumn("i", F.col("n") - 1)
    rings = placed.withColumn("g", F.expr("case when i = 0 then 0L else cast(floor(sqrt((i - 1) / 4D)) as bigint) end")).withColumn("k", F.expr("i - (4 * g * g + 1)"))
    x = "case when i = 0 then 1 when k < 2 * g then 2 - g + k when k < 4 * g + 1 then g + 1 when k < 6 * g + 2 then g - (k - 4 * g - 1) else -g end"
    y = "case when i = 0 then 0 when k < 2 * g then -g when k < 4 * g + 1 then 1 - g + (k - 2 * g) when k < 6 * g + 2 then g + 1 else g - (k - 6 * g - 2) end"
    return rings.selectExpr("fileid", f"({x}) * {PITCH}D as x", f"({y}) * {PITCH}D as y", f"round(least({EXTENT}D / width, {EXTENT}D / height), 9) as scale")


_RING = "cast(floor(sqrt((i - 1) / 4d)) as bigint)"


@own(
    "layout_spiral",
    f"""with o as ({_ORDERED}), q as (select fileid, width, height, i, case when i = 0 then 0 else {_RING} end as g from o), k as (select *, i - (4 * g * g + 1) as k from q),
p as (select fileid, width, height, case when i = 0 then 1 when k < 2 * g then 2 - g + k when k < 4 * g + 1 then g + 1 when k < 6 * g + 2 then g - (k - 4 * g - 1) else -g end as x,
 case when i = 0 then 0 when k < 2 * g then -g when k < 4 * g + 1 then 1 - g + (k - 2 * g) when k < 6 * g + 2 then g + 1 else g - (k - 6 * g - 2) end as y from k)
select fileid, x * 1024d as x, y * 1024d as y, {_SCALE} from p""",
)
def layout_spiral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiral(fixture(spark, sf_dir, "img_files"))


def scattered(images: DataFrame, seed: int = 1) -> DataFrame:
    """Places in a square that grows with the root of the number of images, and scales from 0.25 to 1.25, drawn from a digest of the
    id; reruns agree."""
    side = int(images.count() ** 0.5 * 1500)
    draw = lambda salt, most: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.col("fileid"), F.lit(seed + salt))), 1, 12), 16, 10).cast("long"), F.lit(max(most, 1)).cast("long"))
    return images.select("fileid", draw(0, side).alias("x"), draw(1, side).alias("y"), (draw(2, 1000) / 1000.0 + 0.25).alias("scale"))


_DRAW = "cast(('0x' || substr(md5(concat_ws(':', fileid, {})), 1, 12)) as bigint) % {}"
_SIDE = "(select greatest(1, cast(floor(sqrt(count(*)) * 1500) as bigint)) from img_files)"


@own("layout_random", f"select fileid, {_DRAW.format(1, _SIDE)} as x, {_DRAW.format(2, _SIDE)} as y, ({_DRAW.format(3, 1000)}) / 1000d + 0.25d as scale from img_files")
def layout_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scattered(fixture(spark, sf_dir, "img_files"))


def tight(images: DataFrame, aspect: float = 4 / 3) -> DataFrame:
    """Rows of equal height that alternate direction and end where the next image would pass the border. Each place depends on the
    one before, so the order goes through one task, as Arrow batches with the state of a row; no list of images is held."""
    step = EXTENT + SPACING
    total = images.selectExpr(f"sum(cast(round(width * {step}D / height, 6) as decimal(30,6))) as s").first()["s"]
    border = (float(total or 0) * aspect * step) ** 0.5

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, last, right = 0.0, 0.0, 0.0, True
        for frame in frames:
            places = []
            for width, height in zip(frame["width"].tolist(), frame["height"].tolist()):
                wide = width * EXTENT / height
                turn = x + wide > border if right else x - wide < 0
                if turn:
                    x, y, right = (last if right else x), y + step, not right
                elif not right:
                    x -= wide + SPACING
                last = x
                places.append((x + wide / 2, y + EXTENT / 2, EXTENT / height))
                if right:
                    x += wide + SPACING
            made = pd.DataFrame(places, columns=["x", "y", "scale"], dtype=float)
            yield pd.DataFrame({"fileid": frame["fileid"].to_numpy(), "x": made["x"].round(4), "y": made["y"], "scale": made["scale"].round(9)})

    return images.select("fileid", "width", "height").orderBy("fileid").coalesce(1).mapInPandas(fold, "fileid long, x double, y double, scale double")


#: The state after each image: corner of the image (px, py), where the next begins (x), and the direction.
_FOLD = """with recursive o as (select fileid, cast(width as double) as w, cast(height as double) as h, row_number() over (order by fileid) as i from img_files),
b as (select sqrt(cast(sum(cast(round(w * 1024d / h, 6) as decimal(30,6))) as double) * (4d / 3d) * 1024d) as border from o),
z as (select cast(0 as bigint) as i, cast(null as bigint) as fileid, 0d as px, 0d as py, 0d as x, true as goes, 0d as w, 0d as h
union all select i, fileid, px, py, case when goes then px + w + 24d else px end, goes, w, h from (
 select s.i, s.fileid, s.wide as w, s.h, case when z.goes and turn then z.px when z.goes or turn then z.x else z.x - (s.wide + 24d) end as px, z.py + case when turn then 1024d else 0d end as py, z.goes <> turn as goes
 from z join (select i, fileid, w * 1000d / h as wide, h from o) s on s.i = z.i + 1 cross join b, lateral (select case when z.goes then z.x + s.wide > b.border else z.x - s.wide < 0 end as turn) t))
select fileid, round(px + w / 2d, 4) as x, py + 500d as y, round(1000d / h, 9) as scale from z where i > 0"""


@own("layout_zigzag", _FOLD)
def layout_zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tight(fixture(spark, sf_dir, "img_files"))


#: The layouts by name; a new one is entered here.
LAYOUTS: dict[str, Callable[[DataFrame], DataFrame]] = {"regular": regular, "vertical": vertical, "spiral": spiral, "random": scattered, "tight": tight}
