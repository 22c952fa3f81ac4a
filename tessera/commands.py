"""The batch commands over a catalog of two tables, ``files`` and ``tiles``, kept as Parquet snapshots below one path.

A command reads the current snapshot, computes a new one, and moves a small pointer file to it; readers see either. There is one
writer at a time.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.image_exprs import THUMBNAIL
from tessera.operators import catalog
from tessera.plans.dialect import render
from tessera.sources import images

FILES = "fileid long, url string, size long, mtime long, width int, height int, format int"
TILES = "rowid long, fileid long, scale int, x int, y int, data binary, quality int, format int"


@dataclass
class Store:
    spark: SparkSession
    path: str

    def _pointer(self) -> str | None:
        try:
            rows = self.spark.read.text(f"{self.path}/current").orderBy(F.desc("value")).head(1)
        except Exception as error:  # the store is new
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise
        return rows[0]["value"] if rows else None

    def _read(self, table: str, schema: str) -> DataFrame:
        snapshot = self._pointer()
        if snapshot is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{snapshot}/{table}")

    @property
    def files(self) -> DataFrame:
        return self._read("files", FILES)

    @property
    def tiles(self) -> DataFrame:
        return self._read("tiles", TILES)

    def save(self, files: DataFrame, tiles: DataFrame) -> None:
        """A new snapshot; tiles lie in folders by scale, sorted by file, so that lookups prune."""
        name = f"snapshot-{time.time_ns():020d}"
        files.select("fileid", "url", "size", "mtime", "width", "height", "format").write.parquet(f"{self.path}/{name}/files")
        columns = [c.split(" ")[0] for c in TILES.split(", ")]
        tiles.select(*columns).repartition("scale", "fileid").sortWithinPartitions("fileid", "x", "y").write.partitionBy("scale").parquet(f"{self.path}/{name}/tiles")
        self.spark.createDataFrame([(name,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/current")


def list_files(store: Store, patterns: list[str] | None = None) -> DataFrame:
    files = store.files
    return (catalog.find_all(files, patterns) if patterns else files).select("url")


def check(store: Store, listing: DataFrame) -> DataFrame:
    """Each url with whether the listing(url) still has it."""
    there = listing.select("url").distinct().withColumn("there", F.lit(True))
    return store.files.join(there, "url", "left").select("url", F.coalesce("there", F.lit(False)).alias("exists"))


def filegen(store: Store, pictures: DataFrame) -> None:
    """Enter pictures(path, length, modificationTime, content) that the catalog does not have, with the sizes in their headers."""
    missing = pictures.join(store.files.select(F.col("url").alias("path")), "path", "left_anti")
    jpeg = F.lower("path").rlike("[.]jpe?g$")
    new = missing.select("path", "length", "modificationTime").join(images.image_sizes(missing), "path")
    new = new.select(F.col("path").alias("url"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), "width", "height", F.when(jpeg, 0).otherwise(1).alias("format"))
    store.save(catalog.upsert(store.files, new), store.tiles)


def thumbgen(store: Store, pictures: DataFrame, every: bool = False, foreign: DataFrame | None = None) -> None:
    """Make the tiles that the store lacks: of each file the four smallest levels, or all with ``every``. What the decoders here do not
    read comes from ``foreign`` (see ``images.read_foreign``)."""
    files, tiles = store.files, store.tiles
    plan = files.withColumn("top", F.expr(render(THUMBNAIL, "spark"))).withColumn("low", F.lit(0) if every else F.greatest(F.lit(0), F.col("top") - 3))
    have = tiles.groupBy("fileid").agg(F.min("scale").alias("lo"))
    plan = plan.join(have, "fileid", "left").where("lo is null or low < lo").selectExpr("url as path", "fileid", "cast(low as int) as low", "cast(coalesce(lo - 1, top) as int) as high")
    surfaces = images.decoded(pictures.join(plan.select("path"), "path", "left_semi"))
    if foreign is not None:
        surfaces = surfaces.unionByName(foreign)
    top = tiles.agg(F.coalesce(F.max("rowid"), F.lit(0)).alias("m")).first()["m"]
    made = images.cut_tiles(surfaces.join(plan, "path"))
    new = made.select((F.monotonically_increasing_id() + F.lit(top + 1)).alias("rowid"), "fileid", "scale", "x", "y", "data", F.lit(0).alias("quality"), F.lit(1).alias("format"))
    store.save(files, tiles.unionByName(new))


def prepare(store: Store, pictures: DataFrame, foreign: DataFrame | None = None) -> None:
    filegen(store, pictures)
    thumbgen(store, pictures, every=True, foreign=foreign)


def downscale(foreign: DataFrame, levels: int = 3) -> DataFrame:
    """(path, data): each surface at an eighth of its size, as PNG."""
    small = foreign.select(F.monotonically_increasing_id().alias("fileid"), F.lit(levels).alias("low"), F.lit(levels).alias("high"), "*")
    tiles = images.cut_tiles(small, 1 << 16)
    return small.select("fileid", "path").join(tiles, "fileid").select("path", "data")


def view(store: Store, urls: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """What a viewer opens: the catalog's files of these urls, and those that match a pattern, with the levels that are there."""
    known = store.files.join(urls.select("url"), "url", "left_semi")
    if patterns:
        known = known.unionByName(catalog.find_all(store.files, patterns))
    return catalog.scale_ranges(known, store.tiles)


def delete(store: Store, urls: DataFrame) -> None:
    gone = store.files.join(urls.select("url"), "url", "left_semi")
    store.save(*catalog.delete_cascade(store.files, store.tiles, gone))


def cleanup(store: Store) -> None:
    """Without orphans and doubles, in fresh files."""
    owned = store.tiles.join(store.files.select("fileid"), "fileid", "left_semi")
    store.save(store.files, catalog.deduplicate(owned))


def merge(store: Store, other: Store) -> None:
    files, tiles = catalog.merge(store.files, store.tiles, other.files, other.tiles)
    store.save(files, tiles.withColumn("rowid", F.monotonically_increasing_id() + 1))


def split(store: Store, pattern: str, target: Store) -> None:
    files = catalog.find(store.files, pattern)
    target.save(files, store.tiles.join(files.select("fileid"), "fileid", "left_semi"))


def export(store: Store, size: int = 512) -> DataFrame:
    """(url, data): each file put together as PNG from the tiles of the least level that is at most size wide or high."""
    level = " + ".join(f"cast(width div {1 << k} > {size} and height div {1 << k} > {size} as int)" for k in range(24))
    files = store.files.withColumn("level", F.expr(level))
    kept = files.select("fileid", "url", F.col("level").alias("scale"))
    tiles = kept.join(store.tiles, ["fileid", "scale"]).select("url", "x", "y", F.col("data").alias("content"))
    part = F.split("path", "\n")
    decoded = images.decoded(tiles.select(F.concat_ws("\n", "url", "x", "y").alias("path"), "content")).select(part[0].alias("url"), part[1].cast("int").alias("x"), part[2].cast("int").alias("y"), "width", "height", "channels", "data")
    return decoded.groupBy("url").applyInPandas(_assembled, "url string, data binary")


def _assembled(key: tuple, tiles: pd.DataFrame) -> pd.DataFrame:
    """One image put together; its level is at most two tiles large in one direction, so a group is small."""
    width = int((256 * tiles["x"] + tiles["width"]).max())
    height = int((256 * tiles["y"] + tiles["height"]).max())
    whole = np.full((height, width, 4), 255, np.uint8)
    for t in tiles.itertuples():
        surface = np.frombuffer(t.data, np.uint8).reshape(t.height, t.width, t.channels)
        whole[256 * t.y : 256 * t.y + t.height, 256 * t.x : 256 * t.x + t.width, : t.channels] = surface
    return pd.DataFrame({"url": [key[0]], "data": [images.encode_png(whole if (whole[..., 3] < 255).any() else whole[..., :3])]})
