"""The catalog of image files and the tile store: lookups, writes, deletes, merges, splits and clean-up.

Functions take and return DataFrames; a write gives the table's new content, so that a caller saves it as one snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.image_exprs import THUMBNAIL, glob, natural_key
from tessera.operators.ordering import numbered
from tessera.plans.dialect import Family, fixture, run

FAMILY = Family()
TILE_KEY = ["fileid", "scale", "x", "y"]


def find(files: DataFrame, pattern: str) -> DataFrame:
    """Files whose url matches a GLOB; several patterns append (duplicates stay), as with repeated options."""
    return files.where(glob(F.col("url"), pattern))


def find_all(files: DataFrame, patterns: list[str]) -> DataFrame:
    found = find(files, patterns[0])
    for pattern in patterns[1:]:
        found = found.unionAll(find(files, pattern))
    return found


def upsert(files: DataFrame, incoming: DataFrame) -> DataFrame:
    """The catalog after incoming rows replace those with their url. A replaced row gets a new id, as a row store with
    growing keys gives it; its tiles become orphans (see ``orphans``). Later rows of one url win by mtime."""
    last = Window.partitionBy("url").orderBy(F.col("mtime").desc(), F.col("size").desc())
    new = incoming.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    kept = files.join(new.select("url"), "url", "left_anti").select("fileid", "url", "size", "mtime", "width", "height", "format")
    top = files.agg(F.max("fileid").alias("top")).first()["top"] or 0
    # ids in order of url: only the incoming urls are numbered
    return kept.unionByName(numbered(new, "url", "_r").select((F.col("_r") + top).cast("long").alias("fileid"), "url", "size", "mtime", "width", "height", "format"))


def without(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("fileid"), "fileid", "left_anti").select(*table.columns)


def delete_cascade(files: DataFrame, tiles: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return without(files, ids), without(tiles, ids)


def orphans(tiles: DataFrame, files: DataFrame) -> DataFrame:
    return without(tiles, files)


def deduplicate(tiles: DataFrame) -> DataFrame:
    """Of tiles with one key, the first stored."""
    rest = [c for c in tiles.columns if c not in TILE_KEY]
    first = tiles.groupBy(*TILE_KEY).agg(F.min_by(F.struct(*rest), "rowid").alias("t"))
    return first.select(*TILE_KEY, "t.*").select(*tiles.columns)


def lookup_tiles(requests: DataFrame, tiles: DataFrame) -> DataFrame:
    """requests with the first stored tile of their key, or nulls."""
    first = tiles.groupBy(*TILE_KEY).agg(F.min_by(F.struct("rowid", "nbytes"), "rowid").alias("t"))
    return requests.join(first, TILE_KEY, "left").select(*requests.columns, F.col("t.rowid").alias("rowid"), F.col("t.nbytes").alias("nbytes"))


def by_id(files: DataFrame, fileid: int) -> DataFrame:
    return files.where(F.col("fileid") == fileid)


def known_tiles(requests: DataFrame, tiles: DataFrame) -> DataFrame:
    """The requests whose tile is stored."""
    return requests.join(tiles.select(*TILE_KEY), TILE_KEY, "left_semi")


def unknown_tiles(requests: DataFrame, tiles: DataFrame) -> DataFrame:
    """The requests whose tile has to be made."""
    return requests.join(tiles.select(*TILE_KEY), TILE_KEY, "left_anti")


def owned(tiles: DataFrame, files: DataFrame) -> DataFrame:
    """The tiles of these files."""
    return tiles.join(files.select("fileid"), "fileid", "left_semi").select(*tiles.columns)


def with_thumbnails(files: DataFrame, tiles: DataFrame) -> DataFrame:
    """files(fileid, thumbnail_scale) with the tiles that show all of them, or null."""
    whole = tiles.where("x = 0 and y = 0").select("fileid", F.col("scale").alias("thumbnail_scale"), "rowid")
    return files.join(whole, ["fileid", "thumbnail_scale"], "left")


def purged(tiles: DataFrame, files: DataFrame) -> DataFrame:
    """The tiles without those of JPEG files at their full size, which can be read from the files."""
    jpeg = files.where(F.lower("url").rlike("[.]jpe?g$")).select("fileid", F.lit(0).alias("scale"))
    return tiles.join(jpeg, ["fileid", "scale"], "left_anti").select(*tiles.columns)


def merged_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ranges (fileid, min_scale, max_scale) of two parts of a store, as of a cache and what is written, as one."""
    return a.unionByName(b).groupBy("fileid").agg(F.min("min_scale").alias("min_scale"), F.max("max_scale").alias("max_scale"))


def scale_ranges(files: DataFrame, tiles: DataFrame) -> DataFrame:
    spans = tiles.groupBy("fileid").agg(F.min("scale").alias("min_scale"), F.max("scale").alias("max_scale"))
    return files.join(spans, "fileid", "left")


def merge(files: DataFrame, tiles: DataFrame, other_files: DataFrame, other_tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All files and tiles of two databases; the other's are keyed anew by url, so that shared files are one."""
    merged = upsert(files, other_files.join(files.select("url"), "url", "left_anti").select("url", "size", "mtime", "width", "height", "format"))
    ids = other_files.select(F.col("fileid").alias("old"), "url").join(merged.select("fileid", "url"), "url").select("old", F.col("fileid").alias("new"))
    moved = other_tiles.join(ids, other_tiles["fileid"] == ids["old"]).select(F.col("new").alias("fileid"), *[c for c in other_tiles.columns if c not in ("fileid", "rowid")])
    return merged, tiles.drop("rowid").unionByName(moved)


def compact(table: DataFrame, path: str, partitions: int) -> DataFrame:
    """A rewritten copy of a table in few files (what a row store calls vacuum)."""
    table.repartition(partitions).write.mode("overwrite").parquet(path)
    return table.sparkSession.read.parquet(path)


same, own = FAMILY.same, FAMILY.own
same("scan_files", "select * from img_files")


@own("files_by_glob", "select * from img_files where url glob 'file:///*promo*/Brand-?/*.jpg'")
def files_by_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(fixture(spark, sf_dir, "img_files"), "file:///*promo*/Brand-?/*.jpg")


@own("files_by_glob_class", "select * from img_files where url glob '*_[0-4][!0-5].*'")
def files_by_glob_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(fixture(spark, sf_dir, "img_files"), "*_[0-4][^0-5].*")


@own("file_by_url", "select f.* from img_files f join (select max(url) as url from img_files where fileid <= 100) u on f.url = u.url")
def file_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fixture(spark, sf_dir, "img_files")
    wanted = files.where("fileid <= 100").agg(F.max("url").alias("url"))
    return files.join(F.broadcast(wanted), "url", "left_semi")  # one row


@own("file_by_id", "select * from img_files where fileid = 42")
def file_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_id(fixture(spark, sf_dir, "img_files"), 42)


@own("param_query", "select fileid, url, width from img_files where width > 3000 and format = 0")
def param_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixture(spark, sf_dir, "img_files").createOrReplaceTempView("img_files_view")
    return spark.sql("select fileid, url, width from img_files_view where width > :least and format = :kind", args={"least": 3000, "kind": 0})


_INCOMING = "select url, cast(size + 1 as bigint) as size, cast(mtime + 60 as bigint) as mtime, width, height, format from img_files where fileid % 7 = 0 union all select concat(url, '.new') as url, size, mtime, width, height, format from img_files where fileid % 50 = 0"


@own(
    "upsert_files",
    f"with inc as ({_INCOMING}) select f.* from img_files f where f.url not in (select url from inc) union all select cast((select max(fileid) from img_files) + row_number() over (order by url) as bigint) as fileid, url, size, mtime, width, height, format from inc",
)
def upsert_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert(fixture(spark, sf_dir, "img_files"), run(spark, sf_dir, _INCOMING))


@own("delete_files", "select * from img_files where not (fileid % 10 = 3)")
def delete_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fixture(spark, sf_dir, "img_files")
    return without(files, files.where("fileid % 10 = 3"))


@own("delete_tiles", "select * from img_tiles where not (fileid % 10 = 3)")
def delete_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = fixture(spark, sf_dir, "img_tiles")
    return without(tiles, tiles.where("fileid % 10 = 3").select("fileid").distinct())


@own("delete_cascade", "select 'file' as kind, fileid, cast(null as bigint) as rowid from img_files where fileid % 10 <> 3 union all select 'tile', fileid, rowid from img_tiles where fileid % 10 <> 3 or fileid not in (select fileid from img_files)")
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, tiles = fixture(spark, sf_dir, "img_files"), fixture(spark, sf_dir, "img_tiles")
    left, rest = delete_cascade(files, tiles, files.where("fileid % 10 = 3"))
    return left.select(F.lit("file").alias("kind"), "fileid", F.lit(None).cast("long").alias("rowid")).unionAll(rest.select(F.lit("tile"), "fileid", "rowid"))


@own("tiles_of_file", "select t.* from img_tiles t join img_files f on f.fileid = t.fileid where f.fileid between 10 and 30")
def tiles_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fixture(spark, sf_dir, "img_files").where("fileid between 10 and 30")
    return fixture(spark, sf_dir, "img_tiles").join(files.select("fileid"), "fileid", "left_semi").select("rowid", "fileid", "scale", "x", "y", "nbytes", "quality", "format")


same("tiles_ordered", "select rowid, fileid, scale, x, y from img_tiles order by fileid, rowid")
same("tile_key_order", "select scale, x, y, fileid, rowid from img_tiles order by scale, x, y, rowid")
_REQUESTED = "select distinct fileid, scale, x, y from img_requests where kind = 'request'"


@own("tile_lookup", f"select q.*, t.rowid, t.nbytes from ({_REQUESTED}) q left join (select fileid, scale, x, y, min(rowid) as rowid, min_by(nbytes, rowid) as nbytes from img_tiles group by all) t on q.fileid = t.fileid and q.scale = t.scale and q.x = t.x and q.y = t.y")
def tile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_tiles(run(spark, sf_dir, _REQUESTED), fixture(spark, sf_dir, "img_tiles"))


_ON = "q.fileid = t.fileid and q.scale = t.scale and q.x = t.x and q.y = t.y"


@own("tile_exists", f"select q.* from ({_REQUESTED}) q where exists (select 1 from img_tiles t where {_ON})")
def tile_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known_tiles(run(spark, sf_dir, _REQUESTED), fixture(spark, sf_dir, "img_tiles"))


@own("missing_tiles", f"select q.* from ({_REQUESTED}) q where not exists (select 1 from img_tiles t where {_ON})")
def missing_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unknown_tiles(run(spark, sf_dir, _REQUESTED), fixture(spark, sf_dir, "img_tiles"))


@own("tile_scale_range", "select f.fileid, f.url, r.min_scale, r.max_scale from img_files f left join (select fileid, min(scale) as min_scale, max(scale) as max_scale from img_tiles group by fileid) r on f.fileid = r.fileid")
def tile_scale_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scale_ranges(fixture(spark, sf_dir, "img_files"), fixture(spark, sf_dir, "img_tiles")).select("fileid", "url", "min_scale", "max_scale")


@own("tile_scale_range_merged", "with parts as (select fileid, min(scale) as lo, max(scale) as hi from img_tiles where rowid % 2 = 0 group by fileid union all select fileid, min(scale), max(scale) from img_tiles where rowid % 2 = 1 group by fileid) select fileid, min(lo) as min_scale, max(hi) as max_scale from parts group by fileid")
def tile_scale_range_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = fixture(spark, sf_dir, "img_tiles")
    parts = [tiles.where(f"rowid % 2 = {k}").groupBy("fileid").agg(F.min("scale").alias("min_scale"), F.max("scale").alias("max_scale")) for k in (0, 1)]
    return merged_ranges(parts[0], parts[1])


@own("append_tiles", "select fileid, scale, x, y, nbytes, quality, format from img_tiles union all select cast(fileid as bigint), scale, x, y, cast(0 as bigint), cast(0 as int), cast(0 as int) from img_requests where kind = 'arrive'")
def append_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles, arrived = fixture(spark, sf_dir, "img_tiles").drop("rowid"), fixture(spark, sf_dir, "img_requests").where("kind = 'arrive'")
    zero = F.lit(0)
    return tiles.unionByName(arrived.select(*TILE_KEY, zero.cast("long").alias("nbytes"), zero.alias("quality"), zero.alias("format")))


@own("store_counts", "select (select count(*) from img_files) as files, (select count(*) from img_tiles) as tiles, (select count(distinct fileid) from img_tiles) as files_with_tiles")
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, tiles = fixture(spark, sf_dir, "img_files"), fixture(spark, sf_dir, "img_tiles")
    return files.agg(F.count("*").alias("files")).crossJoin(tiles.agg(F.count("*").alias("tiles"), F.countDistinct("fileid").alias("files_with_tiles")))  # a row each


@own("files_join_tiles", "select f.fileid, f.url, t.rowid, t.scale, t.x, t.y from img_files f join img_tiles t on f.fileid = t.fileid")
def files_join_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, tiles = fixture(spark, sf_dir, "img_files"), fixture(spark, sf_dir, "img_tiles")
    return files.select("fileid", "url").join(tiles.select("fileid", "rowid", "scale", "x", "y"), "fileid")


@own("thumbnail_join", f"with f as (select fileid, url, cast({THUMBNAIL} as int) as thumbnail_scale from img_files) select f.fileid, f.thumbnail_scale, t.rowid from f left join img_tiles t on t.fileid = f.fileid and t.scale = f.thumbnail_scale and t.x = 0 and t.y = 0")
def thumbnail_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = run(spark, sf_dir, f"select fileid, cast({THUMBNAIL} as int) as thumbnail_scale from img_files")
    return with_thumbnails(files, fixture(spark, sf_dir, "img_tiles"))


_WANTED = "select concat(url, case when fileid % 5 = 0 then '.gone' else '' end) as url from img_files union all select url from img_urls"


@own("resolve_urls", f"select w.url, f.fileid from ({_WANTED}) w left join img_files f on f.url = w.url")
def resolve_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, _WANTED).join(fixture(spark, sf_dir, "img_files").select("url", "fileid"), "url", "left")


@own("missing_files", f"select w.url from ({_WANTED}) w where not exists (select 1 from img_files f where f.url = w.url)")
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, _WANTED).join(fixture(spark, sf_dir, "img_files").select("url"), "url", "left_anti")


_SPLIT = "url like '%promo%'"


@own("split_files", f"select * from img_files where {_SPLIT}")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(fixture(spark, sf_dir, "img_files"), "*promo*")


@own("split_tiles", f"select * from img_tiles where fileid in (select fileid from img_files where {_SPLIT})")
def split_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = find(fixture(spark, sf_dir, "img_files"), "*promo*")
    return owned(fixture(spark, sf_dir, "img_tiles"), files)


@own("orphan_tiles", "select * from img_tiles t where not exists (select 1 from img_files f where f.fileid = t.fileid)")
def orphan_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(fixture(spark, sf_dir, "img_tiles"), fixture(spark, sf_dir, "img_files"))


@own("purge_highres_jpeg", "select t.* from img_tiles t where not (t.scale = 0 and exists (select 1 from img_files f where f.fileid = t.fileid and rx(lower(f.url), '[.]jpe?g$')))")
def purge_highres_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purged(fixture(spark, sf_dir, "img_tiles"), fixture(spark, sf_dir, "img_files"))


@own("dedupe_tiles", "select * exclude (n) from (select *, row_number() over (partition by fileid, scale, x, y order by rowid) as n from img_tiles) where n = 1")
def dedupe_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(fixture(spark, sf_dir, "img_tiles"))


@own("multi_pattern_union", "select fileid, url from img_files where url glob '*promo*' union all select fileid, url from img_files where url glob '*.jpg'")
def multi_pattern_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_all(fixture(spark, sf_dir, "img_files"), ["*promo*", "*.jpg"]).select("fileid", "url")


_MERGED = """with a as (select * from img_files where fileid % 3 <> 0), b as (select * from img_files where fileid % 3 <> 1),
m as (select fileid, url from a union all select cast((select max(fileid) from a) + row_number() over (order by url) as bigint), url from b where url not in (select url from a))"""


@own("merge_databases", f"{_MERGED} select m.fileid, m.url, t.rowid as old_rowid, t.scale, t.x, t.y from m join b on b.url = m.url join img_tiles t on t.fileid = b.fileid union all select a.fileid, a.url, t.rowid, t.scale, t.x, t.y from a join img_tiles t on t.fileid = a.fileid")
def merge_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, tiles = fixture(spark, sf_dir, "img_files"), fixture(spark, sf_dir, "img_tiles").withColumn("old_rowid", F.col("rowid"))
    a, b = files.where("fileid % 3 <> 0"), files.where("fileid % 3 <> 1")
    merged, moved = merge(a, tiles.join(a.select("fileid"), "fileid", "left_semi"), b, tiles.join(b.select("fileid"), "fileid", "left_semi"))
    return moved.join(merged.select("fileid", "url"), "fileid").select("fileid", "url", "old_rowid", "scale", "x", "y")


same("migrate_schema", "select fileid, url as filename, size as filesize, mtime, width, height from img_files")
same("list_files", "select url from img_files")
#: What a scan of the disk finds: not every fifth file of the catalog, and some that it does not have.
_FOUND = "select concat(url, case when fileid % 5 = 0 then '.moved' else '' end) as url from img_files"


def check(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Each file of the catalog with whether listing(url) still has it."""
    there = listing.select("url").distinct().withColumn("_there", F.lit(True))
    return files.join(there, "url", "left").select("url", F.when(F.col("_there"), "ok").otherwise("missing").alias("status"))


@own("check_files", f"select url, case when url in ({_FOUND}) then 'ok' else 'missing' end as status from img_files")
def check_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check(fixture(spark, sf_dir, "img_files"), run(spark, sf_dir, _FOUND))


@own("natural_sort", "with k as (select url, list_transform(regexp_extract_all(url, '([0-9]+|[^0-9]+)'), lambda p : case when regexp_matches(p, '^[0-9]') then '0' || lpad(cast(len(p) as varchar), 6, '0') || p else p end) as parts from img_files) select url, cast(row_number() over (order by array_to_string(parts, '')) as int) as place from k")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = fixture(spark, sf_dir, "img_files").select("url", natural_key(F.col("url")).alias("k"))
    return numbered(keyed, "k", "place").select("url", F.col("place").cast("int").alias("place"))


@own("natural_sort_desc", "with k as (select url, list_transform(regexp_extract_all(url, '([0-9]+|[^0-9]+)'), lambda p : case when regexp_matches(p, '^[0-9]') then '0' || lpad(cast(len(p) as varchar), 6, '0') || p else p end) as parts from img_urls) select distinct url, cast(dense_rank() over (order by array_to_string(parts, '') desc) as int) as place from k")
def natural_sort_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = fixture(spark, sf_dir, "img_urls").select("url", natural_key(F.col("url")).alias("k")).distinct()
    placed = numbered(keyed, "k", "place")  # keys of different urls differ
    return placed.select("url", (F.lit(keyed.count() + 1) - F.col("place")).cast("int").alias("place"))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rows with their place in a random order that reruns repeat: that of the digests of a unique key and a seed."""
    drawn = rows.withColumn("_draw", F.concat(F.md5(F.concat(F.col(key), F.lit(f"#{seed}"))), F.col(key)))
    return numbered(drawn, "_draw", "place").drop("_draw")


@own("shuffle", "select fileid, url, row_number() over (order by md5(url || '#7'), url) as place from img_files")
def shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffled(fixture(spark, sf_dir, "img_files").select("fileid", "url"), "url", 7)


