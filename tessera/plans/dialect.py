"""One definition of a query for Spark SQL and for DuckDB.

A definition is SQL with a few marks: ``~/`` whole division, ``1.5d`` a double, ``pow2(n)``, ``rx(text, 'pattern')`` a search, and
``[[a : b]]`` in a select list for one row for each whole number from a to b. Relations ``img_*`` are the fixtures of FIXTURES.md
and come in as common table expressions when a definition names them; a tile's rowid is put together from the columns that tell its
rows apart, which orders them as a number would. Where that number does not fit a bigint in some row (DuckDB's SQL fails there),
Spark's rowid is the same number as decimal(38, 0), for all rows of the table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "pages")

FIXTURES = {
    "img_files": """select cast(p_partkey + 1 as bigint) as fileid,
 concat('file:///', lower(p_type), '/', replace(p_brand, '#', '-'), '/', replace(p_name, ' ', '_'), '_', cast(p_partkey as string),
  case p_partkey % 8 when 0 then '.jpg' when 1 then '.JPEG' when 2 then '.png' when 3 then '.xcf.gz' when 4 then '.svg' when 5 then '.cbz' when 6 then '.txt' else '.jpg' end) as url,
 cast(p_size * 1024 + p_partkey % 1024 as bigint) as size, cast(1199145600 + p_partkey * 3600 as bigint) as mtime,
 cast(16 + (p_partkey * 37) % 4000 as int) as width, cast(16 + (p_partkey * 53) % 3000 as int) as height,
 cast(case p_partkey % 8 when 0 then 0 when 1 then 0 when 7 then 0 when 2 then 1 else -1 end as int) as format
from part where p_partkey % 10 <> 9""",
    "img_tiles": """select cast((((l_orderkey * 8 + l_linenumber) * 262144 + l_partkey) * 16384 + l_suppkey) * 64 + cast(l_quantity as bigint) as bigint) as rowid,
 cast(l_partkey + 1 as bigint) as fileid, cast(l_linenumber - 1 as int) as scale, cast(cast(l_quantity as int) % 4 as int) as x, cast(l_suppkey % 4 as int) as y,
 cast(floor(l_extendedprice) as bigint) as nbytes, cast(0 as int) as quality, cast(case when l_returnflag = 'R' then 1 else 0 end as int) as format
from lineitem""",
    "img_rects": """select cast(p_partkey + 1 as bigint) as fileid, cast(p_partkey as int) as ord,
 cast((p_partkey * 97) % 20000 as double) - (16 + (p_partkey * 37) % 4000) * 0.125d as l, cast((p_partkey * 61) % 15000 as double) - (16 + (p_partkey * 53) % 3000) * 0.125d as t,
 cast((p_partkey * 97) % 20000 as double) + (16 + (p_partkey * 37) % 4000) * 0.125d as r, cast((p_partkey * 61) % 15000 as double) + (16 + (p_partkey * 53) % 3000) * 0.125d as b
from part""",
    "img_requests": """select event_id as req_id, cast(user_id + 1 as bigint) as fileid, cast(event_id % 7 as int) as scale, cast(event_id % 3 as int) as x, cast(user_id % 3 as int) as y,
 case event_type when 'view' then 'request' when 'click' then 'request' when 'signup' then 'request' when 'purchase' then 'arrive' else 'abort' end as kind
from events""",
    "img_urls": "select page_id, url from pages",
}
#: One 8x8 gray surface for each embedding; the engines number array elements in their own ways.
PIXELS = {
    "spark": "select vec_id as img, cast(i % 8 as int) as x, cast(i div 8 as int) as y, cast(least(255D, greatest(0D, floor((cast(v as double) + 1D) * 127.5D))) as int) as g from embeddings lateral view posexplode(embedding) e as i, v",
    "duck": "select vec_id as img, cast(i % 8 as int) as x, cast(i // 8 as int) as y, cast(least(255.0, greatest(0.0, floor((cast(v as double) + 1.0) * cast(127.5 as double)))) as int) as g from (select vec_id, unnest(range(0, len(embedding))) as i, unnest(embedding) as v from embeddings)",
}
#: Colour images: three surfaces are the planes of one.
COLOURS = "select r.img ~/ 3 as img, r.x, r.y, r.g as r, g.g as g, b.g as b from img_pixels r join img_pixels g on g.img = r.img + 1 and g.x = r.x and g.y = r.y join img_pixels b on b.img = r.img + 2 and b.x = r.x and b.y = r.y where r.img % 3 = 0"


_ROWID = "cast((((l_orderkey * 8 + l_linenumber) * 262144 + l_partkey) * 16384 + l_suppkey) * 64 + cast(l_quantity as bigint) as bigint)"
_WIDE_ROWID = "cast(cast(l_orderkey * 8 + l_linenumber as decimal(20, 0)) * 274877906944 + ((l_partkey * 16384 + l_suppkey) * 64 + cast(l_quantity as bigint)) as decimal(38, 0))"
#: Rows whose number is beyond a bigint.
_BEYOND = "try_add(try_multiply(try_add(try_multiply(try_add(try_multiply(try_add(try_multiply(l_orderkey, 8L), l_linenumber), 262144L), l_partkey), 16384L), l_suppkey), 64L), cast(l_quantity as bigint)) is null and l_orderkey is not null and l_linenumber is not null and l_partkey is not null and l_suppkey is not null and l_quantity is not null"


def wide_rowids(spark: SparkSession, sf_dir: str) -> bool:
    """Whether some tile's rowid needs more than a bigint."""
    return not spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(_BEYOND).isEmpty()


def render(sql: str, dialect: str) -> str:
    names, text = [], sql
    if re.search(r"\bimg_colours\b", text):
        names.append(("img_colours", COLOURS))
    if re.search(r"\bimg_pixels\b", text) or names:
        names.insert(0, ("img_pixels", PIXELS[dialect]))
    names += [(n, FIXTURES[n]) for n in FIXTURES if re.search(rf"\b{n}\b", text)]
    if names:
        head = ", ".join(f"{n} as ({body})" for n, body in names)
        recursive = re.match(r"\s*with\s+recursive\b", text)
        rest = re.sub(r"^\s*with\s+(recursive\s+)?", ", ", text) if re.match(r"\s*with\b", text) else f" {text}"
        text = f"with {'recursive ' if recursive else ''}{head}{rest}"
    spark = dialect == "spark"
    text = text.replace("~/", "div" if spark else "//")
    text = re.sub(r"(?<![\w.])(\d+(?:\.\d+)?)d\b", r"\1D" if spark else r"cast(\1 as double)", text)
    text = re.sub(r"\bpow2\(", "shiftleft(cast(1 as bigint), " if spark else "(cast(1 as bigint) << ", text)
    text = re.sub(r"\brx\(", "rlike(" if spark else "regexp_matches(", text)
    text = re.sub(r"\[\[(.*?) : (.*?)\]\]", r"explode(sequence(\1, \2))" if spark else r"unnest(range(\1, (\2) + 1))", text)
    return text


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    for table in TABLES:
        if re.search(rf"\b{table}\b", sql):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    text = render(sql, "spark")
    if _ROWID in text and re.search(r"\browid\b|\*", sql) and wide_rowids(spark, sf_dir):
        text = text.replace(_ROWID, _WIDE_ROWID)
    views(spark, sf_dir, text)
    return spark.sql(text)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run(spark, sf_dir, f"select * from {name}")


class Family:
    """The queries of a module: shared definitions, and functions with SQL of their own."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def same(self, name: str, sql: str) -> None:
        self.queries[name] = lambda spark, sf_dir, s=sql: run(spark, sf_dir, s)
        self.sql[name] = render(sql, "duck")

    def own(self, name: str, sql: str | None) -> Callable:
        """A decorator: the function is the query, sql its definition for DuckDB (with marks)."""

        def take(function: Callable) -> Callable:
            self.queries[name] = function
            if sql is not None:
                self.sql[name] = render(sql, "duck")
            return function

        return take
