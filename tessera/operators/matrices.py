"""Matrices: products in the long form (m, i, j, v), and determinants, inverses and transposes of rows that hold a small square
matrix as an array in row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.dialect import Family, run

FAMILY = Family()
own = FAMILY.own

Cells = list[list[str]]


def cells(column: str, n: int) -> Cells:
    """SQL for each element of an n by n matrix that an array column holds."""
    return [[f"{column}[{n * i + j}]" for j in range(n)] for i in range(n)]


def _without(m: Cells, i: int, j: int) -> Cells:
    return [row[:j] + row[j + 1 :] for k, row in enumerate(m) if k != i]


def determinant(m: Cells) -> str:
    """SQL: by expansion along the first row."""
    if len(m) == 1:
        return m[0][0]
    terms = [f"{'-' if j % 2 else '+'} {m[0][j]} * ({determinant(_without(m, 0, j))})" for j in range(len(m))]
    return f"({' '.join(terms)})"


def inverse(m: Cells, det: str) -> str:
    """SQL: an array of the inverse's elements, from cofactors; null where the determinant is 0."""
    n = len(m)
    parts = [f"{'-' if (i + j) % 2 else ''}({determinant(_without(m, j, i))}) / {det}" for i in range(n) for j in range(n)]
    return f"case when {det} <> 0 then array({', '.join(parts)}) end"


def transpose(m: Cells) -> str:
    n = len(m)
    return f"array({', '.join(m[j][i] for i in range(n) for j in range(n))})"


def with_inverses(rows: DataFrame, column: str, n: int) -> DataFrame:
    """rows with det, inverse and transposed of an array column of n by n elements."""
    m = cells(column, n)
    told = rows.withColumn("det", F.expr(determinant(m)))
    return told.withColumns({"inverse": F.expr(inverse(m, "det")), "transposed": F.expr(transpose(m))})


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """(m, i, j, v) of the products of left(m, i, j, v) and right(m, i, j, v)."""
    terms = left.withColumnRenamed("j", "k").withColumnRenamed("v", "u").join(right.withColumnRenamed("i", "k"), ["m", "k"])
    return terms.groupBy("m", "i", "j").agg(F.sum(F.col("u") * F.col("v")).cast("long").alias("v"))


@own("matmul_long", "with e as (select img // 2 as m, img % 2 as side, x as i, y as j, g from img_pixels), r as (select m, side, i, list(g order by j) as vs from e group by all), c as (select m, side, j, list(g order by i) as vs from e group by all) select r.m, r.i, c.j, cast(list_dot_product(cast(r.vs as double[]), cast(c.vs as double[])) as bigint) as v from r join c on r.m = c.m and r.side = 0 and c.side = 1")
def matmul_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product of each two neighbouring surfaces as matrices of eight by eight."""
    both = run(spark, sf_dir, "select img ~/ 2 as m, img % 2 as side, x as i, y as j, cast(g as bigint) as v from img_pixels")
    return product(both.where("side = 0").drop("side"), both.where("side = 1").drop("side"))


def _small(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The first elements of each embedding as a matrix, on a grid of steps that keeps sums exact."""
    return run(spark, sf_dir, "select vec_id, embedding from embeddings").select("vec_id", F.expr(f"transform(slice(embedding, 1, {n * n}), (v, i) -> round(cast(v as double), 3) + case when i % {n + 1} = 0 then 1D else 0D end)").alias("m"))


def _spread(rows: DataFrame) -> DataFrame:
    long = rows.select("vec_id", F.round("det", 6).alias("det"), F.posexplode(F.arrays_zip("inverse", "transposed")).alias("place", "e"))
    return long.select("vec_id", "det", "place", F.round("e.inverse", 5).alias("inverse"), F.col("e.transposed").alias("transposed"))


@own(
    "matrix3_inverse",
    """with e as (select vec_id, list_transform(embedding[1:9], lambda v, i : round(cast(v as double), 3) + case when (i - 1) % 4 = 0 then 1 else 0 end) as m from embeddings),
c as (select vec_id, m, [m[5] * m[9] - m[6] * m[8], m[3] * m[8] - m[2] * m[9], m[2] * m[6] - m[3] * m[5], m[6] * m[7] - m[4] * m[9], m[1] * m[9] - m[3] * m[7], m[3] * m[4] - m[1] * m[6], m[4] * m[8] - m[5] * m[7], m[2] * m[7] - m[1] * m[8], m[1] * m[5] - m[2] * m[4]] as a from e),
d as (select *, m[1] * a[1] + m[2] * a[4] + m[3] * a[7] as det from c)
select vec_id, round(det, 6) as det, cast(place as int) as place, round(case when det <> 0 then a[place + 1] / det end, 5) as inverse, m[place % 3 * 3 + place // 3 + 1] as transposed from (select *, unnest(range(0, 9)) as place from d)""",
)
def matrix3_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(with_inverses(_small(spark, sf_dir, 3), "m", 3))


#: By pairs of two-row minors: s of the upper rows, c of the lower ones.
@own(
    "matrix4_inverse",
    """with e as (select vec_id, list_transform(embedding[1:16], lambda v, i : round(cast(v as double), 3) + case when (i - 1) % 5 = 0 then 1 else 0 end) as m from embeddings),
s as (select vec_id, m, m[1] * m[6] - m[5] * m[2] as s0, m[1] * m[7] - m[5] * m[3] as s1, m[1] * m[8] - m[5] * m[4] as s2, m[2] * m[7] - m[6] * m[3] as s3, m[2] * m[8] - m[6] * m[4] as s4, m[3] * m[8] - m[7] * m[4] as s5,
 m[11] * m[16] - m[15] * m[12] as c5, m[10] * m[16] - m[14] * m[12] as c4, m[10] * m[15] - m[14] * m[11] as c3, m[9] * m[16] - m[13] * m[12] as c2, m[9] * m[15] - m[13] * m[11] as c1, m[9] * m[14] - m[13] * m[10] as c0 from e),
d as (select *, s0 * c5 - s1 * c4 + s2 * c3 + s3 * c2 - s4 * c1 + s5 * c0 as det,
 [m[6] * c5 - m[7] * c4 + m[8] * c3, -m[2] * c5 + m[3] * c4 - m[4] * c3, m[14] * s5 - m[15] * s4 + m[16] * s3, -m[10] * s5 + m[11] * s4 - m[12] * s3,
  -m[5] * c5 + m[7] * c2 - m[8] * c1, m[1] * c5 - m[3] * c2 + m[4] * c1, -m[13] * s5 + m[15] * s2 - m[16] * s1, m[9] * s5 - m[11] * s2 + m[12] * s1,
  m[5] * c4 - m[6] * c2 + m[8] * c0, -m[1] * c4 + m[2] * c2 - m[4] * c0, m[13] * s4 - m[14] * s2 + m[16] * s0, -m[9] * s4 + m[10] * s2 - m[12] * s0,
  -m[5] * c3 + m[6] * c1 - m[7] * c0, m[1] * c3 - m[2] * c1 + m[3] * c0, -m[13] * s3 + m[14] * s1 - m[15] * s0, m[9] * s3 - m[10] * s1 + m[11] * s0] as a from s)
select vec_id, round(det, 6) as det, cast(place as int) as place, round(case when det <> 0 then a[place + 1] / det end, 5) as inverse, m[place % 4 * 4 + place // 4 + 1] as transposed from (select *, unnest(range(0, 16)) as place from d)""",
)
def matrix4_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread(with_inverses(_small(spark, sf_dir, 4), "m", 4))
