"""Row numbers and running sums over a whole table without a task that sees all of it.

A bounded sample of the sort key gives bounds, rows fall into ranges between them, and the sums of the ranges (one row each, so
few that the driver holds them) are added to running sums inside each range.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES, SAMPLE = 64, 16


def running(rows: DataFrame, key: str, sums: dict[str, Column], ranges: int = RANGES) -> DataFrame:
    """rows with, for each name, the sum of a whole-number column over all rows up to and with this one, in ascending order of a
    unique key."""
    drawn = sorted(r[0] for r in rows.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(ranges * SAMPLE).collect())
    bounds = sorted(set(drawn[SAMPLE // 2 :: SAMPLE]))
    kind = rows.schema[key].dataType
    upto = F.array(*[F.lit(b).cast(kind) for b in bounds]) if bounds else F.array().cast(f"array<{kind.simpleString()}>")
    ranged = rows.withColumn("_range", F.size(F.filter(upto, lambda b: b <= F.col(key))))
    totals = {r["_range"]: r for r in ranged.groupBy("_range").agg(*(F.sum(c).cast("long").alias(n) for n, c in sums.items())).collect()}
    inside = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged
    for name, column in sums.items():
        own = [int(totals[k][name] or 0) if k in totals else 0 for k in range(len(bounds) + 1)]
        before = F.array(*[F.lit(x).cast("long") for x in accumulate([0, *own[:-1]])])
        out = out.withColumn(name, F.element_at(before, F.col("_range") + 1) + F.sum(column).over(inside).cast("long"))
    return out.drop("_range")


def numbered(rows: DataFrame, key: str, name: str, ranges: int = RANGES) -> DataFrame:
    """rows with their number, from 1, in ascending order of a unique key."""
    return running(rows, key, {name: F.lit(1)}, ranges)
