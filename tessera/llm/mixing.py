"""Mixing sources to target weights by Pareto order sampling.

A document's size is its number of words (``[^\\x20\\x09-\\x0D]+``). Sources in code point order, null last, have the weights of a
cycle and share the total size by weight; a target stops at ``most`` times its source's size, and the excess is shared by
weight among the others until none is above.

Within a source, a document expects min(most, c * w) copies, where w grows slowly with its size (w = 1 + bits of the size / 64),
so probabilities are unequal; c is solved so that expected words are the target. The whole part of the expectation is
certain. The rest, p, is sampled in Pareto order: documents are ranked by (u / (1 - u)) / (p / (1 - p)), with u a hash of
doc_id and text, and taken in this order until the words that are still missing are reached as nearly as whole documents allow.

The cut in the order is found without sorting a source: sums of sizes in 4096 ranges of the rank, then in 4096 ranges of
the one that holds the cut, then row by row in what is left, about a 16-millionth of the source. So a hot source is summed
like any other. What comes to the driver is one row for each source and bit length of sizes, of at most ``max_sources`` sources. With
more, targets are found from sums over a table of the sources, expectations source by source in its groups, and all tables meet
by joins.

Null and empty texts have size 0 and may be taken or not, which takes no words. Rows without a doc_id, or that share one, are
drawn one by one: their texts tell them apart, and rows equal in both, their place in the input. Sources of size 0 have target
0. An empty table gives an empty mix. Other columns pass through whatever their names. The same input gives the same mix.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ordering import numbered

from .common import documents, drop_scratch, materialize

WEIGHTS, MOST, SEED, TIES = (5, 2, 1), 3, 20240, 4096
WORD = r"[^\\x20\\x09-\\x0D]+"


def targets(sizes: list[int], weights: list[float], total: float, most: int = MOST) -> list[float]:
    """Each source's share of total by weight, at most ``most`` times its size."""
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free:
        weight = sum(weights[i] for i in sorted(free))
        over = [i for i in sorted(free) if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
            free.discard(i)
    return out


def preference(bits: int) -> float:
    return 1 + bits / 64


def expectations(words: dict[int, int], target: float, most: int = MOST) -> dict[int, float]:
    """Expected copies of a document by the bit length of its size; words: the words in each of these classes."""
    classes = sorted(words, key=lambda b: (-preference(b), b))
    held, left = {}, target
    for k, b in enumerate(classes):
        rest = sum(words[x] * preference(x) for x in classes[k:])
        c = left / rest if rest else 0.0
        if c * preference(b) < most:
            return held | {x: c * preference(x) for x in classes[k:]}
        held[b] = float(most)
        left -= most * words[b]
    return held


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs as a struct ``row``, with doc_id, source, _size, _bits (its bit length), _u, a hash of doc_id and text in (0, 1), and _tie, a
    number for the row's place."""
    size = F.coalesce(F.expr(f"regexp_count(text, '{WORD}')"), F.lit(0)).cast("long")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 11).cast("double") + 0.5) / float(1 << 53)
    tie = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(TIES))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", size.alias("_size"), u.alias("_u"), tie.alias("_tie"))
    return rows.withColumn("_bits", F.when(F.col("_size") == 0, 0).otherwise(F.length(F.bin("_size"))))


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with the plan of their source and class, and _rank: the Pareto order as an integer below 2**52, of which the last bits
    part rows that would be equal."""
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["_source"]) & (rows["_bits"] == plan["_class"]), "left").drop("_source", "_class")
    odds = "(_u / (1D - _u)) / (_part / (1D - _part))"
    return joined.withColumn("_rank", F.expr(f"case when _part > 0 then cast(floor({odds} / (1D + {odds}) * {(1 << 52) // TIES}D) as bigint) * {TIES} + _tie end"))


PLAN = "_source string, _class int, _certain int, _part double, _target double, _source_size long, _need double"


def planned(source: str | None, words: dict[int, int], target: float, most: int) -> list[tuple]:
    """The rows of a source's plan; _need is the words that are missing beside the certain copies."""
    expected = expectations(words, target, most)
    certain = {b: int(e + 1e-9) for b, e in expected.items()}
    need = target - sum(certain[b] * words[b] for b in expected)
    return [(source, b, certain[b], min(max(expected[b] - certain[b], 0.0), 1 - 1e-12), target, sum(words.values()), need) for b in sorted(expected)]


def plan_on_driver(spark: SparkSession, sums: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    classes: dict[str | None, dict[int, int]] = {}
    for r in sums.collect():
        classes.setdefault(r["source"], {})[r["_bits"]] = int(r["words"])
    names = sorted((x for x in classes if x is not None)) + [None] * (None in classes)
    sizes = [sum(classes[x].values()) for x in names]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], sum(sizes), most)
    return spark.createDataFrame([r for x, target in zip(names, goal) for r in planned(x, classes[x], target, most)], PLAN).coalesce(1)


def plan_by_tables(sums: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """The same with a table of the sources: a source's target is its weight times a level, or its cap if that is less, and the level
    rises from sum to sum until no further cap is met."""
    sources = sums.groupBy("source").agg(F.sum("words").alias("size"))
    listed = numbered(sources.where("source is not null"), "source", "n").unionByName(sources.where("source is null").withColumn("n", F.lit(sources.count()).cast("long")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("n") - 1, F.lit(len(weights))).cast("int") + 1)
    listed = materialize(listed.withColumn("weight", weight))
    level, last = 0.0, None
    while level != last:
        over = F.lit(level) * F.col("weight") > most * F.col("size")
        r = listed.agg(F.sum("size").alias("all"), F.sum(F.when(over, most * F.col("size"))).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
        level, last = max(level, (r["all"] - (r["capped"] or 0)) / r["free"]) if r["free"] else level, level
    goal = listed.withColumn("target", F.least(F.lit(level) * F.col("weight"), (most * F.col("size")).cast("double"))).select("source", "target")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        source = frame["source"].iloc[0]
        words = dict(zip(frame["_bits"].astype(int).tolist(), frame["words"].astype(int).tolist()))
        return pd.DataFrame(planned(None if pd.isna(source) else source, words, float(frame["target"].iloc[0]), most), columns=[c.split(" ")[0] for c in PLAN.split(", ")])

    both = sums.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    return materialize(both.select("source", "_bits", "words", "target").groupBy("source").applyInPandas(solve, PLAN))


def plan_mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, max_sources: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(plan, cut) of rows(source, _size, _bits, _u, _tie): the plan has one row for each source and class, the cut one for each
    source: its target, size and the rank up to which documents are taken once more."""
    spark = rows.sparkSession
    sums = materialize(rows.groupBy("source", "_bits").agg(F.sum("_size").alias("words")))
    few = sums.select("source").distinct().count() <= max_sources
    plan_df = plan_on_driver(spark, sums, weights, most) if few else plan_by_tables(sums, weights, most)
    near_by = F.broadcast if few else lambda df: df  # tables of a row for each source
    keep = (lambda df: spark.createDataFrame(df.collect(), df.schema).coalesce(1)) if few else materialize
    need = plan_df.groupBy("_source").agg(F.max("_need").alias("_need"))
    plan_df = plan_df.drop("_need")
    ranked = _ranked(rows, near_by(plan_df)).where("_rank is not null").select("source", "_size", "_rank")
    for shift in (40, 28, 0):
        ranged = ranked.groupBy("source", F.shiftright("_rank", shift).alias("_range")).agg(F.sum("_size").alias("_sum"))
        upto = ranged.join(near_by(need), ranged["source"].eqNullSafe(need["_source"])).selectExpr("source", "_range", "_sum", "_need", "sum(_sum) over (partition by source order by _range) as _upto")
        if shift:
            # the first range by whose end the missing words are there; if none, all are taken
            chosen = upto.groupBy("source").agg(F.expr("min(_range) filter (where _upto >= _need)").alias("_range"), F.expr("max(_need) - coalesce(max(_upto) filter (where _upto < _need), 0)").alias("_need"), F.expr("max(_range)").alias("_last"))
            near = keep(chosen.selectExpr("source as _source", "coalesce(_range, _last + 1) as _range", "cast(_need as double) as _need"))
            ranked = ranked.join(near_by(near), ranked["source"].eqNullSafe(near["_source"]) & (F.shiftright("_rank", shift) == near["_range"])).select("source", "_size", "_rank")
            need, base = near.select("_source", "_need"), near.selectExpr("_source as _s", f"_range * {1 << shift} - 1 as _base")
        else:
            # whole documents in order, the one at the cut if that comes nearer
            taken = upto.groupBy("source").agg(F.expr("max(_range) filter (where abs(_upto - _need) <= abs(_upto - _sum - _need))").alias("_cut"))
    cut = base.join(near_by(taken), base["_s"].eqNullSafe(taken["source"]), "left").select("_s", F.greatest(F.coalesce("_cut", "_base"), "_base").alias("_cut"))
    drop_scratch(sums)
    return near_by(plan_df), near_by(keep(cut))


def copies(rows: DataFrame, plan: DataFrame, cut: DataFrame) -> DataFrame:
    """rows with _copies, _target and _source_size."""
    ranked = _ranked(rows, plan)
    joined = ranked.join(cut, ranked["source"].eqNullSafe(cut["_s"]), "left").drop("_s")
    return joined.withColumn("_copies", F.expr("coalesce(_certain, 0) + case when _rank <= _cut then 1 else 0 end"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of docs(doc_id, text, source, ...), each as often as the mix takes it."""
    rows = sized(docs)
    narrow = materialize(rows.select("source", "_size", "_bits", "_u", "_tie"))
    plan, cut = plan_mix(narrow, weights, most)
    drop_scratch(narrow)
    taken = copies(rows, plan, cut).where("_copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(sized(documents(spark, sf_dir)).select("doc_id", "source", "_size", "_bits", "_u", "_tie"))
    plan, cut = plan_mix(rows)
    return copies(rows, plan, cut).select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.expr("cast(_size * _copies as bigint)").alias("taken"), F.col("_copies").alias("copies"))
