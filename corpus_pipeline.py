"""A corpus pipeline over ``documents`` in five stages; each works on all rows that the one before kept.

1. toxicity: documents that the classifier rejects go.
2. near duplicates: of each class of documents linked by their shingles, the one with the smallest doc_id stays.
3. repeated passages: words of passages that a document with a smaller doc_id holds go.
4. mixing: documents are taken as often as the target weights of their sources ask for.
5. packing: the mix as pieces of sequences.

All stages but the last return the columns of ``documents``, and further ones, whatever their names; n_chars follows the text.

Rows without a doc_id are scored, mixed and packed like others, but are no duplicate of any row and lose no passage. Null and
empty texts stay: they are not toxic, no duplicates, take no words of the mix and are packed as one closing id. Repeated rows
of one doc_id stay or go together until the mix, which draws them one by one. Texts are read whole at any length. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, ngram_join, packing, substring_dedup, toxicity
from tessera.llm.common import documents, labels, materialize, small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = toxicity.fit(docs, labels(spark, sf_dir))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = ngram_join.link_components(docs.select("doc_id", "text"))
    stay = found.where("component_id = doc_id").select(F.col("doc_id").alias("stay")).distinct()
    # the rows go as structs, so that their names do not matter
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*docs.columns).alias("row"))
    return rows.join(stay, F.col("id") == F.col("stay"), "left").where("id is null or stay is not null").select("row.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    cut = substring_dedup.remove_repeats(docs, counts=False)
    # a text that loses nothing stays as it is
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The toxicity scores and the sampling order have no SQL form; tests hold run() against the operators' own rules.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
