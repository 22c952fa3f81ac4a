"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Statistics are computed once for each document, from its bytes, and written to the shared folder. Class moments are sums over
all training rows (merged by Spark, so that no sample is drawn); each class covariance is shrunk towards its own diagonal
and, as it has few rows, towards a multiple of the pooled one. Scores are the logistic function of the difference of the two log
densities, from squared Mahalanobis distances by Cholesky factors that are computed once and kept with the model.

Labels, lang, source and doc_id are no inputs. Null and empty texts have the statistics of a text without words and a score
like any other; a null doc_id is in the training fold, but has no label. Ids with labels that contradict each other have none;
without any labels all scores are the prior's. Rows are scored one by one, whatever repeats; an empty table has none. Texts are read
whole, in batches that their bytes bound. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, Words, crc32_split, documents, labels, materialize, slices

FOLDS, HELD, THRESHOLD, STEPS = 4, 2, 0.7, 1 << 16
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>{}[]=_^~@\\")] = True
STOPS = np.zeros(256, dtype=bool)
STOPS[list(b".,;:!?")] = True
DIGITS = np.zeros(256, dtype=bool)
DIGITS[48:58] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True

STATISTICS = ["words", "word_length", "word_spread", "symbols", "stops", "digits", "upper", "short", "distinct", "same_next", "repeats", "lines", "ends"]


def statistics(column: pa.Array) -> np.ndarray:
    """The transformed statistics of each text, one row each."""
    words = Words(column, lower=True)
    n, counts, first = len(column), words.counts, words.first
    of_word = np.repeat(np.arange(n), counts)
    m = np.maximum(counts, 1).astype(float)
    length = (words.ends - words.starts).astype(float)
    total = np.bincount(of_word, length, n)
    mean = total / m
    spread = np.sqrt(np.maximum(np.bincount(of_word, length**2, n) / m - mean**2, 0))
    # bytes of words, by their text
    inside = ~WHITE[words.data]
    upto = np.concatenate([[0], np.cumsum(length.astype(np.int64))])
    letters = words.data[inside]

    def share(table: np.ndarray) -> np.ndarray:
        hits = np.concatenate([[0], np.cumsum(table[letters])])
        return hits[upto[first[1:]]] - hits[upto[first[:-1]]]

    ends = np.bincount(of_word, STOPS[words.data[words.ends - 1]] if len(words.ends) else None, n)
    same = np.zeros(n)
    if len(of_word) > 1:
        equal = (words.hashes[1:] == words.hashes[:-1]) & (of_word[1:] == of_word[:-1])
        same = np.bincount(of_word[1:], equal, n)
    order = np.lexsort((words.hashes, of_word))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (words.hashes[order][1:] != words.hashes[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    distinct = np.bincount(of_word, new[np.argsort(order)], n)
    at, text, gram = words.windows(3)
    order = np.lexsort((gram, text))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (gram[order][1:] != gram[order][:-1]) | (text[order][1:] != text[order][:-1])
    repeats = 1 - (np.bincount(text[order], fresh, n) + 1) / (np.maximum(counts - 2, 0) + 1)
    breaks = np.zeros(n)
    if len(words.data):
        # line breaks between two words of one text: some in the gap behind a word
        upto_break = np.concatenate([[0], np.cumsum(words.data == 10)])
        gap = upto_break[np.append(words.starts[1:], len(words.data))] - upto_break[words.ends] if len(words.ends) else np.zeros(0)
        breaks = np.bincount(of_word, gap > 0, n) if len(of_word) else breaks
    size = np.maximum(total, 1)
    log = np.log1p
    return np.column_stack([
        log(counts), np.log(mean + 1), log(spread), log(50 * share(SYMBOLS) / m), log(20 * share(STOPS) / m), log(20 * share(DIGITS) / size), np.sqrt(share(UPPER) / size),
        np.bincount(of_word, length <= 3, n) / m, log(distinct) - log(counts), np.sqrt(same / m), np.sqrt(np.maximum(repeats, 0)), log(20 * breaks / m), log(10 * ends / m),
    ])


def statistics_table(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(rows), pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


def forward(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of factor @ z = b for a lower triangular factor, by forward substitution."""
    z = np.zeros_like(b, dtype=float)
    for i in range(len(factor)):
        z[i] = (b[i] - factor[i, :i] @ z[:i]) / factor[i, i]
    return z


@dataclass
class Discriminant:
    means: list[np.ndarray]
    factors: list[np.ndarray]  #: lower Cholesky factors of the shrunk covariances
    priors: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        log = []
        for mean, factor, prior in zip(self.means, self.factors, self.priors):
            z = forward(factor, (x - mean).T)
            log.append(np.log(prior) - np.log(np.diag(factor)).sum() - 0.5 * (z * z).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def shrink(own: np.ndarray, rows: float, pooled: np.ndarray, diagonal: float = 0.1, strength: float = 20.0, floor: float = 1e-3) -> np.ndarray:
    """Towards the pooled covariance as rows are few (weight strength / (rows + strength)), and to the diagonal."""
    weight = strength / (rows + strength)
    mixed = (1 - weight) * own + weight * pooled
    mixed = (1 - diagonal) * mixed + diagonal * np.diag(np.diag(mixed))
    return mixed + floor * np.eye(len(mixed))


def fit(table: DataFrame, target: DataFrame) -> Discriminant:
    """From table(doc_id, x) and target(doc_id, y): only sums by class leave the executors. Statistics count in steps of 2**-16 and
    are summed as whole numbers, so the sums do not depend on the order of rows."""
    d = len(STATISTICS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d + 1, d + 1), dtype=object)
        for batch in batches:
            x = np.rint(np.array(batch.column("x").to_pylist(), dtype=float).reshape(-1, d) * STEPS).astype(np.int64)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            one = np.column_stack([np.full(len(x), STEPS), x])
            for c in (0, 1):
                part = one[y == c]
                total[c] += (part.T @ part).astype(object)
        c, i, j = np.indices(total.shape).reshape(3, -1)
        exact = pa.array([Decimal(int(v)) for v in total.ravel()], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), exact], ["c", "i", "j", "v"])

    rows = table.join(target, "doc_id").select("x", "y").mapInArrow(sums, "c int, i int, j int, v decimal(38,0)")
    total = np.zeros((2, d + 1, d + 1))
    for r in rows.groupBy("c", "i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["c"], r["i"], r["j"]] = float(r["v"]) / STEPS**2
    n = np.maximum(total[:, 0, 0], 0)
    means, own = [], []
    for c in (0, 1):
        mean = total[c, 0, 1:] / max(n[c], 1)
        means.append(mean)
        own.append(total[c, 1:, 1:] / max(n[c], 1) - np.outer(mean, mean))
    pooled = (n[0] * own[0] + n[1] * own[1]) / max(n.sum(), 1) if n.sum() else np.eye(d)
    if not n.sum():
        own = [np.eye(d), np.eye(d)]
    factors = [np.linalg.cholesky(shrink(own[c], n[c], pooled)) for c in (0, 1)]
    return Discriminant(means, factors, [(n[c] + 1) / (n.sum() + 2) for c in (0, 1)])


def classify(docs: DataFrame, labelled: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Scores of all docs by a model of the labelled rows (doc_id, quality) outside the held-out fold."""
    table = materialize(statistics_table(docs))
    target = labelled.where("doc_id is not null and quality in (0, 1)").where("not " + crc32_split("doc_id", FOLDS, HELD)).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("other")).where("y = other").drop("other")
    model = fit(table, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(-1, len(STATISTICS))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = table.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.expr(crc32_split("doc_id", FOLDS, HELD)).alias("held_out"), "score", "predicted")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), labels(spark, sf_dir))
