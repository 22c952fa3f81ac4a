"""Token counts by a map-side two-tier lookup.

The vocabulary's segmentation is local to pre-tokens: no piece holds a word mark after another character, so a
text's count is the sum over its pre-tokens (a run of marks and the characters up to the next mark). Tier one is a
broadcast table of frequent pre-tokens and their lengths, of at most ``table_size`` entries, gathered from about
``sample_rows`` rows drawn alike from all partitions: it only saves work and never changes a count. Tier two is a cache in each
Python worker, of at most ``cache_size`` entries, which later tasks of the worker find filled; what neither holds is encoded in one
call for a batch. Nothing is shuffled.

Null and empty texts have no tokens. Rows pass through one by one: repeated rows are counted each, null ids stay null,
further columns are not read. A text may be of any length: it is counted whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import documents, slices, texts

MODEL = "piece_bpe_32k.model"
MARK = "▁"
_RUNS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens without their first mark; a text's leading mark is the one the library adds."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[-1] != " " and text[0] != " ":
        return text.split(" ")
    return [x[1:] for x in _RUNS.findall(MARK + text.replace(" ", MARK))]


class Encoder:
    """Lengths of pre-tokens for one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def lengths(self, tokens: list[str]) -> list[int]:
        # behind a letter, so that runs of marks alone and an empty rest have a count as well
        plain = [not x.startswith(MARK) and x != "" for x in tokens]
        found = self.model.encode([x if p else f"x{MARK}{x}" for x, p in zip(tokens, plain)], num_threads=1)
        return [len(ids) - (not p) for ids, p in zip(found, plain)]


#: By model file: the encoder and the lengths that this worker has found.
_WORKER: dict[str, tuple[Encoder, dict[str, int]]] = {}


def _encoder(path: str) -> tuple[Encoder, dict[str, int]]:
    if path not in _WORKER:
        _WORKER[path] = Encoder(path), {}
    return _WORKER[path]


def frequent_lengths(docs: DataFrame, path: str, sample_rows: int, table_size: int) -> dict[str, int]:
    """Tier one: the most frequent pre-tokens of about sample_rows rows, drawn alike from all partitions, and their lengths."""
    seen: Counter = Counter()
    share = min(1.0, sample_rows / max(docs.count(), 1))
    for row in docs.select("text").sample(share, 1).where("text is not null").collect():
        seen.update(x for x in pre_tokens(row[0]) if len(x) <= 40)
    top = [x for x, _ in seen.most_common(table_size)]
    return dict(zip(top, Encoder(path).lengths(top))) if top else {}


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 4096, sample_rows: int = 500, table_size: int = 20_000, cache_size: int = 400_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for each row of docs(doc_id, text)."""
    spark, path = docs.sparkSession, path or tokenizer_path(MODEL)
    table = spark.sparkContext.broadcast(frequent_lengths(docs, path, sample_rows, table_size))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (encoder, known), frequent = _encoder(path), table.value
        known.update(frequent)
        for batch in slices(batches):
            column = batch.column("text")
            split = [pre_tokens(x) for x in texts(column)]
            missing = list(set().union(*split).difference(known))
            if len(known) + len(missing) > cache_size + len(frequent):
                known.clear()
                known.update(frequent)
                missing = list(set().union(*split).difference(known))
            known.update(zip(missing, encoder.lengths(missing)))
            get = known.__getitem__
            n = pa.array([sum(map(get, x)) for x in split], pa.int64())
            size = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
