"""What several operators share: tables, shared scratch tables, and hashing of words in Arrow batches.

The hashing works on the raw UTF-8 buffer of an Arrow string column, so that no Python object is made
per word. A word's hash is a polynomial over a table of random 64-bit byte values, modulo 2**64, read off a
prefix array and finalised; a window's hash is the same over the hashes of its words.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space: the complement of the word class [^\x20\x09-\x0D].
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

U64 = np.uint64
_LIBC = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python a thousand at a time, and about 8 MB at most, which bounds what a worker holds beside its own arrays. An
    executor holds a batch off its heap two or three times, and Spark's own bound is 64 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only where that setting is missing and all runs on one machine, as in tests, a temporary folder is made.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-scratch-")
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: it is computed once, and lost executors cost no rework."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), in place on an own copy."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


_TABLE = mix((np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1))
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_POWERS: list[np.ndarray] = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n-1 of the base and of its inverse, modulo 2**64; kept by the worker."""
    have = len(_POWERS[0])
    if have < n:
        size = max(n, have * 3 // 2, 1 << 16)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] for each pair, from one prefix array."""
    pw, inv = powers(len(values) + 1)
    prefix = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * pw[: len(values)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (one more than rows); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """The words of some texts: byte spans, 64-bit hashes, and where each text's words begin."""

    def __init__(self, column: pa.Array | None, lower: bool = False, raw: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        data, offsets = raw if raw is not None else utf8(column)
        self.data, n = data, len(data)
        inside = ~WHITE[data]
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edge = offsets[(offsets > 0) & (offsets < n)]
            begins[edge] |= inside[edge]
            ends[edge - 1] |= inside[edge - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.hashes = spans((_LOWER if lower else _TABLE)[data], self.starts, self.ends)
        #: words of text k: first[k]:first[k + 1]
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    @classmethod
    def hashed(cls, parts: Iterator["Words"]) -> "Words":
        """The texts of several parts one after the other, of which only the words' hashes and counts are kept."""
        some = [(p.hashes, p.counts) for p in parts]
        words = cls.__new__(cls)
        words.hashes, words.counts = (np.concatenate([x[k] for x in some]) for k in range(2))
        words.first = np.concatenate([[0], np.cumsum(words.counts)])
        return words

    def places(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of first word, text) of each run of ``size`` words inside one text."""
        per = np.maximum(self.counts - size + 1, 0)
        text = np.repeat(np.arange(len(per)), per)
        return np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(self.first[:-1], per), text

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same with each run's hash."""
        at, text = self.places(size)
        return at, text, spans(self.hashes, at, at + size)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 400_000) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows to about ``limit`` bytes of text; a longer text comes alone."""
    for batch in batches:
        offsets, begin = utf8(batch.column(text))[1], 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def texts(column: pa.Array) -> list[str]:
    """The column as Python strings, nulls as empty ones."""
    return [x or "" for x in column.to_pylist()]


def crc32_split(doc_id: str, folds: int, held: int) -> str:
    """SQL: the row belongs to the held-out fold (crc32 of the id as text, modulo folds)."""
    return f"coalesce(pmod(crc32(cast({doc_id} as string)), {folds}) = {held}, false)"


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialize`` that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file.rpartition("/")[0])
        if "/tessera-" in path.toString():
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def trim_memory() -> None:
    """Give a worker's free memory back to the system; workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task, after which its worker gives memory back."""
    yield from batches
    trim_memory()


def free_shuffles(spark: SparkSession) -> None:
    """Ask the driver to let go of finished plans, so that their shuffle files are removed from the executors' disks."""
    gc.collect()
    spark._jvm.System.gc()
