"""Packing by power-of-two decomposition.

A document's ids (with the closing id) are cut into as many pieces of the full length as fit, and the rest by its binary
digits, largest first. Each piece is a sequence of its own in the bucket of its length: no sequence crosses documents and,
as every length is a power of two, none is padded. There is no shuffle, and a task holds one document's ids at a time.

Ids are those of the tokenizer library. A text is cut at single spaces between two characters that are not white space,
which are always token boundaries of this vocabulary; the parts' ids are cached in the worker (at most ``cache_size`` of
them), and those of parts that are not cached come from the same vocabulary's faster library where the part is plain Latin,
else from the library itself.

Null and empty texts are one closing id. Each row is packed by itself, so repeated rows are packed each and null ids stay
null; sequence numbers tell the rows apart. Further columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import documents, slices, texts
from .token_counts import tokenizer_path

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
LENGTH, CLOSING = 2048, 1
_CUT = re.compile(r"(?<=\S) (?=\S)")
_PLAIN = re.compile("[\x00-\x1b\x20-\x7e\xa1-ɏ]*")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


class Ids:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str, ranks: str | None, cache_size: int = 300_000, part_limit: int = 48) -> None:
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary)
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.cache: dict[str, bytes] = {}
        self.cache_size, self.part_limit = cache_size, part_limit

    def encode(self, part: str) -> bytes:
        if self.fast is not None and "<|" not in part and _PLAIN.fullmatch(part):
            ids = self.fast.encode_ordinary(part)
        else:
            ids = self.exact.encode(part, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = _CUT.split(text)
        cache, encode = self.cache, self.encode
        found = [encode(first)]
        for part in rest:
            ids = cache.get(part)
            if ids is None:
                ids = encode(" " + part)
                if len(part) <= self.part_limit:
                    if len(cache) >= self.cache_size:
                        cache.clear()
                    cache[part] = ids
            found.append(ids)
        return b"".join(found)


def binary_lengths(tokens: int, length: int = LENGTH) -> list[int]:
    """Piece lengths of a document: full ones, then the binary digits of the rest, largest first."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << k for k in range(length.bit_length() - 2, -1, -1) if rest >> k & 1]


_WORKER: dict = {}


def pack(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, length: int = LENGTH, closing: int = CLOSING) -> DataFrame:
    """One row for each piece of docs(doc_id, text); ``length`` is a power of two."""
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    if vocabulary is None:
        vocabulary, ranks = tokenizer_path(VOCABULARY), tokenizer_path(RANKS)
    end = np.asarray([closing], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocabulary, ranks)
        if key not in _WORKER:
            _WORKER[key] = Ids(vocabulary, ranks)
        ids_of, next_id = _WORKER[key], TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text"))):
                ids = memoryview(ids_of(text) + end)
                start, total = 0, len(ids) // 4
                for size in binary_lengths(total, length):
                    rows.append((doc_id, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), total, next_id, 0, size.bit_length() - 1))
                    start, next_id = start + size, next_id + 1
            if rows:
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                columns[-1] = columns[-1].cast(pa.int32())
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"])

    return docs.select("doc_id", "text").mapInArrow(cut, SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
