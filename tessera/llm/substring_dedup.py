"""Removal of passages that repeat across documents, by a compressed FM-index for each shard.

A window is ``size`` consecutive words (``[^\\x20\\x09-\\x0D]+``) of one document; a word goes if a window over it also starts in a
document with a smaller doc_id. Windows are judged on the input.

1. Sharding by content. Each window is dealt by its minimizer, the least hash of its word pairs. A run of windows with the
   same minimizer (a stretch) travels as one piece of text with the document that holds it; equal windows always meet in one
   shard. A shard has about ``shard_bytes`` of the text, up to 500 shards or two a task. Of equal stretches in one
   sending batch only those of the smallest document travel: the others repeat it whole, and are told so at once. So a notice in
   a third of all documents costs its shard one stretch a batch, not one a document. A frequent pair of words can be the
   minimizer of any share of the text, so a shard beyond ``most_bytes`` of stretches is dealt again in its task: by pairs, and
   what is still too long by the least hash of 4, of 8 and at last of all ``size`` words. Equal windows meet again each time.
   Its stretches come in small batches and go to a temporary file of the task, so they are never in memory together.
2. In a shard, stretches none of whose windows has a second document (by window hash) are set aside. An FM-index is built
   over the words of the others, and these are streamed through it whole: backward search over the wavelet tree gives the
   matching statistics of each of their places, and where ``size`` words match, the suffixes in the range tell the smallest
   document. Windows of larger documents are reported as intervals of words.
3. Intervals meet their documents by (doc_id, crc32 of the text), and the covered words are cut out.

Rows with a null doc_id keep all of their words and take none from others. Rows that share a doc_id have no effect on each
other; repeated rows each get the same result. Null and empty texts have no words, an empty table has no rows. Texts are cut at
no length. Other columns pass through whatever their names.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Words, documents, mix, parallelism, slices, spans, texts, trim_memory
from .fm_index import FMIndex

SIZE, GRAM = 13, 2
#: The words of which a shard that is too long takes the least hash, one after the other.
GRAMS = (GRAM, 4, 8, 1 << 30)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out, have = np.minimum(out[:-step], out[step:]), have + step
    return out


class Outbox:
    """Stretches of one task's documents, by shard, until they are sent. ``salt`` makes the shards of one deal independent of
    those of another."""

    def __init__(self, shards: int, gram: int = GRAM, salt: int = 0, level: int = 6) -> None:
        self.shards, self.gram, self.salt, self.level = shards, gram, U64(salt), level
        self.parts, self.bytes, self.turn = [], 0, int.from_bytes(os.urandom(2), "little")

    def add(self, words: Words, doc: np.ndarray, tag: np.ndarray, size: int, place: np.ndarray | None = None) -> None:
        """Texts with their documents; ``place`` is where in its document a text's words begin, if not at 0."""
        self.bytes += len(words.data)
        at, text = words.places(size)
        if not len(at):
            return
        gram = min(size, self.gram)
        places = np.arange(len(words.hashes) - gram + 1)
        least = _least(spans(words.hashes, places, places + gram), size - gram + 1)[at]
        begins = np.ones(len(at), dtype=bool)
        begins[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(at)) - 1
        shard = (mix(least[first] ^ self.salt) % U64(self.shards)).astype(np.int64)
        start, end = at[first], at[last] + size
        content = spans(words.hashes, start, end)
        begin = start - words.first[text[first]] + (0 if place is None else place[text[first]])
        self.parts.append((shard, content, doc[text[first]], tag[text[first]], begin, end - start, words.starts[start], words.ends[end - 1], words.data.tobytes()))

    def send(self) -> Iterator[tuple[int, bytes]]:
        """(shard, packed stretches); a negative shard holds intervals that are told already."""
        if not self.parts:
            self.bytes = 0
            return
        base = np.cumsum([0] + [len(p[8]) for p in self.parts])
        raw = b"".join(p[8] for p in self.parts)
        shard, content, doc, tag, place, words, low, high = (np.concatenate([p[k] + (base[i] if k in (6, 7) else 0) for i, p in enumerate(self.parts)]) for k in range(8))
        self.parts, self.bytes, self.turn = [], 0, self.turn + 1
        order = np.lexsort((doc, content, shard))
        shard, content, doc, tag, place, words, low, high = (x[order] for x in (shard, content, doc, tag, place, words, low, high))
        new = np.ones(len(shard), dtype=bool)
        new[1:] = (shard[1:] != shard[:-1]) | (content[1:] != content[:-1])
        heads = np.flatnonzero(new)
        own = doc == np.repeat(doc[heads], np.diff(np.append(heads, len(shard))))
        if not own.all():
            yield -1 - self.turn % self.shards, _told(doc[~own], tag[~own], place[~own], place[~own] + words[~own])
        shard, doc, tag, place, low, high, new = (x[own] for x in (shard, doc, tag, place, low, high, new))
        heads = np.flatnonzero(new)
        copies = np.diff(np.append(heads, len(shard)))
        cuts = np.flatnonzero(np.diff(shard[heads])) + 1
        packer = zstandard.ZstdCompressor(level=self.level)
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(heads))):
            own = slice(heads[a], heads[b - 1] + copies[b - 1])
            some = heads[a:b]
            text = b"\n".join(raw[i:j] for i, j in zip(low[some].tolist(), high[some].tolist()))
            fields = [copies[a:b].astype("<u4"), doc[own].astype("<i8"), tag[own].astype("<u4"), place[own].astype("<u4"), (high[some] - low[some]).astype("<u4")]
            blob = struct.pack("<II", b - a, len(doc[own])) + b"".join(f.tobytes() for f in fields) + text
            yield int(shard[heads[a]]), packer.compress(blob)


def _told(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(x.astype("<i8").tobytes() for x in columns))


def _tell(blob: bytes) -> dict[str, np.ndarray]:
    columns = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i8").reshape(4, -1)
    return dict(zip(["doc_id", "tag", "low", "high"], columns))


def _open(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = struct.unpack_from("<II", raw)
    out, at = [], 8
    for count, kind in ((n, "<u4"), (m, "<i8"), (m, "<u4"), (m, "<u4"), (n, "<u4")):
        out.append(np.frombuffer(raw, kind, count, at).astype(np.int64))
        at += out[-1].size * np.dtype(kind).itemsize
    return (*out, np.frombuffer(raw, np.uint8, offset=at))


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - starts, counts)


class Spool:
    """Packed stretches by shard in a temporary file, which goes when this does."""

    def __init__(self) -> None:
        self.file, self.places = tempfile.TemporaryFile(), defaultdict(list)

    def add(self, shard: int, blob: bytes) -> None:
        self.places[shard].append((self.file.tell(), len(blob)))
        self.file.write(blob)

    def read(self, shard: int) -> Iterator[bytes]:
        for start, length in self.places[shard]:
            self.file.seek(start)
            yield self.file.read(length)


def _opened(blobs: Iterable[bytes], limit: int = 400_000) -> Iterator[tuple[np.ndarray, ...]]:
    """Packed stretches opened, as many at once as make about ``limit`` bytes; a byte follows each stretch."""
    some, held = [], 0
    for blob in blobs:
        some.append(_open(blob))
        some[-1] = (*some[-1][:5], np.append(some[-1][5], np.uint8(10)))
        held += len(some[-1][5])
        if held >= limit:
            yield tuple(np.concatenate([x[c] for x in some]) for c in range(6))
            some, held = [], 0
    if some:
        yield tuple(np.concatenate([x[c] for x in some]) for c in range(6))


def _words(data: np.ndarray, length: np.ndarray) -> Words:
    return Words(None, raw=(data, np.concatenate([[0], np.cumsum(length + 1)])))


def _dealt_again(blobs: Iterable[bytes], box: Outbox, size: int, slice_bytes: int = 400_000, batch_bytes: int = 2_000_000) -> Iterator[tuple[int, bytes]]:
    """What a box sends of packed stretches, each once for each document and place that holds it."""
    for copies, doc, tag, place, length, data in _opened(blobs):
        piece, low = np.repeat(np.arange(len(copies)), copies), np.cumsum(length + 1) - (length + 1)
        upto, a, raw = np.cumsum(length[piece] + 1), 0, data.tobytes()
        while a < len(piece):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + slice_bytes, side="right")))
            some = piece[a:b]
            text = b"".join(raw[i:j] for i, j in zip(low[some].tolist(), (low + length + 1)[some].tolist()))
            box.add(_words(np.frombuffer(text, np.uint8), length[some]), doc[a:b], tag[a:b], size, place[a:b])
            a = b
            if box.bytes >= batch_bytes:
                yield from box.send()
    yield from box.send()


def bounded_intervals(blobs: Iterable[bytes], size: int, most_bytes: int, deal: int = 0) -> Iterator[dict[str, np.ndarray]]:
    """The same as ``shard_intervals`` in parts, where the stretches of a shard of more than ``most_bytes`` are dealt again, by the
    next of GRAMS, to shards of which only one is open at a time. Beyond the bound, stretches wait in files."""
    blobs, held, total = iter(blobs), [], 0
    for blob in blobs:
        held.append(blob)
        total += zstandard.frame_content_size(blob)
        if total > most_bytes and deal < len(GRAMS):
            break
    else:
        if held:
            yield shard_intervals(held, size)
        return
    whole = Spool()
    for blob in held:
        whole.add(0, blob)
    held.clear()
    for blob in blobs:
        whole.add(0, blob)
        total += zstandard.frame_content_size(blob)
    box = Outbox(3 * total // most_bytes + 1, GRAMS[deal], salt=0x9E3779B97F4A7C15 >> deal, level=3)
    parts = Spool()
    for shard, blob in _dealt_again(whole.read(0), box, size):
        if shard < 0:
            yield _tell(blob)
        else:
            parts.add(shard, blob)
    del whole, box
    for shard in parts.places:
        yield from bounded_intervals(parts.read(shard), size, most_bytes, deal + 1)


def shard_intervals(blobs: list[bytes], size: int) -> dict[str, np.ndarray]:
    """The intervals of words to remove in a shard: doc_id, tag, first word and the word behind the last."""
    opened = list(_opened(blobs))
    copies, doc, tag, place = (np.concatenate([o[k] for o in opened]) for k in range(4))
    none = {"doc_id": np.zeros(0, np.int64), "tag": np.zeros(0, np.int64), "low": np.zeros(0, np.int64), "high": np.zeros(0, np.int64)}
    words = Words.hashed(_words(o[5], o[4]) for o in opened)
    del opened
    first_copy = np.cumsum(copies) - copies
    least, most = np.minimum.reduceat(doc, first_copy), np.maximum.reduceat(doc, first_copy)
    at, piece, hashes = words.windows(size)
    order = np.argsort(hashes)
    groups = np.flatnonzero(np.append(True, np.diff(hashes[order]) != 0))
    several = np.minimum.reduceat(least[piece[order]], groups) < np.maximum.reduceat(most[piece[order]], groups)
    wanted = np.zeros(len(at), dtype=bool)
    wanted[order] = np.repeat(several, np.diff(np.append(groups, len(order))))
    if not wanted.any():
        return none
    kept = np.unique(piece[wanted])
    whole = np.isin(piece, kept)
    at, piece, hashes = at[whole], piece[whole], hashes[whole]
    # the words of the pieces in question, with a 0 in front of each
    starts, counts = words.first[:-1][kept], words.counts[kept]
    chosen = _expand(starts, counts)
    codes = np.unique(words.hashes[chosen], return_inverse=True)[1] + 1
    heads = np.cumsum(counts + 1) - (counts + 1)
    symbols = np.zeros(int((counts + 1).sum()) + 1, dtype=np.int64)
    symbols[np.delete(np.arange(len(symbols) - 1), heads)] = codes
    index = FMIndex(symbols, depth=1 << (size - 1).bit_length())
    owner = np.repeat(np.arange(len(kept)), counts + 1)
    owner = least[kept][np.append(owner, 0)]  # the smallest document at each symbol
    # stream the pieces; equal windows have one range, so each different one goes once
    unique, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    offset = at - words.first[:-1][piece]
    ends = heads[np.searchsorted(kept, piece)] + 1 + offset + size
    found, low, high = index.matches(symbols, ends[sample], size)
    by = np.argsort(low)
    bounds = np.column_stack([low[by], high[by]]).ravel()
    smallest = np.zeros(len(unique), dtype=np.int64)
    smallest[by] = np.minimum.reduceat(np.append(owner[index.suffixes], 0), bounds)[::2]
    repeated = found[inverse] >= size
    smallest = smallest[inverse]
    # each window for each entry of its piece
    times = copies[piece]
    entry = _expand(first_copy[piece], times)
    gone = np.repeat(repeated, times) & (doc[entry] > np.repeat(smallest, times))
    if not gone.any():
        return none
    entry, offset = entry[gone], np.repeat(offset, times)[gone]
    by = np.lexsort((offset, entry))
    entry, offset = entry[by], offset[by]
    begins = np.append(True, (entry[1:] != entry[:-1]) | (offset[1:] != offset[:-1] + 1))
    a = np.flatnonzero(begins)
    b = np.append(a[1:], len(entry)) - 1
    return {"doc_id": doc[entry[a]], "tag": tag[entry[a]], "low": place[entry[a]] + offset[a], "high": place[entry[a]] + offset[b] + size}


def repeated_spans(docs: DataFrame, size: int = SIZE, shard_bytes: int = 1_200_000, batch_bytes: int = 8_000_000, most_bytes: int = 5_000_000) -> DataFrame:
    """doc_id, tag (crc32 of the text) and the word intervals [low, high) to remove, of docs(doc_id, text)."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    # more shards than tasks need would make the packed stretches of a batch short, which pack badly
    shards = max(min(total // shard_bytes + 1, 500), 2 * parallelism(spark))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = Outbox(shards)

        def flush() -> Iterator[pa.RecordBatch]:
            for rows in batched(box.send(), 500):
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "blob"])
            trim_memory()

        for batch in slices(batches):
            doc, tag = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "tag"))
            box.add(Words(batch.column("text")), doc, tag, size)
            if box.bytes >= batch_bytes:
                yield from flush()
        yield from flush()

    def search(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = (blob for batch in batches for blob in batch.column("blob").to_pylist())
        for part in map(_tell, blobs) if key[0].as_py() < 0 else bounded_intervals(blobs, size, most_bytes):
            yield pa.RecordBatch.from_pydict(part)

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32("text").alias("tag"))
    dealt = rows.mapInArrow(deal, "shard long, blob binary").repartition(parallelism(spark), "shard")
    return dealt.groupBy("shard").applyInArrow(search, "doc_id long, tag long, low long, high long")


def remove_repeats(docs: DataFrame, size: int = SIZE, joined_by_space: bool = False, counts: bool = True, **options: int) -> DataFrame:
    """All columns of docs(doc_id, text, ...) with the text's remaining words, joined by one space, and, if ``counts``, _n_words and
    _n_removed. A text that loses nothing stays as it is, unless ``joined_by_space``."""
    extra = ["_n_words", "_n_removed"] if counts else []
    if clash := set(extra) & set(docs.columns):
        raise ValueError(f"docs has {sorted(clash)}; rename them or pass counts=False")
    found = repeated_spans(docs, size, **options)
    found = found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    # the rows go as structs, so that their names meet none of these
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(F.coalesce("text", F.lit(""))).alias("tag"), F.struct(*docs.columns).alias("row"))
    joined = rows.join(found, ["doc_id", "tag"], "left").select("row", "spans")
    columns, place = docs.columns, docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in extra)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = batch.column("row").flatten()
            whole = pa.RecordBatch.from_arrays([*fields, batch.column("spans")], [*(f"c{k}" for k in range(len(fields))), "spans"])
            for part in slices(iter([whole]), f"c{place}"):
                yield cut_part(part)
        trim_memory()

    def cut_part(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, total, gone = [], [], []
        for text, some in zip(texts(batch.column(place)), batch.column("spans").to_pylist()):
            words = text.encode().split()
            total.append(len(words))
            if some:
                steps = np.zeros(len(words) + 1, dtype=np.int32)
                for s in some:
                    steps[s["low"]] += 1
                    steps[s["high"]] -= 1
                free = np.cumsum(steps[:-1]) == 0
                words = [w for w, f in zip(words, free.tolist()) if f]
            gone.append(total[-1] - len(words))
            kept.append(b" ".join(words).decode() if gone[-1] or joined_by_space else text)
        arrays = [pa.array(kept, pa.string()) if k == place else batch.column(k) for k in range(len(columns))]
        numbers = [pa.array(total, pa.int64()), pa.array(gone, pa.int64())] if counts else []
        return pa.RecordBatch.from_arrays([*arrays, *numbers], [*columns, *extra])

    return joined.mapInArrow(cut, schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), joined_by_space=True)
    return kept.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
w as (select doc_id, unnest(range(1, len(words) - {SIZE} + 2)) as i, words from d where len(words) >= {SIZE}),
g as (select doc_id, i, array_to_string(words[i : i + {SIZE - 1}], ' ') as gram from w),
m as (select doc_id, i, min(doc_id) over (partition by gram) as least from g),
r as (select distinct doc_id, unnest(range(i, i + {SIZE})) as p from m where least < doc_id),
p as (select doc_id, unnest(range(1, len(words) + 1)) as p, words from d),
k as (select p.doc_id, string_agg(words[p.p], ' ' order by p.p) filter (where r.p is null) as kept, count(r.p) as gone from p left join r on p.doc_id = r.doc_id and p.p = r.p group by p.doc_id)
select d.doc_id, cast(len(d.words) as bigint) as n_words, cast(coalesce(gone, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k on d.doc_id = k.doc_id
"""
