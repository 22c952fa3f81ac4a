"""N-gram Jaccard join by token-combination prefixes, and the classes of linked documents.

A document's set holds the hashes of its different five-word shingles (with fewer words, of the whole sequence). Two
documents link if the intersection is at least 75 hundredths of the union. The join is exact: every bound below is necessary
for a link, and every candidate pair is verified on the sets.

1. Equal sets are one node: the smallest doc_id stands for them.
2. Pruning by extended prefixes. With k(n) = max(1, n / 20), the first n - ceil(0.75 n) + k(n) tokens in the order of their hashes
   of two linked sets have k of the smaller set in common. A document of whose prefix fewer than k(ceil(0.75 n)) tokens are in
   any other document's has no partner. Tokens travel by hash in packed blobs to be counted, those that several documents of a
   batch have once.
3. For the rest, the number of documents is counted for all of their tokens. Tokens that a document has alone come first in its
   order, then rare ones, then frequent ones; a set with more than n - ceil(0.75 n) of its own has no partner. So a shared passage
   makes no candidates of documents that have enough words of their own.
4. The index. Of two linked sets the first n - ceil(0.75 n) + k tokens share k. Tokens of at most ``rare`` documents are indexed by
   themselves, as far as k = 1 asks for: if the prefixes share a rare token at all, they share one there. Frequent tokens are indexed
   by combinations of two, with k = n / 4: two sets that share no rare token share k frequent ones; these are dealt by hash to
   k - 1 classes, so two of them meet in one class. k follows the power of two at or below the smaller set's size; a set is also
   indexed as of the next lower power if a partner may be that small. (With k = 1, frequent tokens stand alone.)
5. Candidates without all pairs of a block. Only classes of linked documents are asked for, so a block is compared with one
   pivot at a time, in a linear number of pairs. The pivot is the set with the smallest share of tokens of its own: a clean copy,
   to which the other copies link. A pivot that was compared with all of its block leaves it; blocks of one class are told.
6. Bounds on pairs. A pair of n and m tokens needs an overlap of 3/7 (n + m), so both must have as many tokens that other sets
   have; sets too poor in them for the smallest set of a block leave it. Two sets that meet by a combination have all of their rare
   tokens in the prefix, and if they share one they meet by it; so for them the frequent tokens alone must be as many. The sets
   may differ in (n + m) / 7 tokens at most, and the parities of tokens over 1024 bits differ in no more places than the sets do.
7. Where all but ``small`` sets of a block are in its pivot's class, these few are compared with the block under the same bounds.
   Other blocks get some further pivots; then their sets are indexed anew among themselves, by combinations of one token more out
   of longer prefixes: with k shared tokens in (k - 1) // (c - 1) classes, c of them meet in one. Tokens that only settled sets
   have no longer count. Blocks still open when combinations have ``LONGEST`` tokens are cut into tiles of ``small`` sets.
8. Pairs meet their sets by joins; links go to connected components. No group is collected anywhere.

Null and empty texts have empty sets and are linked with nothing. Repeated rows with one doc_id give one row each; a null
doc_id is its own class (null). Tokens are 64-bit hashes, and sets are compared by 48 bits of them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, documents, drop_scratch, free_shuffles, materialize, mix, parallelism, slices, spans
from .components import connected_components

SHINGLE, RARE, FILTER_BITS, ROUNDS, SMALL, LONGEST = 5, 24, 1 << 28, 3, 256, 4
_SIGNATURE = [f"g{k}" for k in range(16)]


def alpha(n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of n tokens with a partner: ceil(0.75 n)."""
    return (3 * n + 3) // 4


def extra(n: np.ndarray, size: int = 1) -> np.ndarray:
    """k(n): how many tokens of the smaller set a pair has in common in extended prefixes, for combinations of ``size`` tokens."""
    return np.maximum(1, n // {1: 20, 2: 4}.get(size, 2))


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, token) pairs without repeats, sorted, and the number of tokens of each document."""
    _, doc, token = words.windows(size)
    few = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(few):
        whole = spans(words.hashes, words.first[:-1][few], words.first[1:][few])
        doc, token = np.concatenate([doc, few]), np.concatenate([token, whole])
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    doc, token = doc[new], token[new]
    return doc, token, np.bincount(doc, minlength=len(words.counts))


def _rank_in_group(group: np.ndarray) -> np.ndarray:
    """0, 1, ... along each run of equal values."""
    new = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    return np.arange(len(group)) - np.repeat(new, np.diff(np.append(new, len(group))))


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(len(a) for a in arrays)], dtype="<u4").tobytes()
    kinds = "".join(a.dtype.str[1:] for a in arrays).encode()
    return zstandard.ZstdCompressor(level=1).compress(head + kinds + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (k,) = np.frombuffer(raw, "<u4", 1)
    sizes = np.frombuffer(raw, "<u4", k, 4)
    at = 4 + 4 * int(k)
    kinds = [raw[at + 2 * i : at + 2 * i + 2].decode() for i in range(k)]
    at += 2 * int(k)
    out = []
    for n, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(raw, f"<{kind}", n, at))
        at += n * int(kind[1])
    return out


class Dealer:
    """(key, document, value) triples of one task, sent as packed blobs by shard; documents are given as a table and places
    in it, with the differences of their ids, which pack well."""

    def __init__(self, shards: int, most: int = 1_000_000) -> None:
        self.shards, self.most, self.parts, self.held = shards, most, [], 0

    def add(self, shard: np.ndarray, token: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(token):
            self.parts.append((shard, token, doc))
            self.held += len(token)
        if self.held >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        shard, token, doc = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.held = [], 0
        order = np.lexsort((doc, shard))
        shard, token, doc = shard[order], token[order], doc[order]
        cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        blobs = []
        for a, b in zip(cuts, np.append(cuts[1:], len(shard))):
            new = np.append(True, doc[a + 1 : b] != doc[a : b - 1])
            table = doc[a:b][new]
            times = np.diff(np.append(np.flatnonzero(new), b - a))
            blobs.append(_pack(np.diff(table, prepend=0).astype("<i8"), times.astype("<u4"), token[a:b]))
        yield pa.RecordBatch.from_arrays([pa.array(shard[cuts], pa.int64()), pa.array(blobs, pa.binary())], ["shard", "blob"])


def _undeal(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    docs, tokens = [], []
    for blob in blobs:
        table, times, token = _unpack(blob)
        docs.append(np.repeat(np.cumsum(table), times))
        tokens.append(token)
    return np.concatenate(docs), np.concatenate(tokens)


def _document_frequencies(doc: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs sorted by token and document, without repeats, with the number of documents of each one's token."""
    order = np.lexsort((doc, token))
    doc, token = doc[order], token[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (token[1:] != token[:-1]))
    doc, token = doc[new], token[new]
    cuts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    times = np.diff(np.append(cuts, len(token)))
    return doc, token, np.repeat(times, times)


def node_table(docs: DataFrame) -> DataFrame:
    """doc_id, n and the 128-bit hash of the set (s1, s2), from docs(doc_id, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, token, n = shingle_sets(Words(batch.column("text"), lower=True))
            sums = []
            for salt in (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)):
                total = np.zeros(len(n) + 1, dtype=U64)
                upto = np.concatenate([[U64(0)], np.cumsum(mix(token ^ salt))])
                edge = np.concatenate([[0], np.cumsum(n)])
                total = upto[edge[1:]] - upto[edge[:-1]]
                sums.append(pa.array(total.view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *sums], ["doc_id", "n", "s1", "s2"])

    return docs.mapInArrow(sets, "doc_id long, n long, s1 long, s2 long")


def _bit_filter(nodes: DataFrame, bits: int) -> np.ndarray:
    """A bit table over node ids: no false negatives."""
    bit = F.pmod(F.xxhash64("node"), F.lit(bits)) + 1  # SQL's bitmaps count from one
    rows = nodes.select(bit.alias("b")).groupBy(F.expr("bitmap_bucket_number(b)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("m")).collect()
    out = np.zeros(bits // 8 + 8192, dtype=np.uint8)
    for r in rows:
        at = (r["k"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["m"]), dtype=np.uint8)
    return out


def _credits(doc: np.ndarray) -> bytes:
    """Documents and how often they occur."""
    ids, times = np.unique(doc, return_counts=True)
    return _pack(np.diff(ids, prepend=0).astype("<i8"), times.astype("<u4"))


def candidate_documents(docs: DataFrame, shards: int) -> DataFrame:
    """doc ids that share k(n) tokens of their extended prefix with other documents.

    A token that several documents of one sending batch have is told to these at once, and travels as one entry. So a token in
    a third of all documents makes one entry for each batch, not for each document.
    """
    spark = docs.sparkSession

    def deal(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
        parts, held, turn = [], 0, int.from_bytes(os.urandom(2), "little")

        def flush() -> pa.RecordBatch:
            doc, token, df = _document_frequencies(*(np.concatenate(x) for x in zip(*parts)))
            parts.clear()
            first = np.append(True, token[1:] != token[:-1])
            rows = [(-1 - turn % shards, _credits(doc[df > 1]))] if (df > 1).any() else []  # negative shards hold what is told already
            doc, token, several = doc[first], token[first], df[first] > 1
            shard = (mix(token) % U64(shards)).astype(np.int64)
            # 32 further bits do: tokens that fall together only keep a document in
            short = (mix(token ^ U64(0x5851F42D4C957F2D)) >> U64(32)).astype("<u4")
            order = np.lexsort((doc, shard))
            shard, short, doc, several = shard[order], short[order], doc[order], several[order]
            cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            for a, b in zip(cuts, np.append(cuts[1:], len(shard))):
                rows.append((int(shard[a]), _pack(np.diff(doc[a:b], prepend=0).astype("<i8"), short[a:b], several[a:b].astype("<u1"))))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "blob"])

        for batch in slices(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            doc, token, n = shingle_sets(Words(batch.column("text"), lower=True))
            prefix = _rank_in_group(doc) < (n - alpha(n) + extra(n))[doc]  # tokens are in the order of their hashes
            if prefix.any():
                parts.append((ids[doc[prefix]], token[prefix]))
                held += len(parts[-1][0])
            if held >= most:
                yield flush()
                held, turn = 0, turn + 1
        if parts:
            yield flush()

    homes = parallelism(spark)

    def count(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        opened = [_unpack(b) for b in frame["blob"]]
        doc = np.concatenate([np.cumsum(o[0]) for o in opened])
        if key[0] < 0:
            doc = np.repeat(doc, np.concatenate([o[1] for o in opened]))
        else:
            token, several = np.concatenate([o[1] for o in opened]), np.concatenate([o[2] for o in opened]) > 0
            order = np.lexsort((doc, token))
            doc, token, several = doc[order], token[order], several[order]
            cuts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            sizes = np.diff(np.append(cuts, len(token)))
            met = np.maximum.reduceat(several, cuts) | (doc[cuts] != doc[cuts + sizes - 1])
            doc = doc[np.repeat(met, sizes) & ~several]
        home = (mix(doc.view(U64)) % U64(homes)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        home, doc = home[order], doc[order]
        cuts = np.flatnonzero(np.append(True, home[1:] != home[:-1])) if len(home) else np.zeros(0, np.int64)
        return pd.DataFrame({"home": home[cuts], "blob": [_credits(part) for part in np.split(doc, cuts[1:])] if len(cuts) else []})

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        opened = [_unpack(b) for b in frame["blob"]]
        ids, place = np.unique(np.concatenate([np.cumsum(o[0]) for o in opened]), return_inverse=True)
        times = np.bincount(place, np.concatenate([o[1] for o in opened]))
        return pd.DataFrame({"doc_id": ids, "shared": times.astype(np.int64)})

    dealt = docs.mapInArrow(deal, "shard long, blob binary").repartition(homes, "shard")
    counted = dealt.groupBy("shard").applyInPandas(count, "home long, blob binary")
    return counted.groupBy("home").applyInPandas(total, "doc_id long, shared long")


def _classes(n: int, size: int) -> list[tuple[int, int]]:
    """(power, k) of the sizes that the smaller set of a pair with a set of n tokens can have."""
    top = n.bit_length() - 1
    low = int(alpha(np.int64(n))).bit_length() - 1
    return [(b, int(extra(np.int64(1 << b), size))) for b in range(low, top + 1)]


def _combinations(group: np.ndarray, token: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all combinations of ``size`` tokens of one group; the tokens are sorted by group and hash."""
    ends, last, key = np.searchsorted(group, group, side="right"), np.arange(len(token)), mix(token)
    for _ in range(size - 1):
        times = ends[last] - last - 1
        after = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - last - 1, times)
        key = mix(np.repeat(key, times) + token[after])
        last = after
    return key


def index_keys(n: int, token: np.ndarray, df: np.ndarray, rare: int = RARE, size: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a set's rare tokens and those of its frequent ones, in combinations of ``size``. token: those that other sets
    have, by number of sets and then hash. Frequent tokens have no keys if they are too few for the least overlap with the
    smallest partner."""
    least = int(alpha(np.int64(n)))
    spare = len(token) - least
    none = np.zeros(0, dtype=U64)
    if spare < 0:
        return none, none
    often, pairs = df > rare, [none]
    # the first token that both have in prefixes one longer than the spare is rare if any token that they share there is
    singles = token[: spare + 1][~often[: spare + 1]]
    for b, k in _classes(n, size) if 7 * int(often.sum()) >= 3 * (n + least) else []:
        head = token[: spare + k][often[: spare + k]]
        salt = mix(np.array([b + 1], dtype=U64))[0]
        c = min(k, size)
        group = (mix(head + salt) % U64((k - 1) // (c - 1) if c > 1 else 1)).astype(np.int64)
        order = np.lexsort((head, group))
        pairs.append(_combinations(group[order], head[order] ^ salt, c))
    return singles, np.unique(np.concatenate(pairs))


def block_index(sets: DataFrame, shards: int, rare: int = RARE, size: int = 2) -> DataFrame:
    """(key, node, n, s) of all index keys, from sets(node, n, tokens); s bounds the tokens that two sets
    with this key have in common: for a rare token those that other sets have, for a combination the frequent ones."""
    spark = sets.sparkSession

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Dealer(shards)
        for batch in batches:
            ids, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n"))
            token = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), dtype="<u8")
            yield from out.add((mix(token) % U64(shards)).astype(np.int64), token, np.repeat(ids, n))
        yield from out.flush()

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        doc, token, df = _document_frequencies(*_undeal(frame["blob"].tolist()))
        doc, token, df = doc[df > 1], token[df > 1], df[df > 1]
        home = (mix(doc.view(U64)) % U64(shards)).astype(np.int64)
        order = np.lexsort((doc, home))
        doc, token, df, home = doc[order], token[order], df[order], home[order]
        cuts = np.flatnonzero(np.append(True, home[1:] != home[:-1])) if len(home) else np.zeros(0, np.int64)
        blobs = [_pack(np.diff(doc[a:b], prepend=0).astype("<i8"), token[a:b].astype("<u8"), df[a:b].astype("<u4")) for a, b in zip(cuts, np.append(cuts[1:], len(home)))]
        return pd.DataFrame({"home": home[cuts], "blob": blobs})

    def keys(key: tuple, shared: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(shared):
            return pd.DataFrame({"key": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "s": np.zeros(0, np.int64)})
        opened = [_unpack(b) for b in shared["blob"]]
        doc = np.concatenate([np.cumsum(o[0]) for o in opened])
        token, df = (np.concatenate([o[k] for o in opened]) for k in (1, 2))
        order = np.lexsort((token, df, doc))
        doc, token, df = doc[order], token[order], df[order]
        cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        sizes = dict(zip(own["node"].tolist(), own["n"].tolist()))
        found, nodes, common = [], [], []
        for a, b in zip(cuts, np.append(cuts[1:], len(doc))):
            node = int(doc[a])
            both = index_keys(sizes[node], token[a:b], df[a:b], rare, size)
            found += both
            nodes += [node, node]
            common += [b - a, int((df[a:b] > rare).sum())]
        times = [len(f) for f in found]
        return pd.DataFrame({"key": np.concatenate(found).view(np.int64), "node": np.repeat(nodes, times), "n": np.repeat([sizes[x] for x in nodes], times), "s": np.repeat(common, times)})

    parts = parallelism(spark)
    counted = sets.mapInArrow(deal, "shard long, blob binary").repartition(parts, "shard").groupBy("shard").applyInPandas(count, "home long, blob binary")

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("node").to_numpy(zero_copy_only=False)
            home = (mix(ids.view(U64)) % U64(shards)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int64()), batch.column("node"), batch.column("n")], ["home", "node", "n"])

    known = sets.select("node", "n").mapInArrow(homes, "home long, node long, n long")
    return counted.groupBy("home").cogroup(known.groupBy("home")).applyInPandas(keys, "key long, node long, n long, s long")


def _fits(n: str, s: str, m: str, t: str) -> str:
    """Sizes n and m, of which s and t tokens are in other sets too, allow a link: an overlap of 3/7 of n + m."""
    return f"4 * least({n}, {m}) >= 3 * greatest({n}, {m}) and 7 * least({s}, {t}) >= 3 * ({n} + {m})"


def _differ(n: str, m: str, left: str, right: str) -> str:
    """The parities of two sets differ in as many places as the sets of a link can, at most."""
    return f"7 * ({' + '.join(f'bit_count({left}{g} ^ {right}{g})' for g in _SIGNATURE)}) <= {n} + {m}"


def _parities(doc: np.ndarray, token: np.ndarray, rows: int) -> list[pa.Array]:
    """For each document the parity of its tokens at each of 1024 bits, in long columns."""
    odd = np.bincount(doc * 1024 + (token >> U64(54)).astype(np.int64), minlength=1024 * rows) & 1
    words = np.packbits(odd.astype(np.uint8).reshape(rows, 1024), axis=1, bitorder="little").view("<i8")
    return [pa.array(np.ascontiguousarray(words[:, k]), pa.int64()) for k in range(len(_SIGNATURE))]


def verify(pairs: DataFrame, sets: DataFrame, share: int = 75) -> DataFrame:
    """Those of pairs(a, b) whose sets have 100 * intersection >= share * union."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            good, last, x = np.zeros(batch.num_rows, dtype=bool), None, None
            for i, (p, q) in enumerate(zip(left, right)):
                if p is not last:
                    x, last = _tokens48(p), p
                y = _tokens48(q)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 100 * both >= share * (len(x) + len(y) - both)
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    narrow = sets.select("node", "short")
    joined = pairs.join(narrow.toDF("a", "left"), "a").join(narrow.toDF("b", "right"), "b")
    return joined.select("a", "b", "left", "right").mapInArrow(test, "a long, b long")


def _tokens48(raw: bytes) -> np.ndarray:
    six = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    eight = np.zeros((len(six), 8), dtype=np.uint8)
    eight[:, :6] = six
    return eight.view("<u8").ravel()


def candidate_sets(docs: DataFrame, nodes: DataFrame, most_bits: int = FILTER_BITS) -> DataFrame:
    """(node, n, tokens, short, and the parities) of the documents among nodes(node), and of some more; short has 48 bits of each token.

    A bit table of 16 bits for each node goes to all tasks, so that texts are not shuffled. Where that would take more than
    ``most_bits``, the texts meet their nodes by a join, and every bit is set.
    """
    size = 1 << max(16, (16 * nodes.count()).bit_length())
    if size <= most_bits:
        bits = _bit_filter(nodes, size)
    else:
        docs, size = docs.join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), 8
        bits = np.full(1, 255, dtype=np.uint8)
    table = docs.sparkSession.sparkContext.broadcast(bits)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = table.value
        for batch in slices(batches):
            place = batch.column("bit").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((held[place >> 3] >> (place & 7) & 1).astype(bool)))
            if not batch.num_rows:
                continue
            doc, token, n = shingle_sets(Words(batch.column("text"), lower=True))
            edge = np.concatenate([[0], np.cumsum(n)])
            eight = token.astype("<u8").view(np.uint8).reshape(-1, 8)
            full, short = eight.tobytes(), np.ascontiguousarray(eight[:, :6]).tobytes()
            cut = lambda raw, w: pa.array([raw[w * a : w * b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())], pa.binary())
            whole = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), cut(full, 8), cut(short, 6), *_parities(doc, token, batch.num_rows)], ["node", "n", "tokens", "short", *_SIGNATURE])
            yield whole.filter(pa.array(n > 0))

    marked = docs.withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(size)))
    return marked.mapInArrow(sets, "node long, n long, tokens binary, short binary" + "".join(f", {g} long" for g in _SIGNATURE))


class _Links:
    """The links found so far, their classes, and the pairs that were compared."""

    def __init__(self, sets: DataFrame) -> None:
        self.sets, self.tried, self.found, self.scratch = sets, None, None, []
        self.classes = sets.sparkSession.createDataFrame([], "node long, component long")

    def keep(self, df: DataFrame) -> DataFrame:
        """df in a scratch table that goes with the others when the classes are told."""
        self.scratch.append(materialize(df))
        return self.scratch[-1]

    def signed(self, rows: DataFrame) -> DataFrame:
        """rows with the parities of their node."""
        return rows.join(self.sets.select("node", *_SIGNATURE), "node")

    def compare(self, pairs: DataFrame) -> None:
        """Verify pairs(a, b), a < b, that were not compared before."""
        pairs = pairs.distinct()
        new = self.keep(pairs if self.tried is None else pairs.join(self.tried, ["a", "b"], "left_anti"))
        if new.isEmpty():
            return
        links = self.keep(verify(new, self.sets))
        self.tried = new if self.tried is None else self.tried.union(new)
        if not links.isEmpty():
            self.found = links if self.found is None else self.found.union(links)
            self.classes = connected_components(self.found)
            self.scratch.append(self.classes)

    def drop(self) -> None:
        for df in self.scratch:
            drop_scratch(df)


def _open_blocks(links: _Links, held: DataFrame) -> DataFrame:
    """Of held(key, node, n, s) the rows that may still have a link to tell, with their class, their block's pivot (p) and the
    number of rows that are not in its class (o). Blocks of one class are told; rows poor in shared tokens for the smallest set of
    their block leave."""
    classed = held.join(links.classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    classed = classed.select("key", "node", "n", "s", "class")
    several = classed.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.min("n").alias("least")).where("lo <> hi").drop("lo", "hi")
    rows = materialize(classed.join(several, "key").where("7 * s >= 3 * (n + greatest(least, (3 * n + 3) div 4))").drop("least"))
    best = F.max_by(F.struct("node", "n", "s", "class"), F.struct(F.col("s") / F.col("n"), -F.col("node")))
    pivots = materialize(rows.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), best.alias("p")).where("lo <> hi").drop("lo", "hi"))
    others = rows.join(pivots, "key").where("class <> p.class").groupBy("key").agg(F.count("*").alias("o"))
    found = links.keep(rows.join(pivots.join(others, "key"), "key"))
    drop_scratch(rows)
    drop_scratch(pivots)
    return found


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def _pairs(links: _Links, few: DataFrame, rows: DataFrame, keys: list[str], once: str = "true") -> DataFrame:
    """(a, b) of the pairs of ``few`` with ``rows`` in one block and different classes, under the bounds."""
    right = links.signed(rows).select(*keys, "node", "n", "s", "class", "tile", *_SIGNATURE)
    left = links.signed(few).select(*keys, F.col("node").alias("other"), F.col("n").alias("m"), F.col("s").alias("t"), F.col("class").alias("to"), F.col("tile").alias("from"), *(F.col(g).alias(f"o{g}") for g in _SIGNATURE))
    return _ordered(left.join(right, keys).where(f"{once} and class <> to and {_fits('n', 's', 'm', 't')} and {_differ('n', 'm', '', 'o')}"), "node", "other")


def _few_against_all(links: _Links, rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("tile", F.lit(0))
    return _pairs(links, rows.where("class <> p.class"), rows, ["key"])


def _by_tiles(links: _Links, rows: DataFrame, size: int) -> DataFrame:
    """All pairs of each block. A block's rows are dealt into tiles of about ``size`` rows; each two tiles are a block of their own."""
    many = rows.groupBy("key").agg(F.ceil(F.count("*") / size).alias("many"))
    dealt = rows.join(many, "key").withColumn("tile", F.pmod(F.xxhash64("node", "key"), F.col("many")))
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)))
    met = met.withColumn("low", F.least("tile", "with")).withColumn("high", F.greatest("tile", "with"))
    # rows of one tile meet in that tile's own block
    return _pairs(links, met, met, ["key", "low", "high"], "node < other and (low = high or tile <> from)")


def _settle(links: _Links, blocks: DataFrame, rounds: int, small: int) -> DataFrame | None:
    """Tell all links of blocks(key, node, n, s) but those of blocks of which more than ``small`` rows are outside their pivot's class
    after all rounds; these blocks are returned."""
    spark, held = blocks.sparkSession, blocks
    if links.tried is None:
        # nothing is known yet: a first pivot without classes and parities
        pivots = held.groupBy("key").agg(F.count("*").alias("c"), F.max_by(F.struct("node", "n", "s"), F.struct(F.col("s") / F.col("n"), -F.col("node"))).alias("p")).where("c > 1")
        rows = links.keep(held.join(pivots, "key").where("node <> p.node"))
        links.compare(_ordered(rows.where(_fits("n", "s", "p.n", "p.s")), "node", "p.node"))
        held = rows.select("key", "node", "n", "s")
        free_shuffles(spark)
    for turn in range(rounds):
        rows = _open_blocks(links, held)
        if rows.isEmpty():
            return None
        large = rows.where(f"o > {small}")
        close = _ordered(large.where(f"class <> p.class and {_fits('n', 's', 'p.n', 'p.s')}"), "node", "p.node")
        links.compare(_few_against_all(links, rows.where(f"o <= {small}")).union(close))
        held = large.where("node <> p.node").select("key", "node", "n", "s")
        free_shuffles(spark)
        if large.isEmpty():
            return None
    rows = _open_blocks(links, held)
    return None if rows.isEmpty() else rows


def link_components(docs: DataFrame, shard_bytes: int = 6_000_000, rare: int = RARE, rounds: int = ROUNDS, small: int = SMALL, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs(doc_id, text). ``rare``, ``rounds``, ``small`` and ``filter_bits`` only move work between
    the steps above: the result is the same for all values."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    nodes = materialize(node_table(docs))
    real = nodes.where("doc_id is not null and n > 0")
    copies = real.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    total = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    shards = total // shard_bytes + parallelism(spark)

    shared = candidate_documents(docs.where("doc_id is not null and text is not null"), shards)
    likely = real.join(shared, "doc_id").where("shared >= greatest(1, ((3 * n + 3) div 4) div 20)").join(copies.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    likely = materialize(likely.select(F.col("doc_id").alias("node")).distinct())
    free_shuffles(spark)

    # one text for each node: rows that repeat a doc_id with another text were given the smallest id of their own set
    sets = materialize(candidate_sets(docs.where("doc_id is not null and text is not null"), likely, filter_bits))
    drop_scratch(likely)
    links, active = _Links(sets), sets
    for size in range(2, LONGEST + 1):
        blocks = links.keep(block_index(active.select("node", "n", "tokens"), shards, rare, size))
        free_shuffles(spark)
        large = _settle(links, blocks, rounds, small)
        if large is None:
            break
        if size == LONGEST:
            links.compare(_by_tiles(links, large, small))
        active = sets.join(large.select("node").distinct(), "node", "left_semi")
    of_set = copies.join(links.classes, copies["rep"] == links.classes["node"], "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    told = materialize(of_set)
    links.drop()
    drop_scratch(sets)
    out = nodes.join(told, ["n", "s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.expr("case when doc_id is not null then coalesce(component_id, doc_id) end").alias("component_id"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(documents(spark, sf_dir))


SQL = f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words from documents),
w as (select doc_id, unnest(range(1, greatest(len(words) - {SHINGLE - 2}, 2))) as i, words from d where len(words) > 0),
s as (select distinct doc_id, hash(array_to_string(words[i : i + {SHINGLE - 1}], ' ')) as t from w),
n as (select doc_id, count(*) as n from s group by doc_id),
r as (select t, count(*) as df from s group by t having count(*) > 1),
c as (select doc_id, t from s semi join r on s.t = r.t),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from c a join c b on a.t = b.t and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)),
e as (select a as u, b as v from l union select b, a from l),
k(node, low) as (select doc_id, doc_id from documents where doc_id is not null union select e.v, k.low from k join e on e.u = k.node where k.low < e.v)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, m.low as component_id
from documents d left join n on n.doc_id = d.doc_id left join (select node, min(low) as low from k group by node) m on m.node = d.doc_id
"""
