"""Document fingerprints from prefix polynomial hashes.

A text's code points c_0..c_(n-1) have prefix arrays P_i = sum of (c_j + 1) * B^j for j < i, modulo two primes below 2^31.
P answers the equality of any two spans: (P_(i+m) - P_i) * B^-i does not depend on where a span lies. Two things follow.

* The longest common extension of two texts from two places is found by binary search over span equality
  (``longest_common_extension``).
* A fingerprint: the hash of the whole text, and the prefix values at places chosen by content, those whose following window
  of ``window`` code points has a hash in the lowest ``1 / spacing`` of all hashes, or at the ``anchors`` lowest if these are
  more. So there is about one place to ``spacing`` code points at every length (of a repeated window, the first place), and
  an edit costs the same few code points in a long text as in a short one. Two fingerprints are compared after places that
  only one has are dropped: prefix values still give the hash of the span between any two places that remain. Also, the
  prefix values at up to 32 multiples of a power of two, of which the longest common beginning is found by binary search.
  ``likeness`` is the share of code points in spans that both have, or in that common beginning if it is longer (as where a
  text repeats itself and has few places of its own).

``near_edited`` and ``near_next`` have the prefix arrays of both texts at hand: each common place, the beginning and the end are
extended both ways as far as the texts agree, and the code points in such stretches are counted once in each text
(``extended_likeness``).

The form is ``length:whole hash:anchors:prefix values`` with hexadecimal numbers, of 8, 16 and 16 digits for the place, window hash and
prefix value of each anchor, and of 16 for each prefix value, without marks between them. Equal texts
have equal fingerprints. Null texts are empty; a text of at most ``window`` code points has no places, and is compared from its
beginning and its end; an empty one is alike (1.0) to an empty text and 0.0 to any other.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, parallelism, slices, texts

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1289706101)
U64 = np.uint64
_TABLES: list[list[np.ndarray]] = [[], []]


def _powers(n: int) -> list[list[np.ndarray]]:
    """For each prime, powers 0..n-1 of the base and of its inverse; kept by the worker, doubled on demand."""
    for k, (p, b) in enumerate(zip(PRIMES, BASES)):
        have = len(_TABLES[k][0]) if _TABLES[k] else 0
        if have < n:
            size = max(n, 2 * have, 1 << 15)
            made = []
            for base in (b, pow(b, -1, p)):
                table, step = np.ones(size, dtype=U64), 1
                factor = base
                while step < size:  # doubling: the next stretch is the last one times base**step
                    more = min(step, size - step)
                    table[step : step + more] = table[:more] * U64(factor) % U64(p)
                    factor, step = factor * factor % p, step * 2
                made.append(table)
            _TABLES[k] = made
    return _TABLES


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, text: str) -> None:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(U64) + U64(1)
        self.n = len(points)
        self.prefix = []
        for p, (pw, _) in zip(PRIMES, _powers(self.n + 1)):
            sums = np.zeros(self.n + 1, dtype=U64)
            np.cumsum(points * pw[: self.n] % U64(p), out=sums[1:])  # below 2^31 a term: no overflow before 2^33 of them
            self.prefix.append(sums % U64(p))
        self._order: dict[int, np.ndarray] = {}

    @classmethod
    def edited(cls, own: PrefixHash, following: PrefixHash, windows: Iterable[int] = ()) -> PrefixHash:
        """The prefix arrays of the ``edited`` text from those of its two texts, and its ``order`` of the ``windows``."""
        made = cls.__new__(cls)
        kept = own.n - own.n // 4
        taken = min(own.n // 4, following.n)
        made.n, made.prefix, made._order = kept + taken, [], {}
        for k, (p, (pw, _)) in enumerate(zip(PRIMES, _powers(made.n + 1))):
            tail = (following.prefix[k][1 : taken + 1] * pw[kept] + own.prefix[k][kept]) % U64(p)
            made.prefix.append(np.concatenate([own.prefix[k][: kept + 1], tail]))
        for window in windows:
            low, high = max(0, kept - window + 1), max(0, min(kept, made.n - window + 1))
            across = made._ordered(low, high, window) if low < high else np.zeros(0, dtype=U64)
            made._order[window] = np.concatenate([own.order(window)[:low], across, following.order(window)[: max(0, taken - window + 1)]])
        return made

    def _ordered(self, low: int, high: int, window: int) -> np.ndarray:
        out = np.zeros(high - low, dtype=U64)
        for k, (p, (_, inv)) in enumerate(zip(PRIMES, _powers(self.n + 1))):
            part = self.prefix[k][low + window : high + window] + U64(p) - self.prefix[k][low:high]  # below 2^32, times 2^31
            out = out << U64(31) | part * inv[low:high] % U64(p)
        return _scramble(out)

    def order(self, window: int) -> np.ndarray:
        """The scrambled hash of the window at each place, from 0; kept."""
        if window not in self._order:
            self._order[window] = self._ordered(0, max(0, self.n - window + 1), window)
        return self._order[window]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans; they depend on the spans' code points alone."""
        out = np.zeros(len(starts), dtype=U64)
        for k, (p, (_, inv)) in enumerate(zip(PRIMES, _powers(self.n + 1))):
            part = (self.prefix[k][ends] + U64(p) - self.prefix[k][starts]) * inv[starts] % U64(p)
            out = out << U64(31) | part
        return out

    def span(self, start: int, end: int) -> int:
        return int(self.hashes(np.array([start]), np.array([end]))[0])

    def values(self, at: np.ndarray) -> np.ndarray:
        return self.prefix[0][at] << U64(31) | self.prefix[1][at]


def longest_common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """The largest m with a[i:i+m] equal to b[j:j+m], by binary search over span equality."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if a.span(i, i + mid) == b.span(j, j + mid):
            low = mid
        else:
            high = mid - 1
    return low


def _extension(a: PrefixHash, i: int, b: PrefixHash, j: int, back: bool) -> int:
    """``extensions`` of one pair, in plain numbers."""
    low, high, way = 0, min(i, j) if back else min(a.n - i, b.n - j), -1 if back else 1
    marks = []
    for k, (p, (pw, inv)) in enumerate(zip(PRIMES, _powers(max(a.n, b.n) + 1))):
        x, y = a.prefix[k].item, b.prefix[k].item
        marks.append((x, x(i), y, y(j), pw.item(j - i) if j >= i else inv.item(i - j), p))
    while low < high:
        mid = min((low + high + 1) // 2, 2 * low + 32)  # most extensions are short
        for x, begin, y, other, move, p in marks:  # a span of a is moved to where that of b lies
            if ((x(i + way * mid) - begin) * move - y(j + way * mid) + other) % p:
                high = mid - 1
                break
        else:
            low = mid
    return low


def extensions(a: PrefixHash, i: np.ndarray, b: PrefixHash, j: np.ndarray, back: np.ndarray) -> np.ndarray:
    """``longest_common_extension`` from many pairs of places at once; where ``back`` holds, towards the beginning."""
    if len(i) <= 24:  # as for most pairs of texts; numpy takes longer to begin
        return np.array([_extension(a, x, b, y, z) for x, y, z in zip(i.tolist(), j.tolist(), back.tolist())], dtype=np.int64)
    low, high = np.zeros(len(i), dtype=np.int64), np.where(back, np.minimum(i, j), np.minimum(a.n - i, b.n - j))
    way, shift, marks = np.where(back, -1, 1), np.abs(j - i), []
    for k, (p, (pw, inv)) in enumerate(zip(PRIMES, _powers(max(a.n, b.n) + 1))):
        # a span of a is moved to where that of b lies, by the same power for all lengths
        marks.append((U64(p) - a.prefix[k][i], np.where(j >= i, pw[shift], inv[shift]), U64(p) + b.prefix[k][j]))
    found, live = low, np.arange(len(i))
    while len(live):
        mid = np.minimum((low + high + 1) // 2, 2 * low + 32)  # most extensions are short
        x, y, same = i + way * mid, j + way * mid, low < high
        for k, p in enumerate(PRIMES):
            ahead, move, behind = marks[k]
            same &= ((a.prefix[k][x] + ahead) * move + (behind - b.prefix[k][y])) % U64(p) == 0  # below 2^32, times 2^31
            if not same.any():
                break
        low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        open_ = low < high
        if 2 * np.count_nonzero(open_) <= len(live):  # go on with those that are not at their ends
            found[live] = low
            live, low, high, i, j, way = (v[open_] for v in (live, low, high, i, j, way))
            marks = [tuple(v[open_] for v in m) for m in marks]
    return found


def _scramble(h: np.ndarray) -> np.ndarray:
    h = h * U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(29)
    return (h * U64(0xBF58476D1CE4E5B9)) >> U64(32)


def grid_step(n: int, most: int = 32) -> int:
    """The least power of two of which n has at most ``most`` multiples."""
    return 1 << max(0, (max(n, 1) // (most + 1)).bit_length())


#: An anchor as it is written: 8, 16 and 16 hexadecimal digits.
ANCHOR = np.dtype([("at", ">u4"), ("window", ">u8"), ("value", ">u8")])


@dataclass(frozen=True)
class Fingerprint:
    n: int
    whole: int  #: the hash of all code points: also the prefix value at the end
    at: np.ndarray  #: places, ascending
    window: np.ndarray  #: the hash of the window behind each place
    value: np.ndarray  #: the prefix value at each place
    grid: np.ndarray  #: the prefix values at multiples of ``step``, from the first

    @property
    def step(self) -> int:
        return grid_step(self.n)

    def __str__(self) -> str:
        rows = np.empty(len(self.at), dtype=ANCHOR)
        rows["at"], rows["window"], rows["value"] = self.at, self.window, self.value
        return f"{self.n:x}:{self.whole:x}:{rows.tobytes().hex()}:{self.grid.astype('>u8').tobytes().hex()}"

    @staticmethod
    def parse(mark: str) -> Fingerprint:
        n, whole, parts, grid = mark.split(":")
        rows, values = np.frombuffer(bytes.fromhex(parts), ANCHOR), np.frombuffer(bytes.fromhex(grid), ">u8").astype(U64)
        return Fingerprint(int(n, 16), int(whole, 16), rows["at"].astype(np.int64), rows["window"].astype(U64), rows["value"].astype(U64), values)


def fingerprint(text: str, anchors: int = 64, window: int = 8, spacing: int = 32) -> Fingerprint:
    return marked(PrefixHash(text), anchors, window, spacing)


def marked(hashed: PrefixHash, anchors: int = 64, window: int = 8, spacing: int = 32) -> Fingerprint:
    n = hashed.n
    whole = int(hashed.values(np.array([n]))[0])
    step = grid_step(n)
    grid = hashed.values(np.arange(step, n + 1, step))
    if n <= window:
        return Fingerprint(n, whole, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64), np.zeros(0, dtype=U64), grid)
    starts = np.arange(1, n - window + 1)
    order = hashed.order(window)[1:]
    low = np.flatnonzero(order < U64((1 << 32) // spacing))
    chosen, first = np.unique(order[low], return_index=True)  # of a repeated window, the first place
    if len(chosen) >= anchors:
        at = starts[low][first]
    else:
        if len(order) > 8 * anchors:
            low = np.flatnonzero(order <= np.partition(order, 4 * anchors)[4 * anchors])
            if len(np.unique(order[low])) > anchors:  # else windows repeat so often that all must be looked at
                starts, order = starts[low], order[low]
        chosen, first = np.unique(order, return_index=True)
        at, chosen = starts[first[:anchors]], chosen[:anchors]
    by = np.argsort(at)
    return Fingerprint(n, whole, at[by], chosen[by], hashed.values(at[by]), grid)


def common_beginning(a: Fingerprint, b: Fingerprint) -> int:
    """The largest place on both grids up to which the texts agree, by binary search."""
    step = max(a.step, b.step)
    x, y = a.grid[step // a.step - 1 :: step // a.step], b.grid[step // b.step - 1 :: step // b.step]
    low, high = 0, min(len(x), len(y))
    while low < high:
        mid = (low + high + 1) // 2
        if x[mid - 1] == y[mid - 1]:
            low = mid
        else:
            high = mid - 1
    return low * step


def _spans(mark: Fingerprint, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and hashes of the spans between the places that both texts have."""
    keep = np.isin(mark.window, common)
    at = np.concatenate([[0], mark.at[keep], [mark.n]])
    value = np.concatenate([np.zeros(1, dtype=U64), mark.value[keep], np.array([mark.whole], dtype=U64)])
    out = np.zeros(len(at) - 1, dtype=U64)
    for k, (p, (_, inv)) in enumerate(zip(PRIMES, _powers(mark.n + 1))):
        part = value >> U64(31 * (1 - k)) & U64(0x7FFFFFFF)
        out = out << U64(31) | (part[1:] + U64(p) - part[:-1]) % U64(p) * inv[at[:-1]] % U64(p)
    return np.diff(at), out


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """The share of code points (of the longer text) in spans that both texts have, from their fingerprints alone."""
    if a.n == b.n and a.whole == b.whole:
        return 1.0
    if not a.n or not b.n:
        return 0.0
    common = np.intersect1d(a.window, b.window)
    (size, x), (_, y) = _spans(a, common), _spans(b, common)
    length, other = dict(zip(x.tolist(), size.tolist())), Counter(y.tolist())
    shared = sum(length[h] * min(c, other[h]) for h, c in Counter(x.tolist()).items() if h in other)
    return min(1.0, max(shared, common_beginning(a, b)) / max(a.n, b.n))


def _covered(start: np.ndarray, end: np.ndarray) -> int:
    """The number of places in at least one of the ranges."""
    by = np.argsort(start)
    start, end = start[by], np.maximum.accumulate(end[by])
    return int(np.maximum(0, end - np.maximum(start, np.concatenate([[0], end[:-1]]))).sum())


def extended_likeness(x: PrefixHash, a: Fingerprint, y: PrefixHash, b: Fingerprint) -> float:
    """The share of code points (of the longer text) in stretches that both have, with the prefix arrays of both texts."""
    if a.n == b.n and a.whole == b.whole:
        return 1.0
    if not a.n or not b.n:
        return 0.0
    _, p, q = np.intersect1d(a.window, b.window, assume_unique=True, return_indices=True)
    i, j = np.concatenate([[0], a.at[p], [a.n]]), np.concatenate([[0], b.at[q], [b.n]])
    by = np.lexsort((i, i - j))
    i, j = i[by], j[by]
    # Places of one diagonal with equal spans between them are one run; only a run's ends are extended.
    linked = np.diff(i - j) == 0
    linked[linked] = x.hashes(i[:-1][linked], i[1:][linked]) == y.hashes(j[:-1][linked], j[1:][linked])
    first, last = np.concatenate([[True], ~linked]), np.concatenate([~linked, [True]])
    left, right = i[first], i[last]
    back = np.arange(2 * len(left)) < len(left)
    more = extensions(x, np.concatenate([left, right]), y, np.concatenate([j[first], j[last]]), back)
    before, behind = more[: len(left)], more[len(left) :]
    shared = min(_covered(left - before, right + behind), _covered(j[first] - before, j[last] + behind))
    return shared / max(a.n, b.n)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the following text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


LOWEST = -(1 << 63)


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (key, doc_id, text, bucket, peek) in partitions sorted by bucket, peek, key and text.

    A bucket is a range of ids and holds, marked ``peek``, a copy of the rows at the beginning of the next one (the last
    bucket: of the first). An id that fills several buckets, as a null one may, is cut further by the first bytes of its texts. Bounds
    and beginnings are found from these alone, so texts are shuffled once. There are several buckets to a partition, which evens out
    what hashing gives each. Rows that agree in id and first bytes stay together.
    """
    head = F.conv(F.rpad(F.hex(F.substring(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"), "doc_id", "text", head.alias("head"))
    count = 8 * parts
    cuts = Counter(docs.agg(F.percentile_approx("key", [k / count for k in range(1, count)], 20_000).alias("c")).first()["c"] or [])
    array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.array().cast("array<long>")
    inner = F.lit(count)  # behind the parts of an id that begins the same range
    for key in sorted(k for k, times in cuts.items() if times > 1):
        shares = [k / (cuts[key] + 1) for k in range(1, cuts[key] + 1)]
        found = docs.where(F.col("key") == key).agg(F.percentile_approx("head", shares, 20_000).alias("c")).first()["c"]
        inner = F.when(F.col("key") == key, F.size(F.filter(array(sorted(set(found))), lambda b: b <= F.col("head")))).otherwise(inner)
    outer = F.size(F.filter(array(sorted(cuts)), lambda b: b <= F.col("key")))
    docs = docs.withColumn("bucket", outer.cast("long") * (count + 1) + inner)
    lowest = {r["bucket"]: tuple(r["low"]) for r in docs.groupBy("bucket").agg(F.min(F.struct("key", "head")).alias("low")).collect()}
    order = sorted(lowest)
    goes = {lowest[b]: order[k - 1] for k, b in enumerate(order)}  # order[-1] peeks at order[0]
    place = F.concat_ws(":", "key", "head")
    named = {f"{a}:{h}": b for (a, h), b in goes.items()}
    also = (F.element_at(F.create_map(*[F.lit(x) for pair in named.items() for x in pair]), place) if goes else F.lit(None)).cast("long")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("peek"))
    copy = F.struct(also.alias("bucket"), F.lit(True).alias("peek"))
    both = F.when(F.col("key").isin([a for a, _ in goes]) & place.isin(list(named)), F.array(own, copy)).otherwise(F.array(own))
    rows = docs.withColumn("x", F.explode(both)).select("key", "doc_id", "text", "x.bucket", "x.peek")
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "peek", "key", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, anchors: int = 64, window: int = 8, spacing: int = 32) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and its likeness to that and to the next row's.

    The next row is that of the next doc_id in ascending order, null ids first and equal ids by text; the last row's is the
    first, and a single row's is itself. Further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (bucket, doc_id, text, prefix arrays, fingerprint) of the row whose next one is still to come
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, text, bucket, peek in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), batch.column("bucket").to_pylist(), batch.column("peek").to_pylist()):
                if peek and (last is None or last[0] != bucket):
                    continue  # a further row with the peeked id
                hashed = PrefixHash(text)
                mark = marked(hashed, anchors, window, spacing)
                if last is not None and last[0] == bucket:
                    _, own_id, own, own_hashed, own_mark = last
                    changed = edited(own, text)
                    changed_hashed = PrefixHash.edited(own_hashed, hashed, [window])
                    changed_mark = marked(changed_hashed, anchors, window, spacing)
                    digest = hashlib.sha256(changed.encode("utf-8")).hexdigest()
                    near = (extended_likeness(own_hashed, own_mark, *other) for other in ((changed_hashed, changed_mark), (hashed, mark)))
                    rows.append((own_id, len(own), digest, str(own_mark), str(changed_mark), *near))
                last = None if peek else (bucket, doc_id, text, hashed, mark)
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in rows], schema=ARROW)

    parts = parallelism(docs.sparkSession)
    return in_order(docs, parts).select("doc_id", "text", "bucket", "peek").mapInArrow(run, SCHEMA)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
ARROW = pa.schema([(n, pa.int64() if n in NAMES[:2] else pa.float64() if n in NAMES[5:] else pa.string()) for n in NAMES])


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
