"""Toxicity by a support vector machine with a subsequence string kernel and Nyström landmarks.

The kernel counts common subsequences of three characters within a span of five, each occurrence weighted by decay**span, so
it tolerates gaps and inserted letters; it is normalised by the strings' lengths. Strings are the words of a text, lower-cased,
with punctuation taken out and runs of single letters joined (as in ``i.d i o t``), between two edge marks.

Training takes labelled texts and works on their words as short labelled sentences: those of clean texts are clean; of a toxic
text, at least one is toxic. It starts from words that begin like no word of a clean text but like words of more
toxic ones than by chance, and goes on in rounds: each toxic text names its highest word as toxic, clean texts name their highest as hard examples.
Features are kernel values to the landmarks times the inverse root of the landmarks' own kernel; the machine is linear in
them (squared hinge, Newton steps). A logistic fit turns the margins of a text's three highest words, its number of words and
its number of words over the margin into its score: a few accidental words of a long text do not make it toxic, many do.

Words stand in for sentences: a toxic phrase of ordinary words, or an insult split into parts of two or more letters (``mo
ron``), is seen as separate words only and is missed.

The machine is linear in subsequences, so its landmarks fold into one table of weights, and a text is scored by table lookups
over its bytes: whole texts, without a shuffle.

Bounds (parameters): at most ``most_toxic`` and ``most_clean`` labelled rows of up to ``most_chars`` characters are used to fit, those
with the smallest hashes of their ids, and one text for each id. A round's first toxic words are the 1,000 seeds in most texts; of the clean texts' different words, the
``negatives // 2`` (2,000) most frequent and every k-th, about as many again, are examples, and each round adds up to as many that
score highest; a round has at most ``landmarks`` (96) landmarks. A text is scored by all of its words. Labels, lang, source and doc_id are no inputs. Null and empty texts have no words and score like a clean word. Rows are
scored one by one, repeated ones alike, in batches that their bytes bound, so no text is too long; an empty table has no scores. Null
ids have no label and are not held out; ids with labels that contradict each other have none. Other columns pass through; the
names of the two new ones are parameters.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, crc32_split, documents, labels, slices, trimmed, utf8

FOLDS, HELD, THRESHOLD = 5, 0, 0.5
DECAY, SPAN = 0.7, 5
PATTERNS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
DROP = 63
#: A text's score is from this many of its words, those with the highest margins; margins are cut at +-FLOOR.
TOP, FLOOR = 3, -2.0
#: Symbols of bytes: 0 white space, letters 1-26, digits and other bytes above; punctuation is dropped.
SYMBOL = np.full(256, DROP, dtype=np.uint8)
SYMBOL[WHITE] = 0
for _b in range(26):
    SYMBOL[97 + _b] = SYMBOL[65 + _b] = 1 + _b
SYMBOL[48:58] = 27
SYMBOL[128:] = 28 + np.arange(128) % 34
# Characters that stand for letters.
for _a, _b in zip(b"0134578@$", b"oieastbas"):
    SYMBOL[_a] = SYMBOL[_b]


def _norm(length: np.ndarray) -> np.ndarray:
    """The root of a word's kernel with itself, by its number of symbols with edge marks."""
    own = sum(np.maximum(length - j, 0) * DECAY ** (2 * (j + 1)) for _, j in PATTERNS)
    return np.sqrt(np.maximum(own, 1e-9))


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all texts, each word behind a 0; where words begin (at that 0); and each word's text."""
    data, offsets = utf8(column)
    # a space in front of each text
    ends = offsets[1:]
    symbols = np.insert(SYMBOL[data], offsets[:-1], 0)
    text = np.repeat(np.arange(len(ends)), np.diff(offsets) + 1)
    keep = symbols != DROP
    symbols, text = symbols[keep], text[keep]
    keep = np.ones(len(symbols), dtype=bool)
    keep[:-1] = (symbols[1:] != 0) | (symbols[:-1] != 0)  # of several spaces, the last
    symbols, text = symbols[keep], text[keep]
    edge = np.flatnonzero(symbols == 0)
    size = np.diff(np.append(edge, len(symbols))) - 1
    # a space between two single letters of one text is dropped
    single = size == 1
    joined = np.zeros(len(edge), dtype=bool)
    joined[1:] = single[1:] & single[:-1] & (text[edge[1:]] == text[edge[:-1]])
    if joined.any():
        keep = np.ones(len(symbols), dtype=bool)
        keep[edge[joined]] = False
        symbols, text = symbols[keep], text[keep]
        edge = np.flatnonzero(symbols == 0)
    return symbols, edge, text[edge]


def word_sums(symbols: np.ndarray, edge: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """For each word, the sum of the table's weights over its subsequences."""
    n = len(symbols)
    x = np.concatenate([symbols.astype(np.int32), np.zeros(SPAN, dtype=np.int32)])
    word = np.concatenate([np.cumsum(symbols == 0), np.full(SPAN, len(edge) + 1)]).astype(np.int32)
    last = word - (x == 0)  # an edge mark also ends the word before it
    value = np.zeros(n, dtype=np.float32)
    high = x[:n] << 12
    for (i, j), table in zip(PATTERNS, tables):
        part = table[high | x[i : i + n] << 6 | x[j : j + n]]
        value += np.where(last[j : j + n] <= word[:n], part, np.float32(0))
    return np.add.reduceat(value, edge) if len(edge) else np.zeros(0, dtype=np.float32)


def lay_out(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words, given by their symbols, in a row behind edge marks, and where they begin."""
    symbols = np.frombuffer(b"".join(b"\0" + w for w in words), dtype=np.uint8)
    return symbols, np.flatnonzero(symbols == 0)


def normed_sums(symbols: np.ndarray, edge: np.ndarray, tables: np.ndarray) -> np.ndarray:
    size = np.diff(np.append(edge, len(symbols))) + 1
    return word_sums(symbols, edge, tables) / _norm(size)


def spread(weights: np.ndarray) -> np.ndarray:
    return np.stack([weights * DECAY ** (j + 1) for _, j in PATTERNS]).astype(np.float32)


def subsequence_weights(word: bytes) -> np.ndarray:
    """The normalised weights of a word's subsequences, by code."""
    x = [0, *word, 0]
    out = np.zeros(1 << 18, dtype=np.float32)
    for i, j in PATTERNS:
        for p in range(len(x) - j):
            out[x[p] << 12 | x[p + i] << 6 | x[p + j]] += DECAY ** (j + 1)
    return out / _norm(np.array([len(x)]))[0].astype(np.float32)


def kernel(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    symbols, edge = lay_out(words)
    return np.column_stack([normed_sums(symbols, edge, spread(subsequence_weights(m))) for m in landmarks])


def svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.0002, steps: int = 30) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, by Newton steps."""
    x = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        active = y * (x @ w) < 1
        a = x[active] * weight[active, None]
        new = np.linalg.solve(penalty + x[active].T @ a / weight.sum(), a.T @ y[active] / weight.sum())
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


@dataclass
class Model:
    tables: np.ndarray  #: weights of subsequences, one table for each pattern
    bias: float
    slope: np.ndarray = field(default_factory=lambda: np.zeros(TOP + 2))
    intercept: float = -3.0

    def features(self, column: pa.Array) -> np.ndarray:
        """The TOP highest margins of each text's words, one column each (where words are fewer, the lowest possible); less for
        more words, as a long text has more accidental ones; and more for more words over the margin."""
        symbols, edge, text = words_of(column)
        out = np.full((len(column), TOP), FLOOR)
        over = np.zeros(len(column))
        if len(edge):
            value = np.clip(normed_sums(symbols, edge, self.tables) + self.bias, FLOOR, -FLOOR)
            first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            order = np.lexsort((-value, text))
            size = np.diff(np.append(first, len(text)))
            for k in range(TOP):
                some = size > k
                out[text[first[some]], k] = value[order[first[some] + k]]
            over = np.bincount(text, weights=value > 0, minlength=len(column))
        return np.column_stack([out, -np.log1p(np.bincount(text, minlength=len(column))), np.log1p(over)])

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(column) @ self.slope + self.intercept, -500, 500)))


def bag(text: str) -> list[bytes]:
    """A text's different words."""
    symbols, edge, _ = words_of(pa.array([text]))
    raw = symbols.tobytes()
    return sorted(set(raw.split(b"\0")) - {b""})  # 0 is in front of each word


def train(words: list[bytes], y: np.ndarray, weight: np.ndarray, landmarks: list[bytes]) -> Model:
    own = kernel(landmarks, landmarks)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    keep = value > 1e-3
    root = vector[:, keep] / np.sqrt(value[keep])
    w = svm(kernel(words, landmarks) @ root, y, weight)
    beta = root @ w[:-1]
    folded = sum(b * subsequence_weights(m) for b, m in zip(beta, landmarks))
    return Model(spread(folded), float(w[-1]))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes (not negative) and intercept of a lightly penalised logistic fit of y (0, 1)."""
    a = np.column_stack([x, np.ones(len(x))])
    free = np.ones(a.shape[1], dtype=bool)
    while True:
        w = np.zeros(free.sum())
        some = a[:, free]
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(some @ w, -30, 30)))
            step = np.linalg.solve((some * (p * (1 - p))[:, None]).T @ some + 0.05 * np.eye(len(w)), some.T @ (y - p) - 0.05 * w)
            w = w + np.clip(step, -2, 2)
        full = np.zeros(len(free))
        full[free] = w
        if (full[:-1] >= 0).all():
            return full[:-1], float(full[-1])
        free[:-1] &= full[:-1] > 0


def fit_texts(toxic: list[str], clean: list[str], landmarks: int = 96, rounds: int = 5, negatives: int = 4000) -> Model:
    bags, clear = [bag(t) for t in toxic], [bag(t) for t in clean]
    if not any(bags) or not any(clear):
        return Model(spread(np.zeros(1 << 18, dtype=np.float32)), -1.0)

    def heads(w: bytes) -> set[bytes]:
        return {w[:k] for k in range(4, min(len(w), 8) + 1)}

    # words that begin like words of so many more toxic than clean texts that chance would give less than one such beginning
    among = Counter(h for b in bags for h in set().union(*map(heads, b)))
    against = Counter(h for b in clear for h in set().union(*map(heads, b)) if h in among)
    share = len(bags) / (len(bags) + len(clear))
    least = math.log(max(len(among), 2))

    def telling(n: int, m: int) -> bool:
        rate = n / (n + m)
        if n * len(clear) < 8 * m * len(bags) or rate <= share:
            return False
        bits = rate * math.log(rate / share) + ((1 - rate) * math.log((1 - rate) / (1 - share)) if m else 0)
        return (n + m) * bits > least

    strong = {h for h, n in among.items() if n > 1 and telling(n, against[h])}
    seeds = Counter(w for b in bags for w in b if not strong.isdisjoint(heads(w)))
    del among, against, strong
    positive = dict((seeds or Counter(w for b in bags for w in b)).most_common(1000))
    common = Counter(w for b in clear for w in b)
    every = sorted(common)
    hard = ({w for w, _ in common.most_common(negatives // 2)} | set(every[:: max(1, 2 * len(every) // negatives)])) - set(positive)
    listed = sorted(set(every).union(*bags))
    place = {w: k for k, w in enumerate(listed)}
    model = None
    for turn in range(rounds):
        good = [w for w, _ in sorted(positive.items(), key=lambda x: (-x[1], x[0]))]
        third = max(1, landmarks // 3)
        marks = [*good[:third], *good[third :: max(1, (len(good) - third) // third)][:third], *sorted(hard)[:: max(1, len(hard) // third)][:third]]
        words = [*good, *sorted(hard)]
        y = np.array([1.0] * len(good) + [-1.0] * len(hard))
        told = np.sqrt([positive[w] for w in good])  # words that more texts name count more
        weight = np.concatenate([told / told.sum(), np.full(len(hard), 4 / len(hard))])
        model = train(words, y, weight, list(dict.fromkeys(marks)))
        if turn == rounds - 1:
            break
        value = np.concatenate([normed_sums(*lay_out(listed[i : i + 50_000]), model.tables) for i in range(0, len(listed), 50_000)]) + model.bias
        # every toxic text names its highest word; clean texts name theirs where it is near or over the margin
        named: Counter = Counter()
        for b in bags:
            if b:
                top = max(b, key=lambda w: value[place[w]])
                if value[place[top]] > 0.3:
                    named[top] += 1
        named = Counter({w: n for w, n in named.items() if telling(n, common[w])})
        positive = {w: n for w, n in positive.items() if value[place[w]] > -0.2}
        positive |= {w: max(n, positive.get(w, 0)) for w, n in named.items()}
        hard |= {w for w in sorted(common, key=lambda w: -value[place[w]])[: negatives // 2] if value[place[w]] > -1.0}
        hard -= set(positive)
        if not positive:
            positive = dict(seeds.most_common(1000)) or {bags[0][0]: 1}
    every_text = [*toxic, *clean]
    seen = np.vstack([model.features(pa.array(every_text[i : i + 32], pa.string())) for i in range(0, len(every_text), 32)])
    model.slope, model.intercept = logistic(seen, np.array([1.0] * len(toxic) + [0.0] * len(clean)))
    return model


def fit(docs: DataFrame, labelled: DataFrame, most_toxic: int = 1000, most_clean: int = 2000, most_chars: int = 200_000) -> Model:
    known = labelled.where("doc_id is not null and toxic in (0, 1)").where("not " + crc32_split("doc_id", FOLDS, HELD))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").select("doc_id", "toxic")
    order = F.xxhash64("doc_id")
    rows = [known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(n) for y, n in ((1, most_toxic), (0, most_clean))]
    chosen = F.broadcast(rows[0].union(rows[1]))  # at most most_toxic + most_clean ids
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").where(f"coalesce(length(text), 0) <= {most_chars}")
    found = sorted(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect(), key=lambda r: r["doc_id"])
    return fit_texts(*([r["text"] or "" for r in found if r["toxic"] == y] for y in (1, 0)))


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD, names: tuple[str, str] = ("_score", "_predicted")) -> DataFrame:
    """docs with a score and a prediction, in columns of these names."""
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"docs has {sorted(clash)}; pass other names")
    held, columns = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = held.value.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*columns, *names])

    return docs.mapInArrow(lambda batches: trimmed(run(batches)), schema)


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with the columns of docs alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(held.value.score(batch.column("text")) < threshold))

    return docs.mapInArrow(lambda batches: trimmed(run(batches)), docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = scores(docs, fit(docs, labels(spark, sf_dir)))
    return scored.select("doc_id", F.expr(crc32_split("doc_id", FOLDS, HELD)).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))
