"""The text operators on a small table with odd rows, against brute force, round trips or held-out labels."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, fingerprints, fm_index, license_scan, mixing, ngram_join, packing, quality_classifier, quality_rules, registry, substring_dedup, token_counts, toxicity
from tessera.llm.common import Words, documents

SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("shard", pa.string()), ("bucket", pa.int32())])


def rows():
    random.seed(11)
    vocabulary = ["".join(random.choice("abcdefg") for _ in range(random.randint(1, 6))) for _ in range(400)]
    prose = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    passage, base = prose(60), prose(200)
    texts = [None, "", " ", "one", "Two words", "a b c d", base, base, base.upper(), "the mit licence", "Released under the MIT License.\nApache License, Version 2.0", "licensed under cc by-nc 4.0 " * 2]
    for k in range(12):  # near copies, each with some words changed
        words = base.split()
        for _ in range(k):
            words[random.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [f"{prose(30)} {passage} {prose(40)}" for _ in range(8)]
    texts += ["line of some words\n" * 9 + prose(60), "x " * 500, "é漢😀 ß　<|endoftext|> ▁▁ <s> \t\x0b \u0085 y", prose(6000), "same tail " + passage, "#$% ** || && <> ##" * 20, "\n\n \n"]
    out = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", "s3", "hot", "hot", None)[i % 6], len(t or ""), "clash", 7) for i, t in enumerate(texts)]
    out.append(out[6])  # a repeated row
    out += [(None, base, "en", "s1", 3, None, None), (None, None, None, None, None, None, None), (-5, passage + " " + prose(20), "en", "s1", None, "c", 1)]
    return out


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows()), SCHEMA)], schema=SCHEMA)
    pq.write_table(table, path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [1, 2, 6, 12, None], "quality": pa.array([1, 0, 1, 0, 1], pa.int32()), "toxic": pa.array([0, 1, 0, 1, 0], pa.int32())}), path / "labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    pq.write_table(SCHEMA.empty_table(), path / "documents.parquet")
    pq.write_table(pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]).empty_table(), path / "labels.parquet")
    return str(path)


OPS = sorted(registry.QUERIES)


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", [n for n in OPS if not n.startswith("op6")])
def test_one_row_for_each_row(spark, odd, name):
    found = Counter(r.doc_id for r in registry.QUERIES[name](spark, odd).select("doc_id").collect())
    assert found == Counter(r[0] for r in rows())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    path = f"{sf_dir}/documents.parquet"
    duck.execute(f"create view documents as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    duck.register("ours", registry.QUERIES[name](spark, sf_dir).toArrow())
    duck.execute(f"create table theirs as {registry.SQL[name]}")
    columns = ", ".join(r[0] for r in duck.execute("describe theirs").fetchall())
    for a, b in (("ours", "theirs"), ("theirs", "ours")):
        assert duck.execute(f"select count(*) from (select {columns} from {a} except all select {columns} from {b})").fetchall()[0][0] == 0


def test_token_counts(spark, odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.tokenizer_path(token_counts.MODEL))
    want = Counter((r[0], len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in rows())
    for cache in (0, 1000):
        frame = token_counts.count_tokens(spark.read.parquet(f"{odd}/documents.parquet"), cache_size=cache, table_size=5)
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in frame.collect()) == want


def test_frequent_tokens_come_from_the_whole_table(spark):
    docs = spark.range(4000, numPartitions=4).selectExpr("id as doc_id", "case when id < 2000 then 'alpha beta' else 'gamma delta' end as text")
    found = token_counts.frequent_lengths(docs, token_counts.tokenizer_path(token_counts.MODEL), 500, 10)
    assert set(found) == {"alpha", "beta", "gamma", "delta"}


def test_fingerprints(spark, odd):
    ordered = sorted(((-(10**9) if r[0] is None else r[0], r[1] or "", r[0]) for r in rows()))
    want = Counter()
    for k, (_, text, doc_id) in enumerate(ordered):
        changed = fingerprints.edited(text, ordered[(k + 1) % len(ordered)][1])
        want[(doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest())] += 1
    found = fingerprints.op2_fingerprints(spark, odd).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == want
    by_id = {r.doc_id: r for r in found}
    assert by_id[6].fingerprint == by_id[7].fingerprint != by_id[8].fingerprint
    assert by_id[6].near_next == 1.0 and all(0 <= x <= 1 for r in found for x in (r.near_edited, r.near_next))
    long = by_id[len(rows()) - 4 - 4]
    assert long.n_chars > 10_000 and 0.65 < long.near_edited < 0.85


def test_longest_common_extension():
    random.seed(4)
    for _ in range(60):
        a, b = ("".join(random.choice("ab") for _ in range(random.randint(0, 30))) for _ in range(2))
        x, y = fingerprints.PrefixHash(a), fingerprints.PrefixHash(b)
        i, j = random.randint(0, len(a)), random.randint(0, len(b))
        want = 0
        while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
            want += 1
        assert fingerprints.longest_common_extension(x, i, y, j) == want
    mark = fingerprints.fingerprint("some text of some length, that repeats some of its text " * 9)
    assert str(fingerprints.Fingerprint.parse(str(mark))) == str(mark)


def test_prefix_arrays_of_edited_texts_are_put_together():
    """Those of an edited text come from its two texts', with the window hashes, at every length around the window's."""
    random.seed(14)
    texts = ["".join(random.choices("ab\U0001F600 ", k=n)) for n in (0, 1, 3, 4, 7, 8, 9, 10, 11, 12, 13, 28, 31, 32, 33, 40, 500, 4_000)]
    for own in texts:
        for following in texts:
            x, y = fingerprints.PrefixHash(own), fingerprints.PrefixHash(following)
            want, found = fingerprints.PrefixHash(fingerprints.edited(own, following)), fingerprints.PrefixHash.edited(x, y, [8])
            assert found.n == want.n and all((p == q).all() for p, q in zip(found.prefix, want.prefix))
            assert found.order(8).tolist() == want.order(8).tolist()
            assert str(fingerprints.marked(found)) == str(fingerprints.marked(want))


def test_extensions_of_few_and_of_many_places():
    random.seed(15)
    a, b = ("".join(random.choice("ab") for _ in range(n)) + "c" * 300 for n in (60, 90))
    x, y = fingerprints.PrefixHash(a), fingerprints.PrefixHash(b)
    for count in (1, 5, 24, 25, 400):
        i, j = (np.array([random.randint(0, len(t)) for _ in range(count)]) for t in (a, b))
        back = np.array([random.random() < 0.5 for _ in range(count)])
        want = [len(os.path.commonprefix([a[:p][::-1], b[:q][::-1]] if z else [a[p:], b[q:]])) for p, q, z in zip(i, j, back)]
        assert fingerprints.extensions(x, i, y, j, back).tolist() == want


def test_likeness_at_every_length():
    random.seed(8)
    for n, rate, least in ((2_000, 0.005, 0.9), (10_000, 0.005, 0.9), (120_000, 0.005, 0.9), (120_000, 0.001, 0.97)):
        text = random.choices("abcdefghijklmnopqrstuvwxyz ", k=n)
        near = list(text)
        for k in random.sample(range(n), int(n * rate)):
            near[k] = "#"
        del near[n // 3]
        both = [fingerprints.PrefixHash("".join(t)) for t in (text, near)]
        a, b = (fingerprints.marked(x) for x in both)
        assert least < fingerprints.extended_likeness(both[0], a, both[1], b) <= 1 - rate
        assert 0.6 < fingerprints.likeness(a, b) <= 1 - rate
        other = fingerprints.PrefixHash("".join(random.choices("abcdefghijklmnopqrstuvwxyz ", k=n)))
        assert fingerprints.extended_likeness(both[0], a, other, fingerprints.marked(other)) < 0.01


def test_one_window_for_all_lengths():
    """Near copies on both sides of any length have places in common."""
    random.seed(12)
    for n in (20, 40, 95, 96, 97, 98, 200):
        text = "".join(random.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
        for other in (text[2:], text[:-2], text[: n // 2] + "#" + text[n // 2 :]):
            x, y = fingerprints.PrefixHash(text), fingerprints.PrefixHash(other)
            assert fingerprints.extended_likeness(x, fingerprints.marked(x), y, fingerprints.marked(y)) > 0.85


def test_an_id_of_many_rows_is_split(spark):
    rows = [(None, f"{k:05d} text") for k in range(3000)] + [(k, f"own {k}") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = fingerprints.in_order(docs, 4)
    sizes = [r["count"] for r in placed.where("doc_id is null and not peek").groupBy("bucket").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 500
    ordered = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    want = Counter((i, hashlib.sha256(fingerprints.edited(t, ordered[(k + 1) % len(ordered)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(ordered))
    assert Counter((r.doc_id, r.edited_sha256) for r in fingerprints.fingerprints(docs).select("doc_id", "edited_sha256").collect()) == want


def test_extensions_count_shared_stretches():
    def near(a, b):
        x, y = fingerprints.PrefixHash(a), fingerprints.PrefixHash(b)
        return fingerprints.extended_likeness(x, fingerprints.marked(x), y, fingerprints.marked(y))

    random.seed(9)
    s, t, u = ("".join(random.choices("abcdefghijklmnop", k=3_000)) for _ in range(3))
    assert near(s + t, t + s) > 0.99 and abs(near(s + t, s + u) - 0.5) < 0.01
    assert near("x " * 500, "x " * 400) == 0.8 and near("", s) == 0.0 and near("", "") == near(s, s) == 1.0
    assert abs(near(s * 4, s) - 0.25) < 0.01 and near(s, s * 4) == near(s * 4, s)


def test_license_places(spark, odd):
    lower = str.maketrans(license_scan.UPPER, license_scan.LOWER)
    found = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.op3_license_scan(spark, odd).collect())
    want = Counter()
    for doc_id, text, *_ in rows():
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(lower))
        at = [(i, label) for label, phrase in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        want[(doc_id, len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))] += 1
    assert found == want


def test_license_notice_with_inserted_words(spark):
    words = license_scan.NOTICES["bsd"].split()
    frame = spark.createDataFrame([(1, " ".join(words[:8] + ["quite", "freely"] + words[8:])), (2, " ".join(words[:6]))], "doc_id long, text string")
    labels = {r.doc_id: r.labels for r in license_scan.scan(frame).collect()}
    assert labels == {1: "bsd", 2: ""}


def test_license_counts_each_place_once(spark):
    """A notice's few grams said again and again are no notice: three of seven are found."""
    words = license_scan.NOTICES["gpl-3"].split()
    again = "the gnu general public license general public license general public license"
    frame = spark.createDataFrame([(1, again), (2, " ".join(words))], "doc_id long, text string")
    found = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(frame).collect()}
    assert len(words) == 9 and found[2] == ("gpl-3", 1.0)
    assert found[1][0] == "" and abs(found[1][1] - 3 / 7) < 1e-9


def brute_dedup(docs, size=13):
    tokens = {i: re.findall("[^\x20\x09-\x0d]+", t or "") for i, t in docs}
    first = {}
    for i in sorted(k for k in tokens if k is not None):
        for p in range(len(tokens[i]) - size + 1):
            first.setdefault(tuple(tokens[i][p : p + size]), i)
    out = {}
    for i, w in tokens.items():
        gone = set()
        if i is not None:
            for p in range(len(w) - size + 1):
                if first[tuple(w[p : p + size])] < i:
                    gone |= set(range(p, p + size))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup(spark, odd):
    own = [(r[0], r[1]) for r in rows() if r[0] is not None]
    want = brute_dedup(own)
    found = substring_dedup.op4_substring_dedup(spark, odd).where("doc_id is not null").collect()
    assert all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in found)
    assert sum(r.n_removed for r in found) > 1000
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    kept = substring_dedup.remove_repeats(docs, size=5, shard_bytes=500, batch_bytes=700)
    assert kept.columns == [*docs.columns, "_n_words", "_n_removed"]
    want = brute_dedup(own, 5)
    assert all((r._n_words, r._n_removed) == want[r.doc_id][:2] for r in kept.where("doc_id is not null").collect())


def test_substring_dedup_long_shard(monkeypatch):
    """A shard beyond the bound, as a frequent pair of words makes it, is searched in parts and gives the same words."""
    random.seed(21)
    vocabulary = [f"w{k}" for k in range(60)]
    shared = [" ".join(random.choices(vocabulary, k=16)) for _ in range(30)]
    docs = [(i, " ".join(f"{random.choice(shared)} of the {' '.join(random.choices(vocabulary, k=9))}" for _ in range(12))) for i in range(150)]
    docs += [(200, "of the " * 300), (201, "of the " * 20), (150, docs[3][1])]
    box = substring_dedup.Outbox(1)
    blobs = []
    for k in range(0, len(docs), 20):
        some = docs[k : k + 20]
        box.add(Words(pa.array([t for _, t in some])), np.array([i for i, _ in some]), np.zeros(len(some), np.int64), 13)
        blobs += box.send()
    told = [substring_dedup._tell(b) for shard, b in blobs if shard < 0]
    blobs = [b for shard, b in blobs if shard == 0]
    sizes, search = [], substring_dedup.shard_intervals

    def watched(blobs, size):
        sizes.append(sum(len(substring_dedup._open(b)[5]) for b in blobs))
        return search(blobs, size)

    monkeypatch.setattr(substring_dedup, "shard_intervals", watched)
    found = told + list(substring_dedup.bounded_intervals(blobs, 13, 30_000))
    assert len(sizes) > 10 and max(sizes) <= 30_000 < sum(sizes)
    gone = defaultdict(set)
    for part in found:
        for doc, low, high in zip(part["doc_id"].tolist(), part["low"].tolist(), part["high"].tolist()):
            gone[doc] |= set(range(low, high))
    want = brute_dedup(docs)
    assert {i: len(gone[i]) for i, _ in docs} == {i: want[i][1] for i, _ in docs}


def test_substring_dedup_small_bound(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    want = brute_dedup([(r[0], r[1]) for r in rows() if r[0] is not None], 5)
    kept = substring_dedup.remove_repeats(docs, size=5, shard_bytes=5000, batch_bytes=700, most_bytes=600)
    assert all((r._n_words, r._n_removed) == want[r.doc_id][:2] for r in kept.where("doc_id is not null").collect())


def test_substring_dedup_streams_long_shard():
    """The stretches of a shard beyond the bound are not in memory together."""

    class Counted(bytes):
        alive = most = 0

        def __new__(cls, raw):
            cls.alive += 1
            cls.most = max(cls.most, cls.alive)
            return super().__new__(cls, raw)

        def __del__(self):
            Counted.alive -= 1

    random.seed(22)
    box, blobs = substring_dedup.Outbox(1), []
    docs = [(i, " ".join(random.choices("abcdefgh", k=60)) + (" x" * 14 if i % 9 == 0 else "")) for i in range(120)]
    for i, text in docs:
        box.add(Words(pa.array([text])), np.array([i]), np.zeros(1, np.int64), 13)
        blobs += box.send()
    found = list(substring_dedup.bounded_intervals((Counted(b) for _, b in blobs), 13, 2_000))
    assert len(blobs) == 120 and Counted.most < 40
    want = brute_dedup(docs)
    gone = Counter()
    for part in found:
        for doc, low, high in zip(*(part[c].tolist() for c in ("doc_id", "low", "high"))):
            gone.update((doc, p) for p in range(low, high))
    assert Counter(doc for doc, _ in gone) == Counter({i: want[i][1] for i, _ in docs if want[i][1]})


def test_group_batches_are_bounded(spark, odd):
    """A group of long rows goes to Python in batches of a few MB."""
    documents(spark, odd)
    rows = spark.range(30).selectExpr("id % 1 as shard", "cast(repeat('x', 1000000) as binary) as blob")

    def sizes(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    found = [r[0] for r in rows.groupBy("shard").applyInArrow(sizes, "bytes long").collect()]
    assert sum(found) > 30_000_000 and max(found) < 12_000_000


def test_fm_index():
    random.seed(6)
    symbols = np.array([random.randint(1, 5) if random.random() < 0.95 else 0 for _ in range(400)])
    index = fm_index.FMIndex(symbols, depth=8)
    query = np.array([random.randint(0, 6) for _ in range(300)])
    ends = np.arange(1, 301)
    length, low, high = index.matches(query, ends, 8)
    text = symbols.tolist()
    places = lambda p: [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p]
    for end, n, a, b in zip(ends, length, low, high):
        want = 0
        while want < min(8, end) and 0 not in query[end - want - 1 : end] and places(query[end - want - 1 : end].tolist()):
            want += 1
        assert n == want
        if n:
            assert sorted(index.suffixes[a:b].tolist()) == places(query[end - n : end].tolist())


def test_words():
    texts = ["", " a\tb\x0bc ", "x", None, "é漢\n😀", "A a"]
    words = Words(pa.array(texts), lower=True)
    assert words.counts.tolist() == [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for t in texts]
    assert words.hashes[-1] == words.hashes[-2] and len(set(words.hashes[:-1].tolist())) == len(words.hashes) - 2


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(token_counts.tokenizer_path(packing.VOCABULARY))
    found = packing.op6_packing(spark, odd).collect()
    assert len({r.sequence_id for r in found}) == len(found)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 for r in found)
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found)
    want = Counter()
    for doc_id, text, *_ in rows():
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        start = 0
        for size in packing.binary_lengths(len(ids)):
            want[(doc_id, start, size, zlib.crc32(ids[start : start + size].tobytes()), len(ids))] += 1
            start += size
        assert start == len(ids)
    assert pieces == want


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans(license_scan.UPPER, license_scan.LOWER)))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_components(docs):
    sets = {i: shingles(t) for i, t in docs if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("rare", [0, 2, 8])
def test_ngram_join(spark, odd, rare):
    want = brute_components([(r[0], r[1]) for r in rows()])
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(docs, shard_bytes=2000, rare=rare).collect() if r.doc_id is not None}
    assert found == want


@pytest.mark.parametrize("options", [{}, {"rounds": 1, "small": 1, "filter_bits": 0}])
def test_ngram_join_on_many_near_copies(spark, options):
    """With few rounds and small blocks, links are found by longer combinations and by tiles."""
    random.seed(9)
    docs, word = [], lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    for g in range(6):
        base = [word() for _ in range(random.choice([8, 40, 160]))]
        for _ in range(14):
            words = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 18))):
                words[random.randrange(len(words))] = word()
            docs.append((len(docs), " ".join(words)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_components(spark.createDataFrame(docs, "doc_id long, text string"), rare=3, **options).collect()}
    assert found == brute_components(docs)


def test_components(spark):
    random.seed(8)
    links = [(random.randint(0, 60), random.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {i: root(i) for i in parent if root(i) != i}
    found = components.connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == want


def test_quality_counts(spark, odd):
    found = Counter(tuple(r) for r in quality_rules.apply_rules(spark.read.parquet(f"{odd}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for doc_id, text, *_ in rows():
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = {g for g, n in Counter(grams).items() if n > 1}
        covered = {p for i, g in enumerate(grams) if g in often for p in (i, i + 1, i + 2)}
        lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        n = (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        want[(doc_id, *n, n[0] < 50 or 100 * n[4] > 50 * n[0])] += 1
    assert found == want


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 300) == [187.5, 75.0, 37.5]
    capped = mixing.targets([10, 100, 400], [5, 2, 1], 510)
    assert capped[0] == 30 and capped[1] == 300 and abs(sum(capped) - 510) < 1e-9
    assert mixing.targets([0, 0], [5, 2], 0) == [0.0, 0.0]
    expected = mixing.expectations({3: 100, 9: 300}, 700.0)
    assert abs(100 * expected[3] + 300 * expected[9] - 700) < 1e-9 and expected[9] > expected[3]


def test_mixing(spark, odd, sf_dir):
    for place in (odd, sf_dir.replace("sf0.001", "sf0.01")):
        found = mixing.op9_mixing(spark, place).collect()
        again = mixing.op9_mixing(spark, place).collect()
        assert Counter(map(tuple, found)) == Counter(map(tuple, again))
        assert all(r.taken <= 3 * r["size"] for r in found)
    sources = defaultdict(list)
    ids = {r.doc_id: r.source for r in spark.read.parquet(f"{place}/documents.parquet").select("doc_id", "source").collect()}
    for r in found:
        sources[ids[r.doc_id]].append(r)
    for own in sources.values():
        largest = max(r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= largest / 2 + 1
        assert own[0].source_size == sum(r["size"] for r in own)


def test_mixing_without_ids(spark):
    """Rows without an id are drawn one by one, also where their texts are equal."""
    rows = [(None, "w " * (50 + k % 3), "a" if k < 1000 else "b") for k in range(2000)] + [(None, None, "a"), (None, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("w"))).alias("n")).collect()}
    sizes = [sum(len((t or "").split()) for _, t, x in rows if x == n) for n in "ab"]
    for name, target in zip("ab", mixing.targets(sizes, [5, 2], sum(sizes))):
        assert abs(taken[name] - target) <= 60, (taken, target)


def test_mixing_of_more_sources_than_the_driver_takes(spark, odd):
    for docs in (spark.read.parquet(f"{odd}/documents.parquet"), spark.range(900).selectExpr("id as doc_id", "repeat('w ', cast(id % 60 + 1 as int)) as text", "concat('s', id % 70) as source")):
        drawn = mixing.sized(docs).drop("row").orderBy("doc_id").coalesce(1).checkpoint()
        found = []
        for bound in (100, 0):
            plan, cut = mixing.plan_mix(drawn, max_sources=bound)
            found.append(sorted((repr((r.doc_id, r["_size"], r["_tie"], r["_copies"], round(r["_target"], 6))) for r in mixing.copies(drawn, plan, cut).collect())))
        assert found[0] == found[1]


def test_mixing_equals_a_sorted_sample(spark, odd):
    """The plan and the cut against expectations and an order that are worked out for all rows at once."""
    for docs in (spark.read.parquet(f"{odd}/documents.parquet"), spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + pow(id % 97, 2) as int)) as text", "concat('s', id % 5) as source")):
        drawn = mixing.sized(docs)
        plan, cut = mixing.plan_mix(drawn)
        found = mixing.copies(drawn, plan, cut).select("source", "_size", "_bits", "_u", "_tie", "_copies").collect()
        names = sorted({r.source for r in found} - {None}) + [None] * any(r.source is None for r in found)
        sizes = [sum(r["_size"] for r in found if r.source == n) for n in names]
        for name, target in zip(names, mixing.targets(sizes, [mixing.WEIGHTS[k % 3] for k in range(len(names))], sum(sizes))):
            own = [r for r in found if r.source == name]
            words = Counter()
            for r in own:
                words[r["_bits"]] += r["_size"]
            expected = mixing.expectations(dict(words), target)
            certain = {b: int(e + 1e-9) for b, e in expected.items()}
            ranked = []
            for r in own:
                part = min(max(expected[r["_bits"]] - certain[r["_bits"]], 0.0), 1 - 1e-12)
                if part > 0:
                    odds = (r["_u"] / (1 - r["_u"])) / (part / (1 - part))
                    ranked.append((int(odds / (1 + odds) * 2**40) * 4096 + r["_tie"], r["_size"], r["_copies"] - certain[r["_bits"]]))
                else:
                    assert r["_copies"] == certain[r["_bits"]]
            ranked.sort()
            need = target - sum(certain[r["_bits"]] * r["_size"] for r in own)
            upto, taken = 0, set()
            for rank, size, _ in ranked:
                if upto >= need or abs(upto + size - need) > abs(upto - need):
                    break
                upto += size
                taken.add(rank)
            assert sum(size for _, size, extra in ranked if extra) == upto
            assert all(extra == (rank in taken) for rank, size, extra in ranked if size)


def test_pareto_order_takes_unequal_shares(spark):
    frame = spark.range(40_000).selectExpr("id as doc_id", "repeat('w ', cast(1 + (id % 2) * 255 as int)) as text", "case when id % 4 < 2 then 'a' else 'b' end as source")
    taken = mixing.mix(frame).groupBy("source", F.length("text").alias("n")).count().collect()
    share = {(r.source, r.n): r["count"] / 10_000 for r in taken}
    short, long = share[("b", 2)], share[("b", 512)]
    want = mixing.preference(1) / mixing.preference(9)
    assert 0 < short < long < 1 and abs(short / long - want) < 0.05


def test_quality_classifier_held_out(spark, sf_dir):
    place = sf_dir.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{place}/labels.parquet").collect()}
    held = [(truth[r.doc_id], r.predicted) for r in quality_classifier.op5_quality_classifier(spark, place).collect() if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.93


def test_quality_scores_by_hand(spark, sf_dir):
    """Statistics by words and characters in Python, and the densities from inverse covariances and determinants."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labelled = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}

    def numbers(text):
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        raw = [w.encode() for w in words]
        lower = [bytes(c + 32 if 65 <= c < 91 else c for c in w) for w in raw]
        n, letters = len(words), b"".join(raw)
        m, size = max(n, 1), max(len(letters), 1)
        lengths = [len(w) for w in raw]
        mean = sum(lengths) / m
        spread = math.sqrt(max(sum(x * x for x in lengths) / m - mean**2, 0))
        count = lambda some: sum(c in some for c in letters)
        grams = {tuple(lower[i : i + 3]) for i in range(n - 2)}
        gaps = re.split("[^\x20\x09-\x0d]+", text or "")[1:]
        return [
            math.log1p(n), math.log(mean + 1), math.log1p(spread), math.log1p(50 * count(b"#*$%&|<>{}[]=_^~@\\") / m), math.log1p(20 * count(b".,;:!?") / m), math.log1p(20 * count(b"0123456789") / size),
            math.sqrt(count(bytes(range(65, 91))) / size), sum(x <= 3 for x in lengths) / m, math.log1p(len(set(lower))) - math.log1p(n), math.sqrt(sum(a == b for a, b in zip(lower, lower[1:])) / m),
            math.sqrt(max(1 - (len(grams) + 1) / (max(n - 2, 0) + 1), 0)), math.log1p(20 * sum("\n" in g for g in gaps) / m), math.log1p(10 * sum(w[-1] in b".,;:!?" for w in raw) / m),
        ]

    rows = {r.doc_id: np.array(numbers(r.text)) for r in docs.collect()}
    table = quality_classifier.statistics_table(docs)
    for r in table.collect():
        assert np.allclose(r.x, rows[r.doc_id], atol=1e-9), (r.doc_id, r.x, rows[r.doc_id])
    train = {i: y for i, y in labelled.items() if zlib.crc32(str(i).encode()) % 4 != 2 and i in rows and y in (0, 1)}
    classes = [np.array([np.rint(rows[i] * quality_classifier.STEPS) / quality_classifier.STEPS for i, y in train.items() if y == c]) for c in (0, 1)]
    own = [np.cov(x.T, bias=True) for x in classes]
    pooled = sum(len(x) * c for x, c in zip(classes, own)) / len(train)
    mixed = [quality_classifier.shrink(c, len(x), pooled) for x, c in zip(classes, own)]

    def density(x, c):
        away = x - classes[c].mean(axis=0)
        return math.log((len(classes[c]) + 1) / (len(train) + 2)) - 0.5 * np.linalg.slogdet(mixed[c])[1] - 0.5 * away @ np.linalg.inv(mixed[c]) @ away

    for r in quality_classifier.op5_quality_classifier(spark, sf_dir).collect():
        want = 1 / (1 + math.exp(min(max(density(rows[r.doc_id], 0) - density(rows[r.doc_id], 1), -500), 500)))
        assert abs(r.score - want) < 1e-6 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_labels_that_contradict_each_other(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string")
    rows = [(i, i % 2, i % 2) for i in range(20)]
    once, twice = (spark.createDataFrame(r, "doc_id long, quality int, toxic int") for r in (rows, [*rows, *rows, *((i, k, k) for i in range(20, 40) for k in (0, 1))]))
    a, b = (quality_classifier.classify(docs, x).orderBy("doc_id").collect() for x in (once, twice))
    assert a == b
    assert (toxicity.fit(docs, once).tables == toxicity.fit(docs, twice).tables).all()


def test_subsequence_kernel_by_hand():
    """Common subsequences of three symbols within a span of five, over both words with their edge marks."""
    random.seed(5)

    def weights(word):
        x, out = (0, *word, 0), Counter()
        for a in range(len(x)):
            for b in range(a + 1, len(x)):
                for c in range(b + 1, min(a + toxicity.SPAN, len(x))):
                    out[x[a], x[b], x[c]] += toxicity.DECAY ** (c - a + 1)
        return out

    words = [bytes(random.choices([1, 2, 3, 4, 5], k=random.randint(1, 9))) for _ in range(30)]
    norm = lambda w: math.sqrt(max(sum(max(len(w) + 2 - j, 0) * toxicity.DECAY ** (2 * (j + 1)) for _, j in toxicity.PATTERNS), 1e-9))
    found = toxicity.kernel(words, words[:6])
    for i, w in enumerate(words):
        for j, mark in enumerate(words[:6]):
            a, b = weights(w), weights(mark)
            # a pair of places with one span each: the landmark's weight meets that of the word's own occurrence
            assert abs(found[i, j] - sum(v * b[k] for k, v in a.items()) / norm(w) / norm(mark)) < 1e-4


def test_toxicity_held_out(spark, sf_dir):
    place = sf_dir.replace("sf0.001", "sf0.1")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{place}/labels.parquet").collect()}
    held = [(truth[r.doc_id], r.predicted) for r in toxicity.op10_toxicity(spark, place).collect() if r.held_out and r.doc_id in truth]
    toxic = [p for t, p in held if t == 1]
    assert np.mean([a == b for a, b in held]) > 0.95 and np.mean(toxic) > 0.8


def test_toxicity_tolerates_gaps():
    random.seed(2)
    word = lambda: "".join(random.choice("etaoinsr") for _ in range(random.randint(2, 8)))
    bad = ["muppetz", "clodpoll", "fopdoodle"]
    clean = [" ".join(word() for _ in range(80)) for _ in range(150)]
    toxic = [" ".join([*(word() for _ in range(40)), random.choice(bad), *(word() for _ in range(40)), random.choice(bad)]) for _ in range(80)]
    model = toxicity.fit_texts(toxic, clean)
    plain = " ".join(word() for _ in range(40))
    texts = [plain, f"{plain} muppetz clodpoll", f"{plain} m.u.p.p.e.t.z c-l-o-d-p-o-l-l", f"{plain} m u p p e t z clodpoll", f"{plain} muppxetz clodzpoll"]
    assert (model.score(pa.array(texts)) >= 0.5).tolist() == [False, True, True, True, True]


def test_toxicity_counts_all_words_of_long_texts():
    random.seed(2)
    word = lambda: "".join(random.choice("etaoinsr") for _ in range(random.randint(2, 8)))
    bad = ["muppetz", "clodpoll", "fopdoodle"]
    clean = [" ".join(word() for _ in range(n)) for n in [80] * 130 + [2000] * 20]
    toxic = [" ".join([*(word() for _ in range(40)), random.choice(bad), *(word() for _ in range(40)), random.choice(bad)]) for _ in range(80)]
    model = toxicity.fit_texts(toxic, clean)
    short = " ".join([*(word() for _ in range(40)), *bad])
    many = [random.choice(bad) for _ in range(60)] + [word() for _ in range(4000)]
    random.shuffle(many)
    few, dozens, none = model.score(pa.array([short, " ".join(many), " ".join(word() for _ in range(4000))]))
    assert none < 0.1 and 0.9 < few < dozens


def brute_kept(docs, size=13):
    """Texts without repeated passages; a text that loses nothing stays as it is."""
    counts = brute_dedup(docs, size)
    first, out = {}, {}
    tokens = {i: re.findall("[^\x20\x09-\x0d]+", t or "") for i, t in docs}
    for i in sorted(tokens):
        for p in range(len(tokens[i]) - size + 1):
            first.setdefault(tuple(tokens[i][p : p + size]), i)
    for i, text in docs:
        gone = {q for p in range(len(tokens[i]) - size + 1) if first[tuple(tokens[i][p : p + size])] < i for q in range(p, p + size)}
        assert counts[i][1] == len(gone)
        out[i] = " ".join(w for p, w in enumerate(tokens[i]) if p not in gone) if gone else text or ""
    return out


def test_pipeline_stage_by_stage(spark, sf_dir):
    """Each stage on what the one before kept, against brute force; the mix by its rules, packing by the tokenizer."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near duplicates", "substring dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns

    def step(name, frame):
        out = corpus_pipeline.materialize(stages[name](spark, frame, sf_dir))
        if name != "packing":
            assert out.columns == columns
        return out

    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    clean = {i for i, t in texts.items() if model.score(pa.array([t], pa.string()))[0] < 0.5}
    kept = step("toxicity", docs)
    assert {r.doc_id for r in kept.collect()} == clean and len(clean) > 0.8 * len(texts)

    unique = step("near duplicates", kept)
    rows_in = [(r.doc_id, r.text) for r in kept.collect()]
    found = {r.doc_id: r.text for r in unique.collect()}
    assert set(found) == {i for i, (_, c) in brute_components(rows_in).items() if c == i}

    cut = step("substring dedup", unique)
    want = brute_kept(list(found.items()))
    got = {r.doc_id: (r.text or "", r.n_chars) for r in cut.collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}

    mixed = step("mixing", cut)
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    before = {r.doc_id: r for r in cut.collect()}
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 3 and all(tuple(before[r.doc_id]) == tuple(r) for r in mixed.collect())
    names = sorted({r.source for r in before.values()})
    sums = [sum(size(r.text) for r in before.values() if r.source == n) for n in names]
    goal = mixing.targets(sums, [mixing.WEIGHTS[k % 3] for k in range(len(names))], sum(sums))
    for name, target in zip(names, goal):
        own = [r for r in before.values() if r.source == name]
        taken = sum(copies[r.doc_id] * size(r.text) for r in own)
        assert abs(taken - target) <= max(size(r.text) for r in own) / 2 + 1

    exact = Tokenizer.from_file(token_counts.tokenizer_path(packing.VOCABULARY))
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in step("packing", mixed).collect())
    want = Counter()
    for r in mixed.collect():
        ids, start = np.array([*exact.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for n in packing.binary_lengths(len(ids)):
            want[(r.doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()))] += 1
            start += n
    assert pieces == want


def test_pipeline(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, odd))
        if name != "packing":
            assert set(docs.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}
    assert docs.count() > 0


NAMES = ["_size", "_bits", "_u", "_tie", "_rank", "_copy", "_copies", "_target", "_source_size", "_tag", "_spans", "_score", "_predicted", "_id", "_n_words", "row", "id", "stay", "spans", "tag", "col", "key", "component_id"]


def test_pipeline_passes_columns_of_any_name(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd}/documents.parquet").withColumns({n: F.lit(k + 77) for k, n in enumerate(NAMES)})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, odd))
        assert docs.columns == columns, name
        assert [tuple(r) for r in docs.select(*(f"`{n}`" for n in NAMES)).distinct().collect()] == [tuple(range(77, 77 + len(NAMES)))], name
    assert docs.count() > 0


def test_pipeline_of_no_rows(spark, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from tessera.llm.common import scratch_dir

    def session(master, settings):
        conf = SimpleNamespace(get=lambda k, d=None: settings.get(k, d))
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    assert scratch_dir(session("spark://host", {"spark.checkpoint.dir": "hdfs:///x/"})).startswith("hdfs:///x/tessera-")
    assert scratch_dir(session("local[4]", {}))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            scratch_dir(session(master, {}))
