"""Every query with SQL against DuckDB, and the folds and state machines against plain Python."""

import functools
import math
import os
import random
import re
import shutil
import subprocess
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.image_exprs import glob_to_regex, halvings, natural_key, normalize_path
from tessera.operators import catalog, layouts, matrices, ordering, raster, spatial
from tessera.plans.dialect import TABLES, fixture, render
from tessera.plans.registry import QUERIES, SQL
from tessera.streaming import requests


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for file in os.listdir(sf_dir):
        path = f"{sf_dir}/{file}"
        connection.execute(f"create view {file.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    frame = QUERIES[name](spark, sf_dir)
    ours = frame.toArrow()
    duck.register("ours", ours)
    duck.execute(f"create or replace table theirs as {SQL[name]}")
    names = ", ".join(f'"{c}"' for c in sorted(frame.columns))
    assert sorted(frame.columns) == sorted(r[0] for r in duck.execute("describe theirs").fetchall())
    for a, b in (("ours", "theirs"), ("theirs", "ours")):
        assert duck.execute(f"select count(*) from (select {names} from {a} except all select {names} from {b})").fetchall()[0][0] == 0
    types = [dict((r[0], r[1]) for r in duck.execute(f"describe {t}").fetchall()) for t in ("ours", "theirs")]
    assert types[0] == types[1]


def test_transform_all_takes_every_surface(spark, sf_dir, duck):
    pixels = fixture(spark, sf_dir, "img_pixels").collect()
    turns = {"Rot0": lambda x, y: (x, y), "Rot90": lambda x, y: (7 - y, x), "Rot180": lambda x, y: (7 - x, 7 - y), "Rot270": lambda x, y: (y, 7 - x)}
    want = Counter((p.img, name, *turn(p.x, p.y), p.g) for p in pixels for name, turn in turns.items())
    want += Counter((p.img, f"{name}Flip", x, 7 - y, p.g) for p in pixels for name, turn in turns.items() for x, y in [turn(p.x, p.y)])
    found = Counter((r.img, r.name, r.x, r.y, r.g) for r in QUERIES["transform_all"](spark, sf_dir).select("img", "name", "x", "y", "g").collect())
    assert found == want


def test_nearest_patch_of_every_patch(spark, sf_dir, duck):
    patches = raster.run(spark, sf_dir, f"{raster._PATCHES} select * from p").localCheckpoint()
    rows = patches.collect()
    want = {q.img: min((sum((x - y) ** 2 for x, y in zip(q[1:], t[1:])), -t.img) for t in rows) for q in rows}
    found = QUERIES["nearest_patch"](spark, sf_dir).collect()
    assert len(found) == len(rows) and {r.query: (r.dist, -r.tile) for r in found} == want


def test_grid_lines_of_every_customer(spark, sf_dir, duck):
    ids = [r[0] for r in duck.execute("select c_custkey from customer").fetchall()]
    want = Counter((c, i, at) for c in ids for i, at in enumerate(range(c * 37 % 400 % 64, 800, 64)))
    found = Counter((r.c_custkey, r.i, r.at) for r in QUERIES["grid_lines"](spark, sf_dir).collect())
    assert max(ids) >= 50 and found == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_text_operators(tmp_path):
    """The tree without both folders, with and without the pipeline's file, still gives the other queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ignore = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(root, tmp_path / "tree", ignore=ignore)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith(('op', 'pipeline')) for n in e.queries()))"
    for name in ("corpus_pipeline.py", None):
        found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "tree", env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, check=True)
        assert found.stdout.split() == [str(len(QUERIES)), str(len(SQL)), "False"]
        if name and (tmp_path / "tree" / name).exists():
            (tmp_path / "tree" / name).unlink()


def natural_less(a, b):
    """The natural comparison by hand: runs of digits compare by length, then as text."""
    split = lambda s: re.findall(r"[0-9]+|[^0-9]+", s)
    for x, y in zip(split(a), split(b)):
        if x[0].isdigit() and y[0].isdigit():
            if (len(x), x) != (len(y), y):
                return -1 if (len(x), x) < (len(y), y) else 1
        elif x != y:
            return -1 if x < y else 1
    return (len(split(a)) > len(split(b))) - (len(split(a)) < len(split(b)))


def test_natural_order(spark):
    random.seed(3)
    texts = sorted({"".join(random.choice("ab19_") for _ in range(random.randint(1, 7))) for _ in range(300)})
    rows = spark.createDataFrame([(t,) for t in texts], "t string").orderBy(natural_key(F.col("t")), "t").collect()
    assert [r.t for r in rows] == sorted(texts, key=functools.cmp_to_key(natural_less))


def test_urls(spark):
    from tessera.functions import urls

    cases = {
        "file:///a/b.png": ("file", "/a/b.png", None, None),
        "file:///a/b.zip//zip:c/d.png": ("file", "/a/b.zip", "zip", "c/d.png"),
        "file:///a/b.rar//rar": ("file", "/a/b.rar", "rar", None),
        "http://host.x/p?q=1": ("http", "host.x/p?q=1", None, None),
        "file://Some Folder/bla/boing": ("file", "Some Folder/bla/boing", None, None),
    }
    frame = spark.createDataFrame([(k,) for k in cases], "url string").withColumn("p", urls.parse_url(F.col("url")))
    for r in frame.select("url", "p", urls.format_url(F.col("p")).alias("again"), urls.has_stdio_name(F.col("p")).alias("plain")).collect():
        assert tuple(r.p) == cases[r.url] and r.again == r.url and r.plain == (r.p.protocol == "file" and r.p.plugin is None)


def test_listings_of_archives(spark):
    from tessera.functions.queries import seven_zip_members, zip_members

    seven = "7-Zip\nPath = whole.7z\n----------\nPath = a b.png\nSize = 1\nPath = d/c.jpg\n"
    plain = "   115  2010-05-01 11:44   a b.png\n     9  2010-05-01 11:45   d/c.jpg\n"
    row = spark.createDataFrame([(seven, plain)], "s string, z string").select(seven_zip_members(F.col("s")).alias("s"), zip_members(F.col("z")).alias("z")).first()
    assert row.s == row.z == ["a b.png", "d/c.jpg"]


def test_paths(spark):
    cases = {"/a/./b//c/../d/": "/a/b/d", "/": "/", "/../x": "/x", "/a/b/../../c": "/c"}
    frame = spark.createDataFrame(list(cases.items()), "p string, want string")
    assert frame.where(normalize_path(F.col("p")) != F.col("want")).count() == 0


@pytest.mark.parametrize("pattern, good, bad", [("*.jpg", "a/b.jpg", "a.JPG"), ("a?c", "abc", "ac"), ("[^ab]x", "cx", "ax"), ("[a-c]*", "b/x", "d"), ("a.b", "a.b", "axb")])
def test_glob(pattern, good, bad):
    assert re.match(glob_to_regex(pattern), good) and not re.match(glob_to_regex(pattern), bad)


def test_thumbnail_scale(spark):
    def by_hand(n):
        k = 0
        while n > 8:
            n, k = n // 2, k + 1
        return k

    rows = spark.range(0, 70_000, 7).selectExpr("id", render(f"{halvings('id')}", "spark") + " as k").collect()
    assert all(r.k == by_hand(r.id) for r in rows)


def images(spark, n, seed=1):
    random.seed(seed)
    rows = [(k * 3 + 1, random.randint(1, 3000), random.randint(1, 3000)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "fileid long, width int, height int")


def test_spiral_is_a_walk(spark):
    """No place twice, ring after ring, and each place beside the one before."""
    rows, frame = images(spark, 300)
    found = {r.fileid: (int(r.x // 1024), int(r.y // 1024)) for r in layouts.spiral(frame).collect()}
    order = [found[r[0]] for r in rows]
    assert len(set(order)) == len(order) and order[0] == (1, 0)
    # ring g has 8 g + 4 cells, all at a distance of g or g + 1
    for g in range(1, 7):
        ring = order[4 * g * g + 1 : 4 * (g + 1) ** 2 + 1]
        assert all(max(abs(a), abs(b)) in (g, g + 1) for a, b in ring)
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(order[1:], order[2:]))


def plain_tight(rows, aspect=4 / 3):
    """The fold by hand, in plain numbers."""
    total = sum(round(w * 1024 / h, 6) for _, w, h in rows)
    border = math.sqrt(total * aspect * 1024)
    x = y = last = 0.0
    right, out = True, {}
    for fileid, w, h in rows:
        wide = w * 1000 / h
        if right:
            if x + wide > border:
                x, y, right = last, y + 1024, False
                place, last = (x, y), x
            else:
                place, last = (x, y), x
                x += wide + 24
        elif x - wide < 0:
            y, right = y + 1024, True
            place, last = (x, y), x
            x += wide + 24
        else:
            x -= wide + 24
            place, last = (x, y), x
        out[fileid] = (place[0] + wide / 2, place[1] + 500, 1000 / h)
    return out


def test_tight_layout(spark):
    rows, frame = images(spark, 400, 7)
    want = plain_tight(rows)
    found = {r.fileid: (r.x, r.y, r.scale) for r in layouts.tight(frame).collect()}
    assert found.keys() == want.keys() and len({p[1] for p in found.values()}) > 5
    assert all(abs(a - b) < 1e-3 for k in want for a, b in zip(found[k], want[k]))


@pytest.mark.parametrize("name", sorted(layouts.LAYOUTS))
def test_layouts_of_no_and_one_image(spark, name):
    for n in (0, 1):
        assert layouts.LAYOUTS[name](images(spark, n)[1]).count() == n


def test_running_sums(spark):
    random.seed(2)
    rows = [(f"k{random.random()}", random.randint(0, 9)) for _ in range(2000)]
    frame = spark.createDataFrame(rows, "k string, v int").repartition(7)
    found = {r.k: (r.n, r.s) for r in ordering.running(frame, "k", {"n": F.lit(1), "s": F.col("v")}, ranges=9).collect()}
    total, want = 0, {}
    for i, (k, v) in enumerate(sorted(rows)):
        total += v
        want[k] = (i + 1, total)
    assert found == want
    assert ordering.numbered(frame.where("false"), "k", "n").count() == 0


def test_matrices(spark):
    random.seed(3)
    for n in (2, 3, 4):
        rows = [(k, [random.uniform(-2, 2) + 3 * (i % (n + 1) == 0) for i in range(n * n)]) for k in range(20)] + [(99, [1.0] * n * n)]
        for r in matrices.with_inverses(spark.createDataFrame(rows, "k long, m array<double>"), "m", n).collect():
            m = np.array(r.m).reshape(n, n)
            assert abs(r.det - np.linalg.det(m)) < 1e-6 and (np.array(r.transposed).reshape(n, n) == m.T).all()
            assert r.inverse is None if r.k == 99 else np.allclose(np.array(r.inverse).reshape(n, n) @ m, np.eye(n))


def test_cache_state_machine(spark):
    """The closed form against the cache's own steps, one event after the other."""
    random.seed(4)
    rows = [(i, 1, random.randint(0, 3), random.randint(0, 2), 0, random.choice(["request", "arrive", "abort", "request", "abort"])) for i in range(60)]
    cache = {}
    for _, f, s, x, y, kind in rows:
        key = (f, s, x, y)
        if kind == "request":
            cache.setdefault(key, "REQUESTED")
        elif kind == "arrive":
            cache[key] = "SUCCEEDED"
        elif cache.get(key) == "REQUESTED":
            del cache[key]
    events = spark.createDataFrame(rows, "req_id long, fileid long, scale int, x int, y int, kind string")
    found = requests.cached_tiles(events)
    assert {(r.fileid, r.scale, r.x, r.y): r.status for r in found.collect()} == cache
    kept = {(r.fileid, r.scale, r.x, r.y) for r in requests.after_cleanup(found, 2).collect()}
    assert kept == {k for k, v in cache.items() if v == "SUCCEEDED" and k[1] >= 2}
    gone = {(r.fileid, r.scale, r.x, r.y) for r in requests.with_cancelled(found, 1, 0, 0, 2, 1).where("cancelled").collect()}
    assert gone == {k for k, v in cache.items() if v == "REQUESTED" and not (k[1] == 1 and k[2] in (0, 1) and k[3] == 0)}


def test_on_demand_ranges(spark):
    files = [(1, True, 6), (2, False, 6), (3, True, 5), (4, True, 7), (5, True, 4)]
    stored = [(1, 4, 6), (3, 0, 5), (4, 3, 5), (5, 2, 4)]
    asked = [(1, 2), (1, 3), (2, 5), (3, 6), (4, 6), (4, 1), (5, 3)]
    frames = (spark.createDataFrame(files, "fileid long, jpeg boolean, ts int"), spark.createDataFrame(stored, "fileid long, lo int, hi int"), spark.createDataFrame(asked, "fileid long, scale int"))
    found = {r.fileid: (r.min_scale, r.max_scale) for r in raster.on_demand_ranges(*frames).collect()}
    assert found == {1: (2, 3), 2: (0, 6), 3: (0, 5), 4: (1, 2)}


def test_ancestors_up_to_the_top(spark):
    """Nine levels up, which is within ten levels and not within nine."""
    missing = spark.createDataFrame([(1, 0, 700, 300, 10), (2, 0, 700, 300, 9)], "fileid long, scale int, x int, y int, top int")
    tiles = spark.createDataFrame([(5, 1, 9, 1, 0), (6, 2, 9, 1, 0)], "rowid long, fileid long, scale int, x int, y int")
    assert [tuple(r) for r in spatial.fallback_parents(missing, tiles).collect()] == [(1, 0, 700, 300, 9, 5, 700 % 512, 300)]


def test_single_tile_of_small_images(spark):
    row = lambda i, w, h, scale: (i, w, h, 0.0, 0.0, w * scale, h * scale, scale, 9)
    frame = spark.createDataFrame([row(1, 1000, 800, 1.0), row(2, 2000, 100, 1.0), row(3, 100, 100, 0.1)], "fileid long, width int, height int, l double, t double, r double, b double, image_scale double, top int")
    found = Counter(tuple(r) for r in spatial.tiles_in_view(frame, 0.25, 0.0, 0.0, 1500.0, 5000.0).collect())
    assert found == Counter([(1, 2, 0, 0), (2, 2, 0, 0), (2, 2, 1, 0), (3, 5, 0, 0)])


def test_candidates_list_archives(spark):
    from tessera.functions.queries import candidates

    scanned = spark.createDataFrame([("file:///a/x.cbz",), ("file:///a/b.JPG",), ("file:///a/n.txt",), ("file:///a/s.workspace",), ("builtin://mandelbrot",)], "url string")
    members = spark.createDataFrame([("file:///a/x.cbz", "zip", "p/1.png"), ("file:///a/x.cbz", "zip", "p/r.txt")], "archive string, loader string, member string")
    assert sorted(r.url for r in candidates(scanned, members).collect()) == ["builtin://mandelbrot", "file:///a/b.JPG", "file:///a/s.workspace", "file:///a/x.cbz//zip:p/1.png"]


def test_grid_join_equals_all_pairs(spark):
    random.seed(5)
    rects = [(i, float(x), float(y), x + random.choice([1.0, 30.0, 400.0]), y + random.choice([1.0, 50.0])) for i in range(150) for x, y in [(random.randint(-300, 300), random.randint(-300, 300))]]
    want = {(a[0], b[0]) for a in rects for b in rects if a[0] < b[0] and a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4]}
    frame = spark.createDataFrame(rects, "ord int, l double, t double, r double, b double")
    found = [(r.i_ord, r.j_ord) for r in spatial.overlapping_pairs(frame, 64.0).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def _rects_with_copies():
    random.seed(6)
    some = [(float(x), float(y), x + random.choice([0.0, 30.0, 90.0]), y + random.choice([5.0, 50.0])) for _ in range(12) for x, y in [(random.randint(-100, 100), random.randint(-100, 100))]]
    ords = random.sample(range(10_000), 318) + [10_001] * 3  # an ord of three rows of different rectangles
    return [(o, *(some[0] if k < 300 else some[k % 12])) for k, o in enumerate(ords)] + [(None, *some[0])]


def test_copies_go_through_the_grid_join_as_one(spark):
    rects = _rects_with_copies()
    rows = [r for r in rects if r[0] is not None]
    want = Counter((*a, *b) for a in rows for b in rows if a[0] < b[0] and a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4])
    frame = spark.createDataFrame(rects, "ord int, l double, t double, r double, b double")
    found = spatial.overlapping_pairs(frame, 64.0).select(*[f"{p}_{c}" for p in "ij" for c in ("ord", "l", "t", "r", "b")])
    assert Counter(map(tuple, found.collect())) == want and sum(want.values()) > 40_000
    # the join itself has two blocks of the 300 copies and one of each other rectangle
    assert spatial._overlapping_blocks(frame, 64.0).count() < 100


def test_pushes_of_copies(spark):
    rects = _rects_with_copies()
    want = {o: [0.0, 0.0, 0] for o, *_ in rects}
    rows = [r for r in rects if r[0] is not None]
    for a in rows:
        for b in rows:
            w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
            if a[0] < b[0] and a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4]:
                dx, dy = (0.0, h / 2 + 16) if w > h else (w / 2 + 16, 0.0)
                for o, sign in ((a[0], -1), (b[0], 1)):
                    want[o] = [want[o][0] + sign * dx, want[o][1] + sign * dy, want[o][2] + 1]
    frame = spark.createDataFrame(rects, "ord int, l double, t double, r double, b double")
    pushed = spatial.overlap_push(frame)
    expected = Counter((o, round((l + r) / 2 + want[o][0], 6), round((t + b) / 2 + want[o][1], 6), want[o][2]) for o, l, t, r, b in rects)
    assert Counter(map(tuple, pushed.collect())) == expected and pushed.schema["ord"].dataType.simpleString() == "int"
    # no plan step makes a row for each pair of rows
    assert "Generate explode(i_ords" not in pushed._jdf.queryExecution().optimizedPlan().toString()


def test_overlaps_are_solved(spark):
    random.seed(1)
    rects = [(i, float(x), float(y), x + 60.0 + i % 7 * 5, y + 40.0 + i % 5 * 9) for i in range(7) for x, y in [(random.randint(0, 100), random.randint(0, 100))]]
    frame = spark.createDataFrame(rects, "ord int, l double, t double, r double, b double")
    out, steps = spatial.solved(frame, 40)
    assert 0 < steps < 40 and spatial.overlapping_pairs(out, 64.0).count() == 0
    found = {r.ord: (r.r - r.l, r.b - r.t) for r in out.collect()}
    assert all(abs(found[o][0] - (r - l)) + abs(found[o][1] - (b - t)) < 1e-3 for o, l, t, r, b in rects)


def test_pyramid_halves_each_level(spark, sf_dir):
    pixels = spark.createDataFrame([(1, x, y, (x * 31 + y * 17) % 256) for x in range(7) for y in range(6)], "img int, x int, y int, g int")
    sizes = {r.scale: r.n for r in raster.pyramid(pixels, ["g"], 2).groupBy("scale").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 42, 1: 9, 2: 1}


def test_upsert_gives_new_ids(spark):
    schema = "fileid long, url string, size long, mtime long, width int, height int, format int"
    files = spark.createDataFrame([(1, "a", 1, 1, 1, 1, 0), (2, "b", 1, 1, 1, 1, 0)], schema)
    new = spark.createDataFrame([("b", 9, 2, 1, 1, 0), ("c", 9, 2, 1, 1, 0), ("c", 8, 1, 1, 1, 0)], "url string, size long, mtime long, width int, height int, format int")
    assert {(r.fileid, r.url, r.size) for r in catalog.upsert(files, new).collect()} == {(1, "a", 1), (3, "b", 9), (4, "c", 9)}


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from tessera.plans.dialect import fixture
    from tessera.streaming.requests import answer_batch, request_stream

    requests, stored = fixture(spark, sf_dir, "img_requests"), fixture(spark, sf_dir, "img_tiles").where("scale >= 3")
    requests.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = request_stream(spark, str(tmp_path / "in"), "req_id long, fileid long, scale int, x int, y int, kind string", stored, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    stream.awaitTermination(120)
    assert stream.exception() is None
    got = spark.read.parquet(str(tmp_path / "out/answers")).drop("batch")
    want = answer_batch(requests, stored)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stream_keeps_arrivals(spark, tmp_path):
    """A tile that arrives in one batch answers the requests of later ones."""
    schema = "req_id long, fileid long, scale int, x int, y int, kind string"
    batches = [[(1, 1, 0, 0, 0, "arrive"), (2, 2, 0, 0, 0, "request")], [(3, 1, 0, 0, 0, "request"), (4, 2, 0, 0, 0, "arrive")], [(5, 2, 0, 0, 0, "request"), (6, 3, 0, 0, 0, "request")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are read in the order of their times
    stored = spark.createDataFrame([], "fileid long, scale int, x int, y int")
    stream = requests.request_stream(spark, str(tmp_path / "in"), schema, stored, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    stream.awaitTermination(120)
    assert stream.exception() is None
    got = {r.req_id: (r.batch, r.answered) for r in spark.read.parquet(str(tmp_path / "out/answers")).collect()}
    assert got == {2: (0, False), 3: (1, True), 5: (2, True), 6: (2, False)}


WIDE = ["dedupe_tiles", "delete_tiles", "delete_cascade", "export_plan", "files_join_tiles", "merge_databases", "orphan_tiles", "purge_highres_jpeg", "split_tiles", "thumbnail_join", "tile_fallback_children", "tile_fallback_parent", "tile_key_order", "tile_lookup", "tile_path_encode", "tile_path_parse", "tile_scale_range_merged", "tiles_of_file", "tiles_ordered"]


@pytest.fixture(scope="module")
def wide_dir(sf_dir, tmp_path_factory):
    """The tables with orders so large that a tile's number is beyond a bigint in some rows."""
    out = str(tmp_path_factory.mktemp("wide"))
    for name in TABLES:
        os.symlink(f"{sf_dir}/{name}.parquet", f"{out}/{name}.parquet") if name != "lineitem" else None
    duckdb.sql(f"copy (select * replace (l_orderkey * 60000 as l_orderkey) from '{sf_dir}/lineitem.parquet') to '{out}/lineitem.parquet' (format parquet)")
    return out


@pytest.mark.parametrize("name", WIDE)
def test_rowids_beyond_bigint(spark, wide_dir, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{wide_dir}/{table}.parquet'")
    exact = SQL[name].replace("cast((((l_orderkey * 8", "cast((((cast(l_orderkey as hugeint) * 8").replace("cast(l_quantity as bigint) as bigint) as rowid", "cast(l_quantity as bigint) as hugeint) as rowid")
    assert exact != SQL[name]
    want = con.sql(exact).fetchall()
    found = [tuple(int(v) if isinstance(v, Decimal) else v for v in row) for row in QUERIES[name](spark, wide_dir).collect()]
    ordered = name in ("tiles_ordered", "tile_key_order")
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert (found if ordered else sorted(found, key=key)) == (want if ordered else sorted(want, key=key))


def test_rowids_that_fit(spark, sf_dir):
    assert dict(fixture(spark, sf_dir, "img_tiles").dtypes)["rowid"] == "bigint"
