"""The batch commands on generated pictures."""

import numpy as np

from tessera import commands
from tessera.sources import images


def halve(p):
    h, w = p.shape[0] // 2, p.shape[1] // 2
    p = p[: 2 * h, : 2 * w].astype(int)
    return ((p[::2, ::2] + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2]) // 4).astype(np.uint8)


def test_commands(spark, tmp_path):
    made = {}
    (tmp_path / "in").mkdir()
    for k, (w, h) in enumerate([(300, 40), (20, 30)]):
        made[f"p{k}.png"] = np.random.default_rng(k).integers(0, 256, (h, w, 3), dtype=np.uint8)
        (tmp_path / "in" / f"p{k}.png").write_bytes(images.encode_png(made[f"p{k}.png"]))
    pictures = images.read_binary(spark, str(tmp_path / "in"))
    store = commands.Store(spark, str(tmp_path / "store"))
    assert store.files.count() == 0
    commands.prepare(store, pictures)
    files = {r.url.rpartition("/")[2]: r for r in store.files.collect()}
    assert {n: (r.width, r.height) for n, r in files.items()} == {"p0.png": (300, 40), "p1.png": (20, 30)}
    for name, row in files.items():
        level, scale = made[name], 0
        tiles = {(t.scale, t.x, t.y): bytes(t.data) for t in store.tiles.where(f"fileid = {row.fileid}").collect()}
        count = 0
        while max(level.shape[:2]) > 8:
            for y in range(0, level.shape[0], 256):
                for x in range(0, level.shape[1], 256):
                    assert (images.decode_png(tiles[(scale, x // 256, y // 256)]) == level[y : y + 256, x : x + 256]).all()
                    count += 1
            level, scale = halve(level), scale + 1
        assert len(tiles) == count + 1 or not level.size
    before = store.tiles.count()
    commands.thumbgen(store, pictures, every=True)  # nothing is missing
    assert store.tiles.count() == before
    exported = {r.url.rpartition("/")[2]: images.decode_png(bytes(r.data)) for r in commands.export(store).collect()}
    assert all((exported[n] == made[n]).all() for n in made)
    part, whole = commands.Store(spark, str(tmp_path / "part")), commands.Store(spark, str(tmp_path / "whole"))
    commands.split(store, "*p0.png", part)
    assert [r.url[-6:] for r in commands.list_files(part).collect()] == ["p0.png"]
    commands.merge(whole, part)
    commands.merge(whole, store)
    assert whole.files.count() == 2
    commands.cleanup(whole)
    assert whole.tiles.count() == before
    assert {r.exists for r in commands.check(store, part.files).collect()} == {True, False}
    commands.delete(store, part.files)
    assert store.files.count() == 1 and store.tiles.select("fileid").distinct().count() == 1


def test_commands_with_jpeg(spark, tmp_path):
    """JPEG files are entered with the size in their header, and their tiles come from Spark's decoder."""
    from tests.test_sources import write_jpeg

    (tmp_path / "in").mkdir()
    pixels = np.zeros((300, 520, 3), np.uint8)
    pixels[:, 260:] = (30, 160, 90)
    write_jpeg(spark, tmp_path / "in" / "p.jpg", pixels)
    pictures, foreign = images.read_binary(spark, str(tmp_path / "in")), images.read_foreign(spark, str(tmp_path / "in"))
    store = commands.Store(spark, str(tmp_path / "store"))
    commands.prepare(store, pictures, foreign)
    assert [(r.width, r.height, r.format) for r in store.files.collect()] == [(520, 300, 0)]
    tiles = {(t.scale, t.x, t.y): images.decode_png(bytes(t.data)) for t in store.tiles.collect()}
    assert {k[1:] for k in tiles if k[0] == 0} == {(x, y) for x in range(3) for y in range(2)} and max(k[0] for k in tiles) == 6
    assert np.abs(tiles[(0, 2, 0)].astype(int) - pixels[:256, 512:]).mean() < 6
    small = commands.downscale(foreign).collect()[0]
    assert images.decode_png(bytes(small.data)).shape == (37, 65, 3)
    urls = store.files.select("url")
    assert [(r.min_scale, r.max_scale) for r in commands.view(store, urls.where("false"), ["*p.jpg"]).collect()] == [(0, 6)]
