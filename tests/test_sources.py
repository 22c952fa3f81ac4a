"""Codecs, archives and workspace files: round trips and small hand-made files."""

import io
import struct
import tarfile
import zipfile
import zlib

import numpy as np
import pytest

from tessera.sources import images


def surface(channels, seed=1, height=11, width=17):
    return np.random.default_rng(seed).integers(0, 256, (height, width, channels), dtype=np.uint8)


@pytest.mark.parametrize("channels", [3, 4])
def test_png_round_trip(channels):
    assert (images.decode_png(images.encode_png(surface(channels))) == surface(channels)).all()


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_png_filters(kind):
    pixels = surface(3).reshape(11, -1).astype(np.int32)
    raw = np.zeros((11, pixels.shape[1] + 1), np.uint8)
    for k in range(11):
        for i in range(pixels.shape[1]):
            left = pixels[k, i - 3] if i >= 3 else 0
            up = pixels[k - 1, i] if k else 0
            corner = pixels[k - 1, i - 3] if k and i >= 3 else 0
            p = left + up - corner
            paeth = left if abs(p - left) <= min(abs(p - up), abs(p - corner)) else up if abs(p - up) <= abs(p - corner) else corner
            raw[k, i + 1] = (pixels[k, i] - {1: left, 2: up, 3: (left + up) // 2, 4: paeth}[kind]) & 255
        raw[k, 0] = kind
    assert (images._unfilter(raw, 3) == pixels).all()


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def made_png(width, height, depth, colour, raw, *more, interlaced=0):
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced))
    return b"\x89PNG\r\n\x1a\n" + head + b"".join(more) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_png_of_few_bits(depth):
    values = np.random.default_rng(depth).integers(0, 1 << depth, (5, 11))
    raw = b"".join(b"\0" + np.packbits(np.unpackbits(row.astype(np.uint8)[:, None], axis=1)[:, 8 - depth :].ravel()).tobytes() for row in values)
    gray = images.decode_png(made_png(11, 5, depth, 0, raw))
    assert (gray == (values * 255 // ((1 << depth) - 1))[..., None]).all()
    palette = surface(3, height=1, width=1 << depth)[0]
    found = images.decode_png(made_png(11, 5, depth, 3, raw, chunk(b"PLTE", palette.tobytes())))
    assert (found == palette[values]).all()


def test_png_interlaced_and_transparent():
    pixels = surface(3)
    passes = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]
    raw = b"".join(b"\0" + row.tobytes() for a, b, c, d in passes if pixels[a::c, b::d].size for row in np.ascontiguousarray(pixels[a::c, b::d]))
    assert (images.decode_png(made_png(17, 11, 8, 2, raw, interlaced=1)) == pixels).all()
    plain = b"".join(b"\0" + row.tobytes() for row in pixels)
    clear = images.decode_png(made_png(17, 11, 8, 2, plain, chunk(b"tRNS", struct.pack(">HHH", *pixels[3, 4].tolist()))))
    assert clear[3, 4, 3] == 0 and (clear[..., 3] == 0).sum() == (pixels == pixels[3, 4]).all(axis=-1).sum()


def write_jpeg(spark, path, pixels):
    """By Java's own writer."""
    awt, io_ = spark._jvm.java.awt.image, spark._jvm.javax.imageio.ImageIO
    picture = awt.BufferedImage(pixels.shape[1], pixels.shape[0], 1)
    for y, row in enumerate(pixels.tolist()):
        for x, (r, g, b) in enumerate(row):
            picture.setRGB(x, y, r << 16 | g << 8 | b)
    assert io_.write(picture, "jpg", spark._jvm.java.io.File(str(path)))


def test_jpeg(spark, tmp_path):
    pixels = np.zeros((20, 33, 3), np.uint8)
    pixels[..., 0], pixels[10:, :, 2] = 200, 120
    write_jpeg(spark, tmp_path / "p.jpg", pixels)
    row = images.read_foreign(spark, str(tmp_path)).collect()[0]
    found = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)
    assert found.shape == pixels.shape and np.abs(found.astype(int) - pixels).mean() < 12
    files = images.read_binary(spark, str(tmp_path), "*.jpg")
    assert [(r.width, r.height) for r in images.image_sizes(files).collect()] == [(33, 20)]
    assert files.join(images.read_foreign(spark, str(tmp_path)), "path").count() == 1


def test_pnm():
    pixels = surface(3, height=2, width=3)
    assert (images.decode_pnm(b"P6\n# a comment\n3 2\n255\n" + pixels.tobytes()) == pixels).all()
    assert images.decode_pnm(b"P5 1 1 255\n\x07").tolist() == [[[7, 7, 7]]]
    with pytest.raises(ValueError):
        images.decode_pnm(b"P6 1 1 65535\n")


def test_dds():
    head = bytearray(128)
    head[:4], head[84:88] = b"DDS ", b"DXT1"
    struct.pack_into("<II", head, 12, 4, 4)
    block = struct.pack("<HHI", 0xF800, 0x001F, 0b11100100)
    pixels = images.decode_dds(bytes(head) + block)
    assert pixels[0].tolist() == [[255, 0, 0], [0, 0, 255], [170, 0, 85], [85, 0, 170]] and pixels[3, 3].tolist() == [255, 0, 0]


def test_files_and_archives(spark, tmp_path):
    png = images.encode_png(surface(3))
    folder = tmp_path / "in" / "sub"
    folder.mkdir(parents=True)
    (tmp_path / "in" / ".thumbnails").mkdir()
    (folder / "a.png").write_bytes(png)
    (folder / "wrong.dds").write_bytes(png)
    (folder / "short.jpg").write_bytes(b"x")
    (tmp_path / "in" / ".thumbnails" / "t.png").write_bytes(png)
    with zipfile.ZipFile(folder / "b.zip", "w") as archive:
        archive.writestr("dir/[1].png", png)
    with tarfile.open(folder / "c.tar", "w") as archive:
        entry = tarfile.TarInfo("d.txt")
        entry.size = 2
        archive.addfile(entry, io.BytesIO(b"hi"))
    files = images.read_binary(spark, str(tmp_path / "in"))
    assert files.count() == 5
    pixels = images.to_pixels(files)
    assert {r.path.rpartition("/")[2]: r["count"] for r in pixels.groupBy("path").count().collect()} == {"a.png": 187, "wrong.dds": 187}
    members = {(r.plugin, r.member): bytes(r.content) for r in images.archive_members(files).collect()}
    assert members == {("zip", "dir/[1].png"): png, ("tar", "d.txt"): b"hi"}
    surfaces = images.decoded(files.where("path like '%a.png'")).selectExpr("1L as fileid", "0 as low", "0 as high", "*")
    tiles = images.cut_tiles(surfaces, 8).collect()
    assert len(tiles) == 6
    assert all((images.decode_png(bytes(t.data)) == surface(3)[8 * t.y : 8 * t.y + 8, 8 * t.x : 8 * t.x + 8]).all() for t in tiles)
    sizes = {r.path.rpartition("/")[2]: (r.width, r.height) for r in images.image_sizes(files).collect()}
    assert sizes == {"a.png": (17, 11), "wrong.dds": (17, 11)}


def test_workspace_round_trip(spark, tmp_path):
    rows = [(0, 'file:///a "b"\\c.png', 1.5, -2.0, 1.0), (1, "http://x/y.jpg", 1e10, 0.0, 0.25)]
    frame = spark.createDataFrame(rows, "ord int, url string, x double, y double, scale double")
    images.write_workspace(frame).coalesce(1).write.text(str(tmp_path / "w"))
    part = next((tmp_path / "w").glob("part-*.txt"))
    assert [tuple(r) for r in images.read_workspace(spark, str(part)).orderBy("ord").collect()] == rows


def test_line_file(spark, tmp_path):
    (tmp_path / "urls").write_text("file:///a\n\nfile:///b\n")
    assert [r.url for r in images.read_lines(spark, str(tmp_path / "urls")).collect()] == ["file:///a", "file:///b"]
