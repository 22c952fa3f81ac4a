"""Sources and sinks for images: files, archives and their members, codecs, line files and workspace files.

Codecs are plain functions on bytes, registered by name; Spark runs them in batches over ``binaryFile`` rows. JPEG, GIF and BMP come
decoded from Spark's ``image`` source. What needs an outside program or a network (raw cameras, video, fetching) is not here; its
loaders keep their places in the registry.
"""

from __future__ import annotations

import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a decoder gives: rows of pixels, three or four channels of bytes.
Surface = np.ndarray


def read_binary(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files below a path with their bytes, without thumbnail folders of other programs."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).where("path not like '%/.thumbnails/%' and path not like '%/.xvpics/%'")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A line file of urls."""
    return spark.read.text(path).select(F.col("value").alias("url")).where("url <> ''")


# -- codecs ------------------------------------------------------------------------------------------------------------
def encode_png(pixels: Surface) -> bytes:
    height, width, channels = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(pixels, dtype=np.uint8))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, {3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """Undo PNG's row filters; raw has a filter number in front of each row."""
    width = (raw.shape[1] - 1) // step
    rows = np.zeros((raw.shape[0], width, step), dtype=np.uint8)
    above = np.zeros((width, step), dtype=np.int32)
    for k, (kind, line) in enumerate(zip(raw[:, 0], raw[:, 1:].reshape(-1, width, step).astype(np.int32))):
        if kind == 1:
            line = np.cumsum(line, axis=0)  # each byte adds to the one a pixel before
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            line, left, corner = line.copy(), np.zeros(step, dtype=np.int32), np.zeros(step, dtype=np.int32)
            for i, up in enumerate(above):
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left = line[i] = (line[i] + guess) & 255
                corner = up
        above = line & 255
        rows[k] = above
    return rows.reshape(raw.shape[0], -1)


#: The seven passes of interlaced images: first row and column, and the steps.
_PASSES = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]


def _samples(raw: bytes, width: int, height: int, channels: int, depth: int) -> tuple[np.ndarray, int]:
    """The samples of a (part of an) image as bytes, scaled up for grays by the caller, and how many bytes it took."""
    row = (width * channels * depth + 7) // 8
    size = height * (row + 1)
    lines = _unfilter(np.frombuffer(raw, np.uint8, size).reshape(height, row + 1), max(1, channels * depth // 8))
    if depth < 8:
        bits = np.unpackbits(lines, axis=1)[:, : width * depth].reshape(height, width, depth)
        return np.dot(bits, 1 << np.arange(depth)[::-1]).astype(np.uint8)[..., None], size
    return lines.reshape(height, width, channels, depth // 8)[..., 0], size


def decode_png(data: bytes) -> Surface:
    """PNG of 1 to 16 bits a channel, gray, colour or palette, with or without alpha or a transparent colour, interlaced or not."""
    at, body, palette, alpha = 8, b"", None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(part, np.uint8)
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = zlib.decompress(body)
    if interlaced:
        pixels, done = np.zeros((height, width, channels), np.uint8), 0
        for top, left, down, right in _PASSES:
            part = pixels[top::down, left::right]
            if part.size:
                part[...], size = _samples(raw[done:], part.shape[1], part.shape[0], channels, depth)
                done += size
    else:
        pixels, _ = _samples(raw, width, height, channels, depth)
    if colour == 3:
        index = pixels[..., 0]
        pixels = palette[index]
        if alpha is not None:
            full = np.full(256, 255, np.uint8)
            full[: len(alpha)] = alpha
            pixels = np.dstack([pixels, full[index]])
        return pixels
    clear = None
    if alpha is not None and colour in (0, 2):  # one colour that is transparent
        key = alpha.reshape(-1, 2)[:, 1 if depth < 16 else 0]
        clear = np.where((pixels == key).all(axis=-1), 0, 255).astype(np.uint8)
    if depth < 8:
        pixels = (pixels.astype(np.int32) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    if colour in (0, 4):
        pixels = np.dstack([pixels[..., :1]] * 3 + [pixels[..., 1:]])
    return pixels if clear is None else np.dstack([pixels, clear])


def decode_pnm(data: bytes) -> Surface:
    """Binary gray or colour maps (P5, P6) with comments and a maximum of 255."""
    fields, at = [], 0
    while len(fields) < 4:
        end = at
        while data[end : end + 1] not in (b" ", b"\t", b"\n", b"\r", b""):
            end += 1
        token = data[at:end]
        if token.startswith(b"#"):
            at = data.index(b"\n", at) + 1
            continue
        if token:
            fields.append(token)
        at = end + 1
    kind, width, height, most = fields[0], *map(int, fields[1:])
    if kind not in (b"P5", b"P6") or most != 255:
        raise ValueError("only P5 and P6 with a maximum of 255")
    channels = 3 if kind == b"P6" else 1
    pixels = np.frombuffer(data, np.uint8, width * height * channels, at).reshape(height, width, channels)
    return pixels if channels == 3 else np.dstack([pixels] * 3)


def decode_dds(data: bytes) -> Surface:
    """DXT1, DXT3 and DXT5 blocks to colour; alpha is passed over."""
    height, width = struct.unpack_from("<II", data, 12)
    kind = data[84:88]
    if kind not in (b"DXT1", b"DXT3", b"DXT5"):
        raise ValueError(f"unknown DDS format {kind!r}")
    wide, high = (width + 3) // 4, (height + 3) // 4
    size = 8 if kind == b"DXT1" else 16
    blocks = np.frombuffer(data, np.uint8, wide * high * size, 128).reshape(-1, size)[:, size - 8 :]
    ends = blocks[:, :4].copy().view("<u2").astype(np.int32)
    colour = np.stack([(ends >> 11 & 31) * 255 // 31, (ends >> 5 & 63) * 255 // 63, (ends & 31) * 255 // 31], axis=-1)
    a, b = colour[:, 0], colour[:, 1]
    four = ((ends[:, 0] > ends[:, 1]) | (kind != b"DXT1"))[:, None]
    table = np.stack([a, b, np.where(four, (2 * a + b) // 3, (a + b) // 2), np.where(four, (a + 2 * b) // 3, 0)], axis=1)
    bits = blocks[:, 4:].copy().view("<u4")[:, 0]
    index = np.stack([bits >> (2 * k) & 3 for k in range(16)], axis=1)
    pixels = table[np.arange(len(table))[:, None], index].astype(np.uint8).reshape(high, wide, 4, 4, 3)
    return pixels.transpose(0, 2, 1, 3, 4).reshape(high * 4, wide * 4, 3)[:height, :width]


#: The decoders by loader; ``register_decoder`` adds one.
DECODERS: dict[str, Callable[[bytes], Surface]] = {"png": decode_png, "pnm": decode_pnm, "dds": decode_dds}
MAGIC = {b"\x89PNG": "png", b"P5": "pnm", b"P6": "pnm", b"DDS ": "dds"}


def register_decoder(name: str, decode: Callable[[bytes], Surface], magic: bytes | None = None) -> None:
    DECODERS[name] = decode
    if magic:
        MAGIC[magic] = name


def decode(data: bytes, loader: str | None) -> Surface | None:
    """By the loader that the name asks for; if there is none or it fails, by the magic bytes; else nothing."""
    by_magic = next((name for magic, name in MAGIC.items() if data.startswith(magic)), None)
    for name in (loader, by_magic):
        if name in DECODERS:
            try:
                return DECODERS[name](data)
            except (ValueError, KeyError, struct.error, zlib.error, IndexError):
                continue
    return None


def _png_size(data: bytes) -> tuple[int, int]:
    return struct.unpack_from(">II", data, 16)


def _jpeg_size(data: bytes) -> tuple[int, int]:
    """From the frame's header, which is found by going from marker to marker."""
    at = 2
    while True:
        if data[at] != 0xFF:
            raise ValueError("no marker")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height
        else:
            at += 2 if kind == 1 or 0xD0 <= kind <= 0xD8 else 2 + struct.unpack_from(">H", data, at + 2)[0]


def _pnm_size(data: bytes) -> tuple[int, int]:
    surface = decode_pnm(data)
    return surface.shape[1], surface.shape[0]


def _dds_size(data: bytes) -> tuple[int, int]:
    height, width = struct.unpack_from("<II", data, 12)
    return width, height


SIZES: dict[bytes, Callable[[bytes], tuple[int, int]]] = {b"\x89PNG": _png_size, b"\xff\xd8": _jpeg_size, b"P5": _pnm_size, b"P6": _pnm_size, b"DDS ": _dds_size}


def size_of(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a file, by its magic bytes; none if there is no loader or the header is broken."""
    for magic, size in SIZES.items():
        if data.startswith(magic):
            try:
                return size(data)
            except (ValueError, struct.error, IndexError):
                return None
    return None


def image_sizes(files: DataFrame) -> DataFrame:
    """(path, width, height) of files(path, content), from the headers alone; files that no loader reads give no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(path, *size) for path, content in zip(frame["path"], frame["content"]) if (size := size_of(bytes(content)))]
            yield pd.DataFrame(found, columns=["path", "width", "height"])

    return files.select("path", "content").mapInPandas(run, "path string, width int, height int")


SURFACE = "path string, width int, height int, channels int, data binary"


def decoded(files: DataFrame) -> DataFrame:
    """(path, width, height, channels, data) of files(path, content): rows of bytes from the top. Files that no decoder here reads give no
    rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                surface = decode(bytes(content), path.rpartition(".")[2].lower())
                if surface is not None:
                    height, width, channels = surface.shape
                    yield pd.DataFrame({"path": [path], "width": [width], "height": [height], "channels": [channels], "data": [np.ascontiguousarray(surface).tobytes()]})

    return files.select("path", "content").mapInPandas(run, SURFACE)


def read_foreign(spark: SparkSession, path: str) -> DataFrame:
    """The same of JPEG, GIF and BMP files below a path, which Spark's ``image`` source decodes; gray ones as colour."""
    reader = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").option("pathGlobFilter", "*.{jpg,jpeg,JPG,JPEG,gif,GIF,bmp,BMP}")
    rows = reader.load(path).select("image.*").where("origin not like '%/.thumbnails/%' and origin not like '%/.xvpics/%'")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                stored = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                surface = np.dstack([stored] * 3) if r.nChannels == 1 else stored[..., [2, 1, 0, 3][: r.nChannels]]
                yield pd.DataFrame({"path": [r.origin], "width": [r.width], "height": [r.height], "channels": [surface.shape[2]], "data": [np.ascontiguousarray(surface).tobytes()]})

    told = rows.mapInPandas(run, SURFACE)
    return told.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))


def halved(surface: Surface) -> Surface:
    """A box of two by two pixels becomes one, truncating; an odd last row or column goes."""
    h, w = surface.shape[0] // 2, surface.shape[1] // 2
    box = surface[: 2 * h, : 2 * w].reshape(h, 2, w, 2, surface.shape[2]).astype(np.uint16)
    return (box.sum(axis=(1, 3)) // 4).astype(np.uint8)


def cut_tiles(surfaces: DataFrame, size: int = 256) -> DataFrame:
    """(fileid, scale, x, y, data) of surfaces(fileid, low, high, width, height, channels, data): the tiles of the levels low to high as
    PNG. An image is decoded, halved and cut in one pass of one task; nothing but its tiles leaves it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                level = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                for scale in range(r.high + 1):
                    if scale:
                        level = halved(level)
                    if scale < r.low or not level.size:
                        continue
                    for y in range(0, level.shape[0], size):
                        row = [level[y : y + size, x : x + size] for x in range(0, level.shape[1], size)]
                        made = [encode_png(t if r.channels == 4 and (t[..., 3] < 255).any() else t[..., :3]) for t in row]
                        yield pd.DataFrame({"fileid": r.fileid, "scale": scale, "x": range(len(made)), "y": y // size, "data": made})

    return surfaces.select("fileid", "low", "high", "width", "height", "channels", "data").mapInPandas(run, "fileid long, scale int, x int, y int, data binary")


def to_pixels(files: DataFrame) -> DataFrame:
    """(path, x, y, r, g, b, a) of files(path, content); files that no loader reads give no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                flat = np.frombuffer(r.data, np.uint8).reshape(-1, r.channels).astype(np.int32)
                y, x = np.divmod(np.arange(len(flat)), r.width)
                alpha = flat[:, 3] if r.channels == 4 else np.full(len(flat), 255)
                yield pd.DataFrame({"path": r.path, "x": x, "y": y, "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2], "a": alpha})

    return decoded(files).mapInPandas(run, "path string, x int, y int, r int, g int, b int, a int")


# -- archives ------------------------------------------------------------------------------------------------------------
def _members(data: bytes) -> Iterator[tuple[str, str, bytes]]:
    if data.startswith(b"PK"):
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for name in archive.namelist():
                if not name.endswith("/"):
                    yield "zip", name, archive.read(name)
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as archive:
            for member in archive:
                if member.isfile():
                    yield "tar", member.name, archive.extractfile(member).read()
    except tarfile.TarError:
        return


def archive_members(files: DataFrame, contents: bool = True) -> DataFrame:
    """(path, plugin, member, content) of zip and tar archives in files(path, content); others give no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                for plugin, name, data in _members(bytes(content)):
                    yield pd.DataFrame({"path": [path], "plugin": [plugin], "member": [name], "content": [data if contents else None]})

    return files.select("path", "content").mapInPandas(run, "path string, plugin string, member string, content binary")


# -- workspace files -----------------------------------------------------------------------------------------------------
def write_workspace(images: DataFrame) -> DataFrame:
    """One row, the text of a workspace with images(ord, url, x, y, scale); quotes and backslashes in urls are escaped."""
    quoted = F.regexp_replace("url", r'(["\\])', r"\\$1")
    line = F.concat(F.lit('(image (url "'), quoted, F.lit('") (pos '), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(") (scale "), F.col("scale").cast("string"), F.lit("))"))
    listed = images.select("ord", line.alias("line")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", "line")))["line"], "\n  ").alias("lines"))
    return listed.select(F.concat(F.lit("(workspace (images\n  "), F.col("lines"), F.lit("))\n")).alias("value"))


def parse_workspace(texts: DataFrame) -> DataFrame:
    """(ord, url, x, y, scale) of texts(value), each a whole workspace."""
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    pattern = rf'\(image\s+\(url\s+"((?:[^"\\\\]|\\\\.)*)"\)\s*\(pos\s+{number}\s+{number}\)\s*\(scale\s+{number}\)\s*\)'.replace("\\\\\\\\", "\\\\")
    whole = texts.select(F.posexplode(F.regexp_extract_all("value", F.lit(pattern), F.lit(0))).alias("ord", "image"))
    take = lambda n: F.regexp_extract("image", pattern, n)
    return whole.select("ord", F.regexp_replace(take(1), r'\\(["\\])', "$1").alias("url"), take(2).cast("double").alias("x"), take(3).cast("double").alias("y"), take(4).cast("double").alias("scale"))


def read_workspace(spark: SparkSession, path: str) -> DataFrame:
    return parse_workspace(spark.read.text(path, wholetext=True))
