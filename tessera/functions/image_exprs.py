"""SQL expressions of scalar functions on file names, URLs and sizes, shared by queries and operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions of the image loaders, in the order of the loaders.
IMAGE_EXTENSIONS = {
    "jpeg": ["jpeg", "jpg"],
    "png": ["png"],
    "xcf": ["xcf", "xcf.bz2", "xcf.gz"],
    "ufraw": ["3fr", "arw", "cr2", "crw", "dcr", "dcs", "dng", "kdc", "mef", "mrw", "nef", "orf", "pef", "raf", "raw", "sr2", "srf", "x3f"],
    "vidthumb": ["avi", "wmv", "flv", "ogv", "mkv", "mp4"],
    "rsvg": ["svg", "svgz"],
    "kra": ["kra"],
    "dds": ["dds", "tex"],
    "imagemagick": ["gif", "tga", "rgb", "bmp", "tiff", "tif", "pbm", "ppm", "pgm", "webp"],
}
# Magic beginnings of image and archive files, in hexadecimal.
IMAGE_MAGIC = {"jpeg": ["FFD8"], "png": ["89504E47"], "xcf": ["67696D7020786366"]}
ARCHIVE_MAGIC = {"rar": ["526172211A0700"], "zip": ["504B0304", "504B0506", "504B0708"], "7zip": ["377ABCAF271C"]}
# Suffixes of archives (without a dot: any name that ends so).
ARCHIVE_SUFFIXES = {
    "rar": ["rar", "cbr"],
    "zip": ["zip", "cbz"],
    "tar": ["tar", "tgz", "tar.gz", "tbz", "tar.bz2", "taz", "tar.Z", "tlz", "tar.lz", "txz", "tar.xz"],
    "7zip": ["7z"],
}


def values(table: dict[str, list[str]], names: str) -> str:
    """A registry as a SQL relation (loader, key, prio); the first registration of a key has the least prio."""
    rows = [(loader, key) for loader, keys in table.items() for key in keys]
    return f"(values {', '.join(f"('{a}', '{k}', {i})" for i, (a, k) in enumerate(rows))}) as {names}"


def glob_to_regex(pattern: str) -> str:
    """An anchored regular expression for a GLOB with *, ?, [abc], [a-z] and [^...]; * crosses '/'; case counts."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end]
            negated = inner.startswith("^")
            body = (inner[1:] if negated else inner).replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return f"(?s)^{''.join(out)}$"


def glob(column: Column, pattern: str) -> Column:
    return column.rlike(glob_to_regex(pattern))


def natural_key(column: Column) -> Column:
    """A key whose binary order is the natural order: digit runs by their length (leading zeros count), then value."""
    parts = F.regexp_extract_all(column, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(p).cast("string"), 6, "0"), p)).otherwise(p)), "")


def halvings(size: str, limit: str = "8") -> str:
    """SQL: how often a size is halved, truncating, until it is at most limit."""
    return "(" + " + ".join(f"cast(({size}) ~/ {1 << k} > {limit} as int)" for k in range(31)) + ")"


THUMBNAIL = halvings("greatest(width, height)")


def extension(path: Column) -> Column:
    """What follows the last dot, lower-cased; of .gz and .bz2 files, one component more. Without a dot, all of it."""
    return F.lower(F.regexp_extract(path, r"([^.]*\.(?i:gz|bz2)|[^.]*)$", 1))


EXTENSION_SQL = "lower(regexp_extract(url, '([^.]*[.](?i:gz|bz2)|[^.]*)$', 1))"


def normalize_path(path: Column) -> Column:
    """'.', '..', '//' and a trailing '/' resolved by name alone."""
    folded = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda stack, part: F.when((part == "") | (part == "."), stack).when(part == "..", F.when(F.size(stack) > 0, F.slice(stack, 1, F.size(stack) - 1)).otherwise(stack)).otherwise(F.concat(stack, F.array(part))),
    )
    return F.concat(F.lit("/"), F.array_join(folded, "/"))
