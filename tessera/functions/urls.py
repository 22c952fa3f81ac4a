"""URLs as columns: protocol://payload[//plugin[:plugin payload]], their parts, their kinds, and where they lead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders in which other programs keep small pictures: fixed values.
HIDDEN = (".thumbnails", ".xvpics")


def _before(text: Column, mark: str) -> Column:
    """What stands before the first mark; all of it without one."""
    return F.when(F.contains(text, F.lit(mark)), F.substring_index(text, mark, 1)).otherwise(text)


def _behind(text: Column, mark: str) -> Column:
    """What stands behind the first mark; null without one."""
    return F.when(F.contains(text, F.lit(mark)), F.substr(text, F.instr(text, mark) + len(mark)))


def parse_url(url: Column) -> Column:
    """A struct of protocol, payload, plugin and plugin_payload; the last two are null where there are none."""
    rest = _behind(url, "//")
    inner = _behind(rest, "//")
    return F.struct(
        F.substr(url, F.lit(1), F.instr(url, "/") - 2).alias("protocol"),
        _before(rest, "//").alias("payload"),
        _before(inner, ":").alias("plugin"),
        _behind(inner, ":").alias("plugin_payload"),
    )


def format_url(parts: Column) -> Column:
    """The url of a struct of parts."""
    plugin = F.coalesce(F.concat(F.lit("//"), parts["plugin"], F.coalesce(F.concat(F.lit(":"), parts["plugin_payload"]), F.lit(""))), F.lit(""))
    return F.concat(parts["protocol"], F.lit("://"), parts["payload"], plugin)


def is_remote(parts: Column) -> Column:
    return parts["protocol"] != "file"


def has_stdio_name(parts: Column) -> Column:
    """Whether an open file can be had by name: a plain file that no plugin takes apart."""
    return (parts["protocol"] == "file") & parts["plugin"].isNull()


def is_url(text: Column) -> Column:
    return text.rlike("^[a-z]*://")


def route(url: Column) -> Column:
    """Which reader a url of a workspace goes to."""
    drawn = url.startswith("builtin://") | url.startswith("buildin://")
    return F.when(url.endswith(".workspace"), "workspace").when(drawn, "builtin").when(url.endswith("ImageProperties.xml"), "zoomify").otherwise("database")


def is_hidden(url: Column) -> Column:
    """Whether a file lies in a folder that scans pass over."""
    out = F.lit(False)
    for name in HIDDEN:
        out = out | F.contains(url, F.lit(f"/{name}/"))
    return out
