"""Queries on scalar functions: URLs, file names, registries, numbers, and the text formats of sources."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.image_exprs import ARCHIVE_MAGIC, ARCHIVE_SUFFIXES, IMAGE_EXTENSIONS, IMAGE_MAGIC, THUMBNAIL, extension, halvings, normalize_path, values
from tessera.functions.urls import format_url, has_stdio_name, is_hidden, is_remote, is_url, parse_url, route
from tessera.plans.dialect import Family, fixture, run

FAMILY = Family()
same, own = FAMILY.same, FAMILY.own

# -- URLs ------------------------------------------------------------------------------------------------------------
#: protocol://payload[//plugin:plugin_payload]; a plugin part without a colon has no payload of its own.
_LINKS = "select url from img_files union all select concat(url, '//zip:dir/', cast(fileid as string), '.png') from img_files where fileid % 3 = 0 union all select concat(url, '//rar') from img_files where fileid % 11 = 0 union all select url from img_urls"
_PARSED = """select url, substr(url, 1, instr(url, '/') - 2) as protocol,
 case when instr(rest, '//') > 0 then substr(rest, 1, instr(rest, '//') - 1) else rest end as payload,
 case when instr(rest, '//') > 0 then split_part(substr(rest, instr(rest, '//') + 2), ':', 1) end as plugin,
 case when instr(rest, '//') > 0 and instr(substr(rest, instr(rest, '//') + 2), ':') > 0 then substr(rest, instr(rest, '//') + 2 + instr(substr(rest, instr(rest, '//') + 2), ':')) end as plugin_payload
from (select url, substr(url, instr(url, '/') + 2) as rest from links)"""


@own("url_parse", f"with links as ({_LINKS}) {_PARSED}")
def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = run(spark, sf_dir, _LINKS).withColumn("parts", parse_url(F.col("url")))
    return links.select("url", "parts.*")


@own("url_roundtrip", f"with links as ({_LINKS}), p as ({_PARSED}) select url, concat(protocol, '://', payload, case when plugin is null then '' else concat('//', plugin, case when plugin_payload is null then '' else concat(':', plugin_payload) end) end) as formatted from p")
def url_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = run(spark, sf_dir, _LINKS)
    return links.select("url", format_url(parse_url(F.col("url"))).alias("formatted"))


@own("url_flags", f"with links as ({_LINKS}), p as ({_PARSED}) select url, protocol <> 'file' as is_remote, protocol = 'file' and plugin is null as has_stdio_name, rx(url, '^[a-z]*://') as is_url from p")
def url_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = run(spark, sf_dir, _LINKS).withColumn("parts", parse_url(F.col("url")))
    parts = F.col("parts")
    return links.select("url", is_remote(parts).alias("is_remote"), has_stdio_name(parts).alias("has_stdio_name"), is_url(F.col("url")).alias("is_url"))


_TOOLS = f"{_LINKS} union all select 'file:///a/b.workspace' union all select 'builtin://mandelbrot' union all select 'buildin://mandelbrot' union all select 'file:///z/ImageProperties.xml'"


@own(
    "route_urls",
    f"with links as ({_TOOLS}) select url, case when url like '%.workspace' then 'workspace' when url like 'builtin://%' or url like 'buildin://%' then 'builtin' when url like '%ImageProperties.xml' then 'zoomify' else 'database' end as route from links",
)
def route_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, _TOOLS).select("url", route(F.col("url")).alias("route"))


@own("normalize_path", "with recursive p as (select fileid, concat(replace(substr(url, 8), '/brand', '/./x/../brand'), case when fileid % 2 = 0 then '/..//./' else '' end) as path from img_files), w as (select fileid, path, string_split(path, '/') as parts, 1 as i, cast([] as varchar[]) as stack from p union all select fileid, path, parts, i + 1, case when parts[i] in ('', '.') then stack when parts[i] = '..' then stack[1:len(stack) - 1] else list_append(stack, parts[i]) end from w where i <= len(parts)) select fileid, path, '/' || array_to_string(stack, '/') as normal from w where i = len(parts) + 1")
def normal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = run(spark, sf_dir, "select fileid, concat(replace(substr(url, 8), '/brand', '/./x/../brand'), case when fileid % 2 = 0 then '/..//./' else '' end) as path from img_files")
    return paths.select("fileid", "path", normalize_path(F.col("path")).alias("normal"))


@own("url_from_filename", "select fileid, concat('file://', regexp_replace(substr(url, 8), '/+', '/', 'g')) as url from img_files")
def url_from_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = run(spark, sf_dir, "select fileid, concat('/.', replace(substr(url, 8), '/', '//'), '/') as path from img_files")
    return files.select("fileid", F.concat(F.lit("file://"), normalize_path(F.col("path"))).alias("url"))


@own("file_extension", "select fileid, lower(regexp_extract(url, '([^.]*[.](?i:gz|bz2)|[^.]*)$', 1)) as extension from img_files")
def file_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "img_files").select("fileid", extension(F.col("url")).alias("extension"))


@own("suffix_prefix", "select url, right(url, 4) = '.jpg' as has_suffix, substr(url, 1, 8) = 'file:///' as has_prefix from img_files")
def suffix_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return fixture(spark, sf_dir, "img_files").select("url", url.endswith(".jpg").alias("has_suffix"), url.startswith("file:///").alias("has_prefix"))


_TREE = "select url from img_files union all select replace(url, '/promo/', '/.thumbnails/') from img_files union all select replace(url, '/small/', '/.xvpics/') from img_files"


@own("scan_paths", f"select url from ({_TREE}) where url not like '%/.thumbnails/%' and url not like '%/.xvpics/%'")
def scan_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, _TREE).where(~is_hidden(F.col("url")))


def listed_in(paths: DataFrame, folder: str) -> DataFrame:
    """The files that lie right in a folder, with their whole paths."""
    return paths.where(F.substring_index("url", "/", -1) != "").where(F.regexp_replace("url", "/[^/]*$", "") == folder.rstrip("/"))


@own("list_folder", "select url from img_files where url glob 'file:///promo*' and array_to_string(string_split(url, '/')[1:5], '/') = 'file:///' || string_split(url, '/')[4] || '/Brand-1' and len(string_split(url, '/')) = 6 and string_split(url, '/')[4] = (select min(string_split(url, '/')[4]) from img_files where url like 'file:///promo%')")
def list_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fixture(spark, sf_dir, "img_files").select("url")
    kind = files.where("url like 'file:///promo%'").agg(F.min(F.split("url", "/")[3]).alias("k")).first()["k"]
    return listed_in(files, f"file:///{kind}/Brand-1")
#: Files, some in folders and on hosts with dots in their names.
_DOTTED = "select fileid, case when fileid % 3 = 0 then replace(url, 'file:///', 'http://a.b/c.png/') else url end as url from img_files"


def jpegs(files: DataFrame) -> DataFrame:
    return files.where(extension(F.col("url")).isin("jpg", "jpeg"))


@own("jpeg_files", f"select fileid, url from ({_DOTTED}) where list_contains(['jpg', 'jpeg'], lower(string_split(url, '.')[-1]))")
def jpeg_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpegs(run(spark, sf_dir, _DOTTED))


@own("valid_files", "with f as (select fileid, url, case when fileid % 13 = 0 then 0 else width end as width, case when fileid % 13 = 0 then 0 else height end as height from img_files) select * from f where not (width = 0 and height = 0)")
def valid_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = run(spark, sf_dir, "select fileid, url, case when fileid % 13 = 0 then 0 else width end as width, case when fileid % 13 = 0 then 0 else height end as height from img_files")
    return files.where((F.col("width") != 0) | (F.col("height") != 0))


@own("md5_hex", "select fileid, md5(url) as digest from img_files")
def md5_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "img_files").select("fileid", F.md5("url").alias("digest"))


# -- registries ------------------------------------------------------------------------------------------------------
_EXTENDED = "select fileid, url, lower(regexp_extract(url, '([^.]*[.](gz|bz2|GZ|BZ2)|[^.]*)$', 1)) as extension from img_files"
_IMAGES = values(IMAGE_EXTENSIONS, "r(loader, key, prio)")


@own("supported_files", f"with f as ({_EXTENDED}) select fileid, url from f where exists (select 1 from {_IMAGES} where r.key = f.extension)")
def supported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = [key for keys in IMAGE_EXTENSIONS.values() for key in keys]
    return fixture(spark, sf_dir, "img_files").where(extension(F.col("url")).isin(known)).select("fileid", "url")


def first_loader(registry: dict[str, list[str]], met: Callable[[str], F.Column]) -> F.Column:
    """The loader whose key is met; of several, the one that was entered first; else null."""
    return F.coalesce(*[F.when(met(key), loader) for loader, keys in registry.items() for key in keys])


_ARCHIVE = values(ARCHIVE_SUFFIXES, "r(loader, key, prio)")
_HEADS = "select fileid, url, case fileid % 5 when 0 then '504B030414000000' when 1 then '526172211A070000' when 2 then '377ABCAF271C0004' when 3 then 'FFD8FFE000104A46' else '89504E470D0A1A0A' end as head from img_files"


@own(
    "classify_archive",
    f"""with f as ({_HEADS}), s as (select f.fileid, min_by(r.loader, r.prio) as by_suffix from f join {_ARCHIVE} on right(f.url, length(r.key)) = r.key group by f.fileid),
m as (select f.fileid, min_by(r.loader, r.prio) as by_magic from f join {values(ARCHIVE_MAGIC, "r(loader, key, prio)")} on substr(f.head, 1, length(r.key)) = r.key group by f.fileid)
select f.fileid, s.by_suffix is not null as is_archive, s.by_suffix, m.by_magic, coalesce(s.by_suffix, m.by_magic) as loader from f left join s on s.fileid = f.fileid left join m on m.fileid = f.fileid""",
)
def classify_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = run(spark, sf_dir, _HEADS)
    suffix, magic = first_loader(ARCHIVE_SUFFIXES, F.col("url").endswith), first_loader(ARCHIVE_MAGIC, F.col("head").startswith)
    return files.select("fileid", suffix.isNotNull().alias("is_archive"), suffix.alias("by_suffix"), magic.alias("by_magic"), F.coalesce(suffix, magic).alias("loader"))


@own(
    "classify_format",
    f"""with e as ({_EXTENDED}), f as ({_HEADS}), x as (select e.fileid, min_by(r.loader, r.prio) as by_extension from e join {_IMAGES} on e.extension = r.key group by e.fileid),
m as (select f.fileid, min_by(r.loader, r.prio) as by_magic from f join {values(IMAGE_MAGIC, "r(loader, key, prio)")} on substr(f.head, 1, length(r.key)) = r.key group by f.fileid)
select f.fileid, x.by_extension, m.by_magic, coalesce(x.by_extension, m.by_magic) as loader from f left join x on x.fileid = f.fileid left join m on m.fileid = f.fileid""",
)
def classify_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = run(spark, sf_dir, _HEADS)
    name, magic = first_loader(IMAGE_EXTENSIONS, lambda key: extension(F.col("url")) == key), first_loader(IMAGE_MAGIC, F.col("head").startswith)
    return files.select("fileid", name.alias("by_extension"), magic.alias("by_magic"), F.coalesce(name, magic).alias("loader"))


#: Paths of a scan, and what the archives among them list.
_SCANNED = "select fileid, url from img_files union all select cast(-1 as bigint), 'file:///a/sheet.workspace' union all select cast(-2 as bigint), 'file:///z/ImageProperties.xml' union all select cast(-3 as bigint), 'builtin://mandelbrot'"
_LISTED = f"select f.url as archive, r.loader, concat(m.name, cast(f.fileid as string), m.ending) as member from img_files f join {_ARCHIVE} on right(f.url, length(r.key)) = r.key cross join (values ('dir/a', '.png'), ('b', '.txt'), ('c', '.JPG')) as m(name, ending)"


def candidates(scanned: DataFrame, members: DataFrame) -> DataFrame:
    """The urls that a scan enters: files of supported kinds, sheets and pyramids as they are, and of archives, the supported ones among
    members(archive, loader, member)."""
    archive = reduce(operator.or_, (F.col("url").endswith(key) for keys in ARCHIVE_SUFFIXES.values() for key in keys))
    known = [key for keys in IMAGE_EXTENSIONS.values() for key in keys]
    plain = F.col("url").rlike(r"[.]workspace$|ImageProperties[.]xml$|^(builtin|buildin)://") | extension(F.col("url")).isin(known)
    inside = scanned.where(archive).join(members, F.col("url") == F.col("archive")).where(extension(F.col("member")).isin(known))
    return scanned.where(~archive & plain).select("url").unionAll(inside.select(F.concat("url", F.lit("//"), "loader", F.lit(":"), "member").alias("url")))


@own(
    "candidate_files",
    f"""with s as ({_SCANNED}), l as ({_LISTED}), e as (select url, lower(string_split(url, '.')[-1]) as one, lower(array_to_string(string_split(url, '.')[-2:], '.')) as two from s)
select e.url from e where not exists (select 1 from {_ARCHIVE} where suffix(e.url, r.key)) and (exists (select 1 from {_IMAGES} where r.key in (e.one, e.two)) or suffix(e.url, '.workspace') or suffix(e.url, 'ImageProperties.xml') or prefix(e.url, 'builtin://') or prefix(e.url, 'buildin://'))
union all select archive || '//' || loader || ':' || member from l where not suffix(member, '.txt')""",
)
def candidate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(run(spark, sf_dir, _SCANNED), run(spark, sf_dir, _LISTED))


# The messages of unzip's exit codes.
ZIP_ERRORS = {
    0: "normal; no errors or warnings detected.",
    1: "out one or more warning errors were encountered, but processing completed successfully anyway. This includes zipfiles where one or more files was skipped due to unsupported compression method or encryption with an unknown password.",
    2: "a generic error in the zipfile format was detected.  Processing may have completed successfully anyway; some broken zipfiles created by other archivers have simple work-arounds.",
    3: "a severe error in the zipfile format was detected.  Processing probably failed immediately.",
    4: "unzip was unable to allocate memory for one or more buffers during program initialization.",
    5: "unzip was unable to allocate memory or unable to obtain a tty to read the decryption password(s).",
    6: "unzip was unable to allocate memory during decompression to disk.",
    7: "unzip was unable to allocate memory during in-memory decompression.",
    8: "[currently not used]",
    9: "the specified zipfiles were not found.",
    10: "invalid options were specified on the command line.",
    11: "no matching files were found.",
    50: "the disk is (or was) full during extraction.",
    51: "the end of the ZIP archive was encountered prematurely.",
    80: "the user aborted unzip prematurely with control-C (or similar)",
    81: "testing or extraction of one or more files failed due to unsupported compression methods or unsupported decryption.",
    82: "no files were found due to bad decryption password(s).  (If even one file is successfully processed, however, the exit status is 1.)",
}
same("zip_error_message", f"with c as (select distinct cast(p_size as int) as code from part union select 80 union select 81 union select 82 union select 0) select c.code, coalesce(e.message, concat('unknown error code: ', cast(c.code as string))) as message from c left join (values {', '.join(f"({k}, '{v.replace(chr(39), chr(39) * 2)}')" for k, v in ZIP_ERRORS.items())}) as e(code, message) on e.code = c.code")
#: EXIF orientations and their transformations (fixed values).
ORIENTATIONS = {1: "Rot0", 2: "Rot180Flip", 3: "Rot180", 4: "Rot0Flip", 5: "Rot270Flip", 6: "Rot90", 7: "Rot90Flip", 8: "Rot270"}


def modifier(orientation: F.Column) -> F.Column:
    """How a picture is turned for an orientation; not at all for unknown ones."""
    table = F.create_map(*[F.lit(x) for pair in ORIENTATIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, orientation), F.lit("Rot0"))


def turned_size(orientation: F.Column, width: F.Column, height: F.Column) -> tuple[F.Column, F.Column]:
    """A picture's size when it is turned; quarter turns swap its sides."""
    quarter = orientation.between(5, 8)
    return F.when(quarter, height).otherwise(width), F.when(quarter, width).otherwise(height)


@own(
    "exif_orientation",
    f"select o.page_id, o.orientation, coalesce(m.modifier, 'Rot0') as modifier, case when o.orientation between 5 and 8 then 300 else 400 end as width, case when o.orientation between 5 and 8 then 400 else 300 end as height from (select page_id, cast(page_id % 10 as int) as orientation from pages) o left join (values {', '.join(f"({k}, '{v}')" for k, v in ORIENTATIONS.items())}) as m(orientation, modifier) on m.orientation = o.orientation",
)
def exif_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = run(spark, sf_dir, "select page_id, cast(page_id % 10 as int) as orientation from pages")
    wide, high = turned_size(F.col("orientation"), F.lit(400), F.lit(300))
    return pages.select("page_id", "orientation", modifier(F.col("orientation")).alias("modifier"), wide.alias("width"), high.alias("height"))


# -- numbers ---------------------------------------------------------------------------------------------------------
same("math_basic", "select ord, greatest(10d, least(l, 100d)) as clamped, least(l, r) as lo, greatest(l, r) as hi, abs(l) as a, round(sin(ord), 6) as s, round(cos(ord), 6) as c, round(sqrt(ord), 6) as q, ord % 7 as m, floor(l / 10d) * 10d as f, round(atan2(cast(ord as double), 10d), 6) as t from img_rects")


def half_away(value: F.Column) -> F.Column:
    """The nearest whole number; halves go away from zero."""
    return F.when(value >= 0, F.floor(value + 0.5)).otherwise(F.ceil(value - 0.5)).cast("double")


@own("math_round", "select ord, case when l >= 0 then floor(l + 0.5d) else ceil(l - 0.5d) end * 1d as rounded from img_rects")
def math_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "img_rects").select("ord", half_away(F.col("l")).alias("rounded"))


same("math_pow2", "select ord, pow2(cast(ord % 20 as int)) as p, cast((ord + 255) ~/ 256 as int) as ceiling, (ord > 0 and ord = pow2(cast(floor(log2(greatest(ord, 1))) as int))) as is_power from img_rects")


def power_of_two_from(n: str) -> str:
    """SQL: the least power of two that is not below a whole number of at least 1; 0 for 0."""
    return f"case when {n} <= 1 then cast({n} as bigint) else shiftleft(1L, length(bin({n} - 1))) end"


@own("math_round_pow2", "select ord, case when ord <= 1 then cast(ord as bigint) else list_filter(list_transform(range(0, 40), lambda k : cast(1 as bigint) << k), lambda p : p >= ord)[1] end as k from img_rects")
def math_round_pow2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "img_rects").select("ord", F.expr(power_of_two_from("ord")).alias("k"))


def float_hex(value: str) -> str:
    """SQL: the four bytes of a 32-bit float in hexadecimal, lowest first, as a little-endian machine holds them. Finite normal values and 0."""
    power = f"cast(floor(round(log2(abs({value})), 9)) as int)"
    # the rounded logarithm may be one off at the edges of a power
    exponent = f"({power} + case when abs({value}) >= power(2D, {power} + 1) then 1 when abs({value}) < power(2D, {power}) then -1 else 0 end)"
    bits = f"(cast(abs({value}) / power(2D, {exponent}) * 8388608D as bigint) - 8388608 + ({exponent} + 127) * 8388608 + case when {value} < 0 then 2147483648 else 0 end)"
    big = f"lpad(lower(hex({bits})), 8, '0')"
    return f"case when {value} = 0 then '00000000' else concat(substr({big}, 7, 2), substr({big}, 5, 2), substr({big}, 3, 2), substr({big}, 1, 2)) end"


def float_of_hex(text: str) -> str:
    """SQL: the value of four bytes in hexadecimal, lowest first."""
    bits = f"cast(conv(concat(substr({text}, 7, 2), substr({text}, 5, 2), substr({text}, 3, 2), substr({text}, 1, 2)), 16, 10) as bigint)"
    return f"case when {text} = '00000000' then 0D else (1D + ({bits} % 8388608) / 8388608D) * power(2D, {bits} div 8388608 % 256 - 127) * case when {bits} >= 2147483648 then -1D else 1D end end"


@own("float_to_hex", "with b as (select ord, cast(cast(cast(l as float) as bit) as varchar) as s from img_rects) select ord, lower(printf('%08x', cast(('0b' || substr(s, 25, 8) || substr(s, 17, 8) || substr(s, 9, 8) || substr(s, 1, 8)) as bigint))) as hex, cast(cast(l as float) as double) as back from b join img_rects using (ord)")
def float_to_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run(spark, sf_dir, "select ord, cast(cast(l as float) as double) as v from img_rects").select("ord", F.expr(float_hex("v")).alias("hex"))
    return rows.select("ord", "hex", F.expr(float_of_hex("hex")).alias("back"))


same("math_angle", "select ord, round(degrees(cast(ord as double) / 100), 6) as deg, round(radians(cast(ord as double)), 6) as rad from img_rects")


@own("thumbnail_scale", f"select fileid, cast({THUMBNAIL} as int) as thumbnail_scale from img_files")
def thumbnail_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fixture(spark, sf_dir, "img_files")
    return files.select("fileid", F.expr(THUMBNAIL.replace("~/", "div")).cast("int").alias("thumbnail_scale"))


@own("zoomify_max_scale", f"select fileid, cast({halvings('greatest(width, height)', '256')} as int) as max_scale from img_files")
def zoomify_max_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fixture(spark, sf_dir, "img_files")
    return files.select("fileid", F.expr(halvings("greatest(width, height)", "256").replace("~/", "div")).cast("int").alias("max_scale"))


# -- text formats of sources -----------------------------------------------------------------------------------------
_ZOOM = "select page_id, concat('<IMAGE_PROPERTIES WIDTH=\"', cast(600 + page_id * 97 % 4000 as string), '\" HEIGHT=\"', cast(500 + page_id * 61 % 3000 as string), '\" NUMTILES=\"1\" NUMIMAGES=\"1\" VERSION=\"1.8\" TILESIZE=\"256\" />') as xml, concat('http://host/', cast(page_id as string), '/ImageProperties.xml') as url from pages"
same(
    "zoomify_tile_urls",
    f"""with s as ({_ZOOM}), a as (select page_id, substr(url, 1, length(url) - 19) as base, cast(regexp_extract(xml, 'WIDTH="([0-9]+)"', 1) as bigint) as w, cast(regexp_extract(xml, 'HEIGHT="([0-9]+)"', 1) as bigint) as h, cast(regexp_extract(xml, 'TILESIZE="([0-9]+)"', 1) as bigint) as ts from s),
m as (select *, {halvings('greatest(w, h)', 'ts')} as max_scale from a), z as (select *, [[0 : max_scale]] as scale from m),
g as (select page_id, base, max_scale, cast(scale as int) as scale, (w ~/ pow2(cast(scale as int)) - 1) ~/ ts + 1 as tw, (h ~/ pow2(cast(scale as int)) - 1) ~/ ts + 1 as th from z),
p as (select *, coalesce(sum(tw * th) over (partition by page_id order by scale desc rows between unbounded preceding and 1 preceding), 0) as earlier from g),
x as (select *, [[0 : tw - 1]] as x from p), y as (select *, [[0 : th - 1]] as y from x)
select page_id, scale, cast(x as bigint) as x, cast(y as bigint) as y, concat(base, '/TileGroup', cast(cast((earlier + y * tw + x) as bigint) ~/ 256 as string), '/', cast(max_scale - scale as string), '-', cast(x as string), '-', cast(y as string), '.jpg') as url from y""",
)
_LISTING = "select fileid, concat('7-Zip listing', chr(10), 'Path = ', url, chr(10), '----------', chr(10), 'Path = a', cast(fileid as string), '.png', chr(10), 'Size = 10', chr(10), 'Path = dir/b.jpg', chr(10)) as listing from img_files"


def seven_zip_members(listing: F.Column) -> F.Column:
    """The paths that a listing names behind its line of dashes."""
    lines = F.split(F.substring_index(listing, "----------\n", -1), "\n")
    return F.transform(F.filter(lines, lambda x: x.startswith("Path = ")), lambda x: F.substr(x, F.lit(8)))


def zip_members(listing: F.Column) -> F.Column:
    """The names in the fourth column of a listing of lines without heading."""
    lines = F.filter(F.split(listing, "\n"), lambda x: x.rlike(r"^\s*\S+\s+\S+\s+\S+\s+\S"))
    return F.transform(lines, lambda x: F.regexp_extract(x, r"^\s*\S+\s+\S+\s+\S+\s+(.*)$", 1))


@own("parse_archive_listing", f"with l as ({_LISTING}), b as (select fileid, split_part(listing, concat('----------', chr(10)), 2) as body from l), n as (select fileid, body, [[1 : 4]] as i from b), r as (select fileid, split_part(body, chr(10), cast(i as int)) as line from n) select fileid, substr(line, 8) as member from r where line like 'Path = %'")
def parse_archive_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, _LISTING).select("fileid", F.explode(seven_zip_members(F.col("listing"))).alias("member"))


_XCF = "select page_id, concat('+ 640x480+0+0 RGB-alpha Normal Layer ', cast(page_id as string)) as line from pages union all select page_id, concat('- 32x16-4+8 RGB Multiply Background copy') from pages"


def layer(line: F.Column) -> F.Column:
    """A line that tells a layer: whether it is shown, its size and its name."""
    pattern = r"^(.) ([0-9]+)x([0-9]+)[-+][0-9]+[-+][0-9]+ [^ ]+ [^ ]+ (.*)$"
    part = lambda n: F.regexp_extract(line, pattern, n)
    return F.struct(part(1).alias("visible"), part(2).cast("int").alias("width"), part(3).cast("int").alias("height"), part(4).alias("layer"))


@own("parse_xcfinfo", f"with l as ({_XCF}) select page_id, regexp_extract(line, '^(.)', 1) as visible, cast(regexp_extract(line, '^. ([0-9]+)x', 1) as int) as width, cast(regexp_extract(line, '^. [0-9]+x([0-9]+)', 1) as int) as height, regexp_extract(line, '^. [0-9]+x[0-9]+[-+][0-9]+[-+][0-9]+ [^ ]+ [^ ]+ (.*)$', 1) as layer from l")
def parse_xcfinfo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, _XCF).select("page_id", layer(F.col("line")).alias("l")).select("page_id", "l.*")


def inked(ink: F.Column, black: F.Column) -> F.Column:
    """The light of a colour of an inverted four-colour picture."""
    return F.floor(ink * black / 255).cast("int")


@own("cmyk_to_rgb", "select c_custkey, cast(c * k ~/ 255 as int) as r, cast(m * k ~/ 255 as int) as g, cast(y * k ~/ 255 as int) as b from (select c_custkey, c_custkey % 256 as c, c_custkey * 7 % 256 as m, c_custkey * 13 % 256 as y, c_custkey * 29 % 256 as k from customer)")
def cmyk_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = run(spark, sf_dir, "select c_custkey, c_custkey % 256 as c, c_custkey * 7 % 256 as m, c_custkey * 13 % 256 as y, c_custkey * 29 % 256 as k from customer")
    return planes.select("c_custkey", *(inked(F.col(ink), F.col("k")).alias(light) for ink, light in zip("cmy", "rgb")))


@own("png_header_size", "select fileid, width, height from img_files")
def png_header_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width and height out of the first bytes of PNG data."""
    files = fixture(spark, sf_dir, "img_files")
    head = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex("width"), 8, "0"), F.lpad(F.hex("height"), 8, "0"), F.lit("0802000000")))
    raw = files.select("fileid", head.alias("data"))
    number = lambda at: F.conv(F.hex(F.substring("data", at, 4)), 16, 10).cast("int")
    return raw.where(F.hex(F.substring("data", 1, 8)) == "89504E470D0A1A0A").select("fileid", number(17).alias("width"), number(21).alias("height"))


_IMAGE = "concat('(image (url \"file:///', cast(fileid as string), '.png\") (pos ', cast(cast(floor(l) as bigint) as string), ' ', cast(cast(floor(t) as bigint) as string), ') (scale 1))')"


@own("workspace_serialize", f"select cast(ord ~/ 10 as bigint) as sheet, concat('(workspace (images ', string_agg({_IMAGE}, ' ' order by ord), '))') as body from img_rects group by ord ~/ 10")
def workspace_serialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = run(spark, sf_dir, f"select cast(ord ~/ 10 as bigint) as sheet, ord, {_IMAGE} as image from img_rects")
    ordered = images.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("ord", "image"))).alias("i"))
    return ordered.select("sheet", F.concat(F.lit("(workspace (images "), F.array_join("i.image", " "), F.lit("))")).alias("body"))


_BODY = "select page_id, concat('(workspace (images (image (url \"file:///', cast(page_id as string), '.png\") (pos ', cast(page_id * 3 as string), ' -', cast(page_id as string), ') (scale 2)) (image (url \"', url, '\") (pos 0 1) (scale 1))))') as body from pages"
same(
    "workspace_parse",
    f"""with b as ({_BODY}), n as (select page_id, body, [[2 : 3]] as i from b), p as (select page_id, cast(i as int) - 1 as ord, split_part(body, '(image ', cast(i as int)) as part from n)
select page_id, cast(ord as int) as ord, regexp_extract(part, 'url "([^"]*)"', 1) as url, cast(regexp_extract(part, 'pos (-?[0-9]+) ', 1) as double) as x, cast(regexp_extract(part, 'pos -?[0-9]+ (-?[0-9]+)', 1) as double) as y, cast(regexp_extract(part, 'scale ([0-9]+)', 1) as double) as scale from p""",
)


_HEX3 = "lpad(lower(to_hex({})), 3, '0')"


@own("tile_path_encode", f"select rowid, concat({_HEX3.format('(fileid >> 24) & 4095')}, '/', {_HEX3.format('(fileid >> 12) & 4095')}, '/', {_HEX3.format('fileid & 4095')}, '/tile-', lpad(cast(scale as varchar), 3, '0'), '-', lpad(cast(x as varchar), 3, '0'), '-', lpad(cast(y as varchar), 3, '0'), case format when 0 then '.jpg' else '.png' end) as path from img_tiles")
def tile_path_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "img_tiles").select("rowid", tile_path().alias("path"))


def tile_path() -> F.Column:
    """The path of a tile in a file tree: the low 36 bits of the id in three groups, then scale and place."""
    group = lambda shift: F.shiftright("fileid", shift).bitwiseAND(F.lit(4095))
    return F.format_string("%03x/%03x/%03x/tile-%03d-%03d-%03d.%s", group(24), group(12), group(0), "scale", "x", "y", F.when(F.col("format") == 0, "jpg").otherwise("png"))


@own("tile_path_parse", "select rowid, fileid, scale, x, y, format from img_tiles")
def tile_path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = r"^([0-9a-f]{3})/([0-9a-f]{3})/([0-9a-f]{3})/tile-([0-9]+)-([0-9]+)-([0-9]+)\.(jpg|png)$"
    part = lambda n: F.regexp_extract("path", pattern, n)
    id_ = F.conv(F.concat(part(1), part(2), part(3)), 16, 10).cast("long")
    paths = fixture(spark, sf_dir, "img_tiles").select("rowid", tile_path().alias("path"))
    return paths.select("rowid", id_.alias("fileid"), part(4).cast("int").alias("scale"), part(5).cast("int").alias("x"), part(6).cast("int").alias("y"), F.when(part(7) == "jpg", 0).otherwise(1).alias("format"))


same("export_plan", f"with s as (select fileid, width, height, least({halvings('width', '512')}, {halvings('height', '512')}) as scale from img_files), z as (select fileid, scale, cast(width ~/ pow2(cast(scale as int)) as bigint) as w, cast(height ~/ pow2(cast(scale as int)) as bigint) as h from s), x as (select *, [[0 : (w + 255) ~/ 256 - 1]] as tx from z), y as (select *, [[0 : (h + 255) ~/ 256 - 1]] as ty from x) select y.fileid, cast(y.scale as int) as scale, cast(tx as bigint) as tx, cast(ty as bigint) as ty, cast(tx * 256 as bigint) as px, cast(ty * 256 as bigint) as py, t.rowid from y left join (select fileid, scale, x, y, min(rowid) as rowid from img_tiles group by fileid, scale, x, y) t on t.fileid = y.fileid and t.scale = y.scale and t.x = tx and t.y = ty")
