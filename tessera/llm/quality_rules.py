"""Quality rules with adaptive thresholds from mergeable quantile sketches, in DataFrame and SQL functions alone.

Each document has four statistics in whole units: symbols and repeated words for 1000 words, repeated lines for 1000 lines
with a word, and hundredths of a code point of mean word length. Documents that pass the fixed base rules feed a sketch for
each (lang, source): the number of documents in each unit, which merges by addition, gives the same result in any order, and
is off by less than one unit. Sketches of a language, and of all, are sums of those. A group with fewer than ``least``
documents uses its language's, and a language with fewer that of all.

The thresholds are fences, q75 + reach * (q75 - q25) + slack; for mean word length also below q25. A joined filter then
keeps a document whose statistics lie within its group's fences.

Nulls: a null text has no words and fails the base; null lang or source are groups of their own. Repeated rows count each.
Further columns are not read. Of a text with repeated windows, places are found by sorting, so no text is too long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize

#: statistic -> (slack above, slack below or None)
SLACK = {"symbols": (60, None), "repeats": (300, None), "dup_lines": (400, None), "word_length": (100, 100)}
REACH, LEAST, MIN_WORDS = 3, 40, 50

_WORD = r"[^\\x20\\x09-\\x0D]+"


def base_counts(docs: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of each row of docs(doc_id, text, lang, source)."""
    one = docs.selectExpr("doc_id", "lang", "source", "coalesce(text, '') as text")
    two = one.selectExpr(
        "doc_id", "lang", "source",
        f"regexp_extract_all(text, '{_WORD}', 0) as words",
        "length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols",
        "length(translate(text, ' \\t\\n\\u000b\\u000c\\r', '')) as word_chars",
        "filter(split(text, '\\n', -1), x -> length(translate(x, ' \\t\\n\\u000b\\u000c\\r', '')) > 0) as lines",
    )
    three = two.selectExpr(
        "doc_id", "lang", "source", "size(words) as n_words", "word_chars", "n_symbols", "size(lines) as n_lines",
        "size(lines) - size(array_distinct(lines)) as n_dup_lines",
        "case when size(words) < 3 then cast(array() as array<bigint>) else transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) end as hashes",
    )
    four = three.selectExpr("*", "case when size(array_distinct(hashes)) < size(hashes) then sort_array(hashes) else cast(array() as array<bigint>) end as ordered")
    five = four.selectExpr("*", "array_distinct(filter(ordered, (x, i) -> i > 0 and x = ordered[i - 1])) as twice").drop("ordered")
    # few hashes occur twice: look each window up; many: sort the windows with their places
    six = five.selectExpr(
        "*",
        "case when size(twice) between 1 and 64 then filter(sequence(0, size(hashes) - 1), i -> array_contains(twice, hashes[i])) end as places",
        "case when size(twice) > 64 then sort_array(transform(hashes, (h, i) -> named_struct('h', h, 'i', i))) end as pairs",
    ).drop("hashes", "twice")
    seven = six.withColumn("places", F.expr("coalesce(places, sort_array(transform(filter(pairs, (p, i) -> (i > 0 and pairs[i - 1].h = p.h) or (i < size(pairs) - 1 and pairs[i + 1].h = p.h)), p -> p.i)), cast(array() as array<int>))")).drop("pairs")
    return seven.selectExpr(
        "doc_id", "lang", "source",
        *(f"cast({c} as bigint) as {c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")),
        "aggregate(transform(places, (p, i) -> case when i = 0 then 3L else cast(least(3, p - places[i - 1]) as bigint) end), 0L, (a, x) -> a + x) as n_repeat_words",
        "cast(n_lines as bigint) as n_lines",
    )


#: The statistics in whole units; the same in either SQL but for the sign of whole division.
UNITS = {
    "symbols": "1000 * n_symbols {div} n_words",
    "repeats": "1000 * n_repeat_words {div} n_words",
    "dup_lines": "1000 * n_dup_lines {div} n_lines",
    "word_length": "100 * word_chars {div} n_words",
}


def apply_rules(docs: DataFrame, reach: int = REACH, least: int = LEAST, slack: dict = SLACK) -> DataFrame:
    """The base counts of each row, base_failed, the fences' verdict on each statistic, and kept."""
    counts = base_counts(docs).withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words"))
    counts = materialize(counts.select("*", *(F.expr(f"case when n_words > 0 then {x.format(div='div')} end").alias(f"u_{n}") for n, x in UNITS.items())))
    stats = ", ".join(f"'{n}', u_{n}" for n in UNITS)
    bins = counts.where("not base_failed").selectExpr("lang", "source", f"stack({len(UNITS)}, {stats}) as (stat, unit)").groupBy("lang", "source", "stat", "unit").agg(F.count("*").alias("n"))
    bins = materialize(bins)  # one row for each unit in use
    fences = None
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        merged = bins if level == 0 else bins.groupBy(*keys, "stat", "unit").agg(F.sum("n").alias("n"))
        over = ", ".join([*keys, "stat"])
        ranked = merged.selectExpr("*", f"sum(n) over (partition by {over} order by unit) as upto", f"sum(n) over (partition by {over}) as total")
        found = ranked.groupBy(*keys, "stat").agg(F.max("total").alias("total"), F.expr("min(unit) filter (where 4 * upto >= total)").alias("q25"), F.expr("min(unit) filter (where 4 * upto >= 3 * total)").alias("q75"))
        picks = []
        for stat in UNITS:
            up, down = slack[stat]
            mine = f"filter (where stat = '{stat}' and total >= {least if keys else 0})"
            picks.append(F.expr(f"max(q75 + {reach} * (q75 - q25) + {up}) {mine}").alias(f"hi{level}_{stat}"))
            if down is not None:
                picks.append(F.expr(f"max(q25 - {reach} * (q75 - q25) - {down}) {mine}").alias(f"lo{level}_{stat}"))
        fences = (fences or []) + [(keys, found.groupBy(*keys).agg(*picks))]
    out = counts
    for keys, table in fences:
        named = table.select(*(F.col(k).alias(f"k_{k}") for k in keys), *(c for c in table.columns if c not in keys))
        if keys:
            condition = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys]
            out = out.join(named, condition, "left").drop(*(f"k_{k}" for k in keys))
        else:
            out = out.join(F.broadcast(named), F.lit(True), "left")  # one row
    within = []
    for stat, (_, down) in slack.items():
        high = f"coalesce(hi0_{stat}, hi1_{stat}, hi2_{stat})"
        low = f" and u_{stat} >= coalesce(lo0_{stat}, lo1_{stat}, lo2_{stat})" if down is not None else ""
        out = out.withColumn(f"ok_{stat}", F.expr(f"coalesce(u_{stat} <= {high}{low}, false)"))
        within.append(f"ok_{stat}")
    return out.withColumn("kept", F.expr("not base_failed and " + " and ".join(within)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    white = r"[\x20\x09-\x0D]"
    units = ", ".join(f"case when n_words > 0 then {x.format(div='//')} end as u_{n}" for n, x in UNITS.items())
    bins = " union all ".join(f"select lang, source, '{n}' as stat, u_{n} as unit, count(*) as n from u where not base_failed group by all" for n in UNITS)
    levels, picks, joins = [], [], []
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        by, over = "".join(f"{k}, " for k in keys), ", ".join([*keys, "stat"])
        made = []
        for stat, (up, down) in SLACK.items():
            mine = f"filter (where stat = '{stat}' and total >= {LEAST if keys else 0})"
            made.append(f"max(q75 + {REACH} * (q75 - q25) + {up}) {mine} as hi{level}_{stat}")
            if down is not None:
                made.append(f"max(q25 - {REACH} * (q75 - q25) - {down}) {mine} as lo{level}_{stat}")
        levels.append(f"""m{level} as (select {by} stat, unit, sum(n) as n from bins group by all),
r{level} as (select *, sum(n) over (partition by {over} order by unit) as upto, sum(n) over (partition by {over}) as total from m{level}),
q{level} as (select {by} stat, max(total) as total, min(unit) filter (where 4 * upto >= total) as q25, min(unit) filter (where 4 * upto >= 3 * total) as q75 from r{level} group by all),
f{level} as (select {by} {", ".join(made)} from q{level} {"group by " + ", ".join(keys) if keys else ""})""")
        on = " and ".join(f"u.{k} is not distinct from f{level}.{k}" for k in keys) or "true"
        joins.append(f"left join f{level} on {on}")
    for stat, (_, down) in SLACK.items():
        picks.append(f"coalesce(u_{stat} <= coalesce(hi0_{stat}, hi1_{stat}, hi2_{stat}), false)")
        if down is not None:
            picks.append(f"coalesce(u_{stat} >= coalesce(lo0_{stat}, lo1_{stat}, lo2_{stat}), false)")
    return f"""
with d as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words from d),
t as (select rid, unnest(range(1, len(words) - 1)) as i, words from w where len(words) >= 3),
g as (select rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as gram from t),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, gram) as c from g) where c > 1),
cov as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from rep) group by rid),
l as (select rid, unnest(string_split(text, chr(10))) as line from d),
dl as (select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by rid),
b as (select d.rid, doc_id, lang, source, cast(len(words) as bigint) as n_words,
  cast(length(regexp_replace(text, '{white}', '', 'g')) as bigint) as word_chars,
  cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(coalesce(n_dup, 0) as bigint) as n_dup_lines, cast(coalesce(cov.n, 0) as bigint) as n_repeat_words, cast(coalesce(n_lines, 0) as bigint) as n_lines
  from d join w on d.rid = w.rid left join cov on d.rid = cov.rid left join dl on d.rid = dl.rid),
u as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed, {units} from b),
bins as ({bins}),
{", ".join(levels)}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {" and ".join(picks)} as kept
from u {" ".join(joins)}
"""


SQL = _sql()
