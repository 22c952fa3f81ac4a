"""License scans by diagonal voting, in DataFrame and SQL functions alone.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. The hash of every rolling three-word gram
of a document is joined to the places of that gram in the templates (a fixed table of some hundred rows, so it is broadcast;
the join also compares the gram itself). Each hit votes for the diagonal document place - template place. Votes are counted
by document, template and diagonal; diagonals of one template at most ``gap`` apart are merged, which bridges inserted and
deleted words; and a merged span is verified: different places of the template found, in tenths of its grams, and its length against
the template's.

A phrase's diagonal with all of its grams is an exact place of the phrase. Notices need ``share`` tenths of their grams.
The score is the largest share of a template's grams that was found (1.0 for a whole phrase or notice).

Documents with fewer than three words have no grams; null and empty texts have no words, no labels and score 0.0. Each row
counts by itself, so that repeated rows and null ids each give a row. Votes of one document meet in one group, which its own
length bounds; nothing is grouped by template or gram. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

# The phrases of the contract.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
# Well-known notices of public licences, as words.
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-3": "licensed under the gnu general public license version 3",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
K, GAP, SHARE = 3, 3, 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_rows(phrases: dict[str, str], notices: dict[str, str]) -> list[tuple]:
    """(template, label, exact, grams of the template, place, gram)"""
    rows = []
    for n, (exact, label, text) in enumerate([(True, *x) for x in phrases.items()] + [(False, *x) for x in notices.items()]):
        words = text.split(" ")
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {text!r}")
        rows += [(n, label, exact, len(words) - K + 1, i, " ".join(words[i : i + K])) for i in range(len(words) - K + 1)]
    return rows


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, gap: int = GAP, share: int = SHARE) -> DataFrame:
    """One row for each row of docs(doc_id, text): words, places of the phrases, labels and score."""
    spark = docs.sparkSession
    values = ", ".join(f"({n}, '{label}', {str(exact).lower()}, {grams}, {at}, '{gram}')" for n, label, exact, grams, at, gram in template_rows(phrases, notices))
    table = spark.sql(f"select template, label, exact, grams, at, gram as t_gram, xxhash64(gram) as t_hash from values {values} as t(template, label, exact, grams, at, gram)")
    words = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("text")).selectExpr(
        "rid", "doc_id", r"regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', 0) as words"
    )
    grams = words.selectExpr(
        "rid", "doc_id", "cast(size(words) as bigint) as n_words",
        # the first element stands for the document itself
        f"posexplode(concat(array(cast(null as string)), case when size(words) < {K} then cast(array() as array<string>) else transform(sequence(0, size(words) - {K}), i -> concat_ws(' ', words[i], words[i + 1], words[i + 2])) end)) as (place, gram)",
    )
    hits = grams.join(F.broadcast(table), (F.xxhash64("gram") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")), "left").where("place = 0 or template is not null")
    by_doc = ["rid", "doc_id", "n_words"]
    diagonals = hits.groupBy(*by_doc, "template", "label", "exact", "grams", F.expr("cast(place - 1 - at as bigint)").alias("diagonal")).agg(F.count("template").alias("votes"), F.collect_set("at").alias("ats"), F.min("place").alias("low"), F.max("place").alias("high"))
    merged = (
        diagonals.withColumn("apart", F.expr(f"coalesce(diagonal - lag(diagonal) over (partition by rid, template order by diagonal) > {gap}, true)"))
        .withColumn("span", F.expr("sum(cast(apart as int)) over (partition by rid, template order by diagonal)"))
        .groupBy(*by_doc, "template", "label", "exact", "grams", "span")
        .agg(F.expr("size(array_distinct(flatten(collect_list(ats))))").cast("long").alias("found"), F.min("low").alias("low"), F.max("high").alias("high"), F.expr("count(case when exact and votes = grams then 1 end)").alias("places"), F.expr("min(case when exact and votes = grams then diagonal end)").alias("first_place"), F.expr("max(case when exact and votes = grams then diagonal end)").alias("last_place"))
        .withColumn("verified", F.expr(f"case when exact then places > 0 else 10 * found >= {share} * grams and 2 * (high - low + {K}) <= 3 * (grams + {K - 1}) end"))
    )
    return merged.groupBy(*by_doc).agg(
        F.sum("places").alias("n_base"),
        F.min("first_place").alias("first_word"),
        F.max("last_place").alias("last_word"),
        F.expr("array_join(array_sort(collect_set(case when places > 0 then label end)), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(collect_set(case when verified then label end)), ',')").alias("labels"),
        F.expr("coalesce(max(case when not exact or places > 0 then cast(found as double) / cast(grams as double) end), 0D)").alias("score"),
    )


OUT = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).select(*OUT)


def _sql() -> str:
    values = ", ".join(f"({n}, '{label}', {str(exact).lower()}, {grams}, {at}, '{gram}')" for n, label, exact, grams, at, gram in template_rows(PHRASES, NOTICES))
    return f"""
with t(template, label, exact, grams, t_at, t_gram) as (values {values}),
w as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents),
n as (select rid, doc_id, cast(len(words) as bigint) as n_words from w),
g as (select rid, unnest(range(0, len(words) - {K - 1})) as place, words from w where len(words) >= {K}),
h as (select rid, place, template, label, exact, grams, t_at, place - t_at as diagonal from g join t on words[place + 1] || ' ' || words[place + 2] || ' ' || words[place + 3] = t_gram),
d as (select rid, template, label, exact, grams, diagonal, count(*) as votes, list(t_at) as ats, min(place) as low, max(place) as high from h group by all),
a as (select *, coalesce(diagonal - lag(diagonal) over (partition by rid, template order by diagonal) > {GAP}, true) as apart from d),
s as (select *, sum(apart::int) over (partition by rid, template order by diagonal) as span from a),
m as (select rid, template, label, exact, grams, span, len(list_distinct(flatten(list(ats)))) as found, max(high) - min(low) + {K} as len,
  count(*) filter (where exact and votes = grams) as places, min(diagonal) filter (where exact and votes = grams) as first_place, max(diagonal) filter (where exact and votes = grams) as last_place from s group by rid, template, label, exact, grams, span),
v as (select *, case when exact then places > 0 else 10 * found >= {SHARE} * grams and 2 * len <= 3 * (grams + {K - 1}) end as verified from m)
select n.doc_id, n.n_words, cast(coalesce(sum(places), 0) as bigint) as n_base, cast(min(first_place) as bigint) as first_word, cast(max(last_place) as bigint) as last_word,
  coalesce(array_to_string(list_sort(list_distinct(list(label) filter (where places > 0))), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list(label) filter (where verified))), ','), '') as labels,
  coalesce(max(case when not exact or places > 0 then found::double / grams::double end), 0.0::double) as score
from n left join v on n.rid = v.rid group by n.rid, n.doc_id, n.n_words
"""


SQL = _sql()
