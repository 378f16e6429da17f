"""License scans: an exact set-similarity join of text blocks with templates.

A block is a line that has a word and the lines after it that begin within BLOCK
words of its end: so it holds any notice that begins in its first line, however
long that line is and however the notice is wrapped. Tokens are ordered by how many documents hold them, rarest
first. A template of n words is contained in a block to the threshold t if they
share o = ceil(t n) words; then one of the template's first n - o + 1 words (its
prefix) is among the block's first words. So blocks and templates are joined on
prefix words, the block's length and the two words' positions discard pairs that
can't share o words any more, and what is left is verified. Words that are in no
template can't be shared and are left out of the blocks.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.storage import save

#: Fixed values of the base scan: phrase and label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices by which licenses are told.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: Words behind a block's first line from which on it takes no further line; more than any template has.
BLOCK = 60

_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _words_pattern(alternatives: list[str]) -> str:
    """Whole words (or phrases, their words apart by what is no word), A-Z like a-z."""
    parts = [f"{_GAP}+".join(x.split()) for x in sorted(alternatives, key=lambda x: (-len(x), x))]
    return f"(?i)(?<!{_WORD})(?:{'|'.join(parts)})(?!{_WORD})"


def _n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{_WORD}+"))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _base(text: Column, n_words: Column, n_places: dict[str, Column]) -> list[Column]:
    """first_word, last_word and base_labels from the phrases' numbers of places."""
    firsts, lasts, labels = [], [], []
    for phrase, label in PHRASES.items():
        found = n_places[phrase] > 0
        gaps = F.split(text, _words_pattern([phrase]), -1)
        firsts.append(F.when(found, _n_words(F.element_at(gaps, 1))))
        lasts.append(F.when(found, n_words - _n_words(F.element_at(gaps, -1)) - len(phrase.split())))
        labels.append(F.when(found, F.lit(label)))
    return [
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"),
    ]


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.85) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    Base columns tell where the fixed phrases stand, words counted from 0. labels
    adds those of templates that some block of lines contains to the threshold (the
    share of the template's distinct words that it has); score is 1 where a phrase
    stands, else the largest such share, else 0. A null text counts as empty, a
    repeated row is a document of its own.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    wordsets = [(label, sorted({*text.split()})) for label, text in templates]
    vocabulary = sorted({w for _, words in wordsets for w in words})
    any_word = _words_pattern(vocabulary)

    seen = F.array_distinct(F.transform(_all(F.col("text"), any_word), F.lower))
    counted = rows.select(F.explode(seen).alias("word")).groupBy("word").count().collect()  # a row for each template word at most
    frequency = {r.word: r["count"] for r in counted}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    sets = []
    for number, (label, words) in enumerate(wordsets):
        ranks, least = sorted(order[w] for w in words), math.ceil(threshold * len(words) - 1e-9)
        sets.append((number, label, ranks, least))
    by_rank = {i: w for w, i in order.items()}
    prefixes = sorted({by_rank[r] for _, _, ranks, least in sets for r in ranks[: len(ranks) - least + 1]})

    rank_of = F.create_map(*(F.lit(x) for w, i in order.items() for x in (w, i)))
    ranks_of = lambda line: F.array_sort(F.array_distinct(F.transform(_all(line, any_word), lambda w: F.element_at(rank_of, F.lower(w)))))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(_WORD))
    told = F.transform(lines, lambda line: F.struct(_n_words(line).alias("n"), ranks_of(line).alias("ranks")))
    text, none = F.col("text"), F.array().cast("array<struct<n:int,ranks:array<int>>>")
    # The phrases have these words, and blocks that can match have a prefix word.
    promising, likely = text.rlike(_words_pattern(prefixes)), text.rlike(_words_pattern([*prefixes, "license", "nc"]))
    first = rows.select("doc_id", "text", _n_words(text).alias("n_words"), likely.alias("likely"), (likely & promising).alias("promising"))
    counts = {p: F.when(F.col("likely"), F.regexp_count(text, F.lit(_words_pattern([p])))).otherwise(0) for p in PHRASES}
    first = first.select("doc_id", "text", "n_words", F.when(F.col("promising"), told).otherwise(none).alias("lines"), *(c.alias(f"places_{i}") for i, c in enumerate(counts.values())))
    places = {p: F.col(f"places_{i}") for i, p in enumerate(PHRASES)}
    n_base = sum(places.values(), F.lit(0)).cast("long").alias("n_base")
    found = first.select(F.monotonically_increasing_id().alias("at"), "doc_id", F.col("n_words").cast("long").alias("n_words"), n_base, *_base(text, F.col("n_words"), places), "lines")
    found = save(found, "licenses")

    index = spark.createDataFrame(
        [(r, number, label, i, len(ranks), least, ranks) for number, label, ranks, least in sets for i, r in enumerate(ranks[: len(ranks) - least + 1])],
        "rank int, template int, label string, i int, size int, least int, ranks array<int>",
    )
    smallest = min((least for *_, least in sets), default=1)
    long_enough = F.size("block") >= smallest
    # Within a document, lines by the number of words ahead of them; a promising document's lines are few.
    ahead = Window.partitionBy("at").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy("at").orderBy("ahead").rangeBetween(Window.currentRow, BLOCK - 1)
    parts = found.filter(F.size("lines") > 0).select("at", F.posexplode("lines").alias("line", "x"))
    parts = parts.select("at", "line", F.col("x.ranks").alias("ranks"), F.coalesce(F.sum("x.n").over(ahead), F.lit(0)).alias("ahead"))
    parts = parts.select("at", "line", "ahead", "ranks", F.array_distinct(F.flatten(F.collect_list("ranks").over(onward))).alias("onward"))
    behind = F.lead("onward").over(Window.partitionBy("at").orderBy("ahead"))  # what begins within BLOCK words of the line's end
    parts = parts.select("at", "line", F.array_sort(F.array_union("ranks", F.coalesce(behind, F.array().cast("array<int>")))).alias("block")).filter(long_enough)
    parts = parts.select("at", "line", "block", F.posexplode(F.slice("block", F.lit(1), F.size("block") - smallest + 1)).alias("j", "rank"))
    pairs = parts.join(F.broadcast(index), "rank")  # the templates are a parameter
    pairs = pairs.filter((F.size("block") >= F.col("least")) & (1 + F.least(F.col("size") - F.col("i") - 1, F.size("block") - F.col("j") - 1) >= F.col("least")))
    shared = F.size(F.array_intersect("block", "ranks"))
    pairs = pairs.select("at", "label", "least", "size", shared.alias("shared")).filter(F.col("shared") >= F.col("least"))
    matches = pairs.groupBy("at").agg(F.collect_set("label").alias("more"), F.max(F.col("shared") / F.col("size")).alias("best"))
    out = found.drop("lines").join(matches, "at", "left")
    empty = F.array().cast("array<string>")
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", empty)))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    templates = ", ".join(f"({i}, '{label}', {sorted({*text.split()})!r})" for i, (label, text) in enumerate(TEMPLATES))
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items())
    return rf"""
WITH t AS (SELECT row_number() OVER () AS doc_key, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc_key, doc_id, text, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM t),
e AS (SELECT doc_key, words, unnest(range(len(words))) AS i FROM w),
p(phrase, label) AS (VALUES {phrases}),
b AS (SELECT doc_key, i, label FROM e JOIN p ON words[i + 1 : i + len(phrase)] = phrase),
base AS (SELECT doc_key, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_distinct(list(label)) AS labels FROM b GROUP BY doc_key),
tpl(n, label, tokens) AS (VALUES {templates}),
r AS (SELECT doc_key, string_split(text, chr(10)) AS lines FROM w),
l AS (SELECT doc_key, unnest(range(len(lines))) AS i, regexp_extract_all(unnest(lines), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM r),
c AS (SELECT doc_key, i, words, coalesce(sum(len(words)) OVER (PARTITION BY doc_key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM l WHERE len(words) > 0),
n AS (SELECT doc_key, i, words, flatten(list(words) OVER (PARTITION BY doc_key ORDER BY ahead RANGE BETWEEN CURRENT ROW AND {BLOCK - 1} FOLLOWING)) AS onward FROM c),
k AS (SELECT doc_key, list_distinct(list_concat(words, coalesce(lead(onward) OVER (PARTITION BY doc_key ORDER BY i), []))) AS words FROM n),
m AS (SELECT doc_key, label, len(list_intersect(tokens, words)) AS shared, len(tokens) AS size FROM k JOIN tpl ON true),
h AS (SELECT doc_key, list_distinct(list(label)) AS labels, max(shared / size) AS best FROM m WHERE shared >= ceil(0.85 * size - 1e-9) GROUP BY doc_key)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(h.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_key) LEFT JOIN h USING (doc_key)
"""


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLES = {"op4_license_scan": _oracle()}
