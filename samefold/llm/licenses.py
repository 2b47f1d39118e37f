"""License scans as an exact set-similarity join, in DataFrame functions only.

A block is a line of a text, or what stands around a line break: for a template of n words the n - 1
words on each side, wherever other lines begin and end, so a wrapped notice lies whole in the block
of any break within it. A block's tokens are its distinct words. A template is found in a block that
holds at least `THRESHOLD` of the template's tokens. Tokens are ordered by how often they occur in
the whole corpus, rarest first. A template T needs a = ceil(THRESHOLD * |T|) common tokens, so:
- prefix: one of T's first |T| - a + 1 tokens is in the block; only these are indexed;
- length: the block has at least a tokens that any template uses (other tokens can't match);
- position: with a match at i in T and j in the block, min(i, j) + 1 + min(tokens after i, after j)
  is at least a.
What passes is verified by intersecting the sets. The index is made from the fixed templates below,
so its size is known and it is broadcast. Blocks without a prefix token never leave their row.

Words: A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Null texts have no words, empty labels
and score 0. Every row of documents gives one row, repeated ones too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samefold.llm.common import documents

THRESHOLD = 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases and their labels.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: Openings of well-known public notices, in words.
TEMPLATES: list[tuple[str, str]] = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

_APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """Words with one blank before, between and after; A-Z may still be upper case."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, _APART, " ")), F.lit(" "))


def exact_words(text: Column) -> Column:
    return F.split(F.trim(F.translate(F.regexp_replace(text, _APART, " "), UPPER, LOWER)), " ")


def needed(size: int, threshold: float = THRESHOLD) -> int:
    return math.ceil(threshold * size - 1e-9)


def frequencies(docs: DataFrame, vocab: list[str]) -> dict[str, int]:
    """How often each word of the templates occurs in all texts: one row for each at most."""
    words = docs.select(F.explode(F.split(F.lower(spaced(F.col("text"))), " ")).alias("w"))
    return {r.w: r.n for r in words.where(F.col("w").isin(vocab)).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sets = [(label, set(text.split())) for label, text in templates]
    reach = [len(text.split()) - 1 for _, text in templates]
    vocab = sorted(set().union(*(s for _, s in sets)))
    count = frequencies(docs, vocab)
    rank = {w: k for k, w in enumerate(sorted(vocab, key=lambda w: (count.get(w, 0), w)))}
    index = []
    for (label, words), near in zip(sets, reach, strict=True):
        order = sorted(rank[w] for w in words)
        a = needed(len(order), threshold)
        index += [(r, i, order, a, label, near) for i, r in enumerate(order[: len(order) - a + 1])]
    prefix = sorted({r[0] for r in index})
    rare = [w for w in vocab if rank[w] in set(prefix)]
    least = min(r[3] for r in index)
    table = F.broadcast(spark.createDataFrame(index, "r int, i int, tokens array<int>, a int, label string, near int"))

    # one pass over each text; the rest looks only at rows that may hold something
    text = F.coalesce("text", F.lit(""))
    plain = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), spaced(text).alias("s"))
    low = plain.withColumn("low", F.lower("s"))  # lower() also folds other letters: only a sieve
    maybe = F.lit(False)
    for p in PHRASES.values():
        maybe = maybe | F.contains("low", F.lit(f" {p} "))
    blank = F.col("s") == "  "
    n_words = F.when(blank, F.lit(0)).otherwise(F.length("s") - F.length(F.replace("s", F.lit(" "), F.lit(""))) - 1).cast("long")
    hits = []
    for name, phrase in PHRASES.items():
        test = " AND ".join(f"get(ws, i + {k}) = '{w}'" for k, w in enumerate(phrase.split()))
        hits.append(f"transform(filter(sequence(0, size(ws) - 1), i -> {test}), i -> struct(i AS at, '{name}' AS label))")
    places = F.expr(f"concat({', '.join(hits)})")
    ranks = F.create_map(*(F.lit(x) for w in vocab for x in (w, rank[w])))
    held = lambda rs: F.array_sort(F.array_distinct(F.filter(rs, lambda r: r.isNotNull())))
    ranked = F.transform(F.split("text", "\n"), lambda x: F.transform(exact_words(x), lambda w: F.struct(F.try_element_at(ranks, w).alias("r"), (w == "").alias("no"))))
    # the ranks of each line's words, null for words of no template; lines without words have nothing to carry on
    lines = F.transform(F.filter(ranked, lambda ws: ~F.element_at(ws, 1)["no"]), lambda ws: F.transform(ws, lambda w: w["r"]))
    far = max(1, *reach)
    tail = lambda rs: F.slice(rs, F.greatest(F.lit(1), F.size(rs) - (far - 1)), F.lit(far))
    heads, tails = F.transform("lines", lambda rs: F.slice(rs, 1, far)), F.transform("lines", tail)
    left = lambda k: tail(F.flatten(F.slice(tails, F.greatest(F.lit(1), k - (far - 1)), F.least(k, F.lit(far)))))
    right = lambda k: F.slice(F.flatten(F.slice(heads, k + 1, F.lit(far))), 1, far)
    none = F.lit(None).cast("array<int>")
    own = F.transform("lines", lambda rs: F.struct(held(rs).alias("b"), none.alias("left"), none.alias("right")))
    breaks = F.when(F.size("lines") > 1, F.sequence(F.lit(1), F.size("lines") - 1)).otherwise(F.array().cast("array<int>"))
    sides = F.transform(breaks, lambda k: F.struct(left(k).alias("left"), right(k).alias("right")))
    around = F.transform(sides, lambda x: F.struct(held(F.concat(x["left"], x["right"])).alias("b"), x["left"].alias("left"), x["right"].alias("right")))
    rares = F.array(*map(F.lit, prefix))
    blocks = F.concat(F.filter(own, lambda x: F.size(x["b"]) >= least), F.filter(around, lambda x: (F.size(x["b"]) >= least) & F.arrays_overlap(x["b"], rares)))
    sieved = low.withColumns({
        "ws": F.when(maybe, exact_words(F.col("text"))),
        "lines": F.when(F.arrays_overlap(F.split("low", " "), F.array(*map(F.lit, rare))), lines),
        "n_words": n_words,
    }).select("rid", "doc_id", "n_words", F.when(F.col("ws").isNotNull(), places).alias("places"), F.when(F.col("lines").isNotNull(), blocks).alias("blocks"))

    tokens = sieved.select("*", F.explode_outer("blocks").alias("x")).select("rid", "doc_id", "n_words", "places", "x.*", F.posexplode_outer("x.b").alias("j", "r"))
    # an outer join: rows without a block, and blocks without a prefix token, stay for their document
    at, size_b = F.least("i", "j"), F.size("b")
    bound = at + 1 + F.least(F.size("tokens") - F.col("i") - 1, size_b - F.col("j") - 1)
    near = F.concat(F.slice("left", F.greatest(F.lit(1), F.size("left") - F.col("near") + 1), F.col("near")), F.slice("right", F.lit(1), F.col("near")))
    words = F.when(F.col("left").isNull(), F.col("b")).otherwise(near)
    found = tokens.join(table, "r", "left").withColumn("common", F.when((size_b >= F.col("a")) & (bound >= F.col("a")), F.size(F.array_intersect(words, "tokens"))))
    good = F.col("common") >= F.col("a")
    out = found.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("places").alias("places"),
        F.collect_set(F.when(good, F.col("label"))).alias("more"), F.max(F.when(good, F.col("common") / F.size("tokens"))).alias("best"),
    )
    ats = F.expr("transform(places, p -> p.at)")
    own = F.coalesce(F.expr("array_sort(array_distinct(transform(places, p -> p.label)))"), F.array().cast("array<string>"))
    n_base = F.coalesce(F.size("places"), F.lit(0))
    n_base = F.when(n_base > 0, n_base).otherwise(0).cast("long")
    return out.select(
        "doc_id", "n_words", n_base.alias("n_base"), F.array_min(ats).cast("long").alias("first_word"), F.array_max(ats).cast("long").alias("last_word"),
        F.array_join(own, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(own, "more")), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BASE = "\n  UNION ALL ".join(
    f"SELECT r, '{name}' AS label, i FROM p WHERE " + " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(phrase.split(), 1))
    for name, phrase in PHRASES.items()
)
_T = ", ".join(f"('{label}', {sorted(set(text.split()))!r}, {needed(len(set(text.split())))})" for label, text in TEMPLATES)
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LOWERED} AS low, regexp_extract_all({_LOWERED}, '{_WORD}') AS ws FROM documents),
p AS (SELECT r, ws, unnest(range(0, len(ws))) AS i FROM d),
base AS ({_BASE}),
bs AS (SELECT r, count(*)::BIGINT AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM base GROUP BY r),
t(label, ts, need) AS (VALUES {_T}),
lines AS (SELECT r, list_distinct(regexp_extract_all(unnest(string_split(low, chr(10))), '{_WORD}')) AS b FROM d),
m AS (SELECT r, label, len(list_intersect(b, ts)) / len(ts) AS s FROM lines, t WHERE len(list_intersect(b, ts)) >= need),
ms AS (SELECT r, max(s) AS s FROM m GROUP BY r),
al AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM (SELECT r, label FROM base UNION SELECT r, label FROM m) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(bs.n, 0)::BIGINT AS n_base, bs.a::BIGINT AS first_word, bs.z::BIGINT AS last_word,
  coalesce(bs.ls, '') AS base_labels, coalesce(al.ls, '') AS labels, CASE WHEN bs.n > 0 THEN 1.0 ELSE coalesce(ms.s, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN bs USING (r) LEFT JOIN ms USING (r) LEFT JOIN al USING (r)
"""
