"""Operator 8: license scan as an exact set-similarity join (native)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import table, written

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices as they stand in sources, in words; the label each adds; the tokens that tell
#: it from its likes, which a block must hold.  Fixed values.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "compliance obtain"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "program general"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lesser"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "affero"),
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "granted charge"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "nc"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "sharealike"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived neighboring"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution binary"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "fee granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "authors arising"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
]
THRESHOLD = 0.8
WHOLE = 12  # tokens; templates of fewer must be held whole, as one word there tells licenses apart
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words, lower-cased in A-Z and joined by one blank: ' a b ', or ' ' for none.
    ``lower`` is the fast way; the Kelvin sign, which it would make an ASCII k, is
    set aside before (it is a word character in any case)."""
    return F.regexp_replace(F.lower(F.replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), F.lit("K"), F.lit("µ"))), SEPARATORS, " ")


def blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" ")))


def _base(padded: Column) -> dict[str, Column]:
    """Places of the phrases by string search; first and last by what stands around."""
    n_words = blanks(padded) - 1
    count, first, last, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        sought = F.lit(f" {phrase} ")
        there = F.contains(padded, sought)
        count.append(F.when(there, F.regexp_count(padded, F.lit(f" {phrase}(?= )"))).otherwise(0))
        first.append(F.when(there, blanks(F.substring_index(padded, f" {phrase} ", 1))))
        last.append(F.when(there, n_words - blanks(F.substring_index(padded, f" {phrase} ", -1)) - len(phrase.split())))
        labels.append(F.when(there, F.lit(label)))
    return {
        "n_words": n_words.cast("long"),
        "n_base": sum(count[1:], count[0]).cast("long"),
        "first_word": F.least(*first).cast("long"),
        "last_word": F.greatest(*last).cast("long"),
        "base": F.array_compact(F.array(*labels)),
    }


@dataclass(frozen=True)
class Template:
    label: str
    tokens: tuple[str, ...]
    required: tuple[str, ...]
    need: int  # tokens that a block holds at least
    run: int  # words in a block


def prepared(templates: list[tuple[str, str, str]], threshold: float) -> list[Template]:
    out = []
    for label, text, required in templates:
        tokens = tuple(sorted(set(text.split())))
        need = len(tokens) if len(tokens) < WHOLE else math.ceil(threshold * len(tokens) - 1e-9)
        out.append(Template(label, tokens, tuple(required.split()), need, math.ceil(len(text.split()) / threshold - 1e-9)))
    return out


def token_order(words: DataFrame, templates: list[Template]) -> list[str]:
    """The templates' tokens, rarest first by the number of texts that hold them (ties by
    name).  Counted over all rows of ``words``; at most one row a token returns."""
    vocab = sorted({w for t in templates for w in t.tokens})
    found = words.select(F.explode(F.array_intersect(F.lit(vocab), "words")).alias("w")).groupBy("w").count().collect()
    n = {r["w"]: r["count"] for r in found}
    return sorted(vocab, key=lambda w: (n.get(w, 0), w))


def candidates(texts: DataFrame, order: list[str], templates: list[Template]) -> DataFrame:
    """(row, template) of the texts whose ``held`` tokens contain enough of a template's.

    A template's prefix is its ``size - need + 1`` rarest tokens: a text with ``need``
    of its tokens holds one of these.  Prefix tokens of a text are joined to those of
    the templates (a constant table); then the text must hold ``need`` tokens (length),
    and enough of them from the common one on (position).  What is left is verified."""
    rank = {w: k for k, w in enumerate(order)}
    index = []
    for k, t in enumerate(templates):
        tokens = sorted(t.tokens, key=rank.get)
        index += [(w, k, i, t.need, tokens) for i, w in enumerate(tokens[: len(tokens) - t.need + 1])]
    index = texts.sparkSession.createDataFrame(index, "token string, template int, at int, need int, tokens array<string>")
    prefix = sorted({r for t in templates for r in sorted(t.tokens, key=rank.get)[: len(t.tokens) - t.need + 1]})
    probes = texts.select("row", "held", F.explode(F.array_intersect("held", F.lit(prefix))).alias("token"))
    pairs = probes.join(F.broadcast(index), "token").where(
        (F.size("held") >= F.col("need"))
        & (1 + F.least(F.size("tokens") - F.col("at") - 1, F.size("held") - F.array_position("held", F.col("token"))) >= F.col("need"))
    )
    return pairs.where(F.size(F.array_intersect("held", "tokens")) >= F.col("need")).select("row", "template").distinct()


def matches(texts: DataFrame, order: list[str], templates: list[Template]) -> DataFrame:
    """(row, label, containment) of the texts that hold a template in a block: a run of
    consecutive words, as long as the template divided by the threshold, wherever it
    stands and lines break.  Only the places of template tokens (``spots``) are looked
    at, each as the start of a block."""
    table_ = texts.sparkSession.createDataFrame([(k, t.label, t.need, t.run, list(t.tokens), list(t.required)) for k, t in enumerate(templates)], "template int, label string, need int, run int, tokens array<string>, required array<string>")
    able = candidates(texts, order, templates).join(texts.select("row", "spots"), "row").join(F.broadcast(table_), "template")
    at = able.select("row", "template", "label", "run", "need", F.size("tokens").alias("size"), "tokens", "required", F.explode("spots").alias("spot")).where(F.array_contains("tokens", F.col("spot.w")))
    at = at.select("*", F.col("spot.at").alias("at"))
    frame = W.partitionBy("row", "template").orderBy("at").rowsBetween(0, max(t.run for t in templates))
    near = F.collect_list("spot").over(frame)
    block = F.array_distinct(F.filter(near, lambda x: x["at"] < F.col("at") + F.col("run"))["w"])
    held = at.withColumn("block", block).where((F.size("block") >= F.col("need")) & (F.size(F.array_intersect("block", "required")) == F.size("required")))
    return held.groupBy("row", "template", "label").agg((F.max(F.size("block")) / F.max("size")).alias("containment")).drop("template")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.  Base:
    places where a phrase of ``PHRASES`` stands.  Added: labels of the templates that a
    block of the text contains to ``threshold`` (``matches``); short templates must be
    held whole.  ``score`` is 1 if there is a base label, else the best containment
    found, else 0.  Texts are read twice: for the order of tokens, and once more for
    all the rest, which is written without the texts.

    Nulls: a null text is empty (no words, no labels: empty strings); a null id is
    carried.  Repeated rows give one row each.  An empty table gives no rows; other
    columns are ignored.  Texts of any length are scanned whole.
    """
    asked = prepared(templates, threshold)
    padded = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("padded"))
    order = token_order(padded.select(F.split("padded", " ").alias("words")), asked)
    words = F.split(F.trim("padded"), " ")
    split = padded.select("doc_id", "padded", *(c.alias(n) for n, c in _base(F.col("padded")).items()), words.alias("words"))
    held = split.select("*", F.array_intersect(F.lit(order), "words").alias("held"))
    able = F.size("held") >= min(t.need for t in asked)
    places = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("w"))), lambda x: F.array_contains(F.lit(order), x["w"]))
    kept = held.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base", F.when(able, F.col("held")).alias("held"), F.when(able, places).alias("spots"), F.monotonically_increasing_id().alias("row"))
    kept = written(kept)
    found = matches(kept.where("held is not null").select("row", "held", "spots"), order, asked).groupBy("row").agg(F.collect_set("label").alias("added"), F.max("containment").alias("best"))
    both = kept.drop("held", "spots").join(found, "row", "left")
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return both.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        join(F.col("base")).alias("base_labels"),
        join(F.concat("base", F.coalesce("added", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    seps = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = lambda x: f"list_filter(string_split(regexp_replace({low(x)}, '{seps}', ' ', 'g'), ' '), lambda w: w <> '')"
    phrases = ", ".join(f"('{label}', {phrase.split()!r})" for phrase, label in PHRASES.items())
    templates = ", ".join(f"({k}, '{t.label}', {t.need}, {t.run}, {list(t.tokens)!r}, {list(t.required)!r})" for k, t in enumerate(prepared(TEMPLATES, THRESHOLD)))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, {words("text")} AS w FROM d),
p(label, q) AS (VALUES {phrases}),
b AS (SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1] = q[1] AND w[(i + 1):(i + len(q))] = q)) AS pos FROM w, p),
base AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM b GROUP BY r),
t(k, label, need, run, tokens, required) AS (VALUES {templates}),
able AS (SELECT r, k, label, need, run, tokens, required, w FROM w, t WHERE len(list_intersect(tokens, w)) >= need),
spot AS (SELECT r, k, pos, w[pos] AS x FROM (SELECT r, k, w, unnest(list_filter(range(1, len(w) + 1), lambda i: list_contains(tokens, w[i]))) AS pos FROM able)),
blocks AS (SELECT a.r, a.k, a.pos, list(DISTINCT b.x) AS block FROM spot a JOIN t USING (k) JOIN spot b ON a.r = b.r AND a.k = b.k AND b.pos >= a.pos AND b.pos < a.pos + run GROUP BY a.r, a.k, a.pos),
c AS (SELECT r, label, len(block) / len(tokens)::DOUBLE AS part FROM blocks JOIN t USING (k) WHERE len(block) >= need AND list_has_all(block, required)),
m AS (SELECT r, list(DISTINCT label) AS added, max(part) AS best FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(added, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN m USING (r)"""


QUERIES = {"op8_license_set_join": op8}
ORACLE_SQL = {"op8_license_set_join": _sql()}
