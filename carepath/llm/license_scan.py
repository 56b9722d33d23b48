"""License scans as an exact set-similarity join, with DataFrame functions only.

Templates are sets of words. A block (WINDOW words of a text, one beginning at every STRIDE words,
across line ends, so that each notice lies whole in a block) matches a template when it holds at
least CONTAINED of the template's words and all of those that tell the licence from others. The
words of all templates are put in one order, by the number of documents that hold them over the
whole table, rarest first. Then a block that matches must hold one of a template's first
|T| - required + 1 words (prefix filter), must have enough words (length filter) and enough words
of the order left behind each shared one (positional filter); what is left is verified. Every
block that matches is found. Texts are cut once: that pass also cuts the blocks of those whose
words could meet a template at all.

Beside it, fixed phrases are found where their words stand consecutively.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import lower_ascii, stored

Template = tuple[str, str, str]

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Labels, notices as word sets, and the words without which a notice is another one's; a handful, so joins with them are broadcast.
TEMPLATES: tuple[Template, ...] = (
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "granted charge software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "fee granted software"),
    ("apache-2", "licensed under the apache license version 2 0", "apache 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org licenses license 2 0", "apache 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution binary"),
    ("bsd", "released under the bsd license", "bsd"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser"),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla 2"),
    ("public-domain", "this is free and unencumbered software released into the public domain", "public domain"),
)
#: Share of a template's words that a block must hold; words of a block, and from one block to the next: no template is longer than the difference.
CONTAINED, WINDOW, STRIDE = 0.8, 64, 32
#: Everything that is not part of a word, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _spaced(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with one space between them.

    `lower` also changes letters beyond ASCII, which matters to no phrase or template, except for
    the two that it turns into ASCII letters.
    """
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212A")), lower_ascii(text)).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(low, BETWEEN, " "))


def _n_words(spaced: Column) -> Column:
    return F.when(spaced == "", 0).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1).cast("long")


def _phrase(spaced: Column, n_words: Column, phrase: str) -> Column:
    """(places, first, last) of a phrase; no phrase can overlap itself."""
    size = len(phrase.split())
    wide = F.concat(F.lit(" "), F.replace(spaced, F.lit(" "), F.lit("  ")), F.lit(" "))
    parts = F.split(wide, " " + "  ".join(phrase.split()) + " ", -1)
    count = lambda s: F.regexp_count(s, F.lit("[^ ]+")).cast("long")
    found = F.struct((F.size(parts) - 1).cast("long").alias("n"), count(parts[0]).alias("first"), (n_words - count(F.element_at(parts, -1)) - size).alias("last"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    return F.when(F.contains(F.concat(F.lit(" "), spaced, F.lit(" ")), F.lit(f" {phrase} ")), found).otherwise(none)


def _need(t: str, contained: float) -> int:
    return ceil(contained * len(set(t.split())) - 1e-9)


def _passed(docs: DataFrame, id_col: str, text_col: str, templates: tuple[Template, ...], contained: float) -> DataFrame:
    """What one pass over the texts finds: the phrases, the vocabulary held, and the blocks (held, n) of texts that hold enough of a template."""
    key = F.xxhash64("text").alias("text_key")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = rows.select("doc_id", key, _spaced(F.col("text")).alias("spaced")).withColumn("n_words", _n_words(F.col("spaced"))).withColumn("words", F.split("spaced", " "))
    for k, phrase in enumerate(PHRASES):
        base = base.withColumn(f"p{k}", _phrase(F.col("spaced"), F.col("n_words"), phrase))
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for _, t, _ in templates for w in t.split()})])
    base = base.withColumn("held", F.array_intersect(vocabulary, "words"))
    enough = [F.size(F.array_intersect("held", F.array(*[F.lit(w) for w in sorted(set(t.split()))]))) >= _need(t, contained) for _, t, _ in templates]
    some = enough[0]
    for e in enough[1:]:
        some = some | e
    cut = lambda i: F.slice("words", i + 1, WINDOW)
    block = lambda i: F.struct(F.array_intersect(F.col("held"), cut(i)).alias("held"), F.size(F.array_distinct(cut(i))).alias("n"))
    blocks = F.when(some, F.transform(F.sequence(F.lit(0), F.size("words") - 1, F.lit(STRIDE)), block))
    n = range(len(PHRASES))
    return base.select(
        "doc_id", "text_key", "n_words", "held", blocks.alias("blocks"),
        sum((F.col(f"p{k}.n") for k in n[1:]), F.col("p0.n")).alias("n_base"),
        F.least(*[F.col(f"p{k}.first") for k in n]).alias("first_word"),
        F.greatest(*[F.col(f"p{k}.last") for k in n]).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.col(f"p{k}.n") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())])))).alias("base"),
    )


def template_order(passed: DataFrame, templates: tuple[Template, ...]) -> list[str]:
    """The templates' words, those in fewest documents first."""
    held = passed.select(F.explode("held").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    found = {r["w"]: r["n"] for r in held.collect()}  # at most the vocabulary
    return sorted({w for _, t, _ in templates for w in t.split()}, key=lambda w: (found.get(w, 0), w))


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    A null text is empty: no words, no labels, score 0. The score is the largest share of a
    template's words in a block that matches, and 1 where a phrase stands; templates that tie all
    give their labels. Whole texts of any length are read, an empty table gives no row. Rows that
    repeat an id with another text are told apart by a hash of the text. Other columns are not
    looked at, whatever their names.
    """
    passed = stored(_passed(docs, id_col, text_col, templates, contained), "license-pass")
    order = template_order(passed, templates)
    place = {w: k for k, w in enumerate(order)}
    entries = []
    for k, (label, t, must) in enumerate(templates):
        ws, need = sorted(set(t.split()), key=place.get), _need(t, contained)
        entries += [(w, k, label, p, len(ws), need, ws, must.split()) for p, w in enumerate(ws[: len(ws) - need + 1])]
    index = F.broadcast(docs.sparkSession.createDataFrame(entries, "word string, template int, label string, p int, n int, need int, words array<string>, must array<string>"))  # fixed size

    in_order = F.array_intersect(F.array(*[F.lit(w) for w in order]), F.col("block.held"))
    blocks = passed.where("blocks is not null").select("doc_id", "text_key", F.explode("blocks").alias("block")).select("doc_id", "text_key", in_order.alias("held"), F.col("block.n").alias("n_block"))
    blocks = blocks.select("doc_id", "text_key", "held", "n_block", F.posexplode("held").alias("q", "word"))
    pairs = blocks.join(index, "word").where("n_block >= need and least(p, q) + 1 + least(n - p - 1, size(held) - q - 1) >= need")
    share = F.size(F.array_intersect("words", "held")) / F.col("n")
    found = pairs.where((F.size(F.array_intersect("words", "held")) >= F.col("need")) & (F.size(F.array_except("must", "held")) == 0))
    found = found.groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("found"), F.max(share).alias("share"))

    f = found.select(F.col("doc_id").alias("f_id"), F.col("text_key").alias("f_key"), "found", "share")
    base = passed.drop("blocks", "held")
    both = base.join(f, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_key") == F.col("f_key")), "left")
    all_labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    phrase = lambda p: f"list_filter(range(0, greatest(len(w) - {len(p.split()) - 1}, 0)), lambda i: w[i + 1 : i + {len(p.split())}] = {p.split()!r})"
    sets = ", ".join(f"({label!r}, {sorted(set(t.split()))!r}, {must.split()!r})" for label, t, must in TEMPLATES)
    lower = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    cut = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    hits = ", ".join(f"{phrase(p)} AS p{k}" for k, p in enumerate(PHRASES))
    labels = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN {label!r} END" for k, label in enumerate(PHRASES.values()))
    every = "list_concat(" * (len(PHRASES) - 1) + "p0" + "".join(f", p{k})" for k in range(1, len(PHRASES)))
    return f"""
WITH t(label, words, must) AS (VALUES {sets}),
d AS (SELECT doc_id, text, {cut.format(lower.format("text"))} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {hits} FROM d),
b AS (SELECT doc_id, w[i + 1 : i + {WINDOW}] AS w FROM (SELECT doc_id, w, unnest(range(0, len(w), {STRIDE})) AS i FROM d)),
m AS (SELECT doc_id, list(DISTINCT label) AS found, max(share) AS share
      FROM (SELECT doc_id, label, len(list_intersect(words, w)) / len(words) AS share, len(list_intersect(must, w)) = len(must) AS told FROM b, t) WHERE told AND share >= {CONTAINED} - 1e-9 GROUP BY doc_id),
q AS (SELECT p.doc_id, n_words, {every} AS places, list_filter([{labels}], lambda x: x IS NOT NULL) AS base, found, share FROM p LEFT JOIN m ON p.doc_id = m.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM q"""


SQL = _sql()
