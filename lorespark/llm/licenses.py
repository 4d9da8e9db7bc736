"""License scans by diagonal voting, in DataFrame functions only.

Every rolling word pair (k-gram) of a text is joined by its hash to the places that templates have it at, and the words
themselves are compared. A hit votes for the diagonal of its template: where the template would start in the text. Votes
are put together by diagonal, neighbouring diagonals (words added or left out) merge into a span, and a span counts
when enough of the template's words stand in it. Phrases need all their words on one diagonal.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .exact_dedup import LOWER, UPPER, normalised

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2
#: The phrases of the base and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Sentences by which licenses are told, as their authors publish them, and labels.
NOTICES = [
    ("apache", "Licensed under the Apache License"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-nc", "Licensed under CC BY-NC"),
    ("cc-by-sa", "Licensed under CC BY-SA"),
    ("cc-by-nd", "Licensed under CC BY-ND"),
]
#: Words of which a notice's pair has one at least that is none of them, to vote.
COMMON = "a an and any are at be by for from in is it of on or the this to under with".split()
#: One in so many of a notice's words may be missing; diagonals so far apart are neighbours, for each so many words.
MISSING, NEAR = 10, 6
#: Votes of templates up to which they are broadcast.
VOTES = 100_000
#: The hash that stands for a text itself.
SELF = 0


def words(text: Column) -> Column:
    return F.array_remove(F.split(normalised(text), SEPARATORS), "")


def grams(of: Column, k: int = K) -> Column:
    """The hash of the k words from each place on; those that begin behind the last k have fewer."""
    return F.transform(of, lambda w, i: F.xxhash64(w, *(F.get(of, i + j) for j in range(1, k))))


def templates(spark: SparkSession, phrases: Mapping[str, str] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES, k: int = K) -> DataFrame:
    """(hash, gram, template, label, base, n_words, n_votes, at), a row for each gram of each template that votes.

    n_words counts the words under the grams that vote. Templates have k words at least.
    """
    rows = enumerate([*((v, p) for p, v in phrases.items()), *notices])
    rows = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(i < len(phrases)).alias("base"), F.lit(text).alias("text")) for i, (label, text) in rows]
    made = spark.range(1).select(F.inline(F.array(*rows))).withColumn("w", words(F.col("text")))
    short = F.raise_error(F.concat(F.lit(f"a template needs {k} words: "), "text")).cast("array<bigint>")
    made = made.select("template", "label", "base", "w", F.posexplode(F.when(F.size("w") >= k, F.slice(grams(F.col("w"), k), 1, F.size("w") - (k - 1))).otherwise(short)).alias("at", "hash"))
    made = made.withColumn("gram", F.slice("w", F.col("at") + 1, k))
    common = F.array(*map(F.lit, COMMON))
    made = made.where(F.col("base") | ~F.forall("gram", lambda w: F.array_contains(common, w)))
    own = Window.partitionBy("template")
    under = F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + k - 1)).over(own)))
    return made.select("hash", "gram", "template", "label", "base", F.size(under).alias("n_words"), F.count("*").over(own).cast("int").alias("n_votes"), "at")


def votes(docs: DataFrame, known: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, key, n_words, template, label, base, of_words, n_votes, diagonal, at, rows): the hits of each text, once each, and a row without template for the text itself.

    key tells texts of one doc_id apart, rows counts the rows that have both.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("key"), words(text).alias("w"))
    rows = rows.select("doc_id", "key", "w", F.posexplode(F.concat(F.array(F.lit(SELF).cast("long")), grams(F.col("w"), k))).alias("at", "hash"))
    itself = {"hash": SELF, "template": -1, "base": False, "n_words": 0, "n_votes": 0, "at": 0}
    for_self = known.sparkSession.range(1).select(*(F.lit(itself.get(f.name)).cast(f.dataType).alias(f.name) for f in known.schema))
    known = known.unionByName(for_self).withColumnRenamed("at", "_at").withColumnRenamed("n_words", "of_words")
    if known.limit(VOTES + 1).count() <= VOTES:
        known = F.broadcast(known)
    hits = rows.join(known, "hash").where(F.when(F.col("template") < 0, F.col("at") == 0).otherwise((F.col("at") > 0) & (F.slice("w", F.greatest("at", F.lit(1)), k) == F.col("gram"))))
    keys = ["doc_id", "key", F.size("w").cast("long").alias("n_words"), "template", "label", "base", "of_words", "n_votes"]
    hits = hits.select(*keys, (F.col("at") - 1 - F.col("_at")).alias("diagonal"), F.col("_at").alias("at"))
    return hits.groupBy(*hits.columns).agg(F.count("*").alias("rows"))


def scan(docs: DataFrame, known: DataFrame | None = None, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row of docs (doc_id, text).

    n_base counts the places of phrases, first_word and last_word are the smallest and largest of their starts (null without any); labels are
    distinct, sorted and comma-joined, empty without any. score is the largest share of a template's words that one span has. A null text
    is empty; repeated rows and ids are rows of their own, a null doc_id is one like others. Columns but doc_id and text are not carried. One
    text's words are held by one task: some ten times its bytes, whatever its length.
    """
    known = templates(docs.sparkSession, k=k) if known is None else known
    # Everything below stays with the text.
    found = votes(docs, known, k).repartition("doc_id", "key")
    text = ["doc_id", "key", "n_words"]
    one = [*text, "template", "label", "base", "of_words", "n_votes"]
    lines = found.groupBy(*one, "diagonal").agg(F.collect_list("at").alias("at"), F.max("rows").alias("rows"))
    by_diagonal = Window.partitionBy(*text, "template").orderBy("diagonal")
    near = F.when(F.col("base"), 0).otherwise(F.floor(F.col("of_words") / NEAR))
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > near, F.lit(True))
    lines = lines.withColumn("_new", new.cast("int")).withColumn("span", F.sum("_new").over(by_diagonal))
    spans = lines.groupBy(*one, "span").agg(F.flatten(F.collect_list("at")).alias("at"), F.min("diagonal").alias("start"), F.max("rows").alias("rows"))
    there = F.size(F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a, a + k - 1)))))
    whole = F.col("base") & (F.size("at") == F.col("n_votes"))
    fits = F.when(F.col("base"), whole).otherwise(there >= F.col("of_words") - F.floor(F.col("of_words") / MISSING))
    spans = spans.select(
        *text, "rows", F.when(whole, F.col("start")).alias("start"), F.when(whole, F.col("label")).alias("base_label"), F.when((F.col("template") >= 0) & fits, F.col("label")).alias("label"),
        F.when(F.col("template") >= 0, there / F.col("of_words")).alias("share"),
    )
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = spans.groupBy(*text).agg(
        F.count("start").alias("n_base"), F.min("start").cast("long").alias("first_word"), F.max("start").cast("long").alias("last_word"),
        listed("base_label").alias("base_labels"), listed("label").alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"), F.max("rows").alias("rows"),
    )
    out = out.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ROWS = ", ".join(f"({i}, {quoted(label)}, {str(base).lower()}, {quoted(text)})" for i, (label, base, text) in enumerate([*((v, True, p) for p, v in PHRASES.items()), *((n, False, t) for n, t in NOTICES)]))
#: The same as scan with its default parameters, by word pairs themselves.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT template, label, base, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM (VALUES {_ROWS}) v(template, label, base, text)),
grams AS (SELECT template, label, base, g[1] AS a, g[2] AS b, pos FROM (SELECT *, unnest(list_zip(w[:-2], w[2:])) AS g, unnest(range(len(w) - 1)) AS pos FROM t)
          WHERE base OR NOT (list_contains([{", ".join(map(quoted, COMMON))}], g[1]) AND list_contains([{", ".join(map(quoted, COMMON))}], g[2]))),
sizes AS (SELECT template, count(*) AS n_votes, len(list_distinct(flatten(list([pos, pos + 1])))) AS of_words FROM grams GROUP BY template),
pairs AS (SELECT r, unnest(w[:-2]) AS a, unnest(w[2:]) AS b, unnest(range(len(w) - 1)) AS i FROM d WHERE len(w) > 1),
lines AS (SELECT r, template, label, base, i - pos AS diagonal, list(pos) AS pos FROM pairs JOIN grams USING (a, b) GROUP BY ALL),
marked AS (SELECT l.*, n_votes, of_words, coalesce(diagonal - lag(diagonal) OVER q > CASE WHEN base THEN 0 ELSE of_words // {NEAR} END, true) AS new
           FROM lines l JOIN sizes USING (template) WINDOW q AS (PARTITION BY r, template ORDER BY diagonal)),
numbered AS (SELECT *, sum(new::INT) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM marked),
spans AS (SELECT r, template, label, base, n_votes, of_words, span, flatten(list(pos)) AS pos, min(diagonal) AS start FROM numbered GROUP BY ALL),
judged AS (SELECT *, base AND len(pos) = n_votes AS whole, len(list_distinct(flatten(list_transform(pos, lambda x: [x, x + 1])))) AS there FROM spans),
s AS (
  SELECT r, count(*) FILTER (whole) AS n_base, min(start) FILTER (whole) AS first_word, max(start) FILTER (whole) AS last_word,
         list_sort(list(DISTINCT label) FILTER (whole)) AS base_labels,
         list_sort(list(DISTINCT label) FILTER (CASE WHEN base THEN whole ELSE there >= of_words - of_words // {MISSING} END)) AS labels, max(there / of_words) AS score
  FROM judged GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(base_labels, ','), '') AS base_labels, coalesce(array_to_string(labels, ','), '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN s USING (r)
"""
