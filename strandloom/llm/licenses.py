"""License scans by diagonal voting, in DataFrame operations alone.

Every rolling hash of ``k`` consecutive words of every document meets the positions of the
license templates' k-word hashes in a join (the templates are constants of this module, so their
side is small whatever the corpus). Meetings whose words are equal vote for the diagonal
document position - template position; neighbouring diagonals of a document and template, which an
inserted or lost word or two sets apart, are merged; a merged span gives its label if it
holds at least ``coverage`` of the template's positions within not much more than its length.

Beside that, fixed phrases are counted at every place where their words stand one after the
other. Words are runs of characters other than ASCII ones that are neither digit nor lower-case
letter, after A-Z became lower case. Null and empty texts have no words, empty labels
and score 0. Rows with equal id and text share one scan; null ids are rows as any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Phrases and their labels (the contract's).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Texts and notices of public licenses (fixed values), by label.
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the BSD 3-Clause License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def template_words(text: str) -> list[str]:
    """A template's words on the driver, by ``words_of``'s rule."""
    import re

    return [w for w in re.split(GAP, text.translate(str.maketrans(UPPER, LOWER))) if w]


def _gram(words: Column, at: Column, k: int) -> list[Column]:
    return [F.get(words, at + j) for j in range(k)]


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts of a phrase, in order."""
    parts = phrase.split()
    here = lambda i: F.get(words, i) == parts[0] if len(parts) == 1 else _all([F.get(words, i + j) == p for j, p in enumerate(parts)])
    last = F.size(words) - len(parts)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def base(words: str, phrases) -> list[Column]:
    """n_words and what the phrases tell of each row."""
    # most texts lack a phrase's words and need no search
    none = F.array().cast("array<int>")
    places = [F.when(_all([F.array_contains(words, w) for w in p.split()]), phrase_places(F.col(words), p)).otherwise(none) for p, _ in phrases]
    every = F.concat(*places)
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(x) > 0, F.lit(label)) for x, (_, label) in zip(places, phrases, strict=True)]))))
    return [F.size(words).cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), found.alias("base")]


def doc_key(doc_id: str, text: str) -> Column:
    """Tells rows apart by id and text."""
    return F.struct(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).alias("i"), F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit(1)).alias("a"), F.xxhash64(F.lit(2), F.coalesce(F.col(text), F.lit(""))).alias("b"))


def template_grams(spark, templates, k: int) -> DataFrame:
    """(template, label, positions, at, words, hash) of every template position."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    rows = rows.withColumn("w", words_of(F.col("text"))).withColumn("positions", F.size("w") - k + 1).where("positions > 0")
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("positions") - 1)))
    return rows.select("template", "label", "positions", "at", F.slice("w", F.col("at") + 1, k).alias("gram"), F.xxhash64(*_gram(F.col("w"), F.col("at"), k)).alias("hash"))


#: What ``met`` carries of each document.
FACTS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base")


def met(docs: DataFrame, phrases, templates, k: int, doc_id: str, text: str) -> DataFrame:
    """Words and hashes of every document, made once: a row (template, label, positions, pos, at) for each
    gram that a template has too, and one with a null template and the document's facts for each document."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).select("doc_id", doc_key("doc_id", "t").alias("doc_key"), words_of(F.col("t")).alias("words"))
    hashes = F.when(F.size("words") >= k, F.transform(F.sequence(F.lit(0), F.size("words") - k), lambda i: F.xxhash64(*_gram(F.col("words"), i, k)))).otherwise(F.array().cast("array<bigint>"))
    # a null behind a document's hashes: the one row that every document has
    # facts are made before positions are: a projection beside an explode runs for each of its rows. The outer
    # explode, since a plain one has the planner filter by the size of its array below the words, which it would
    # then split anew for every position
    facts = rows.select("doc_key", "doc_id", "words", *base("words", phrases), F.concat(hashes, F.array(F.lit(None).cast("bigint"))).alias("hashes"))
    rolled = facts.select("doc_key", *FACTS, "words", F.posexplode_outer("hashes").alias("pos", "hash"))
    got = rolled.join(F.broadcast(template_grams(docs.sparkSession, templates, k)), "hash", "left")
    # equality as two bounds: generated code then reads the words in place, where a lambda would have
    # the array copied to every position
    here = F.slice("words", F.col("pos") + 1, k)
    equal = (here <= F.col("gram")) & (here >= F.col("gram"))
    return got.where(F.col("hash").isNull() | (F.col("template").isNotNull() & equal)).select("doc_key", *[F.when(F.col("template").isNull(), F.col(c)).alias(c) for c in FACTS], "template", "label", "positions", "pos", "at")


def spans(hits: DataFrame, k: int, drift: int = 3, coverage: float = 0.6, stretch: float = 1.5) -> DataFrame:
    """(doc_key, label, template, first, last, share): verified spans."""
    diagonal = hits.groupBy("doc_key", "template", "label", "positions", (F.col("pos") - F.col("at")).alias("d")).agg(F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    near = Window.partitionBy("doc_key", "template").orderBy("d")
    island = diagonal.withColumn("new", F.coalesce((F.col("d") - F.lag("d").over(near) > drift).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(near))
    merged = island.groupBy("doc_key", "template", "label", "positions", "island").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("n"), F.min("first").alias("first"), (F.max("last") + k - 1).alias("last"))
    share = F.col("n") / F.col("positions")
    return merged.withColumn("share", share).where((F.col("share") >= coverage) & (F.col("last") - F.col("first") + 1 <= stretch * (F.col("positions") + k - 1))).select("doc_key", "label", "template", "first", "last", "share")


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, k: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: counts and places of phrases, labels, score, and the spans."""
    rows = C.written(met(docs, phrases, templates, k, doc_id, text), "licenses")
    votes = rows.where("template is not null").select("doc_key", "template", "label", "positions", "pos", "at").distinct()
    found = spans(votes, k).groupBy("doc_key").agg(F.collect_set("label").alias("own"), F.max("share").alias("share"), F.sort_array(F.collect_list(F.struct("first", "last", "label", "share"))).alias("spans"))
    out = rows.where("template is null").select("doc_key", *FACTS).join(found, "doc_key", "left")
    text_of = lambda c: F.array_join(c, ",")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", text_of(F.col("base")).alias("base_labels"),
        text_of(F.array_sort(F.array_union("base", F.coalesce("own", none)))).alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"), "spans",
    )


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents")).drop("spans")
