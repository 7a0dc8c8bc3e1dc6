"""Licence scan by diagonal voting, in DataFrame operations only.

Templates are cut into all word k-grams with their positions. One pass over the texts hashes every word once, rolls the
words' hashes into those of all k-grams (each is turned by its place and added without carry), and keeps the places whose
hash some template has, with their words. Those few are joined with the templates' positions and verified word by word.
A hit at text position p and template position q votes for diagonal p - q: an unchanged copy puts all its votes on one
diagonal, inserted or missing words move the rest to a neighbouring one. Votes are counted by (text, template, diagonal),
diagonals no further apart than `drift` are merged into a run, and a run is a span if it holds enough of the template's
k-grams within a bounded length. A run that is longer, as when copies follow each other, is taken apart into its diagonals.

Templates are a constant of this module or a caller's list: their hashes travel in the plan. Only rows without texts are
stored; texts are neither shuffled nor read twice.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Stored, words
from lodestone.llm.licenses import BODIES

#: Phrases that mark a licence wherever their words stand consecutively.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Opening words of public licences and of the notices by which texts name them.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    *BODIES,
]
K, DRIFT, SHARE = 3, 3, 0.6


def template_words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


def _rolled(hashes: Column, at: Column | int, k: int) -> Column:
    """The hash of k words from the hashes of each: all bits of the word that is i from the end are turned by i places."""
    turned = []
    for i in range(k):
        h, by = F.get(hashes, F.lit(at) + i if isinstance(at, int) else at + i), k - 1 - i
        turned.append(F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by)) if by else h)
    out = turned[0]
    for h in turned[1:]:
        out = out.bitwiseXOR(h)
    return out


def _word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """(t, label, off, gram, grams, shingle): every k-gram of the templates; grams counts those of its template."""
    rows = [(t, label, i, w[i : i + k], len(w) - k + 1) for t, (label, text) in enumerate(templates) for w in [template_words(text)] for i in range(len(w) - k + 1)]
    grams = spark.createDataFrame(rows, "t int, label string, off int, gram array<string>, grams int")
    return grams.withColumn("shingle", _rolled(_word_hashes(F.col("gram")), 0, k))


def hits(w: Column, shingles: list[int], k: int) -> Column:
    """array of (at, shingle, gram) of the places in an array of words whose k words have one of the hashes."""
    none = F.lit(None).cast("array<struct<at:int,shingle:bigint,gram:array<string>>>")
    if not shingles:
        return none
    places = F.sequence(F.lit(0), F.size(w) - k)
    rolled = F.transform(F.array(_word_hashes(w)), lambda h: F.transform(places, lambda i: F.struct(i.alias("at"), _rolled(h, i, k).alias("shingle"))))[0]
    found = F.transform(F.filter(rolled, lambda x: x["shingle"].isin(shingles)), lambda x: F.struct(x["at"].alias("at"), x["shingle"].alias("shingle"), F.slice(w, x["at"] + 1, F.lit(k)).alias("gram")))
    return F.when(F.size(w) >= k, found).otherwise(none)


def spans(found: DataFrame, grams: DataFrame, k: int = K, drift: int = DRIFT, share: float = SHARE) -> DataFrame:
    """(_id, label, start, end, coverage): verified spans, in words, of rows (_id, hits)."""
    each = found.where(F.size("hits") > 0).select("_id", F.explode("hits").alias("x")).select("_id", "x.at", "x.shingle", F.col("x.gram").alias("here"))
    voted = each.join(grams, "shingle").where(F.col("here") == F.col("gram"))
    votes = voted.groupBy("_id", "t", "label", "grams", (F.col("at") - F.col("off")).alias("diagonal")).agg(F.collect_set("off").alias("offs"))
    near = Window.partitionBy("_id", "t").orderBy("diagonal")
    votes = votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(near) > drift).cast("int")).withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(near))
    run = Window.partitionBy("_id", "t", "run")
    votes = votes.withColumns({"first": F.col("diagonal") + F.array_min("offs"), "last": F.col("diagonal") + F.array_max("offs") + k})
    long = F.max("last").over(run) - F.min("first").over(run) > 2 * (F.col("grams") + k)
    votes = votes.withColumn("own", F.when(long, F.col("diagonal")))  # a run that is too long: each diagonal by itself
    found = votes.groupBy("_id", "t", "label", "grams", "run", "own").agg(F.min("first").alias("start"), F.max("last").alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("offs")))).alias("held"))
    return found.where(F.col("held") >= share * F.col("grams")).select("_id", "label", "start", "end", (F.col("held") / F.col("grams")).alias("coverage"))


def _phrase(w: Column, phrase: str) -> Column:
    """Where the words of a phrase stand consecutively."""
    ws = phrase.split()
    rare = max(ws, key=lambda x: (x not in ("by", "all", "public"), len(x)))

    def here(i: Column) -> Column:
        ok = F.get(w, i) == ws[0]
        for j in range(1, len(ws)):
            ok = ok & F.coalesce(F.get(w, i + j) == ws[j], F.lit(False))
        return ok

    none = F.array().cast("array<int>")
    return F.when(F.array_contains(w, rare), F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))), here)).otherwise(none)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """docs' columns but text with n_words, n_base, first_word, last_word, base_labels, labels (arrays), spans and score.

    score: 1 with a base phrase, else the best share of a template that a span holds, else 0. A licence whose text holds
    another's carries both labels. Null and empty texts have no words, labels or places; repeated rows and null ids each
    get their result; equal spans of one label come once; columns of docs with the new names are replaced; an empty table
    gives an empty one. A text of any length is one row's work, at a few arrays of its words' number.
    """
    store = Stored(docs.sparkSession)
    grams = template_grams(docs.sparkSession, TEMPLATES if templates is None else templates, K)
    shingles = sorted(r.shingle for r in grams.select("shingle").distinct().collect())
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "spans", "score"]
    own = [c for c in docs.columns if c not in ("text", *new)]
    phrases = list(PHRASES.items())
    w = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), words(F.col("text").cast("string")).alias("w"))
    w = w.select("row", F.size("w").cast("long").alias("n_words"), F.struct(*(_phrase(F.col("w"), p).alias(f"at_{i}") for i, (_, p) in enumerate(phrases))).alias("places"), hits(F.col("w"), shingles, K).alias("hits"))
    scanned = store.put("scanned", w.withColumn("_id", F.monotonically_increasing_id()))
    found = spans(scanned.select("_id", "hits"), grams)
    found = found.groupBy("_id").agg(F.array_sort(F.collect_set("label")).alias("also"), F.max("coverage").alias("best"), F.array_sort(F.collect_set(F.struct("start", "end", "label", "coverage"))).alias("spans"))
    found = store.put("spans", found)
    places = F.concat(*(F.col(f"places.at_{i}") for i in range(len(phrases))))
    named = F.array_sort(F.array_compact(F.array(*(F.when(F.size(f"places.at_{i}") > 0, F.lit(label)) for i, (label, _) in enumerate(phrases)))))
    out = scanned.drop("hits").join(found, "_id", "left")
    labels = F.array_sort(F.array_union(named, F.coalesce("also", F.array().cast("array<string>"))))
    score = F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select(
        *(F.col(f"row.`{c}`") for c in own), "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        named.alias("base_labels"), "spans", labels.alias("labels"), score.alias("score"),
    )
