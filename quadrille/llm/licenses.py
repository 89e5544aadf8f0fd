"""License scans by diagonal voting, in DataFrame functions only.

Method: every text becomes its words; each rolling pair of words (``K`` = 2, the length of
the shortest template) is hashed and joined to the positions at which templates hold the
same pair. A hit votes for the diagonal (document position less template position) of its
template. Votes are counted by document, template and diagonal. A diagonal with all of a
template's pairs is a verified place of it. Neighbouring diagonals of a longer template
(within ``DRIFT``: a word put in, left out or changed shifts the rest) are merged into one
span, which counts if it holds at least ``COVER`` of the template's pairs.

The templates are a constant of this module, so their table is small whatever the data,
and is broadcast. A document's pairs are counted in the task that reads the text; only
voted diagonals and one row for each document are shuffled.

The base are the four phrases of ``PHRASES``; ``TEXTS`` adds labels of longer templates.
A pair's hash has 64 bits and its words are compared as well, so a vote is exact.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows
give one row each; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import no_nulls, settle

K = 2
DRIFT = 3
COVER = 0.7

# The phrases of the contract and the opening words of public license texts.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "this work is licensed under a creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "all rights reserved": "proprietary",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return F.array_remove(F.split(F.translate(no_nulls(text), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def template_rows() -> list[tuple]:
    """(template, label, is base, its pairs, position, first word, second word)."""
    rows = []
    for k, (text, label, base) in enumerate([*((t, x, True) for t, x in PHRASES.items()), *((t, x, False) for t, x in TEXTS.items())]):
        w = re.findall("[0-9a-z]+", text)
        rows += [(k, label, base, len(w) - 1, i, a, b) for i, (a, b) in enumerate(zip(w, w[1:]))]
    return rows


def votes(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """A row for each document and voted diagonal, and one without a template for each document."""
    spark = docs.sparkSession
    templates = spark.createDataFrame(template_rows(), "template int, label string, base boolean, pairs int, position int, a string, b string")
    labels = F.broadcast(templates.where("position = 0").select("template", "label", "base", "pairs"))
    templates = F.broadcast(templates.select("template", "position", "a", "b", F.xxhash64("a", "b").alias("pair")))
    w = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).cast("long").alias("doc_id"), words(F.col(text).cast("string")).alias("w"))
    rolled = w.select("row_no", "doc_id", F.posexplode_outer(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("at", "two"))
    rolled = rolled.select("row_no", "doc_id", "at", F.col("two.a").alias("x"), F.col("two.b").alias("y")).withColumn("hash", F.xxhash64("x", "y"))
    hit = rolled.join(templates, (F.col("hash") == F.col("pair")) & (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")), "left")
    return hit.groupBy("row_no", "doc_id", "template", (F.col("at") - F.col("position")).alias("diagonal")).agg(
        F.max("at").alias("last_at"), F.min("at").alias("from_at"), F.count("position").alias("votes")
    ).join(labels, "template", "left")


def spans(voted: DataFrame) -> DataFrame:
    """Verified places: (row_no, label, base, first, last, share), word positions from 0.

    A document position votes once for a template position, so votes on one diagonal are
    distinct and all of them mean the whole template.
    """
    voted = voted.where("template IS NOT NULL")
    whole = voted.where("votes = pairs").select("row_no", "label", "base", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("pairs")).alias("last"), F.lit(1.0).alias("share"))
    partial = voted.where(~F.col("base") & (F.col("pairs") >= 6))
    order = Window.partitionBy("row_no", "template").orderBy("diagonal")
    partial = partial.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT).cast("int"))
    partial = partial.withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(order))
    run = Window.partitionBy("row_no", "template", "run")
    partial = partial.withColumn("length", F.max("last_at").over(run) - F.min("from_at").over(run)).withColumn("away", F.col("diagonal") - F.min("diagonal").over(run))
    # A run that is longer than a span may be is cut at each half template's length of diagonals,
    # in two ways, so that a span that drifts by less than a quarter lies whole in a piece.
    half = F.greatest(F.floor(F.col("pairs") / 2), F.lit(2))
    ways = F.when(F.col("length") <= F.col("pairs") * 2, F.array(F.lit(-1))).otherwise(F.array(F.lit(0), F.lit(1)))
    partial = partial.withColumn("way", F.explode(ways)).withColumn("piece", F.when(F.col("way") < 0, F.lit(0)).otherwise(F.floor((F.col("away") + F.col("way") * F.floor(half / 2)) / half)))
    merged = partial.groupBy("row_no", "template", "run", "way", "piece").agg(F.sum("votes").alias("votes"), F.first("pairs").alias("pairs"), F.first("label").alias("label"), F.min("from_at").alias("first"), F.max("last_at").alias("last"), F.count(F.lit(1)).alias("n"))
    merged = merged.where((F.col("votes") >= F.ceil(F.col("pairs") * COVER)) & (F.col("last") - F.col("first") <= F.col("pairs") * 2) & ~((F.col("n") == 1) & (F.col("votes") == F.col("pairs"))))
    return whole.unionByName(merged.select("row_no", "label", F.lit(False).alias("base"), "first", (F.col("last") + 1).alias("last"), F.least(F.lit(1.0), F.col("votes") / F.col("pairs")).alias("share")))


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each document."""
    voted = settle(votes(docs, id_col, text), "license-votes")
    first = F.col("diagonal").cast("long")
    base = F.col("base") & (F.col("votes") == F.col("pairs"))
    # All diagonals of a document meet in one group; templates and words in it bound their number.
    per_doc = voted.groupBy("row_no", "doc_id").agg(
        F.coalesce(F.max("last_at") + 1, F.lit(0)).cast("long").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, first)).alias("first_word"),
        F.max(F.when(base, first)).alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_set"),
    )
    found = spans(voted).groupBy("row_no").agg(F.collect_set("label").alias("all_set"), F.max("share").alias("share"))
    out = per_doc.join(found, "row_no", "left")
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", F.array_sort("base_set")).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union("base_set", F.coalesce("all_set", F.array().cast("array<string>"))))).alias("labels"),
        F.coalesce("share", F.lit(0.0)).alias("score"),
    )
