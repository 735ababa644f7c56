"""Licence scans by diagonal voting, in DataFrame operations only.

Every pair of consecutive words of a document is hashed and joined with the
pairs of all templates (a fixed table of a few hundred rows, so it is
broadcast); the words themselves are compared in the same join.  A match of
document place p with template place t votes for diagonal p - t.  Votes are
aggregated by document, template and diagonal, diagonals at most `NEAR` apart
(words put in or left out) are merged, and a span is a finding if the union of
its template places covers enough of the template.  A base phrase must be
covered whole on one diagonal.

Everything up to the first aggregation runs in the scan's stage.  The rest
handles matches only, keyed by document, template and diagonal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tables

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Furthest distance of diagonals that are one span, and the share of a template's places that a span covers at least.
NEAR, COVER = 2, 0.8

# The base phrases with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices of well-known licences, at most 63 words each, with the labels that this method adds.
NOTICES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-notice",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-notice",
    "licensed under the apache license version 2 0": "apache-2.0-notice",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0-notice",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-text",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-text",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0-notice",
    "all rights reserved unauthorized copying of this file via any medium is strictly prohibited": "proprietary-notice",
}


def templates(spark: SparkSession, base: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """(tid, t, w1, w2, h): the word pairs of every template."""
    rows = []
    for tid, text in enumerate([*base, *notices]):
        words = text.split()
        if not 2 <= len(words) <= 63:
            raise ValueError(f"a template has 2 to 63 words: {text}")
        rows += [(tid, t, words[t], words[t + 1]) for t in range(len(words) - 1)]
    return spark.createDataFrame(rows, "tid int, t int, w1 string, w2 string").withColumn("h", F.xxhash64("w1", "w2"))


def _names(spark: SparkSession, base: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """(tid, label, added, pairs)."""
    rows = [(k, v, k >= len(base), len(x.split()) - 1) for k, (x, v) in enumerate([*base.items(), *notices.items()])]
    return spark.createDataFrame(rows, "tid int, label string, added boolean, pairs int")


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base (all places of base phrases), first_word and last_word (their
    least and largest start), base_labels, labels (both distinct, sorted, comma-joined) and score.

    Words are runs of letters a-z (A-Z are lower-cased), digits and anything
    beyond ASCII.  score is 1 where a base phrase stands, else the share of a
    notice that the best span covers, else 0.

    A null or empty text has no words and empty labels; a very long one is scanned
    whole.  A null doc_id is carried
    as null, repeated rows are scanned alike.  An empty table gives no rows.
    Columns beside doc_id and text are not read.
    """
    spark = docs.sparkSession
    rows = tables.texts(docs)
    # lower() also folds letters beyond ASCII; no word of a base phrase can come from one
    text = F.lower("text")
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    # a last entry without a word stands for the row itself: its place is the number of words
    ended = rows.select("rk", "doc_id", F.concat(words, F.array(F.lit(None).cast("string"))).alias("words"))
    pairs = ended.select("rk", "doc_id", "words", F.posexplode("words").alias("p", "w1")).select("rk", "doc_id", "p", "w1", F.get("words", F.col("p") + 1).alias("w2"))
    known = F.broadcast(templates(spark, base, notices).withColumnsRenamed({"w1": "t1", "w2": "t2"}))  # a fixed table
    # stored, so that the texts are read once: a row per document and per pair that stands in a template
    hits = tables.keep(
        pairs.withColumn("ph", F.xxhash64("w1", "w2"))
        .join(known, (F.col("ph") == F.col("h")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")), "left")
        .filter("w1 IS NULL OR tid IS NOT NULL")
        .select("rk", "doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("own"), "p", "tid", "t"),
        "hits",
    )
    counted = hits.filter("tid IS NULL").select("rk", "own", "doc_id", F.col("p").cast("long").alias("n_words"))
    votes = hits.filter("tid IS NOT NULL").groupBy("rk", "own", "tid", (F.col("p") - F.col("t")).alias("diagonal")).agg(F.bit_or(F.expr("shiftleft(1L, t)")).alias("places"))
    beside = Window.partitionBy("rk", "own", "tid").orderBy("diagonal")
    spans = (
        votes.join(F.broadcast(_names(spark, base, notices)), "tid")
        .withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(beside) > F.when(F.col("added"), NEAR).otherwise(0)).cast("int"), F.lit(1)))
        .withColumn("span", F.sum("new").over(beside.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("rk", "own", "tid", "label", "added", "pairs", "span")
        .agg(F.bit_count(F.bit_or("places")).alias("covered"), F.min("diagonal").alias("start"))
        .withColumn("share", F.col("covered") / F.col("pairs"))
        .filter(F.col("share") >= F.when(F.col("added"), COVER).otherwise(1.0))
    )
    whole = ~F.col("added")
    found = spans.groupBy("rk", "own").agg(
        F.sum(whole.cast("long")).alias("n_base"),
        F.min(F.when(whole, F.col("start").cast("long"))).alias("first_word"),
        F.max(F.when(whole, F.col("start").cast("long"))).alias("last_word"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(whole, F.col("label"))))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.collect_set("label"))).alias("labels"),
        F.max("share").alias("score"),
    )
    out = counted.join(found, ["rk", "own"], "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
    )


def op6(spark, sf_dir: str) -> DataFrame:
    return scan(tables.load(spark, sf_dir, "documents"))
