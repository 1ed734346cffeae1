"""Licence detection over a positional rare-token index, in DataFrame operations only.

A template is a short list of (relative position, word) postings taken from a public
licence text, some of them mandatory. Per file the occurrences of licence words are
kept with their positions. Document frequencies over the whole corpus give each word's
IDF; per template the file's `ANCHORS` highest-IDF words are looked up first, their
occurrences name the possible starting places, and the other postings are intersected with
those places by relative position. A template counts where all its mandatory key words stand and the
IDF-weighted share of its words reaches `min_coverage`.

Null texts count as empty. Files without licence words get no labels and score 0.
Repeated rows and null ids are judged each on its own; an empty table gives an empty result.
Extra columns are ignored, texts of any length are searched whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import ascii_lower, materialize, whole_text

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Words of a template that are looked up first.
ANCHORS = 3
#: Openings of public licence texts; words in capitals are the mandatory key phrases, a star is any word.
TEXTS = (
    ("mit", "PERMISSION IS HEREBY GRANTED FREE OF CHARGE to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the APACHE LICENSE VERSION 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "REDISTRIBUTION AND USE IN SOURCE AND BINARY FORMS with or without modification are permitted provided that the following conditions are met"),
    ("lgpl", "gnu LESSER GENERAL PUBLIC LICENSE as published by the free software foundation"),
    ("agpl", "gnu AFFERO GENERAL PUBLIC LICENSE as published by the free software foundation"),
    ("mpl", "subject to the terms of the MOZILLA PUBLIC LICENSE"),
    ("isc", "PERMISSION TO USE COPY MODIFY AND OR DISTRIBUTE this software for any purpose with or without fee is hereby granted"),
    ("cc", "CREATIVE COMMONS ATTRIBUTION * * international license"),
    ("unlicense", "this is FREE AND UNENCUMBERED SOFTWARE released into the public domain"),
)
#: Function words carry no evidence and are not indexed.
COMMON = frozenset("a an and any are as by for in is it not of or that the this to with you".split())


def templates() -> list[tuple[str, str, bool, int, str, bool]]:
    """Postings: (template, label, base, position, word, mandatory)."""
    out = []
    for phrase, label in BASE:
        out += [(f"base:{phrase}", label, True, i, w, True) for i, w in enumerate(phrase.split())]
    for n, (label, text) in enumerate(TEXTS):
        for i, w in enumerate(text.split()):
            if w != "*" and w.lower() not in COMMON:
                out.append((f"text:{n}:{label}", label, False, i, w.lower(), w.isupper() or bool(re.fullmatch(r"\d", w))))
    return out


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_coverage: float = 0.6) -> DataFrame:
    """Per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    rows = templates()
    vocabulary = sorted({r[4] for r in rows})
    postings = F.broadcast(  # a fixed table of about a hundred rows
        spark.createDataFrame(rows, "template string, label string, base boolean, at int, word string, mandatory boolean")
    )
    words = F.regexp_extract_all(ascii_lower(whole_text(text_col)), F.lit(WORD), F.lit(0))
    files = docs.select(F.col(id_col).cast("long").alias("doc_id"), words.alias("words")).select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda x: x["word"].isin(vocabulary)).alias("hits"),
    )
    files = materialize(files.withColumn("rid", F.monotonically_increasing_id()), "license-files")

    occurrences = files.select("rid", F.inline("hits"))
    n_files = files.count()
    idf = files.select(F.explode(F.array_distinct("hits.word")).alias("word")).groupBy("word").agg(
        F.log((F.lit(n_files) + 1.0) / F.count("*")).alias("idf")
    )
    weights = materialize(postings.join(idf, "word", "left").fillna({"idf": 0.0}), "license-weights")  # as many rows as the postings
    weighted = F.broadcast(weights)
    totals = F.broadcast(
        weights.groupBy("template", "label", "base").agg(
            F.sum("idf").alias("all_idf"), F.sum(F.col("mandatory").cast("long")).alias("n_mandatory"), F.count("*").alias("n_postings")
        )
    )
    # each file's highest-IDF words of each template (the first postings on ties); a template bounds their number
    found = occurrences.join(weighted, "word").withColumn("start", F.col("pos") - F.col("at"))
    ranked = F.sort_array(F.collect_set(F.struct("idf", (-F.col("at")).alias("before"))), asc=False)
    best = found.groupBy("rid", "template").agg(F.transform(F.slice(ranked, 1, ANCHORS), lambda x: -x["before"]).alias("anchors"))
    anchored = found.join(best, ["rid", "template"]).where(F.array_contains("anchors", F.col("at"))).select("rid", "template", "start").distinct()
    places = (
        found.join(anchored, ["rid", "template", "start"])
        .groupBy("rid", "template", "start")
        .agg(F.sum("idf").alias("idf"), F.sum(F.col("mandatory").cast("long")).alias("n_met"), F.count("*").alias("n_found"))
        .join(totals, "template")
        .where(F.col("n_met") == F.col("n_mandatory"))
        .withColumn("coverage", F.when(F.col("n_found") == F.col("n_postings"), 1.0).otherwise(F.coalesce(F.try_divide("idf", "all_idf"), F.lit(0.0))))
        .where(F.col("base") | (F.col("coverage") >= min_coverage))
    )
    verdicts = places.groupBy("rid").agg(
        F.sum(F.col("base").cast("long")).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.least(F.lit(1.0), F.max("coverage")).alias("score"),
    )
    return files.select("rid", "doc_id", "n_words").join(verdicts, "rid", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
