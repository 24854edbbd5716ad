"""License scans by diagonal voting, in DataFrame operations only.

The hash of every run of ``K`` words of a text is joined to the places where licence templates hold the same
run. A hit at word ``p`` of a text and word ``q`` of a template votes for the diagonal ``p - q``: the word at which the
template would start. Votes are summed by diagonal, neighbouring diagonals (a few words put in or left out) are merged
into a span, no further from its first than ``GAP`` words or one word in ``DRIFT_PART`` of the template. A span is verified
by the words themselves (runs are joined by their words as well as by their hash), by their order (a run counts where it
stands behind all earlier runs of the template) and by the share of the template's runs that it holds so: all of them on
one diagonal for the short base phrases, ``SHARE`` of them for the longer licence texts.

Runs of the text that are in no template are left out before the join by a set test on the hash, so what is
exploded and shuffled follows the hits.

Edge cases: null and empty texts have no words, no labels and score 0; ids may be null or repeated (every row gives
a row of its own); empty tables give no rows; only the two named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chirpmill.session import stage

K = 3
GAP = 4
DRIFT_PART = 8
SHARE = 0.75

# Phrases that decide the base labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening passages of public licence texts, for the method's own labels.
TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files the software to deal in the software without restriction": "mit",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the"
    " following conditions are met": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
    " license as published by the free software foundation": "gpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
    " granted": "isc",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work is licensed under a creative commons attribution": "cc-by",
}

#: Lower case over all letters finds the same words as over A-Z: no letter beyond ASCII becomes one of these phrases'.
_WORDS = r"regexp_extract_all(lower(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', 0)"


def _runs(words: str, keep: str = "true") -> str:
    hashed = f"transform(sequence(0, size({words}) - {K}), i -> struct(i as at, xxhash64({words}[i], {words}[i + 1], {words}[i + 2]) as run))"
    told = f"transform(filter({hashed}, r -> {keep}), r -> struct(r.at as at, r.run as run, concat_ws(' ', slice({words}, r.at + 1, {K})) as said))"
    return f"if(size({words}) < {K}, cast(array() as array<struct<at:int,run:bigint,said:string>>), {told})"


def template_runs(spark: SparkSession) -> DataFrame:
    """``template, label, base, n_runs, place, run, said``: each run of each template. As few rows as there are words above."""
    rows = [(t, label, True) for t, label in BASE.items()] + [(t, label, False) for t, label in TEXTS.items()]
    return (
        spark.createDataFrame(rows, "template string, label string, base boolean")
        .withColumn("w", F.split("template", " "))
        .withColumn("n_runs", F.size("w") - (K - 1))
        .select("template", "label", "base", "n_runs", F.explode(F.expr(_runs("w"))).alias("r"))
        .select("template", "label", "base", "n_runs", F.col("r.at").alias("place"), "r.run", "r.said")
    )


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The texts as ``row, doc_id, n_words, runs`` and the hits as ``row, template, label, base, n_runs, place, diagonal``."""
    spark = docs.sparkSession
    templates = template_runs(spark)
    known = ", ".join(f"{r[0]}L" for r in templates.select("run").distinct().collect())
    read = (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .select("doc_id", F.expr(_WORDS).alias("w"))
        .select("doc_id", F.size("w").cast("long").alias("n_words"), F.expr(_runs("w", f"r.run in ({known})")).alias("runs"))
    )
    read = stage(read.withColumn("row", F.monotonically_increasing_id()), "license-runs")
    hits = (
        read.where(F.size("runs") > 0).select("row", F.explode("runs").alias("r")).select("row", "r.at", "r.run", "r.said")
        .join(F.broadcast(templates), ["run", "said"])
        .select("row", "template", "label", "base", "n_runs", "place", (F.col("at") - F.col("place")).cast("long").alias("diagonal"))
    )
    return read, hits


def spans(hits: DataFrame) -> DataFrame:
    """``row, template, label, base, first, share``: hits on the diagonals from ``first`` on as one span.

    A span may open at every diagonal with a hit and takes hits at most the drift away from it, however many diagonals
    lie close to each other. Of a template's runs those count that stand behind all the earlier runs found, so words in
    another order than the template's do not.
    """
    drift = f"greatest({GAP}, (n_runs + {K - 1}) div {DRIFT_PART})"
    firsts = hits.select("row", "template", F.col("diagonal").alias("first")).distinct()
    near = (
        hits.withColumn("first", F.explode(F.expr(f"sequence(diagonal - {drift}, diagonal)")))
        .join(firsts, ["row", "template", "first"])
        .groupBy("row", "template", "label", "base", "n_runs", "first", "place").agg(F.min(F.col("diagonal") + F.col("place")).alias("at"))
    )
    earlier = Window.partitionBy("row", "template", "label", "base", "n_runs", "first").orderBy("place").rowsBetween(
        Window.unboundedPreceding, -1)
    return (
        near.withColumn("behind", F.coalesce(F.col("at") > F.max("at").over(earlier), F.lit(True)))
        .groupBy("row", "template", "label", "base", "n_runs", "first").agg(F.count_if("behind").alias("found"))
        .withColumn("share", F.col("found") / F.col("n_runs"))
        .drop("found", "n_runs")
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each text: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    read, hits = votes(docs, id_col, text_col)
    places = (
        hits.where("base").groupBy("row", "template", "label", "n_runs", "diagonal").agg(F.count("*").alias("n"))
        .where("n = n_runs")
        .groupBy("row").agg(
            F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"),
            F.collect_set("label").alias("base_set"))
    )
    own = spans(hits).groupBy("row").agg(
        F.max("share").alias("score"),
        F.collect_set(F.when(~F.col("base") & (F.col("share") >= SHARE), F.col("label"))).alias("own_set"))
    none = F.array().cast("array<string>")
    return (
        read.select("row", "doc_id", "n_words").join(own.join(places, "row", "left"), "row", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
            F.array_join(F.sort_array(F.coalesce("base_set", none)), ",").alias("base_labels"),
            F.array_join(F.sort_array(F.array_union(F.coalesce("base_set", none), F.coalesce("own_set", none))), ",").alias("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"))
    )
