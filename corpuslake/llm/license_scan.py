"""License scans: an exact set-similarity join of text blocks with license templates, with DataFrame operations only.

A block is a line of a text, or as many running words of it as the template has, whatever lines they stand in, so that
wrapped notices are met. A template is a set of words; a block meets it if it holds at least the share `THRESHOLD` of
that set (containment), all of the words that set this license apart (`MUST`) and none that names another (`NEVER`).

Words are in one global order: first those of no template, then the templates' by how often they occur over all
documents, rarest first. A template of n words that needs c of them must share with a block one of its n - c + 1 rarest
words (prefix filter); the block must have at least c distinct words (length filter); and all shared words stand in
the order of either side at or behind the first shared prefix word, so of the template's and of the block's words c must
be left from there (positional filter). The prefix and length filters run first on the words of whole texts, which hold those of any
block, then on blocks; only blocks around a prefix word are formed. What passes is verified by counting the shared words.

Beside this, the phrases of BASE are found by their places. Null and empty texts have no words and no label; texts of
any length are scanned whole; of ties the best containment counts; repeated rows get equal results each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm.common import UPPER, ascii_lower, materialize, row_key, words

THRESHOLD = 0.8

#: Phrases and labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices of public licenses, by label.
TEMPLATES = {
    "mit-notice": "released under the MIT license",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-warranty": "The software is provided as is, without warranty of any kind, express or implied",
    "apache-2.0-notice": "licensed under the Apache License, version 2.0",
    "apache-2.0-terms": "you may not use this file except in compliance with the License",
    "apache-2.0-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0-notice": "licensed under the GNU General Public License, version 3",
    "gpl-notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-notice": "licensed under a Creative Commons Attribution 4.0 International License",
    "mpl-2.0-notice": "subject to the terms of the Mozilla Public License, v. 2.0",
}


#: Words that a block must hold, beside the threshold.
MUST = {
    "mit-notice": ["mit"],
    "mit-grant": ["permission", "granted"],
    "mit-warranty": ["software", "warranty"],
    "apache-2.0-notice": ["apache", "2"],
    "apache-2.0-terms": ["compliance", "license"],
    "apache-2.0-copy": ["apache"],
    "gpl-3.0-notice": ["general", "public", "3"],
    "gpl-notice": ["general", "public"],
    "bsd-notice": ["redistribution", "source", "binary"],
    "cc-by-notice": ["creative", "commons", "attribution", "4"],
    "mpl-2.0-notice": ["mozilla", "2"],
}

#: Words that a block must not hold.
NEVER = {
    "gpl-3.0-notice": ["lesser", "library", "affero"],
    "gpl-notice": ["lesser", "library", "affero"],
    "cc-by-notice": ["noncommercial", "noderivatives", "sharealike"],
}


def _split(template: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in template.translate(str.maketrans(UPPER, UPPER.lower()))).split()


def template_words() -> dict[str, list[str]]:
    return {k: sorted(set(_split(v))) for k, v in TEMPLATES.items()}


def template_lengths() -> dict[str, int]:
    return {k: len(_split(v)) for k, v in TEMPLATES.items()}


def needed(n: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * n - 1e-9))


def token_counts(split: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of the fixed template vocabulary occurs over all documents."""
    hit = split.select(F.explode(F.filter("w", lambda x: x.isin(vocabulary))).alias("token")).groupBy("token").count()
    return {r["token"]: r["count"] for r in hit.collect()}  # one row for each template word at most


def template_index(spark: SparkSession, counts: dict[str, int], threshold: float) -> tuple[DataFrame, list[str], list[str]]:
    """One row for each template and prefix word; the template vocabulary in the global order; the prefix words."""
    ordered = sorted({w for v in template_words().values() for w in v}, key=lambda w: (counts.get(w, 0), w))
    rows = []
    for k, v in template_words().items():
        tokens, c = sorted(v, key=ordered.index), needed(len(v), threshold)
        prefix = tokens[: len(v) - c + 1]
        rows += [(w, k, len(v), c, template_lengths()[k], prefix, tokens, MUST[k], NEVER.get(k, [])) for w in prefix]
    schema = "token string, label string, n int, c int, span int, prefix array<string>, tokens array<string>, must array<string>, never array<string>"
    return spark.createDataFrame(rows, schema), ordered, sorted({r[0] for r in rows})


def candidate_blocks(split: DataFrame, index: DataFrame, probes: list[str]) -> DataFrame:
    """A row with the distinct words b of each block of a text that holds a prefix word of a template, beside the template's columns.

    split has row_key, text and its words w.
    """
    sized = split.select("row_key", "text", "w", F.array_distinct("w").alias("d"))
    probed = sized.select("*", F.explode(F.filter("d", lambda x: x.isin(probes))).alias("token"))
    joined = probed.join(F.broadcast(index), "token").filter(F.size("d") >= F.col("c"))  # TEMPLATES bounds the index
    once = joined.filter(F.get(F.filter("prefix", lambda x: F.array_contains("d", x)), F.lit(0)) == F.col("token"))  # one row for each template
    every = F.sequence(F.lit(0), F.size("w") - 1)
    probe_at = F.filter(every, lambda i: F.array_contains("prefix", F.get("w", i)))
    around = F.array_distinct(F.flatten(F.transform(probe_at, lambda i: F.sequence(F.greatest(i - F.col("span") + 1, F.lit(0)), i))))
    runs = F.transform(around, lambda i: F.array_distinct(F.slice("w", i + 1, F.col("span"))))
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda line: F.array_distinct(words(line))), lambda b: F.arrays_overlap(b, F.col("prefix")))
    return once.select("row_key", "label", "n", "c", "prefix", "tokens", "must", "never", F.explode(F.concat(runs, lines)).alias("b"))


def filtered_blocks(blocks: DataFrame, ordered: list[str]) -> DataFrame:
    """blocks with `left`: how many of the block's words stand, in the global order, at or behind the first shared prefix word; those that pass the length and positional filters."""
    vocabulary = F.array(*map(F.lit, ordered))
    first = F.get(F.filter("prefix", lambda x: F.array_contains("b", x)), F.lit(0))
    ranked = blocks.filter(F.size("b") >= F.col("c")).withColumn("first", first).withColumn("mine", F.filter(vocabulary, lambda x: F.array_contains("b", x)))
    left = F.size("mine") - F.array_position("mine", F.col("first")) + 1
    return ranked.withColumn("left", left).filter((F.col("left") >= F.col("c")) & (F.col("n") - F.array_position("tokens", F.col("first")) + 1 >= F.col("c")))


def block_matches(split: DataFrame, counts: dict[str, int], threshold: float = THRESHOLD) -> DataFrame:
    """(row_key, label, containment) for every row and template that one of the row's blocks meets; containment is that of its best block."""
    index, ordered, probes = template_index(split.sparkSession, counts, threshold)
    passed = filtered_blocks(candidate_blocks(split, index, probes), ordered)
    shared = F.size(F.array_intersect("b", "tokens"))
    whole = (F.size(F.array_except("must", "b")) == 0) & ~F.arrays_overlap("never", "b")
    met = passed.select("row_key", "label", "n", "c", shared.alias("shared"), whole.alias("whole")).filter("shared >= c AND whole")
    return met.groupBy("row_key", "label").agg(F.max(F.col("shared") / F.col("n")).alias("containment"))


def _places(w: Column, phrase: str) -> Column:
    """Word numbers, from 0, where the phrase begins."""
    parts = phrase.split(" ")
    last = F.size(w) - len(parts)

    def begins(i: Column) -> Column:
        test = F.get(w, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            test = test & (F.get(w, i + k) == part)
        return test

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), begins))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest containment of a template among those met, 1 where a base phrase occurs, else 0.
    """
    keyed = docs.select("doc_id", row_key("doc_id", "text").alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    vocabulary = sorted({w for v in template_words().values() for w in v})
    w = F.col("w")
    none = F.array().cast("array<int>")
    base = {label: F.when(F.array_contains(w, phrase.split(" ")[-1]), F.coalesce(_places(w, phrase), none)).otherwise(none) for phrase, label in BASE.items()}
    split = keyed.select("doc_id", "row_key", "text", words(F.col("text")).alias("w"))
    found = split.select("doc_id", "row_key", F.size(w).alias("n_words"), *(c.alias(f"at_{k}") for k, c in base.items()))
    flat = F.concat(*(F.col(f"at_{k}") for k in base))
    hits = found.select(
        "doc_id",
        "row_key",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(flat).cast("long").alias("n_base"),
        F.array_min(flat).cast("long").alias("first_word"),
        F.array_max(flat).cast("long").alias("last_word"),
        F.filter(F.array(*(F.when(F.size(f"at_{k}") > 0, F.lit(k)) for k in sorted(base))), lambda x: x.isNotNull()).alias("base"),
    )
    counts = token_counts(split, vocabulary)
    matches = block_matches(split, counts, threshold)
    per_doc = matches.groupBy("row_key").agg(F.collect_set("label").alias("own"), F.max("containment").alias("best"))  # TEMPLATES bounds the set
    out = hits.join(materialize(per_doc, "licenses"), "row_key", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


__all__ = ["BASE", "MUST", "NEVER", "TEMPLATES", "THRESHOLD", "ascii_lower", "block_matches", "scan", "token_counts"]
