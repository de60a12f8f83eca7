"""Licence scans with a positional index of rare words, in DataFrame functions only.

Every text is cut into words once. The words of licence templates are weighed by how rare they are among all
documents; of each text all licence words are looked up in the postings of the templates' rarest words, hits that
agree on where the template would begin are added up, and a template is found where enough of its weight
lies at one place and its key phrase stands in the text. Fixed phrases are looked for beside that.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import stash

#: Label and phrase; a label is found wherever the phrase's words stand consecutively.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

#: Label, key phrase that must stand in the text, and the words of a licence notice.
TEMPLATES = (
    (
        "mit-text",
        "permission is hereby granted free of charge",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
    ),
    ("mit-notice", "the mit license", "released under the mit license"),
    (
        "apache-2.0",
        "apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
        "with the license",
    ),
    ("apache-2.0-notice", "apache license version 2 0", "licensed under the apache license version 2 0"),
    (
        "gpl-text",
        "gnu general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
    ),
    ("gpl-notice", "gnu general public license", "licensed under the gnu general public license"),
    (
        "lgpl",
        "gnu lesser general public license",
        "redistribute it and or modify it under the terms of the gnu lesser general public license",
    ),
    ("agpl", "gnu affero general public license", "under the terms of the gnu affero general public license"),
    (
        "bsd",
        "redistribution and use in source and binary forms",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
    ),
    (
        "mpl-2.0",
        "mozilla public license",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ),
    (
        "unlicense",
        "free and unencumbered software",
        "this is free and unencumbered software released into the public domain",
    ),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "cc by nd", "licensed under cc by nd 4 0"),
    (
        "cc-by-text",
        "creative commons attribution",
        "this work is licensed under a creative commons attribution 4 0 international license",
    ),
)

WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VOCABULARY = sorted({w for _, key, text in TEMPLATES for w in f"{key} {text}".split()} | {w for _, p in PHRASES for w in p.split()})


def words_of(text: str = "text") -> Column:
    """The words of a text, A-Z lowered; of null none."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(1))


def has_all(words: str, among: str) -> Column:
    """Whether the array holds every word of a phrase."""
    return reduce(lambda a, b: a & b, (F.array_contains(among, w) for w in sorted(set(words.split()))))


def has_any_of(phrases: list[str], among: str) -> Column:
    """Whether the array holds all words of any of the phrases."""
    return reduce(lambda a, b: a | b, (has_all(p, among) for p in phrases))


def stands_at(phrase: str, i: Column) -> Column:
    """Whether the phrase stands in words from place i."""
    return reduce(lambda a, b: a & b, (F.get("words", i + k) == w for k, w in enumerate(phrase.split())))


def places(phrase: str, words: str = "words") -> Column:
    """The places (words from 0) where the phrase's words stand consecutively."""
    last = F.size(words) - len(phrase.split())
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: stands_at(phrase, i))).otherwise(
        F.array().cast("array<int>")
    )


def word_facts(docs: DataFrame) -> DataFrame:
    """Per row doc_id, key (hash of the text), n_words, licence words, and all words where a phrase or key phrase may stand."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), words_of().alias("words"))
    rows = rows.select("*", F.array_intersect("words", F.array(*map(F.lit, VOCABULARY))).alias("known"))
    phrases = sorted({p for _, p in PHRASES} | {k for _, k, _ in TEMPLATES})
    maybe = has_any_of(phrases, "known")
    return rows.select(
        "doc_id", "key", F.size("words").cast("long").alias("n_words"), "known", F.when(maybe, F.col("words")).alias("words")
    )


def fixed_phrases(facts: DataFrame) -> DataFrame:
    """facts with n_base, first_word, last_word and base (labels found)."""
    empty = F.array().cast("array<int>")
    found = facts.withColumns(
        {
            f"__p{k}": F.when(F.col("words").isNotNull() & has_all(p, "known"), places(p)).otherwise(empty)
            for k, (_, p) in enumerate(PHRASES)
        }
    )
    spots = F.concat(*(f"__p{k}" for k in range(len(PHRASES))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"__p{k}") > 0, label) for k, (label, _) in enumerate(PHRASES))))
    return found.select(
        *facts.columns,
        F.size(spots).cast("long").alias("n_base"),
        F.array_min(spots).cast("long").alias("first_word"),
        F.array_max(spots).cast("long").alias("last_word"),
        labels.alias("base"),
    )


def rarity(facts: DataFrame) -> dict[str, float]:
    """Weights of the templates' words by the number of documents with them, over all documents."""
    counts = facts.select(F.explode("known").alias("word")).groupBy("word").count()
    seen = {r["word"]: r["count"] for r in counts.collect()}  # no more rows than the fixed vocabulary
    every = facts.count()
    return {w: math.log((every + 1) / (seen.get(w, 0) + 0.5)) for w in VOCABULARY}


def template_hits(facts: DataFrame, top: int = 12, least: float = 0.7, slack: int = 2) -> DataFrame:
    """(doc_id, key, label, coverage) for the templates that stand in a text: the share of the template's looked-up weight
    that agrees on one place to within `slack` words, `least` at least, with the key phrase in the text."""
    spark = facts.sparkSession
    weight = rarity(facts)
    postings, totals = [], {}
    for label, _, text in TEMPLATES:
        words = text.split()
        rare = sorted(set(words), key=lambda w: (-weight[w], w))[:top]
        totals[label] = sum(weight[w] for w in rare)
        postings += [(w, label, k, weight[w]) for k, w in enumerate(words) if w in rare]
    index = F.broadcast(spark.createDataFrame(postings, "word string, label string, at int, weight double"))
    some = facts.where("words is not null").select("doc_id", "key", "words", "known").distinct()
    spots = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("i"))), lambda x: F.array_contains("known", x["word"]))
    spots = some.select("doc_id", "key", F.inline(spots))
    begun = spots.join(index, "word").withColumn("start", F.col("i") - F.col("at"))
    wide = 2 * slack
    shifted = F.explode(F.array(F.floor(F.col("start") / wide) * 2, F.floor((F.col("start") + slack) / wide) * 2 + 1))
    begun = begun.select("doc_id", "key", "label", "word", "weight", shifted.alias("place"))
    begun = begun.groupBy("doc_id", "key", "label", "place", "word").agg(F.max("weight").alias("weight"))
    votes = begun.groupBy("doc_id", "key", "label", "place").agg(F.sum("weight").alias("weight"))
    best = votes.groupBy("doc_id", "key", "label").agg(F.max("weight").alias("weight"))
    whole = F.create_map(*(F.lit(x) for k, v in totals.items() for x in (k, v)))
    best = best.withColumn("coverage", F.least(F.lit(1.0), F.round(F.col("weight") / whole[F.col("label")], 6)))
    keys = some.select("doc_id", "key", F.explode(_key_labels()).alias("label"))
    best = best.where(F.col("coverage") >= least).alias("b").join(keys.alias("k"), _same("b", "k", "label"), "left_semi")
    return best.select("doc_id", "key", "label", "coverage")


def _key_labels() -> Column:
    """The labels of templates whose key phrase stands in the text."""
    tests = [F.when(has_all(key, "known") & (F.size(places(key)) > 0), label) for label, key, _ in TEMPLATES]
    return F.array_compact(F.array(*tests))


def _same(a: str, b: str, *more: str) -> Column:
    """Equal doc_id and key, nulls included."""
    tests = [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ("doc_id", "key", *more)]
    return reduce(lambda x, y: x & y, tests)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs.

    Null and empty texts have no words. Rows that repeat a doc_id and text are looked up once and all get the result;
    a null doc_id is a value like others. Columns other than doc_id and text are not read. score is 1 where a fixed
    phrase stands, else the best template's coverage, 0 without one.
    """
    facts = stash(word_facts(docs.select("doc_id", "text")))
    hits = template_hits(facts).groupBy("doc_id", "key").agg(F.collect_set("label").alias("own"), F.max("coverage").alias("coverage"))
    base = fixed_phrases(facts).drop("known", "words")
    joined = base.alias("f").join(stash(hits).alias("h"), _same("f", "h"), "left")
    labels = F.array_union("base", F.coalesce("own", F.array().cast("array<string>")))
    return joined.select(
        "f.doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("coverage", F.lit(0.0))).alias("score"),
    )
