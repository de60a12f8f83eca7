"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every text is scanned once for word n-grams of the benchmark; around the hits, passages are cut out. Every n-gram of an
item is a seed, common or not, so that one intact n-gram is enough and what other documents hold plays no part. Seeds join
passages to items, and a local alignment of words scores each pair that has words enough in common to reach the least
score: copies score 1, edited or paraphrased ones somewhat less.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillspark.llm.common import stash

#: Of copies with a quarter of 30 words exchanged, four words in a row are left in 0.99, and hardly any other text holds them.
GRAM = 4
LEAST = 0.5
#: The benchmark's distinct words and n-grams go to every worker while they are this few; beyond, they are joined.
BROADCAST_GRAMS = 2_000_000
REACH = 1.5
WORDS_AT_ONCE = 1 << 16


def word_list(text: str | None) -> list[str]:
    """The words of a text in lower case, without punctuation at their ends."""
    return [w.strip(".,;:!?\"'()[]{}*#$%&|") for w in text.lower().split()] if text else []


def word_id(word: str) -> int:
    """A hash of a word as a signed 64-bit number."""
    h = xxh64_intdigest(word.encode("utf-8", "replace"), 17)
    return h - (1 << 64) if h >= 1 << 63 else h


def gram_ids(ids: np.ndarray, width: int = GRAM) -> np.ndarray:
    """Hashes of all n-grams of word hashes."""
    if len(ids) < width:
        return np.zeros(0, np.int64)
    out = np.zeros(len(ids) - width + 1, np.uint64)
    x = ids.view(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out ^ x[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def align(a: np.ndarray, b: np.ndarray, match: int = 2, other: int = -1, gap: int = -1) -> int:
    """The best local alignment score (Smith-Waterman) of two sequences of word hashes."""
    if not len(a) or not len(b):
        return 0
    steps = np.arange(1, len(b) + 1) * -gap
    row, best = np.zeros(len(b) + 1, np.int64), 0
    for x in a:
        up = np.maximum(row[:-1] + np.where(b == x, match, other), row[1:] + gap)
        up = np.maximum(up, 0)
        row[1:] = np.maximum.accumulate(up + steps) - steps  # gaps along b
        np.maximum(row, 0, out=row)
        best = max(best, int(row.max()))
    return best


def benchmark_grams(items: DataFrame) -> DataFrame:
    """(item_id, ids array<long>, words int) of the items, and with them their n-grams."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ids = [np.fromiter(map(word_id, word_list(t)), np.int64) for t in rows["text"]]
            grams = [gram_ids(x, min(GRAM, max(1, len(x)))) for x in ids]
            yield pd.DataFrame({"item_id": rows["item_id"], "ids": ids, "grams": grams, "words": [word_list(t) for t in rows["text"]]})

    plain = items.where("text is not null").select(F.col("item_id").cast("long"), "text")
    return plain.mapInPandas(each, "item_id long, ids array<long>, grams array<long>, words array<string>").where("size(ids) > 0")


def passages(docs: DataFrame, words: frozenset, grams: np.ndarray, widths: tuple[int, ...], longest: int) -> DataFrame:
    """(doc_id, ids, hits): stretches of texts around benchmark n-grams, with the word hashes there and the distinct n-grams hit.

    Stretches reach so far to both sides of a hit that the longest item fits; those that meet are one.
    """
    reach = int(longest * REACH) + GRAM
    ids = {w: word_id(w) for w in words}
    known = np.sort(grams)

    def found(texts: pd.Series, doc_ids: pd.Series) -> Iterator[tuple]:
        get = ids.get
        for doc_id, text in zip(doc_ids, texts):
            listed = word_list(text)
            if not listed:
                continue
            x = np.fromiter((get(w, 0) for w in listed), np.int64, len(listed))
            spots, which = [], []
            for width in widths:
                g = gram_ids(x, width)
                at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                hit = np.nonzero(known[at] == g)[0] if len(known) and len(g) else np.zeros(0, np.int64)
                spots.append(hit)
                which.append(g[hit])
            spot, gram = np.concatenate(spots), np.concatenate(which)
            if not len(spot):
                continue
            order = np.argsort(spot, kind="stable")
            spot, gram = spot[order], gram[order]
            breaks = np.nonzero(np.diff(spot) > 2 * reach)[0] + 1
            for part, own in zip(np.split(spot, breaks), np.split(gram, breaks)):
                low, high = max(0, part[0] - reach), min(len(x), part[-1] + GRAM + reach)
                # a very long stretch is cut into overlapping ones, each longer than two items
                for start in range(low, high, 8 * reach):
                    end = min(high, start + 10 * reach)
                    inside = np.unique(own[(part >= start) & (part < end)])
                    if len(inside):
                        yield doc_id, int(start), x[start:end], inside
                    if end == high:
                        break

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame(list(found(rows["text"], rows["doc_id"])), columns=["doc_id", "start", "ids", "hits"])

    plain = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return plain.mapInPandas(each, "doc_id long, start long, ids array<long>, hits array<long>")


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST, bound: int = BROADCAST_GRAMS, depth: int = 0) -> DataFrame:
    """(doc_id, item_id, score) for documents that hold an item, or an edited copy of it, whole or in good part.

    score is the best local alignment's share of the item's own, from 0 to 1, `least` at least. Null and empty texts and
    rows with a null doc_id or item_id match nothing; rows that repeat a doc_id count as one document. Items shorter than
    an n-gram are sought whole. Other columns are not read. A benchmark of more n-grams than `bound` is taken in shares of
    whole items; an item of more by itself is a share, the only one that may exceed it. depth counts how often it was shared out.
    """
    bench = stash(benchmark_grams(items.where("item_id is not null").select("item_id", "text")))
    spots = bench.select("item_id", F.posexplode("grams").alias("at", "gram"))
    sizes = bench.agg(F.max(F.size("ids")), F.count("*"), F.sum(F.size("grams"))).first()
    spark = docs.sparkSession
    if not sizes[1]:
        return spark.createDataFrame([], "doc_id long, item_id long, score double")
    if sizes[2] > bound and bench.select("item_id").distinct().limit(2).count() > 1:
        parts = max(2, -(-sizes[2] // bound))
        dealt = F.pmod(F.xxhash64(F.lit(depth), F.col("item_id").cast("long")), F.lit(parts))
        shares = [contaminated(docs, items.where(dealt == p), least, bound, depth + 1) for p in range(parts)]
        return reduce(DataFrame.union, shares)
    words = frozenset(w for (w,) in bench.select(F.explode("words")).distinct().collect())
    grams = np.array([g for (g,) in spots.select("gram").distinct().collect()], np.int64)
    short = [w for (w,) in bench.select(F.least(F.size("ids"), F.lit(GRAM))).distinct().collect()]
    cut = stash(passages(docs, words, grams, tuple(sorted(short)), sizes[0]))
    # no more rows than the bound, so that a common n-gram needs no shuffle by it
    seeds = F.broadcast(spots.select("item_id", "gram").distinct())
    met = cut.select("doc_id", "start", F.explode("hits").alias("gram")).join(seeds, "gram")
    met = met.select("doc_id", "start", "item_id").distinct()
    # what a passage is compared with: each item that it shares a seed with, once
    pairs = met.join(cut.select("doc_id", "start", "ids").dropDuplicates(["doc_id", "start"]), ["doc_id", "start"])
    pairs = pairs.join(F.broadcast(bench.select("item_id", F.col("ids").alias("own"))), "item_id")

    @F.pandas_udf("double")
    def score(ids: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(map(np.asarray, ids), map(np.asarray, own)):
            # no alignment matches more words of the item than stand in the passage
            out.append(align(y, x) / (2 * len(y)) if np.isin(y, x).mean() >= least else 0.0)
        return pd.Series(out, dtype=float)

    scored = pairs.select("doc_id", "item_id", score("ids", "own").alias("score"))
    best = scored.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))
    return best.where(F.col("score") >= least)


def drop_contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """docs without the documents that hold a benchmark item; all columns as they were.

    Rows that share a doc_id go together; rows with a null doc_id are told apart by a hash of their text.
    """
    found = stash(contaminated(docs, items, least).select("doc_id").distinct())
    kept = docs.join(found, docs["doc_id"].cast("long") == found["doc_id"], "left_anti").select(*docs.columns)
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return kept
    name = F.xxhash64("text")
    found = stash(contaminated(nameless.select(name.alias("doc_id"), "text"), items, least).select(F.col("doc_id").alias("__name")).distinct())
    rest = nameless.join(found, name == F.col("__name"), "left_anti").select(*docs.columns)
    return kept.where("doc_id is not null").unionByName(rest)
