"""Ranked lexical search of all documents for each item of a benchmark, by bags of item terms that are scored once a class.

Documents are cut down to the items' vocabulary. Those that hold the same terms as often and have the same length norm m
form one class: a hash groups them and the whole bag is compared. A class is scored once, for all items, in blocks of
classes, and only an item's ten best classes are expanded to documents, by ascending doc_id. That loses nothing: every
class ahead of another has a document ahead of all of the other's, so an item's ten best documents lie in its ten best
classes, among the first ten members of each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import stash

#: Between terms stand these; terms are all other characters, with A-Z in lower case.
BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
TERM = f"[^{BETWEEN}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same by bytes of UTF-8: letters and digits of ASCII and all bytes beyond it stay, the rest becomes a space.
FOLD = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))
#: Items with up to so many terms together are searched for in one pass; a larger benchmark is dealt out in shares of whole items.
SHARE_TERMS = 1_000_000
#: Classes scored together, and distinct terms of items that a block of values has rows for.
BLOCK_CLASSES = 1024
BLOCK_TERMS = 4096
FIRST = -(1 << 63)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms) of the different rows of items; a null text has no terms."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    return items.select("item_id", "text").distinct().select("item_id", F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("terms"))


def bags(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, bag): a document's number of terms, and of the terms in ids the sorted numbers and how often each stands there.

    A bag is the numbers and then the counts, four bytes each; it is empty where a document holds none of the terms.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = ids.get
        for rows in batches:
            sizes, packed = [], []
            for text in rows.column(1):
                terms = (text.as_py() or b"").translate(FOLD).split()
                held = sorted((i, tf) for t, tf in Counter(terms).items() if (i := get(t)) is not None)
                sizes.append(len(terms))
                packed.append(np.array(held, np.int32).T.tobytes())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n", "bag"])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return plain.mapInArrow(each, "doc_id long, n long, bag binary")


def holders(held: DataFrame, n_terms: int) -> np.ndarray:
    """How many bags hold each of the numbered terms; every partition sends one row a term at most."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_terms, np.int64)
        for rows in batches:
            for bag in rows.column(0):
                counts[np.frombuffer(bag.as_py(), np.int32).reshape(2, -1)[0]] += 1
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for term, df in held.select("bag").mapInArrow(each, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return out


class Best:
    """The best few of scored classes: higher scores first, then smaller first documents."""

    def __init__(self, top: int):
        self.top, self.rows = top, np.zeros((0, 4), np.int64)

    def add(self, score: np.ndarray, others: np.ndarray) -> None:
        """Scores of a block of classes and, a row for each, (first, h, m)."""
        least = self.rows[-1, 0] if len(self.rows) == self.top else 1
        at = np.flatnonzero(score >= max(least, 1))
        if len(at):
            rows = np.vstack([self.rows, np.column_stack([score[at], others[at]])])
            self.rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], -rows[:, 0]))][: self.top]


def groups_of(items: list[list[int]], most: int) -> list[tuple[np.ndarray, list[tuple[int, np.ndarray]]]]:
    """Items by groups of at most `most` distinct terms, or one item: the sorted terms, and each item with its terms' places among them."""
    out, terms, members = [], set(), []
    for k, item in enumerate(items):
        if members and len(terms | set(item)) > most:
            out.append((terms, members))
            terms, members = set(), []
        terms = terms | set(item)
        members = [*members, k]
    out.append((terms, members))
    placed = []
    for terms, members in out:
        order = np.array(sorted(terms), np.int64)
        placed.append((order, [(k, np.searchsorted(order, items[k])) for k in members]))
    return placed


def best_classes(classes: DataFrame, items: list[list[int]], weights: np.ndarray, top: int) -> DataFrame:
    """(item, score, first, h, m): the best classes of each partition for each item, of (h, m, first, bag)."""
    parts = groups_of(items, BLOCK_TERMS)

    def score(block: list[tuple[int, int, int, np.ndarray]], best: list[Best]) -> None:
        others = np.array([(first, h, m) for h, m, first, _ in block], np.int64)
        row = np.repeat(np.arange(len(block)), [b.shape[1] for *_, b in block])
        term, tf = np.concatenate([b for *_, b in block], axis=1).astype(np.int64)
        value = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * others[row, 2]))
        for order, members in parts:
            at = np.minimum(np.searchsorted(order, term), len(order) - 1)
            own = order[at] == term
            values = np.zeros((len(order), len(block)), np.int64)
            values[at[own], row[own]] = value[own]
            for k, places in members:
                best[k].add(values[places].sum(axis=0), others)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, block = [Best(top) for _ in items], []
        for rows in batches:
            for h, m, first, bag in zip(*(c.to_pylist() for c in rows.columns)):
                block.append((h, m, first, np.frombuffer(bag, np.int32).reshape(2, -1)))
                if len(block) == BLOCK_CLASSES:
                    score(block, best)
                    block = []
        if block:
            score(block, best)
        sizes = [len(b.rows) for b in best]
        rows = np.vstack([b.rows for b in best])
        columns = [np.repeat(np.arange(len(best)), sizes), *rows.T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], names=["item", "score", "first", "h", "m"])

    return classes.select("h", "m", "first", "bag").mapInArrow(each, "item long, score long, first long, h long, m long")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 10, bound: int = SHARE_TERMS, depth: int = 0) -> DataFrame:
    """(item_id, rank, doc_id, score): the documents with the highest scores above 0 for each item, equal ones by ascending doc_id.

    A term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))); a document's score is the sum over an item's terms, with repeats,
    of w * (10^9 tf div (1000 tf + 8 m)) with m = 25 + 75 n N div L. Each row of docs is a document: rows that repeat a doc_id
    each have a rank, and null ids come first among equals. Null and empty texts hold no term and count nowhere; an item
    without terms, or with none that a document holds, has no rows. Rows of items that are equal count once; different texts of
    one item_id are ranked apart. Other columns are not read. A benchmark of more terms than `bound` is taken in shares of
    whole items, each with its own pass over docs; a single item is never split, its row being what exceeds the bound.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    asked = stash(item_terms(items).where(F.size("terms") > 0))
    n_items, n_terms = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    if not n_items:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    if n_terms > bound and n_items > 1:
        parts = max(2, -(-n_terms // bound))
        dealt = F.pmod(F.xxhash64(F.lit(depth), "item_id", "text"), F.lit(parts))
        return reduce(DataFrame.union, [rank_documents(docs, items.where(dealt == p), top, bound, depth + 1) for p in range(parts)])
    rows = asked.collect()
    vocabulary = sorted({t for r in rows for t in r["terms"]})
    number = {t: i for i, t in enumerate(vocabulary)}
    wanted = [[number[t] for t in r["terms"]] for r in rows]
    names = F.broadcast(spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(rows)], f"item long, item_id {kind}"))

    counted = stash(bags(docs, {t.encode(): i for t, i in number.items()}))
    n_docs, length = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = counted.where(F.octet_length("bag") > 0)
    df = holders(held, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)

    norm = F.lit(25) + F.expr(f"(75L * n * {n_docs}L) div {max(length, 1)}L")
    bagged = held.select("doc_id", F.coalesce("doc_id", F.lit(FIRST)).alias("place"), norm.alias("m"), "bag").withColumn("h", F.xxhash64("m", "bag"))
    # equal hashes are not enough: the bag itself is a key, and so compared
    classes = bagged.groupBy("h", "m", "bag").agg(F.min("place").alias("first"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "first", "h", "m")
    best = best_classes(classes, wanted, weights, top).withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    best = stash(best.drop("r"))
    # at most `top` classes an item, and so no more rows than the bound on items allows
    needed = F.broadcast(best.select("h", "m").distinct())
    inside = Window.partitionBy("h", "m", "bag").orderBy("place")
    members = bagged.join(needed, ["h", "m"], "left_semi").withColumn("r", F.row_number().over(inside)).withColumn("first", F.first("place").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    members = members.where(F.col("r") <= top).select("h", "m", "first", "doc_id")
    found = members.join(F.broadcast(best), ["h", "m", "first"])
    by_item = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= top)
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
