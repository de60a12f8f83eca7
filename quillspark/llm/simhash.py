"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked where few bits differ.

Fingerprints are compared exactly, tile against tile, with numpy exclusive-or and bit counts; tile pairs whose
population counts differ by more than the radius are skipped. Two fingerprints within the radius r agree
in at least one of r + 1 blocks of bits, so tiles are only drawn from fingerprints that share a hash
bucket of a block, and the work grows with the input rather than with its square.

Similarities of 0.8 or more need some 20 bits, for which 64 bits hold no selective blocks: there, tiles are drawn from
texts that share a band of minimum hashes, and pairs within the radius are verified by their sets of shingles in the
task that finds them, so that rows grow with the texts of a group and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from quillspark.llm.common import components, merge_links, release, spread_buckets, stash

WORDS_AT_ONCE = 1 << 16
TILE = 512
#: Minimum hashes: a pair at similarity 0.8 shares none of 24 bands of 4 with chance 0.000003.
BANDS, BAND_ROWS = 24, 4
#: What a candidate weighs beside its shingles where sets are dealt to tasks, and shingles that one text is compared with at once.
SET_WEIGHT, SHINGLES_AT_ONCE = 256, 1 << 19
#: Up to so many ids are broadcast to the documents, whose texts are then not shuffled.
BROADCAST_IDS = 2_000_000


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles as a signed 64-bit number; 0 for a text without words."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    votes = np.zeros(64, np.int64)
    for start in range(0, n, WORDS_AT_ONCE):
        part = words[start : min(start + WORDS_AT_ONCE, n) + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
        hashes = np.frombuffer(b"".join(map(xxh64_digest, shingles, repeat(seed))), np.uint8).reshape(-1, 8)
        votes += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, text: str = "text") -> DataFrame:
    """docs with a column fp. Null and empty texts have the fingerprint 0."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width, seed) for t in texts], dtype="int64")

    return docs.withColumn("fp", fp(F.col(text)))


def linked_tiles(fps: np.ndarray, side: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join what fps links within the radius: of each found group, every member with its smallest.

    side tells two tiles apart, of which only pairs across count; None: all pairs count.
    """
    pop = np.bitwise_count(fps)
    order = np.argsort(pop, kind="stable")
    fps, pop = fps[order], pop[order]
    side = None if side is None else side[order]
    label = np.arange(len(fps))
    for a in range(0, len(fps), TILE):
        x, most = fps[a : a + TILE], pop[min(a + TILE, len(fps)) - 1]
        for b in range(a, len(fps), TILE):
            if pop[b] > most + radius:
                break
            near = np.bitwise_count(x[:, None] ^ fps[None, b : b + TILE]) <= radius
            if side is not None:
                near &= side[a : a + TILE][:, None] != side[None, b : b + TILE]
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            own = i < j
            label = merge_links(label, i[own], j[own])
    moved = np.nonzero(label != np.arange(len(fps)))[0]
    return fps[moved], fps[label[moved]]


def link_fingerprints(fps: DataFrame, radius: int = 2, bucket_rows: int = 2048, split_rows: int = 16384) -> DataFrame:
    """Links (a, b) among the distinct fps whose components are those of all pairs within the radius."""
    spans = np.array_split(np.arange(64), radius + 1)
    rows = fps.count()
    buckets = max(1, rows // bucket_rows)
    keys = [
        F.pmod(F.xxhash64(F.lit(k), F.shiftrightunsigned("fp", int(s[0])).bitwiseAND((1 << len(s)) - 1)), F.lit(buckets))
        * (radius + 1)
        + k
        for k, s in enumerate(spans)
    ]
    spread = fps.select("fp", F.explode(F.array(*keys)).alias("bucket")).withColumn("salt", F.xxhash64("fp"))

    def links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        two = key[1] != key[2]
        a, b = linked_tiles(rows["fp"].to_numpy().view(np.uint64), rows["tile"].to_numpy() if two else None, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    spread = spread_buckets(spread, split_rows).select("bucket", "lo", "hi", "tile", "fp")
    return spread.groupBy("bucket", "lo", "hi").applyInPandas(links, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs: component_id is the smallest doc_id that links reach.

    Null, empty and blank texts share the fingerprint 0 and are linked like others. Rows that repeat a text
    share its fingerprint. A null doc_id never names a component, unless all its members are null. Columns
    other than doc_id and text are not read.
    """
    prints = stash(fingerprints(docs.select("doc_id", "text"), width, seed).select("doc_id", "fp"))
    distinct = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = stash(components(link_fingerprints(distinct, radius)))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    named = stash(named.select("fp", "low", F.coalesce("component", "fp").alias("head")))
    heads = named.groupBy("head").agg(F.min("low").alias("component_id"))
    named = named.join(heads, "head").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles in order; none for a text without words."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.frombuffer(b"".join(map(xxh64_digest, shingles, repeat(42))), np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of a set's minimum hashes."""
    factors = np.random.default_rng(5).integers(0, 1 << 63, (BANDS * BAND_ROWS, 2)).astype(np.uint64)
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(hashes), 4096):
            mixed = hashes[start : start + 4096, None] * (factors[:, 0] * np.uint64(2) + np.uint64(1)) + factors[:, 1]
            np.minimum(least, mixed.min(axis=0), out=least)
        keys = np.arange(BANDS, dtype=np.uint64)
        for part in least.reshape(BANDS, BAND_ROWS).T:
            keys = (keys ^ part) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(29)
    return keys


def near_pairs(rows: pd.DataFrame, radius: int, across: bool, star: bool) -> pd.DataFrame:
    """Pairs (a, b) of different labels that share a key and are within the radius; across: of different tiles too.

    star: not all of them, but of each group that they join, every member with one other.
    """
    rows = rows.sort_values(["key", "id"])
    ids, keys, tile, label = (rows[c].to_numpy() for c in ("id", "key", "tile", "label"))
    fps, group, found = rows["fp"].to_numpy().view(np.uint64), np.arange(len(rows)), []
    for a in range(0, len(rows), TILE):
        x, last = slice(a, a + TILE), keys[min(a + TILE, len(rows)) - 1]
        for b in range(a, len(rows), TILE):
            if keys[b] > last:
                break
            y = slice(b, b + TILE)
            near = (keys[x, None] == keys[None, y]) & (label[x, None] != label[None, y])
            near &= np.bitwise_count(fps[x, None] ^ fps[None, y]) <= radius
            if across:
                near &= tile[x, None] != tile[None, y]
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            own = i < j
            if star:
                group = merge_links(group, i[own], j[own])
            else:
                found.append(np.stack([ids[i[own]], ids[j[own]]]))
    if star:
        moved = np.nonzero(group != np.arange(len(rows)))[0]
        found = [np.stack([ids[moved], ids[group[moved]]])]
    a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def alike_links(rows: pd.DataFrame, radius: int, least: float, across: bool) -> pd.DataFrame:
    """Links (a, b) that join what candidate pairs of a similarity of `least` or more link: every member with its smallest.

    Candidates are of one group, share a band, and are within the radius; across: of different tiles too. A pair that earlier
    links have joined is not looked at again.
    """
    rows = rows.sort_values(["group", "id"])
    ids, group, tile, sets = (rows[c].to_numpy() for c in ("id", "group", "tile", "set"))
    fps, bands, label = rows["fp"].to_numpy().view(np.uint64), np.stack(rows["bands"].to_numpy()), np.arange(len(rows))
    sizes = np.fromiter(map(len, sets), np.int64, len(rows))
    starts, ends = np.cumsum(sizes) - sizes, np.searchsorted(group, group, side="right")
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    own = np.zeros(len(codes), bool)  # by code: whether the text at hand has it
    for i, end in enumerate(ends):
        y = slice(i + 1, end)
        near = (label[y] != label[i]) & (np.bitwise_count(fps[y] ^ fps[i]) <= radius)
        near &= np.minimum(sizes[y], sizes[i]) >= least * np.maximum(sizes[y], sizes[i])
        if across:
            near &= tile[y] != tile[i]
        near = np.nonzero(near)[0] + i + 1
        near = near[(bands[near] == bands[i]).any(axis=1)]
        if not len(near):
            continue
        mine = codes[starts[i] : starts[i] + sizes[i]]
        own[mine] = True
        at_once = max(1, SHINGLES_AT_ONCE // max(1, len(mine)))
        for start in range(0, len(near), at_once):
            j = near[start : start + at_once]
            first = np.cumsum(sizes[j]) - sizes[j]
            places = np.arange(sizes[j].sum()) + np.repeat(starts[j] - first, sizes[j])
            both = np.add.reduceat(own[codes[places]], first, dtype=np.int64) if len(mine) else np.zeros(len(j), np.int64)
            j = j[both >= least * (len(mine) + sizes[j] - both)]
            label = merge_links(label, np.full(len(j), i), j)
        own[mine] = False
    moved = np.nonzero(label != np.arange(len(rows)))[0]
    return pd.DataFrame({"a": ids[label[moved]], "b": ids[moved]})


def described_texts(docs: DataFrame, width: int) -> DataFrame:
    """(id, h1, h2, low, fp, bands) of the different texts of docs (doc_id, text), written out: low is the smallest doc_id.

    Null texts are like empty ones. Texts stay where they are: what is shuffled is of a fixed size for each.
    """

    @F.pandas_udf("fp long, bands array<long>")
    def described(texts: pd.Series) -> pd.DataFrame:
        bands = [band_keys(shingle_hashes(t, width)).view(np.int64) for t in texts]
        return pd.DataFrame({"fp": pd.Series([fingerprint(t, width) for t in texts], dtype="int64"), "bands": bands})

    seen = docs.select("doc_id", *text_name(), described("text").alias("d")).select("doc_id", "h1", "h2", "d.fp", "d.bands")
    texts = seen.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    return stash(texts.select(F.monotonically_increasing_id().alias("id"), "*"))


def text_name() -> list[Column]:
    """A name of a text: two independent hashes, h1 and h2."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2")]


def similar_links(docs: DataFrame, texts: DataFrame, width: int, radius: int, least: float, split_rows: int = 8192, split_weight: int = 1 << 20) -> DataFrame:
    """Links (a, b) among described texts whose components are those of all candidate pairs of a similarity of `least` or more.

    Candidates are first joined to groups by links that grow with their number; sets then meet by group and tile, where every
    candidate pair is verified. Pairs that fail are never rows.
    """

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for start in range(0, len(rows), 256):  # sets are longer than texts: few of them at a time
                part = rows.iloc[start : start + 256]
                yield pd.DataFrame({"id": part["id"], "set": [shingle_hashes(t, width).view(np.int64) for t in part["text"]]})

    def star(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return near_pairs(rows, radius, key[1] != key[2], True)

    def verified(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return alike_links(rows, radius, least, key[1] != key[2])

    entered = texts.select("id", "fp", F.explode("bands").alias("key"))
    shared = entered.groupBy("key").count().where("count > 1").select("key")
    entered = stash(entered.join(shared, "key").withColumn("label", F.col("id")))
    buckets = max(1, entered.count() // 2048)
    spread = entered.withColumns({"bucket": F.pmod("key", F.lit(buckets)), "salt": F.xxhash64("id")})
    spread = spread_buckets(spread, split_rows)
    met = stash(spread.groupBy("bucket", "lo", "hi").applyInPandas(star, "a long, b long").distinct())
    groups = components(met).withColumnsRenamed({"node": "id", "component": "group"})
    few = stash(texts.join(groups, "id").select("id", "h1", "h2", "fp", "bands", "group"))
    release(entered, met)
    names = few.select("id", "h1", "h2")
    named = docs.select(*text_name(), "text").join(F.broadcast(names) if few.count() <= BROADCAST_IDS else names, ["h1", "h2"])
    sets = named.select("id", "text").mapInPandas(shingles, "id long, set array<long>").dropDuplicates(["id"])
    weight = (F.size("set") + SET_WEIGHT).cast("long").alias("weight")
    sets = stash(few.select("id", "fp", "bands", "group").join(sets, "id").select("*", weight))
    buckets = max(1, 4 * (sets.agg(F.sum("weight")).first()[0] or 0) // split_weight)
    spread = sets.withColumns({"bucket": F.pmod(F.xxhash64("group"), F.lit(buckets)), "salt": F.xxhash64("id")})
    spread = spread_buckets(spread, split_weight, F.col("weight"))
    found = stash(spread.groupBy("bucket", "lo", "hi").applyInPandas(verified, "a long, b long"))
    release(few, sets)
    return found


def similar_documents(docs: DataFrame, width: int = 5, radius: int = 20, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for each row of docs, where texts are linked whose shingle sets have a similarity of `least` or more.

    Texts of equal words are one; null, empty and blank texts are alike. component_id is as in near_duplicates.
    """
    rows = docs.select("doc_id", "text")
    texts = described_texts(rows, width)
    found = stash(components(similar_links(rows, texts, width, radius, least)))
    heads = texts.select("id", "h1", "h2", "low").join(found.withColumnRenamed("node", "id"), "id", "left")
    heads = stash(heads.select("h1", "h2", "low", F.coalesce("component", "id").alias("head")))
    release(texts, found)
    lowest = heads.groupBy("head").agg(F.min("low").alias("component_id"))
    heads = heads.join(lowest, "head").select("h1", "h2", "component_id")
    return rows.select("doc_id", *text_name()).join(heads, ["h1", "h2"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = 3, radius: int = 2, least: float | None = None) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id stays, all columns as they were.

    Components are those of fingerprints within the radius, or, with `least`, of verified similarities.
    Rows with a null doc_id have no identity to compare and stay. Of rows that repeat a doc_id, all stay or
    go together, but for rows that repeat its text too, of which one stays.
    """
    found = near_duplicates(docs, width, radius) if least is None else similar_documents(docs, width, radius, least)
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept"), F.count("*").alias("rows"))
    ids = stash(ids.where("not kept or rows > 1"))
    few = ids.count() <= BROADCAST_IDS
    side = lambda df: F.broadcast(df.select("doc_id")) if few else df.select("doc_id")
    kept = docs.join(side(ids.where("not kept")), "doc_id", "left_anti")
    again = ids.where("kept and rows > 1")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(side(again), "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(kept.join(side(again), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns))
