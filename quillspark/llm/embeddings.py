"""Near-duplicate embeddings by Euclidean p-stable hashing.

Unit vectors are projected on random directions, shifted and quantised; several such values make a bucket in each
of many tables. Vectors that share a bucket are candidates where a byte a component can't rule them out, and what candidates
connect is compared exactly, in double precision, every pair once. A task gives sums and spanning links, never pairs.

What tables deal out goes with their number, which grows with the input: they are gone through a few at a time, and
the shuffle files of each round are deleted before the next.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import components, merge_links, release, shuffles_dropped, spread_buckets, stash

TILE = 512
#: So many rows are compared in one call, or one split group.
GROUP_ROWS = 8192
#: So many rows of buckets are looked through in one call, but that a bucket is not split.
SPOTS = 32768
#: Buckets of more rows are compared by matrix products.
SMALL = 32
#: Tables of a round: as many as deal out so many bytes, LEAST_TABLES at least.
ROUND_BYTES = 256 << 20
LEAST_TABLES = 8
#: Bytes of rows that a task makes at once.
HELD_BYTES = 16 << 20
#: Most bytes of vectors in a tile of a group that is split.
TILE_BYTES = 32 << 20
QUANTUM = 2.0
MISS = 0.02


def collision(distance: float, quantum: float) -> float:
    """The chance that two points at this distance share one quantised projection."""
    t = quantum / distance
    cdf = 0.5 * (1 + math.erf(-t / math.sqrt(2)))
    return 1 - 2 * cdf - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(rows: int, least: float, quantum: float = QUANTUM, miss: float = MISS) -> tuple[int, int]:
    """(values in a bucket's key, tables): unrelated unit vectors share about one bucket in all, and a pair
    at the least similarity is missed in all tables with chance `miss`."""
    far, near = collision(math.sqrt(2), quantum), collision(math.sqrt(2 - 2 * least), quantum)
    width = max(4, math.ceil(math.log(max(rows, 2)) / -math.log(far)))
    return width, math.ceil(math.log(miss) / math.log(1 - near**width))


def unit(x: np.ndarray) -> np.ndarray:
    """The rows of x, which are finite and not zero, as unit vectors in double precision, the same in whatever batch a row comes."""
    v = x.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).cumsum(axis=1)[:, -1:]) + 0.0


def _kind(vectors: DataFrame) -> str:
    """What the components of vectors are, or are made to be."""
    return "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"


def told(vectors: DataFrame, whole: bool) -> DataFrame:
    """(vec_id, h, and if whole x): 128 bits of hash of the unit vector, null for rows that are not finite or zero; x holds the bytes of the vector."""
    kind = "array<float>" if _kind(vectors) == "<f4" else "array<double>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(at))
            h: list[bytes | None] = [None] * len(sizes)
            raw: list[bytes | None] = [None] * len(sizes)
            for size in np.unique(sizes[sizes > 0]):
                own = np.flatnonzero(sizes == size)
                step = max(1, HELD_BYTES // (8 * int(size)))
                for rows in (own[i : i + step] for i in range(0, len(own), step)):
                    x = values[at[rows][:, None] + np.arange(size)]
                    good = np.isfinite(x).all(axis=1) & x.any(axis=1)
                    for r, one, u in zip(rows[good], x[good], unit(x[good])):
                        h[r] = hashlib.blake2b(u.tobytes(), digest_size=16).digest()
                        raw[r] = one.tobytes() if whole else None
            out = {"vec_id": batch.column("vec_id"), "h": pa.array(h, pa.binary())}
            yield pa.RecordBatch.from_pydict(out | ({"x": pa.array(raw, pa.binary())} if whole else {}))

    fields = [vectors.schema["vec_id"], T.StructField("h", T.BinaryType()), T.StructField("x", T.BinaryType())]
    return vectors.select("vec_id", F.col("embedding").cast(kind)).mapInArrow(each, T.StructType(fields[: 2 + whole]))


def spot_type(size: int) -> np.dtype:
    """A vector of this size in a bucket: a byte for each component, what they are multiples of, and the length of what they leave."""
    return np.dtype([("key", "<i8"), ("id", "<i8"), ("step", "<f4"), ("rest", "<f4"), ("q", "i1", (size,))])


def spots(nodes: DataFrame, kind: str, width: int, tables: int, first: int, last: int, parts: int, seed: int) -> DataFrame:
    """(part, size, rows): the vectors of nodes (id, x) in their buckets of the tables from first to last, dealt to parts by bucket."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = last - first
        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        # sums of small whole numbers times these are exact
        mix = np.random.default_rng(seed).integers(1, 1 << 44, (tables, width), dtype=np.int64)[first:last].astype(np.float64)
        for batch in batches:
            ids, raw = batch.column("id").to_numpy(), batch.column("x").to_pylist()
            sizes = np.array([len(x) for x in raw]) // np.dtype(kind).itemsize
            for size in map(int, np.unique(sizes)):
                if size not in made:
                    rng = np.random.default_rng([seed, size])
                    ways, shifts = rng.standard_normal((size, tables * width)), rng.uniform(0, QUANTUM, tables * width)
                    cut = slice(first * width, last * width)
                    made[size] = (ways[:, cut] / QUANTUM).astype(np.float32), (shifts[cut] / QUANTUM).astype(np.float32)
                kept = spot_type(size)
                own = np.flatnonzero(sizes == size)
                step = max(1, HELD_BYTES // (k * (kept.itemsize + 8 * width)))
                for rows in (own[i : i + step] for i in range(0, len(own), step)):
                    u = unit(np.frombuffer(b"".join(raw[r] for r in rows), kind).reshape(len(rows), size))
                    p = u.astype(np.float32) @ made[size][0]
                    p += made[size][1]
                    np.floor(p, out=p)
                    key = np.einsum("rtw,tw->rt", p.reshape(len(rows), k, width).astype(np.float64), mix).astype(np.int64)
                    with np.errstate(over="ignore"):
                        key = (key * 31 + (np.arange(first, last) << 8) + size) * -7046029254386353131
                    key ^= (key >> 31) & 0x1FFFFFFFF
                    grain = np.abs(u).max(axis=1) / 127
                    q = np.rint(u / grain[:, None])
                    grain = grain.astype(np.float32)
                    rest = np.sqrt(((u - q * grain[:, None]) ** 2).sum(axis=1)) * (1 + 1e-6)
                    part = ((key & 0x7FFFFFFFFFFFFFFF) % parts).ravel()
                    order = np.argsort(part, kind="stable")
                    row = order // k
                    out = np.empty(len(order), kept)
                    out["key"], out["id"], out["step"], out["rest"] = key.ravel()[order], ids[rows][row], grain[row], rest[row]
                    out["q"] = q.astype(np.int8)[row]
                    to, at = np.unique(part[order], return_index=True)
                    blobs = [out[a:b].tobytes() for a, b in zip(at, [*at[1:], len(out)])]
                    yield pa.RecordBatch.from_pydict({"part": pa.array(to, pa.int64()), "size": pa.array([size] * len(to), pa.int32()), "rows": pa.array(blobs, pa.binary())})

    return nodes.select("id", "x").mapInArrow(each, "part long, size int, rows binary")


def candidates(rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows of spot_type: ids, and the smallest id that each leads to by links in its bucket, for those that differ.

    Links are all pairs of a bucket whose cosine may be `least`, as far as a byte a component can tell.
    """
    order = np.lexsort((rows["id"], rows["key"]))
    key = rows["key"][order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(edge, len(key)))
    rows = rows[order[np.repeat(count > 1, count)]]
    count = count[count > 1]
    if not len(count):
        return rows["id"], rows["id"]
    rest, x = rows["rest"], rows["q"].astype(np.float32) * rows["step"][:, None]
    label, left = np.arange(len(rows)), np.repeat(np.cumsum(count), count) - np.arange(len(rows))
    few = np.repeat(count <= SMALL, count)
    # what a cosine may be above that of the rounded vectors, and what the sums in single precision may be off
    fits = lambda near, i, j: near >= least - 1e-4 - rest[i] - rest[j] * (1 + rest[i])
    links = []
    for d in range(1, int(count[count <= SMALL].max(initial=0))):
        i = np.flatnonzero(few & (left > d))
        i = i[fits(np.einsum("ij,ij->i", x[i], x[i + d]), i, i + d)]
        links.append((i, i + d))
    if links:
        label = merge_links(label, *map(np.concatenate, zip(*links)))
    for end, n in zip(np.cumsum(count)[count > SMALL], count[count > SMALL]):
        own = slice(end - n, end)
        sub, y, r, inner = label[own] - own.start, x[own], rest[own], None
        for a in range(0, n, TILE):
            for b in range(a, n, TILE):
                p, q = slice(a, a + TILE), slice(b, b + TILE)
                inner = y[p] @ y[q].T
                i, j = np.nonzero(inner >= least - 1e-4 - r[p][:, None] - r[q][None, :] * (1 + r[p][:, None]))
                sub = merge_links(sub, i + a, j + b)
        label[own] = sub + own.start
    some = label != np.arange(len(rows))
    return rows["id"][some], rows["id"][label[some]]


def compare(rows: pd.DataFrame, kind: str, across: bool, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one group: ids that have links, the id that each leads to, and the number of links, summed over copies."""
    ids, copies, tile, sizes = rows["id"].to_numpy(), rows["copies"].to_numpy(), rows["tile"].to_numpy(), rows["x"].map(len).to_numpy()
    links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        x = unit(np.frombuffer(b"".join(rows["x"].to_numpy()[own]), kind).reshape(len(own), -1))
        for a in range(0, len(own), TILE):
            for b in range(a, len(own), TILE):
                p, q = own[a : a + TILE], own[b : b + TILE]
                near = x[a : a + TILE] @ x[b : b + TILE].T >= least
                if across:
                    near &= tile[p][:, None] != tile[q][None, :]
                if a == b:
                    near = np.triu(near, 1)
                if not near.any():
                    continue
                links[p] += near @ copies[q]
                links[q] += copies[p] @ near
                i, j = np.nonzero(near)
                label = merge_links(label, p[i], q[j])
    some = (links > 0) | (label != np.arange(len(ids)))
    return ids[some], ids[label[some]], links[some]


def near_duplicates(
    vectors: DataFrame, least: float = 0.9, tables: int | None = None, split_rows: int = 4096, seed: int = 5
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding).

    Pairs that share a bucket link where their cosine is at least `least`, and so do others of what such pairs connect;
    none else. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do vectors of
    different sizes. Rows with equal directions are compared once and link among themselves. component_id is the smallest
    vec_id reached, itself included; a null vec_id never names a component that has others. Other columns are not read.
    """
    kind = _kind(vectors)
    with shuffles_dropped(vectors.sparkSession):
        named = stash(told(vectors, False))
        # equal vectors are one node, named by a hash of 128 bits, and numbered as it is written out
        nodes = told(vectors, True).where("h is not null").groupBy("h")
        nodes = nodes.agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.min("x").alias("x"))
        nodes = stash(nodes.withColumn("id", F.monotonically_increasing_id()))
        n, longest = nodes.agg(F.count("*"), F.coalesce(F.max(F.octet_length("x")), F.lit(1))).first()
        found = _linked(nodes, kind, n, longest, least, tables, split_rows, seed)
        sums = found.groupBy("a").agg(F.sum("links").alias("links")).select(F.col("a").alias("id"), "links")
        heads = components(found.select("a", "b")).withColumnRenamed("node", "id")
        heads = heads.join(sums, "id", "left").join(nodes.select("id", "h", "low", "copies"), "id")
        lows = heads.groupBy("component").agg(F.min("low").alias("component_id"))
        heads = stash(heads.join(lows, "component").select("h", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
        # what links with no other direction
        others = nodes.where("copies > 1").select("h", (F.col("copies") - 1).alias("n_links"), F.col("low").alias("component_id"))
        linked = stash(heads.union(others.join(heads.select("h"), "h", "left_anti")))
        release(nodes, found, heads)
    rows = named.join(linked.withColumnRenamed("h", "hash"), F.col("h") == F.col("hash"), "left")
    rows = rows.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("hash").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _linked(nodes: DataFrame, kind: str, n: int, longest: int, least: float, tables: int | None, split_rows: int, seed: int) -> DataFrame:
    """(a, b, links): ids that have links, an id that each leads to, and how many; an id has a row for each group it is compared in."""
    width, planned = plan(n, least, QUANTUM)
    tables = tables or planned
    a_table = max(1, n) * spot_type(longest // np.dtype(kind).itemsize).itemsize
    step = max(LEAST_TABLES, ROUND_BYTES // a_table)

    def look(part: pa.Table) -> pa.Table:
        out, size = [], part.column("size").to_numpy()
        for one in np.unique(size):
            blob = b"".join(x.as_py() for x in part.column("rows").filter(pa.array(size == one)))
            out.append(candidates(np.frombuffer(blob, spot_type(int(one))), least))
        pairs = pd.DataFrame(dict(zip("ab", map(np.concatenate, zip(*out))))).drop_duplicates()
        return pa.table({c: pairs[c].to_numpy() for c in "ab"})

    rounds = []
    for first in range(0, tables, step):
        last = min(tables, first + step)
        dealt = spots(nodes, kind, width, tables, first, last, max(1, math.ceil(n * (last - first) / SPOTS)), seed)
        rounds.append(stash(dealt.groupBy("part").applyInArrow(look, "a long, b long")))
    edges = rounds[0]
    for more in rounds[1:]:
        edges = edges.union(more)
    heads = stash(components(edges).select(F.col("node").alias("id"), F.col("component").alias("bucket")))
    release(*rounds)
    members = stash(nodes.select("id", "copies", "x").join(heads, "id").withColumn("salt", F.xxhash64("id")))
    # a large group is sixteen tiles, or as many more as keep a tile in bounds
    most = max(split_rows, TILE_BYTES // longest)
    spread = spread_buckets(members, F.greatest(F.lit(split_rows), F.least(F.lit(most), F.ceil(F.col("count") / 16))))
    shares = max(1, math.ceil(members.count() / GROUP_ROWS))
    spread = spread.withColumn("share", F.pmod(F.xxhash64("bucket", "lo", "hi"), F.lit(shares)))

    def links(part: pd.DataFrame) -> pd.DataFrame:
        out = [compare(rows, kind, lo != hi, least) for (_, lo, hi), rows in part.groupby(["bucket", "lo", "hi"], sort=False)]
        a, b, counts = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"a": a, "b": b, "links": counts})

    found = spread.select("share", "bucket", "lo", "hi", "tile", "id", "copies", "x")
    found = stash(found.groupBy("share").applyInPandas(links, "a long, b long, links long"))
    release(heads, members)
    return found
