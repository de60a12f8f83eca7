"""Byte-level BPE encoding and decoding by the ranks of a public tokenizer file.

A pre-token's merges run on a rank queue: one bucket per merge rank holds positions of a linked list, a
two-level bitmap marks the ranks whose buckets hold something, find-first-set gives the next rank, and
positions that an earlier merge has changed are skipped. A pre-token of n bytes takes time in proportion to
n, which also suits very long ones. The new pre-tokens of a few texts go through one queue, since pre-tokens
don't touch each other and share most ranks. The ids of short pre-tokens are remembered by each
worker, packed, in two generations of a cache that is bounded in bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from sys import byteorder, getsizeof

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import per_worker

SPLIT_BITS = 10
MASK = (1 << SPLIT_BITS) - 1
#: Single bits of both levels, so that a merge makes no new numbers for them; ranks have to be below 2 ** (2 * SPLIT_BITS).
BIT = [1 << k for k in range(1 << SPLIT_BITS)]
#: Bytes of keys, packed ids and places in the dict that a generation of the cache may take: some 260,000 pre-tokens of usual length.
CACHE_BYTES = 40_000_000
CACHE_PLACE_BYTES = 48
CACHE_KEY_CHARS = 64
#: New pre-tokens or characters of texts after which the texts at hand are given back, and bytes that go through one queue.
MERGE_AT_ONCE, HELD_CHARS, MERGE_BYTES = 256, 1 << 17, 1 << 15


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with one base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}


class Merges:
    """The pairs of tokens that merge, by the left one, and the rank queue that merges many pre-tokens at once."""

    def __init__(self, ranks: dict[bytes, int]):
        none: dict[int, int] = {}
        after: list[dict[int, int]] = [none] * (max(ranks.values()) + 2)  # the last is that of an edge, -1
        self.pairs = np.full((256, 256), -1, np.int32)
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    if after[left] is none:
                        after[left] = {}
                    after[left][right] = rank
            if len(token) == 2:
                self.pairs[token[0], token[1]] = rank
        self.pairs[255] = self.pairs[:, 255] = -1
        nowhere = none.get
        self.rank_after = [nowhere if d is none else d.get for d in after]
        self.single = [ranks[bytes([b])] for b in range(255)] + [-1]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each pre-token: pairs merge by lowest rank, leftmost first among equals.

        Pre-tokens are UTF-8, which has no byte 255: it stands at their edges, where nothing merges.
        """
        data = b"\xff".join([b"", *pieces, b""])
        n, rank_after = len(data), self.rank_after
        token: list[int | None] = [self.single[b] for b in data]
        after, before = list(range(1, n + 2)), list(range(-1, n))
        by = np.frombuffer(data, np.uint8)
        first = self.pairs[by[:-1], by[1:]]
        at: list[int | None] = [*first.tolist(), None]  # the rank that a live position waits at
        places = np.flatnonzero(first >= 0)
        places = places[np.argsort(first[places], kind="stable")]
        cuts = np.flatnonzero(np.diff(first[places], prepend=-1, append=-1)).tolist()
        waits, places = first[places].tolist(), places.tolist()
        buckets: dict[int, list[int]] = {}
        leaves: dict[int, int] = {}
        top = 0
        for start, end in zip(cuts, cuts[1:]):
            r = waits[start]
            buckets[r] = places[start:end]
            h = r >> SPLIT_BITS
            leaves[h] = leaves.get(h, 0) | BIT[r & MASK]
            top |= BIT[h]
        while top:
            h = (top & -top).bit_length() - 1
            leaf = leaves[h]
            low = leaf & -leaf
            rank = h << SPLIT_BITS | low.bit_length() - 1
            if leaf == low:
                del leaves[h]
                top ^= BIT[h]
            else:
                leaves[h] = leaf ^ low
            waiting, get = buckets.pop(rank), rank_after[rank]
            if len(waiting) > 1:
                waiting.sort()
            for k in waiting:
                if at[k] != rank:
                    continue  # stale: merged away, or a neighbour has grown
                right = after[k]
                at[right] = token[right] = None
                token[k] = rank
                after[k] = follow = after[right]
                before[follow] = k
                at[k] = r = get(token[follow])
                if r is not None:
                    if r in buckets:
                        buckets[r].append(k)
                    else:
                        buckets[r] = [k]
                        h = r >> SPLIT_BITS
                        leaves[h] = leaves.get(h, 0) | BIT[r & MASK]
                        top |= BIT[h]
                left = before[k]
                at[left] = r = rank_after[token[left]](rank)
                if r is not None:
                    if r in buckets:
                        buckets[r].append(left)
                    else:
                        buckets[r] = [left]
                        h = r >> SPLIT_BITS
                        leaves[h] = leaves.get(h, 0) | BIT[r & MASK]
                        top |= BIT[h]
        ids = np.array([t for t in token if t is not None], np.int32)
        edges = (np.flatnonzero(ids < 0) * ids.itemsize).tolist()
        packed = ids.tobytes()
        return [packed[start + ids.itemsize : end] for start, end in zip(edges, edges[1:])]


class Codec:
    """Encodes and decodes with one rank file and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.merges = Merges(ranks)
        self.tokens = {r: t for t, r in ranks.items()}
        self.digits = {r: str(r) for r in ranks.values()}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.young_bytes = 0

    def remember(self, match: str, packed: bytes) -> None:
        """Keep the packed ids of a match of the pattern, if it is short."""
        if len(match) <= CACHE_KEY_CHARS:
            size = getsizeof(match) + getsizeof(packed) + CACHE_PLACE_BYTES
            if self.young_bytes + size > CACHE_BYTES:
                self.old, self.young, self.young_bytes = self.young, {}, 0
            self.young[match] = packed
            self.young_bytes += size

    def known(self, matches: list[str], new: dict[str, bytes]) -> tuple[list[bytes | None], list[int]]:
        """The packed ids of matches that are remembered, and the places of the others, which are put into new."""
        found = list(map(self.young.get, matches))
        holes = []
        if None in found:
            for k, f in enumerate(found):
                if f is None:
                    m = matches[k]
                    if m not in new:
                        f = self.young.get(m)
                        if f is None and (f := self.old.pop(m, None)) is not None:
                            self.remember(m, f)
                    if f is None:
                        new[m] = b""
                        holes.append(k)
                    else:
                        found[k] = f
        return found, holes

    def learn(self, new: dict[str, bytes]) -> None:
        """Give new matches their packed ids, and remember them."""
        pieces: dict[str, bytes] = {}
        size = 0
        for m in [*new, None]:
            if pieces and (m is None or size >= MERGE_BYTES):
                new.update(zip(pieces, self.merges.merge(list(pieces.values()))))
                pieces, size = {}, 0
            if m is not None:
                piece = m.encode("utf-8", "replace")
                whole = self.ranks.get(piece)
                if whole is None:
                    pieces[m] = piece
                    size += len(piece)
                else:
                    new[m] = whole.to_bytes(4, byteorder)
        for m, packed in new.items():
            self.remember(m, packed)

    def packed(self, texts: Iterable[str]) -> Iterator[memoryview]:
        """The ids of texts, each match of the pattern on its own; what is new in a few texts is merged at once."""
        held: list[tuple[list[str], list[bytes | None], list[int]]] = []
        new: dict[str, bytes] = {}
        size = 0

        def give() -> Iterator[memoryview]:
            self.learn(new)
            for names, found, holes in held:
                for k, m in zip(holes, names):
                    found[k] = new[m]
                yield memoryview(b"".join(found)).cast("I")
            held.clear()
            new.clear()

        for text in texts:
            matches = self.split(text)
            found, holes = self.known(matches, new)
            held.append(([matches[k] for k in holes], found, holes))
            size += len(text)
            if len(new) >= MERGE_AT_ONCE or size >= HELD_CHARS:
                yield from give()
                size = 0
        yield from give()

    def encode(self, text: str) -> list[int]:
        """The ids of a text as a list."""
        return next(self.packed([text])).tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.tokens.__getitem__, ids))

    def digests(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text, the number of ids, and SHA-256 of the ids' text and of the decoded bytes."""
        for ids in self.packed(texts):
            written = hashlib.sha256(",".join(map(self.digits.__getitem__, ids)).encode()).hexdigest()
            yield len(ids), written, hashlib.sha256(self.decode(ids)).hexdigest()

    def digest(self, text: str) -> tuple[int, str, str]:
        """The digests of one text."""
        return next(self.digests([text]))


def codec(path: str, pattern: str) -> Codec:
    """A worker's codec, kept until it needs another or other tables."""
    return per_worker((Codec, path, pattern), lambda: Codec(read_ranks(path), pattern))


def encode_documents(docs: DataFrame, locate: Callable[[], str], pattern: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) of every text; null counts as empty and gives no ids and no bytes.

    locate gives the rank file's path on the machine that calls it. Repeated rows are encoded alike; columns
    other than doc_id and text are not read.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(locate(), pattern)
        for rows in batches:
            ids = [c.encode(t or "") for t in rows["text"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "ids": ids, "decoded": [c.decode(x) for x in ids]})

    plain = docs.select(F.col("doc_id").cast("long"), "text")
    return plain.mapInPandas(each, "doc_id long, ids array<int>, decoded binary")


def digests(c: Codec, texts: pa.Array) -> pa.StructArray:
    """The digests of a batch of texts (null: as an empty one), of which a few at a time are strings of Python's."""
    rows = list(c.digests(t.as_py() or "" for t in texts))
    named = (("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()))
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(named)], [n for n, _ in named])


def digest_documents(docs: DataFrame, locate: Callable[[], str], pattern: str) -> DataFrame:
    """docs' columns with n_tokens, ids_sha256 and decoded_sha256 of every whole text (null: as an empty one)."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def each(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(partial(digests, codec(locate(), pattern)), texts)

    own = [c for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    return docs.withColumn("__bpe", each("text")).select(*own, "__bpe.*")
