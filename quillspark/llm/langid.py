"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1; an n-gram's vector binds (multiplies) its letters' vectors, each
permuted (rotated) by its place; a document's profile bundles (adds) the vectors of its n-grams. A language's
prototype is the sum of its training documents' profiles of unit length, and a document takes the language
whose prototype has the highest cosine with its profile.

A distinct n-gram's vector is made once per worker and kept in a bounded table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import hash_bound, is_training, per_worker

DIMENSIONS = 512
GRAM = 3
COMMON = 128
TABLE_ROWS = 1 << 14
DOCS_AT_ONCE = 64
SCAN_CHARS = 1 << 16
#: Training profiles are drawn from about this many labelled documents at most.
TRAINING_BOUND = 8000
SPACE = 32


class Profiler:
    """Document profiles with one seed.

    The first COMMON letters that a worker meets get a dense table from n-gram to row; n-grams with other
    letters, or beyond the table's rows, are bound anew each time. Either way gives the same profile.
    """

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.place = np.full(0x110000, -1, np.int16)  # of a code point: 0 no letter, below COMMON common, else rare
        self.codes = [SPACE]
        self.row = np.full(COMMON**GRAM, -1, np.int32)
        self.rows, self.used = np.zeros((TABLE_ROWS, dimensions), np.float32), 0  # memory is taken as rows are filled

    def letter(self, code: int) -> np.ndarray:
        """The vector of a letter, by its code point and the seed alone."""
        found = self.letters.get(code)
        if found is None:
            bits = np.random.Generator(np.random.Philox(key=[self.seed, code])).integers(0, 2, self.dimensions)
            self.letters[code] = found = (bits * 2 - 1).astype(np.int8)
        return found

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of n-grams, given as one row of code points each."""
        out = np.ones((len(grams), self.dimensions), np.int8)
        for place in range(GRAM):
            codes, back = np.unique(grams[:, place], return_inverse=True)
            out *= np.stack([np.roll(self.letter(int(c)), place) for c in codes])[back]
        return out.astype(np.float32)

    def places(self, codes: np.ndarray) -> np.ndarray:
        """The places of code points, with new ones entered."""
        found = self.place[codes]
        if (found < 0).any():
            for c in np.unique(codes[found < 0]).tolist():
                if not chr(c).isalpha():
                    self.place[c] = 0
                elif len(self.codes) < COMMON:
                    self.place[c] = len(self.codes)
                    self.codes.append(c)
                else:
                    self.place[c] = COMMON
            found = self.place[codes]
        return found

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray, bool, str]:
        """Table rows of a part's n-grams, the vectors' sum of those without a row, whether it has a letter, and its last
        characters, with one space for each run of others than letters, for n-grams that go on in the next part."""
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        at = self.places(codes)
        seen = bool(at.any())
        keep = np.ones(len(at), bool)
        keep[1:] = (at[1:] != 0) | (at[:-1] != 0)
        at, codes = at[keep], codes[keep]
        rest = np.zeros(self.dimensions, np.float32)
        tail = "".join(chr(c) if a else " " for c, a in zip(codes[1 - GRAM :], at[1 - GRAM :]))
        if len(at) < GRAM:
            return np.zeros(0, np.int32), rest, seen, tail
        if (at == COMMON).any():
            rare = (at[:-2] == COMMON) | (at[1:-1] == COMMON) | (at[2:] == COMMON)
            codes = np.where(at == 0, SPACE, codes)
            odd = np.stack([codes[:-2], codes[1:-1], codes[2:]], 1)[rare]
            odd, counts = np.unique(odd, axis=0, return_counts=True)
            for k in range(0, len(odd), 4096):
                rest += counts[k : k + 4096].astype(np.float32) @ self.bind(odd[k : k + 4096])
        else:
            rare = None
        wide = at.astype(np.int32)
        keys = (wide[:-2] * COMMON + wide[1:-1]) * COMMON + wide[2:]
        keys = keys if rare is None else keys[~rare]
        rows = self.row[keys]
        if (rows < 0).any():
            fresh = np.unique(keys[rows < 0])[: TABLE_ROWS - self.used]
            if len(fresh):
                self.row[fresh] = np.arange(self.used, self.used + len(fresh))
                self.rows[self.used : self.used + len(fresh)] = self.bind(self.spell(fresh))
                self.used += len(fresh)
                rows = self.row[keys]
            if (rows < 0).any():
                odd, counts = np.unique(keys[rows < 0], return_counts=True)
                for k in range(0, len(odd), 4096):
                    rest += counts[k : k + 4096].astype(np.float32) @ self.bind(self.spell(odd[k : k + 4096]))
                rows = rows[rows >= 0]
        return rows, rest, seen, tail

    def spell(self, keys: np.ndarray) -> np.ndarray:
        """The code points of the n-grams with these keys."""
        codes = np.array(self.codes)
        return np.stack([codes[keys // COMMON**2], codes[keys // COMMON % COMMON], codes[keys % COMMON]], 1)

    def profiles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The unit profiles of whole texts, and which of them have a letter; the others' are zero."""
        total = np.zeros((len(texts), self.dimensions), np.float32)
        seen = np.zeros(len(texts), bool)
        counts = []
        for i, text in enumerate(texts):
            text, count = text or "", np.zeros(0, np.int64)
            tail = " "
            for start in range(0, len(text), SCAN_CHARS):
                part = tail + text[start : start + SCAN_CHARS].lower() + (" " if start + SCAN_CHARS >= len(text) else "")
                rows, rest, has, tail = self.grams(part)
                more = np.bincount(rows, minlength=len(count))
                more[: len(count)] += count
                count, seen[i] = more, seen[i] or has
                total[i] += rest
            counts.append(count)
        wide = np.zeros((len(texts), max(map(len, counts), default=0)), np.float32)
        for i, count in enumerate(counts):
            wide[i, : len(count)] = count
        if wide.size:
            total += wide @ self.rows[: wide.shape[1]]
        size = np.linalg.norm(total, axis=1, keepdims=True)
        return np.divide(total, size, out=np.zeros_like(total), where=size > 0), seen & (size[:, 0] > 0)


def profiler(dimensions: int = DIMENSIONS) -> Profiler:
    """A worker's profiler, kept until it needs another or other tables."""
    return per_worker((Profiler, dimensions), lambda: Profiler(dimensions))


def train(docs: DataFrame, bound: int = TRAINING_BOUND, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes by language from (text, lang) of documents whose labels may be learned.

    About `bound` labelled documents are drawn by a hash of the id, evenly over the whole table. Partial sums
    are made in each partition; the driver gets one vector per language. Null languages are left out.
    """
    usable = docs.where(F.col("lang").isNotNull() & is_training("doc_id"))
    share = hash_bound(usable.count(), bound)
    drawn = usable.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) < math.ceil(share * 1_000_000))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, total = profiler(dimensions), {}
        for rows in batches:
            for k in range(0, len(rows), DOCS_AT_ONCE):
                part = rows[k : k + DOCS_AT_ONCE]
                units, seen = p.profiles(list(part["text"]))
                for one, has, lang in zip(units, seen, part["lang"]):
                    if has:
                        total[lang] = total.get(lang, 0) + one.astype(np.float64)
        if total:
            yield pd.DataFrame({"lang": list(total), "v": [x.tolist() for x in total.values()]})

    parts = drawn.select("text", "lang").mapInPandas(sums, "lang string, v array<double>")
    whole = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for lang, k, x in whole.collect():
        out.setdefault(lang, np.zeros(dimensions))[k] = x
    return {k: v / n for k, v in sorted(out.items()) if (n := np.linalg.norm(v)) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """docs with lang_pred and score, the cosine with the winning prototype (0 where negative).

    A text that is null or has no letter is `und` with score 0, as is every text where nothing was learned;
    ties go to the first language by name. A column of docs with one of these names is replaced.
    """
    names = sorted(prototypes)
    size = len(next(iter(prototypes.values()))) if names else DIMENSIONS
    table = np.stack([prototypes[n] for n in names]).astype(np.float32) if names else None

    @F.arrow_udf("lang_pred string, score double")
    def each(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = profiler(size)
        for batch in texts:
            rows = []
            for k in range(0, len(batch), DOCS_AT_ONCE):
                # few texts of a batch at a time are strings of Python's
                units, seen = p.profiles(batch.slice(k, DOCS_AT_ONCE).to_pylist())
                cosines = units @ table.T if names else np.zeros((len(units), 1))
                for best, top, has in zip(cosines.argmax(axis=1), cosines.max(axis=1), seen & bool(names)):
                    rows.append((names[best], min(1.0, max(0.0, float(top)))) if has else ("und", 0.0))
            columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())]
            yield pa.StructArray.from_arrays(columns, ["lang_pred", "score"])

    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*own, each("text").alias("__lang")).select(*own, "__lang.*")


def identify(docs: DataFrame, bound: int = TRAINING_BOUND) -> DataFrame:
    """docs with held_out, lang_pred and score, by prototypes learned from docs itself."""
    found = predict(docs, train(docs, bound))
    return found.withColumn("held_out", ~is_training("doc_id"))


def keep_identified(docs: DataFrame, least: float = 0.05, bound: int = TRAINING_BOUND) -> DataFrame:
    """The documents whose language is told: `und` and scores below `least` go. All columns stay as they were."""
    found = identify(docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text", "lang"), bound)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("__row.*")
