"""Toxicity scores by a learned lexicon that also catches misspelled terms.

Spark counts in how many toxic and other training documents each word and word stem occurs; what is far more
frequent in toxic ones becomes the lexicon, held in a trie. A word is looked up by running the trie against a
Levenshtein automaton for the word, all terms at once: the reachable pairs of trie node and edits are one state,
and states are made when first met. Every hit is scored in its context window: hits within quotation marks
count apart from plain abuse, and hits near each other add up. A logistic model on these few sums gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import hash_bound, is_training, stash

#: About so many documents of each label are learned from at most.
TRAINING_BOUND = 8000
#: Of the terms kept, this share may stand in toxic documents by chance (by bounds on binomial tails); each must be this precise.
CHANCE = 0.05
PRECISION = 0.8
STEMS = (5, 6)
FUZZY_CHARS = 5
WINDOW = 8
QUOTED_TOKENS = 24
CACHE_ROWS = 300_000
STATES = 50_000
WORDS = re.compile(r"[^\W_]+|[\"“”«»„]")
QUOTES = frozenset("\"“”«»„")
FEATURES = 6


class Lexicon:
    """Terms with weights in a trie; a term that ends in * stands for every word that begins with it."""

    def __init__(self, terms: dict[str, float]):
        self.terms = dict(terms)
        self.child: list[dict[str, int]] = [{}]
        self.whole: list[tuple[float, int] | None] = [None]  # weight and edits allowed of the term that ends here
        self.stem: list[float | None] = [None]
        for term, weight in sorted(terms.items()):
            node, letters = 0, term.rstrip("*")
            for c in letters:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.whole.append(None)
                    self.stem.append(None)
                node = self.child[node][c]
            if term.endswith("*"):
                self.stem[node] = weight
            else:
                self.whole[node] = (weight, int(len(letters) >= FUZZY_CHARS))
        self.cache: dict[str, tuple[float, int] | None] = {}
        self.reset()

    def reset(self) -> None:
        """Forget the states that were made."""
        self.states: dict[frozenset, int] = {frozenset(): 0}
        self.sets: list[frozenset] = [frozenset()]
        self.next: list[dict[str, int]] = [{}]
        self.start = self.state({(0, 0)})

    def state(self, pairs: set[tuple[int, int]]) -> int:
        """The state of these pairs, of what skipping a letter of a term adds, and of nothing that a lesser pair covers."""
        best: dict[int, int] = {}
        for node, edits in pairs:
            best[node] = min(edits, best.get(node, 9))
        for node, edits in list(best.items()):
            if edits == 0:
                for child in self.child[node].values():
                    best[child] = min(1, best.get(child, 9))
        key = frozenset(best.items())
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
        return found

    def step(self, state: int, letter: str) -> int:
        """The state after one more letter of the word."""
        pairs = set()
        for node, edits in self.sets[state]:
            same = self.child[node].get(letter)
            if same is not None:
                pairs.add((same, edits))
            if edits == 0:
                pairs.add((node, 1))
                pairs.update((c, 1) for c in self.child[node].values())
        found = self.state(pairs) if pairs else 0
        self.next[state][letter] = found
        return found

    def look_up(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the best term for a word: fewest edits, then the highest weight; None without one."""
        if word in self.cache:
            return self.cache[word]
        if len(self.cache) >= CACHE_ROWS:
            self.cache = {}
        if len(self.sets) >= STATES:
            self.reset()
        state, best, node = self.start, None, 0
        for letter in word:
            to = self.next[state].get(letter)
            state = self.step(state, letter) if to is None else to
            if node is not None:
                node = self.child[node].get(letter)
                if node is not None and self.stem[node] is not None:
                    best = max(best or (0.0, 0), (self.stem[node], 0))
            if not state:
                break
        for at, edits in self.sets[state]:
            term = self.whole[at]
            if term and edits <= term[1]:
                best = min(best or (0.0, 9), (term[0], edits), key=lambda x: (x[1], -x[0]))
        self.cache[word] = best
        return best

    def features(self, text: str | None) -> list[float]:
        """Sums over a whole text's hits: plain, misspelled, quoted, best window, number, and share of words."""
        tokens = WORDS.findall(text.lower()) if text else []
        hits = {t: h for t in set(tokens) if (h := self.look_up(t))}
        if not hits:
            return [0.0] * FEATURES
        plain = fuzzy = quoted = window = 0.0
        number, recent, opened = 0, [], None
        marks = [i for i, t in enumerate(tokens) if t in QUOTES]
        closes = dict(zip(marks[::2], marks[1::2]))
        for i, t in enumerate(tokens):
            if t in QUOTES:
                end = closes.get(i)
                opened = end if end is not None and end - i <= QUOTED_TOKENS else (opened if opened and opened > i else None)
                continue
            hit = hits.get(t)
            if not hit:
                continue
            weight, number = hit[0], number + 1
            if opened is not None and i < opened:
                quoted += weight
                weight *= 0.3
            elif hit[1]:
                fuzzy += weight
                weight *= 0.7
            else:
                plain += weight
            recent = [x for x in recent if x[0] > i - WINDOW] + [(i, weight)]
            window = max(window, sum(x[1] for x in recent))
        cap = math.log1p
        return [cap(plain), cap(fuzzy), cap(quoted), cap(window), cap(number), number / math.sqrt(len(tokens))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Weights of a ridge logistic model by Newton's method, the constant last."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    keep = np.full(len(w), ridge * len(x) / 100 + 1e-6)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, bound: int) -> tuple[DataFrame, float]:
    """(text, toxic) of about `bound` documents of each label that may be learned, drawn by a hash of the id, and written out;
    and the log of how much more of the toxic ones than of the others were drawn."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & is_training("doc_id"))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    bad, good = usable.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") != 1)).first()
    shares = hash_bound(bad, bound), hash_bound(good, bound)
    share = F.when(F.col("toxic") == 1, math.ceil(shares[0] * 1_000_000)).otherwise(math.ceil(shares[1] * 1_000_000))
    drawn = usable.where(F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(1_000_000)) < share)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").where("text is not null")
    return stash(rows.select("text", "toxic")), math.log(shares[0] / shares[1])


def _stems(size: int) -> Column:
    """The first letters of all longer words, with * for the rest."""
    longer = F.filter("words", lambda w: F.length(w) > size)
    return F.transform(longer, lambda w: F.concat(F.substring(w, 1, size), F.lit("*")))


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Terms and weights (log odds) from (text, toxic)."""
    sizes = rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") != 1)).first()
    good, bad = sizes[1], sizes[0]
    if not good or not bad:
        return {}
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1))
    stems = [_stems(k) for k in STEMS]
    rows = rows.select("toxic", words.alias("words"))
    terms = rows.select("toxic", F.explode(F.array_distinct(F.concat("words", *stems))).alias("term"))
    counts = terms.groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") != 1).alias("q"))
    base = bad / (good + bad)
    counts = counts.where("p >= 3").withColumn("rate", (F.col("p") - 0.5) / (F.col("p") + F.col("q")))
    tried = max(1, terms.agg(F.approx_count_distinct("term")).first()[0])
    rest = 1 - F.col("rate")
    gap = F.col("rate") * F.log(F.col("rate") / base) + rest * F.log(rest / (1 - base))
    rare = counts.where((F.col("rate") > base) & (F.col("p") >= PRECISION * (F.col("p") + F.col("q"))))
    # the sample bounds the terms of three toxic documents
    found = rare.select("term", "p", "q", (-(F.col("p") + F.col("q")) * gap).alias("chance")).orderBy("chance", "term").collect()
    kept = max((k for k, r in enumerate(found, 1) if r["chance"] <= math.log(CHANCE * k / tried)), default=0)
    found = [(r["term"], r["p"], r["q"]) for r in found[:kept]]
    weight = {t: math.log((p + 0.5) / (bad + 1)) - math.log((q + 0.5) / (good + 1)) for t, p, q in found}
    seen = {t: p for t, p, _ in found}
    for stem in [t for t in weight if t.endswith("*")]:
        inner = [p for t, p in seen.items() if t != stem and t.startswith(stem[:-1])]
        if seen[stem] < 1.2 * max(inner, default=0):
            del weight[stem]
    return weight


def learn(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_BOUND) -> tuple[dict[str, float], list[float]]:
    """The lexicon and the logistic weights. The driver gets the terms kept and six sums per training document."""
    rows, more = training_rows(docs, labels, bound)
    terms = learn_lexicon(rows)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(terms)
        for part in batches:
            yield pd.DataFrame({"x": [lexicon.features(t) for t in part["text"]], "toxic": part["toxic"]})

    got = rows.mapInPandas(sums, "x array<double>, toxic int").toPandas()
    if not terms or got["toxic"].nunique() < 2:
        rate = float(got["toxic"].mean()) if len(got) else 0.0
        return terms, [0.0] * FEATURES + [math.log((rate + 0.01) / (1.01 - rate)) - more]
    weights = logistic(np.stack(got["x"].to_numpy()), (got["toxic"] == 1).to_numpy(float)).tolist()
    weights[-1] -= more  # as if all labels had been learned from alike
    return terms, weights


def score(docs: DataFrame, terms: dict[str, float], weights: list[float]) -> DataFrame:
    """docs with score and predicted; null and empty texts score as a text without hits."""

    @F.pandas_udf("double")
    def each(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon, w = Lexicon(terms), np.array(weights)
        for batch in texts:
            x = np.array([lexicon.features(t) for t in batch]).reshape(-1, FEATURES)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))))

    own = [c for c in docs.columns if c not in ("score", "predicted")]
    found = docs.select(*own, each("text").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score_documents(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_BOUND) -> DataFrame:
    """docs with held_out, score and predicted; without labels of both kinds every text scores the rate of toxic ones."""
    terms, weights = learn(docs, labels, bound)
    return score(docs, terms, weights).withColumn("held_out", ~is_training("doc_id"))
