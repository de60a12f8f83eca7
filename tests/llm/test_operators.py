"""Each operator against a brute-force version on small tables, and on rows that are odd in every way."""

import base64
import hashlib
import os
import random
import re
import time
import tracemalloc
import weakref
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from quillspark.llm import bpe, common, decontaminate, embeddings, html, langid, licenses, lines, pii, queries, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and blank texts, a very long one, ties, and repeated rows."""
    text = "The quick brown fox jumps over the lazy dog near the river bank today.\nA second line that is long enough to count here."
    return [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (None, text, "en", "s", len(text)), (4, text, "en", None, len(text)),
        (4, text, "en", None, len(text)), (5, text, None, "s", None), (6, "x" * 100_000, "en", "s", 100_000), (7, "word " * 20_000, "de", "s", 100_000), (8, "日本語 émoji 🎉 ﬁ İ", "xx", "s", 5),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), DOCS)
    return df.withColumns({"bucket": F.lit(1), "key": F.lit("k"), "words": F.lit(2), "score": F.lit("s"), "tile": F.lit(3), "id": F.lit(9), "fp": F.lit("f"), "component": F.lit(0)})


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 1


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(n, linked):
    label = list(range(n))
    while True:
        new = [min([label[i], *(label[j] for j in range(n) if linked(i, j))]) for i in range(n)]
        if new == label:
            return label
        label = new


def test_simhash(spark):
    rng = random.Random(1)
    texts = [words(rng, 150) for _ in range(12)]
    for t in list(texts):
        w = t.split()
        for _ in range(4):
            k = rng.randrange(len(w))
            texts.append(" ".join(w[:k] + [rng.choice(WORDS)] + w[k + 1 :]))
    texts += ["", None, "One", "one"]
    ids = list(range(100, 100 + len(texts)))
    got = table(simhash.near_duplicates(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")))
    fps = [brute_fp(t) for t in texts]
    label = brute_components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    for i, d in enumerate(ids):
        assert got[d]["fp"] & (1 << 64) - 1 == fps[i]
        assert got[d]["component_id"] == ids[label[i]]
    assert len(set(label)) < len(label) - 4


def test_simhash_splits_large_buckets(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 20)
    fps = sorted({int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 62, (30, 2))})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    links = simhash.link_fingerprints(df, 2, bucket_rows=100, split_rows=20)
    got = {r["node"]: r["component"] for r in common.components(links).collect()}
    label = brute_components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    assert [got.get(x, x) for x in fps] == [fps[k] for k in label]


def test_keep_one(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    got = sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect())
    assert [d for _, d in got if d] == [1, 4, 6, 7, 8] and got[-1] == (True, None)


def test_similar_documents(spark, odd):
    rng = random.Random(6)
    texts = [words(rng, rng.choice([4, 30, 120, 400])) for _ in range(30)]
    for t in list(texts):
        for changes in (1, 3, 6):
            w = t.split()
            for _ in range(changes):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    texts += ["", None, " ", "One", "one"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else {()} for t in texts]
    label = brute_components(len(texts), lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()} == dict(enumerate(label))
    assert len(set(label)) < len(label) - 20
    kept = simhash.keep_one(odd, 5, 20, 0.8)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {None, 1, 4, 6, 7, 8}
    assert simhash.keep_one(odd.limit(0), 5, 20, 0.8).count() == 0


def test_similar_documents_make_no_rows_of_pairs(spark, monkeypatch):
    """What is written grows with the near copies of a text, also if most are under the least similarity, and not with their pairs."""
    rng = random.Random(8)
    base = words(rng, 400).split()
    texts = [" ".join(rng.choice(WORDS) if rng.random() < p else w for w in base) for p in (0.01, 0.03, 0.04, 0.05) for _ in range(75)]
    made = []

    def counted(table):
        table = common.stash(table)
        made.append(table.count())
        return table

    monkeypatch.setattr(simhash, "stash", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df, 5, 64, 0.8).collect()}
    assert max(made) <= simhash.BANDS * len(texts)
    sets = [simhash.shingle_hashes(t, 5) for t in texts]
    bands = np.stack([simhash.band_keys(x) for x in sets])
    held = np.stack([np.isin(np.unique(np.concatenate(sets)), x) for x in sets]).astype(np.int64)
    both, size = held @ held.T, held.sum(axis=1)
    linked = (5 * both >= 4 * (size[:, None] + size - both)) & (bands[:, None] == bands).any(axis=2)
    label = simhash.merge_links(np.arange(len(texts)), *np.nonzero(linked))
    assert [got[i] for i in range(len(texts))] == label.tolist() and 20 < len(set(label)) < len(texts) - 20


def test_alike_links_in_tiles(monkeypatch):
    rng = np.random.default_rng(5)
    n = 300
    sets = [np.unique(rng.integers(0, 14, k)) for k in rng.integers(0, 30, n)]
    rows = pd.DataFrame({"id": np.arange(n) + 50, "group": rng.integers(0, 3, n), "tile": rng.integers(0, 2, n), "fp": rng.integers(0, 1 << 8, n), "bands": list(rng.integers(0, 4, (n, 3))), "set": sets})
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 40)
    fp, group, tile, bands = (rows[c].tolist() for c in ("fp", "group", "tile", "bands"))
    found = [set(x.tolist()) for x in sets]

    def linked(i, j, across):
        near = group[i] == group[j] and (fp[i] ^ fp[j]).bit_count() <= 3 and (bands[i] == bands[j]).any() and not (across and tile[i] == tile[j])
        return near and len(found[i] & found[j]) >= 0.8 * len(found[i] | found[j])

    for across in (False, True):
        label = brute_components(n, lambda i, j: i == j or linked(i, j, across))  # noqa: B023
        got = simhash.alike_links(rows.sample(frac=1, random_state=1), 3, 0.8, across)
        assert len(got) == n - len(set(label))
        joined = simhash.merge_links(np.arange(n), got["a"].to_numpy() - 50, got["b"].to_numpy() - 50)
        assert joined.tolist() == label and 20 < len(set(label)) < n - 20


def test_near_pairs_in_tiles():
    rng = np.random.default_rng(4)
    n = 1500
    rows = pd.DataFrame({"id": np.arange(n), "key": rng.integers(0, 3, n), "fp": rng.integers(0, 1 << 63, n), "tile": rng.integers(0, 2, n), "label": rng.integers(0, 900, n)})
    fp, key, tile, label = (rows[c].tolist() for c in ("fp", "key", "tile", "label"))
    expect = {(i, j) for i in range(n) for j in range(i + 1, n) if key[i] == key[j] and label[i] != label[j] and tile[i] != tile[j] and (fp[i] ^ fp[j]).bit_count() <= 18}
    assert expect and set(simhash.near_pairs(rows, 18, True, False).itertuples(index=False, name=None)) == expect


def test_pipeline_drops_near_copies(spark):
    rng = random.Random(12)
    lines_of = [words(rng, 12) for _ in range(20)]
    near = [" ".join(["new", "other", "words", *t.split()[3:]]) if k in (3, 9, 15) else t for k, t in enumerate(lines_of)]
    df = spark.createDataFrame([(1, "\n".join(lines_of), "en", "s", 1), (2, " ".join(near), "en", "s", 1), (3, words(rng, 240), "en", "s", 1)], DOCS)
    df = lines.drop_repeated(df)
    assert {r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, df, "").collect()} == {1, 3}
    assert len({r["component_id"] for r in simhash.near_duplicates(df).collect()}) == 3


# 2

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum((lambda d: d - 9 if d > 9 else d)(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_pii(spark):
    rng = random.Random(3)
    bits = ["a", "b@", "@", ".", "1", "23", "456.7", "8.9", " ", "-", "+1", "+", "(5) ", "4111111111111111", "4111 1111-1111 1111", "é", "🎉", "_", "%", "x.y", "com", "\n", "256.1.1.1", "001.2.3.4", "foo@bar.com", "_x@d.com"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, "", "a." * 30_000 + "@", "1 " * 5_000]
    texts += [f'note token = "{hashlib.sha1(str(i).encode()).hexdigest()}" end mail me{i}@x.org or 10.0.0.{i}' for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = table(pii.find_spans(df))
    for i, t in enumerate(texts):
        if t and t.startswith("a.a."):
            assert got[i]["base_spans"] == ""
            continue
        found = {k: [m for m in re.finditer(p, t or "") if brute_valid(k, m.group())] for k, p in KINDS.items()}
        assert got[i]["base_spans"] == ",".join(f"{k}:{m.start()}:{m.end()}" for k, ms in found.items() for m in ms)
        assert [got[i][f"n_{k}"] for k in KINDS] == [len(ms) for ms in found.values()]
        assert set(filter(None, got[i]["base_spans"].split(","))) <= set(got[i]["spans"].split(","))
    assert sum("opaque" in got[i]["spans"] for i in range(len(texts) - 60, len(texts))) > 40


def test_pii_finds_every_added_kind(spark):
    rng = random.Random(13)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    value = {
        "masked_email": lambda i: f"name{i} [at] host{i % 7} [dot] org",
        "local_phone": lambda i: f"{rng.randint(200, 999)}-{digits(3)}-{digits(4)}",
        "number": lambda i: f"7{digits(8)}",
        "opaque": lambda i: hashlib.sha1(str(i).encode()).hexdigest(),
    }
    cue = {"masked_email": "please write to ", "local_phone": "my telephone: ", "number": "from account ", "opaque": "token = "}
    docs, places = [], {}
    for kind, make in value.items():
        for i in range(150):
            v = make(i)
            places[len(docs)] = f"{kind}:{len(cue[kind])}:{len(cue[kind]) + len(v)}"
            docs.append((len(docs), f"{cue[kind]}{v} and so on"))
    plain = len(docs)
    for kind in ("local_phone", "number", "opaque"):
        docs += [(len(docs) + i, f"some part {value[kind](1000 + i)} of it") for i in range(150)]
    got = table(pii.find_spans(spark.createDataFrame(docs, "doc_id long, text string")))
    for kind in value:
        own = [d for d, x in places.items() if x.startswith(kind)]
        assert sum(places[d] in got[d]["spans"].split(",") for d in own) >= 0.9 * len(own), kind
    assert sum(bool(got[d]["spans"]) for d in range(plain, len(docs))) <= 0.1 * (len(docs) - plain)


def test_pii_learns_formats_beside_cues(spark):
    """Where only secrets have a format, one without the word that tells the weak label is found, and long plain words are not."""
    rng = random.Random(17)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(24)) for _ in range(200)]
    docs = [(i, f"it says token = {hashlib.sha1(str(i).encode()).hexdigest()} here") for i in range(400)]
    docs += [(1000 + i, f"some part {w} of it") for i, w in enumerate(plain)]
    docs += [(2000 + i, f"some part {hashlib.sha1(str(-i - 1).encode()).hexdigest()} of it") for i in range(12)]
    got = table(pii.find_spans(spark.createDataFrame(docs, "doc_id long, text string")))
    assert all(got[2000 + i]["spans"] == "opaque:10:50" for i in range(12))
    assert not any(got[1000 + i]["spans"] for i in range(200))


# 3


def brute_align(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(0, 12)), rng.integers(0, 4, rng.integers(0, 15))
        assert decontaminate.align(a, b) == (brute_align(a, b) if len(a) and len(b) else 0)


def test_decontamination(spark):
    rng = random.Random(5)
    items = [words(rng, 30) for _ in range(20)]
    docs, expect = [], set()
    for d in range(120):
        text = words(rng, 200).split()
        if d % 4 == 0:
            item = items[d % 20].split()
            if d % 8 == 0:
                item[rng.randrange(10, 20)] = "changed"
                del item[5]
            text[50:50] = item
            expect.add((d, d % 20))
        docs.append((d, " ".join(text).upper() if d % 3 == 0 else " ".join(text)))
    docs += [(500, None), (501, ""), (None, items[0]), (502, "hi")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (None, "x y z")], "item_id long, text string")
    got = decontaminate.contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == expect
    whole = {(r["doc_id"], r["item_id"]): r["score"] for r in got}
    for (d, i), score in whole.items():
        assert abs(score - brute_align(items[i].split(), dict(docs)[d].lower().split()) / 60) < 1e-9
    assert decontaminate.drop_contaminated(df, bench).count() == len(docs) - len(expect) - 1  # and the copy without an id
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench, bound=60).collect()} == expect
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_finds_edited_copies(spark):
    """Recall against alignment by brute force, with up to a quarter of the words exchanged at random places."""
    rng = random.Random(11)
    items = [words(rng, 30) for _ in range(30)]
    docs, expect = [], set()
    for d in range(240):
        copy = [w if rng.random() >= (0.1, 0.15, 0.2, 0.25)[d % 4] else rng.choice(WORDS) for w in items[d % 30].split()]
        docs.append((d, " ".join([words(rng, 50), *copy, words(rng, 50)])))
        if brute_align(items[d % 30].split(), copy) / 60 >= decontaminate.LEAST:
            expect.add((d, d % 30))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert len(got & expect) >= 0.97 * len(expect)


def test_decontamination_finds_regular_edits(spark):
    rng = random.Random(8)
    items = [words(rng, 40) for _ in range(8)]
    docs, expect = [], set()
    for every in (6, 7, 8):
        for i, item in enumerate(items):
            edited = [f"edit{k}" if k % every == every - 1 else w for k, w in enumerate(item.split())]
            docs.append((len(docs), " ".join([words(rng, 60), *edited, words(rng, 60)])))
            expect.add((docs[-1][0], i))
    docs += [(len(docs) + k, items[k]) for k in range(2)]  # exact copies beside the edited ones change nothing
    expect |= {(docs[k - 2][0], k) for k in range(2)}
    common_gram = " ".join(items[3].split()[:5])
    docs += [(1000 + k, f"{words(rng, 30)} {common_gram} {words(rng, 30)}") for k in range(30)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == expect
    assert all(abs(v - brute_align(items[i].split(), dict(docs)[d].split()) / 80) < 1e-9 for (d, i), v in got.items())


# 4


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lexicon_states_match_edit_distance():
    rng = random.Random(2)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 7))): rng.random() for _ in range(25)}
    lex = toxicity.Lexicon(terms)
    for _ in range(800):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(0, 8)))
        near = [(brute_distance(w, t), -v) for t, v in terms.items() if brute_distance(w, t) <= (len(t) >= toxicity.FUZZY_CHARS)]
        got = lex.look_up(w)
        assert (got is None) == (not near) and (got is None or (got[1], -got[0]) == min(near)), w
    assert toxicity.Lexicon({"abcde*": 2.0}).look_up("abcdexyz") == (2.0, 0)


def test_toxicity_learns_and_tells_quotes(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for d in range(400):
        text, toxic = words(rng, 60).split(), int(d % 5 == 0)
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["scoundrel", "blockhead", "nincompoop"]))
        docs.append((d, " ".join(text)))
        labels.append((d, toxic))
    docs += [(1000, "you are a scoundrell and a blokhead scoundrel"), (1001, None), (1002, ""), (1003, 'someone said "scoundrel" once ' + words(rng, 60))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = table(toxicity.score_documents(df, spark.createDataFrame(labels, "doc_id long, toxic int")))
    held = [d for d in range(400) if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d]["held_out"] for d in held) and sum(got[d]["predicted"] == int(d % 5 == 0) for d in held) == len(held)
    assert got[1000]["predicted"] == 1 and got[1001]["predicted"] == 0 and got[1002]["score"] < 0.5
    lex = toxicity.Lexicon({"scoundrel": 3.0})
    assert lex.features('he said "scoundrel" loudly')[2] > 0 and lex.features("you scoundrel")[0] > 0
    none = toxicity.score_documents(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.where("score < 0 or score > 1").count() == 0


# 5


def test_language_profiles():
    p = langid.Profiler(dimensions=64)
    text = "Abé c1 日本 xyz"
    units, seen = p.profiles([text, None, "12 3", "İİ"])
    letters = " abé c 日本 xyz "
    total = np.zeros(64)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        total += p.letter(ord(a)) * np.roll(p.letter(ord(b)), 1) * np.roll(p.letter(ord(c)), 2).astype(float)
    assert np.allclose(units[0], total / np.linalg.norm(total), atol=1e-5) and seen.tolist() == [True, False, False, True]
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefg hijé") for _ in range(200_000))
    whole, _ = p.profiles([long])
    langid.SCAN_CHARS, was = 1000, langid.SCAN_CHARS
    parts, _ = p.profiles([long])
    langid.SCAN_CHARS = was
    assert np.allclose(whole, parts, atol=1e-4)


def test_language_rare_letters_agree():
    few = langid.Profiler(dimensions=64)
    few.codes = few.codes + [0] * (langid.COMMON - 1)  # no room for common letters
    assert np.allclose(few.profiles(["abc déf 日本"])[0], langid.Profiler(dimensions=64).profiles(["abc déf 日本"])[0], atol=1e-5)


def test_language_held_out(spark, odd):
    rng = random.Random(7)
    alphabets = {"aa": "abcdefghij", "bb": "klmnopqrst", "cc": "aeioukmnt"}
    docs = [(d, " ".join("".join(rng.choice(alphabets[k]) for _ in range(6)) for _ in range(40)), k) for d in range(300) for k in [rng.choice(list(alphabets))]]
    got = table(langid.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")))
    held = [(d, k) for d, _, k in docs if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum(got[d]["lang_pred"] == k for d, k in held) >= 0.97 * len(held)
    rows = langid.identify(odd)
    assert {r["doc_id"]: r["lang_pred"] for r in rows.collect()}[2] == "und"
    assert langid.identify(odd.limit(0)).count() == 0
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {4, 5, 7}


# 6


def page(host, n, main, wrap="div"):
    body = {
        "div": f'<div class="site-header"><a href="/">Home</a></div><div class="content c{n}"><h1>Title {n}</h1>{main}<div class="comments"><p>reader says no</p></div></div><div class="sidebar"><p>side</p></div>',
        "article": f"<header>Site</header><article><h1>Title {n}</h1>{main}</article><aside>no</aside><footer>f</footer>",
    }[wrap]
    return f"https://{host}/p{n}", f"<html><head><title>t</title><script>if (a < b) document.write('<p>x</p>')</script></head><body><nav><ul><li>m</li></ul></nav>{body}<form><p>sign up</p></form></body></html>"


def test_html(spark):
    rows, expect = [], {}
    for n in range(40):
        wrap = ("div", "article")[n % 2]
        main = f"<p>First &amp; paragraph {n}  with\n text that is long enough.<p>Second<br>part {n} &copy; goes on for a while.<ul><li>one<li>two</ul>"
        url, source = page(f"h{n % 4}.org", n, main, wrap)
        rows.append((n, url, source))
        expect[n] = f"Title {n}\nFirst & paragraph {n} with text that is long enough.\nSecond part {n} © goes on for a while.\none\ntwo"
    rows += [(90, None, "<p>no host"), (91, "https://h0.org/x", None), (92, "https://h0.org/y", ""), (93, "nonsense", "plain"), (None, "https://h1.org", "<b>x</b>"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "paths": F.lit(1), "text": F.lit("t")})
    got = html.extract_pages(df).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    for n, e in expect.items():
        assert text[n] == e, n
    assert text[90] == "no host" and text[91] == "" and text[92] == "" and text[93] == "plain" and text[None] == "x"
    assert html.extract_pages(df.limit(0)).count() == 0


def test_html_by_consensus_of_the_host(spark):
    """A page's own longest container is a text that all pages of the host hold; only the host's other pages tell that."""
    same = "We are a small reading circle that meets by the river on every second evening of the month. " * 6
    aside = "<section class=reader>Printed by the circle, and free to copy.</section>"
    rows = [(n, f"https://circle.org/{n}", f"<body><div class=intro>{same}</div><div class=c{n}>Page {n} says something of its own.{aside}</div></body>") for n in range(12)]
    alone = [(100, "https://other.org/1", rows[0][2])]
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows + alone, "page_id long, url string, html string")).collect()}
    assert all(got[n] == f"Page {n} says something of its own." for n in range(12))
    assert got[100].startswith(same.strip())


# 7


@pytest.mark.parametrize("letters,least,most", [("abcd", 9, 16), ("aé日🎉", 35, 80)])
def test_line_links(spark, letters, least, most):
    rng = random.Random(9)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(least, most))) for _ in range(60)]
    family = {t: n for n, t in enumerate(base)}
    for n, t in enumerate(base):
        for _ in range(6):
            x = list(t)
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(x))
                x[k : k + 1] = rng.choice([[], [rng.choice(letters)], [x[k], rng.choice(letters)]])
            family["".join(x)] = n if least > 20 else 0  # long texts of two families are far apart
        family[t] = n if least > 20 else 0
    texts = sorted(t for t in family if len(t) >= 6)
    nodes = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "id long, line string, n int")
    expect = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if abs(len(texts[i]) - len(texts[j])) <= 2 and family[texts[i]] == family[texts[j]] and brute_distance(texts[i], texts[j]) <= 2}
    for hot in (0, 3, 1000):
        assert {(r["a"], r["b"]) for r in lines.links(nodes, 2, hot).collect()} == expect


def test_busy_lines_ask_only_for_what_follows_from_their_segments(spark):
    """Of the 48 compound keys, a line that met others of its length at places that don't move needs 20; a short line asks for all."""
    still = sum(1 << i for i, w in enumerate(lines.segment_ways(2)) if w["less"] == w["shift"] == 0)
    rows = [(n, "".join(chr(97 + i * i % 23) for i in range(n)), still) for n in (40, 8)] + [(41, "z" * 41, 1)]
    df = spark.createDataFrame(rows, "n int, line string, met long")
    got = {r["n"]: r["size"] for r in df.select("n", F.size(lines.compound_keys(2, 5, True)).alias("size")).collect()}
    assert got == {40: 20, 8: 48, 41: 12}


def test_line_dedup(spark, odd):
    long = "This line is surely long enough to be compared at all."
    docs = [(1, f"{long}\nshort\nAnother line, which also is long enough to count."), (2, f"short\n{long.replace('surely', 'surelY')}\nA wholly different line that nobody else has, really."), (3, long), (4, "tiny"), (5, f"{long}\n{long}")]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], DOCS)
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated(df).collect()}
    assert got == {1: docs[0][1], 2: "short\nA wholly different line that nobody else has, really.", 4: "tiny"}
    kept = lines.drop_repeated(odd)
    assert kept.columns == odd.columns
    rows = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert [d for _, d in rows] == [1, 2, 3, 4, 4, 6, 7, 8]
    assert lines.drop_repeated(odd.limit(0)).count() == 0 and lines.line_classes(odd.limit(0)).count() == 0


def test_line_dedup_keeps_clean_lines(spark):
    footer, other = "This footer line is shared by all of the documents here.", "Another shared line, which is also long enough to count."
    docs = [(1, footer), (2, f"one\ntwo\n{footer}\nthree"), (3, f"{footer}\n \n"), (4, f"{other}\nfour"), (5, f"{footer}\nfive"), (5, "A clean line of the same number, and of the same document id.\nsix"),
            (None, f"{other}\nseven"), (None, "A clean line of the same number in a row without document id.\neight")]
    got = lines.drop_repeated(spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], DOCS)).collect()
    expect = [docs[0], (2, "one\ntwo\nthree"), docs[3], (5, "five"), docs[5], (None, "seven"), docs[7]]
    assert sorted(((r["doc_id"] or 9, r["text"]) for r in got)) == sorted((d or 9, t) for d, t in expect)


def test_line_classes_of_short_lines(spark):
    docs = [(1, "short\n\n \t\nshorT"), (2, "other\nshort"), (3, "short\na line that is long enough for two edits, surely"), (4, "A line that is long enough for two edits, surely")]
    got = {(r["doc_id"], r["line_no"]): r for r in lines.line_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    firsts = {place: (r["class_doc_id"], r["class_line_no"]) for place, r in got.items()}
    assert firsts == {(1, 0): (1, 0), (1, 3): (1, 3), (2, 0): (2, 0), (2, 1): (1, 0), (3, 0): (1, 0), (3, 1): (3, 1), (4, 0): (3, 1)}
    assert {place for place, r in got.items() if r["kept"]} == set(firsts.values()) and got[2, 1]["n_links"] == 0


# 8


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    centers = rng.standard_normal((15, 32))
    x = [list(map(float, v)) for v in rng.standard_normal((100, 32))]
    for c in centers:
        x += [list(map(float, c / np.linalg.norm(c) + s * rng.standard_normal(32) / 6)) for s in rng.uniform(0.02, 0.6, 20)]
    x += [x[5], x[5], [0.0] * 32, None, [float("nan")] * 32, [1.0] + [None] * 31, [], [2.0, 1.0], [4.0, 2.0], [float("inf")] * 32]
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(a), b) for a, b in zip(ids, x)], "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "u": F.lit(2), "low": F.lit(3)})
    fine = [i for i, v in enumerate(x) if v and all(y is not None and np.isfinite(y) for y in v) and any(v)]
    unit = {i: np.array(x[i]) / np.linalg.norm(x[i]) for i in fine}
    linked = lambda i, j: i != j and i in unit and j in unit and len(x[i]) == len(x[j]) and unit[i] @ unit[j] >= 0.9
    count = [sum(linked(i, j) for j in range(len(x))) for i in range(len(x))]
    reach = {i: [j for j in range(len(x)) if linked(i, j)] for i in range(len(x))}
    label = {i: int(ids[i]) for i in range(len(x))}
    while True:
        new = {i: min([label[i], *(label[j] for j in reach[i])]) for i in label}
        if new == label:
            break
        label = new
    for split in (4096, 30):
        got = table(embeddings.near_duplicates(df, split_rows=split), "vec_id")
        assert len(got) == len(x)
        found = [got[int(i)]["n_links"] for i in ids]
        assert all(a <= b for a, b in zip(found, count)) and sum(found) >= 0.97 * sum(count)
        assert sum(got[int(ids[i])]["component_id"] == label[i] for i in label) >= 0.99 * len(x)
        assert all(got[int(i)]["kept"] == (got[int(i)]["component_id"] == int(i)) for i in ids)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_hold_less_disk_than_four_times_the_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    x[1500:1600] = x[:100] + 0.01
    df = common.stash(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))
    shared = common.shared_dir(spark).removeprefix("file://")
    folders = [shared, *map(str, spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())]
    size = lambda path: os.path.getsize(path) if os.path.exists(path) else 0
    held = lambda: sum(size(f"{d}/{f}") for top in folders for d, _, files in os.walk(top) for f in files if d.startswith(shared) or f.startswith("shuffle_"))
    before, seen = held(), []

    def watched(table):
        out = common.materialize(table)
        time.sleep(0.3)
        seen.append(held() - before)
        return out

    monkeypatch.setattr(embeddings, "stash", watched)
    monkeypatch.setattr(embeddings, "ROUND_BYTES", 0, raising=False)
    got = table(embeddings.near_duplicates(df), "vec_id")
    assert max(seen) < 4 * x.nbytes
    assert [i for i in range(3000) if got[i]["n_links"]] == [*range(100), *range(1500, 1600)]


# 9


@pytest.fixture(scope="module")
def codec():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.codec(path, public_tokenizers.PATTERN)


def test_bpe_matches_library(codec):
    assert codec.ranks == {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab aaé\n \t'sll123日本🎉.  ") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 3000, "ab" * 3000, "".join(rng.choice("abcdeth") for _ in range(20_000)), "<|endoftext|>", " \r\n  x"]
    for t in texts:
        ids = library.encode_ordinary(t)
        assert codec.encode(t) == ids and codec.decode(ids) == t.encode()
        assert codec.digest(t) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_bpe_documents(odd):
    got = queries.encode_digests(odd)
    assert got.count() == odd.count() and set(odd.columns) < set(got.columns)
    assert table(got)[1]["n_tokens"] == 0
    full = bpe.encode_documents(odd, lambda: public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in full.where("doc_id = 8").collect():
        assert bytes(r["decoded"]).decode() == "日本語 émoji 🎉 ﬁ İ"


def test_worker_keeps_one_operators_tables():
    own = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), r"\S+")
    first = bpe.codec(*own)
    assert bpe.codec(*own) is first
    gone = weakref.ref(first)
    del first
    assert langid.profiler() is langid.profiler() and gone() is None


def test_bpe_merges_new_words_of_many_texts_at_once(codec, monkeypatch):
    """A queue for each new word took most of the time; one takes those of several texts, with the ids of each as if alone."""
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    own = bpe.Codec(codec.ranks, public_tokenizers.PATTERN)
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("aathernionßÿ日") for _ in range(rng.randint(1, 15))) for _ in range(40)) for _ in range(100)] + ["", "a" * 40_000 + " " + "aab" * 9]
    sizes, merge = [], own.merges.merge
    monkeypatch.setattr(own.merges, "merge", lambda pieces: sizes.append(len(pieces)) or merge(pieces))
    assert [x.tolist() for x in own.packed(texts)] == [library.encode_ordinary(t) for t in texts]
    assert sum(sizes) > 1500 and len(sizes) < sum(sizes) / 50
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2_000)
    assert [x.tolist() for x in own.packed(texts)] == [library.encode_ordinary(t) for t in texts]


def test_bpe_holds_one_text_of_a_batch(codec):
    """A batch stays in Arrow's memory: Python's own holds one text and what is given back."""
    texts = pa.array(["word " * 2000] * 1000 + [None])
    bpe.digests(codec, texts[:1])
    tracemalloc.start()
    got = bpe.digests(codec, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < texts.nbytes / 5
    assert got[0].as_py() == dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), codec.digest("word " * 2000))) and got[1000]["n_tokens"].as_py() == 0


def test_bpe_cache_is_bounded_in_bytes(codec, monkeypatch):
    """Pre-tokens of many ids take no more memory than others: what a generation holds is counted in bytes."""
    monkeypatch.setattr(bpe, "CACHE_BYTES", 500_000, raising=False)
    own = bpe.Codec(codec.ranks, public_tokenizers.PATTERN)
    rng = random.Random(3)
    texts = [" ".join("".join(map(chr, rng.choices(range(0x4E00, 0x9FA5), k=60))) for _ in range(300)) for _ in range(10)]
    ids = own.encode(texts[0])
    tracemalloc.start()
    for t in texts:
        own.encode(t)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1_300_000
    assert ids == own.encode(texts[0]) and own.decode(ids) == texts[0].encode() and own.digest(texts[0])[0] == len(ids)


def test_pipeline_stages_send_small_batches(spark):
    """What a worker is given at once is bounded in bytes; 10,000 whole texts were one batch."""

    @F.arrow_udf("long")
    def batch(texts: pa.Array) -> pa.Array:
        return pa.array([texts.nbytes] * len(texts), pa.int64())

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = spark.range(0, 5000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    spark.conf.unset(key)
    try:
        corpus_pipeline.byte_bpe(spark, df, "")
        assert 1 << 20 < df.select(F.max(batch("text"))).first()[0] <= 5 << 20
        spark.conf.set(key, "1m")
        common.bound_batches(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)


# 10


def test_licenses(spark, odd):
    texts = ["", None, "Released under the MIT License.", "GNU general/public LICENSE and gnu general public license", "cc-by cc by 4.0 K", "no licence", "mit license",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
             "filler " * 500 + "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."]
    got = table(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, t in enumerate(texts):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        at = {label: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for label, p in licenses.PHRASES}
        every = [k for ks in at.values() for k in ks]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(every), min(every, default=None), max(every, default=None))
        assert r["base_labels"] == ",".join(sorted(k for k, v in at.items() if v)) and 0 <= r["score"] <= 1
    assert "mit-text" in got[7]["labels"] and "apache-2.0" in got[8]["labels"].split(",")
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(odd.limit(0)).count() == 0


def test_licenses_joined_in_one_file(spark):
    notices = [f"Part {k}. {key}. {text}." for k, (_, key, text) in enumerate(licenses.TEMPLATES)]
    docs = [(0, "\n\n".join(notices))] + [(1 + k, f"plain filler text {t.split()[0]} number {k}") for k, t in enumerate(notices)]
    got = table(licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")))
    assert set(got[0]["labels"].split(",")) >= {label for label, _, _ in licenses.TEMPLATES}


# Odd rows through the rest, and the pipeline


def test_odd_rows(spark, odd):
    n = odd.count()
    assert simhash.near_duplicates(odd).count() == n and simhash.near_duplicates(odd.limit(0)).count() == 0
    assert pii.find_spans(odd).count() == n and pii.find_spans(odd.limit(0)).count() == 0
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    assert toxicity.score_documents(odd, labels).count() == n and toxicity.score_documents(odd.limit(0), labels).count() == 0
    bench = spark.createDataFrame([(1, "word " * 40)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(odd, bench).collect()} == {7}
    assert decontaminate.contaminated(odd.limit(0), bench).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(100):
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_pipeline_by_stage(spark, tmp_path):
    rng = random.Random(11)
    long = lambda: "\n".join(words(rng, 25) for _ in range(4))
    items = [words(rng, 30) for _ in range(3)]
    docs = [(d, long(), "en", "s") for d in range(40)]
    near = docs[0][1].split("\n")
    docs += [(50, docs[1][1], "en", "s"), (51, "12345 67890", "en", "s"), (52, None, "en", "s"), (53, items[0] + "\n" + long(), "en", "s"), (54, "\n".join([near[0], *long().split("\n")]), "en", "s")]
    pd.DataFrame([(*d, len(d[1] or "")) for d in docs], columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"item_id": range(3), "text": items}).to_parquet(tmp_path / "benchmark.parquet")
    now, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.stash(stage(spark, now, str(tmp_path)))
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        left.append({r["doc_id"] for r in now.collect()})
    every = {d[0] for d in docs}
    assert left[0] == every - {51, 52} and left[1] == left[0] - {50} and left[2] == left[1] and left[3] == left[2] - {53}
    text = {r["doc_id"]: r["text"] for r in now.collect()}
    assert text[54] == "\n".join(docs[-1][1].split("\n")[1:]) and text[0] == docs[0][1]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == left[3]
    assert all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in out)
