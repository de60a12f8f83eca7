"""Offsets by the sparse index against plain counting, and services that fail."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators import asking, offsets, rules


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice(["a", "é", "日", "🎉", "\n"]) for _ in range(rng.randint(0, 60)))) for k in range(40)]
    rows += [(100, None), (101, ""), (None, "abc"), (102, "日" * 40), (103, "🎉" * 40), (104, "a" * 64)]
    return rows, spark.createDataFrame(rows, "book_id long, source_text string").withColumns({"piece": F.lit(1), "held": F.lit(2), "chunk": F.lit(3)})


@pytest.mark.parametrize("piece", [4, 7, 16, 4096])
def test_offsets_by_index(spark, texts, piece):
    rows, df = texts
    index = offsets.offset_index(df, piece)
    asked, want = [], []
    for book, text in [*rows, (999, None)]:
        raw = None if text is None or book is None else text.encode()
        for at in [-5, None, *range(len(raw or b"") + 3)]:
            asked.append((book, at, "x"))
            if raw is None or at is None:
                want.append((book, at, "x", None, None))
                continue
            cut = min(max(at, 0), len(raw))
            while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
                cut -= 1
            head = raw[:cut].decode()
            want.append((book, at, "x", len(head), len(head.encode("utf-16-le")) // 2))
    points = spark.createDataFrame(asked, "book_id long, byte long, at string")
    got = offsets.bytes_to_chars(points, index, piece_bytes=piece).select("book_id", "byte", "at", "char", "utf16")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)

    asked, want = [], []
    for book, text in rows:
        for at in [-1, None, *range(len(text or "") + 2)]:
            asked.append((book, at, "y"))
            known = text is not None and book is not None and at is not None
            want.append((book, at, len(text[: max(at, 0)].encode()) if known else None))
    points = spark.createDataFrame(asked, "book_id long, char long, bucket string")
    got = offsets.chars_to_bytes(points, index, piece_bytes=piece).select("book_id", "char", "byte")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_offsets_of_a_long_line_take_seconds(spark):
    text = spark.range(1).select(F.col("id").alias("book_id"), F.repeat(F.lit("é日🎉a"), 500_000).alias("source_text"))
    points = spark.range(100_000).select(F.lit(0).cast("long").alias("book_id"), (F.col("id") * 50).alias("byte"))
    began = time.monotonic()
    index = offsets.offset_index(text)
    found = offsets.bytes_to_chars(points, index)
    wrong = found.where(F.col("char") != F.floor(F.col("byte") / 10) * 4).count()
    assert wrong == 0 and found.agg(F.max("utf16")).first()[0] == 99_999 * 5 * 5
    assert time.monotonic() - began < 60


def test_offsets_of_empty_tables(spark, texts):
    none = texts[1].limit(0)
    points = spark.createDataFrame([(1, 2)], "book_id long, byte long")
    index = offsets.offset_index(none)
    assert index.count() == 0
    assert offsets.bytes_to_chars(points, index).collect()[0]["char"] is None
    assert offsets.chars_to_bytes(points.limit(0).withColumnRenamed("byte", "char"), offsets.offset_index(texts[1])).count() == 0


def test_a_service_that_fails_half_the_time(spark, tmp_path):
    log, calls = str(tmp_path / "log"), str(tmp_path / "calls")
    df = spark.createDataFrame([(k, None if k == 7 else f"q{k % 40}", "old") for k in range(60)], "book_id long, request string, reply string")

    def fails_at_first(requests):
        import os
        import pathlib
        import uuid

        os.makedirs(calls, exist_ok=True)
        asked_before = sum(p.read_text().split("\n")[0] == requests[0] for p in pathlib.Path(calls).iterdir())
        (pathlib.Path(calls) / uuid.uuid4().hex).write_text("\n".join(requests))
        if asked_before == 0 and int(requests[0][1:]) % 2 == 0:
            raise OSError("busy")
        return [r.upper() for r in requests]

    got = asking.ask(df, log, fails_at_first, batch=1, wait=0.01, waves=3, tasks=2)
    want = [(k, None, None) if k == 7 else (k, f"q{k % 40}", f"Q{k % 40}") for k in range(60)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    told = asking.read_log(spark, log)
    # request 7 comes from book 47; twenty of the forty took two tries
    assert told.count() == 40 and told.where("attempts = 2").count() == 20

    import os

    n = len(os.listdir(calls))
    again = asking.ask(df, log, fails_at_first, batch=1, waves=3)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(want, key=str) and len(os.listdir(calls)) == n


def test_what_failed_is_told_and_asked_again(spark, tmp_path):
    log = str(tmp_path / "log")
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "request string")

    def broken(requests):
        raise OSError("down")

    assert [r["reply"] for r in asking.ask(df, log).collect()] == [None] * 3
    assert [r["reply"] for r in asking.ask(df, log, broken, attempts=2, wait=0.01).collect()] == [None] * 3
    assert {(r["request"], r["error"], r["attempts"]) for r in asking.read_log(spark, log).collect()} == {("a", "OSError: down", 2), ("b", "OSError: down", 2)}
    short = asking.ask(df, log, lambda r: [], attempts=1)
    assert [r["reply"] for r in short.collect()] == [None] * 3
    assert sorted(r["reply"] for r in asking.ask(df, log, lambda r: list(r)).collect()) == ["a", "a", "b"]
    # another service has replies of its own, and no requests need no log
    assert [r["reply"] for r in asking.ask(df, log, name="search").collect()] == [None] * 3
    assert asking.ask(df.limit(0), str(tmp_path / "none"), lambda r: r).count() == 0


def test_rules_that_cannot_be_used_are_left_out(spark):
    df = spark.createDataFrame([("a", "x+"), ("b", "(x"), ("c", "(a+)+$")], "id string, pattern string")
    assert [r["id"] for r in rules.usable_rules(df).collect()] == ["a"]


def test_characters_of_parts_that_are_torn(spark):
    """Every part of a text, also one that begins or ends inside a character, without a scan that replaces byte by byte."""
    raw = "aé中🎉b🎉🎉中é".encode()
    parts = [raw[i:j] for i in range(len(raw)) for j in range(i, len(raw) + 1)]
    df = spark.createDataFrame([(bytearray(p),) for p in parts], "p binary").select("p", offsets._chars(F.col("p")).alias("chars"), offsets._units(F.col("p")).alias("units"))
    assert "translate" not in df.select("chars")._jdf.queryExecution().optimizedPlan().toString()
    for r in df.collect():
        begun = sum(x & 0xC0 != 0x80 for x in r["p"])
        assert (r["chars"], r["units"]) == (begun, begun + sum(x >= 0xF0 for x in r["p"])), bytes(r["p"])
