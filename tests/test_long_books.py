"""Books cut into chunks: the same rows as whole ones, and spread over many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.config import CleaningConfig
from quillspark.operators import chapters, cleaning, lines, overlay, spans

KINDS = ["watermark_keyword", "watermark_repetition", "watermark_non_cjk", "control_char"]
FIRST = {"watermark_keyword": 3, "watermark_repetition": 2, "watermark_non_cjk": 1}


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(6)
    rows = [(k, "".join(rng.choice(["a", "bc", "\n", "\n", " ", "　", "é日", "🎉", "\r\n", "\x01", "\t"]) for _ in range(rng.randint(0, 90)))) for k in range(80)]
    rows += [(500, None), (501, ""), (None, "x\ny  \n\n\n\nz" * 9), (502, "\n"), (503, "日" * 50), (504, "日" * 50 + "\n")]
    return rows, spark.createDataFrame(rows, "book_id long, source_text string").withColumns({"chunk": F.lit("c"), "piece": F.lit(1), "parts": F.lit(2)})


def plain_lines(rows):
    out = []
    for book, text in rows:
        raw = (text or "").split("\n")
        at = chars = 0
        for k, line in enumerate(raw):
            ended = k < len(raw) - 1
            if ended or line:
                out.append((book, k, line, len(line), at, at + len(line.encode()), chars, ended, len(text.encode())))
            at, chars = at + len(line.encode()) + 1, chars + len(line) + 1
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [4, 7, 40, 1 << 20])
def test_lines_of_chunks(texts, chunk):
    rows, df = texts
    got = lines.split_lines(df, chunk).select("book_id", "line_no", "line", "n_chars", "byte_start", "byte_end", "char_start", "ended", "n_bytes")
    assert sorted(map(tuple, got.collect()), key=str) == plain_lines(rows)


def test_a_long_book_is_the_work_of_many_tasks(spark):
    book = spark.range(1).select(F.lit("b").alias("book_id"), F.repeat(F.lit("第一章 the same short line again\n"), 400_000).alias("source_text"))
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = [n for (n,) in lines.split_lines(book, 1 << 18).groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(counts) == 400_000 and len(counts) >= 16 and max(counts) <= sum(counts) / 8


@pytest.fixture(scope="module")
def some_spans(spark):
    rng = random.Random(7)
    rows = set()
    for book in [*range(30), None]:
        for _ in range(rng.randint(0, 30)):
            start = rng.randint(0, 300)
            rows.add((book, start, start + rng.choice([1, 2, 5, 20, 100]), rng.choice(KINDS)))
    rows = [(*r, rng.choice([None, "x"])) for r in sorted(rows, key=str)]
    df = spark.createDataFrame(rows, "book_id long, start long, end long, kind string, replacement string").withColumns({"chunk": F.lit(1), "reach": F.lit("r"), "row": F.lit(2)})
    return rows, df


def by_book(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1:4])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("pieces", [1, 3, 50])
def test_merged_and_contained_spans_of_chunks(some_spans, pieces):
    rows, df = some_spans
    merged, kept = [], []
    for book, own in by_book(rows).items():
        runs, reach = [], -1
        for r in own:
            if reach < 0 or r[2] > reach:
                kept.append(r)
            if runs and r[1] < reach:
                runs[-1].append(r)
            else:
                runs.append([r])
            reach = max(reach, r[2])
        for run in runs:
            best = max(run, key=lambda r: FIRST.get(r[3], 10))
            merged.append((book, run[0][1], max(r[2] for r in run), best[3], best[4]))
    width = 400 // pieces
    assert sorted(map(tuple, spans.merge_spans(df, width).collect()), key=str) == sorted(merged, key=str)
    held = spans.drop_contained(df, width)
    assert held.columns == df.columns
    assert sorted((tuple(r)[:5] for r in held.collect()), key=str) == sorted(kept, key=str)


@pytest.mark.parametrize("pieces", [1, 3, 50])
def test_ranges_of_chunks(spark, some_spans, pieces):
    rows, df = some_spans
    rng = random.Random(8)
    ranges = [(b, 10 * x, 10 * x + 7, x) for b in range(28) for x in sorted(rng.sample(range(40), rng.randint(0, 12)))]
    got = spans.assign_to_ranges(df.select("book_id", "start", "end"), spark.createDataFrame(ranges, "book_id long, start long, end long, no long"), ["no"], 400 // pieces)
    want = []
    for b, start, end, *_ in rows:
        last = max((r for r in ranges if r[0] == b and r[1] <= start <= r[2]), default=(None,) * 4)
        want.append((b, start, end, last[1], last[2], last[3]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_cleaning_of_chunks(texts):
    rows, df = texts
    whole = lines.split_lines(df)
    want = sorted(map(tuple, cleaning.cleaning_annotations(whole, CleaningConfig.everything()).collect()), key=str)
    assert want
    for width in (4, 30):
        assert sorted(map(tuple, cleaning.cleaning_annotations(whole, CleaningConfig.everything(), width).collect()), key=str) == want


def test_spans_of_empty_tables(spark, some_spans):
    _, df = some_spans
    none = df.limit(0)
    assert spans.merge_spans(none).count() == 0 and spans.drop_contained(none).count() == 0
    plain = df.select("book_id", "start", "end")
    ranges = spark.createDataFrame([], "book_id long, start long, end long, no long")
    assert spans.assign_to_ranges(plain.limit(0), ranges, ["no"]).count() == 0
    assert spans.assign_to_ranges(plain, ranges, ["no"]).where("no is null and range_start is null").count() == plain.count()
    layers = plain.where("book_id is not null").withColumn("layer", F.lit("l"))
    assert overlay.overlap_lines(lines.split_lines(spark.createDataFrame([(0, "ab\ncd")], "book_id long, source_text string")), layers).where("e <= s").count() == 0


def plain_splice(text, edits):
    raw, out, at = text.encode(), b"", 0
    for start, end, new in sorted(edits, key=lambda e: (e[0], e[1], e[2] or "")):
        if start >= at:
            out, at = out + raw[at:start] + (new or "").encode(), end
    return (out + raw[at:]).decode()


@pytest.mark.parametrize("apart", [True, False])
def test_spliced_texts(spark, apart):
    rng = random.Random(9)
    rows = [(500, None, [(0, 1, None)]), (501, "é日", None), (502, "", []), (503, "é日🎉", [(0, 9, None)]), (504, "é日", [(2, 2, "+"), (5, 5, "🎉")])]
    for k in range(60):
        text = "".join(rng.choice(["a", "é", "日", "🎉"]) for _ in range(rng.randint(0, 40)))
        cuts = sorted({len(text[:i].encode()) for i in range(len(text) + 1)})
        ends = sorted(rng.sample(cuts, 2 * rng.randint(0, len(cuts) // 2)))
        edits = [(a, b, rng.choice([None, "", "新"])) for a, b in zip(ends[::2], ends[1::2])]
        if not apart:
            edits += [(min(x), max(x), "-") for x in (rng.choices(cuts, k=2) for _ in range(8))]
        rows.append((k, text, sorted(edits, key=lambda e: (e[0], e[1], e[2] or ""))))
    df = spark.createDataFrame(rows, "book_id long, source_text string, edits array<struct<start:long,end:long,replacement:string>>")
    want = {k: None if t is None else plain_splice(t, e or []) for k, t, e in rows}
    assert {k: t for k, t in df.select("book_id", spans.spliced("source_text", "edits")).collect()} == want
    flat = df.select("book_id", F.inline("edits"))
    applied = spans.apply_spans(df.select("book_id", "source_text", F.lit("x").alias("edits")), flat, ["book_id"])
    assert {r["book_id"]: r["cleaned"] for r in applied.collect()} == want
    assert "Python" not in applied._jdf.queryExecution().toString()


@pytest.mark.parametrize("width", [4, 30, 1 << 20])
def test_paragraphs_of_chunks(spark, texts, width):
    rng, want, bodies, edits = random.Random(10), [], [], []
    for book, text in (r for r in texts[0] if r[0] is not None and r[1]):
        own = sorted(plain_lines([(book, text)]), key=lambda r: r[1])
        edges = sorted({0, len(own), *(rng.randint(0, len(own)) for _ in range(3))})
        chars = sorted({len(text[:i].encode()) for i in range(len(text) + 1)})
        picked = sorted(rng.sample(chars, 2 * min(4, len(chars) // 2)))
        cuts = [(a, b, rng.choice([None, "x"])) for a, b in zip(picked[::2], picked[1::2])]
        edits += [(book, *c[:2], "watermark_keyword", c[2]) for c in cuts]
        edits.append((book, 0, len(text.encode()), "blank_line_compression", "\n\n"))
        for no, (a, b) in enumerate(zip(edges, edges[1:])):
            start, end = own[a][4], own[b - 1][5]
            if end <= start:
                continue
            bodies.append((book, no, start, end))
            held = [c for c in cuts if start <= c[0] and c[1] <= end]
            n = 0
            for _, _, line, _, s, e, *_ in own[a:b]:
                if s >= end:
                    continue
                here = [(c[0] - s, min(c[1], e) - s, c[2]) for c in held if s <= c[0] <= e]
                here += [(0, min(c[1], e) - s, None) for c in held if c[0] < s < c[1]]
                new = plain_splice(line, here).strip()
                if new:
                    want.append((book, no, n, new))
                    n += 1
    assert len(want) > 100
    ranges = spark.createDataFrame(bodies, "book_id long, chapter_no int, body_start long, body_end long")
    table = spark.createDataFrame(edits, "book_id long, start long, end long, kind string, replacement string")
    # names that the scan uses itself
    clashing = {c: F.lit("c") for c in ("chunk", "side", "text", "body", "cut", "before", "edit")}
    got = chapters.materialize_paragraphs(lines.split_lines(texts[1]).withColumns(clashing), ranges.withColumns(clashing), table.withColumns(clashing), width)
    assert sorted(map(tuple, got.collect())) == sorted(want)
