"""Lines, cleaning, chapters, and boilerplate on small books with known outcomes."""

import time

import pytest
from pyspark.sql import functions as F

from quillspark.config import CleaningConfig, WatermarkConfig, partial_config
from quillspark.functions import text
from quillspark.operators import chapters, cleaning, lines, rules, spans, watermark
from quillspark.plans.books import Curation

BOOKS = {
    "flat3": "第一章 起\n正文1\n\n第二章 承\n正文2a\n正文2b\n第三章 转\n正文3",
    "preface": "雨下了一整夜,屋檐还在滴水\n\n第一章\n天亮了",
    "no_heading": "一行\n两行\n三行",
    "keyword_in_body": "第一章\n信纸上抄着第一章 里的两行字\n第二章\n后续",
    "arabic": "第1章 阿拉伯数字\n正文\n第2章 第二\n正文",
    "volumes": "第一卷 渡口\n第一章 船\n河水很慢\n第二章 桥\n桥下无人\n第二卷 山路\n第三章 雪\n脚印很浅\n",
    "heading_bytes": "第一章 起\n正文1\n第二章 承\n正文2",
    "trailing_in_body": "第一章\n正文1   \n正文2　\n",
    "long_line": "第一章 " + "很长的标题" * 30,
    "crlf": "第一章\r\n正文1\r\n\r\n\r\n正文2\r\n",
    "empty": "",
    "null": None,
    "x50": "第一章 起\n" + "本书首发于甲乙丙读书站,多谢捧场\n他沿着河岸一直走到了黄昏\n" * 50,
    "heading_wm": "第一章 首发于\n窗外有风。\n第二章 灯\n灯还亮着。\n",
    "dialogue": "「你从哪里听来的？本书首发于 https://example.org」\n" * 50,
    "ncjk": "本文首发于 https://example.com 谢谢支持。",
    "keyword_only": "本书首发于甲乙丙读书站,多谢捧场。",
    "emoji": "a🎉b\n　　第一章 起   \n\n\n\n  正文1\t\t\n前\x01中\x07后\x7f\n",
}


@pytest.fixture(scope="module")
def run(spark):
    rows = [(k, f"T {k}", v) for k, v in BOOKS.items()]
    return Curation(spark.createDataFrame(rows, "book_id string, title string, source_text string"))


@pytest.fixture(scope="module")
def chapter_rows(run):
    out = {}
    for r in run.chapters.orderBy("book_id", "chapter_no").collect():
        out.setdefault(r["book_id"], []).append(r)
    return out


def test_lines_have_true_byte_offsets(run):
    seen = {}
    for r in run.lines.collect():
        raw = BOOKS[r["book_id"]].encode()
        assert raw[r["byte_start"] : r["byte_end"]].decode() == r["line"]
        assert BOOKS[r["book_id"]][r["char_start"] : r["char_start"] + r["n_chars"]] == r["line"]
        seen[r["book_id"]] = seen.get(r["book_id"], 0) + 1
    for k, v in BOOKS.items():
        expect = len((v or "").split("\n")) - int((v or "").endswith("\n") or not v)
        assert seen.get(k, 0) == expect


def test_chapters(chapter_rows):
    titles = {k: [r["title"] for r in v] for k, v in chapter_rows.items()}
    assert titles["flat3"] == ["第一章 起", "第二章 承", "第三章 转"]
    assert titles["preface"] == ["楔子", "第一章"]
    assert titles["no_heading"] == ["T no_heading"]
    assert titles["keyword_in_body"] == ["第一章", "第二章"]
    assert titles["arabic"] == ["第1章 阿拉伯数字", "第2章 第二"]
    assert titles["long_line"] == ["T long_line"]
    assert [r["volume_no"] for r in chapter_rows["volumes"]] == [1, 1, 2]
    first = chapter_rows["heading_bytes"][0]
    assert (first["heading_start"], first["heading_end"], first["body_start"]) == (0, 13, 14)
    assert chapter_rows["no_heading"][0]["origin"] == "fallback"


def test_oversized_chapters_split(spark):
    small = "".join(f"第{n}章 短\n{'短正文' * 5}\n" for n in range(1, 5))
    text = small + "第5章 长\n" + "开头" * 30 + "\n\n独立小节\n\n" + "中间" * 30 + "\n\n又一小节\n\n" + "末尾" * 30 + "\n"
    even = "".join(f"第{n}章\n{'正文' * 10}\n" for n in range(1, 5))
    c = Curation(spark.createDataFrame([("o", "O", text), ("e", "E", even)], "book_id string, title string, source_text string"))
    got = [(r["book_id"], r["title"], r["origin"]) for r in c.chapters.orderBy("book_id", "chapter_no").collect()]
    assert [t for b, t, o in got if o == "structural"] == ["独立小节", "又一小节"]
    assert sum(b == "e" for b, _, _ in got) == 4


def test_paragraphs(run):
    found = {}
    for r in run.paragraphs.orderBy("book_id", "chapter_no", "para_no").collect():
        found.setdefault(r["book_id"], []).append(r["text"])
    assert found["trailing_in_body"] == ["正文1", "正文2"]
    assert found["crlf"] == ["正文1", "正文2"]
    assert found["x50"] == ["他沿着河岸一直走到了黄昏"] * 50
    assert "empty" not in found and "null" not in found


def test_cleaning_round_trip(run):
    cleaned = {r["book_id"]: r["cleaned"] for r in cleaning.apply_cleaning(run.books, run.cleaning).collect()}
    assert cleaned["emoji"] == "a🎉b\n第一章 起\n\n  正文1\n前中后\n"
    assert cleaned["crlf"] == "第一章\n正文1\n\n正文2\n"
    off = cleaning.cleaning_annotations(run.lines)
    assert off.count() == 0


def test_cleaning_spans_are_sorted_apart(run):
    last = {}
    for r in run.cleaning.orderBy("book_id", "start").collect():
        assert r["start"] >= last.get(r["book_id"], 0) and r["end"] > r["start"]
        last[r["book_id"]] = r["end"]


def test_watermarks(run):
    by = {}
    for r in run.watermarks.collect():
        by.setdefault(r["book_id"], []).append(r)
    assert len(by["x50"]) == 50 and all(r["verdict"] == "auto" and abs(r["score"] - 0.8) < 1e-9 for r in by["x50"])
    assert by["ncjk"][0]["verdict"] == "suspect" and [s["kind"] for s in by["ncjk"][0]["signals"]] == ["non_cjk_ratio", "keyword_regex"]
    assert not {"heading_wm", "dialogue", "keyword_only"} & set(by)
    off = watermark.watermarks(run.lines, run.rules, None, WatermarkConfig(enabled=False))
    assert off.count() == 0


def test_merge_spans(spark):
    rows = [
        ("a", 10, 15, "trailing_whitespace"), ("a", 12, 30, "watermark_keyword"), ("b", 10, 25, "watermark_repetition"), ("b", 20, 30, "watermark_keyword"),
        ("c", 0, 5, "control_char"), ("c", 5, 9, "control_char"), ("d", 3, 4, "watermark_non_cjk"),
    ]
    df = spark.createDataFrame([(*r, None) for r in rows], "book_id string, start long, end long, kind string, replacement string")
    got = sorted(tuple(r)[:4] for r in spans.merge_spans(df).collect())
    assert got == [("a", 10, 30, "trailing_whitespace"), ("b", 10, 30, "watermark_keyword"), ("c", 0, 5, "control_char"), ("c", 5, 9, "control_char"), ("d", 3, 4, "watermark_non_cjk")]


def test_partial_config():
    assert partial_config(CleaningConfig(), {"control_char": True}).control_char
    with pytest.raises(ValueError):
        partial_config(CleaningConfig(), {"nope": True})


def test_empty_tables(spark):
    c = Curation(spark.createDataFrame([], "book_id string, title string, source_text string"))
    for name in ("lines", "chapters", "watermarks", "cleaning", "merged", "paragraphs"):
        assert getattr(c, name).count() == 0


RULE_LINES = [
    ("chapter", "第一章 起", True), ("chapter", "第十二回", True), ("chapter", "第3节　开端", True), ("chapter", "番外篇 一", True), ("chapter", "他读第一章", False), ("chapter", "第一章节", False),
    ("volume", "第一卷 渡口", True), ("volume", "卷三", True), ("volume", "上卷", True), ("volume", "上卷书", False),
    ("watermark", "请到 https://a.b/c", True), ("watermark", "访问foo.com吧", False), ("watermark", "see foo.com now", True), ("watermark", "盗版必究", True), ("watermark", "正文", False),
]


def test_rule_lines(spark):
    found = rules.builtin_rules(spark)
    df = spark.createDataFrame(RULE_LINES, "kind string, line string, expect boolean")
    for kind in ("chapter", "volume", "watermark"):
        hit = rules.match_first_rule("line", rules.compiled(found, kind)).isNotNull()
        for r in df.where(df.kind == kind).withColumn("hit", hit).collect():
            assert r["hit"] == r["expect"], r


def test_rule_sets(spark, tmp_path):
    base = rules.builtin_rules(spark)
    mine = spark.createDataFrame([("builtin-chapter-cn-zhang", "^X$", "chapter", True, 1, "user", "", 0), ("mine", "^Y$", "chapter", True, 5, "user", "", 1)], rules.RULE_SCHEMA + ", ord int")
    both = rules.merge_rules(base, mine)
    assert both.count() == 18 and rules.find_rule(both, "builtin-chapter-cn-zhang").first()["pattern"] == "^X$"
    assert both.where("id = 'builtin-chapter-cn-zhang'").first()["ord"] == 0
    assert rules.remove_rules(both, mine).count() == 16
    assert rules.validate_rules(base.limit(2)).count() == 0
    bad = spark.createDataFrame([("bad", "(", "chapter", True, 1, "user", "", 0)], rules.RULE_SCHEMA + ", ord int")
    assert rules.validate_rules(bad).first()["id"] == "bad"
    with pytest.raises(ValueError):
        rules.compiled(bad, "chapter")
    rules.write_rules(both, str(tmp_path / "r"))
    again = rules.read_rules(spark, str(tmp_path / "r"))
    assert {r["id"]: r["pattern"] for r in again.collect()} == {r["id"]: r["pattern"] for r in both.collect()}
    (tmp_path / "part.json").write_text('{"rules": [{"id": "a", "pattern": "x", "kind": "watermark"}]}')
    assert rules.read_rules(spark, str(tmp_path / "part.json")).first()["enabled"]


def test_texts_are_dealt_out_once(spark):
    books = spark.createDataFrame([("a", "x\ny")], "book_id string, source_text string")
    plan = lines.split_lines(books)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1


def test_repeats_without_a_sort_by_text(spark):
    rows = [(b, k, t, "n") for b in ("a", "b", None) for k, t in enumerate(["hot line"] * 3000 + ["twice"] * 2 + [f"once {b} {k}" for k in range(500)])]
    some = spark.createDataFrame(rows, "book_id string, line_no int, trimmed string, n string").withColumns({"h": F.lit(1), "n1": F.lit(2)})
    got = watermark.line_frequency(some)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "trimmed#" not in "".join(x for x in plan.splitlines() if "- Sort [" in x)
    assert got.columns == [*some.columns, "repeats"]
    assert {(r["trimmed"].split()[0], r["repeats"], r["count"]) for r in got.groupBy("trimmed", "repeats").count().collect() if r["repeats"] > 1} == {("hot", 3000, 9000), ("twice", 2, 6)}
    assert got.where("repeats = 1").count() == 1500
    assert watermark.line_frequency(some.limit(0)).count() == 0


def test_chapter_lengths(spark):
    sized = spark.createDataFrame([("a", 1), ("a", 4), ("b", 7)], "book_id string, n_chars long")
    assert {r["book_id"]: r["median"] for r in chapters.chapter_length_median(sized).collect()} == {"a": 2, "b": 7}


def test_a_long_book_is_split_in_linear_time(spark):
    """A book of some two million characters and 100,000 lines."""
    book = spark.range(1).select(F.col("id").alias("book_id"), F.repeat(F.lit("第一行文字 and twenty.\n"), 100_000).alias("source_text"))
    began = time.time()
    got = lines.split_lines(book).agg(F.count("*"), F.max("byte_end"), F.max("n_bytes")).first()
    assert tuple(got) == (100_000, 100_000 * 28 - 1, 100_000 * 28) and time.time() - began < 20


def test_signals_of_a_text_are_told_below_the_exchange(spark):
    """A filter on the score names the signals many times over; patterns in it would be matched anew for each."""
    line = "book_id long, line_no int, line string, trimmed string, n_chars int, byte_start long, byte_end long, char_start long, ended boolean, n_bytes long"
    found = watermark.watermarks(spark.createDataFrame([], line), rules.builtin_rules(spark))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join", 1)
    assert "RLIKE" not in above and "regexp_replace" not in above and "RLIKE" in below


def test_characters_of_chinese_context_are_counted(spark):
    texts = ["", "abc", "中文", "a中b文文，c", "🎉中🎉", "\u3000\u00a0\u00b7\ufeffx", "第１章 \n é"]
    want = [0, 0, 2, 4, 1, 4, 3]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", text.cjk_count("t").alias("n")).orderBy("k").collect()
    assert [r["n"] for r in got] == want
