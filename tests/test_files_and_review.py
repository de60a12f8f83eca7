"""File sources, decoding, review helpers, metadata, export, and streaming."""

import io
import zipfile
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import export, metadata, review
from quillspark.plans import catalog
from quillspark.plans.books import BOILERPLATE, Curation, books
from quillspark.sources import files
from quillspark.streaming.curate import batch_folders, curate_stream, first_seen, stream_books


def test_decode(spark, tmp_path):
    cases = {
        "utf8.txt": ("你好".encode(), None, "你好", "UTF-8", "ok"),
        "bom.txt": (b"\xef\xbb\xbf" + "你好".encode(), None, "你好", "UTF-8", "ok"),
        "gbk.txt": ("中文小说内容".encode("gbk"), None, "中文小说内容", "gb18030", "ok"),
        "le.txt": (b"\xff\xfe" + "你好".encode("utf-16le"), None, "你好", "UTF-16LE", "ok"),
        "be.txt": (b"\xfe\xff" + "你好".encode("utf-16be"), None, "你好", "UTF-16BE", "ok"),
        "label_first.txt": (b"\xef\xbb\xbf" + "你好啊".encode(), "gb18030", (b"\xef\xbb\xbf" + "你好啊".encode()).decode("gb18030"), "gb18030", "ok"),
        "labelled.txt": ("你好".encode("gb18030"), "gb18030", "你好", "gb18030", "ok"),
        "unknown.txt": (b"abc", "klingon", None, None, "unknown_label"),
        "bad.txt": (b"\xc0\xc0\xc0", "utf-8", None, "UTF-8", "malformed"),
    }
    for name, (raw, *_) in cases.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "skip.bin").write_bytes(b"x")
    raw = files.read_raw_books(spark, str(tmp_path))
    labels = spark.createDataFrame([(r["path"], cases[r["path"].rsplit("/", 1)[1]][1]) for r in raw.select("path").collect()], "path string, label string")
    books = files.decode_books(raw, labels)
    got = {r["path"].rsplit("/", 1)[1]: r for r in books.collect()}
    assert set(got) == set(cases)
    for name, (_, _, text, encoding, status) in cases.items():
        assert (got[name]["source_text"], got[name]["source_encoding"], got[name]["decode_status"]) == (text, encoding, status), name
    good, bad = files.quarantine_malformed(books)
    assert good.count() == 7 and bad.count() == 2


CHINESE = "清晨的集市上人声鼎沸，卖菜的老人把新摘的豆角摆得整整齐齐，孩子们在人群里跑来跑去，笑声传得很远。"
TRADITIONAL = "清晨的市集上人聲鼎沸，賣菜的老人把新摘的豆角擺得整整齊齊，孩子們在人群裡跑來跑去，笑聲傳得很遠。"
JAPANESE = "朝の市場には人があふれていた。野菜を売る老人は、とれたての豆をていねいに並べている。"
KOREAN = "이른 아침 시장에는 사람들이 가득했고 채소를 파는 노인은 갓 딴 콩을 가지런히 늘어놓았다"


@pytest.mark.parametrize("text,encoding", [(CHINESE, "gb18030"), (TRADITIONAL, "Big5"), (JAPANESE, "Shift_JIS"), (JAPANESE, "EUC-JP"), (KOREAN, "EUC-KR"), (CHINESE, "UTF-8"), (KOREAN, "UTF-8")])
def test_detected_encodings(text, encoding):
    assert files.decode_one(text.encode(encoding), None) == (text, encoding, "ok")


def test_encoding_names():
    labels = {"cp936": "GBK", "sjis": "Shift_JIS", "UTF-16": "UTF-16LE", " latin1 ": "windows-1252", "iso-8859-2": "ISO-8859-2", "koi8-r": "KOI8-R", "cp949": "EUC-KR", "klingon": None, "": None, None: None}
    assert {x: files.canonical_name(x) for x in labels} == labels


def test_strip_bom(spark):
    rows = [(b"\xef\xbb\xbfab", "UTF-8"), (b"\xff\xfea\x00", "UTF-16LE"), (b"\xff\xfea\x00", "UTF-8")]
    got = [bytes(r[0]) for r in spark.createDataFrame(rows, "content binary, encoding string").select(files.strip_bom()).collect()]
    assert got == [b"ab", b"a\x00", b"\xff\xfea\x00"]


def test_read_decisions(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"book_id": "a", "span": {"start": 1, "end": 2}, "scope": "watermark", "verdict": "approved"}]')
    assert tuple(files.read_decisions(spark, str(tmp_path / "d.json")).first()) == ("a", 1, 2, "watermark", "approved")
    (tmp_path / "bad.json").write_text('[{"book_id": "a", "span": 3}]')
    with pytest.raises(Exception):
        files.read_decisions(spark, str(tmp_path / "bad.json")).collect()


def test_offsets(spark):
    rows = [("hi你好", b, c) for b, c in ((0, 0), (2, 2), (3, 2), (4, 2), (5, 3), (8, 4), (99, 4))] + [("a🎉b", b, c) for b, c in ((1, 1), (3, 1), (5, 2), (6, 3))]
    df = spark.createDataFrame(rows, "text string, byte int, char int")
    for r in df.withColumn("got", T.byte_to_char("text", "byte")).collect():
        assert r["got"] == r["char"], r
    back = spark.createDataFrame([("hi你好", 3, 5), ("a🎉b", 2, 5), ("", 4, 0)], "text string, char int, byte int")
    assert all(r["got"] == r["byte"] for r in back.withColumn("got", T.char_to_byte("text", "char")).collect())
    assert df.select(T.utf16_length("text")).distinct().count() == 1


def test_trim(spark):
    df = spark.createDataFrame([("　 a b \x85 ",), ("​a﻿",), ("　",)], "t string")
    assert [r[0] for r in df.select(T.trim_unicode("t")).collect()] == ["a b", "​a﻿", ""]


def test_verdict_lines(spark):
    batches = spark.createDataFrame([("a", 0, 4)], "book_id string, batch long, n long")
    replies = spark.createDataFrame([("a", 0, "1. 水印: 含链接\n\n2. 正文: 叙述\n随便")], "book_id string, batch long, reply string")
    got = [tuple(r)[2:] for r in review.parse_verdict_lines(batches, replies).orderBy("i").collect()]
    assert got == [(1, "is_watermark", "含链接"), (2, "is_content", None), (3, "uncertain", None), (4, "uncertain", None)]


def test_decisions_log(spark):
    log = spark.createDataFrame([("a", 0, 1, "watermark", "approved", 1), ("a", 0, 1, "watermark", "rejected", 2)], "book_id string, start long, end long, scope string, verdict string, ts int")
    last = review.last_decisions(log)
    assert last.first()["verdict"] == "rejected"
    again = review.toggle_decisions(last, last, "watermark", "rejected")
    assert again.count() == 0 and review.toggle_decisions(again, last, "watermark", "approved").first()["verdict"] == "approved"


def test_metadata_replies(spark):
    raw = [("f", '```json\n{"title": " 书 ", "author": "未知", "subjects": ["a", " ", "b"], "series_index": "3"}\n```'), ("b", "oops"), ("n", '{"title": "null", "subjects": "a，b / c", "series_index": 2}')]
    got = {r["book_id"]: r for r in metadata.parse_metadata_json(spark.createDataFrame(raw, "book_id string, raw string")).collect()}
    assert (got["f"]["title"], got["f"]["author"], got["f"]["subjects"], got["f"]["series_index"]) == ("书", None, ["a", "b"], 3)
    assert got["b"]["title"] is None and got["b"]["subjects"] == []
    assert (got["n"]["title"], got["n"]["subjects"], got["n"]["series_index"]) == (None, ["a", "b", "c"], 2)
    known = {r["book_id"]: r["k"] for r in metadata.parse_metadata_json(spark.createDataFrame(raw, "book_id string, raw string")).select("book_id", metadata.known_fields().alias("k")).collect()}
    assert known == {"f": "- 已知书名:书\n- 已知分类:a、b", "b": "(尚无任何已知字段)", "n": "- 已知分类:a、b、c"}
    found = metadata.search_context(spark.createDataFrame([("a", 1, "t", "u", None)], "book_id string, rank int, title string, url string, snippet string"))
    assert found.first()["context"] == "1. 标题:t\n   URL:u\n   摘要:"


def _curation(spark):
    text = "第一卷 风<起>\n第一章 起\n正文1\n第二章 承\n正文2\n"
    return Curation(spark.createDataFrame([("a", "书 & 名", text)], "book_id string, title string, source_text string"))


def test_epub(spark):
    c = _curation(spark)
    found = export.sections(c.chapters, c.volumes)
    meta = c.books.select("book_id", "title", F.lit("me").alias("author"), F.lit(None).cast("string").alias("description"), F.lit("zh-CN").alias("language"), F.array(F.lit("s")).alias("subjects"), F.lit("S").alias("series"), F.lit(1).alias("series_index"), F.lit(None).cast("string").alias("rights"))
    texts = [export.css_part(c.books, font="f"), export.chapter_pages(found, c.paragraphs), export.volume_pages(found), export.nav_toc(found), export.ncx_toc(found, c.books).drop("depth"), export.opf_manifest(found, meta, "2024-01-01T00:00:00Z", True, "f")]
    cover = export.binary_part(spark.createDataFrame([("a", bytearray(b"jpg"))], "book_id string, content binary"), "cover.jpg")
    packed = export.epub_files(export.epub_parts([*texts, export.cover_pages(c.books)], [cover])).cache()
    entries = {r["name"]: r for r in export.epub_entries(packed).collect()}
    assert entries["mimetype"]["entry_no"] == 0 and entries["mimetype"]["stored"] and entries["OEBPS/cover.jpg"]["size"] == 3
    assert b'src="cover.jpg"' in bytes(entries["OEBPS/cover.xhtml"]["data"])
    opf = bytes(entries["OEBPS/content.opf"]["data"]).decode()
    assert opf.index('<itemref idref="cover"') < opf.index('<itemref idref="vol0001"') and 'href="cover.xhtml"' in opf
    data = packed.first()["epub"]
    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        opf = z.read("OEBPS/content.opf").decode()
        assert "书 &amp; 名" in opf and 'href="volume_0001.xhtml"' in opf and "group-position" in opf
        assert "正文1" in z.read("OEBPS/chapter_0001.xhtml").decode() and z.read("OEBPS/cover.jpg") == b"jpg"
        assert "风&lt;起&gt;" in z.read("OEBPS/nav.xhtml").decode()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("第一章 起\n正文1\n")
    (tmp_path / "in" / "b.txt").write_bytes(b"\xff\xff\xc0")
    seen = {}
    run = curate_stream(stream_books(spark, str(tmp_path / "in")), lambda name, df, n: seen.setdefault(name, []).extend(df.collect()), str(tmp_path / "check"))
    run.awaitTermination(120)
    assert [r["text"] for r in seen["paragraphs"]] == ["正文1"] and len(seen["quarantine"]) == 1


def test_stream_goes_on_and_sees_files_once(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def step(files_of):
        for name, text in files_of.items():
            (source / name).write_text(text)
        curate_stream(first_seen(stream_books(spark, str(source))), batch_folders(out), str(tmp_path / "check")).awaitTermination(120)
        return sorted(r["text"] for r in spark.read.parquet(f"{out}/paragraphs").collect())

    assert step({"a.txt": "第一章 起\n正文1\n"}) == ["正文1"]
    assert step({"again.txt": "第一章 起\n正文1\n", "b.txt": "第一章 起\n正文2\n"}) == ["正文1", "正文2"]
    # a batch that is tried again replaces what it wrote
    sink, rows = batch_folders(out), spark.createDataFrame([("x", 0, 0, "正文3")], spark.read.parquet(f"{out}/paragraphs").drop("batch").schema)
    sink("paragraphs", rows, 9)
    sink("paragraphs", rows, 9)
    assert sorted(r["text"] for r in spark.read.parquet(f"{out}/paragraphs").collect()) == ["正文1", "正文2", "正文3"]


def test_streamed_books_are_split_as_they_would_be_in_one_run(spark, tmp_path):
    """The last chapter has exactly 2.5 times the median: a character more in its file and it would be split."""
    size = lambda text, indent=0: indent + len(text) + 2 + len(BOILERPLATE)
    first = "a" * 100
    first += "a" * (size(first) % 2)
    last = "b" * 40 + "\nshort\n" + "c" * 40
    gap = 2 * (len("  \n\n\n\n") - 1)
    last += "c" * (size(first) * 5 // 2 - size(last) - gap)
    rows = [(2, 0, "user", first), (2, 1, "assistant", first[2:]), (2, 2, "user", last), (3, 0, "user", "d" * 50)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found, whole = (catalog.QUERIES[q](spark, str(tmp_path)) for q in ("streamed_paragraphs", "materialize_paragraphs"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.select(*found.columns).collect()))


def test_stream_takes_many_files_in_several_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(5):
        (tmp_path / "in" / f"{k}.txt").write_text(f"第一章 起\n正文{k}\n")
    seen = {}
    sink = lambda name, df, n: seen.setdefault(n, []).extend(r["text"] for r in df.collect() if name == "paragraphs")
    curate_stream(first_seen(stream_books(spark, str(tmp_path / "in"), batch_files=3)), sink, str(tmp_path / "check")).awaitTermination(120)
    assert sorted(map(len, seen.values())) == [2, 3] and sorted(sum(seen.values(), [])) == [f"正文{k}" for k in range(5)]
    assert spark.conf.get("spark.sql.files.maxPartitionNum", None) is None


def test_files_of_a_step_lie_in_one_folder(spark, tmp_path, monkeypatch):
    rows = [(b, 0, "user", f"text {b}\n") for b in range(30)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    asked = []
    monkeypatch.setattr(catalog, "stream_books", lambda spark, path: asked.append(path))
    monkeypatch.setattr(catalog, "first_seen", lambda raw: raw)
    monkeypatch.setattr(catalog, "curate_stream", lambda *args: type("Run", (), {"awaitTermination": lambda self: None})())
    with pytest.raises(AnalysisException):  # nothing was curated
        catalog.QUERIES["streamed_paragraphs"](spark, str(tmp_path))
    texts = {r["book_id"]: r["source_text"] for r in books(spark, str(tmp_path)).collect()}
    for k in range(3):
        own = list(Path(asked[0].removeprefix("file://"), f"step-{k}").iterdir())
        assert not any(x.is_dir() for x in own)
        want = [t for b, t in texts.items() if b % 3 == k or k == 1 and b % 6 == 0]
        assert sorted(x.read_text() for x in own if x.suffix == ".txt" and x.stat().st_size) == sorted(want)


def test_reading_order_is_made_once_for_a_package(spark, tmp_path):
    spark.createDataFrame([(2, 0, "user", "a text")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    plan = catalog.QUERIES["epub_files"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "_%04d.xhtml" not in plan
