"""The registered queries over the base tables, and their SQL.

Books are derived from conversations (plans.books), or are the documents themselves; a query's SQL states the same over
the common tables of plans.oracle. Scores are rounded to six digits on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chapters as C
from quillspark.operators import asking, cleaning, export, metadata, offsets, overlay, review, spans, watermark
from quillspark.operators import lines as L
from quillspark.operators import rules as R
from quillspark.plans.books import BOILERPLATE, Curation, books, document_books
from quillspark.plans.oracle import merged, sql
from quillspark.sources import encodings, files
from quillspark.streaming.curate import batch_folders, curate_stream, first_seen, stream_books
from quillspark.tables import materialize, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODIFIED = "2024-01-01T00:00:00Z"


def query(statement: str | None = None, **options):
    """Register a function of a curation run over the derived books, under its own name, with its SQL."""

    def register(f: Callable[[Curation], DataFrame]):
        source = document_books if options.get("documents") else books
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Curation(source(spark, sf_dir)))
        if statement is not None:
            SQL[f.__name__] = sql(statement, **options)
        return f

    return register


def over(table: str, statement: str | None = None):
    """Register a function of one of the given tables."""

    def register(f: Callable[[DataFrame], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if statement is not None:
            SQL[f.__name__] = statement
        return f

    return register


def _span(df: DataFrame, *more) -> DataFrame:
    return df.select("book_id", F.col("start").alias("s"), F.col("end").alias("e"), *more)


# Lines and spans


@query("SELECT book_id, line_no, line, trimmed, n_chars, byte_start, byte_end, char_start FROM lines")
def split_lines(c):
    return c.lines.drop("ended", "n_bytes")


@query("SELECT book_id, line_no, line, trimmed, n_chars, byte_start, byte_end, char_start FROM lines", documents=True)
def document_lines(c):
    return c.lines.drop("ended", "n_bytes")


@query(
    "SELECT book_id, chapter_no, heading_start, coalesce((SELECT line FROM lines l WHERE l.book_id = c.book_id AND l.byte_start = c.heading_start), '') AS heading, "
    "greatest(body_end - body_start, 0) AS body_bytes, body_end <= body_start AS body_empty FROM chapters c WHERE heading_end > heading_start"
)
def span_text(c):
    own = c.chapters.where("heading_end > heading_start")
    own = own.join(c.lines.select("book_id", F.col("byte_start").alias("heading_start"), "line"), ["book_id", "heading_start"])
    return own.select(
        "book_id", "chapter_no", "heading_start", T.span_text("line", F.lit(0), F.col("heading_end") - F.col("heading_start")).alias("heading"),
        T.span_len("body_start", "body_end").alias("body_bytes"), T.span_is_empty("body_start", "body_end").alias("body_empty"),
    )


@query("SELECT book_id, s, e, char_start AS char_s, s AS byte_again FROM marks JOIN lines l USING (book_id, line_no)")
def byte_and_char_offsets(c):
    at = c.lines.select("book_id", F.col("byte_start").alias("s"), "byte_start", "char_start", "line")
    marked = _span(c.watermarks).join(at, ["book_id", "s"])
    marked = marked.withColumn("char_s", F.col("char_start") + T.byte_to_char("line", F.col("s") - F.col("byte_start")))
    again = F.col("byte_start") + T.char_to_byte("line", F.col("char_s") - F.col("char_start"))
    return marked.select("book_id", "s", "e", "char_s", again.alias("byte_again"))


@query(
    r"SELECT book_id, line_no, byte_start, char_start AS char, char_start + length(regexp_replace(substr(source_text, 1, char_start), '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS utf16, "
    "byte_start AS byte FROM lines JOIN books USING (book_id)",
    documents=True,
)
def offsets_by_index(c):
    index = offsets.offset_index(c.books)
    found = offsets.bytes_to_chars(c.lines.select("book_id", "line_no", "byte_start"), index, "byte_start")
    return offsets.chars_to_bytes(found, index)


@query(
    "SELECT book_id, s, e, substr(source_text, greatest(char_start - 8, 0) + 1, char_start - greatest(char_start - 8, 0)) AS before_, trimmed_line AS target, "
    "substr(source_text, char_start + length(trimmed_line) + 1, 8) AS after_ FROM (SELECT m.book_id, m.s, m.e, l.char_start, l.line AS trimmed_line FROM marks m JOIN lines l USING (book_id, line_no)) JOIN books USING (book_id)"
)
def span_preview(c):
    at = c.lines.select("book_id", F.col("byte_start").alias("s"), "char_start", "n_chars")
    marked = _span(c.watermarks).join(at, ["book_id", "s"]).join(c.books.select("book_id", "source_text"), "book_id")
    seen = marked.withColumn("p", T.span_preview("source_text", "char_start", F.col("char_start") + F.col("n_chars")))
    return seen.select("book_id", "s", "e", F.col("p.before").alias("before_"), F.col("p.target").alias("target"), F.col("p.after").alias("after_"))


@query(
    "SELECT book_id, line_no, length(trimmed) <= 100 AS heading_length_ok, regexp_matches(trimmed, '^[「『“](?s:.*)[」』”]$') AS dialogue, "
    f"regexp_matches(line, '^{T.LINE_SPACE}*$') AS blank, regexp_matches(line, '{T.CONTROL}') AS has_control, length(line) AS utf16, "
    f"CASE WHEN length(line) > 0 THEN round(length(regexp_replace(line, '[^{T.CJK}]', '', 'g')) / length(line), 6) END AS cjk FROM lines"
)
def line_predicates(c):
    return c.lines.select(
        "book_id", "line_no", (F.length("trimmed") <= 100).alias("heading_length_ok"), T.is_dialogue_line("trimmed").alias("dialogue"),
        T.is_line_whitespace("line").alias("blank"), T.is_strippable_control("line").alias("has_control"), T.utf16_length("line").alias("utf16"), F.round(T.cjk_ratio("line"), 6).alias("cjk"),
    )


@over("pages", r"SELECT page_id, regexp_extract(url, '([^/]+?)(\.[^./]*)?$', 1) AS stem FROM pages")
def file_stem(pages):
    return pages.select("page_id", T.file_stem("url").alias("stem"))


@over("documents", "SELECT doc_id, substr(text, 1, 1000) AS sample FROM documents")
def sample_text(docs):
    return docs.select("doc_id", T.sample_text("text").alias("sample"))


@query(
    "SELECT book_id, length(source_text) AS n_chars, strlen(source_text) AS n_bytes, (SELECT count(*) FROM cleaning c WHERE c.book_id = b.book_id) AS n_cleaning, "
    "(SELECT count(*) FROM chapters c WHERE c.book_id = b.book_id) AS n_chapters FROM books b"
)
def book_profile(c):
    return L.book_profile(c.books, c.cleaning, c.chapters)


@over("documents", "SELECT 'book-' || doc_id AS path, 'ok' AS decode_status, text AS source_text, strlen(text) AS n_bytes, length(text) AS n_chars FROM documents WHERE text IS NOT NULL")
def decoded_books(docs):
    raw = docs.where("text is not null").select(F.concat(F.lit("book-"), "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return files.decode_books(raw).select("path", "decode_status", "source_text", "n_bytes", "n_chars")


# Files and rule sets, made from the documents


def _written(df: DataFrame, name: str) -> str:
    """Where df is written for a reader of files to find it."""
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


#: A document's label of its encoding, and the encoding its file is in.
LABEL = "CASE doc_id % 6 WHEN 0 THEN 'utf8' WHEN 1 THEN ' GBK ' WHEN 2 THEN 'cp936' WHEN 3 THEN 'klingon' WHEN 4 THEN 'unicode-1-1-utf-8' END"


@over("documents", f"SELECT doc_id, {LABEL} AS label, CASE doc_id % 6 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'GBK' WHEN 2 THEN 'GBK' WHEN 4 THEN 'UTF-8' END AS encoding, doc_id % 6 <> 3 AS label_known FROM documents")
def encoding_labels(docs):
    return files.resolve_encoding_label(docs.select("doc_id", F.expr(LABEL).alias("label")))


@over("documents", "SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 1 THEN chr(65279) || text ELSE text END) AS sha256 FROM documents WHERE text IS NOT NULL")
def stripped_marks(docs):
    raw = F.concat(F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit(""))), F.encode("text", "UTF-8"))
    marked = docs.where("text is not null").select("doc_id", raw.alias("content"), F.when(F.col("doc_id") % 2 == 0, "UTF-8").otherwise("UTF-16LE").alias("encoding"))
    return marked.select("doc_id", F.sha2(files.strip_bom(), 256).alias("sha256"))


#: Cyrillic letters that take the place of Latin ones; what stands in a document's file, in one of four encodings, where letters
#: of ISO-8859-1 have the bytes of Cyrillic ones.
CYRILLIC = "абцдефгхийклмнопярстувщызАБЦДЕФГХИЙКЛМНОПЯРСТУВЩЫЗ"
PLAIN = "abcdefghijklmnopqrstuvwyzABCDEFGHIJKLMNOPQRSTUVWYZ"


def _file_of():
    kind, narrow, ascii_ = F.col("doc_id") % 4, F.regexp_replace("text", r"[^\x00-\x7F\xA0-\xFF]", ""), F.regexp_replace("text", r"[^\x00-\x7F]", "")
    byte = lambda encoding: F.encode(F.translate(ascii_, PLAIN, CYRILLIC.encode(encoding).decode("latin-1")), "ISO-8859-1")
    return F.when(kind == 0, F.encode(narrow, "ISO-8859-1")).when(kind == 1, byte("cp1251")).when(kind == 2, byte("koi8-r")).otherwise(F.encode(narrow, "UTF-16LE"))


@over(
    "documents",
    r"""SELECT CASE doc_id % 4 WHEN 0 THEN 'windows-1252' WHEN 1 THEN 'windows-1251' WHEN 2 THEN 'KOI8-R' ELSE 'UTF-16LE' END AS encoding, count(*) AS n, true AS told
    FROM documents WHERE length(text) >= 200 AND (doc_id % 4 <> 0 OR regexp_matches(text, '[\x{C0}-\x{FF}]')) AND regexp_matches(text, '[a-wyz]') GROUP BY 1""",
)
def detected_encodings(docs):
    """Documents in four encodings, without marks or labels, told by a model of the texts themselves: whether 0.95 are, of each."""
    some = docs.where("length(text) >= 200").where((F.col("doc_id") % 4 != 0) | F.col("text").rlike(r"[\xC0-\xFF]")).where(F.col("text").rlike("[a-wyz]"))
    kind = F.when(F.col("doc_id") % 4 == 0, "windows-1252").when(F.col("doc_id") % 4 == 1, "windows-1251").when(F.col("doc_id") % 4 == 2, "KOI8-R").otherwise("UTF-16LE")
    raw = some.select(F.concat(kind, F.lit("/"), "doc_id").alias("path"), _file_of().alias("content"))
    found = files.decode_books(raw, pairs=encodings.count_pairs(some)).withColumn("encoding", F.substring_index("path", "/", 1))
    right = (F.col("source_encoding") == F.col("encoding")) & (F.col("decode_status") == "ok")
    return found.groupBy("encoding").agg(F.count("*").alias("n"), (F.count_if(right) >= 0.95 * F.count("*")).alias("told"))


def _raw(docs) -> tuple[DataFrame, DataFrame]:
    """Files of the documents, of which every seventh breaks off in a character, and the labels of some."""
    some = docs.where("text is not null").select(F.concat(F.lit("book-"), "doc_id").alias("path"), "doc_id", "text")
    broken = F.when(F.col("doc_id") % 7 == 0, F.unhex(F.lit("E4BD"))).otherwise(F.unhex(F.lit("")))
    labels = some.where("doc_id % 2 = 0 or doc_id % 7 = 0").select("path", F.when(F.col("doc_id") % 5 == 0, "klingon").otherwise("UTF-8").alias("label"))
    return some.select("path", F.concat(F.encode("text", "UTF-8"), broken).alias("content")), labels


@over(
    "documents",
    "SELECT 'book-' || doc_id AS path, CASE WHEN (doc_id % 2 = 0 OR doc_id % 7 = 0) AND doc_id % 5 = 0 THEN 'unknown_label' ELSE 'malformed' END AS decode_status, "
    "doc_id % 7 <> 0 AND NOT (doc_id % 2 = 0 AND doc_id % 5 = 0) AS good FROM documents WHERE text IS NOT NULL AND (doc_id % 7 = 0 OR doc_id % 2 = 0 AND doc_id % 5 = 0) "
    "UNION ALL SELECT 'book-' || doc_id, 'ok', true FROM documents WHERE text IS NOT NULL AND doc_id % 7 <> 0 AND NOT (doc_id % 2 = 0 AND doc_id % 5 = 0)",
)
def quarantined_books(docs):
    good, bad = files.quarantine_malformed(files.decode_books(*_raw(docs)))
    pick = lambda df, is_good: df.select("path", "decode_status", F.lit(is_good).alias("good"))
    return pick(good, True).union(pick(bad, False))


@over("documents", "SELECT lang AS folder, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY lang")
def raw_book_files(docs):
    path = _written(docs, "raw")
    docs.where("text is not null and lang is not null").select("lang", "text").write.partitionBy("lang").text(path)
    return files.read_raw_books(docs.sparkSession, path).groupBy(F.regexp_extract("path", "lang=([^/]+)/", 1).alias("folder")).agg(F.sum("length").alias("n_bytes"))


@over("labels", "SELECT 'book-' || doc_id AS book_id, quality AS start, quality + 10 AS \"end\", 'watermark' AS scope, CASE WHEN toxic = 1 THEN 'approved' ELSE 'rejected' END AS verdict FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL")
def decisions_from_json(labels):
    path = _written(labels, "decisions")
    span = F.struct(F.col("quality").cast("long").alias("start"), (F.col("quality") + 10).cast("long").alias("end"))
    item = F.struct(F.concat(F.lit("book-"), "doc_id").alias("book_id"), span.alias("span"), F.lit("watermark").alias("scope"), F.when(F.col("toxic") == 1, "approved").otherwise("rejected").alias("verdict"))
    rows = labels.where("doc_id is not null and quality is not null").select((F.col("doc_id") - F.col("doc_id") % 1000).alias("part"), item.alias("d"))
    rows.groupBy("part").agg(F.to_json(F.collect_list("d")).alias("value")).write.partitionBy("part").text(path)
    return files.read_decisions(labels.sparkSession, f"{path}/part=*")


def _rules_of(docs, keep: str) -> DataFrame:
    """A rule for each language and source of some documents; the first of German is named like a built-in one, and one in three does not compile."""
    groups = docs.where(f"lang is not null and source is not null and ({keep})").groupBy("lang", "source").agg(F.count("*").cast("int").alias("n"), F.min("doc_id").cast("int").alias("low"))
    own = F.concat_ws("-", F.lit("user"), "lang", "source")
    ordered = groups.withColumn("ord", (F.row_number().over(Window.orderBy("lang", "source")) - 1).cast("int"))
    first = (F.col("lang") == "de") & (F.col("ord") == 0)
    return ordered.select(
        F.when(first, "builtin-volume-cn-bu").otherwise(own).alias("id"), F.concat("source", F.when(F.col("n") % 3 == 0, "(").otherwise("")).alias("pattern"),
        F.when(F.col("n") % 2 == 0, "chapter").otherwise("watermark").alias("kind"), (F.col("low") % 2 == 0).alias("enabled"), F.col("n").alias("priority"),
        F.lit("user").alias("source"), F.col("lang").alias("description"), "ord",
    )


def _rules_sql(keep: str) -> str:
    return (
        "(SELECT CASE WHEN lang = 'de' AND ord = 0 THEN 'builtin-volume-cn-bu' ELSE 'user-' || lang || '-' || src END AS id, src || CASE WHEN n % 3 = 0 THEN '(' ELSE '' END AS pattern, "
        "CASE WHEN n % 2 = 0 THEN 'chapter' ELSE 'watermark' END AS kind, low % 2 = 0 AS enabled, n AS priority, 'user' AS source, lang AS description, ord FROM (SELECT lang, source AS src, "
        "CAST(count(*) AS INT) AS n, CAST(min(doc_id) AS INT) AS low, CAST(row_number() OVER (ORDER BY lang, source) - 1 AS INT) AS ord FROM documents "
        f"WHERE lang IS NOT NULL AND source IS NOT NULL AND ({keep}) GROUP BY lang, source))"
    )


RULE_FIELDS = ("pattern", "kind", "enabled", "priority", "source", "description")
OLD, NEW = "doc_id % 3 <> 0", "doc_id % 2 = 0"


def _upsert_sql(old: str, new: str) -> str:
    """SQL for a rule set with the rules of another: known ones in their places, the others behind."""
    fields = ", ".join(f"CASE WHEN n.id IS NULL THEN o.{c} ELSE n.{c} END AS {c}" for c in RULE_FIELDS)
    return f"SELECT coalesce(n.id, o.id) AS id, {fields}, CAST(coalesce(o.ord, (SELECT max(ord) FROM {old}) + 1 + n.ord) AS INT) AS ord FROM {old} o FULL JOIN {new} n ON o.id = n.id"


def _builtin_sql() -> str:
    rows = ", ".join(f"('{i}', '{p}', '{k}', true, {n}, 'builtin', '', {at})" for at, (i, p, k, n) in enumerate(R.BUILTIN))
    return f"(SELECT * FROM (VALUES {rows}) AS t(id, pattern, kind, enabled, priority, source, description, ord))"


@over("documents", _upsert_sql(_rules_sql(OLD), _rules_sql(NEW)))
def upserted_rules(docs):
    return R.upsert_rules(_rules_of(docs, OLD), _rules_of(docs, NEW))


@over("documents", _upsert_sql(_builtin_sql(), _rules_sql(NEW)))
def merged_rules(docs):
    return R.merge_rules(R.builtin_rules(docs.sparkSession), _rules_of(docs, NEW))


@over("documents", f"SELECT * FROM {_rules_sql(OLD)} WHERE id NOT IN (SELECT id FROM {_rules_sql('doc_id % 40 = 0')})")
def removed_rules(docs):
    return R.remove_rules(_rules_of(docs, OLD), _rules_of(docs, "doc_id % 40 = 0"))


@over("documents", f"SELECT * FROM {_rules_sql(OLD)} WHERE id = 'builtin-volume-cn-bu'")
def found_rule(docs):
    return R.find_rule(_rules_of(docs, OLD), "builtin-volume-cn-bu")


@over("documents", f"SELECT id FROM {_rules_sql(OLD)} WHERE contains(pattern, '(')")
def invalid_rules(docs):
    return R.validate_rules(_rules_of(docs, OLD)).select("id")


@over("documents", f"SELECT * FROM {_rules_sql(OLD)}")
def rules_from_json(docs):
    path = _written(docs, "rules")
    R.write_rules(_rules_of(docs, OLD), path)
    return R.read_rules(docs.sparkSession, path)


#: Rules of the words that documents begin with: as they are, in two ways at once inside a repeat, unclosed, and repeated.
WORD_RULE = "CASE length(id) % 4 WHEN 0 THEN id WHEN 1 THEN concat('(?:', id, '|', id, ')+$') WHEN 2 THEN concat('(', id) ELSE concat('(?:', id, ')+$') END"


@over("documents", "SELECT DISTINCT regexp_extract(text, '[A-Za-z]{3,}') AS id FROM documents WHERE length(id) % 4 IN (1, 2)")
def refused_rules(docs):
    words = docs.select(F.regexp_extract("text", "[A-Za-z]{3,}", 0).alias("id")).where("id <> ''").distinct()
    return R.validate_rules(words.select("id", F.expr(WORD_RULE).alias("pattern"))).select("id")


def match_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a thousand rules, one for each word of the benchmark, the lines of all documents match."""
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("id")).distinct()
    table = words.select("id", F.concat("id", F.lit("[.]")).alias("pattern"), F.lit("watermark").alias("kind"), F.lit(True).alias("enabled"), F.lit(1).alias("priority"), F.lit(0).alias("ord"))
    found = L.split_lines(document_books(spark, sf_dir)).select("book_id", "line_no", R.match_all_rules("trimmed", R.compiled(table, "watermark")).alias("hits"))
    return found.where(F.size("hits") > 0).select("book_id", "line_no", F.array_join(F.array_sort("hits"), " ").alias("hits"))


QUERIES["match_many_rules"] = match_many_rules
SQL["match_many_rules"] = """
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS w FROM benchmark),
l AS (SELECT doc_id AS book_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
SELECT book_id, CAST(line_no AS INT) AS line_no, string_agg(w, ' ' ORDER BY w) AS hits FROM l JOIN w ON contains(line, w || '.') GROUP BY ALL
"""


# Cleaning


@query("SELECT book_id, s, e FROM trail")
def clean_trailing_ws(c):
    return _span(cleaning.clean_trailing_ws(c.lines))


@query("SELECT book_id, s, e FROM lead_")
def clean_leading_fullwidth(c):
    return _span(cleaning.clean_leading_fullwidth(c.lines))


@query("SELECT book_id, s, e FROM inline_")
def clean_inline_fullwidth(c):
    return _span(cleaning.clean_inline_fullwidth(c.lines))


@query("SELECT book_id, s, e FROM controls")
def clean_control_chars(c):
    return _span(cleaning.clean_control_chars(c.lines))


@query("SELECT book_id, s, e, chr(10) || chr(10) AS replacement FROM blanks")
def clean_blank_runs(c):
    return _span(cleaning.clean_blank_runs(c.lines), "replacement")


@query("SELECT book_id, s, e, kind, replacement FROM cleaning")
def cleaning_annotations(c):
    return _span(c.cleaning, "kind", "replacement")


@query("SELECT book_id, kind, count(*) AS n FROM cleaning GROUP BY ALL")
def cleaning_kind_counts(c):
    return cleaning.cleaning_kind_counts(c.cleaning)


@query(
    f"SELECT book_id, md5(regexp_replace(t, '\\r?\\n(?:[ \\t　]*\\r?\\n){{2,}}', chr(10) || chr(10), 'g')) AS cleaned_md5 FROM (SELECT book_id, string_agg(CASE WHEN rest IS NULL THEN line ELSE "
    f"regexp_replace(regexp_replace(rest, '　{{2,}}', '', 'g'), '{T.CONTROL}', '', 'g') END || CASE WHEN ended THEN chr(10) ELSE '' END, '' ORDER BY line_no) AS t FROM "
    "(SELECT l.*, r.rest FROM lines l LEFT JOIN rest r USING (book_id, line_no)) GROUP BY book_id)"
)
def apply_cleaning(c):
    return cleaning.apply_cleaning(c.books, c.cleaning).select("book_id", F.md5("cleaned").alias("cleaned_md5"))


# Rules and chapters


@query("SELECT book_id, line_no, hits FROM (SELECT *, " + "{hits}" + " AS hits FROM lines) WHERE hits <> ''")
def rule_hits(c):
    found = c.lines.select("book_id", "line_no", F.array_join(R.match_all_rules("trimmed", R.compiled(c.rules, "watermark")), ", ").alias("hits"))
    return found.where("hits <> ''")


@query("SELECT book_id, s, e, level, title, rule_id FROM headings")
def heading_candidates(c):
    return _span(c.headings, "level", "title", "rule_id")


@query("SELECT book_id, s, body_start, body_end FROM bodies")
def chapter_bodies(c):
    return C.chapter_bodies(c.headings).select("book_id", F.col("start").alias("s"), "body_start", "body_end")


@query("SELECT book_id, s, level, CASE WHEN v > 0 THEN v END AS volume_no FROM bodies")
def assign_volumes(c):
    return C.assign_volumes(c.headings).select("book_id", F.col("start").alias("s"), "level", "volume_no")


@query("SELECT book_id, volume_no, title, heading_start, heading_end, origin, matched_rule_id FROM vols")
def volumes(c):
    return c.volumes


@query("SELECT book_id, title, body_end FROM unsplit WHERE origin = 'fallback' AND title = '楔子'")
def preface_chapter(c):
    return C.preface_chapter(c.lines, c.headings).select("book_id", "title", "body_end")


@query("SELECT book_id, volume_no, title, heading_end, body_start, body_end FROM unsplit WHERE origin = 'fallback' AND title = '(卷前)'")
def volume_preface(c):
    found = C.volume_preface(c.lines, C.chapter_bodies(c.headings))
    return found.select("book_id", "volume_no", "title", "heading_end", "body_start", "body_end")


@query("SELECT book_id, title, body_end FROM unsplit WHERE origin = 'fallback' AND title LIKE 'Book %'")
def fallback_chapter(c):
    return C.fallback_chapter(c.books, c.headings).select("book_id", "title", "body_end")


@query("SELECT book_id, median, n_chapters FROM medians")
def chapter_length_median(c):
    return C.chapter_length_median(c.unsplit)


@query("SELECT book_id, title, body_start, body_end, n_chars, median FROM oversized")
def oversized_chapters(c):
    return C.oversized_chapters(c.unsplit).select("book_id", "title", "body_start", "body_end", "n_chars", "median")


@query("SELECT book_id, title, heading_start, heading_end, body_start, body_end FROM chapters WHERE origin = 'structural'")
def split_oversized(c):
    pieces = C.split_oversized(C.oversized_chapters(c.unsplit), c.lines).where("origin = 'structural'")
    return pieces.select("book_id", "title", "heading_start", "heading_end", "body_start", "body_end")


@query("SELECT book_id, volume_no, chapter_no, title, heading_start, heading_end, body_start, body_end, origin, matched_rule_id FROM chapters")
def chapters(c):
    return c.chapters


@query(
    "SELECT book_id, count(*) AS n_chapters, count(*) FILTER (origin = 'fallback') AS n_fallback, count(*) FILTER (origin = 'structural') AS n_structural, "
    "(SELECT count(*) FROM vols v WHERE v.book_id = c.book_id) AS n_volumes FROM chapters c GROUP BY book_id"
)
def chapter_stats(c):
    return C.chapter_stats(c.chapters, c.volumes)


PARAGRAPHS = (
    f"(SELECT book_id, line_no, byte_start, coalesce(regexp_replace(regexp_replace(rest, '　{{2,}}', '', 'g'), '{T.CONTROL}', '', 'g'), '') AS t FROM rest r "
    "WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.verdict = 'auto' AND m.book_id = r.book_id AND m.line_no = r.line_no))"
)
PARAGRAPH_TABLE = f""",
paras AS (SELECT c.book_id, c.chapter_no, row_number() OVER (PARTITION BY c.book_id, c.chapter_no ORDER BY line_no) - 1 AS para_no, {{trim}} AS text
  FROM chapters c JOIN {PARAGRAPHS} p ON p.book_id = c.book_id AND p.byte_start >= c.body_start AND p.byte_start < c.body_end WHERE {{trim}} <> '')"""


def _paragraph_table() -> str:
    from quillspark.plans.oracle import trim

    return PARAGRAPH_TABLE.replace("{trim}", trim("p.t"))


@query("SELECT book_id, chapter_no, para_no, text FROM paras", more=_paragraph_table())
def materialize_paragraphs(c):
    return c.paragraphs


def streamed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of all books that arrive as files in three steps, the second with files of the first again, the stream started anew for each."""
    plain = books(spark, sf_dir).select("book_id", "source_text")
    root = _written(plain, "stream")
    step = F.pmod(F.col("book_id"), F.lit(3))
    for k in range(3):
        arrived = plain.where(step == k) if k != 1 else plain.where((step == 1) | (F.col("book_id") % 6 == 0))
        # a book ends with a line break, which the writer adds: a file holds its book's bytes and no more, for a character more can split a chapter
        # a step's files lie in one folder and tasks put them there, as the driver makes, lists and moves folders and files one by one
        one_each = arrived.repartition(4 * spark.sparkContext.defaultParallelism, "book_id").select(F.regexp_replace("source_text", r"\n\z", ""))
        one_each.write.options(**{"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}).text(f"{root}/in/step-{k}")
        curate_stream(first_seen(stream_books(spark, f"{root}/in")), batch_folders(f"{root}/out"), f"{root}/checkpoint").awaitTermination()
    name = plain.select(F.col("book_id").alias("own"), F.sha2("source_text", 256).alias("book_id"))
    found = spark.read.parquet(f"{root}/out/paragraphs").join(name, "book_id")
    return found.select(F.col("own").alias("book_id"), "chapter_no", "para_no", "text")


QUERIES["streamed_paragraphs"] = streamed_paragraphs
SQL["streamed_paragraphs"] = SQL["materialize_paragraphs"]


@query(
    "SELECT book_id, count(*) AS n_entries, count(*) FILTER (kind = 'volume') AS n_volumes, sum(n) AS n_chapters, string_agg(title, ' / ' ORDER BY spot) AS titles FROM ("
    "SELECT book_id, 'chapter' AS kind, title, heading_start AS spot, 1 AS n FROM chapters WHERE volume_no IS NULL UNION ALL SELECT book_id, 'volume', title, heading_start, "
    "(SELECT count(*) FROM chapters c WHERE c.book_id = v.book_id AND c.volume_no = v.volume_no) FROM vols v) GROUP BY book_id"
)
def book_tree(c):
    tree = C.book_tree(c.chapters, c.volumes)
    held = F.aggregate(F.transform("entries", lambda x: F.size(x["chapters"])), F.lit(0), lambda a, n: a + n)
    return tree.select(
        "book_id", F.size("entries").alias("n_entries"), F.size(F.filter("entries", lambda x: x["type"] == "volume")).alias("n_volumes"), held.alias("n_chapters"), F.array_join("entries.title", " / ").alias("titles")
    )


# Boilerplate


@query("SELECT book_id, heading_start AS s FROM heading_starts")
def heading_starts(c):
    return c.heading_starts.select("book_id", F.col("start").alias("s"))


@query("SELECT book_id, line_no, trimmed FROM eligible")
def eligible_lines(c):
    return watermark.eligible_lines(c.lines, c.heading_starts).select("book_id", "line_no", "trimmed")


@query("SELECT book_id, line_no, repeats FROM counted")
def line_frequency(c):
    return watermark.line_frequency(watermark.eligible_lines(c.lines, c.heading_starts)).select("book_id", "line_no", "repeats")


SIGNALS = (
    "SELECT book_id, line_no, repeats, hits, round(non_cjk, 6) AS non_cjk, round(s_repeat, 6) AS s_repeat, round(s_non_cjk, 6) AS s_non_cjk, CAST(s_keyword AS DOUBLE) AS s_keyword, round(score, 6) AS score FROM scored"
)


def _signals(c, headings):
    found = watermark.line_signals(watermark.eligible_lines(c.lines, headings), c.rules)
    digits = [F.round(n, 6).alias(n) for n in ("non_cjk", "s_repeat", "s_non_cjk", "s_keyword", "score")]
    return found.select("book_id", "line_no", "repeats", F.array_join("hits", ", ").alias("hits"), *digits)


@query(SIGNALS)
def line_signals(c):
    return _signals(c, c.heading_starts)


@query(SIGNALS, documents=True)
def document_signals(c):
    return _signals(c, c.heading_starts)


WATERMARKS = (
    "SELECT book_id, s, e, verdict, round(score, 6) AS score, array_to_string(list_filter([CASE WHEN s_repeat IS NOT NULL THEN '出现 ' || repeats || ' 次' END, "
    "CASE WHEN s_non_cjk IS NOT NULL THEN CAST(floor(non_cjk * 100 + 0.5) AS INT) || '% 非中文字符' END, CASE WHEN s_keyword IS NOT NULL THEN '命中规则 ' || hits END], lambda x: x IS NOT NULL), '; ') AS details FROM marks"
)


def _watermarks(c):
    return _span(c.watermarks, "verdict", F.round("score", 6).alias("score"), F.array_join("signals.detail", "; ").alias("details"))


@query(WATERMARKS)
def watermarks(c):
    return _watermarks(c)


@query(WATERMARKS, documents=True)
def document_watermarks(c):
    return _watermarks(c)


COUNTS = "SELECT book_id, count(*) FILTER (verdict = 'auto') AS n_auto, count(*) FILTER (verdict = 'suspect') AS n_suspect, count(*) AS n FROM marks GROUP BY book_id"


@query(COUNTS)
def watermark_counts(c):
    return watermark.watermark_counts(c.watermarks)


@query(COUNTS, documents=True)
def document_watermark_counts(c):
    return watermark.watermark_counts(c.watermarks)


@query("SELECT book_id, s, e FROM marks WHERE verdict = 'suspect'")
def filter_verdict(c):
    return _span(watermark.filter_verdict(c.watermarks, "suspect"))


@query("SELECT book_id, s, e, verdict, kind FROM mirrors")
def signal_to_kind(c):
    return _span(c.watermarks, "verdict", watermark.signal_to_kind().alias("kind"))


@query("SELECT book_id, s, e, kind, replacement FROM merged", source="(SELECT * FROM found UNION ALL SELECT book_id, s, e, kind, replacement FROM mirrors)")
def merge_spans(c):
    every = cleaning.clean_trailing_ws(c.lines)
    for find in (cleaning.clean_leading_fullwidth, cleaning.clean_inline_fullwidth, cleaning.clean_control_chars, cleaning.clean_blank_runs):
        every = every.unionByName(find(c.lines))
    marks = c.watermarks.select("book_id", "start", "end", watermark.signal_to_kind().alias("kind"), F.lit(None).cast("string").alias("replacement"))
    return _span(spans.merge_spans(every.unionByName(marks)), "kind", "replacement")


@query("SELECT book_id, s, e, kind, replacement FROM merged")
def merge_auto_into_cleaning(c):
    return _span(c.merged, "kind", "replacement")


@query(
    "SELECT m.book_id, m.s, m.e, m.kind, c.chapter_no FROM merged m LEFT JOIN chapters c ON c.book_id = m.book_id AND c.body_start < c.body_end AND m.s >= c.body_start AND m.s < c.body_end AND m.e <= c.body_end"
)
def assign_to_chapters(c):
    ranges = c.chapters.where("body_end > body_start").select("book_id", F.col("body_start").alias("start"), F.col("body_end").alias("end"), "chapter_no")
    found = spans.assign_to_ranges(c.merged, ranges, ["chapter_no"])
    own = F.when((F.col("start") < F.col("range_end")) & (F.col("end") <= F.col("range_end")), F.col("chapter_no"))
    return _span(found, "kind", own.alias("chapter_no"))


# Review


def _decisions(c) -> DataFrame:
    """Decisions by rule: every third suspect or auto line each way, every fourth cleaning row rejected."""
    w = c.watermarks.select("book_id", "start", "end", F.lit("watermark").alias("scope"), F.when(F.col("start") % 3 == 0, "rejected").when(F.col("start") % 3 == 1, "approved").alias("verdict"))
    k = c.cleaning.select("book_id", "start", "end", F.lit("cleaning").alias("scope"), F.when(F.col("start") % 4 == 0, "rejected").alias("verdict"))
    return w.union(k).where("verdict is not null")


DECIDED = """,
decisions AS (SELECT book_id, s, e, 'watermark' AS scope, CASE s % 3 WHEN 0 THEN 'rejected' ELSE 'approved' END AS verdict FROM marks WHERE s % 3 < 2
  UNION ALL SELECT book_id, s, e, 'cleaning', 'rejected' FROM cleaning WHERE s % 4 = 0),
base_merge AS (SELECT * FROM to_merge),"""
KEPT = """
kept AS (SELECT * FROM first_merged c WHERE NOT EXISTS (SELECT 1 FROM decisions d WHERE d.book_id = c.book_id AND d.s = c.s AND d.e = c.e AND d.verdict = 'rejected'
    AND d.scope = CASE WHEN c.kind LIKE 'watermark%' THEN 'watermark' ELSE 'cleaning' END)
  UNION ALL SELECT m.book_id, m.s, m.e, m.kind, NULL FROM mirrors m JOIN decisions d ON d.book_id = m.book_id AND d.s = m.s AND d.e = m.e AND d.scope = 'watermark' AND d.verdict = 'approved' WHERE m.verdict = 'suspect')"""
FIRST_MERGED = merged("base_merge").replace("m1 AS", "f1 AS").replace("m2 AS", "f2 AS").replace("FROM m1", "FROM f1").replace("FROM m2", "FROM f2").replace("merged AS", "first_merged AS").lstrip(",") + ","


@query("SELECT book_id, s, e, kind, replacement FROM merged", source="kept", more=DECIDED + FIRST_MERGED + KEPT)
def apply_decisions(c):
    return _span(review.apply_decisions(c.merged, c.watermarks, _decisions(c)), "kind", "replacement")


@query(
    "SELECT book_id, s, e, scope, verdict FROM decisions d WHERE NOT (scope = 'watermark' AND EXISTS (SELECT 1 FROM marks m WHERE m.verdict = 'suspect' AND m.book_id = d.book_id AND m.s = d.s AND m.e = d.e)) "
    "UNION ALL SELECT book_id, s, e, 'watermark', 'approved' FROM marks WHERE verdict = 'suspect'",
    more=DECIDED.rstrip(","),
)
def bulk_decide(c):
    return _span(review.bulk_decide(_decisions(c), watermark.filter_verdict(c.watermarks, "suspect"), "watermark", "approved"), "scope", "verdict")


@query(
    "SELECT book_id, s, e, scope, verdict FROM decisions d WHERE NOT (scope = 'watermark' AND EXISTS (SELECT 1 FROM marks m WHERE m.verdict = 'auto' AND m.book_id = d.book_id AND m.s = d.s AND m.e = d.e))",
    more=DECIDED.rstrip(","),
)
def clear_decisions(c):
    return _span(review.clear_decisions(_decisions(c), watermark.filter_verdict(c.watermarks, "auto"), "watermark"), "scope", "verdict")


_IS = "EXISTS (SELECT 1 FROM decisions d WHERE d.book_id = x.book_id AND d.s = x.s AND d.e = x.e AND d.scope = '{}' AND d.verdict = '{}')"


LAYERS = (
    f"SELECT book_id, s, e, 'removed' AS layer FROM cleaning x WHERE NOT {_IS.format('cleaning', 'rejected')} "
    f"UNION ALL SELECT book_id, s, e, 'removed' FROM marks x WHERE verdict = 'suspect' AND {_IS.format('watermark', 'approved')} "
    f"UNION ALL SELECT book_id, s, e, 'auto' FROM marks x WHERE verdict = 'auto' AND NOT {_IS.format('watermark', 'rejected')} "
    f"UNION ALL SELECT book_id, s, e, 'suspect' FROM marks x WHERE verdict = 'suspect' AND NOT {_IS.format('watermark', 'approved')} AND NOT {_IS.format('watermark', 'rejected')}"
)


@query(LAYERS, more=DECIDED.rstrip(","))
def effective_layers(c):
    return _span(review.effective_layers(c.cleaning, c.watermarks, _decisions(c)), "layer")


CANDIDATES = """,
cands AS (SELECT m.book_id, m.s, m.e, m.trimmed AS text,
    (SELECT max_by(l.trimmed, l.line_no) FROM lines l WHERE l.book_id = m.book_id AND l.line_no < m.line_no AND l.trimmed <> '') AS context_before,
    (SELECT min_by(l.trimmed, l.line_no) FROM lines l WHERE l.book_id = m.book_id AND l.line_no > m.line_no AND l.trimmed <> '') AS context_after
  FROM marks m WHERE verdict = 'suspect'),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY book_id ORDER BY s) - 1) // 2 AS batch, (row_number() OVER (PARTITION BY book_id ORDER BY s) - 1) % 2 + 1 AS i FROM cands)"""


@query("SELECT book_id, s, e, text, context_before, context_after FROM cands", more=CANDIDATES)
def llm_candidates(c):
    return _span(review.llm_candidates(c.lines, c.watermarks), "text", "context_before", "context_after")


@query("SELECT book_id, s, e, text, context_before, context_after FROM cands", more=CANDIDATES, documents=True)
def document_llm_candidates(c):
    return _span(review.llm_candidates(c.lines, c.watermarks), "text", "context_before", "context_after")


@query("SELECT book_id, batch, count(*) AS n, string_agg(i || '. ' || text, chr(10) ORDER BY i) AS prompt FROM numbered GROUP BY book_id, batch", more=CANDIDATES)
def number_candidates(c):
    return review.number_candidates(review.llm_candidates(c.lines, c.watermarks), 2)


def _replies(c) -> tuple[DataFrame, DataFrame]:
    """Batches, and replies by rule: one line says boilerplate with a reason or without, or content, by book."""
    batches = review.number_candidates(review.llm_candidates(c.lines, c.watermarks), 2)
    line = F.when(F.col("book_id") % 3 == 0, "1. 水印: 含推广链接").when(F.col("book_id") % 3 == 1, "1. 水印").otherwise("1. 正文: 叙述")
    return batches, batches.select("book_id", "batch", F.concat(line, F.lit("\n\n2. ???\n3. 水印")).alias("reply"))


VERDICTS = """,
verdicts AS (SELECT book_id, batch, i, s, e, CASE WHEN i = 2 THEN 'uncertain' WHEN book_id % 3 = 2 THEN 'is_content' ELSE 'is_watermark' END AS verdict,
    CASE WHEN i = 2 OR book_id % 3 = 2 THEN NULL WHEN book_id % 3 = 0 THEN '含推广链接' ELSE 'LLM 判定为水印' END AS reason FROM numbered)"""


@query("SELECT book_id, batch, i, verdict, reason FROM verdicts", more=CANDIDATES + VERDICTS)
def parse_verdict_lines(c):
    return review.parse_verdict_lines(*_replies(c))


@query("SELECT book_id, verdict, count(*) AS n FROM verdicts GROUP BY ALL", more=CANDIDATES + VERDICTS)
def verdict_counts(c):
    return review.verdict_counts(review.parse_verdict_lines(*_replies(c)))


def _verdict_spans(c) -> DataFrame:
    """Verdicts with the spans of their candidates."""
    from pyspark.sql import Window

    found = review.llm_candidates(c.lines, c.watermarks)
    at = F.row_number().over(Window.partitionBy("book_id").orderBy("start")) - 1
    placed = found.select("book_id", "start", "end", F.floor(at / 2).alias("batch"), (at % 2 + 1).alias("i"))
    return placed.join(review.parse_verdict_lines(*_replies(c)), ["book_id", "batch", "i"])


@query(
    "SELECT m.book_id, m.s, m.e, CASE WHEN v.verdict = 'is_watermark' THEN 'auto' ELSE m.verdict END AS verdict, "
    "CASE WHEN v.verdict = 'is_watermark' THEN v.reason ELSE '' END AS reason FROM marks m LEFT JOIN verdicts v USING (book_id, s, e)",
    more=CANDIDATES + VERDICTS,
)
def apply_verdicts(c):
    found = review.apply_verdicts(c.watermarks, _verdict_spans(c))
    own = F.filter("signals", lambda s: s["kind"] == "llm_adjudication")
    return _span(found, "verdict", F.array_join(own["detail"], ", ").alias("reason"))


@query(
    "SELECT book_id, s, e, kind, replacement FROM merged", source="upgraded",
    more=CANDIDATES + VERDICTS + ",\nupgraded AS (SELECT * FROM to_merge UNION ALL SELECT book_id, s, e, 'watermark_keyword', NULL FROM verdicts WHERE verdict = 'is_watermark')",
)
def upgraded_cleaning(c):
    return _span(review.upgraded_cleaning(c.merged, c.watermarks, _verdict_spans(c)), "kind", "replacement")


@query(
    "SELECT book_id, count(*) AS n, string_agg(trimmed, chr(10) ORDER BY s) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY s) AS i FROM marks WHERE s % 3 = 0) WHERE i <= 10 GROUP BY book_id"
)
def induction_samples(c):
    return review.induction_samples(c.lines, _decisions(c))


@query(
    "SELECT DISTINCT 'llm-' || substr(sha256(pattern), 1, 12) AS id, pattern, 50 AS priority FROM (SELECT regexp_extract(trimmed, '[A-Za-z]+', 0) AS pattern FROM marks WHERE s % 3 = 0) WHERE pattern <> ''"
)
def induced_rule(c):
    rejected = _decisions(c).where("scope = 'watermark' and verdict = 'rejected'")
    text = c.lines.select("book_id", F.col("byte_start").alias("start"), F.col("byte_end").alias("end"), "trimmed")
    reply = text.join(rejected, ["book_id", "start", "end"]).select(F.regexp_extract("trimmed", "[A-Za-z]+", 0).alias("pattern"))
    return review.induced_rule(reply).select("id", "pattern", "priority")


#: What rules a model has made up: a word, one without its end, or one twice in a repeat, which takes exponential time.
INDUCED = "CASE length({w}) % 3 WHEN 0 THEN {w} WHEN 1 THEN '(' || {w} ELSE '(' || {w} || '|' || {w} || ')+$' END"


@query(
    "SELECT DISTINCT 'llm-' || substr(sha256(pattern), 1, 12) AS id, pattern, 'llm_generated' AS source FROM (SELECT regexp_extract(trimmed, '[A-Za-z]+', 0) AS pattern FROM marks WHERE s % 3 = 0) "
    f"WHERE pattern <> '' AND length(pattern) % 3 = 0 UNION ALL SELECT id, pattern, source FROM {_builtin_sql()}"
)
def learned_rules(c):
    """The built-in rules with those of replies that can be used."""
    rejected = _decisions(c).where("scope = 'watermark' and verdict = 'rejected'")
    text = c.lines.select("book_id", F.col("byte_start").alias("start"), F.col("byte_end").alias("end"), "trimmed")
    words = text.join(rejected, ["book_id", "start", "end"]).select(F.regexp_extract("trimmed", "[A-Za-z]+", 0).alias("w")).where("w <> ''")
    induced = R.usable_rules(review.induced_rule(words.select(F.expr(INDUCED.format(w="w")).alias("pattern"))))
    placed = induced.withColumn("ord", (F.row_number().over(Window.orderBy("id")) - 1).cast("int"))
    return R.merge_rules(c.rules, placed).select("id", "pattern", "source")


def _odd_lines_are_content(requests: list[str]) -> list[str]:
    """A stand-in for a model: a candidate of an even number of characters is boilerplate."""
    told = lambda row: "水印: 偶数" if len(row.split(". ", 1)[1]) % 2 == 0 else "正文"
    return ["\n".join(f"{i}. {told(row)}" for i, row in enumerate(r.split("\n"), 1)) for r in requests]


@query(
    "SELECT book_id, batch, i, CASE WHEN length(text) % 2 = 0 THEN 'is_watermark' ELSE 'is_content' END AS verdict, CASE WHEN length(text) % 2 = 0 THEN '偶数' END AS reason FROM numbered",
    more=CANDIDATES,
)
def asked_verdicts(c):
    """Verdicts of a stand-in for a model, asked in two waves; the replies are those of the log, of a second run that asks no one."""
    batches = review.number_candidates(review.llm_candidates(c.lines, c.watermarks), 2)
    requests, log = batches.withColumnRenamed("prompt", "request"), _written(c.books, "replies")
    asking.ask(requests, log, _odd_lines_are_content, waves=2)
    return review.parse_verdict_lines(batches, asking.ask(requests, log))


# Metadata


def _first_words(c) -> DataFrame:
    """Suggestions as JSON by rule: in a fence for even books, with fields that say nothing."""
    word = F.regexp_extract("source_text", "([A-Za-z]{3,})", 1)
    body = F.concat(
        F.lit('{"title": "'), "title", F.lit('", "author": "'), F.when(F.col("book_id") % 3 == 0, "未知").otherwise(word), F.lit('", "subjects": "a, b，'), word,
        F.lit('、 未知", "series": null, "series_index": "'), F.when(F.col("book_id") % 2 == 0, F.col("book_id").cast("string")).otherwise("x"), F.lit('"}'),
    )
    raw = F.when(F.col("book_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("book_id") % 5 == 0, "no json").otherwise(body)
    return c.books.select("book_id", raw.alias("raw"))


META = """,
words AS (SELECT book_id, title, regexp_extract(source_text, '([A-Za-z]{3,})', 1) AS word, book_id % 2 <> 0 AND book_id % 5 = 0 AS bad FROM books),
meta AS (SELECT book_id, CASE WHEN NOT bad THEN title END AS title, CASE WHEN NOT bad AND book_id % 3 <> 0 AND word <> '' THEN word END AS author,
    CASE WHEN bad THEN '' WHEN word = '' OR word IN ('a', 'b') THEN 'a;b' ELSE 'a;b;' || word END AS subjects, CASE WHEN NOT bad AND book_id % 2 = 0 THEN CAST(book_id AS INT) END AS series_index FROM words)"""


@query("SELECT book_id, title, author, subjects, series_index, true AS needs_fillin, title IS NULL AS is_empty FROM meta", more=META)
def parse_metadata_json(c):
    m = metadata.parse_metadata_json(_first_words(c))
    return m.select("book_id", "title", "author", F.array_join("subjects", ";").alias("subjects"), "series_index", metadata.metadata_needs_fillin().alias("needs_fillin"), metadata.metadata_is_empty().alias("is_empty"))


def _second(c) -> DataFrame:
    return c.books.select(
        "book_id", F.concat(F.lit("Second "), "book_id").alias("title"), F.lit("Anon").alias("author"), F.lit("told").alias("description"), F.lit(None).cast("string").alias("cover_keywords"),
        F.array(F.lit("z")).alias("subjects"), F.lit("S").alias("series"), F.lit(7).alias("series_index"),
    )


@query(
    "SELECT book_id, coalesce(title, 'Second ' || book_id) AS title, coalesce(author, 'Anon') AS author, 'told' AS description, CASE WHEN subjects = '' THEN 'z' ELSE subjects END AS subjects, 'S' AS series, coalesce(series_index, 7) AS series_index FROM meta",
    more=META,
)
def fill_metadata(c):
    m = metadata.fill_metadata(metadata.parse_metadata_json(_first_words(c)), _second(c))
    return m.select("book_id", "title", "author", "description", F.array_join("subjects", ";").alias("subjects"), "series", "series_index")


def _overlaid(c) -> DataFrame:
    """Books' metadata with a user's values over it, by rule."""
    null = F.lit(None).cast("string")
    base = c.books.select("book_id", "title", F.lit("Anon").alias("author"), null.alias("description"), F.lit("zh-CN").alias("language"), F.array(F.lit("a"), F.lit("b & c")).alias("subjects"), null.alias("series"), F.lit(None).cast("int").alias("series_index"), null.alias("rights"))
    user = c.books.select(
        "book_id", F.when(F.col("book_id") % 2 == 0, F.concat(F.lit(" <New> "), "book_id")).otherwise("  ").alias("title"), null.alias("author"), F.lit("told").alias("description"), null.alias("language"),
        F.array().cast("array<string>").alias("subjects"), F.when(F.col("book_id") % 3 == 0, "S").alias("series"), F.lit(4).alias("series_index"), null.alias("rights"),
    )
    return metadata.overlay_metadata(base, user)


@query(
    "SELECT book_id, CASE WHEN book_id % 2 = 0 THEN '<New> ' || book_id ELSE title END AS title, 'Anon' AS author, 'told' AS description, 'a;b & c' AS subjects, CASE WHEN book_id % 3 = 0 THEN 'S' END AS series, CASE WHEN book_id % 3 = 0 THEN 4 END AS series_index FROM books"
)
def overlay_metadata(c):
    m = _overlaid(c)
    return m.select("book_id", "title", "author", "description", F.array_join("subjects", ";").alias("subjects"), "series", "series_index")


@query("SELECT book_id, trim(CASE WHEN book_id % 2 = 0 THEN '《' || title || '》精校版' ELSE '' END || '') AS t, CASE WHEN book_id % 2 = 0 THEN title ELSE 'file ' || book_id END || ' 网络小说 作者 简介' AS phrase FROM books")
def search_query(c):
    named = c.books.select("book_id", F.when(F.col("book_id") % 2 == 0, F.concat(F.lit("《"), "title", F.lit("》精校版"))).otherwise("").alias("t"), F.concat(F.lit("file "), "book_id").alias("file_stem"))
    return named.select("book_id", "t", metadata.search_query("t", "file_stem").alias("phrase"))


@over(
    "pages",
    "SELECT book_id, count(*) AS n, string_agg(i || '. 标题:' || coalesce(substr(regexp_extract(html, '<title>([^<]*)', 1), 1, 40), '') || chr(10) || '   URL:' || url || chr(10) || '   摘要:' || length(coalesce(html, '')), chr(10) ORDER BY i) AS context FROM (SELECT *, regexp_extract(url, '//([^/?#]+)', 1) AS book_id, "
    "row_number() OVER (PARTITION BY regexp_extract(url, '//([^/?#]+)', 1) ORDER BY page_id) AS i FROM pages) WHERE i <= 5 GROUP BY book_id",
)
def search_context(pages):
    rows = pages.select(F.regexp_extract("url", "//([^/?#]+)", 1).alias("book_id"), F.col("page_id").alias("rank"), F.substring(F.regexp_extract("html", "<title>([^<]*)", 1), 1, 40).alias("title"), "url", F.length(F.coalesce("html", F.lit(""))).cast("string").alias("snippet"))
    return metadata.search_context(rows)


@query(
    "SELECT book_id, coalesce(nullif(concat_ws(chr(10), '- 已知书名:' || title, '- 已知作者:' || author, CASE WHEN subjects <> '' THEN '- 已知分类:' || replace(subjects, ';', '、') END), ''), '(尚无任何已知字段)') AS known FROM meta",
    more=META,
)
def known_fields(c):
    return metadata.parse_metadata_json(_first_words(c)).select("book_id", metadata.known_fields().alias("known"))


@over(
    "documents",
    "SELECT doc_id, array_to_string(list_filter(xs, lambda x, i: x <> '' AND list_position(xs, x) = i), '|') AS subjects FROM (SELECT doc_id, list_transform(string_split_regex(coalesce(text, ''), '[,，、;；]'), lambda x: trim(x)) AS xs FROM documents)",
)
def normalize_subjects(docs):
    return metadata.normalize_subjects(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("subjects_text"))).select("doc_id", F.array_join("subjects", "|").alias("subjects"))


# Export and overlays

ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
SECTIONS = """,
sect0 AS (SELECT book_id, 'chapter' AS kind, title, volume_no, chapter_no, body_start AS spot, 1 AS tie FROM chapters UNION ALL SELECT book_id, 'volume', title, volume_no, NULL, heading_end, 0 FROM vols),
sect1 AS (SELECT *, row_number() OVER w AS seq, count(*) FILTER (kind = 'volume') OVER (PARTITION BY book_id ORDER BY spot, tie, chapter_no ROWS UNBOUNDED PRECEDING) AS n FROM sect0 WINDOW w AS (PARTITION BY book_id ORDER BY spot, tie, chapter_no)),
sects AS (SELECT book_id, seq, kind, title, volume_no, chapter_no, printf('%s_%04d.xhtml', kind, CASE kind WHEN 'volume' THEN n ELSE seq - n END) AS href,
    CASE kind WHEN 'volume' THEN 'vol' ELSE 'ch' END || printf('%04d', CASE kind WHEN 'volume' THEN n ELSE seq - n END) AS id FROM sect1)"""


@query("SELECT book_id, seq, kind, href, id, title FROM sects", more=SECTIONS)
def sections(c):
    return export.sections(c.chapters, c.volumes).select("book_id", "seq", "kind", "href", "id", "title")


@query(
    f"SELECT book_id, href, '<h1 class=\"{export.CHAPTER_CLASS}\">' || {ESC.format('title')} || '</h1>' || chr(10) || coalesce((SELECT string_agg('<p>' || {ESC.format('text')} || '</p>' || chr(10), '' ORDER BY para_no) FROM paras p WHERE p.book_id = s.book_id AND p.chapter_no = s.chapter_no), '') AS body FROM sects s WHERE kind = 'chapter'",
    more=SECTIONS + _paragraph_table(),
)
def chapter_pages(c):
    pages = export.chapter_pages(export.sections(c.chapters, c.volumes), c.paragraphs)
    return pages.select("book_id", "href", F.regexp_extract("content", r"(?s)<body>\n(.*)</body>", 1).alias("body"))


@query(f"SELECT book_id, href, '<h1 class=\"{export.VOLUME_CLASS}\">' || {ESC.format('title')} || '</h1>' || chr(10) AS body FROM sects WHERE kind = 'volume'", more=SECTIONS)
def volume_pages(c):
    pages = export.volume_pages(export.sections(c.chapters, c.volumes))
    return pages.select("book_id", "href", F.regexp_extract("content", r"(?s)<body>\n(.*)</body>", 1).alias("body"))


@query("SELECT book_id, string_agg(href, ',' ORDER BY seq) AS hrefs, count(*) FILTER (kind = 'chapter' AND volume_no IS NOT NULL) AS nested FROM sects GROUP BY book_id", more=SECTIONS)
def nav_toc(c):
    nav = export.nav_toc(export.sections(c.chapters, c.volumes))
    inner = F.array_join(F.regexp_extract_all("content", F.lit(r"(?s)<ol>\n((?:<li><a [^\n]*</li>\n)+)</ol>\n</li>"), F.lit(1)), "")
    return nav.select("book_id", F.array_join(F.regexp_extract_all("content", F.lit('<a href="([^"]*)"'), F.lit(1)), ",").alias("hrefs"), F.regexp_count(inner, F.lit("<li>")).alias("nested"))


@query(
    "SELECT book_id, string_agg(seq || ':' || href, ',' ORDER BY seq) AS points, CASE WHEN count(*) FILTER (kind = 'chapter' AND volume_no IS NOT NULL) > 0 THEN 2 ELSE 1 END AS depth FROM sects GROUP BY book_id",
    more=SECTIONS,
)
def ncx_toc(c):
    ncx = export.ncx_toc(export.sections(c.chapters, c.volumes), c.books)
    order = F.regexp_extract_all("content", F.lit('playOrder="([0-9]+)"'), F.lit(1))
    href = F.regexp_extract_all("content", F.lit('<content src="([^"]*)"'), F.lit(1))
    return ncx.select("book_id", F.array_join(F.zip_with(order, href, lambda a, b: F.concat(a, F.lit(":"), b)), ",").alias("points"), "depth")


@query(
    f"SELECT s.book_id, 'cover=cover.xhtml,' || string_agg(id || '=' || href, ',' ORDER BY seq) AS items, 'cover,' || string_agg(id, ',' ORDER BY seq) AS spine, any_value({ESC.format('CASE WHEN s.book_id % 2 = 0 THEN ' + chr(39) + '<New> ' + chr(39) + ' || s.book_id ELSE b.title END')}) AS title, any_value(CASE WHEN s.book_id % 3 = 0 THEN 4 END) AS series_index FROM sects s JOIN books b USING (book_id) GROUP BY s.book_id",
    more=SECTIONS,
)
def opf_manifest(c):
    opf = export.opf_manifest(export.sections(c.chapters, c.volumes), _overlaid(c), MODIFIED, has_cover=True)
    pair = lambda p, n: F.regexp_extract_all("content", F.lit(p), F.lit(n))
    items = r'<item id="((?:ch|vol)[0-9]+|cover)" href="([^"]*)"'
    return opf.select(
        "book_id", F.array_join(F.zip_with(pair(items, 1), pair(items, 2), lambda a, b: F.concat(a, F.lit("="), b)), ",").alias("items"), F.array_join(pair('<itemref idref="([^"]*)"', 1), ",").alias("spine"),
        F.regexp_extract("content", "<dc:title>([^<]*)</dc:title>", 1).alias("title"), F.expr("try_cast(regexp_extract(content, 'group-position\">([0-9]+)<', 1) as int)").alias("series_index"),
    )


def _parts(c) -> DataFrame:
    sections_ = materialize(export.sections(c.chapters, c.volumes))  # five kinds of parts read it
    texts = [export.css_part(c.books), export.chapter_pages(sections_, c.paragraphs), export.volume_pages(sections_), export.nav_toc(sections_)]
    texts += [export.ncx_toc(sections_, c.books).drop("depth"), export.opf_manifest(sections_, _overlaid(c), MODIFIED)]
    return export.epub_parts(texts)


@query("SELECT book_id, count(*) + 5 AS n_parts FROM sects GROUP BY book_id", more=SECTIONS)
def epub_parts(c):
    return _parts(c).groupBy("book_id").agg(F.count("*").alias("n_parts"))


@query()
def epub_files(c):
    return export.epub_files(_parts(c)).select("book_id", F.length("epub").alias("n_bytes"), F.sha2("epub", 256).alias("sha256"))


@query(
    "SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY name <> 'mimetype', name) - 1 AS entry_no, name, name = 'mimetype' AS stored FROM (SELECT book_id, 'OEBPS/' || href AS name FROM sects "
    "UNION ALL SELECT DISTINCT book_id, unnest(['mimetype', 'META-INF/container.xml', 'OEBPS/styles.css', 'OEBPS/nav.xhtml', 'OEBPS/toc.ncx', 'OEBPS/content.opf']) FROM sects)",
    more=SECTIONS,
)
def epub_entries(c):
    return export.epub_entries(export.epub_files(_parts(c))).select("book_id", "entry_no", "name", "stored")


@query(
    "SELECT book_id, layer, CAST(floor(s / total * 200) AS BIGINT) AS bucket, count(*) AS n, max(greatest(2, CAST(ceil((e - s) / total * 200) AS BIGINT))) AS longest FROM (SELECT book_id, s, e, CASE WHEN kind LIKE 'watermark%' THEN 'auto' ELSE 'format' END AS layer, strlen(source_text) AS total FROM merged JOIN books USING (book_id)) GROUP BY ALL"
)
def density_ruler(c):
    layer = F.when(T.is_watermark_kind("kind"), "auto").otherwise("format")
    return overlay.density_ruler(c.merged.withColumn("layer", layer), c.books)


@query(
    "SELECT l.book_id, l.line_no, coalesce(m.verdict, '') AS layer, l.line AS text FROM lines l LEFT JOIN marks m USING (book_id, line_no)"
)
def highlight_lines(c):
    layers = c.watermarks.select("book_id", "start", "end", F.col("verdict").alias("layer"))
    return overlay.highlight_segments(c.lines, layers).select("book_id", "line_no", F.coalesce("layer", F.lit("")).alias("layer"), "text")


#: Spans cut to lines and numbered by start, the longer first; which one is taken after each; those taken; and the gaps around them.
SEGMENTS = f""",
layers AS ({LAYERS}),
pieces AS (SELECT *, row_number() OVER (PARTITION BY book_id, line_no ORDER BY s, e DESC, layer) AS i FROM (
  SELECT l.book_id, l.line_no, greatest(x.s, l.byte_start) - l.byte_start AS s, least(x.e, l.byte_end) - l.byte_start AS e, x.layer
  FROM lines l JOIN layers x ON x.book_id = l.book_id AND least(x.e, l.byte_end) > greatest(x.s, l.byte_start))),
follows AS (SELECT p.book_id, p.line_no, p.i, min(q.i) AS after FROM pieces p JOIN pieces q ON q.book_id = p.book_id AND q.line_no = p.line_no AND q.i > p.i AND q.s >= p.e GROUP BY ALL),
taken AS (SELECT book_id, line_no, i FROM pieces WHERE i = 1 UNION ALL SELECT t.book_id, t.line_no, f.after FROM taken t JOIN follows f ON f.book_id = t.book_id AND f.line_no = t.line_no AND f.i = t.i),
chosen AS (SELECT p.*, coalesce(lag(e) OVER (PARTITION BY book_id, line_no ORDER BY i), 0) AS last FROM pieces p JOIN taken t USING (book_id, line_no, i)),
segments AS (
  SELECT book_id, line_no, s, e, layer FROM chosen UNION ALL SELECT book_id, line_no, last, s, NULL FROM chosen WHERE s > last
  UNION ALL SELECT book_id, line_no, at_, size, NULL FROM (SELECT l.book_id, l.line_no, strlen(l.line) AS size, coalesce((SELECT max(e) FROM chosen c WHERE c.book_id = l.book_id AND c.line_no = l.line_no), 0) AS at_ FROM lines l)
  WHERE at_ < size OR size = 0)"""


@query(
    "SELECT book_id, line_no, row_number() OVER (PARTITION BY book_id, line_no ORDER BY s) - 1 AS seg_no, decode(encode(line)[s + 1:e]) AS text, layer FROM segments JOIN lines USING (book_id, line_no)",
    more=DECIDED.rstrip(",") + SEGMENTS, recursive=True,
)
def highlight_segments(c):
    return overlay.highlight_segments(c.lines, _decided_layers(c))


def _decided_layers(c) -> DataFrame:
    return review.effective_layers(c.cleaning, c.watermarks, _decisions(c))


@query()
def pipeline_output(c):
    """One document per book: its text, spans, and tree."""
    pick = lambda df, *more: df.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", *more))).alias("xs"))
    held = c.books.select("book_id", "title", "source_text")
    held = held.join(pick(c.merged, "kind", "replacement").withColumnRenamed("xs", "cleaning"), "book_id", "left")
    held = held.join(pick(c.watermarks, "verdict", "score", "signals").withColumnRenamed("xs", "watermark"), "book_id", "left")
    held = held.join(C.book_tree(c.chapters, c.volumes), "book_id", "left")
    book = F.struct(F.struct("title", F.lit("zh-CN").alias("language")).alias("metadata"), F.col("entries"))
    return held.select("book_id", F.to_json(F.struct("source_text", F.lit("UTF-8").alias("source_encoding"), "cleaning", "watermark", book.alias("book"))).alias("document"))


@query(
    "SELECT b.book_id, sha256(source_text) AS source_sha256, coalesce((SELECT string_agg(s || ':' || e || ':' || kind, ',' ORDER BY s) FROM merged x WHERE x.book_id = b.book_id), '') AS cleaning, "
    "coalesce((SELECT string_agg(s || ':' || e || ':' || verdict, ',' ORDER BY s) FROM marks x WHERE x.book_id = b.book_id), '') AS watermark FROM books b"
)
def pipeline_output_spans(c):
    """What a reader of the documents finds in them."""
    span = "array<struct<start:bigint,end:bigint,kind:string,verdict:string>>"
    read = pipeline_output(c).select("book_id", F.from_json("document", f"struct<source_text:string,cleaning:{span},watermark:{span}>").alias("d"))
    told = lambda name, last: F.coalesce(F.array_join(F.transform(f"d.{name}", lambda x: F.concat_ws(":", x["start"], x["end"], x[last])), ","), F.lit("")).alias(name)
    return read.select("book_id", F.sha2("d.source_text", 256).alias("source_sha256"), told("cleaning", "kind"), told("watermark", "verdict"))


def _finish() -> None:
    """Put in what needs other modules' patterns."""
    from quillspark.plans.oracle import _all

    SQL["rule_hits"] = SQL["rule_hits"].replace("{hits}", _all("watermark"))


_finish()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by how many of their lines are boilerplate or may be."""
    return QUERIES["document_watermark_counts"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Every statement by name."""
    return dict(SQL)
