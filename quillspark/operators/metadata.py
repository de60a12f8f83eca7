"""Book metadata: parsing suggestions, filling gaps, overlaying a user's values, and search phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("title", "author", "description", "cover_keywords", "subjects", "series", "series_index")
MAIN = ("title", "author", "description", "series")
OVERLAID = ("title", "author", "description", "language", "series", "rights")
#: Words that stand for nothing, separators of subjects, and marks that search leaves out.
NOTHING = ("", "未知", "null")
NO_SUBJECT = ("", "未知")
SUBJECT_SPLIT = "[,，、/|]"
SUBJECT_SPLIT_USER = "[,，、;；]"
NOISE = "精校版|完结版|全本|完结|《|》"
#: What stands before the fields of a search result, and before fields that are known already.
RESULT_LABELS = (". 标题:", "\n   URL:", "\n   摘要:")
KNOWN_LABELS = {"title": "- 已知书名:", "author": "- 已知作者:", "description": "- 已知简介:", "subjects": "- 已知分类:", "series": "- 已知系列:"}
NONE_KNOWN = "(尚无任何已知字段)"


def clean_value(c) -> Column:
    """A trimmed text, null where it says nothing."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(~c.isin(*NOTHING), c)


def split_subjects(c, pattern: str = SUBJECT_SPLIT_USER) -> Column:
    """Subjects of a text: trimmed, not empty, each once, in order."""
    parts = F.transform(F.split(F.col(c) if isinstance(c, str) else c, pattern), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def normalize_subjects(df: DataFrame, column: str = "subjects_text") -> DataFrame:
    """df with subjects, the list that a user's text names."""
    return df.withColumn("subjects", F.coalesce(split_subjects(column), F.array().cast("array<string>")))


def parse_metadata_json(replies: DataFrame) -> DataFrame:
    """(book_id, fields...) from replies (book_id, raw): JSON, in a code fence or not; what cannot be read is null."""
    text = F.regexp_replace(F.trim("raw"), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    get = lambda name: F.get_json_object("__json", f"$.{name}")
    parsed = replies.withColumn("__json", text)
    array = F.from_json(get("subjects"), "array<string>")
    listed = F.filter(F.transform(array, lambda x: F.trim(x)), lambda x: x.isNotNull() & ~x.isin(*NO_SUBJECT))
    told = F.filter(split_subjects(get("subjects"), SUBJECT_SPLIT), lambda x: ~x.isin(*NO_SUBJECT))
    subjects = F.when(get("subjects").startswith("["), listed).otherwise(told)
    fields = [clean_value(get(n)).alias(n) for n in ("title", "author", "description", "cover_keywords", "series")]
    return parsed.select(
        "book_id", *fields, F.coalesce(subjects, F.array().cast("array<string>")).alias("subjects"), F.expr("try_cast(trim(get_json_object(__json, '$.series_index')) as int)").alias("series_index")
    )


def metadata_needs_fillin() -> Column:
    """Whether a main field is missing."""
    missing = F.lit(False)
    for name in MAIN:
        missing = missing | F.col(name).isNull()
    return missing | (F.coalesce(F.size("subjects"), F.lit(0)) == 0)


def metadata_is_empty() -> Column:
    """Whether no field says anything."""
    empty = F.coalesce(F.size("subjects"), F.lit(0)) == 0
    for name in (*MAIN, "cover_keywords", "series_index"):
        empty = empty & F.col(name).isNull()
    return empty


def fill_metadata(first: DataFrame, second: DataFrame) -> DataFrame:
    """first with its gaps filled from second, by book_id."""
    joined = first.alias("a").join(second.alias("b"), "book_id", "left")
    scalars = [F.coalesce(f"a.{n}", f"b.{n}").alias(n) for n in FIELDS if n != "subjects"]
    subjects = F.when(F.size("a.subjects") > 0, F.col("a.subjects")).otherwise(F.coalesce("b.subjects", "a.subjects"))
    return joined.select("book_id", *scalars, subjects.alias("subjects"))


def overlay_metadata(base: DataFrame, user: DataFrame) -> DataFrame:
    """base with a user's values where they are not blank; a series index counts only with a series."""
    joined = base.alias("a").join(user.alias("b"), "book_id", "left")
    own = lambda n: F.when(F.trim(F.col(f"b.{n}")) != "", F.trim(F.col(f"b.{n}")))
    texts = [F.coalesce(own(n), F.col(f"a.{n}")).alias(n) for n in OVERLAID]
    subjects = F.when(F.size("b.subjects") > 0, F.col("b.subjects")).otherwise(F.col("a.subjects"))
    index = F.when(own("series").isNotNull(), F.col("b.series_index")).otherwise(F.col("a.series_index"))
    return joined.select("book_id", *texts, subjects.alias("subjects"), index.alias("series_index"))


def search_query(title="title", stem="file_stem", default: str = "中文网络小说", suffix: str = " 网络小说 作者 简介") -> Column:
    """A phrase to search for a book by: its title, else its file's name, without marks of editions."""
    name = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    plain = F.trim(F.regexp_replace(F.coalesce(name(title), name(stem), F.lit(default)), NOISE, ""))
    return F.concat(plain, F.lit(suffix))


def known_fields() -> Column:
    """A line for each field that a suggestion has, which a second reply must leave as it is."""
    held = {n: F.col(n) for n in KNOWN_LABELS} | {"subjects": F.when(F.size("subjects") > 0, F.array_join("subjects", "、"))}
    lines = F.array_compact(F.array(*(F.concat(F.lit(label), held[n]) for n, label in KNOWN_LABELS.items())))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(NONE_KNOWN)


def search_context(results: DataFrame, first: int = 5) -> DataFrame:
    """(book_id, n, context): the first results (rank, title, url, snippet) as numbered text of three lines each."""
    found = results.withColumn("i", F.row_number().over(Window.partitionBy("book_id").orderBy("rank"))).where(F.col("i") <= first)
    told = [x for label, c in zip(RESULT_LABELS, ("title", "url", "snippet")) for x in (F.lit(label), F.coalesce(c, F.lit("")))]
    text = F.concat(F.col("i").cast("string"), *told)
    item = F.struct("i", text.alias("t"))
    return found.groupBy("book_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(item))["t"], "\n").alias("context"))
