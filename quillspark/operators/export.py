"""Books as e-book packages: reading order, pages, tables of contents, manifest, and the zipped file.

Every part is a row (book_id, href, content); only zipping needs a book's parts together.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import xml_escape

#: The classes that style sheets of such books address, and the media types of covers.
CHAPTER_CLASS = "titlel2std"
VOLUME_CLASS = "volume-title titlel2single"
COVER_TYPES = {"jpg": "image/jpeg", "png": "image/png"}
#: The markup below is fixed by the package format.
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html>\n'
RIGHTS = "All rights remain with the author."
#: Bytes of entries that are given back together, so that small books do not go one by one.
HELD_BYTES = 4 << 20


def _page(title, body, extra: str = ""):
    """An XHTML page with a stylesheet."""
    parts = (
        HEAD + f'<html xmlns="http://www.w3.org/1999/xhtml"{extra} xml:lang="zh-CN" lang="zh-CN">\n<head>\n<title>', title,
        '</title>\n<meta charset="utf-8"/>\n<link rel="stylesheet" type="text/css" href="styles.css"/>\n</head>\n<body>\n', body, "</body>\n</html>\n",
    )
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def sections(chapters: DataFrame, volumes: DataFrame) -> DataFrame:
    """(book_id, seq, kind, href, id, title, volume_no, chapter_no): volumes and chapters in reading order.

    Volumes and chapters are numbered apart, both from 1.
    """
    c = chapters.select("book_id", F.lit("chapter").alias("kind"), "title", "volume_no", "chapter_no", F.col("body_start").alias("at"), F.lit(1).alias("tie"))
    v = volumes.select("book_id", F.lit("volume").alias("kind"), "title", "volume_no", F.lit(None).cast("int").alias("chapter_no"), F.col("heading_end").alias("at"), F.lit(0).alias("tie"))
    every = c.unionByName(v)
    order = Window.partitionBy("book_id").orderBy("at", "tie", "chapter_no")
    every = every.withColumn("seq", F.row_number().over(order)).withColumn("n", F.count_if(F.col("kind") == "volume").over(order))
    number = F.when(F.col("kind") == "volume", F.col("n")).otherwise(F.col("seq") - F.col("n")).cast("int")
    every = every.withColumn("href", F.concat(F.col("kind"), F.format_string("_%04d.xhtml", number)))
    every = every.withColumn("id", F.concat(F.when(F.col("kind") == "volume", "vol").otherwise("ch"), F.format_string("%04d", number)))
    return every.select("book_id", "seq", "kind", "href", "id", "title", "volume_no", "chapter_no")


def chapter_pages(sections_: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """A page per chapter: its title and a <p> for each paragraph."""
    p = F.concat(F.lit("<p>"), xml_escape("text"), F.lit("</p>\n"))
    held = paragraphs.groupBy("book_id", "chapter_no").agg(F.array_sort(F.collect_list(F.struct("para_no", p.alias("p")))).alias("ps"))
    pages = sections_.where("kind = 'chapter'").join(held, ["book_id", "chapter_no"], "left")
    title = xml_escape("title")
    body = F.concat(F.lit(f'<h1 class="{CHAPTER_CLASS}">'), title, F.lit("</h1>\n"), F.coalesce(F.array_join("ps.p", ""), F.lit("")))
    return pages.select("book_id", "href", _page(title, body).alias("content"))


def volume_pages(sections_: DataFrame) -> DataFrame:
    """A title page per volume."""
    title = xml_escape("title")
    body = F.concat(F.lit(f'<h1 class="{VOLUME_CLASS}">'), title, F.lit("</h1>\n"))
    return sections_.where("kind = 'volume'").select("book_id", "href", _page(title, body).alias("content"))


def cover_pages(books: DataFrame, kind: str = "jpg") -> DataFrame:
    """The page that shows a book's cover image."""
    body = F.lit(f'<section epub:type="cover"><img src="cover.{kind}" alt="cover"/></section>\n')
    page = _page(xml_escape("title"), body, ' xmlns:epub="http://www.idpf.org/2007/ops"')
    return books.select("book_id", F.lit("cover.xhtml").alias("href"), page.alias("content"))


def _entries(sections_: DataFrame) -> DataFrame:
    """Sections by the entry at the top of the table of contents that they belong to."""
    return sections_.withColumn("top", F.when(F.col("volume_no").isNotNull(), F.col("volume_no")).cast("long")).withColumn("top", F.coalesce("top", -F.col("seq")))


def nav_toc(sections_: DataFrame) -> DataFrame:
    """The navigation page: root chapters, and volumes with their chapters inside."""
    link = F.concat(F.lit('<li><a href="'), F.col("href"), F.lit('">'), xml_escape("title"), F.lit("</a>"))
    rows = _entries(sections_).withColumn("link", link)
    inner = F.array_join(F.array_sort(F.collect_list(F.when((F.col("kind") == "chapter") & F.col("volume_no").isNotNull(), F.struct("seq", F.concat("link", F.lit("</li>\n")).alias("t")))))["t"], "")
    entry = rows.groupBy("book_id", "top").agg(F.min("seq").alias("seq"), F.min_by("link", "seq").alias("head"), inner.alias("inner"))
    text = F.concat(F.col("head"), F.when(F.col("inner") != "", F.concat(F.lit("\n<ol>\n"), "inner", F.lit("</ol>\n"))).otherwise(""), F.lit("</li>\n"))
    whole = entry.groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", text.alias("t"))))["t"], "").alias("items"))
    body = F.concat(F.lit('<nav epub:type="toc" id="toc">\n<ol>\n'), "items", F.lit("</ol>\n</nav>\n"))
    return whole.select("book_id", F.lit("nav.xhtml").alias("href"), _page("目录", body, ' xmlns:epub="http://www.idpf.org/2007/ops"').alias("content"))


def ncx_toc(sections_: DataFrame, books: DataFrame) -> DataFrame:
    """The older table of contents: play order runs over volumes and chapters; depth 2 where a volume has chapters."""
    n = F.col("seq").cast("string")
    point = F.concat(F.lit('<navPoint id="navPoint-'), n, F.lit('" playOrder="'), n, F.lit('"><navLabel><text>'), xml_escape("title"), F.lit('</text></navLabel><content src="'), "href", F.lit('"/>'))
    rows = _entries(sections_).withColumn("point", point)
    inner = F.array_join(F.array_sort(F.collect_list(F.when((F.col("kind") == "chapter") & F.col("volume_no").isNotNull(), F.struct("seq", F.concat("point", F.lit("</navPoint>\n")).alias("t")))))["t"], "")
    entry = rows.groupBy("book_id", "top").agg(F.min("seq").alias("seq"), F.min_by("point", "seq").alias("head"), inner.alias("inner"))
    text = F.concat("head", "inner", F.lit("</navPoint>\n"))
    whole = entry.groupBy("book_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("seq", text.alias("t"))))["t"], "").alias("points"), F.max(F.when(F.col("inner") != "", 2).otherwise(1)).alias("depth")
    )
    joined = whole.join(books.select("book_id", "title"), "book_id")
    content = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1">\n<head><meta name="dtb:uid" content="'), book_uid(), F.lit('"/><meta name="dtb:depth" content="'), F.col("depth").cast("string"),
        F.lit('"/></head>\n<docTitle><text>'), xml_escape("title"), F.lit("</text></docTitle>\n<navMap>\n"), "points", F.lit("</navMap>\n</ncx>\n"),
    )
    return joined.select("book_id", F.lit("toc.ncx").alias("href"), content.alias("content"), "depth")


def book_uid():
    """An identifier that follows from the book's id alone."""
    return F.concat(F.lit("urn:sha256:"), F.substring(F.sha2(F.col("book_id").cast("string"), 256), 1, 32))


def opf_manifest(
    sections_: DataFrame, metadata: DataFrame, modified: str, has_cover: bool = False, font: str | None = None, cover_kind: str = "jpg"
) -> DataFrame:
    """The package document: metadata, manifest, and spine, which a cover page begins. metadata has the fields of an overlaid book."""
    items = F.concat(F.lit('<item id="'), "id", F.lit('" href="'), "href", F.lit('" media-type="application/xhtml+xml"/>\n'))
    spine = F.concat(F.lit('<itemref idref="'), "id", F.lit('"/>\n'))
    lists = sections_.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("seq", items.alias("i"), spine.alias("s")))).alias("xs"))
    m = lists.join(metadata, "book_id")
    some = lambda c, before, after: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(before), xml_escape(F.col(c).cast("string")), F.lit(after))).otherwise("")
    subjects = F.array_join(F.transform(F.filter("subjects", lambda x: x != ""), lambda x: F.concat(F.lit("<dc:subject>"), xml_escape(x), F.lit("</dc:subject>\n"))), "")
    in_series = F.coalesce(F.col("series"), F.lit("")) != ""
    series = F.when(in_series, F.concat(some("series", '<meta property="belongs-to-collection" id="series-id">', "</meta>\n"), F.lit('<meta refines="#series-id" property="collection-type">series</meta>\n'), some("series_index", '<meta refines="#series-id" property="group-position">', "</meta>\n"), some("series", '<meta name="calibre:series" content="', '"/>\n'), some("series_index", '<meta name="calibre:series_index" content="', '"/>\n'))).otherwise("")
    rights = F.concat(F.lit("<dc:rights>"), xml_escape(F.coalesce(F.when(F.col("rights") != "", F.col("rights")), F.lit(RIGHTS))), F.lit("</dc:rights>\n"))
    fixed = '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>\n<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>\n<item id="css" href="styles.css" media-type="text/css"/>\n'
    if has_cover:
        fixed += f'<item id="cover-image" href="cover.{cover_kind}" media-type="{COVER_TYPES[cover_kind]}" properties="cover-image"/>\n'
        fixed += '<item id="cover" href="cover.xhtml" media-type="application/xhtml+xml"/>\n'
    opening = '<itemref idref="cover" linear="yes"/>\n' if has_cover else ""
    if font:
        fixed += f'<item id="font-regular" href="fonts/{font}.ttf" media-type="font/ttf"/>\n'
    content = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="bookid">\n<metadata xmlns:dc="http://purl.org/dc/elements/1.1/">\n<dc:identifier id="bookid">'), book_uid(),
        F.lit("</dc:identifier>\n<dc:title>"), xml_escape("title"), F.lit("</dc:title>\n<dc:creator>"), xml_escape(F.coalesce("author", F.lit(""))), F.lit("</dc:creator>\n<dc:language>"), xml_escape(F.coalesce("language", F.lit("zh-CN"))),
        F.lit(f'</dc:language>\n<meta property="dcterms:modified">{modified}</meta>\n'), some("description", "<dc:description>", "</dc:description>\n"), F.coalesce(subjects, F.lit("")), series, rights,
        F.lit('<meta name="cover" content="cover-image"/>\n' if has_cover else ""), F.lit("</metadata>\n<manifest>\n" + fixed), F.array_join("xs.i", ""), F.lit('</manifest>\n<spine toc="ncx">\n' + opening), F.array_join("xs.s", ""), F.lit("</spine>\n</package>\n"),
    )
    return m.select("book_id", F.lit("content.opf").alias("href"), content.alias("content"))


def css_part(books: DataFrame, css: str = "p { text-indent: 2em; }\n", font: str | None = None) -> DataFrame:
    """The stylesheet, with a face for an embedded font."""
    face = f"@font-face {{ font-family: '{font}'; src: url('fonts/{font}.ttf'); }}\nbody {{ font-family: '{font}'; }}\n" if font else ""
    return books.select("book_id", F.lit("styles.css").alias("href"), F.lit(face + css).alias("content"))


def binary_part(files: DataFrame, href: str) -> DataFrame:
    """Covers or fonts (book_id, content binary) as parts."""
    return files.select("book_id", F.lit(href).alias("href"), F.col("content").alias("data"))


def epub_parts(text_parts: list[DataFrame], binary_parts: list[DataFrame] = ()) -> DataFrame:
    """(book_id, href, data binary): all parts of the packages, the container among them."""
    out = None
    for part in text_parts:
        rows = part.select("book_id", F.concat(F.lit("OEBPS/"), "href").alias("href"), F.encode("content", "UTF-8").alias("data"))
        out = rows if out is None else out.union(rows)
    for part in binary_parts:
        out = out.union(part.select("book_id", F.concat(F.lit("OEBPS/"), "href"), "data"))
    box = '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>\n'
    books = text_parts[0].select("book_id").distinct()
    return out.union(books.select("book_id", F.lit("META-INF/container.xml"), F.encode(F.lit(box), "UTF-8")))


def epub_files(parts: DataFrame) -> DataFrame:
    """(book_id, epub binary): one zip per book, with the media type first and stored."""
    kind = parts.schema["book_id"].dataType.simpleString()

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        box = io.BytesIO()
        with zipfile.ZipFile(box, "w") as z:
            fixed = (1980, 1, 1, 0, 0, 0)
            z.writestr(zipfile.ZipInfo("mimetype", fixed), b"application/epub+zip", zipfile.ZIP_STORED)
            for href, data in sorted(zip(rows["href"], rows["data"])):
                z.writestr(zipfile.ZipInfo(href, fixed), bytes(data), zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"book_id": [rows["book_id"].iloc[0]], "epub": [box.getvalue()]})

    return parts.groupBy("book_id").applyInPandas(pack, f"book_id {kind}, epub binary")


def epub_entries(packages: DataFrame) -> DataFrame:
    """(book_id, entry_no, name, stored, size, data) for the entries of zipped books (book_id, epub), in their order."""
    kind = packages.schema["book_id"].dataType.simpleString()

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, found, held = ["book_id", "entry_no", "name", "stored", "size", "data"], [], 0
        for rows in batches:
            for book, epub in zip(rows["book_id"], rows["epub"]):
                with zipfile.ZipFile(io.BytesIO(bytes(epub))) as z:
                    found += [(book, i, x.filename, x.compress_type == zipfile.ZIP_STORED, x.file_size, z.read(x)) for i, x in enumerate(z.infolist())]
                    held += sum(x.file_size for x in z.infolist())
                if held >= HELD_BYTES:
                    yield pd.DataFrame(found, columns=names)
                    found, held = [], 0
        if found:
            yield pd.DataFrame(found, columns=names)

    return packages.select("book_id", "epub").mapInPandas(unpack, f"book_id {kind}, entry_no long, name string, stored boolean, size long, data binary")
