"""Column functions on text: Unicode trimming, character classes, byte spans and previews.

Spans are half-open byte offsets into the UTF-8 text; lengths in characters are code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters with the Unicode property White_Space, as the inside of a character class.
WHITE_SPACE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WHITE_CHARS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: What counts as white space at the end of a line, and controls that may be stripped.
LINE_SPACE = r"[ \t\r\x{3000}\x{A0}\x{200B}-\x{200D}\x{FEFF}]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
#: Code points that count as Chinese context.
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}\x{2000}-\x{206F}\x{A0}\x{B7}\x{FEFF}"
DIALOGUE = r"(?s)^[「『“].*[」』”]\z"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_unicode(c) -> Column:
    """c without White_Space at either end; zero-width characters stay."""
    return F.btrim(_col(c), F.lit(WHITE_CHARS))


def is_line_whitespace(c) -> Column:
    """Whether every character of c is white space in the sense of line ends."""
    return _col(c).rlike(rf"^{LINE_SPACE}*\z")


def right_trimmed(c) -> Column:
    """c without the run of line white space at its end."""
    return F.regexp_replace(_col(c), rf"{LINE_SPACE}+\z", "")


def is_strippable_control(c) -> Column:
    """Whether c holds a control character other than tab, line feed and carriage return."""
    return _col(c).rlike(CONTROL)


def is_dialogue_line(c) -> Column:
    """Whether a trimmed line begins with an opening and ends with a closing quotation mark; they need not match."""
    return _col(c).rlike(DIALOGUE)


def cjk_count(c) -> Column:
    """Number of characters of Chinese context. Runs of them are taken out, as a match for every other character costs much more."""
    return F.length(_col(c)) - F.length(F.regexp_replace(_col(c), f"[{CJK}]+", ""))


def cjk_ratio(c) -> Column:
    """Share of characters of Chinese context; null for an empty text."""
    return F.when(F.length(_col(c)) > 0, cjk_count(c) / F.length(_col(c)))


def span_text(text, start, end) -> Column:
    """The text between two byte offsets."""
    start, end = _col(start), _col(end)
    raw = F.encode(_col(text), "UTF-8")
    return F.decode(F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")


def span_len(start, end) -> Column:
    """Length of a span; 0 where the end lies before the start."""
    return F.greatest(_col(end) - _col(start), F.lit(0))


def span_is_empty(start, end) -> Column:
    """Whether a span holds nothing."""
    return _col(end) <= _col(start)


def byte_to_char(text, byte) -> Column:
    """Code points before a byte offset; an offset inside a character counts as its start, one outside is clamped."""
    raw = F.encode(_col(text), "UTF-8")
    at = F.least(F.greatest(_col(byte), F.lit(0)), F.octet_length(_col(text)))
    head = F.hex(F.substring(raw, F.lit(1), at.cast("int")))
    starts = F.length(F.regexp_replace(head, "([0-7][0-9A-F]|[C-F][0-9A-F])|[89AB][0-9A-F]", "$1")) / 2
    inside = F.hex(F.substring(raw, (at + 1).cast("int"), F.lit(1))).rlike("^[89AB]")
    return (starts - F.when(inside, 1).otherwise(0)).cast("long")


def char_to_byte(text, char) -> Column:
    """Bytes before a code point offset, clamped to the text."""
    at = F.least(F.greatest(_col(char), F.lit(0)), F.length(_col(text)))
    return F.octet_length(F.substring(_col(text), F.lit(1), at.cast("int"))).cast("long")


def utf16_length(c) -> Column:
    """Length in UTF-16 units."""
    c = _col(c)
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def span_preview(text, char_start, char_end, around: int = 8) -> Column:
    """struct(before, target, after): a span given in code points with a few characters on each side."""
    text, start, end = _col(text), _col(char_start), _col(char_end)
    low = F.greatest(start - around, F.lit(0))
    cut = lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    return F.struct(cut(low, start).alias("before"), cut(start, end).alias("target"), cut(end, end + around).alias("after"))


def file_stem(path) -> Column:
    """A path's file name without its last extension."""
    return F.regexp_extract(_col(path), r"([^/]+?)(\.[^./]*)?$", 1)


def sample_text(text, chars: int = 1000) -> Column:
    """The first characters of a text."""
    return F.substring(_col(text), 1, chars)


def is_watermark_kind(kind) -> Column:
    """Whether a cleaning kind came from boilerplate."""
    return _col(kind).startswith("watermark_")


def xml_escape(c) -> Column:
    """c with the five characters of XML escaped."""
    c = _col(c)
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c
