"""SQL for DuckDB that states the registered queries over the derived books: common tables, and a query on them."""

from __future__ import annotations

from quillspark.functions.text import CJK, CONTROL, LINE_SPACE, WHITE_SPACE
from quillspark.operators.rules import BUILTIN
from quillspark.plans.books import BOILERPLATE


def _re2(pattern: str) -> str:
    """A rule's pattern for RE2, whose white space and word edges are ASCII."""
    out = pattern.replace(r"[\s\.", f"[{WHITE_SPACE}\\.").replace(r"[\s\x{3000}", f"[{WHITE_SPACE}").replace(r"\s*", f"[{WHITE_SPACE}]*")
    if out.startswith(r"\b"):
        out = r"(^|[^\pL\pN_])" + out[2:]
    if out.endswith(r"\b"):
        out = out[:-2] + r"($|[^\pL\pN_])"
    return out


def _rules(kind: str) -> list[tuple[str, str]]:
    own = [(n, at, i, _re2(p)) for at, (i, p, k, n) in enumerate(BUILTIN) if k == kind]
    return [(i, p) for _, _, i, p in sorted(own, key=lambda x: (-x[0], x[1]))]


def _first(kind: str) -> str:
    return " ".join(f"WHEN regexp_matches(trimmed, '{p}') THEN '{i}'" for i, p in _rules(kind))


def _all(kind: str) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(trimmed, '{p}') THEN '{i}' END" for i, p in _rules(kind))
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ', ')"


def trim(c: str) -> str:
    """c without Unicode white space at its ends."""
    return f"regexp_replace(regexp_replace({c}, '^[{WHITE_SPACE}]+', ''), '[{WHITE_SPACE}]+$', '')"


BOOKS = f"""
books AS (
  SELECT conv_id AS book_id, 'Book ' || conv_id AS title, string_agg(part, '' ORDER BY turn, part) AS source_text
  FROM (
    SELECT conv_id, turn,
      CASE WHEN turn = 0 AND conv_id % 3 = 0 AND conv_id % 7 <> 3 THEN '开篇的话' || chr(10) ELSE '' END
      || CASE WHEN turn % 4 = 0 AND conv_id % 7 <> 3 THEN '第' || (turn // 4 + 1) || '卷' || chr(10) ELSE '' END
      || CASE WHEN turn % 4 = 0 AND conv_id % 5 = 1 AND conv_id % 7 <> 3 THEN '卷首语一行' || chr(10) ELSE '' END
      || CASE WHEN conv_id % 7 = 3 THEN '' ELSE '第' || (turn + 1) || '章 ' || coalesce(role, '') || chr(10) END
      || CASE WHEN turn % 2 = 1 THEN '　　' ELSE '' END
      || CASE WHEN turn % 3 = 0 THEN replace(replace(replace(text, ', ', ',　　'), chr(10), '  ' || repeat(chr(10), 4)), '. ', '.' || chr(1) || ' ')
         ELSE replace(replace(text, ', ', ',　　'), chr(10), '  ' || repeat(chr(10), 4)) END
      || chr(10) || '{BOILERPLATE}' || chr(10) AS part
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL)
  GROUP BY conv_id)"""

DOCUMENT_BOOKS = """
books AS (SELECT doc_id AS book_id, 'Document ' || doc_id AS title, text AS source_text FROM documents)"""

TABLES = f""",
parts AS (SELECT book_id, strlen(source_text) AS n_bytes, string_split(source_text, chr(10)) AS parts FROM books),
rows_ AS (SELECT book_id, n_bytes, i - 1 AS line_no, parts[i] AS line, i < len(parts) AS ended FROM parts, unnest(range(1, len(parts) + 1)) AS t(i)),
lines AS (
  SELECT book_id, line_no, line, {trim("line")} AS trimmed, length(line) AS n_chars, ended, n_bytes,
    CAST(coalesce(sum(strlen(line) + 1) OVER w, 0) AS BIGINT) AS byte_start, CAST(coalesce(sum(strlen(line) + 1) OVER w, 0) + strlen(line) AS BIGINT) AS byte_end,
    CAST(coalesce(sum(length(line) + 1) OVER w, 0) AS BIGINT) AS char_start
  FROM rows_ WHERE ended OR line <> ''
  WINDOW w AS (PARTITION BY book_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
headings AS (
  SELECT book_id, byte_start AS s, byte_end AS e, CASE WHEN rule_id LIKE 'builtin-volume%' THEN 'volume' ELSE 'chapter' END AS level, trimmed AS title, rule_id, n_bytes
  FROM (SELECT *, CASE {_first("volume")} {_first("chapter")} END AS rule_id FROM lines WHERE trimmed <> '' AND length(trimmed) <= 100) WHERE rule_id IS NOT NULL),
bodies AS (
  SELECT *, least(e + 1, body_end) AS body_start FROM (
    SELECT *, coalesce(lead(s) OVER (PARTITION BY book_id ORDER BY s), n_bytes) AS body_end,
      CAST(sum(CASE WHEN level = 'volume' THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS INT) AS v FROM headings)),
vols AS (SELECT book_id, v AS volume_no, title, s AS heading_start, e AS heading_end, 'regex_match' AS origin, rule_id AS matched_rule_id FROM bodies WHERE level = 'volume'),
preface AS (
  SELECT book_id, min(s) AS body_end FROM headings h GROUP BY book_id
  HAVING EXISTS (SELECT 1 FROM lines l WHERE l.book_id = h.book_id AND l.trimmed <> '' AND l.byte_start < min(h.s))),
unsplit AS (
  SELECT book_id, CASE WHEN v > 0 THEN v END AS volume_no, title, s AS heading_start, e AS heading_end, body_start, body_end, 'regex_match' AS origin, rule_id AS matched_rule_id FROM bodies WHERE level = 'chapter'
  UNION ALL SELECT book_id, NULL, '楔子', 0, 0, 0, body_end, 'fallback', NULL FROM preface
  UNION ALL SELECT book_id, v, '(卷前)', e, e, body_start, body_end, 'fallback', NULL FROM bodies b WHERE level = 'volume'
    AND EXISTS (SELECT 1 FROM lines l WHERE l.book_id = b.book_id AND l.trimmed <> '' AND l.byte_start >= b.body_start AND l.byte_start < b.body_end)
  UNION ALL SELECT book_id, NULL, title, 0, 0, 0, strlen(source_text), 'fallback', NULL FROM books WHERE book_id NOT IN (SELECT book_id FROM headings)),
sized AS (
  SELECT u.*, CAST(coalesce((SELECT sum(l.n_chars + CASE WHEN l.ended THEN 1 ELSE 0 END) FROM lines l WHERE l.book_id = u.book_id AND l.byte_start >= u.body_start AND l.byte_start < u.body_end), 0) AS BIGINT) AS n_chars FROM unsplit u),
medians AS (SELECT book_id, CAST(floor(quantile_cont(n_chars, 0.5)) AS BIGINT) AS median, count(*) AS n_chapters FROM sized GROUP BY book_id),
oversized AS (SELECT s.*, m.median FROM sized s JOIN medians m USING (book_id) WHERE n_chapters >= 2 AND median > 0 AND n_chars > floor(median * 2.5)),
inside AS (
  SELECT o.*, l.byte_start AS ls, l.byte_end AS le, l.trimmed,
    coalesce(lag(l.trimmed) OVER w, '') = '' AS before_blank, coalesce(lead(l.trimmed) OVER w, '') = '' AS after_blank
  FROM oversized o JOIN lines l ON l.book_id = o.book_id AND l.byte_start >= o.body_start AND l.byte_start < o.body_end
  WINDOW w AS (PARTITION BY o.book_id, o.body_start ORDER BY l.line_no)),
cuts AS (
  SELECT *, coalesce(lead(ls) OVER (PARTITION BY book_id, body_start ORDER BY ls), body_end) AS piece_end
  FROM inside WHERE trimmed <> '' AND length(trimmed) <= 30 AND before_blank AND after_blank),
chapters AS (
  SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY body_start, heading_start) - 1 AS chapter_no FROM (
    SELECT book_id, volume_no, title, heading_start, heading_end, body_start, body_end, origin, matched_rule_id FROM sized s
    WHERE NOT EXISTS (SELECT 1 FROM oversized o WHERE o.book_id = s.book_id AND o.heading_start = s.heading_start AND o.body_start = s.body_start AND o.body_end = s.body_end)
    UNION ALL SELECT book_id, volume_no, title, heading_start, heading_end, body_start,
      coalesce((SELECT min(ls) FROM cuts c WHERE c.book_id = o.book_id AND c.body_start = o.body_start), body_end), origin, matched_rule_id FROM oversized o
    UNION ALL SELECT book_id, volume_no, trimmed, ls, le, least(le + 1, piece_end), piece_end, 'structural', NULL FROM cuts)),
heading_starts AS (
  SELECT book_id, heading_start FROM chapters WHERE heading_end > heading_start
  UNION ALL SELECT book_id, heading_start FROM vols WHERE heading_end > heading_start),
eligible AS (
  SELECT * FROM lines l WHERE trimmed <> '' AND length(trimmed) >= 10 AND NOT regexp_matches(trimmed, '^[「『“](?s:.*)[」』”]$')
  AND NOT EXISTS (SELECT 1 FROM heading_starts h WHERE h.book_id = l.book_id AND h.heading_start = l.byte_start)),
counted AS (
  SELECT *, count(*) OVER (PARTITION BY book_id, trimmed) AS repeats, {_all("watermark")} AS hits,
    (length(trimmed) - length(regexp_replace(trimmed, '[^{CJK}]', '', 'g'))) / length(trimmed) AS non_cjk FROM eligible),
signals AS (
  SELECT *, CASE WHEN repeats >= 5 THEN least(greatest(log10(repeats) / log10(50), 0), 1) END AS s_repeat,
    CASE WHEN non_cjk >= 0.4 THEN least(greatest((non_cjk - 0.4) / 0.4, 0), 1) END AS s_non_cjk, CASE WHEN hits <> '' THEN 1.0 END AS s_keyword FROM counted),
scored AS (
  SELECT *, least(greatest(coalesce(s_repeat, 0) * 0.4 + coalesce(s_non_cjk, 0) * 0.2 + coalesce(s_keyword, 0) * 0.4, 0), 1) AS score FROM signals),
marks AS (
  SELECT book_id, byte_start AS s, byte_end AS e, CASE WHEN score >= 0.7 THEN 'auto' ELSE 'suspect' END AS verdict, score, s_repeat, s_non_cjk, s_keyword, repeats, non_cjk, hits, trimmed, line_no FROM scored WHERE score >= 0.42),
eff AS (SELECT * FROM (SELECT *, regexp_replace(line, '{LINE_SPACE}+$', '') AS eff FROM lines) WHERE eff <> ''),
rest AS (SELECT *, regexp_replace(eff, '^　+', '') AS rest FROM eff),
trail AS (SELECT book_id, byte_start + strlen(eff) AS s, byte_end AS e FROM eff WHERE strlen(eff) < strlen(line)),
lead_ AS (SELECT book_id, byte_start AS s, byte_start + strlen(eff) - strlen(rest) AS e FROM rest WHERE strlen(eff) > strlen(rest)),
wide AS (
  SELECT book_id, byte_start + strlen(eff) - strlen(rest) AS base, line_no, string_split_regex(rest, '　{{2,}}') AS gaps, regexp_extract_all(rest, '　{{2,}}') AS hits FROM rest WHERE regexp_matches(rest, '　{{2,}}')),
inline_ AS (
  SELECT book_id, e - size AS s, e FROM (SELECT book_id, strlen(hits[i]) AS size, CAST(base + sum(strlen(gaps[i]) + strlen(hits[i])) OVER (PARTITION BY book_id, line_no ORDER BY i) AS BIGINT) AS e FROM wide, unnest(range(1, len(hits) + 1)) AS t(i))),
ctl AS (
  SELECT book_id, byte_start + strlen(eff) - strlen(rest) AS base, line_no, string_split_regex(rest, '{CONTROL}') AS gaps, regexp_extract_all(rest, '{CONTROL}') AS hits FROM rest WHERE regexp_matches(rest, '{CONTROL}')),
controls AS (
  SELECT book_id, e - 1 AS s, e FROM (SELECT book_id, CAST(base + sum(strlen(gaps[i]) + strlen(hits[i])) OVER (PARTITION BY book_id, line_no ORDER BY i) AS BIGINT) AS e FROM ctl, unnest(range(1, len(hits) + 1)) AS t(i))),
tokens AS (
  SELECT *, sum(CASE WHEN line_no > 0 AND regexp_matches(line, '^[ \\t　]*\\r?$') THEN 0 ELSE 1 END) OVER (PARTITION BY book_id ORDER BY line_no) AS run FROM lines WHERE ended),
blanks AS (
  SELECT book_id, min(byte_end - CASE WHEN line LIKE '%' || chr(13) THEN 1 ELSE 0 END) AS s, max(byte_end) + 1 AS e FROM tokens GROUP BY book_id, run HAVING count(*) >= 3),
found AS (
  SELECT book_id, s, e, 'trailing_whitespace' AS kind, NULL AS replacement FROM trail
  UNION ALL SELECT book_id, s, e, 'leading_fullwidth_space', NULL FROM lead_
  UNION ALL SELECT book_id, s, e, 'inline_fullwidth_space', NULL FROM inline_
  UNION ALL SELECT book_id, s, e, 'control_char', NULL FROM controls
  UNION ALL SELECT book_id, s, e, 'blank_line_compression', chr(10) || chr(10) FROM blanks),
cleaning AS (
  SELECT book_id, s, e, kind, replacement FROM (SELECT *, max(e) OVER (PARTITION BY book_id ORDER BY s, e, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM found) WHERE reach IS NULL OR e > reach),
mirrors AS (
  SELECT book_id, s, e, CASE WHEN s_keyword >= greatest(coalesce(s_repeat, -1), coalesce(s_non_cjk, -1)) THEN 'watermark_keyword' WHEN s_repeat >= coalesce(s_non_cjk, -1) AND s_repeat >= coalesce(s_keyword, -1) THEN 'watermark_repetition' ELSE 'watermark_non_cjk' END AS kind, NULL AS replacement, verdict FROM marks),
to_merge AS (SELECT * FROM cleaning UNION ALL SELECT book_id, s, e, kind, replacement FROM mirrors WHERE verdict = 'auto')"""


def merged(source: str) -> str:
    """Tables m1 and merged, the overlapping spans of a table as one each."""
    return f""",
m1 AS (SELECT *, sum(CASE WHEN s < reach THEN 0 ELSE 1 END) OVER (PARTITION BY book_id ORDER BY s, e, kind) AS run, row_number() OVER (PARTITION BY book_id ORDER BY s, e, kind) AS place FROM (
  SELECT *, max(e) OVER (PARTITION BY book_id ORDER BY s, e, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source})),
m2 AS (SELECT *, row_number() OVER (PARTITION BY book_id, run ORDER BY CASE kind WHEN 'watermark_keyword' THEN 3 WHEN 'watermark_repetition' THEN 2 WHEN 'watermark_non_cjk' THEN 1 ELSE 10 END DESC, place) AS best FROM m1),
merged AS (SELECT book_id, min(s) AS s, max(e) AS e, max(CASE WHEN best = 1 THEN kind END) AS kind, max(CASE WHEN best = 1 THEN replacement END) AS replacement FROM m2 GROUP BY book_id, run)"""


def sql(select: str, source: str = "to_merge", more: str = "", documents: bool = False, recursive: bool = False) -> str:
    """A whole statement; more adds tables that come before the merge of `source`."""
    return f"WITH {'RECURSIVE' if recursive else ''}{DOCUMENT_BOOKS if documents else BOOKS}{TABLES}{more}{merged(source)}\n{select}"
