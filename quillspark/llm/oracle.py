"""DuckDB SQL for the queries of these operators that SQL can express."""

from __future__ import annotations

#: Formatting is reversible, so what is read back is the turns themselves; only the length needs the escapes.
CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, length('<|im_start|>') + length('<|im_end|>') + 2 + length(replace(replace(role, '\', '\\'), chr(10), '\n')) + len(regexp_extract_all(role, '<\\*\|'))
    + length(text) + len(regexp_extract_all(text, '<\\*\|')) AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""



def _edit(state: str, edit: str, cost: str, line: str | None = None) -> str:
    """The way that ends in a state, (c cost, a audit, o repaired text), with one more edit; line is what it adds to the text."""
    text = f"{state}.o" if line is None else f"{state}.o || CASE WHEN {state}.o = '' THEN '' ELSE chr(10) END || {line}"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'o': {text}}}"


def _best(*ways: str) -> str:
    """The cheapest way, the least audit among equals; null where there is none."""
    return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x.c IS NOT NULL))[1]"


def _when(condition: str, way: str) -> str:
    return f"CASE WHEN {condition} THEN {way} END"


def _step(state: str, before: tuple[str, ...], initial: str, role: str | None) -> str:
    """A state's best way behind the next row: deleted, kept if the initial fits, or given the role."""
    own = "t.role || ':' || t.text"
    whole, more = "NOT t.lost", "CASE WHEN t.fault = 'truncated' THEN 5 ELSE 0 END"
    kept = [_when(f"{whole} AND t.role[1:1] = '{initial}'", _edit(f"e{b}", "K", more, own)) for b in before]
    given = [_when(whole, _edit(f"e{b}", "R", f"1 + {more}", f"'{role}:' || t.text")) for b in before] if role else []
    return f"{_best(_edit(f'e{state}', 'D', '2'), *kept, *given)} AS q{state}"


#: The cheapest edits by the four states after each row: nothing (0), system (s), user (u), assistant (a); an insertion between
#: rows leads on to u or a, and two in a row lead to nothing cheaper.
_BYTES = "list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)"
_CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda t, z: CASE WHEN (t & 1) = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END)), 4294967295)"""
_NO = "{'c': NULL::BIGINT, 'a': NULL::VARCHAR, 'o': NULL::VARCHAR}"
REPAIR = rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), h AS (SELECT *, {_CRC} % 20 AS what FROM k
), d AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE what WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth FROM
    (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d)
), t AS (
  SELECT *, fault IN ('blank', 'duplicate') AS lost FROM (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM n)
), w AS (
  SELECT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': ''::VARCHAR, 'o': ''::VARCHAR}} AS q0, {_NO} AS qs, {_NO} AS qu, {_NO} AS qa FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT e.conv_id, t.pos, {_edit("e0", "D", "2")} AS q0, {_step("s", ("0",), "s", None)}, {_step("u", ("0", "s", "a"), "u", "user")}, {_step("a", ("u",), "a", "assistant")}
  FROM (SELECT conv_id, pos, q0 AS e0, qs AS es, {_best("qu", *(_edit(q, "I", "5", "'user:'") for q in ("q0", "qs", "qa")))} AS eu, {_best("qa", _edit("qu", "I", "5", "'assistant:'"))} AS ea FROM w) e
  JOIN t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.pos = e.pos + 1
), f AS (SELECT conv_id, {_best("q0", "qa", _edit("qu", "I", "5", "'assistant:'"))} AS way FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1
), p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS earlier FROM t
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (earlier IS NOT NULL AND earlier[1:1] || role[1:1] NOT IN ('su', 'ua', 'au')) AS illegal FROM p GROUP BY conv_id
)
SELECT f.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  way.c AS cost, way.a AS audit, sha256(way.o) AS repaired_sha256
FROM f LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM f.conv_id
"""

#: A document's score term by term, without classes.
SEARCH = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), k AS (SELECT row_number() OVER () AS no, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0
), a AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS len_all FROM k
), q AS (
  SELECT i, item_id, t, count(*) AS times FROM (
    SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL
), p AS (SELECT no, t, count(*) AS tf FROM (SELECT no, unnest(terms) AS t FROM k) WHERE t IN (SELECT t FROM q) GROUP BY ALL
), w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, a GROUP BY t, n_docs
), s AS (
  SELECT i, item_id, doc_id, no, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // len_all))))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN w USING (t) JOIN k USING (no), a GROUP BY ALL
), r AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

SQL = {"op11_chat_formatting": CHAT, "op12_conversation_repair": REPAIR, "op13_lexical_search": SEARCH}
