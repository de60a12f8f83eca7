"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Equal lines are one node. A node of n characters is cut into k + 1 segments of about equal length: two lines within k edits
share a segment, at places that the lengths and the segment's number confine to a few. Every node enters its segments into
an index and probes the index, with those substrings, for nodes of its own length and up to k shorter. Lines that meet at a
segment that many nodes share meet again under keys that hold all but k blocks of a line, so that few pairs leave the joins.
Pairs are verified in two steps: blocks of one must stand in the other, and then the edit automaton runs bit-parallel in a
band of width 2 k + 1 over what lies between the first and the last difference.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import components, release, stash

#: Up to so many ids of lines are broadcast to the lines, whose texts are then not shuffled.
BROADCAST_IDS = 1_000_000
#: Up to so many lost line numbers are broadcast to the documents, whose texts are then not shuffled.
BROADCAST_LINES = 2_000_000
#: Texts that make up more than this share of all lines, of which there can't be more than 4096, are looked up by broadcast.
COMMON_SHARE = 1 / 4096
BLANK = " \t\x0b\f\r\n"


def explode_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, key, line_no, line) for the lines of every text; key is a hash of the text."""
    parts = F.split("text", "\n", -1)
    return docs.where("text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.posexplode(parts).alias("line_no", "line")
    )


def place(doc_id: str = "doc_id", key: str = "key", line_no: str = "line_no") -> Column:
    """Where a line stands; places compare by doc_id, nulls last, then by the text's hash and line number."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), F.col(key).alias("key"), F.col(line_no).alias("line_no"))


def name_lines(lines: DataFrame) -> DataFrame:
    """lines with a name of 128 bits, h1 and h2: two hashes of independent seeds."""
    return lines.withColumns({"h1": F.xxhash64(F.lit(1), "line"), "h2": F.xxhash64(F.lit(2), "line")})


def distinct_lines(lines: DataFrame) -> DataFrame:
    """One row per text, written out: id, h1, h2, line, n (characters), and its first place, and copies.

    id numbers the written rows, so that no two texts share one.
    """
    found = lines.groupBy("h1", "h2").agg(F.first("line").alias("line"), F.min(place()).alias("place"), F.count("*").alias("copies"))
    return stash(found.select(F.monotonically_increasing_id().alias("id"), "*", F.length("line").alias("n")))


def cut(n: str, parts: int, i: int | str) -> tuple[str, str]:
    """SQL for start (from 1) and length of part i of n characters; the later ones are longer by at most one."""
    short = f"({parts} - {n} % {parts})"
    return f"int({n} div {parts} * {i} + greatest({i} - {short}, 0) + 1)", f"int({n} div {parts} + int({i} >= {short}))"


def piece(code: str, start: str, size: str) -> str:
    """SQL for some characters, counted from 1, of a text that is encoded by four bytes each: they are found without reading the text before them."""
    return f"substr({code}, 4 * ({start}) - 3, 4 * ({size}))"


def segment_ways(k: int) -> list[dict[str, int]]:
    """How a line may be asked for: for each length that is not greater, each segment, and each place that edits can move it to.

    i edits at most lie before segment i of a pair whose first untouched segment it is, and k - i behind it. A line enters the
    segments that do not move in one of its own length.
    """
    return [
        {"less": less, "i": i, "shift": shift}
        for less in range(k + 1)
        for i in range(k + 1)
        for shift in range(max(-i, less - (k - i)), min(i, less + (k - i)) + 1)
    ]


def segment_keys(k: int) -> Column:
    """A key for each way in which a line's segments may be asked for."""
    start, size = cut("(n - w.less)", k + 1, "w.i")
    key = f"xxhash64(n - w.less, w.i, {piece('c', f'{start} + w.shift', size)})"
    ways = f"from_json('{json.dumps(segment_ways(k))}', 'array<struct<less int, i int, shift int>>')"
    return F.expr(f"transform(array(encode(line, 'UTF-32')), c -> transform({ways}, w -> {key}))[0]")


def runs_without(gone: tuple[int, ...], blocks: int) -> list[tuple[int, int, int]]:
    """(first, behind, edits) of each run of blocks that stay: edits is the number of blocks that go right before it."""
    found, first, edits = [], 0, 0
    for i in (*gone, blocks):
        if i > first:
            found.append((first, i, edits))
            edits = 0
        first, edits = i + 1, edits + 1
    return found


def moves(runs: list[tuple[int, int, int]], less: int, k: int) -> list[tuple[int, ...]]:
    """How far each run may lie to the right in a line that is longer by `less`: r blocks that go before it hold r edits at most."""
    found: list[tuple[int, ...]] = [()]
    for _, _, edits in runs:
        found = [m + (s,) for m in found for s in range((m[-1] if m else 0) - edits, (m[-1] if m else 0) + edits + 1)]
    behind = k - sum(edits for _, _, edits in runs)
    return [m for m in found if abs(less - m[-1]) <= behind]


def follows(k: int, blocks: int, less: int, runs: list[tuple[int, int, int]], moved: tuple[int, ...]) -> int:
    """Bits of the segment ways (by number) after which a line need ask for what stays.

    A pair within k edits shares a segment i with i edits at most before it and k - i behind. The segment tells the lengths'
    difference; of 2 k + 1 blocks it holds block 2 i, which stays and moves with it: the 2 i blocks before and 2 (k - i)
    behind have room for k blocks to go that hold all edits.
    """
    at = {b: s for (first, behind, _), s in zip(runs, moved) for b in range(first, behind)}
    own = [w["less"] == less and (blocks != 2 * k + 1 or at.get(2 * w["i"]) == w["shift"]) for w in segment_ways(k)]
    bits = sum({1 << number % 64 for number, met in enumerate(own) if met})
    return bits - (bits >> 63 << 64)  # as a signed number of 64 bits


def compound_keys(k: int, blocks: int, ask: bool) -> Column:
    """Keys of what stays of a line when k of its blocks go, for each choice of the k: lines within k edits share one.

    ask: what a line looks up, for each length that is not greater and each way in which edits can move what stays, as far as
    that follows from the segments that the line met others at (bits of `met`).
    """
    ways = []
    for less in range(k + 1 if ask else 1):
        for number, gone in enumerate(combinations(range(blocks), k)):
            runs = runs_without(gone, blocks)
            for moved in moves(runs, less, k) if ask else [(0,) * len(runs)]:
                after = follows(k, blocks, less, runs, moved)
                ways.append({"less": less, "gone": number, "after": after, "runs": [{"first": f, "behind": b, "shift": s} for (f, b, _), s in zip(runs, moved)]})
    shape = "array<struct<less int, gone int, after bigint, runs array<struct<first int, behind int, shift int>>>>"

    start = "int((n - w.less) div {m} * {i} + greatest({i} - ({m} - (n - w.less) % {m}), 0) + 1)"
    first, behind = start.format(m=blocks, i="r.first"), start.format(m=blocks, i="r.behind")
    kept = f"transform(w.runs, r -> {piece('c', f'{first} + r.shift', f'{behind} - {first}')})"
    asked = f"from_json('{json.dumps(ways)}', '{shape}')"
    # in shorter lines a block need not lie in its segment
    asked = f"filter({asked}, w -> n < {blocks * (k + 1) + k} or (w.after & met) <> 0)" if ask else asked
    keys = f"transform({asked}, w -> xxhash64(n - w.less, w.gone, {kept}))"
    return F.expr(f"transform(array(encode(line, 'UTF-32')), c -> {keys})[0]")


def parity(pieces: str) -> Column:
    """64 bits, each the parity of how often certain pieces of a text occur."""
    return F.expr(f"aggregate({pieces}, 0L, (found, c) -> found ^ shiftleft(1L, int(pmod(xxhash64(c), 64))))")


def common_part(x: str, limit: str, end: bool) -> str:
    """SQL for how many characters, `limit` at most, two encoded texts (x.a, x.b) have in common at their start or end, by comparisons of halving lengths."""
    halves = f"sequence(int(ceil(log2({limit} + 1))), 0, -1)"
    size = "shiftleft(1, j)"
    a, b = (piece(f"{x}.{t}", f"octet_length({x}.{t}) div 4 + 1 - p - {size}" if end else "p + 1", size) for t in "ab")
    return f"aggregate({halves}, 0, (p, j) -> if(p + {size} <= {limit} and {a} = {b}, p + {size}, p))"


def blocks_agree(x: str, k: int, blocks: int = 8) -> str:
    """SQL for a condition that encoded texts (x.a, x.b) within k edits always meet: of so many blocks of a, all but k stand in b, moved by k at most."""
    start, size = cut(f"int(octet_length({x}.a) div 4)", blocks, "i")
    stands = f"exists(sequence(-{k}, {k}), d -> {piece(f'{x}.a', start, size)} = {piece(f'{x}.b', f'{start} + d', size)})"
    return f"size(filter(sequence(0, {blocks - 1}), i -> {stands})) >= {blocks - k}"


def band_accepts(x: str, k: int) -> str:
    """SQL for whether the texts of a struct of letters (a, b) are within k edits, by bit-parallel simulation of the edit automaton in a band.

    After i characters of b, bit r of vector e tells whether the first i - k + r characters of a can have become them by e
    edits; a character keeps a bit (match or substitution), moves it down (insertion), and a deletion moves it up. Once no
    bit is set, the rest of the characters is only counted off.
    """
    full, first = (1 << (2 * k + 1)) - 1, [1 << k]
    for _ in range(k):
        first.append((first[-1] | first[-1] << 1) & full)
    # a negative index is out of range, not counted from the end: get gives null for it
    same = " + ".join(f"if(get({x}.a, i + {r - k}) = get({x}.b, i), {1 << r}, 0)" for r in range(2 * k + 1))
    rows = ["(acc.e0 & s)"]
    for e in range(1, k + 1):
        rows.append(f"((acc.e{e} & s | acc.e{e - 1} | shiftright(acc.e{e - 1}, 1) | shiftleft({rows[-1]}, 1)) & {full})")
    named = lambda values: "named_struct({})".format(", ".join(f"'e{e}', {v}" for e, v in enumerate(values)))
    places = f"if(size({x}.b) > 0, sequence(0, size({x}.b) - 1), cast(array() as array<int>))"
    step = f"(acc, i) -> if(acc.e{k} = 0, acc, transform(array({same}), s -> {named(rows)})[0])"
    end, at = f"aggregate({places}, {named(first)}, {step}).e{k}", f"(size({x}.a) - size({x}.b) + {k})"
    return f"({at} between 0 and {2 * k} and ({end} & shiftleft(1, {at})) != 0)"


def within_edits(left: str, right: str, k: int) -> Column:
    """Whether two different texts are within k edits.

    Their common start and end go first, so that the automaton sees only what lies between the first and the last edit;
    where that is long, blocks of one must stand in the other.
    """
    least = "least(octet_length(x.a), octet_length(x.b)) div 4"
    core = ", ".join(f"'{t}', {piece(f'x.{t}', 'p + 1', f'octet_length(x.{t}) div 4 - p - q')}" for t in "ab")
    core = f"transform(array({common_part('x', f'({least} - p)', True)}), q -> named_struct({core}))[0]"
    core = f"transform(array({common_part('x', f'({least})', False)}), p -> {core})[0]"
    letters = ", ".join(
        f"'{t}', if(octet_length(y.{t}) > 0, transform(sequence(1, int(octet_length(y.{t}) div 4)), i -> {piece(f'y.{t}', 'i', '1')}), cast(array() as array<binary>))"
        for t in "ab"
    )
    accepted = f"transform(array(named_struct({letters})), l -> {band_accepts('l', k)})[0]"
    long = f"(least(octet_length(y.a), octet_length(y.b)) < 128 or {blocks_agree('y', k)})"
    codes = f"named_struct('a', encode({left}, 'UTF-32'), 'b', encode({right}, 'UTF-32'))"
    found = f"transform(transform(array({codes}), x -> {core}), y -> {long} and {accepted})[0]"
    return F.expr(f"abs(length({left}) - length({right})) <= {k} and {found}")


def some_of(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of a table whose id is listed (once), with what the list tells of it; a short list is broadcast, so that the texts stay where they are."""
    return table.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id")


def verified(met: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Those of the pairs (a, b), each once, whose lines are within k edits, written out."""
    met = stash(met.distinct())
    needed = stash(met.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = some_of(nodes.select("id", "line"), needed)
    left = texts.select(F.col("id").alias("a"), F.col("line").alias("left"))
    right = texts.select(F.col("id").alias("b"), F.col("line").alias("right"))
    found = stash(met.join(left, "a").join(right, "b").where(within_edits("left", "right", k)).select("a", "b"))
    release(met, needed)
    return found


def links(nodes: DataFrame, k: int, hot: int = 8, blocks: int = 5, part_rows: int = 1024) -> DataFrame:
    """(a, b), a < b by id, for all pairs of nodes (id, line, n) within k edits, each pair once.

    A segment that over `hot` lines enter would pair them all. Lines that meet there meet again under compound keys, which
    hold all of a line but k of its blocks; they are paired where the counts of their letters, and of their pairs of
    neighbouring letters, differ by no more than k edits can change. A line asks only for the compound keys that follow from
    the busy segments it met. A key with many entries is dealt over parts.
    """
    nodes = nodes.select("id", "line", "n")
    keyed = stash(nodes.select("id", segment_keys(k).alias("keys")))
    still = [i for i, way in enumerate(segment_ways(k)) if way["less"] == way["shift"] == 0]
    entered = keyed.select("id", F.explode(F.array(*(F.get("keys", F.lit(i)) for i in still))).alias("key"))
    asked = keyed.select("id", F.explode("keys").alias("key"))
    busy = stash(entered.groupBy("key").agg(F.count("*").alias("entries")).where(F.col("entries") > hot).select("key"))
    x, y = entered.join(busy, "key", "left_anti").alias("x"), asked.alias("y")
    # no key has more than `hot` entries here, so that the side of the entries fits a hash table
    met = y.join(x.hint("shuffle_hash"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id")))
    met = met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    if busy.isEmpty():
        found = verified(met, nodes, k)
        release(keyed, busy)
        return found
    ways = keyed.select("id", F.posexplode("keys").alias("way", "key")).join(busy, "key", "left_semi")
    held = stash(ways.groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, way)")).alias("met")))
    letters, pairs = parity("split(line, '')"), parity("transform(sequence(1, n), i -> substr(line, i, 2))")
    keys = {"entered": compound_keys(k, blocks, False), "asked": compound_keys(k, blocks, True)}
    some = stash(some_of(nodes, held).select("id", "n", letters.alias("letters"), pairs.alias("pairs"), *(v.alias(c) for c, v in keys.items())))
    traits = ("id", "n", "letters", "pairs")
    entered, asked = (some.select(*traits, F.explode(c).alias("key")) for c in ("entered", "asked"))
    parts = entered.groupBy("key").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    parts = stash(parts.where("parts > 1"))
    number = F.coalesce("parts", F.lit(1))
    x = entered.join(parts, "key", "left").select(*traits, "key", F.explode(F.sequence(F.lit(1), number)).alias("part")).alias("x")
    y = asked.join(parts, "key", "left").select(*traits, "key", (F.pmod(F.xxhash64("id"), number.cast("bigint")).cast("int") + 1).alias("part")).alias("y")
    once = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    # an edit changes how often two letters occur at most, and four pairs of neighbours
    changed = lambda c: F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")))
    close = (changed("letters") <= 2 * k) & (changed("pairs") <= 4 * k)
    more = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & once & close)
    found = verified(met.union(more.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))), nodes, k)
    release(keyed, busy, held, some, parts)
    return found


def line_classes(docs: DataFrame, k: int = 2, min_chars: int = 32) -> DataFrame:
    """(doc_id, line_no, class_id, class_doc_id, class_line_no, n_links, kept) for each line that is not blank.

    Lines of fewer than min_chars characters, where two edits may make another line, are in one class only where they are equal.
    Of the others, a class is what links of at most k edits join, with all copies of its texts; class_doc_id and class_line_no
    are its first place by doc_id and line number, which alone is kept, and class_id is a 128-bit hash of the line there.
    n_links counts the other texts linked directly. Null and empty texts and blank lines have no rows. Rows that repeat a doc_id
    and text count as one document, null ids come last; texts that share an id come by their hash. Columns other than doc_id
    and text are not read.
    """
    return line_places(docs, k, min_chars, True).select(
        "doc_id", "line_no", "class_id", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"), "n_links", "kept"
    )


def name_of(h1: str, h2: str) -> Column:
    """The name of a text as 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def line_places(docs: DataFrame, k: int, min_chars: int, short: bool, lost: bool = False) -> DataFrame:
    """(doc_id, key, line_no, class_id, first, n_links, kept) for each line; short: with the lines under min_chars; lost: only those not kept."""
    rows = explode_lines(docs.select("doc_id", "text"))
    lines = name_lines(rows.where(F.length(F.btrim("line", F.lit(BLANK))) > 0 if short else F.length("line") >= min_chars))
    nodes = distinct_lines(lines)
    found = links(nodes.where(F.col("n") >= min_chars), k)
    ends = found.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    heads = stash(components(found).withColumnRenamed("node", "id").join(ends, "id"))
    # a text that stands once and has no link is its own class, and needs no look-up
    told = nodes.select("id", "h1", "h2", "place", "copies").join(heads, "id", "left")
    told = marked = stash(told.where("copies > 1 or component is not null"))
    first = told.where("component is not null").groupBy("component").agg(F.min(F.struct("place", name_of("h1", "h2").alias("class_id"))).alias("of"))
    told = told.withColumn("component", F.coalesce("component", "id"))  # no null that all rows without links would share
    told = stash(told.join(first, "component", "left").select(
        "h1",
        "h2",
        "copies",
        F.coalesce("of.class_id", name_of("h1", "h2")).alias("class_id"),
        F.coalesce("of.place", "place").alias("first"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    ))
    every = nodes.agg(F.sum("copies")).first()[0] or 0
    release(nodes, found, heads, marked)
    common = told.where(F.col("copies") > every * COMMON_SHARE)
    other = told.where(F.col("copies") <= every * COMMON_SHARE)
    names = lines.select("doc_id", "key", "line_no", "h1", "h2")
    names = names.join(F.broadcast(common), ["h1", "h2"], "left")
    # what the broadcast told is spread over the tasks of the next join, where nothing meets it
    asks = F.when(F.col("copies").isNull(), F.col("h1")).otherwise(F.xxhash64("doc_id", "key", "line_no"))
    other = other.select(F.col("h1").alias("asks"), F.col("h2").alias("asks2"), *(F.col(c).alias(f"o_{c}") for c in ("class_id", "first", "n_links")))
    named = names.withColumns({"asks": asks, "asks2": F.when(F.col("copies").isNull(), F.col("h2"))}).join(other.hint("merge"), ["asks", "asks2"], "left")
    own = place()
    told_first = F.coalesce("first", "o_first")
    placed = named.select(
        "doc_id",
        "key",
        "line_no",
        F.coalesce("class_id", "o_class_id", name_of("h1", "h2")).alias("class_id"),
        F.coalesce(told_first, own).alias("first"),
        F.coalesce("n_links", "o_n_links", F.lit(0)).alias("n_links"),
        F.coalesce(told_first == own, F.lit(True)).alias("kept"),
    )
    return placed.where("not kept") if lost else placed


def drop_repeated(docs: DataFrame, k: int = 2, min_chars: int = 32) -> DataFrame:
    """docs without lines of min_chars or more that repeat an earlier one; a document left without any but blank lines goes.

    Documents that lose nothing, null and empty texts among them, stay as they are. n_chars follows the text. Lost lines are
    those of a doc_id and text: rows that share an id, or have none, lose only what their own text repeats.
    """
    found = line_places(docs, k, min_chars, False, True)
    lost = found.select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key"), "line_no").distinct()
    lost = stash(lost.groupBy("__doc", "__key").agg(F.collect_set("line_no").alias("__lost")))
    few = (lost.agg(F.sum(F.size("__lost"))).first()[0] or 0) <= BROADCAST_LINES
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__key"))
    joined = docs.join(F.broadcast(lost) if few else lost, same, "left")
    parts = F.split("text", "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "__lost")
    rest = F.transform(places, lambda i: F.get("__parts", i))
    joined = joined.withColumn("__parts", F.when(F.col("__lost").isNotNull(), parts)).withColumn("__rest", F.when(F.col("__lost").isNotNull(), rest))
    left = joined.where(F.col("__lost").isNull() | F.exists("__rest", lambda x: x.rlike(r"\S")))
    text = F.when(F.col("__lost").isNull(), F.col("text")).otherwise(F.array_join("__rest", "\n"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__lost").isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return left.withColumns(changed).select(*docs.columns)
