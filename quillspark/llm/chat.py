"""Chat formatting: records of many layouts become canonical turns, and turns one marked text with a loss mask.

The paths of a record's nested fields are hashed to a fingerprint, and the fingerprint chooses a declarative mapping,
which names the fields that hold roles and texts. A table of typed columns has one fingerprint; records of VARIANT have
one each, told once a schema. Mappings run as column expressions. Turns are marked by control strings, which are escaped
reversibly where a text holds them, and the marked text is read back by its marks alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

TURNS = "array<struct<role:string,text:string>>"
START, END = "<|im_start|>", "<|im_end|>"
#: A backslash is put before the bar of every "<|", however many stand there already, so that no text holds a mark.
ESCAPE, UNESCAPE = r"<(\\*)\|", r"<\\(\\*)\|"
TRAINED = "assistant"
#: Other names of the roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class One:
    """A turn whose text stands in fields of the record, joined by a blank line where several are not empty; no turn for an empty system text."""

    role: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for every element of a list, whose role and text are fields of the element; a text may itself be a list of parts."""

    field: str
    role: str
    text: str


@dataclass(frozen=True)
class Pairs:
    """Two turns, user and assistant, for every element of a list of pairs."""

    field: str


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns: paths that a record must have, and where its turns stand, in order."""

    name: str
    needs: tuple[str, ...]
    turns: tuple[One | Each | Pairs, ...]
    renames: bool = True


def _asked(prompt: str, answer: str, *more: str) -> tuple[One, ...]:
    return (One("system", ("system",)), One("user", (prompt, *more)), One("assistant", (answer,)))


#: The layouts that are known, the more special before the more general of as many paths.
MAPPINGS = (
    Mapping("turn", ("role", "text"), (Each("", "role", "text"),), renames=False),
    Mapping("turn_content", ("content", "role"), (Each("", "role", "content"),)),
    Mapping("turn_value", ("from", "value"), (Each("", "from", "value"),)),
    Mapping("messages", ("messages[].content", "messages[].role"), (One("system", ("system",)), Each("messages", "role", "content"))),
    Mapping("messages_text", ("messages[].role", "messages[].text"), (One("system", ("system",)), Each("messages", "role", "text"))),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), (One("system", ("system",)), Each("conversations", "from", "value"))),
    Mapping("history", ("history[][]", "instruction", "output"), (One("system", ("system",)), Pairs("history"), One("user", ("instruction", "input")), One("assistant", ("output",)))),
    Mapping("instruction", ("instruction", "output"), _asked("instruction", "output", "input")),
    Mapping("instruction_response", ("instruction", "response"), _asked("instruction", "response", "context")),
    Mapping("prompt_completion", ("completion", "prompt"), _asked("prompt", "completion")),
    Mapping("prompt_response", ("prompt", "response"), _asked("prompt", "response")),
    Mapping("question_answer", ("answer", "question"), _asked("question", "answer")),
    Mapping("question_response", ("question", "response"), (One("system", ("system_prompt",)), One("user", ("question",)), One("assistant", ("response",)))),
)


def field_paths(schema: str) -> frozenset[str]:
    """The paths of all fields of a schema as schema_of_variant writes it; [] stands for any element of a list."""
    out, at = set(), 0
    token = re.compile(r"\s*(OBJECT<|ARRAY<|>|,|`(?:[^`]|``)*`:|[^\s<>,:`]+:|[A-Z_ ]+(?:\(\d+,\s*\d+\))?)")
    path, kinds = [""], []
    while at < len(schema) and (m := token.match(schema, at)):
        word, at = m[1], m.end()
        if word == "OBJECT<":
            kinds.append("")
        elif word == "ARRAY<":
            kinds.append("[]")
            path.append(path[-1] + "[]")
            out.add(path[-1])
        elif word == ">":
            if kinds and kinds.pop() == "[]":
                path.pop()
            if kinds and kinds[-1] == "":
                path.pop()
        elif word.endswith(":"):
            name = word[:-1].strip("`").replace("``", "`")
            path.append(f"{path[-1]}.{name}" if path[-1] else name)
            out.add(path[-1])
        elif word != "," and kinds and kinds[-1] == "":
            path.pop()
    return frozenset(out)


def typed_paths(kind: T.DataType, at: str = "") -> frozenset[str]:
    """The paths of all fields of a column type."""
    if isinstance(kind, T.ArrayType):
        return frozenset({f"{at}[]"}) | typed_paths(kind.elementType, f"{at}[]")
    if not isinstance(kind, T.StructType):
        return frozenset()
    names = [(f"{at}.{f.name}" if at else f.name, f.dataType) for f in kind]
    return frozenset(n for n, _ in names).union(*(typed_paths(d, n) for n, d in names))


def fingerprint(paths: frozenset[str]) -> int:
    """A hash of a set of paths as a signed 64-bit number."""
    h = xxh64_intdigest("\n".join(sorted(paths)).encode())
    return h - (1 << 64) if h >= 1 << 63 else h


def choose(paths: frozenset[str]) -> str | None:
    """The mapping with the most needed paths, all of them there, the first of several; None without one."""
    fits = [m for m in MAPPINGS if set(m.needs) <= paths]
    return max(fits, key=lambda m: len(m.needs)).name if fits else None


@cache
def _seen(schema: str) -> tuple[int, str | None]:
    paths = field_paths(schema)
    return fingerprint(paths), choose(paths)


class _Variant:
    """Fields of a VARIANT."""

    def __init__(self, value: Column):
        self.value = value

    def text(self, field: str) -> Column:
        found = F.try_variant_get(self.value, f"$.{field}", "variant")
        parts = F.transform(F.try_variant_get(found, "$", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
        return F.when(F.schema_of_variant(found).startswith("ARRAY"), F.array_join(parts, "")).otherwise(F.try_variant_get(found, "$", "string"))

    def each(self, field: str, make) -> Column:
        return F.transform(F.try_variant_get(self.value, f"$.{field}", "array<variant>"), lambda e: make(_Variant(e)))

    def at(self, k: int) -> Column:
        return F.try_variant_get(self.value, f"$[{k}]", "string")


class _Typed:
    """Fields of typed columns, or of a struct or list inside them; field names are looked up in its type."""

    def __init__(self, kind: T.DataType, value: Column | None = None):
        self.kind, self.value = kind, value

    def _field(self, field: str) -> tuple[Column, T.DataType]:
        if not isinstance(self.kind, T.StructType) or field not in self.kind.names:
            return F.lit(None).cast("string"), T.StringType()
        return (F.col(f"`{field}`") if self.value is None else self.value[field]), self.kind[field].dataType

    def text(self, field: str) -> Column:
        found, kind = self._field(field)
        if isinstance(kind, T.ArrayType):
            return F.array_join(F.transform(found, lambda p: F.coalesce(_Typed(kind.elementType, p).text("text"), F.lit(""))), "")
        return found.cast("string")

    def each(self, field: str, make) -> Column:
        found, kind = self._field(field)
        return F.transform(found, lambda e: make(_Typed(kind.elementType, e)))

    def at(self, k: int) -> Column:
        return F.get(self.value, k).cast("string")


def _role(value: Column, renames: bool) -> Column:
    value = F.coalesce(value, F.lit(""))
    if not renames:
        return value
    plain = F.lower(F.btrim(value))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair)), plain), plain)


def mapped(record: _Variant | _Typed, mapping: Mapping) -> Column:
    """The turns of a record, in order, as its mapping says."""
    turn = lambda role, text: F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    parts = []
    for t in mapping.turns:
        if isinstance(t, One):
            text = F.array_join(F.filter(F.array(*(record.text(f) for f in t.fields)), lambda x: x != ""), "\n\n")
            one = F.array(turn(F.lit(t.role), text))
            parts.append(F.when(text != "", one) if t.role == "system" else one)
        elif isinstance(t, Each):
            make = lambda e, t=t: turn(_role(e.text(t.role), mapping.renames), e.text(t.text))
            parts.append(record.each(t.field, make) if t.field else F.array(make(record)))
        else:
            pairs = record.each(t.field, lambda e: F.array(turn(F.lit("user"), e.at(0)), turn(F.lit("assistant"), e.at(1))))
            parts.append(F.flatten(pairs))
    return F.flatten(F.array(*(F.coalesce(p, F.array().cast(TURNS)) for p in parts)))


def canonical_columns(records: DataFrame, own: list[str]) -> DataFrame:
    """records' columns `own` with layout and turns, by the fingerprint of the other columns' paths.

    The table has one layout. A null field counts as empty; columns that no mapping names are not read. Where no mapping
    fits, layout is null and there are no turns.
    """
    kind = T.StructType([f for f in records.schema if f.name not in own])
    name = choose(typed_paths(kind))
    turns = next((mapped(_Typed(kind), m) for m in MAPPINGS if m.name == name), F.array().cast(TURNS))
    return records.select(*own, F.lit(name).cast("string").alias("layout"), turns.alias("turns"))


def canonical_records(records: DataFrame, record: str = "record") -> DataFrame:
    """records with fingerprint, layout and turns in place of the VARIANT column `record`.

    Every record has the layout of its own paths. Null records and those that no mapping fits have a null layout and no
    turns: set them apart by `layout is null`, their fingerprints tell which mappings are missing.
    """

    @F.pandas_udf("fingerprint long, layout string")
    def told(schemas: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_seen(s) if s is not None else (None, None) for s in schemas], columns=["fingerprint", "layout"]).astype({"fingerprint": "Int64"})

    own = [c for c in records.columns if c not in (record, "fingerprint", "layout", "turns")]
    # in a struct of their own, so that no column's name matters
    seen = records.select(F.struct(*own).alias("own"), F.col(record).alias("record"), told(F.schema_of_variant(record)).alias("told"))
    value = _Variant(F.col("record"))
    turns = F.coalesce(*(F.when(F.col("told.layout") == m.name, mapped(value, m)) for m in MAPPINGS), F.array().cast(TURNS))
    return seen.select("own.*", "told.fingerprint", "told.layout", turns.alias("turns"))


def escaped(text: Column) -> Column:
    """text without marks: reversible, and free of "<|"."""
    return F.regexp_replace(text, ESCAPE, r"<\\$1|")


def escaped_role(role: Column) -> Column:
    """role on one line, without marks: reversible."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    return re.sub(UNESCAPE, r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: DataFrame) -> DataFrame:
    """turns (…, role, text) with piece, its marked text, and loss_start and loss_end in its place.

    The pieces of a conversation, joined in order, are its formatted text. The mask covers what lies between loss_start and
    loss_end, code points within the piece: the escaped text of an assistant's turn; both are null in other turns. Null
    roles and texts count as empty.
    """
    role, text = escaped_role(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    own = [c for c in turns.columns if c not in ("role", "text", "piece", "loss_start", "loss_end")]
    made = turns.select(F.struct(*own).alias("own"), F.coalesce("role", F.lit("")).alias("plain"), F.concat(F.lit(START), role, F.lit("\n")).alias("head"), text.alias("text"))
    trained, start = F.col("plain") == TRAINED, F.length("head").cast("long")
    return made.select(
        "own.*", F.concat("head", "text", F.lit(END + "\n")).alias("piece"),
        F.when(trained, start).alias("loss_start"), F.when(trained, start + F.length("text")).alias("loss_end"),
    )


class Reader:
    """Reads turns back from formatted text that comes in pieces, wherever they are cut."""

    def __init__(self):
        self.rest = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns that end in what has been fed so far."""
        self.rest += piece
        end = END + "\n"
        while (at := self.rest.find(end)) >= 0:
            head, _, text = self.rest[:at].partition("\n")
            if not head.startswith(START):
                raise ValueError("formatted text does not begin with a turn")
            self.rest = self.rest[at + len(end) :]
            yield unescape_role(head[len(START) :]), unescape(text)


def read_back(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of formatted conversations.

    pieces has conv_id, turn, part, piece, loss_start and loss_end. A conversation's pieces are read in order of turn (nulls
    first), part and piece, so rows that tie in turn have a defined order. They are sorted by Spark, which spills, and read as
    they come: nothing of a conversation is held but digests and the piece at hand, however long it is.
    """
    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in out.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def told() -> tuple:
            if state["reader"].rest:
                raise ValueError("formatted text ends inside a turn")
            return now[0], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]

        for rows in batches:
            done = []
            for conv, piece, start, end in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end"))):
                if now != (conv,):
                    if now is not None:
                        done.append(told())
                    now = (conv,)
                    state = {"reader": Reader(), "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
                state["chars"] += len(piece)
                for role, text in state["reader"].feed(piece):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learned = unescape(piece[start:end])
                    state["loss_chars"] += len(learned)
                    state["loss"].update(learned.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in done], schema=SCHEMA)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, told()))], schema=SCHEMA)

    ordered = pieces.select(F.col("conv_id").cast("long"), "turn", "part", "piece", "loss_start", "loss_end").repartition("conv_id")
    return ordered.sortWithinPartitions("conv_id", "turn", "part", "piece").mapInArrow(each, out)


SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def format_conversations(canonical: DataFrame) -> DataFrame:
    """(conv_id, turn, part, piece, loss_start, loss_end) of records (conv_id, turn, turns): part numbers the turns of one record."""
    turns = canonical.select("conv_id", "turn", F.posexplode("turns").alias("part", "__turn"))
    return format_turns(turns.select("conv_id", "turn", "part", "__turn.*"))
