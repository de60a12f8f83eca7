"""Conversation structure repair: the cheapest edits that give a conversation turns in order, by a Viterbi search.

A repaired conversation is empty, or has a system turn at most and then turns of user and assistant by pairs. Rows are
kept, given another role, or deleted, and empty turns inserted. The search has one survivor for each of the four states
that the turns so far can be in. Its backpointers form a tree whose nodes count what refers to them; as soon as all
survivors share an ancestor, the edits up to it are final and given out, so what is held is the unresolved end only.

Ties go to the edits whose initials come first. Two survivors can tie over everything since they parted, so each
comparison is of whole unresolved ends: no survivor's edits begin with another's (the last of them is a row's, and rows are
as many in both), hence the order of two ends never changes once they differ, and their ranks are carried on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5
#: States: nothing yet, after system, after user, after assistant; and which turn may follow, by the role's initial.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ENDS = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
BLANK = r"\x20\x09-\x0D"
FAULTS = ("blank", "duplicate", "truncated")


def mark_faults(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, …) with at, its place in the conversation, and fault, the first that it has.

    Rows stand in order of turn (nulls first), role and text. Faults are blank (no character but white space), duplicate (role
    and text of an earlier row, found beside it in an order by hash, role and text) and truncated (the last character that is
    not white space ends no sentence). Nulls count as one space. One exchange on conv_id serves both orders.
    """
    own = [c for c in turns.columns if c not in ("role", "text", "at", "fault", "__hash", "__nth")]
    filled = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    plain = turns.select(*own, *filled).withColumn("__hash", F.xxhash64("role", "text")).repartition("conv_id")
    order = ["turn", "role", "text"]
    placed = plain.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long") - 1)
    alike = Window.partitionBy("conv_id", "__hash", "role", "text").orderBy("at")
    numbered = placed.withColumn("__nth", F.row_number().over(alike))
    last = F.regexp_extract("text", f"([^{BLANK}])[{BLANK}]*\\z", 1)
    fault = F.when(last == "", "blank").when(F.col("__nth") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return numbered.withColumn("fault", fault).drop("__hash", "__nth")


class Node:
    """One edit behind a survivor: row is what it did something to, None for an inserted turn; kids refer to it."""

    __slots__ = ("parent", "edit", "role", "row", "kids", "alive")

    def __init__(self, parent: Node | None, edit: str, role: str | None, row: tuple | None):
        self.parent, self.edit, self.role, self.row = parent, edit, role, row
        self.kids: list[Node] = []
        self.alive = False


class Search:
    """The survivors of one conversation. Rows are tuples that begin with the role's initial and the fault."""

    def __init__(self):
        self.root = Node(None, "", None, None)
        self.root.alive = True
        #: by state: cost, rank of the edits among survivors, and the last edit
        self.survivors: dict[int, tuple[int, int, Node]] = {START: (0, 0, self.root)}

    def _with_inserts(self) -> Iterator[tuple[int, int, int, str, Node]]:
        """(state, cost, rank, inserted, node) of each survivor as it is and with one or two turns inserted."""
        for state, (cost, rank, node) in self.survivors.items():
            yield state, cost, rank, "", node
            inserted = ""
            for _ in range(2):
                role = "u" if "u" in FOLLOWS[state] else "a"
                state, cost, inserted = FOLLOWS[state][role], cost + COST[INSERT], inserted + role
                yield state, cost, rank, inserted, node

    def add(self, row: tuple) -> list[Node]:
        """Take the next row; returns the edits that are final with it, in order."""
        initial, fault = row[0], row[1]
        kept = TRUNCATED if fault == "truncated" else 0
        best: dict[int, tuple] = {}
        for state, cost, rank, inserted, node in self._with_inserts():
            options = [(state, COST[DELETE], DELETE, None)]
            if fault not in ("blank", "duplicate"):
                if initial in FOLLOWS[state]:
                    options.append((FOLLOWS[state][initial], COST[KEEP] + kept, KEEP, None))
                options += [(to, COST[REROLE] + kept, REROLE, ROLES[r]) for r, to in FOLLOWS[state].items() if r in ROLES]
            for to, more, edit, role in options:
                found = (cost + more, rank, INSERT * len(inserted) + edit, inserted, role, node)
                if to not in best or found[:3] < best[to][:3]:
                    best[to] = found
        self._prune(best)
        order = {key: k for k, key in enumerate(sorted(b[1:3] for b in best.values()))}
        before = [node for _, _, node in self.survivors.values()]
        after = {}
        for state, (cost, rank, letters, inserted, role, node) in best.items():
            for r in inserted:
                node = self._child(node, INSERT, ROLES[r], None)
            leaf = self._child(node, letters[-1], role, row)
            leaf.alive = True
            after[state] = (cost, order[rank, letters], leaf)
        self.survivors = after
        for node in before:
            node.alive = False
            self._release(node)
        return self._settle()

    @staticmethod
    def _prune(best: dict[int, tuple]) -> None:
        """Leave out survivors that one behind an assistant's turn beats whatever follows.

        All that may follow a system turn may follow an assistant's; what may follow nothing may too, but for a system turn,
        which can be deleted for 2.
        """
        if ASSISTANT in best:
            for state, less in ((SYSTEM, 0), (START, COST[DELETE])):
                if state in best and best[state][0] > best[ASSISTANT][0] + less:
                    del best[state]

    @staticmethod
    def _child(node: Node, edit: str, role: str | None, row: tuple | None) -> Node:
        child = Node(node, edit, role, row)
        node.kids.append(child)
        return child

    @staticmethod
    def _release(node: Node) -> None:
        while node.parent is not None and not node.alive and not node.kids:
            node.parent.kids.remove(node)
            node = node.parent

    def _settle(self) -> list[Node]:
        """Move the root to the survivors' nearest shared ancestor; returns the edits on the way."""
        out = []
        while not self.root.alive and len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.parent = None
            out.append(self.root)
        return out

    def end(self) -> tuple[int, list[Node]]:
        """The least cost, and the edits that are left to give out."""
        ended = [(cost, rank, INSERT * len(inserted), inserted, node) for state, cost, rank, inserted, node in self._with_inserts() if state in ENDS]
        cost, _, _, inserted, node = min(ended, key=lambda x: x[:3])
        for r in inserted:
            node = self._child(node, INSERT, ROLES[r], None)
        out = []
        while node is not self.root:
            out.append(node)
            node = node.parent
        return cost, out[::-1]


EDITS = "conv_id long, at long, turn long, fault string, edit string, was string, role string, text string, cost long"


def repair(turns: DataFrame) -> DataFrame:
    """The edits that repair conversations, in order within each, of turns (conv_id, turn, role, text).

    Rows are (conv_id, at, turn, fault, edit, was, role, text, cost): edit is K, R, D or I; was is the role before, role the one
    after, null where deleted; an inserted row has an empty text, and null at, turn, fault and was. A last row of each
    conversation has a null edit and the whole cost. The repaired conversation is the rows with a role. Nulls count as one space; a
    null conv_id is a conversation of its own; other columns are not read; no rows give none.

    A conversation is read in order by one task, and only its unresolved end is held. Rows of one conversation stay together and
    in order in the result's partitions.
    """
    names = [x.split()[0] for x in EDITS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in EDITS.split(", "))])

    def row_of(conv: int | None, node: Node) -> tuple:
        if node.row is None:
            return conv, None, None, None, INSERT, None, node.role, "", None
        _, fault, at, turn, was, text = node.row
        role = None if node.edit == DELETE else node.role or was
        return conv, at, turn, fault, node.edit, was, role, text, None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, search = None, None

        def ended() -> list[tuple]:
            cost, rest = search.end()
            return [*(row_of(now[0], n) for n in rest), (now[0], *[None] * 7, cost)]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, schema)], schema=schema)

        for rows in batches:
            done = []
            for conv, at, turn, fault, role, text in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "at", "turn", "fault", "role", "text"))):
                if now != (conv,):
                    if now is not None:
                        done += ended()
                    now, search = (conv,), Search()
                done += [row_of(conv, n) for n in search.add((role[:1], fault, at, turn, role, text))]
            yield batch(done)
        if now is not None:
            yield batch(ended())

    plain = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return mark_faults(plain).sortWithinPartitions("conv_id", "at").mapInArrow(each, EDITS)


def summarize(edits: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of what repair gives, in its order.

    audit grows with a conversation, one letter an edit; nothing else does.
    """
    out = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    names = [x.split()[0] for x in out.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = lambda: {"counts": dict.fromkeys(FAULTS, 0), "illegal": 0, "initial": None, "turns": None, "distinct": 0, "audit": [], "hash": hashlib.sha256(), "some": False}
        now = fresh()
        for rows in batches:
            done = []
            for conv, turn, fault, edit, was, role, text, cost in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "turn", "fault", "edit", "was", "role", "text", "cost"))):
                if edit is None:
                    low, high = now["turns"] or (0, -1)
                    counts = [now["counts"][f] for f in FAULTS]
                    done.append((conv, high - low + 1 - now["distinct"], *counts, now["illegal"], cost, "".join(now["audit"]), now["hash"].hexdigest()))
                    now = fresh()
                    continue
                now["audit"].append(edit)
                if edit != INSERT:
                    if fault:
                        now["counts"][fault] += 1
                    if now["initial"] is not None:
                        now["illegal"] += now["initial"] + was[:1] not in ("su", "ua", "au")
                    now["initial"] = was[:1]
                    if turn is not None and (now["turns"] is None or turn != now["turns"][1]):
                        now["turns"] = ((now["turns"] or (turn,))[0], turn)
                        now["distinct"] += 1
                if role is not None:
                    now["hash"].update(("\n" * now["some"] + f"{role}:{text}").encode())
                    now["some"] = True
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            columns = zip(*done) if done else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return edits.mapInArrow(each, out)
