"""Cheapest repair of conversations to a legal order of roles, by a Viterbi search that emits edits as its survivors coalesce.

A repaired conversation is empty, or turns of user and assistant by pairs after at most one system turn. Rows are read in order, one stream a
conversation. For each state of that grammar the search keeps the cheapest edits that lead there, of several the ASCII-least.
The survivors' edits are paths in a tree of back pointers with counts of references: what no survivor refers to is
freed, and as soon as all survivors have a common ancestor, the edits up to it are final: they are emitted and freed too. So memory holds the
unresolved suffixes alone, however long a conversation is. Ties are decided by the complete unresolved suffixes:
each survivor has the rank of its path among the survivors', and since every row ends a path with a letter that isn't an insertion, none is
another's prefix, so that a longer path's order is that of its parents, then of the new letters.

Spark brings a conversation's rows together, finds repeated turns by a window over (conversation, role, text) that needs no further
exchange, and sorts; both sorts spill. One hash over a conversation's whole text is asked for, which only one reader can compute, so a
conversation is one task's, streamed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM, USER, ASSISTANT, NOTHING = "system", "user", "assistant", "nothing"
_SPACE = "\t\n\v\f\r"
RETAG, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_AFTER_INSERT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_LEGAL = frozenset(("su", "ua", "au"))


def _moves(initial: str, fault: str) -> dict[str, dict[str, tuple[int, str]]]:
    """For each state, the states that a row leads to, each with the least cost and letters: insertions, then what becomes of the row."""
    extra = TRUNCATED if fault == "truncated" else 0
    out: dict[str, dict[str, tuple[int, str]]] = {}
    for start in (NOTHING, SYSTEM, USER, ASSISTANT):
        best: dict[str, tuple[int, str]] = {}
        state, cost, letters = start, 0, ""
        for _ in range(3):  # a third insertion leads to a state that one leads to
            options = [(state, DELETE, "D")]
            if fault not in ("blank", "duplicate"):
                role = _INITIAL.get(initial)
                if role == SYSTEM and state == NOTHING or role in (USER, ASSISTANT) and _AFTER_INSERT[state] == role:
                    options.append((role, extra, "K"))
                options.append((_AFTER_INSERT[state], RETAG + extra, "R"))
            for to, more, letter in options:
                best[to] = min(best.get(to, (1 << 60, "")), (cost + more, letters + letter))
            state, cost, letters = _AFTER_INSERT[state], cost + INSERT, letters + "I"
        out[start] = best
    return out


_FAULTS = ("", "blank", "duplicate", "truncated")
_MOVES = {(i, f): _moves(i, f) for i in ("s", "u", "a", "") for f in _FAULTS}
#: What the future of a state costs more, at most, than that of another: it may insert its way there, and deletes a system turn that only the
#: beginning can keep. A survivor beyond that from another's cost can't win or tie, so it ends; else the path that deletes all rows would never coalesce.
_BEHIND = {
    NOTHING: {SYSTEM: 0, USER: INSERT, ASSISTANT: 0},
    SYSTEM: {NOTHING: 2 * INSERT + DELETE, USER: INSERT, ASSISTANT: 2 * INSERT},
    USER: {NOTHING: INSERT + DELETE, SYSTEM: INSERT, ASSISTANT: INSERT},
    ASSISTANT: {NOTHING: DELETE, SYSTEM: 0, USER: INSERT},
}
_LAST = {NOTHING: (0, ""), ASSISTANT: (0, ""), USER: (INSERT, "I"), SYSTEM: (2 * INSERT, "II")}


class Node:
    """A step of a path: the letters of a row's edits, the state before them, the row; ``children`` are the living ones."""

    __slots__ = ("parent", "letters", "before", "row", "children", "survives")

    def __init__(self, parent: Node | None, letters: str, before: str, row: tuple | None):
        self.parent, self.letters, self.before, self.row, self.children, self.survives = parent, letters, before, row, [], False


class Repair:
    """The search over one conversation's rows; ``emit`` gets each final edit with the repaired turn: (letter, role, text, turn), role None if deleted."""

    def __init__(self, emit):
        self.emit, self.root, self.held = emit, Node(None, "", NOTHING, None), 0
        self.root.survives = True
        #: state: (cost, rank, node)
        self.survivors: dict[str, tuple[int, int, Node]] = {NOTHING: (0, 0, self.root)}

    def row(self, turn, role: str, text: str, fault: str) -> None:
        moves = _MOVES[role[:1] if role[:1] in _INITIAL else "", fault]
        best: dict[str, tuple] = {}
        for state, (cost, rank, node) in self.survivors.items():
            for to, (more, letters) in moves[state].items():
                found = (cost + more, rank, letters, state)
                if to not in best or found < best[to]:
                    best[to] = found
        best = {to: found for to, found in best.items() if not any(found[0] > other[0] + _BEHIND[at].get(to, 0) for at, other in best.items() if at != to)}
        old = [(s, node) for s, (_, _, node) in self.survivors.items()]
        nodes, row = dict(old), (turn, role, text)
        ranks = {to: k for k, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
        self.survivors = {}
        for to, (cost, _, letters, state) in best.items():
            node = Node(nodes[state], letters, state, row)
            node.survives = True
            nodes[state].children.append(node)
            self.survivors[to] = (cost, ranks[to], node)
        self.held += len(best)
        for _, node in old:
            node.survives = False
            self._free(node)
        self._emit()

    def _free(self, node: Node) -> None:
        while not node.children and not node.survives and node.parent is not None:
            parent = node.parent
            parent.children.remove(node)
            node.parent, node = None, parent
            self.held -= 1

    def _emit(self) -> None:
        """Emit up to the survivors' youngest common ancestor."""
        while len(self.root.children) == 1 and not self.root.survives:
            (node,) = self.root.children
            self._say(node.letters, node.before, node.row)
            node.parent = None
            self.root = node
            self.held -= 1

    def _say(self, letters: str, state: str, row: tuple | None) -> None:
        for letter in letters:
            if letter == "D":
                self.emit("D", None, None, row[0])
                continue
            to = _AFTER_INSERT[state]
            if letter == "I":
                self.emit("I", to, "", None)
            elif letter == "R":
                self.emit("R", to, row[2], row[0])
            else:
                self.emit("K", row[1], row[2], row[0])
                to = _INITIAL[row[1][:1]]
            state = to

    def finish(self) -> int:
        """Emit what is left of the cheapest repair; its cost."""
        state = min(self.survivors, key=lambda s: (self.survivors[s][0] + _LAST[s][0], self.survivors[s][1]))
        cost, _, node = self.survivors[state]
        more, letters = _LAST[state]
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self._say(node.letters, node.before, node.row)
        self._say(letters, state, None)
        return cost + more


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): the rows damaged by the checksum of conv_id and turn; null roles and texts become a space.

    Of twenty remainders, 0 drops a row (``dropped``; it stays to name its conversation), 1 empties its text, 2 removes its marks at sentences' ends, 3 repeats it, 4 gives it to the user.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    what = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), what.alias("what"), role.alias("role"), text.alias("text"))
    changed = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), (F.col("what") == 0).alias("dropped"), "what")
    times = F.when(F.col("what") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("time", F.explode(times)).drop("time", "what")


def _fault(text: Column, number: Column) -> Column:
    flat = F.rtrim(F.translate(text, _SPACE, " " * len(_SPACE)))
    return F.when(flat == "", "blank").when(number > 1, "duplicate").when(~F.substring(flat, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")


_SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with their faults, each conversation's in one partition, by turn, then role and text; dropped rows first."""
    held = rows if "dropped" in rows.columns else rows.withColumn("dropped", F.lit(False))
    held = held.repartition("conv_id").withColumn("h", F.xxhash64("role", "text")).withColumn("g", F.xxhash64("text", F.lit(1), "role"))
    earlier = Window.partitionBy("conv_id", "h", "g", "dropped").orderBy(F.asc_nulls_first("turn"))
    held = held.select("conv_id", "turn", "role", "text", "dropped", _fault(F.col("text"), F.row_number().over(earlier)).alias("fault"))
    return held.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.desc("dropped"), F.asc_nulls_first("turn"), "role", "text")


def repair(rows: DataFrame, turns: bool = False) -> DataFrame:
    """The cheapest repair of each conversation of ``rows`` (conv_id, turn, role, text, and dropped: rows that are only there to name their conversation).

    Keeping a turn costs nothing, giving it to user or assistant 2, deleting it 3, inserting an empty turn 2; blank turns and ones whose role and text came
    before must be deleted, and a turn that stays without a mark at its end costs 1. Returns a row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit (the edits' initials) and repaired_sha256; with ``turns`` the repaired conversations themselves: conv_id, place, edit, turn (null: inserted), role, text.

    Defined cases: null turns come first; rows of one turn go by role and text; repeated rows are duplicates; a null role or text is a space (``damaged``
    makes it so); roles that begin with none of s, u and a are given to another or deleted; rows with a null conv_id are a conversation; a conversation without rows has
    zeros, no edits and the hash of nothing; an empty table gives no rows; texts may be of any length. Other columns are ignored.
    """
    kind = dict(rows.dtypes)["conv_id"]
    if turns:
        schema = f"conv_id {kind}, place long, edit string, turn long, role string, text string"
    else:
        schema = f"conv_id {kind}, {', '.join(f'{k} long' for k in _SUMMARY)}, audit string, repaired_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current: _Conversation | None = None
        for batch in batches:
            types = [batch.schema.field("conv_id").type]
            for conv_id, turn, role, text, dropped, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped", "fault")), strict=True):
                if current is None or conv_id != current.conv_id:
                    if current is not None:
                        current.end(out, turns)
                    current = _Conversation(conv_id, out if turns else None)
                if not dropped:
                    current.add(turn, role, text, fault)
            yield _batch(out, names, types, turns)
        if current is not None:
            current.end(out, turns)
            yield _batch(out, names, types, turns)

    return _ordered(rows).mapInArrow(run, schema)


def _batch(out: list[tuple], names: list[str], types: list[pa.DataType], turns: bool) -> pa.RecordBatch:
    types = [*types, *([pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()] if turns else [pa.int64()] * len(_SUMMARY) + [pa.string()] * 2)]
    columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
    out.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


class _Conversation:
    """Counts, edits and hash of a conversation while its rows come in; repaired turns go to ``turns`` if it is given."""

    def __init__(self, conv_id, turns: list | None):
        self.conv_id, self.turns, self.place = conv_id, turns, 0
        self.count = dict.fromkeys(_FAULTS, 0)
        self.illegal = self.distinct = 0
        self.low = self.high = self.before = None
        self.hash, self.audit, self.first = sha256(), [], True
        self.repair = Repair(self._emit)

    def _emit(self, letter: str, role: str | None, text: str | None, turn) -> None:
        self.audit.append(letter)
        if self.turns is not None:
            if role is not None:
                self.turns.append((self.conv_id, self.place, letter, turn, role, text))
                self.place += 1
        elif role is not None:
            self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode(errors="surrogatepass"))
            self.first = False

    def add(self, turn, role: str, text: str, fault: str) -> None:
        self.count[fault] += 1
        if self.before is not None and self.before + role[:1] not in _LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        self.repair.row(turn, role, text, fault)

    def end(self, out: list, turns: bool) -> None:
        cost = self.repair.finish()
        if not turns:
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
            out.append((self.conv_id, gaps, *(self.count[f] for f in _FAULTS[1:]), self.illegal, cost, "".join(self.audit), self.hash.hexdigest()))
