"""Operator 13: conversation structure repair by Viterbi decoding with survivor coalescence.

A conversation is legal if its role initials are (s?(ua)+)?. Four states read that pattern; a row is kept, given another
role or deleted, and empty rows may be inserted, each at its cost. The best way into each state hangs in a tree of
backpointers whose nodes count what refers to them; nodes that no survivor needs go, and as soon as all survivors share an
ancestor its edits are emitted, so memory holds only what is still open. Of ways that cost the same, the one whose edits'
letters come first wins: the two are compared below their last common ancestor, on all of their open parts.

Rows stream through in order, conversation by conversation, sorted by Spark; no conversation is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.window import Window

from docledger.llm.common import SEPARATORS

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
UNFINISHED = 3
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
ROLES, INITIAL = {2: "user", 3: "assistant"}, {2: "u", 3: "a"}
#: States: nothing yet, after s, after u, after a; where a next u or a leads; states in which a conversation may end.
NEXT, ENDS = (2, 2, 3, 2), (0, 3)
#: What it costs at most to go on from the first state as the second one would: beyond that the second is no survivor.
DETOUR = {
    (1, 0): 6, (2, 0): 7, (3, 0): 4, (0, 1): 0, (2, 1): 3, (3, 1): 0,
    (0, 2): 3, (1, 2): 3, (3, 2): 3, (0, 3): 0, (1, 3): 6, (2, 3): 3,
}
SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Node:
    """An edit and the way that leads to it. fresh: made in the step that is under way."""

    __slots__ = ("parent", "letter", "state", "row", "kids", "held", "fresh", "depth")

    def __init__(self, parent: Node | None, letter: str, state: int, row: tuple | None):
        self.parent, self.letter, self.state, self.row = parent, letter, state, row
        self.kids, self.held, self.fresh, self.depth = 0, 0, True, parent.depth + 1 if parent else 0


class Repair:
    """Cheapest edits of one conversation, row by row; ``step`` and ``finish`` give the edits that are settled.

    apart: for two survivors, the letters with which they leave their last common ancestor (empty for one that is itself
    that ancestor). They decide between all of the two open parts, however long, and follow from the parents' letters.
    """

    def __init__(self) -> None:
        self.top = Node(None, "", 0, None)
        self.best: dict[int, tuple[int, Node]] = {}
        self.apart: dict[tuple[Node, Node], tuple[str, str]] = {}
        self._settle(self._inserted({0: (0, self.top)}))

    def step(self, initial: str, fault: int, row: tuple) -> list[Node]:
        found: dict[int, tuple[int, Node]] = {}
        for q, (cost, node) in self.best.items():
            self._offer(found, q, cost + COST[DELETE], node, DELETE, row)
            if fault in (BLANK, DUPLICATE):
                continue
            more = cost + (UNFINISHED if fault == TRUNCATED else 0)
            if q == 0 and initial == "s":
                self._offer(found, 1, more, node, KEEP, row)
            letter = KEEP if initial == INITIAL[NEXT[q]] else REROLE
            self._offer(found, NEXT[q], more + COST[letter], node, letter, row)
        return self._settle(self._inserted(found))

    def finish(self) -> tuple[int, list[Node]]:
        """The cost of the conversation and its last edits."""
        ends = [self.best[q] for q in ENDS if q in self.best]
        cost, node = ends[0]
        for more, other in ends[1:]:
            if more < cost or more == cost and self._before(other, node):
                cost, node = more, other
        return cost, self._way(node)

    def _way(self, node: Node) -> list[Node]:
        way = []
        while node is not self.top:
            way.append(node)
            node = node.parent
        return way[::-1]

    def _letters(self, a: Node, b: Node) -> tuple[str, str]:
        if a is b:
            return "", ""
        if (known := self.apart.get((a, b))) is not None:
            return known
        if a.fresh and (a.depth >= b.depth or not b.fresh):
            x, y = self._letters(a.parent, b)
            return x or a.letter, y
        x, y = self._letters(a, b.parent)
        return x, y or b.letter

    def _before(self, a: Node, b: Node) -> bool:
        x, y = self._letters(a, b)
        return x < y

    def _offer(self, found: dict, q: int, cost: int, parent: Node, letter: str, row: tuple | None) -> None:
        old = found.get(q)
        if old is None or cost <= old[0]:
            node = Node(parent, letter, q, row)
            if old is None or cost < old[0] or self._before(node, old[1]):
                found[q] = (cost, node)

    def _inserted(self, found: dict) -> dict:
        for q in (0, 1, 3, 2):
            if q in found:
                self._offer(found, NEXT[q], found[q][0] + COST[INSERT], found[q][1], INSERT, None)
        return found

    def _settle(self, found: dict) -> list[Node]:
        """Makes what was found the survivors, drops what none of them needs, and gives the edits that all share."""
        kept = {q: x for q, x in found.items() if not any(p != q and x[0] > y[0] + DETOUR[p, q] for p, y in found.items())}
        nodes = [node for _, node in kept.values()]
        self.apart = {(a, b): self._letters(a, b) for a in nodes for b in nodes if a is not b}
        for node in nodes:
            node.held += 1
            while node.parent is not None and node.held + node.kids == 1:  # new in the tree, so its parent gains a child
                node = node.parent
                node.kids += 1
        for _, node in self.best.values():
            node.held -= 1
            while node.parent is not None and not node.held and not node.kids:
                node = node.parent
                node.kids -= 1
        self.best = kept
        for node in nodes:
            node.fresh = False
        settled: list[Node] = []
        if not self.top.held and self.top.kids == 1:
            for node in self._way(nodes[0]):
                if self.top.held or self.top.kids != 1:
                    break
                self.top = node
                settled.append(node)
            self.top.parent = None
        return settled


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: rows damaged by the CRC-32 of ``conv_id:turn``, nulls read as one space.

    Of 20 remainders 0 drops a row (it stays here, marked, so that its conversation is not lost), 1 empties its text, 2
    removes . ! and ?, 3 repeats the row, 4 makes it the user's.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    how = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(how == 4, "user").otherwise(role).alias("role"),
        F.when(how == 1, "").when(how == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (how == 0).alias("dropped"),
        F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    )
    return rows.select("conv_id", "turn", "role", "text", "dropped", F.explode("copies").alias("_copy")).drop("_copy")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped and the first fault of each row, sorted within partitions by conversation.

    One shuffle, by conversation: the repeated rows are found and the turns sorted where they then are. Rows of one turn
    stand in the order of their role and text, rows without a turn first.
    """
    said = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("turn")
    trimmed = F.btrim(F.col("text"), F.lit(SEPARATORS))
    fault: Column = (
        F.when(trimmed == "", BLANK)
        .when(F.col("nth") > 1, DUPLICATE)
        .when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
        .otherwise(OK)
    )
    dealt = rows.repartition("conv_id").withColumn("nth", F.row_number().over(said))
    found = dealt.select("conv_id", "turn", "role", "text", "dropped", "nth", fault.alias("fault"))
    return found.sortWithinPartitions("conv_id", "turn", "role", "text", "nth").drop("nth")


class _Conversation:
    def __init__(self) -> None:
        self.repair, self.at, self.last, self.turn = Repair(), 0, None, None
        self.low = self.high = None
        self.turns = self.illegal = 0
        self.n = [0, 0, 0, 0]

    def row(self, turn: int | None, role: str, text: str, fault: int) -> list[Node]:
        if turn is not None:
            self.low, self.high = (turn if self.low is None else self.low), turn
            self.turns += turn != self.turn
            self.turn = turn
        initial = role[:1]
        self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
        self.last = initial
        self.n[fault] += 1
        return self.repair.step(initial, fault, (role, text))

    def summary(self, cost: int) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return dict(zip(SUMMARY, (gaps, *self.n[1:], self.illegal, cost), strict=True))


def repair(rows: DataFrame) -> DataFrame:
    """The edits of each conversation in order, sorted within partitions: conv_id, at, edit, role, text, and a summary.

    rows: conv_id, turn (long), role, text (strings) and dropped (boolean; a marked row counts for nothing but its
    conversation's existence). edit is K, R, D or I for a row that is kept, gets another role, is deleted or inserted;
    without the D rows, role and text are the repaired conversation. After its edits each conversation has a row whose
    edit is null and whose summary counts gaps in its turns, rows by first fault, illegal neighbours, and the cost.

    Null roles and texts count as one space, null conversation ids as one conversation; rows of one turn are ordered by
    role and text, repeated rows are duplicates of the first; texts of any length stay whole. A conversation whose rows are
    all dropped has a summary of zeros. Further columns are ignored, an empty table gives no rows.
    """
    kind = rows.schema["conv_id"].dataType
    count = StructType()
    for name in SUMMARY:
        count.add(name, LongType())
    schema = StructType().add("conv_id", kind).add("at", LongType()).add("edit", StringType()).add("role", StringType())
    schema.add("text", StringType()).add("summary", count)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    names, part = schema.fieldNames(), 4 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size, now, conv = 0, None, None

        def put(nodes: list[Node]) -> None:
            nonlocal size
            for node in nodes:
                role, text = node.row or ("", "")
                if node.letter in (REROLE, INSERT):
                    role = ROLES[node.state]
                out.append((now, conv.at, node.letter, role, text, None))
                conv.at += 1
                size += len(text) + 50

        def close() -> None:
            cost, nodes = conv.repair.finish()
            put(nodes)
            out.append((now, conv.at, None, None, None, conv.summary(cost)))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped", "fault")]
            for key, turn, role, text, dropped, fault in zip(*columns, strict=True):
                if conv is None or key != now:
                    if conv is not None:
                        close()
                    now, conv = key, _Conversation()
                if not dropped:
                    put(conv.row(turn, role, text, fault))
                if size > part:
                    yield _batch(out, names, arrow)
                    out, size = [], 0
        if conv is not None:
            close()
        yield _batch(out, names, arrow)

    plain = rows.select("conv_id", F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "dropped")
    return faults(plain).mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def digests(edits: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair``: its summary, the letters of its edits, and a digest of what they leave.

    The digest is the SHA-256 of the repaired rows as role:text, joined by line feeds, taken up edit by edit. ``edits``
    must come as ``repair`` gives them, a conversation's in one partition and in order.
    """
    kind = edits.schema["conv_id"].dataType
    schema = StructType().add("conv_id", kind)
    for name in SUMMARY:
        schema.add(name, LongType())
    schema.add("audit", StringType()).add("repaired_sha256", StringType())
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, left, digest = [], 0, hashlib.sha256()
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text", "summary")]
            for key, edit, role, text, summary in zip(*columns, strict=True):
                if edit is None:
                    out.append((key, *(summary[name] for name in SUMMARY), "".join(letters), digest.hexdigest()))
                    letters, left, digest = [], 0, hashlib.sha256()
                    continue
                letters.append(edit)
                if edit != DELETE:
                    digest.update(f"{chr(10) if left else ''}{role}:{text}".encode())
                    left += 1
            yield _batch(out, schema.fieldNames(), arrow)

    return edits.select("conv_id", "edit", "role", "text", "summary").mapInArrow(run, schema)
