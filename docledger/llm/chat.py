"""Operator 9: chat formatting of reply trees.

Iterative self-joins enumerate every path from a root to a leaf, doubling the distance each time; paths are ranked by
the score of their messages, and each chosen path becomes one formatted conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docledger.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of this template and of others in use; inside texts they are escaped.
CONTROLS = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Head, backslashes and rest of a control string. Escaping adds a backslash to however many there are.
_PARTS = r"([<\[])(\\*)(" + "|".join(re.escape(c[1:]) for c in CONTROLS) + ")"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(_PARTS), F.lit(r"$1\\$2$3"))


def unescape(text: str) -> str:
    return re.sub(_PARTS.replace(r"(\\*)", r"\\(\\*)"), r"\1\2\3", text)


def escape_role(role: Column) -> Column:
    plain = F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escape(plain)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def paths(nodes: DataFrame) -> DataFrame:
    """tree, leaf, node, dist: the nodes of the path from every leaf to its root, dist replies above the leaf.

    nodes: tree, node (both unique together, not null) and parent, null for a root. A round doubles the distance,
    so a chain of n replies takes about log2 n rounds; only nodes with an ancestor that far take part. Links that
    form a cycle are an error.
    """
    parents = nodes.filter("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    path = nodes.join(parents, ["tree", "node"], "left_anti").select(
        "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist")
    )
    jump = nodes.filter("parent is not null").select("tree", "node", F.col("parent").alias("up"))
    step, limit = 1, nodes.count()
    while not jump.isEmpty():
        if step > limit:
            raise ValueError("the replies of a tree form a cycle")
        further = path.join(jump, ["tree", "node"]).select(
            "tree", "leaf", F.col("up").alias("node"), (F.col("dist") + step).alias("dist")
        )
        path = stored(path.unionByName(further), "chat-paths")
        beyond = jump.select("tree", F.col("node").alias("up"), F.col("up").alias("_up"))
        jump = stored(jump.join(beyond, ["tree", "up"]).select("tree", "node", F.col("_up").alias("up")), "chat-jumps")
        step *= 2
    return path


def format_trees(messages: DataFrame, best: int = 1) -> DataFrame:
    """One row for each chosen path: tree_id, leaf, formatted, loss_spans (start, end in code points).

    messages: tree_id, node_id, parent_id, role, text, score. Of the paths of a tree, those with the highest mean
    score stay, ``best`` at most, the earlier leaf first on a tie; null scores count as 0, null texts and roles as
    empty, null tree ids as one tree. A parent that is null, missing or the message itself makes a root. Of rows that
    repeat a node id, the first by parent, role and text counts; null node ids are left out. Further columns are
    ignored. The loss mask covers the assistant's texts. An empty table gives no rows.
    """
    tree = F.coalesce(F.concat(F.lit("s"), F.col("tree_id").cast("string")), F.lit("n"))
    first = (
        messages.filter("node_id is not null")
        .select(tree.alias("tree"), "tree_id", F.col("node_id").alias("node"), F.struct("parent_id", "role", "text", "score").alias("m"))
        .groupBy("tree", "node")
        .agg(F.min("tree_id").alias("tree_id"), F.min("m").alias("m"))
    )
    ids = first.select("tree", F.col("node").alias("_parent"))
    linked = first.select("*", F.when(F.col("m.parent_id") != F.col("node"), F.col("m.parent_id")).alias("_parent"))
    known = linked.join(ids.withColumn("_known", F.lit(True)), ["tree", "_parent"], "left")
    nodes = stored(
        known.select("tree", "tree_id", "node", F.when(F.col("_known"), F.col("_parent")).alias("parent"), "m.role", "m.text", "m.score"),
        "chat-nodes",
    )
    path = paths(nodes.select("tree", "node", "parent"))
    turn = F.struct(
        (-F.col("dist")).alias("at"),
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == LEARNED).alias("learned"),
    )
    turns = path.join(nodes.drop("parent"), ["tree", "node"])
    whole = turns.groupBy("tree", "leaf").agg(
        F.first("tree_id").alias("tree_id"),
        F.avg(F.coalesce("score", F.lit(0)).cast("double")).alias("score"),
        F.array_sort(F.collect_list(turn)).alias("turns"),
    )
    ranked = whole.withColumn("_rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))

    def place(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            (end + len(END) + 1).alias("at"), F.when(t["learned"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")
        )

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return ranked.filter(F.col("_rank") <= best).select(
        "tree_id",
        "leaf",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "").alias("formatted"),
        F.aggregate("turns", nothing, place, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations without branches as trees: each row answers the one before it by turn, role and text."""
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", "role", "text", F.row_number().over(by_turn).cast("long").alias("node_id")).select(
        F.col("conv_id").alias("tree_id"),
        "node_id",
        F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    found = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        found.append((unescape_role(role), unescape(rest.removesuffix("\n").removesuffix(END))))
    return found


def digests(formatted: DataFrame) -> DataFrame:
    """Reads formatted conversations back: their turns, and the text under the loss mask, as digests."""

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                turns = parse(r["formatted"])
                loss = "".join(unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"])
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append(
                    {
                        "conv_id": r["tree_id"],
                        "n_turns": len(turns),
                        "turns_sha256": hashlib.sha256(said.encode()).hexdigest(),
                        "loss_chars": len(loss),
                        "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
                        "formatted_chars": len(r["formatted"]),
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    out = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string())]
        + [("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("tree_id", "formatted", "loss_spans").mapInArrow(read_back, schema)
