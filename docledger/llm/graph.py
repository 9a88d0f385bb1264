"""Connected components of large graphs by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import discard, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. edges: a, b with a > b, distinct.

    Large: each node links its larger neighbours to the smallest of its neighbours and itself. Small: each node links
    its smaller neighbours and itself to the smallest of them. The minimum is pre-aggregated; the join back has one
    row a node on one side, so a node with very many neighbours can be split.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        linked = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        linked = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return linked.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node with an edge: root is the smallest node of its component.

    edges: a, b (long); direction, repeats and loops do not matter. Ends when a round changes nothing; the rounds
    grow with the logarithm of a component's size. An empty table gives no rows.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen, before = mark, now
        now = stored(_stars(_stars(now, large=True), large=False), "edges")
        discard(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
