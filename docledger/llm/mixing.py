"""Operator 8: mixing sources to target weights by Efraimidis-Spirakis sampling.

A document of weight w has the key -ln(u) / w, u uniform and fixed by its id; taking documents by ascending key is
weighted sampling without replacement. A source whose target exceeds its size is first taken whole as often as it
fits; the documents at the front of its order fill the rest of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docledger.llm.common import discard, stored

#: Source weights repeat in this order; a target stops at MAX_EPOCHS times its source's size.
SOURCE_WEIGHTS, MAX_EPOCHS = (1, 2, 3), 3
#: Ranges of the key within a source. Only the range in which a source's target ends is sorted.
KEY_RANGES = 1 << 12
SEED = "mix-1"
#: What mix adds, and the order in which it takes a source's documents.
ADDED, ORDER = ("source_size", "target", "times"), ("_range", "_key", "_id", "_size")


def uniform(doc_id: Column, told: Column | None = None, seed: str = SEED) -> Column:
    """A number in (0, 1] fixed by seed and id, for a null id by seed and ``told``: 52 bits of their MD5."""
    without = F.lit("null") if told is None else F.concat(F.lit("null:"), F.md5(F.coalesce(told.cast("string"), F.lit("")).cast("binary")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), without)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / 4503599627370496.0


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: _src (not null), source, source_size. Adds target.

    Weights follow the sources by code point, null last. The targets share the sum of all sizes by weight; where
    that exceeds the cap, the excess is shared out among the others by weight. The caps bind in the order of cap
    over weight, so that one pass in that order finds the common level. The windows see one row for each source.
    """
    ranked = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.expr(f"get(array({', '.join(map(str, SOURCE_WEIGHTS))}), (_rank - 1) % {len(SOURCE_WEIGHTS)})")
    weighed = (
        sizes.withColumn("_rank", F.row_number().over(ranked))
        .withColumn("_weight", turn.cast("double"))
        .withColumn("_cap", MAX_EPOCHS * F.col("source_size").cast("double"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    )
    rest = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight_left = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    levelled = weighed.withColumn("_level", rest / weight_left).withColumn("_free", F.col("_ratio") > F.col("_level"))
    level = F.max(F.when(F.col("_free"), F.col("_level"))).over(everything)
    return levelled.select(
        "_src", "source_size", F.when(F.col("_free"), F.col("_weight") * level).otherwise(F.col("_cap")).alias("target")
    )


def mix(rows: DataFrame, told: str | None = None) -> DataFrame:
    """rows: doc_id, source, size (long), weight and any other columns. Adds source_size, target and times.

    times says how often the mix takes the row, 0 to 3. Null sources form one source; a null weight counts as 1, and
    rows of weight 0 or less come last. A null size counts as 0. Rows of one id and size are taken alike, so that rows
    repeated m times miss the target by m sizes at most; documents without an id are told apart by the column ``told``,
    as by their text, and only those that agree in it share a key.
    Columns of rows that are named like an added one are replaced. An empty table gives no rows.

    ``rows`` is read twice: for the keys alone, which tell where each source's order is cut, and to compare every row
    with its source's cut. No row is shuffled or sorted as a whole.
    """
    weight, u = F.coalesce(F.col("weight"), F.lit(1.0)), uniform(F.col("doc_id"), F.col(told) if told else None)
    key = F.when(weight > 0, -F.ln(u) / weight).otherwise(u)
    part = F.when(weight > 0, F.least(F.floor(KEY_RANGES * (1 - F.exp(-F.col("_key")))), F.lit(KEY_RANGES - 1)))
    keyed = (
        rows.select(
            F.struct(*(c for c in rows.columns if c not in ADDED)).alias("_row"),
            F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_src"),
            "source",
            F.col("doc_id").alias("_id"),
            F.coalesce("size", F.lit(0)).cast("long").alias("_size"),
            key.alias("_key"),
            (weight > 0).alias("_weighed"),
            "weight",
        )
        .withColumn("_range", F.coalesce(part, KEY_RANGES + F.floor(KEY_RANGES * F.col("_key"))))
        .drop("_weighed", "weight")
    )
    keys = stored(keyed.drop("_row"), "mix-keys")
    cut = stored(_cuts(keys), "mix-cuts")
    discard(keys)
    mine, last = F.struct(*ORDER), F.struct(*(F.col(f"_cut{c}").alias(c) for c in ORDER))
    inside = F.coalesce(F.col("_cut_range").isNotNull() & (mine <= last), F.lit(False)).cast("int")
    times = F.least(F.col("_whole") + inside, F.lit(MAX_EPOCHS)).cast("int")
    return keyed.join(cut, "_src").select("_row.*", "source_size", "target", times.alias("times"))


def _cuts(keys: DataFrame) -> DataFrame:
    """Per _src: source_size, target, _whole epochs, and the last place in the order (_cut...) that is taken once more.

    A document is taken if its middle lies before the rest of the target. Ranges before the cut are taken, those after
    it are not; a window sees the ranges of a source, and another the documents of the one range that holds the cut.
    """
    ranges = stored(keys.groupBy("_src", "source", "_range").agg(F.sum("_size").alias("_sum")), "mix-ranges")
    goals = stored(targets(ranges.groupBy("_src", "source").agg(F.sum("_sum").alias("source_size"))), "mix-targets")
    goals = goals.withColumn("_whole", F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).withColumn(
        "_rest", F.col("target") - F.col("_whole") * F.col("source_size")
    )
    before = Window.partitionBy("_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    split = (
        ranges.select("_src", "_range", "_sum", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
        .join(goals, "_src")
        .filter("_before < _rest")
        .groupBy("_src", "_rest")
        .agg(F.max(F.struct("_range", "_before")).alias("_at"))
        .select("_src", "_rest", "_at.*")
    )
    inside = Window.partitionBy("_src").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        keys.join(stored(split, "mix-splits"), ["_src", "_range"])
        .withColumn("_middle", F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0)) + F.col("_size") / 2.0)
        .filter("_middle < _rest")
        .groupBy("_src")
        .agg(F.max(F.struct(*ORDER)).alias("_cut"))
    )
    # where the range's first document is too long, all before the range are taken
    empty = split.select("_src", F.struct(*(x.alias(c) for c, x in zip(ORDER, _start(keys), strict=True))).alias("_first"))
    found = empty.join(ends, "_src", "left").select("_src", F.coalesce("_cut", "_first").alias("_cut"))
    return goals.join(found, "_src", "left").select(
        "_src", "source_size", "target", "_whole", *(F.col("_cut")[c].alias(f"_cut{c}") for c in ORDER)
    )


def _start(keys: DataFrame) -> list[Column]:
    """A place before all documents of the range."""
    return [F.lit(None).cast(keys.schema[c].dataType) if c != "_range" else F.col("_range") for c in ORDER]


def quality_weight(labels: DataFrame) -> DataFrame:
    """doc_id, weight: 2 for documents labelled good, 0.5 for those labelled bad; the best label counts."""
    best = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_q"))
    return best.select("doc_id", F.when(F.col("_q") > 0, 2.0).otherwise(0.5).alias("weight"))
