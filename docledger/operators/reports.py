"""Aggregations of the quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.operators.validation import LINES_SQL, checked_lines
from docledger.plans.catalog import register
from docledger.plans.tables import table


@register(
    "supplier_reason_counts",
    "A3 A4",
    f"""WITH {LINES_SQL} SELECT n_name, status, count(*) AS n FROM checked JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    WHERE status <> 'ok' GROUP BY ROLLUP (n_name, status)""",
)
def supplier_reason_counts(spark, sf_dir):
    """Nation x status with subtotals; lines are counted per supplier before the small joins."""
    counts = checked_lines(spark, sf_dir).filter("status <> 'ok'").groupBy("l_suppkey", "status").agg(F.count("*").alias("k"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return counts.join(supplier, "l_suppkey").join(nation, "s_nationkey").rollup("n_name", "status").agg(F.sum("k").alias("n"))


@register(
    "top_reasons",
    "O4 O5 O7 A24",
    f"""WITH {LINES_SQL}, c AS (SELECT l_suppkey, status, count(*) AS n FROM checked WHERE status <> 'ok' GROUP BY ALL)
    SELECT l_suppkey, status, n FROM c ORDER BY n DESC, l_suppkey, status LIMIT 12""",
)
def top_reasons(spark, sf_dir):
    """The twelve most frequent: a top-k report."""
    counts = checked_lines(spark, sf_dir).filter("status <> 'ok'").groupBy("l_suppkey", "status").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "l_suppkey", "status").limit(12)


@register(
    "evidence_first_n",
    "A24 P24",
    f"""WITH {LINES_SQL}, r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, quantity, line_total, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, quantity, line_total) AS k FROM checked WHERE status = 'failed')
    SELECT l_suppkey, l_orderkey, l_linenumber, k FROM r WHERE k <= 5""",
)
def evidence_first_n(spark, sf_dir):
    """First five failures of each supplier: a top-k report; the window keeps five rows a group and task before the shuffle."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "quantity", "line_total")
    failed = checked_lines(spark, sf_dir).filter("status = 'failed'").withColumn("k", F.row_number().over(w)).filter("k <= 5")
    return failed.select("l_suppkey", "l_orderkey", "l_linenumber", F.col("k").cast("long").alias("k"))


@register(
    "run_summary",
    "A1 A2 A6 A8 A10 K5 K9",
    f"""WITH {LINES_SQL}, files AS (SELECT o_orderkey, count(l_orderkey) AS n, count(CASE WHEN status = 'ok' THEN 1 END) AS ok, count(CASE WHEN status = 'missing' THEN 1 END) AS lost FROM orders LEFT JOIN checked ON o_orderkey = l_orderkey GROUP BY o_orderkey)
    SELECT count(*) AS files, count(CASE WHEN n = 0 THEN 1 END) AS empty_files, sum(n)::BIGINT AS rows, sum(ok)::BIGINT AS validated, sum(n - ok - lost)::BIGINT AS review, sum(lost)::BIGINT AS discarded,
    floor(sum(ok)::DOUBLE / sum(n) * 1000 + 0.5) / 10 AS pass_rate, floor(avg(CASE WHEN n = 0 THEN 0 ELSE ok::DOUBLE / n END) * 10000 + 0.5) / 10000 AS mean_file_rate FROM files""",
)
def run_summary(spark, sf_dir):
    lines = checked_lines(spark, sf_dir).groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "missing").alias("lost")
    )
    files = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.expr("o_orderkey = l_orderkey"), "left").fillna(0, ["n", "ok", "lost"])
    rate = F.when(F.col("n") == 0, 0.0).otherwise(F.col("ok") / F.col("n"))
    return files.agg(
        F.count("*").alias("files"),
        F.count_if(F.col("n") == 0).alias("empty_files"),
        F.sum("n").alias("rows"),
        F.sum("ok").alias("validated"),
        F.sum(F.col("n") - F.col("ok") - F.col("lost")).alias("review"),
        F.sum("lost").alias("discarded"),
        (F.floor(F.sum("ok") / F.sum("n") * 1000 + 0.5) / 10).alias("pass_rate"),
        (F.floor(F.avg(rate) * 10000 + 0.5) / 10000).alias("mean_file_rate"),
    )


@register(
    "proposal_partial_final",
    "A5 U11",
    """SELECT map_from_entries(list((o_orderpriority, n) ORDER BY o_orderpriority))::VARCHAR AS merged, sum(n)::BIGINT AS total FROM
    (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority)""",
)
def proposal_partial_final(spark, sf_dir):
    """Counters per part, then merged; written like a map."""
    parts = table(spark, sf_dir, "orders").groupBy(F.pmod("o_custkey", F.lit(16)).alias("part"), "o_orderpriority").count()
    merged = parts.groupBy("o_orderpriority").agg(F.sum("count").alias("n"))
    entry = F.concat(F.col("o_orderpriority"), F.lit("="), F.col("n").cast("string"))
    return merged.agg(
        F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(entry)), ", "), F.lit("}")).alias("merged"), F.sum("n").alias("total")
    )


@register(
    "coverage_any_all",
    "A7 A9 P13",
    """SELECT o_orderpriority, count(*) AS orders, sum(any_large::INT)::BIGINT AS any_large, sum(all_large::INT)::BIGINT AS all_large, floor(avg(mean_q) * 1000 + 0.5) / 1000 AS mean_quantity FROM
    (SELECT l_orderkey, bool_or(l_quantity > 40) AS any_large, bool_and(l_quantity > 10) AS all_large, avg(l_quantity) AS mean_q FROM lineitem GROUP BY l_orderkey) JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority""",
)
def coverage_any_all(spark, sf_dir):
    q = F.col("l_quantity")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.bool_or(q > 40).alias("any_large"), F.bool_and(q > 10).alias("all_large"), F.avg(q).alias("mean_q")
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return lines.join(orders, "l_orderkey").groupBy("o_orderpriority").agg(
        F.count("*").alias("orders"),
        F.count_if("any_large").alias("any_large"),
        F.count_if("all_large").alias("all_large"),
        (F.floor(F.avg("mean_q") * 1000 + 0.5) / 1000).alias("mean_quantity"),
    )


@register(
    "confidence_stats",
    "A14 A16",
    """SELECT event_type, count(*) AS n, floor(avg(value / 100) * 1000 + 0.5) / 1000 AS mean, floor(median(value / 100) * 1000 + 0.5) / 1000 AS median, min(value / 100) AS low, max(value / 100) AS high,
    floor(stddev_samp(value / 100) * 1000 + 0.5) / 1000 AS stdev FROM events GROUP BY event_type""",
)
def confidence_stats(spark, sf_dir):
    c = F.col("value") / 100
    r = lambda x: F.floor(x * 1000 + 0.5) / 1000
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), r(F.avg(c)).alias("mean"), r(F.median(c)).alias("median"), F.min(c).alias("low"), F.max(c).alias("high"), r(F.stddev_samp(c)).alias("stdev")
    )


# Edges of the confidence histogram.
EDGES = (0.0, 0.2, 0.4, 0.6, 0.7, 0.8, 0.9, 1.0)
_BINS = " ".join(
    f"WHEN c >= {a} AND (c < {b} OR ({b} = 1.0 AND c = 1.0)) THEN {i}" for i, (a, b) in enumerate(zip(EDGES[:-1], EDGES[1:], strict=True))
)


@register(
    "confidence_histogram",
    "A15",
    f"SELECT event_type, CASE {_BINS} ELSE -1 END AS bin, count(*) AS n FROM (SELECT event_type, value / 100 AS c FROM events) GROUP BY ALL",
)
def confidence_histogram(spark, sf_dir):
    """Bins are open to the right; the last is closed at 1.0; what lies outside has bin -1."""
    c = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 100).alias("c"))
    return c.groupBy("event_type", F.expr(f"CASE {_BINS} ELSE -1 END").alias("bin")).agg(F.count("*").alias("n"))


@register(
    "bucket_average",
    "A16 C6",
    """SELECT CASE WHEN p_size >= 33 THEN 'high' WHEN p_size >= 18 THEN 'medium' ELSE 'low' END AS category, count(*) AS n, floor(avg(p_retailprice) * 1000 + 0.5) / 1000 AS mean_price FROM part GROUP BY 1""",
)
def bucket_average(spark, sf_dir):
    size = F.col("p_size")
    category = F.when(size >= 33, "high").when(size >= 18, "medium").otherwise("low")
    return table(spark, sf_dir, "part").groupBy(category.alias("category")).agg(
        F.count("*").alias("n"), (F.floor(F.avg("p_retailprice") * 1000 + 0.5) / 1000).alias("mean_price")
    )


@register(
    "duplicate_names_having",
    "A19 P27",
    "SELECT p_name, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY p_name HAVING count(*) > 1",
)
def duplicate_names_having(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id")).filter("n > 1")


@register(
    "bounding_boxes_and_medians",
    "A22 A23",
    """WITH e AS (SELECT user_id, value AS x, length(event_type)::DOUBLE AS w, floor(epoch(ts)) / 3600 AS y FROM events), l AS (SELECT user_id, list(x ORDER BY x) AS v FROM e GROUP BY user_id)
    SELECT e.user_id, min(x) AS x0, max(x) + max(w) AS x1, min(y) AS y0, max(y) AS y1, any_value(v)[len(any_value(v)) // 2 + 1] AS upper_median, median(x) AS true_median FROM e JOIN l ON e.user_id = l.user_id GROUP BY e.user_id""",
)
def bounding_boxes_and_medians(spark, sf_dir):
    """Boxes end at the largest x plus the largest width; the upper median takes the later of two middles."""
    e = table(spark, sf_dir, "events").select(
        "user_id", F.col("value").alias("x"), F.length("event_type").cast("double").alias("w"), (F.unix_timestamp("ts") / 3600).alias("y")
    )
    return e.groupBy("user_id").agg(
        F.min("x").alias("x0"),
        (F.max("x") + F.max("w")).alias("x1"),
        F.min("y").alias("y0"),
        F.max("y").alias("y1"),
        F.element_at(F.array_sort(F.collect_list("x")), F.floor(F.count("x") / 2).cast("int") + 1).alias("upper_median"),
        F.median("x").alias("true_median"),
    )


@register(
    "diagnostics_completeness",
    "A11 A12 A13 C7 B17",
    """WITH d AS (SELECT d.doc_id, lang, text, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    f AS (SELECT lang, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN contains(text, '@') THEN 'contact' WHEN regexp_matches(text, '[0-9]{6}') THEN 'numbers' WHEN quality IS NULL THEN 'unlabelled' WHEN quality = 0 THEN 'poor' ELSE 'clean' END AS assessment,
      contains(text, '@') AS p1, regexp_matches(text, '[0-9]{6}') AS p2, contains(text, '|') AS p3, quality, toxic FROM d)
    SELECT lang, assessment, count(*) AS n, count(quality) AS labelled, coalesce(sum(toxic), 0)::BIGINT AS toxic, sum(p1::INT + p2::INT + p3::INT)::BIGINT AS findings FROM f GROUP BY ALL""",
)
def diagnostics_completeness(spark, sf_dir):
    """First assessment that applies, and all findings: a row can have several."""
    text, labels = F.col("text"), table(spark, sf_dir, "labels")
    flags = [text.contains("@"), text.rlike("[0-9]{6}"), text.contains("|")]
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        F.when(text.isNull() | (text == ""), "empty").when(flags[0], "contact").when(flags[1], "numbers").alias("first"),
        sum((f.cast("int") for f in flags), F.lit(0)).alias("findings"),
    )
    q = F.col("quality")
    assessment = F.coalesce("first", F.when(q.isNull(), "unlabelled").when(q == 0, "poor").otherwise("clean"))
    return docs.join(labels, "doc_id", "left").groupBy("lang", assessment.alias("assessment")).agg(
        F.count("*").alias("n"), F.count("quality").alias("labelled"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.sum("findings").alias("findings")
    )


@register(
    "header_frequency",
    "A26 G24",
    """SELECT user_id, event_type, count(*) AS n, floor(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id) * 1000 + 0.5) / 1000 AS share FROM events GROUP BY user_id, event_type""",
)
def header_frequency(spark, sf_dir):
    from pyspark.sql.window import Window

    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))
    return counts.withColumn("share", F.floor(share * 1000 + 0.5) / 1000)
