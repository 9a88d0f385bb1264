"""Order-dependent operators: latches, continuations, groups, gaps and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docledger.functions.folds import first_fit_clusters, mean_clusters
from docledger.functions.text import clean_cell, sql_row_role, with_role
from docledger.plans.catalog import register
from docledger.plans.tables import table


def text_lines(spark, sf_dir) -> DataFrame:
    """The documents' lines, cleaned: doc_id, idx, line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    return docs.select("doc_id", "idx", clean_cell(F.col("line")).alias("line"))


TEXT_LINES_SQL = r"""split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
text_lines AS (SELECT doc_id, unnest(range(len(l))) AS idx, trim(regexp_replace(unnest(l), '\s+', ' ', 'g')) AS line FROM split)"""

def _by_line(first: int = Window.unboundedPreceding, last: int = 0):
    """Rows of a document's lines around each, by default all up to it."""
    return Window.partitionBy("doc_id").orderBy("idx").rowsBetween(first, last)


@register(
    "in_table_prefix",
    "P8 P14 W1 G25",
    f"""WITH {TEXT_LINES_SQL}, f AS (SELECT *, bool_or(regexp_matches(lower(line), '^(the|die|les|los)')) OVER w AS opened,
      bool_or(regexp_matches(lower(line), 'licen|gnu')) OVER w AS closed FROM text_lines WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
    SELECT doc_id, count(*) AS n, sum(length(line))::BIGINT AS chars FROM f WHERE opened AND NOT closed GROUP BY doc_id""",
)
def in_table_prefix(spark, sf_dir):
    """Lines from the first that opens a table up to the first that ends it."""
    low = F.lower("line")
    flagged = text_lines(spark, sf_dir).select(
        "*",
        F.bool_or(low.rlike("^(the|die|les|los)")).over(_by_line()).alias("opened"),
        F.bool_or(low.rlike("licen|gnu")).over(_by_line()).alias("closed"),
    )
    return flagged.filter("opened and not closed").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum(F.length("line")).alias("chars")
    )


_HEAD = "length(line) > 120"


@register(
    "continuation_attach",
    "W2 P10 U1",
    f"""WITH {TEXT_LINES_SQL}, g AS (SELECT *, sum(({_HEAD})::INT) OVER (PARTITION BY doc_id ORDER BY idx) AS grp FROM text_lines WHERE line <> '')
    SELECT doc_id, grp::BIGINT AS grp, count(*) - 1 AS wraps, md5(string_agg(line, ' ' ORDER BY idx)) AS joined,
    floor(greatest(0.1, 0.9 - 0.04 * (count(*) - 1)) * 100 + 0.5) / 100 AS confidence FROM g WHERE grp > 0 GROUP BY doc_id, grp""",
)
def continuation_attach(spark, sf_dir):
    """Short lines continue the last long one; each costs confidence."""
    grouped = text_lines(spark, sf_dir).filter("line <> ''").withColumn("grp", F.sum(F.expr(_HEAD).cast("int")).over(_by_line()))
    wraps = F.count("*") - 1
    return (
        grouped.filter("grp > 0")
        .groupBy("doc_id", "grp")
        .agg(
            wraps.alias("wraps"),
            F.md5(F.array_join(F.array_sort(F.collect_list(F.struct("idx", "line")))["line"], " ").cast("binary")).alias("joined"),
            (F.floor(F.greatest(F.lit(0.1), 0.9 - 0.04 * wraps) * 100 + 0.5) / 100).alias("confidence"),
        )
    )


@register(
    "text_row_groups",
    "W3",
    """WITH e AS (SELECT user_id, event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    f AS (SELECT *, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY r) = 'purchase' AND event_type <> 'purchase', false) AS opens FROM e),
    g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY r) AS grp FROM f)
    SELECT user_id, count(DISTINCT grp) AS groups, max(n)::BIGINT AS longest FROM (SELECT *, count(*) OVER (PARTITION BY user_id, grp) AS n FROM g) GROUP BY user_id""",
)
def text_row_groups(spark, sf_dir):
    """A group opens with the first line after a code."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    opens = (F.lag("event_type").over(order) == "purchase") & (F.col("event_type") != "purchase")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", F.coalesce(opens, F.lit(False)).cast("int").alias("o"))
    grouped = e.withColumn("grp", F.sum("o").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("user_id", "grp").count().groupBy("user_id").agg(
        F.count("*").alias("groups"), F.max("count").alias("longest")
    )


_GAPS_SQL = """g AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) AS gap FROM events)"""


@register(
    "gap_variance",
    "W4",
    f"""WITH {_GAPS_SQL} SELECT user_id, floor(greatest(0, 1 - (max(gap) - min(gap)) / avg(gap)) * 10000 + 0.5) / 10000 AS confidence, count(gap) AS gaps FROM g GROUP BY user_id""",
)
def gap_variance(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("value", "event_id")
    gaps = table(spark, sf_dir, "events").select("user_id", (F.col("value") - F.lag("value").over(order)).alias("gap"))
    score = F.greatest(F.lit(0.0), 1 - (F.max("gap") - F.min("gap")) / F.avg("gap"))
    return gaps.groupBy("user_id").agg((F.floor(score * 10000 + 0.5) / 10000).alias("confidence"), F.count("gap").alias("gaps"))


@register(
    "vertical_spacing",
    "W5 A23",
    f"""WITH {_GAPS_SQL}, m AS (SELECT user_id, median(gap) AS m FROM g WHERE gap IS NOT NULL GROUP BY user_id)
    SELECT g.user_id, floor(any_value(m) * 10000 + 0.5) / 10000 AS median_gap, floor(median(abs(gap - m)) * 10000 + 0.5) / 10000 AS mad,
    floor(greatest(0, least(1, 1 - 2 * median(abs(gap - m)) / any_value(m))) * 1000 + 0.5) / 1000 AS score FROM g JOIN m ON g.user_id = m.user_id WHERE gap IS NOT NULL GROUP BY g.user_id""",
)
def vertical_spacing(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("value", "event_id")
    gaps = table(spark, sf_dir, "events").select("user_id", (F.col("value") - F.lag("value").over(order)).alias("gap")).filter("gap is not null")
    medians = gaps.groupBy("user_id").agg(F.median("gap").alias("m"))
    off = gaps.join(medians, "user_id").groupBy("user_id", "m").agg(F.median(F.abs(F.col("gap") - F.col("m"))).alias("mad"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 2 * F.col("mad") / F.col("m")))
    return off.select(
        "user_id",
        (F.floor(F.col("m") * 10000 + 0.5) / 10000).alias("median_gap"),
        (F.floor(F.col("mad") * 10000 + 0.5) / 10000).alias("mad"),
        (F.floor(score * 1000 + 0.5) / 1000).alias("score"),
    )


GAP_SECONDS = 3600


@register(
    "gap_chain_clusters",
    "G8 A22",
    f"""WITH e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS t, value FROM events),
    f AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > {GAP_SECONDS}, false)::INT AS b FROM e),
    c AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, event_id) AS c FROM f)
    SELECT user_id, c::BIGINT AS cluster, count(*) AS n, min(t) AS start_t, max(t) AS end_t, min(value) AS low, max(value) AS high FROM c GROUP BY user_id, c""",
)
def gap_chain_clusters(spark, sf_dir):
    """An item further than the gap from the one before it opens a cluster; the clusters' boxes."""
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("t"), "value")
    broken = F.coalesce(F.col("t") - F.lag("t").over(order) > GAP_SECONDS, F.lit(False)).cast("int")
    placed = e.withColumn("b", broken).withColumn("cluster", F.sum("b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.groupBy("user_id", "cluster").agg(
        F.count("*").alias("n"), F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def _fold_sql(first_fit: bool, reach: int) -> str:
    order = "ts, event_id" if first_fit else "value, event_id"
    if first_fit:
        hit = f"list_position(list_transform(centres, lambda c: abs(c - x) <= {reach}), true)"
        centres = "list_transform(centres, lambda c, i: CASE WHEN i = pos THEN (c * ns[i] + x) / (ns[i] + 1) ELSE c END)"
        ns = "list_transform(ns, lambda c, i: CASE WHEN i = pos THEN c + 1 ELSE c END)"
    else:
        hit = f"CASE WHEN abs(centres[len(centres)] - x) <= {reach} THEN len(centres) ELSE 0 END"
        centres = "list_transform(centres, lambda c, i: CASE WHEN i = pos THEN (c * ns[i] + x) / (ns[i] + 1) ELSE c END)"
        ns = "list_transform(ns, lambda c, i: CASE WHEN i = pos THEN c + 1 ELSE c END)"
    return f"""WITH RECURSIVE v AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS r FROM events),
    f(user_id, r, centres, ns) AS (SELECT user_id, r, [x], [1] FROM v WHERE r = 1 UNION ALL
      SELECT user_id, r, CASE WHEN pos > 0 THEN {centres} ELSE list_append(centres, x) END, CASE WHEN pos > 0 THEN {ns} ELSE list_append(ns, 1) END
      FROM (SELECT f.user_id, v.r, centres, ns, x, coalesce({hit}, 0) AS pos FROM f JOIN v ON f.user_id = v.user_id AND v.r = f.r + 1))
    SELECT user_id, len(centres)::BIGINT AS clusters, list_max(ns)::BIGINT AS largest, floor(list_sum(centres) * 100 + 0.5) / 100 AS centre_sum FROM f
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY r DESC) = 1"""


def _fold(spark, sf_dir, first_fit: bool):
    key = F.struct("ts", "event_id", "value") if first_fit else F.struct("value", "event_id")
    items = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(key))["value"].alias("v"))
    fold = first_fit_clusters(F.col("v"), 20.0) if first_fit else mean_clusters(F.col("v"), 5.0)
    c = items.select("user_id", fold.alias("c"))
    centre_sum = F.aggregate("c", F.lit(0.0), lambda a, x: a + x["centre"])
    return c.select(
        "user_id",
        F.size("c").cast("long").alias("clusters"),
        F.array_max(F.col("c.n")).cast("long").alias("largest"),
        (F.floor(centre_sum * 100 + 0.5) / 100).alias("centre_sum"),
    )


@register("centroid_clusters", "G1 G2 G3 G4 G6 G7 G9 G12 O1", _fold_sql(False, 5))
def centroid_clusters(spark, sf_dir):
    return _fold(spark, sf_dir, first_fit=False)


@register("first_fit_clusters", "G5 G10 G11 G13", _fold_sql(True, 20))
def first_fit(spark, sf_dir):
    return _fold(spark, sf_dir, first_fit=True)


@register(
    "title_carry_forward",
    "W9 S13",
    f"""WITH {TEXT_LINES_SQL}, t AS (SELECT *, last_value(CASE WHEN len(string_split(line, ' ')) = 1 AND line <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx) AS title FROM text_lines)
    SELECT doc_id, coalesce(title, '') AS title, count(*) AS n FROM t WHERE line <> '' GROUP BY ALL""",
)
def title_carry_forward(spark, sf_dir):
    """A line of one word titles the lines below it."""
    one = F.when((F.size(F.split("line", " ")) == 1) & (F.col("line") != ""), F.col("line"))
    titled = text_lines(spark, sf_dir).withColumn("title", F.last(one, ignorenulls=True).over(_by_line()))
    return titled.filter("line <> ''").groupBy("doc_id", F.coalesce("title", F.lit("")).alias("title")).agg(F.count("*").alias("n"))


@register(
    "look_around",
    "W10 W6",
    f"""WITH {TEXT_LINES_SQL}, t AS (SELECT *, last_value(CASE WHEN length(line) < 40 THEN idx END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS back,
      first_value(CASE WHEN length(line) > 200 THEN idx END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS ahead FROM text_lines)
    SELECT doc_id, count(back) AS with_title, count(ahead) AS with_body, sum(idx - coalesce(back, idx))::BIGINT AS back_rows FROM t GROUP BY doc_id""",
)
def look_around(spark, sf_dir):
    """Nearest short line within three rows above, first long one within seven below."""
    back = F.last(F.when(F.length("line") < 40, F.col("idx")), ignorenulls=True).over(_by_line(-3, -1))
    ahead = F.first(F.when(F.length("line") > 200, F.col("idx")), ignorenulls=True).over(_by_line(1, 7))
    seen = text_lines(spark, sf_dir).select("doc_id", "idx", back.alias("back"), ahead.alias("ahead"))
    return seen.groupBy("doc_id").agg(
        F.count("back").alias("with_title"), F.count("ahead").alias("with_body"), F.sum(F.col("idx") - F.coalesce("back", "idx")).alias("back_rows")
    )


@register(
    "row_role_counts",
    "X6 A3",
    f"WITH {TEXT_LINES_SQL} SELECT role, count(*) AS n FROM (SELECT {sql_row_role('line')} AS role FROM text_lines) GROUP BY role",
)
def row_role_counts(spark, sf_dir):
    return with_role(text_lines(spark, sf_dir), F.col("line")).groupBy("role").agg(F.count("*").alias("n"))
