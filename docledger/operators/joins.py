"""Joins of the line-item and token algebra: nearest, band, interval, neighbour, positional and lookup joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docledger.functions.text import normalize_key
from docledger.functions.validate import with_triples
from docledger.operators.validation import LINES_SQL, checked_lines
from docledger.plans.catalog import register
from docledger.plans.tables import table

# Header fields and their places, for the nearest-header joins.
HEADERS = (("description", 10.0), ("quantity", 25.0), ("unit_price", 45.0), ("total", 70.0), ("vat", 90.0))
_HEADERS_SQL = "(VALUES " + ", ".join(f"({i}, '{f}', {x}::DOUBLE)" for i, (f, x) in enumerate(HEADERS)) + ") h(o, field, x)"


def _nearest(x):
    """Nearest header of a place, the first on a tie: a fixed handful, so an array in the expression, not a join."""
    options = F.array(*(F.struct(F.abs(x - v).alias("d"), F.lit(i).alias("o"), F.lit(f).alias("field")) for i, (f, v) in enumerate(HEADERS)))
    return F.array_min(options)


@register(
    "nearest_header_join",
    "J3",
    f"""WITH d AS (SELECT event_id, field, abs(value - x) AS dist, row_number() OVER (PARTITION BY event_id ORDER BY abs(value - x), o) AS r
      FROM events, {_HEADERS_SQL}) SELECT field, count(*) AS n, floor(sum(dist) * 100 + 0.5) / 100 AS distance FROM d WHERE r = 1 GROUP BY field""",
)
def nearest_header_join(spark, sf_dir):
    near = _nearest(F.col("value"))
    return (
        table(spark, sf_dir, "events")
        .select(near.alias("h"))
        .groupBy("h.field")
        .agg(F.count("*").alias("n"), (F.floor(F.sum("h.d") * 100 + 0.5) / 100).alias("distance"))
    )


@register(
    "nearest_cell_per_column",
    "J4 O2",
    f"""WITH d AS (SELECT event_id, user_id, field, abs(value - x) AS dist, row_number() OVER (PARTITION BY event_id ORDER BY abs(value - x), o) AS r
      FROM events, {_HEADERS_SQL}), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, field ORDER BY dist, event_id) AS k FROM d WHERE r = 1)
    SELECT user_id, field, event_id, dist FROM b WHERE k = 1""",
)
def nearest_cell_per_column(spark, sf_dir):
    """Best cell of each (row, column): a minimum by structure, which combines before the shuffle."""
    return (
        table(spark, sf_dir, "events")
        .select("user_id", "event_id", _nearest(F.col("value")).alias("h"))
        .groupBy("user_id", F.col("h.field").alias("field"))
        .agg(F.min(F.struct(F.col("h.d").alias("dist"), "event_id")).alias("best"))
        .select("user_id", "field", "best.event_id", "best.dist")
    )


BAND = 1800


@register(
    "band_range_join",
    "J5 P12",
    f"""WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t, event_type FROM events)
    SELECT a.event_id, count(*) AS n, sum(abs(b.t - a.t))::BIGINT AS spread FROM e a JOIN e b ON a.user_id = b.user_id
    AND b.t BETWEEN a.t - {BAND} AND a.t + {BAND} WHERE a.event_type = 'purchase' GROUP BY a.event_id""",
)
def band_range_join(spark, sf_dir):
    """Items within a band of each centre: both sides go by bands of the width, a centre to three of them."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_timestamp("ts").alias("t"), "event_type")
    band = F.floor(F.col("t") / BAND)
    items = e.select("user_id", F.col("t").alias("t_b"), band.alias("band"))
    centres = e.filter("event_type = 'purchase'").withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    return (
        centres.join(items, ["user_id", "band"])
        .filter(F.abs(F.col("t_b") - F.col("t")) <= BAND)
        .groupBy("event_id")
        .agg(F.count("*").alias("n"), F.sum(F.abs(F.col("t_b") - F.col("t"))).alias("spread"))
    )


@register(
    "interval_midpoint_join",
    "J6 W6",
    """WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t, event_type FROM events),
    b AS (SELECT event_id AS anchor, user_id, t, lag(t) OVER w AS p, lead(t) OVER w AS n FROM e WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
    SELECT anchor, count(e.event_id) AS n FROM b JOIN e ON b.user_id = e.user_id AND (p IS NULL OR 2 * e.t >= p + b.t) AND (n IS NULL OR 2 * e.t < b.t + n) GROUP BY anchor""",
)
def interval_midpoint_join(spark, sf_dir):
    """Items between the midpoints to the neighbouring anchors.

    Instead of an inequality join: anchors and items in one order, each item between its last and next anchor.
    """
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_timestamp("ts").alias("t"), "event_type")
    anchor = F.when(F.col("event_type") == "purchase", F.struct("t", "event_id"))
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    peers = Window.partitionBy("user_id").orderBy("t")
    before = F.last(anchor, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(anchor, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    last_at = F.max(anchor).over(peers.rangeBetween(0, 0))
    placed = e.select("t", before.alias("a"), after.alias("b"), last_at.alias("at"))
    inside = F.coalesce((2 * F.col("t") >= F.col("a.t") + F.col("b.t")), F.col("a").isNull())
    chosen = F.when(F.col("at").isNotNull(), F.col("at")).when(inside, F.col("b")).otherwise(F.col("a"))
    return (
        placed.select(chosen["event_id"].alias("anchor"))
        .filter("anchor is not null")
        .groupBy("anchor")
        .agg(F.count("*").alias("n"))
    )


@register(
    "neighbour_offset_merge",
    "J7",
    """WITH o AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_quantity > 25 AS full_row FROM lineitem),
    n AS (SELECT l_orderkey, l_linenumber, l_quantity, full_row,
      lead(CASE WHEN full_row THEN l_quantity END, 1) OVER w AS n1, lag(CASE WHEN full_row THEN l_quantity END, 1) OVER w AS p1,
      lead(CASE WHEN full_row THEN l_quantity END, 2) OVER w AS n2, lag(CASE WHEN full_row THEN l_quantity END, 2) OVER w AS p2
      FROM o WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))
    SELECT CASE WHEN full_row THEN 'own' WHEN n1 IS NOT NULL THEN '+1' WHEN p1 IS NOT NULL THEN '-1' WHEN n2 IS NOT NULL THEN '+2' WHEN p2 IS NOT NULL THEN '-2' ELSE 'none' END AS source,
      count(*) AS n, sum(CASE WHEN full_row THEN l_quantity ELSE coalesce(n1, p1, n2, p2, 0) END) AS quantity FROM n GROUP BY ALL""",
)
def neighbour_offset_merge(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    full = F.when(F.col("l_quantity") > 25, F.col("l_quantity"))
    offsets = (("+1", F.lead(full, 1)), ("-1", F.lag(full, 1)), ("+2", F.lead(full, 2)), ("-2", F.lag(full, 2)))
    near = F.coalesce(*(F.when(x.over(w).isNotNull(), F.struct(F.lit(k).alias("source"), x.over(w).alias("q"))) for k, x in offsets))
    own = F.when(full.isNotNull(), F.struct(F.lit("own").alias("source"), full.alias("q")))
    none = F.struct(F.lit("none").alias("source"), F.lit(0.0).alias("q"))
    return (
        table(spark, sf_dir, "lineitem")
        .select(F.coalesce(own, near, none).alias("m"))
        .groupBy("m.source")
        .agg(F.count("*").alias("n"), F.sum("m.q").alias("quantity"))
    )


@register(
    "positional_zip",
    "J9 F52",
    """WITH a AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS q, list(l_extendedprice ORDER BY l_extendedprice) AS p FROM lineitem GROUP BY l_orderkey),
    z AS (SELECT l_orderkey, unnest(q) AS q, unnest(p) AS p FROM a) SELECT l_orderkey, floor(sum(q * p) * 100 + 0.5) / 100 AS crossed, count(*) AS n FROM z GROUP BY l_orderkey""",
)
def positional_zip(spark, sf_dir):
    """Columns read independently of each other, joined by position."""
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(key)).alias("rows"), F.array_sort(F.collect_list("l_extendedprice")).alias("p")
    )
    crossed = F.aggregate(
        F.arrays_zip(F.col("rows.l_quantity").alias("q"), F.col("p").alias("p")), F.lit(0.0), lambda a, x: a + x["q"] * x["p"]
    )
    return lists.select("l_orderkey", (F.floor(crossed * 100 + 0.5) / 100).alias("crossed"), F.size("p").cast("long").alias("n"))


def _triples(spark, sf_dir, lenient: bool):
    """Best triple (quantity, price, total) of the cells of each line: four cells, so 24 triples, as plain expressions."""
    cells = [F.col(c) for c in ("quantity", "unit_price", "line_total", "vat")]
    return with_triples(checked_lines(spark, sf_dir), cells, "best", lenient, 1).select("best")


def _triples_sql(lenient: bool) -> str:
    off = "abs(floor((c.v - floor(a.v * b.v * 100 + 0.5) / 100) * 100 + 0.5) / 100)"
    bad = f"{off} > greatest(0.05, c.v * 0.02)"
    crossed = "2.0 * ((a.k > b.k)::INT + (b.k > c.k)::INT)"
    score = f"CASE WHEN {bad} THEN 1000.0 ELSE 0.0 END + {off} + {crossed}" if lenient else f"{off} + {crossed}"
    return f"""WITH {LINES_SQL}, numbered AS (SELECT *, row_number() OVER () AS id FROM checked),
    cells AS (SELECT * FROM (SELECT id, unnest([1, 2, 3, 4]) AS k, unnest([quantity, unit_price, line_total, vat]) AS v FROM numbered) WHERE v > 0),
    t AS (SELECT a.id, {score} AS score, a.k AS q, b.k AS p, c.k AS t FROM cells a JOIN cells b ON a.id = b.id AND a.k <> b.k JOIN cells c ON a.id = c.id AND c.k <> a.k AND c.k <> b.k {'' if lenient else f'WHERE NOT ({bad})'}),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score, q, p, t) AS r FROM t)
    SELECT coalesce(q, 0) AS q, coalesce(p, 0) AS p, coalesce(r.t, 0) AS t, count(*) AS n, floor(sum(coalesce(score, 0)) * 100 + 0.5) / 100 AS total_score
    FROM numbered LEFT JOIN (SELECT * FROM r WHERE r = 1) r ON numbered.id = r.id GROUP BY ALL"""


def _summed(triples):
    best = {k: F.coalesce(F.col(f"best.{k}"), F.lit(0)).alias(k) for k in "qpt"}
    return triples.groupBy(*best.values()).agg(
        F.count("*").alias("n"), (F.floor(F.sum(F.coalesce("best.score", F.lit(0.0))) * 100 + 0.5) / 100).alias("total_score")
    )


@register("role_assignment_triples", "J1 J25 P13 O2", _triples_sql(False))
def role_assignment_triples(spark, sf_dir):
    return _summed(_triples(spark, sf_dir, lenient=False))


@register("role_assignment_lenient", "J2", _triples_sql(True))
def role_assignment_lenient(spark, sf_dir):
    return _summed(_triples(spark, sf_dir, lenient=True))


@register(
    "normalized_key_lookup",
    "J10 M10",
    """WITH k AS (SELECT p_partkey, lower(p_name) AS key FROM part), d AS (SELECT key, min(p_partkey) AS first_id FROM k GROUP BY key)
    SELECT first_id, count(*) AS n FROM k JOIN d USING (key) GROUP BY first_id""",
)
def normalized_key_lookup(spark, sf_dir):
    keyed = table(spark, sf_dir, "part").select("p_partkey", normalize_key(F.col("p_name")).alias("key"))
    first = keyed.groupBy("key").agg(F.min("p_partkey").alias("first_id"))
    return keyed.join(first, "key").groupBy("first_id").agg(F.count("*").alias("n"))


@register(
    "alias_or_variant_lookup",
    "J11 M2",
    """WITH rec AS (SELECT p_partkey AS id, lower(p_name) AS key, lower(p_brand) AS alias, lower(p_type) AS variant FROM part),
    q AS (SELECT p_partkey, lower(p_name) AS name, lower(p_brand) AS brand, lower(p_type) AS kind FROM part),
    hits AS (SELECT p_partkey, 0 AS prio, id FROM q JOIN rec ON q.name = rec.key UNION ALL SELECT p_partkey, 1, id FROM q JOIN rec ON brand = alias
      UNION ALL SELECT p_partkey, 1, id FROM q JOIN rec ON kind = variant),
    best AS (SELECT p_partkey, prio, id, row_number() OVER (PARTITION BY p_partkey ORDER BY prio, id) AS r FROM hits)
    SELECT q.p_partkey, b.prio, b.id FROM q LEFT JOIN best b ON q.p_partkey = b.p_partkey AND b.r = 1""",
)
def alias_or_variant_lookup(spark, sf_dir):
    """Key, else alias or variant: each rank is its own equi-join against the first record of a value, never an OR."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey", *(F.lower(c).alias(n) for c, n in (("p_name", "name"), ("p_brand", "brand"), ("p_type", "kind")))
    )
    out = part
    for prio, field in ((0, "name"), (1, "brand"), (1, "kind")):
        first = part.groupBy(field).agg(F.min(F.struct(F.lit(prio).alias("prio"), F.col("p_partkey").alias("id"))).alias(f"by_{field}"))
        out = out.join(first, field, "left")
    return out.select("p_partkey", F.least("by_name", "by_brand", "by_kind").alias("m")).select("p_partkey", "m.prio", "m.id")


@register(
    "token_overlap_top1",
    "J12 U8",
    """WITH n AS (SELECT DISTINCT p_name AS name FROM part), b AS (SELECT p_partkey AS id, list_distinct(string_split(lower(p_type || ' ' || p_name), ' ')) AS t FROM part),
    a AS (SELECT name, list_distinct(string_split(name, ' ')) AS t FROM n), x AS (SELECT name, len(t) AS n_a, unnest(t) AS tok FROM a), y AS (SELECT id, len(t) AS n_b, unnest(t) AS tok FROM b),
    o AS (SELECT name, id, count(*)::DOUBLE / greatest(n_a, n_b) AS score FROM x JOIN y USING (tok) GROUP BY name, id, n_a, n_b),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, id) AS r FROM o WHERE score >= 0.5) SELECT name, id, score FROM r WHERE r = 1""",
)
def token_overlap_top1(spark, sf_dir):
    """Set-similarity join through an inverted index on tokens. Of targets with the same tokens the first one stands for all."""
    part = table(spark, sf_dir, "part")
    tokens = lambda c: F.array_distinct(F.split(c, " "))
    a = part.select("p_name").distinct().select(F.col("p_name").alias("name"), tokens(F.col("p_name")).alias("t"))
    b = part.groupBy(F.array_sort(tokens(F.lower(F.concat_ws(" ", "p_type", "p_name")))).alias("u")).agg(F.min("p_partkey").alias("id"))
    x = a.select("name", F.size("t").alias("n_a"), F.explode("t").alias("tok"))
    y = b.select("id", F.size("u").alias("n_b"), F.explode("u").alias("tok"))
    scored = x.join(y, "tok").groupBy("name", "id", "n_a", "n_b").agg((F.count("*") / F.greatest("n_a", "n_b")).alias("score"))
    best = scored.filter("score >= 0.5").groupBy("name").agg(F.max(F.struct("score", (-F.col("id")).alias("minus"))).alias("m"))
    return best.select("name", (-F.col("m.minus")).alias("id"), "m.score")


def _grams(x, n: int):
    """All runs of n characters."""
    at = F.when(F.length(x) >= n, F.sequence(F.lit(1), F.length(x) - (n - 1)))
    return F.array_distinct(F.coalesce(F.transform(at, lambda i: F.substring(x, i, F.lit(n))), F.array().cast("array<string>")))


def substring_matches(names: DataFrame, stock: DataFrame) -> DataFrame:
    """name, item, id of every pair of which one holds the other. names: name; stock: item, id; all distinct, none empty.

    The shorter text has some run of three characters (all of it, where it is shorter) that the longer one must hold:
    its alphabetically last one is looked up among all runs of the longer text, and the pair is then compared.
    """

    def within(short, a, long, b):
        probe = short.withColumn("gram", F.when(F.length(a) < 3, F.col(a)).otherwise(F.array_max(_grams(F.col(a), 3))))
        held = long.withColumn("gram", F.explode(F.concat(*(_grams(F.col(b), n) for n in (1, 2, 3)))))
        return probe.join(held, "gram").filter(F.col(b).contains(F.col(a))).select("name", "item", "id")

    return within(names, "name", stock, "item").unionByName(within(stock, "item", names, "name")).distinct()


@register(
    "stock_price_substring",
    "J15 P21 A25",
    """WITH q AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN 'fresh ' || p_name ELSE split_part(p_name, ' ', 2) END AS name FROM part WHERE p_partkey % 3 < 2 OR contains(p_name, ' ')),
    s AS (SELECT p_name AS item, min(p_partkey) AS id FROM part GROUP BY 1), x AS (SELECT name, item, id, name = item AS same FROM q JOIN s ON contains(name, item) OR contains(item, name)),
    b AS (SELECT name, id, same, row_number() OVER (PARTITION BY name ORDER BY same DESC, id) AS r FROM x)
    SELECT q.name, p_retailprice AS price, coalesce(same, false) AS exact FROM q LEFT JOIN b ON q.name = b.name AND r = 1 LEFT JOIN part ON p_partkey = b.id""",
)
def stock_price_substring(spark, sf_dir):
    """Price of the stock item of that name, else of the first item whose name holds the name or is held by it."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.concat(F.lit("fresh "), "p_name")).otherwise(F.split_part("p_name", F.lit(" "), F.lit(2)))
    names = part.select(name.alias("name")).filter("name <> ''").distinct()
    stock = part.groupBy(F.col("p_name").alias("item")).agg(F.min("p_partkey").alias("id"))
    best = substring_matches(names, stock).groupBy("name").agg(F.min(F.struct((F.col("name") != F.col("item")).alias("other"), "id")).alias("m"))
    priced = best.select("name", "m.*").join(part.select(k.alias("id"), "p_retailprice"), "id")
    return names.join(priced, "name", "left").select(
        "name", F.col("p_retailprice").alias("price"), F.coalesce(~F.col("other"), F.lit(False)).alias("exact")
    )


@register(
    "recipe_lines_left_join",
    "J16 J17 F74",
    """SELECT o_orderpriority, p_brand, s_name IS NULL AS unmatched, count(*) AS n, sum(l_quantity) AS quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
    LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 GROUP BY ALL""",
)
def recipe_lines_left_join(spark, sf_dir):
    orders, lineitem, part, supplier = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part", "supplier"))
    rich = supplier.filter("s_acctbal > 0").select("s_suppkey", "s_name")
    return (
        orders.select("o_orderkey", "o_orderpriority")
        .join(lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity"), F.expr("o_orderkey = l_orderkey"), "left")
        .join(part.select("p_partkey", "p_brand"), F.expr("l_partkey = p_partkey"), "left")
        .join(rich, F.expr("l_suppkey = s_suppkey"), "left")
        .groupBy("o_orderpriority", "p_brand", F.col("s_name").isNull().alias("unmatched"))
        .agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    )


@register(
    "sales_listing",
    "J18 O6 P20",
    """SELECT o_orderkey, c_name, coalesce(o_orderdate, TIMESTAMP '1900-01-01') AS sold FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment <> 'MACHINERY'
    WHERE o_orderdate IS NULL OR o_orderdate >= TIMESTAMP '1995-01-01' ORDER BY sold DESC, o_orderkey DESC""",
)
def sales_listing(spark, sf_dir):
    """All sales from a date on, and those without a date, the latest first."""
    customer = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'MACHINERY'").select("c_custkey", "c_name")
    return (
        table(spark, sf_dir, "orders")
        .filter("o_orderdate is null or o_orderdate >= timestamp '1995-01-01'")
        .join(customer, F.expr("o_custkey = c_custkey"), "left")
        .select("o_orderkey", "c_name", F.coalesce("o_orderdate", F.lit("1900-01-01").cast("timestamp")).alias("sold"))
        .orderBy(F.desc("sold"), F.desc("o_orderkey"))
    )


@register(
    "semi_anti_coverage",
    "J22 J23 A19",
    """SELECT c_mktsegment, count(*) AS customers, sum((EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT'))::INT)::BIGINT AS covered,
    sum((NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT'))::INT)::BIGINT AS missing FROM customer GROUP BY c_mktsegment""",
)
def semi_anti_coverage(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    both = customer.join(urgent, "c_custkey", "left_semi").withColumn("hit", F.lit(1)).unionByName(
        customer.join(urgent, "c_custkey", "left_anti").withColumn("hit", F.lit(0))
    )
    return both.groupBy("c_mktsegment").agg(
        F.count("*").alias("customers"), F.sum("hit").alias("covered"), F.sum(1 - F.col("hit")).alias("missing")
    )


@register(
    "correction_map_apply",
    "J24 J8 F69 U11",
    """WITH m AS (SELECT lower(p_name) AS raw, max(p_partkey) AS k FROM part WHERE p_size < 10 GROUP BY 1), c AS (SELECT raw, p_type AS fixed FROM m JOIN part ON p_partkey = k)
    SELECT coalesce(fixed, p_name) AS name, count(*) AS n, sum((fixed IS NOT NULL)::INT)::BIGINT AS corrected FROM part LEFT JOIN c ON lower(p_name) = raw GROUP BY 1""",
)
def correction_map_apply(spark, sf_dir):
    """Corrections by raw name, the last one wins; then the corrected names are counted."""
    part = table(spark, sf_dir, "part")
    raw = F.lower("p_name").alias("raw")
    fixes = part.filter("p_size < 10").groupBy(raw).agg(F.max_by("p_type", "p_partkey").alias("fixed"))
    return (
        part.select("p_name", raw)
        .join(fixes, "raw", "left")
        .groupBy(F.coalesce("fixed", "p_name").alias("name"))
        .agg(F.count("*").alias("n"), F.count("fixed").alias("corrected"))
    )
