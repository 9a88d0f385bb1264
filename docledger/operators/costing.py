"""Bills of material, usage, costs, variance and strict gates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from docledger.plans.catalog import register
from docledger.plans.tables import stored, table

def explode_recipes(parts: DataFrame, roots: DataFrame) -> DataFrame:
    """root, part, quantity: what each root needs of every part below it, scaled along the way.

    parts: parent, child, quantity, yield (of the parent); roots: root. One equi-join a level, written as a table, until
    no line has a recipe of its own, however deep that is; a part met on its own path is an error.
    """
    line = F.col("quantity") / F.col("yield")
    level = roots.select("root", F.col("root").alias("node"), F.lit(1.0).alias("scale"), F.array("root").alias("path"))
    found = None
    while found is None or not level.isEmpty():
        below = level.join(parts, level.node == parts.parent).select(
            "root",
            F.col("child").alias("node"),
            # the check stands in a column that is always used, so that pruning cannot drop it
            F.when(F.array_contains("path", F.col("child")), F.raise_error(F.lit("Circular batch recipe detected.")).cast("double"))
            .otherwise(F.col("scale") * line)
            .alias("scale"),
            F.concat("path", F.array("child")).alias("path"),
        )
        level = stored(below, "recipe-level")
        found = level if found is None else found.unionByName(level)
    return found.select("root", F.col("node").alias("part"), F.col("scale").alias("quantity"))


def _bom(spark, sf_dir) -> DataFrame:
    """A hierarchy over the parts: each part is an ingredient of the part of a seventh its number."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter("p_partkey >= 7").select(
        F.floor(key / 7).alias("parent"), key.alias("child"), (F.col("p_size") % 9 + 1).cast("double").alias("quantity"), F.lit(2.0).alias("yield")
    )


_BOM_SQL = """b AS (SELECT p_partkey // 7 AS parent, p_partkey AS child, (p_size % 9 + 1)::DOUBLE AS quantity FROM part WHERE p_partkey >= 7),
x(root, node, scale) AS (SELECT p_partkey, p_partkey, 1.0::DOUBLE FROM part WHERE p_partkey < 7 UNION ALL SELECT root, child, scale * (quantity / 2.0) FROM x JOIN b ON node = parent),
needs AS (SELECT root, node AS part, scale AS quantity FROM x WHERE root <> node)"""


def _exploded(spark, sf_dir) -> DataFrame:
    roots = table(spark, sf_dir, "part").filter("p_partkey < 7").select(F.col("p_partkey").alias("root"))
    return explode_recipes(_bom(spark, sf_dir), roots)


@register("bom_explosion", "J19 B1", f"WITH RECURSIVE {_BOM_SQL} SELECT root, part, quantity FROM needs")
def bom_explosion(spark, sf_dir):
    return _exploded(spark, sf_dir)


@register(
    "recipe_cost",
    "B4 B5 J21",
    f"""WITH RECURSIVE {_BOM_SQL} SELECT root, floor(sum(quantity * CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_retailprice END) + 0.500001) AS cost,
    count(CASE WHEN p_partkey % 5 = 0 THEN 1 END) AS unpriced FROM needs JOIN part ON part = p_partkey GROUP BY root""",
)
def recipe_cost(spark, sf_dir):
    """Missing prices cost nothing and are counted."""
    price = table(spark, sf_dir, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("part"), "p_retailprice")
    costed = _exploded(spark, sf_dir).join(price, "part", "left")
    return costed.groupBy("root").agg(
        F.floor(F.sum(F.col("quantity") * F.coalesce("p_retailprice", F.lit(0.0))) + 0.500001).cast("double").alias("cost"),
        F.count_if(F.col("p_retailprice").isNull()).alias("unpriced"),
    )


@register(
    "usage_by_ingredient",
    "A17 A18 B2",
    """SELECT p_brand, p_name, floor(sum(l_quantity * p_size) * 1000 + 0.5) / 1000 AS used, count(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' GROUP BY p_brand, p_name""",
)
def usage_by_ingredient(spark, sf_dir):
    """Sums per part number first: the join then sees one row a part."""
    used = (
        table(spark, sf_dir, "lineitem")
        .filter("l_shipdate >= timestamp '1994-01-01' and l_shipdate < timestamp '1996-01-01'")
        .groupBy("l_partkey")
        .agg(F.sum("l_quantity").alias("q"), F.count("*").alias("k"))
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name", "p_size")
    return used.join(part, "l_partkey").groupBy("p_brand", "p_name").agg(
        (F.floor(F.sum(F.col("q") * F.col("p_size")) * 1000 + 0.5) / 1000).alias("used"), F.sum("k").alias("lines")
    )


@register(
    "inventory_variance",
    "B3 J20",
    """WITH used AS (SELECT l_partkey, sum(l_quantity) AS expected FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_partkey)
    SELECT p_partkey, p_size * 40.0::DOUBLE + 100 - p_size AS actual, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE coalesce(expected, 0) END AS expected,
    p_size * 40.0::DOUBLE + 100 - p_size - CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE coalesce(expected, 0) END AS variance FROM part LEFT JOIN used ON p_partkey = l_partkey""",
)
def inventory_variance(spark, sf_dir):
    """Opening plus purchases less closing, against expected usage; none is expected where the units differ."""
    used = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'").groupBy("l_partkey").agg(F.sum("l_quantity").alias("e"))
    size = F.col("p_size")
    expected = F.when(F.col("p_partkey") % 7 == 0, 0.0).otherwise(F.coalesce("e", F.lit(0.0)))
    return (
        table(spark, sf_dir, "part")
        .join(used, F.expr("p_partkey = l_partkey"), "left")
        .select("p_partkey", (size * 40.0 + 100 - size).alias("actual"), expected.alias("expected"))
        .withColumn("variance", F.col("actual") - F.col("expected"))
    )


@register(
    "strict_gate",
    "B6 J23 K6 P27",
    """WITH unserved AS (SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')),
    unpriced AS (SELECT count(*) AS n FROM orders WHERE o_totalprice IS NULL OR o_totalprice < 0),
    u AS (SELECT c_mktsegment, floor(sum(o_totalprice) * 100 + 0.5) / 100 AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment)
    SELECT c_mktsegment, CASE WHEN a.n = 0 THEN total END AS total_if_served, CASE WHEN b.n = 0 THEN total END AS total_if_priced, a.n AS unserved, b.n AS unpriced FROM u, unserved a, unpriced b""",
)
def strict_gate(spark, sf_dir):
    """All results or none, behind each of two rules: a single issue closes a gate. The counts of issues are one row."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    done = orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    unserved = customer.join(done, "c_custkey", "left_anti").agg(F.lit(1).alias("_one"), F.count("*").alias("unserved"))
    unpriced = orders.agg(F.lit(1).alias("_one"), F.count_if(F.expr("o_totalprice is null or o_totalprice < 0")).alias("unpriced"))
    totals = (
        orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("t"))
        .join(customer.select("c_custkey", "c_mktsegment"), "c_custkey")
        .groupBy("c_mktsegment")
        .agg((F.floor(F.sum("t") * 100 + 0.5) / 100).alias("total"))
    )
    gated = totals.withColumn("_one", F.lit(1)).join(unserved.join(unpriced, "_one"), "_one")
    return gated.select(
        "c_mktsegment",
        F.when(F.col("unserved") == 0, F.col("total")).alias("total_if_served"),
        F.when(F.col("unpriced") == 0, F.col("total")).alias("total_if_priced"),
        "unserved",
        "unpriced",
    )


def ratio(a: str, b: str) -> float:
    """Share of characters in matching blocks, times 100."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a.lower(), b.lower()).ratio() * 100


@F.pandas_udf(DoubleType())
def ratio_udf(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def _letters_bound(a, b):
    """No ratio of two texts is above this: twice the letters they share, over all their letters, times 100."""
    of = lambda text, x: F.length(text) - F.length(F.replace(text, x, F.lit("")))
    letters = F.array_distinct(F.filter(F.split(a, ""), lambda x: x != ""))
    shared = F.aggregate(letters, F.lit(0), lambda n, x: n + F.least(of(a, x), of(b, x)))
    return shared * 200.0 / F.greatest(F.length(a) + F.length(b), F.lit(1))


def best_ratios(sold: DataFrame, menu: DataFrame) -> DataFrame:
    """sold, m (score, menu): the best ratio among all names of the menu, null where the menu is empty.

    sold: sold; menu: menu; both distinct. The best among names that share a word is a floor; all other names whose
    lengths and letters allow a ratio that high are compared too. Pairs meet by their lengths.
    """
    slack = 1e-6
    worded = sold.withColumn("word", F.explode(F.split("sold", " "))).join(menu.withColumn("word", F.explode(F.split("menu", " "))), "word")
    scored = worded.select("sold", "menu").distinct().withColumn("score", ratio_udf("sold", "menu"))
    floors = scored.groupBy("sold").agg(F.max("score").alias("floor"))
    a = sold.join(floors, "sold", "left").select("sold", F.coalesce("floor", F.lit(0.0)).alias("floor"), F.length(F.lower("sold")).alias("n_a"))
    b = menu.withColumn("n_b", F.length(F.lower("menu")))
    reach = F.least("n_a", "n_b") * 200.0 / F.greatest(F.col("n_a") + F.col("n_b"), F.lit(1)) >= F.col("floor") - slack
    near = a.join(b.select("n_b").distinct(), (F.col("n_a") + F.col("n_b") == 0) | reach).join(b, "n_b")
    near = near.filter((F.col("n_a") + F.col("n_b") == 0) | (_letters_bound(F.lower("sold"), F.lower("menu")) >= F.col("floor") - slack))
    best = near.withColumn("score", ratio_udf("sold", "menu")).groupBy("sold").agg(F.max(F.struct("score", "menu")).alias("m"))
    return sold.join(best, "sold", "left")


@register("fuzzy_ratio_best", "J14 F47")
def fuzzy_ratio_best(spark, sf_dir):
    """Best menu name for each sold name, by ratio among all of them."""
    part = table(spark, sf_dir, "part")
    menu = part.select(F.col("p_name").alias("menu")).distinct()
    sold = part.select(F.concat(F.substring("p_name", 1, 3), F.lit("x"), F.expr("substring(p_name, 4)")).alias("sold")).distinct()
    best = best_ratios(sold, menu)
    return best.select("sold", "m.menu", "m.score", F.when(F.col("m.score") >= 95, "auto").otherwise("needs_review").alias("status"))
