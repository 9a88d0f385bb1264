"""Arithmetic validation of a line: quantity x unit price against its total."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.plans.tables import once


def cents(x: Column) -> Column:
    """Rounds half up to cents in plain double arithmetic, the same on any engine."""
    return F.floor(x * 100 + 0.5) / 100


def validation_status(quantity: Column, price: Column, total: Column) -> Column:
    """ok, failed or missing: the total may differ by 0.05 or 2 %, whichever is more."""
    off = F.abs(cents(total - cents(quantity * price)))
    return (
        F.when(quantity.isNull() | price.isNull() | total.isNull(), "missing")
        .when(off <= F.greatest(F.lit(0.05), F.abs(total) * 0.02), "ok")
        .otherwise("failed")
    )


def loose_match(quantity: Column, price: Column, total: Column) -> Column:
    """The more tolerant test of scanned lines: 0.20 or 4 %; no or zero total counts as a match."""
    off = F.abs(total - quantity * price)
    return F.when(total.isNull() | (total == 0), True).otherwise(
        F.coalesce(off <= F.greatest(F.lit(0.2), F.abs(total) * 0.04), F.lit(False))
    )


def with_triples(rows: DataFrame, cells: list[Column], to: str, lenient: bool = False, first: int = 0) -> DataFrame:
    """``rows`` with a struct ``to``: score, q, p, t of the best triple (quantity, price, total) of positive cells; null for none.

    A score is what the product is off, and 2 for each pair out of order; of equal ones the first by place counts, places
    count from ``first``. Lenient: more than 0.05 or 2 % off costs 1,000; else it rules the triple out. Products serve both
    orders of a pair. The steps are columns of their own, so that each compiles to a method that is short enough for the JVM.
    """
    n = range(len(cells))
    pairs, every = list(combinations(n, 2)), list(permutations(n, 3))
    triples = [(pair, t) for pair in pairs for t in n if t not in pair]
    c, product, off, bad = (lambda *at, name=name: F.col("_" + name + "_".join(map(str, at))) for name in ("c", "m", "o", "b"))
    name = lambda kind, *at: f"_{kind}" + "_".join(map(str, at))
    step = once(rows, **{name("c", i): F.when(x > 0, x) for i, x in enumerate(cells)})
    step = once(step, **{name("m", *pair): cents(c(pair[0]) * c(pair[1])) for pair in pairs})
    step = once(step, **{name("o", *pair, t): F.abs(cents(c(t) - product(*pair))) for pair, t in triples})
    step = once(step, **{name("b", *pair, t): off(*pair, t) > F.greatest(F.lit(0.05), c(t) * 0.02) for pair, t in triples})

    def score(q: int, p: int, t: int) -> Column:
        at = (*sorted((q, p)), t)
        plain = off(*at) + 2.0 * ((q > p) + (p > t))
        return F.when(bad(*at), plain + 1000.0 if lenient else None).otherwise(plain)

    step = once(step, _scores=F.array(*(score(*some) for some in every)))
    step = once(step, _best=F.array_min("_scores"))
    nth = F.array_position("_scores", F.col("_best")).cast("int") - 1
    place = lambda k: F.get(F.array(*(F.lit(some[k] + first) for some in every)), nth)
    best = F.when(F.col("_best").isNotNull(), F.struct(F.col("_best").alias("score"), place(0).alias("q"), place(1).alias("p"), place(2).alias("t")))
    return step.select(*rows.columns, best.alias(to))
