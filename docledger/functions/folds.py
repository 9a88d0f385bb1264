"""Ordered clustering folds over arrays, in the JVM.

Three families that are not interchangeable: against the last cluster's running mean, against the first cluster within
reach of its running mean, and against the item before (which needs only a window).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EMPTY = "array<struct<centre:double,n:int>>"


def _cluster(centre: Column, n: Column) -> Column:
    return F.struct(centre.cast("double").alias("centre"), n.cast("int").alias("n"))


def _joined(c: Column, x: Column) -> Column:
    return _cluster((c["centre"] * c["n"] + x) / (c["n"] + 1), c["n"] + 1)


def mean_clusters(sorted_values: Column, reach: float) -> Column:
    """Clusters (centre, n): a value joins the last cluster if it is within reach of its mean, else opens one."""

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        near = F.coalesce(F.abs(x - last["centre"]) <= reach, F.lit(False))
        return F.when(near, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(_joined(last, x)))).otherwise(
            F.concat(acc, F.array(_cluster(x, F.lit(1))))
        )

    return F.aggregate(sorted_values, F.array().cast(_EMPTY), step)


def first_fit_clusters(values: Column, reach: float) -> Column:
    """Clusters (centre, n): a value joins the first cluster within reach of its mean, else opens one."""

    def step(acc: Column, x: Column) -> Column:
        fits = F.transform(acc, lambda c: F.abs(c["centre"] - x) <= reach)
        at = F.array_position(fits, True)
        moved = F.transform(acc, lambda c, i: F.when(i + 1 == at, _joined(c, x)).otherwise(c))
        return F.when(at > 0, moved).otherwise(F.concat(acc, F.array(_cluster(x, F.lit(1)))))

    return F.aggregate(values, F.array().cast(_EMPTY), step)
