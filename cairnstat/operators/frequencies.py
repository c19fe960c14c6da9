"""Cumulative frequencies of values within groups of any size, and order statistics read from them.

Values are reduced to counts first, so a value that a third of all rows share is one row.
A column of more than ROWS_PER_RANGE rows is cut into ranges at its own quantiles, whose
number follows the number of rows; each
(group, range) cell is sorted and summed by a window of its own and the totals of the
lower ranges are added as offsets. No group is ever gathered in one task. A shorter column
is one range, so its groups are windows over at most ROWS_PER_RANGE rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..session import materialize

VALUE, COUNT = "_cs_value", "_cs_n"
RANGES = 1024
ROWS_PER_RANGE = 200_000


def frequencies(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """groups, _cs_value, _cs_n of the values that are neither null nor NaN; -0.0 is 0.0."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*groups, (v + F.lit(0.0)).alias(VALUE)).agg(F.count("*").alias(COUNT))


def split_points(df: DataFrame, value: str) -> list[float]:
    """Upper bounds of the ranges: quantiles of the column, one range for every ROWS_PER_RANGE rows.

    One pass gives RANGES quantiles, enough for RANGES * ROWS_PER_RANGE rows; a longer
    column is read once more for as many as it needs.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v))
    quantiles = lambda k: F.percentile_approx(v, [i / k for i in range(1, k)], 20 * k)
    n, points = rows.agg(F.count("*"), quantiles(RANGES)).first()
    wanted = -(-n // ROWS_PER_RANGE)
    if wanted <= 1:
        return []
    if wanted > RANGES:
        points, step = rows.agg(quantiles(wanted)).first()[0], 1
    else:
        step = max(1, RANGES // wanted)
    return sorted(set(points[step - 1 :: step]))


def range_of(value: Column, points: list[float]) -> Column:
    """How many split points lie below the value, by binary search in a literal array."""
    if not points:
        return F.lit(0)
    bounds = F.array(*[F.lit(float(x)) for x in points])
    step = 1 << (len(points).bit_length() - 1)
    steps = []
    while step:
        steps.append(F.lit(step))
        step >>= 1
    return F.aggregate(F.array(*steps), F.lit(0), lambda lo, s: F.when(F.get(bounds, lo + s - 1) < value, lo + s).otherwise(lo))


def cumulate(rows: DataFrame, groups: list[str], points: list[float], order: list[str] | None = None, tag: str = "cumulative") -> DataFrame:
    """rows with _cs_cum (count of the group up to and including the row) and _cs_total, in the order of _cs_value and then ``order``."""
    order = order or []
    if not points:
        by = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
        return rows.withColumns({"_cs_cum": F.sum(COUNT).over(by.orderBy(VALUE, *order).rowsBetween(W.unboundedPreceding, W.currentRow)), "_cs_total": F.sum(COUNT).over(by)})
    cells = [*groups, "_cs_range"]
    rows = rows.withColumn("_cs_range", range_of(F.col(VALUE), points))
    within = W.partitionBy(*cells).orderBy(VALUE, *order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = materialize(rows.withColumn("_cs_run", F.sum(COUNT).over(within)), tag)
    totals = rows.groupBy(*cells).agg(F.sum(COUNT).alias("_cs_cell"))
    by_group = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    offsets = totals.select(
        *[F.col(c).alias(f"_cs_o_{k}") for k, c in enumerate(cells)],
        F.coalesce(F.sum("_cs_cell").over(by_group.orderBy("_cs_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_cs_offset"),
        F.sum("_cs_cell").over(by_group).alias("_cs_total"),
    )
    cond = F.lit(True)
    for k, c in enumerate(cells):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_cs_o_{k}"))
    return rows.join(offsets, cond).withColumn("_cs_cum", F.col("_cs_run") + F.col("_cs_offset")).drop("_cs_run", "_cs_offset", "_cs_range", *[f"_cs_o_{k}" for k in range(len(cells))])


def order_statistics(df: DataFrame, groups: list[str], value: str, indexes: list[Callable[[Column], Column]]) -> DataFrame:
    """groups, found, n: for each function of the group's count n the value at that index, from 0, in sorted order."""
    run = cumulate(frequencies(df, groups, value), groups, split_points(df, value))
    at = [F.max(F.when((f(F.col("_cs_total")) >= F.col("_cs_cum") - F.col(COUNT)) & (f(F.col("_cs_total")) < F.col("_cs_cum")), F.col(VALUE))) for f in indexes]
    return run.groupBy(*groups).agg(F.array(*at).alias("found"), F.max("_cs_total").alias("n"))


def linear_quantiles(df: DataFrame, groups: list[str], value: str, probs: list[float]) -> DataFrame:
    """groups, quantiles, n: values at (n - 1) p, between two order statistics in proportion."""
    low = [lambda n, p=p: F.floor((n - 1) * F.lit(float(p))) for p in probs]
    high = [lambda n, p=p: F.ceil((n - 1) * F.lit(float(p))) for p in probs]
    found = order_statistics(df, groups, value, [*low, *high])
    k = len(probs)
    cut = []
    for i, p in enumerate(probs):
        a, b = F.col("found")[i], F.col("found")[i + k]
        share = (F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p)))
        cut.append(a + (b - a) * share)
    return found.select(*groups, F.array(*cut).alias("quantiles"), "n")
