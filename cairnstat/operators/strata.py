"""Strata by order statistics, and counts over strata with empty ones kept.

Survey operators: WIN1-WIN3, WIN6, WIN7, AGG17, AGG20, AGG27, EXP7, LIM1, JN14.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..session import materialize
from .frequencies import linear_quantiles, order_statistics

LABELS = ("low", "medium", "high")


def edges(df: DataFrame, groups: list[str], value: str, bins: int = 3) -> DataFrame:
    """WIN1: groups, edges, n: the value at index round(i / bins (n - 1)), halves to even, for i = 1 .. bins - 1."""
    index = [lambda n, i=i: F.bround(F.lit(i) / F.lit(float(bins)) * (n - 1)).cast("bigint") for i in range(1, bins)]
    found = order_statistics(df, groups, value, index)
    return found.select(*groups, F.col("found").alias("edges"), "n")


def assign(value: str | Column, edge_array: str | Column, labels: tuple[str, ...] = LABELS) -> Column:
    """WIN2: the first label whose edge isn't below the value, else the last; null for a null value."""
    v = F.col(value) if isinstance(value, str) else value
    e = F.col(edge_array) if isinstance(edge_array, str) else edge_array
    out = F.when(v.isNull(), F.lit(None).cast("string"))
    for k, label in enumerate(labels[:-1]):
        out = out.when(v <= e[k], F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def stratify(df: DataFrame, groups: list[str], value: str, out: str = "stratum") -> DataFrame:
    """WIN3: each row with the stratum of its value within its group. The edges are one row a group; Spark sees their size."""
    own = edges(df, groups, value)
    return df.join(own.select(*groups, "edges"), groups, "left").withColumn(out, F.when(F.col("edges").isNotNull(), assign(value, "edges"))).drop("edges")


def strata_record(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """AGG20: groups, edges, assigned_items, and the count of each stratum."""
    own = edges(df, groups, value).select(*groups, "edges")
    marked = df.where(F.col(value).isNotNull()).join(own, groups).withColumn("_s", assign(value, "edges"))
    return marked.groupBy(*groups).agg(F.first("edges").alias("edges"), F.count("*").alias("assigned_items"), *[F.count_if(F.col("_s") == s).alias(s) for s in LABELS])


def adoption_by_stratum(df: DataFrame, groups: list[str], stratum: str, outcome: str) -> DataFrame:
    """AGG27: trials, adopted ones and their rate for every stratum of each group; without trials 0, 0 and null."""
    own = df.where(F.col(stratum).isin(*LABELS)).groupBy(*groups, stratum).agg(F.count("*").alias("trials"), F.count_if(F.col(outcome)).alias("adopted"))
    grid = df.select(*groups).distinct().select(*groups, F.explode(F.array(*[F.lit(x) for x in LABELS])).alias(stratum))
    return on_grid(own, grid, [*groups, stratum], ["trials", "adopted"]).withColumn("rate", F.try_divide("adopted", "trials"))


def on_grid(counts: DataFrame, grid: DataFrame, keys: list[str], numbers: list[str]) -> DataFrame:
    """AGG17, AGG27: counts for every cell of a small grid, 0 where there are none."""
    return grid.join(counts, keys, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in numbers})


def blocks(df: DataFrame, id_col: str, size: int = 250, ceiling: int | None = None, groups: list[str] | None = None) -> DataFrame:
    """EXP7, LIM1: rows numbered in the order of their ids as text and cut into blocks of ``size``, up to a ceiling.

    With groups the numbering is a window per group. Without, ranks are global: rows are
    sorted into ranges of ids and each range is numbered from the count of the lower ones,
    so no task holds all rows.
    """
    ident = F.col(id_col).cast("string")
    if groups:
        rn = df.withColumn("row_no", F.row_number().over(W.partitionBy(*groups).orderBy(ident)))
    else:
        ranged = df.withColumn("_id", ident).repartitionByRange("_id").withColumn("_part", F.spark_partition_id())
        ranged = materialize(ranged, "ranges")
        offsets = ranged.groupBy("_part").agg(F.count("*").alias("_c")).select("_part", F.coalesce(F.sum("_c").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
        rn = ranged.join(offsets, "_part").withColumn("row_no", F.row_number().over(W.partitionBy("_part").orderBy("_id")) + F.col("_o")).drop("_part", "_o", "_id")
    out = rn.withColumn("block_index", F.floor((F.col("row_no") - 1) / size).cast("int"))
    return out if ceiling is None else out.where(F.col("row_no") <= ceiling)


def supply_by_block(screened: DataFrame, groups: list[str], value: str, cell: list[str], block: str = "block_index") -> DataFrame:
    """WIN6: for each block k, the supply of each cell x stratum among rows of blocks up to k, strata recomputed for each k.

    A row counts for every later block of its group, so rows are repeated over the group's
    blocks; the number of blocks is bounded by the screening ceiling.
    """
    last = screened.groupBy(*groups).agg(F.max(block).alias("_last"))
    upto = screened.join(last, groups).withColumn("upto_block", F.explode(F.sequence(F.col(block), F.col("_last")))).drop("_last")
    marked = stratify(upto, [*groups, "upto_block"], value)
    return marked.where("stratum is not null").groupBy(*groups, "upto_block", *cell, "stratum").agg(F.count("*").alias("supply"))


def first_block_met(supply: DataFrame, groups: list[str], cells: int, least: int) -> DataFrame:
    """The first block of each group at which all ``cells`` cells hold ``least`` rows or more; null if none does."""
    met = supply.groupBy(*groups, "upto_block").agg(F.count_if(F.col("supply") >= least).alias("_ok"))
    return met.groupBy(*groups).agg(F.min(F.when(F.col("_ok") >= cells, F.col("upto_block"))).alias("stop_block"))


def quantile_bins(df: DataFrame, groups: list[str], value: str, outcome: str, bins: int = 4) -> DataFrame:
    """WIN7: mean value and outcome rate in bins at linear quantiles, the last bin closed; groups of fewer rows than bins left out."""
    cuts = linear_quantiles(df, groups, value, [k / bins for k in range(1, bins)]).where(F.col("n") >= bins).select(*groups, "quantiles")
    inner = F.lit(0)
    for k in range(bins - 1):
        inner = inner + (F.col(value) >= F.col("quantiles")[k]).cast("int")
    return df.where(F.col(value).isNotNull()).join(cuts, groups).withColumn("bin", inner).groupBy(*groups, "bin").agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"), F.avg(F.col(outcome).cast("int")).alias("rate"))
