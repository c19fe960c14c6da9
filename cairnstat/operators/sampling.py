"""Seeded samples by keyed hash: fixed for a seed, whatever the order and number of partitions.

Survey operators: SMP1-SMP6, JN3, JN4, AGG18, AGG30.

All are row_number over a hash within a stratum, with a limit that Spark pushes below the
shuffle (WindowGroupLimit), so a stratum of any size sends only its first k rows on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from ..functions.digest import keyed_order


def take(df: DataFrame, k: int, seed: int, id_col: str, strata: list[str] | None = None, salt: str = "") -> DataFrame:
    """SMP1, SMP3: k rows (of each stratum), all of it where it is smaller."""
    tag = F.concat_ws(":", F.lit(salt), *[F.coalesce(F.col(s).cast("string"), F.lit("None")) for s in strata or []])
    keyed = df.withColumn("_order", keyed_order(seed, tag, F.col(id_col).cast("string")))
    if not strata:
        return keyed.orderBy("_order", id_col).limit(k).drop("_order")
    by = W.partitionBy(*strata).orderBy("_order", id_col)
    return keyed.withColumn("_rn", F.row_number().over(by)).where(F.col("_rn") <= k).drop("_order", "_rn")


def balanced(df: DataFrame, target: int, seed: int, id_col: str, bin_col: str) -> DataFrame:
    """SMP2: as evenly over the bins as their sizes allow, min(target, rows) rows in all.

    A bin gives its r-th row in round r; rounds are filled bin by bin. Only the first
    ``target`` rows of a bin can be needed.
    """
    keyed = df.withColumn("_order", keyed_order(seed, F.col(bin_col).cast("string"), F.col(id_col).cast("string")))
    ranked = keyed.withColumn("_round", F.row_number().over(W.partitionBy(bin_col).orderBy("_order", id_col))).where(F.col("_round") <= target)
    return ranked.orderBy("_round", bin_col).limit(target).drop("_order", "_round")


def without(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """JN3: rows whose id isn't excluded."""
    return df.join(ids.select(id_col).where(F.col(id_col).isNotNull()).distinct(), id_col, "left_anti")


def in_all(df: DataFrame, id_col: str, member: str, members: int) -> DataFrame:
    """JN4: ids present with all members (models); one aggregation instead of a chain of joins."""
    return df.groupBy(id_col).agg(F.countDistinct(member).alias("_m")).where(F.col("_m") == members).select(id_col)


def cohort_supply(df: DataFrame, bin_col: str, bins: list[str], target: int) -> DataFrame:
    """SMP4: for each bin, also an empty one, how many are available and selected, the shortfall, and the state of the whole."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(b,) for b in bins], f"`{bin_col}` string")
    zero = F.lit(0).cast("bigint")
    counted = grid.join(df.groupBy(bin_col).agg(F.count("*").alias("available")), bin_col, "left").withColumn("available", F.coalesce("available", zero))
    d = counted.withColumns({"selected": F.least("available", F.lit(target).cast("bigint")), "shortfall": F.greatest(F.lit(target) - F.col("available"), zero)})
    # as many rows as bins
    short = F.sum("shortfall").over(W.partitionBy(F.lit(0)))
    return d.withColumn("state", F.when(short > 0, "ELIGIBILITY_LIMITED").otherwise("COMPLETE"))


def shared_quota(df: DataFrame, id_col: str, member: str, members: int, part: str, parts: list[str], target: int, seed: int, salt: str) -> DataFrame:
    """SMP6: ids that all members have, with one and the same listed part, an equal quota of each part drawn by the seed."""
    shared = df.groupBy(id_col).agg(F.countDistinct(member).alias("_m"), F.count_if(F.col(part).isNull()).alias("_null"), F.min(part).alias(part), F.max(part).alias("_other"))
    ok = (F.col("_m") == members) & (F.col("_null") == 0) & (F.col(part) == F.col("_other")) & F.col(part).isin(*parts)
    return take(shared.where(ok).select(id_col, part), target // len(parts), seed, id_col, [part], salt)


def member_records(members: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """JN5: each member with its record; a member without one is an error when the plan runs."""
    found = records.withColumn("_found", F.lit(True))
    joined = members.join(found, keys, "left")
    first = keys[0]
    absent = F.raise_error(F.concat(F.lit("a member has no record: "), F.concat_ws("|", *[F.col(k).cast("string") for k in keys])))
    return joined.withColumn(first, F.when(F.col("_found"), F.col(first)).otherwise(absent.cast(members.schema[first].dataType))).drop("_found")


def ladder(df: DataFrame, groups: list[str], cell: list[str], bin_col: str, bins: int, least: int, target: int, seed: int, id_col: str) -> DataFrame:
    """SMP5: from each cell x bin the same number of rows, as many as the smallest qualifying one has, up to ``target``.

    A cell qualifies if all its bins hold ``least`` rows or more. The number is read per
    group from the counts, joined back and used as the limit.
    """
    counts = df.groupBy(*groups, *cell, bin_col).agg(F.count("*").alias("_n"))
    cells = counts.groupBy(*groups, *cell).agg(F.count_if(F.col("_n") >= least).alias("_ok"), F.min("_n").alias("_min")).where(F.col("_ok") == bins)
    realized = cells.groupBy(*groups).agg(F.least(F.lit(target), F.min("_min")).alias("realized"), F.count("*").alias("qualifying"))
    rows = df.join(cells.select(*groups, *cell), [*groups, *cell], "left_semi").join(realized, groups)
    tag = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in (*groups, *cell, bin_col)])
    by = W.partitionBy(*groups, *cell, bin_col).orderBy(keyed_order(seed, tag, F.col(id_col).cast("string")), id_col)
    return rows.withColumn("_rn", F.row_number().over(by)).where((F.col("_rn") <= target) & (F.col("_rn") <= F.col("realized"))).drop("_rn")


def composition(df: DataFrame, groups: list[str], part: str, flag_above: float = 0.60) -> DataFrame:
    """AGG18: rows per part, its share of the group, and whether the largest share is above the flag."""
    counts = df.groupBy(*groups, part).agg(F.count("*").alias("n"))
    by = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    share = F.col("n") / F.sum("n").over(by)
    return counts.withColumns({"share": share, "dominant": F.max("n").over(by) / F.sum("n").over(by) > flag_above})


def label_agreement(df: DataFrame, id_col: str, label: str) -> DataFrame:
    """AGG30: how many ids have one label throughout, and how many have several."""
    per = df.groupBy(id_col).agg(F.countDistinct(label).alias("_k"))
    return per.agg(F.count_if(F.col("_k") == 1).alias("agreeing"), F.count_if(F.col("_k") > 1).alias("differing"))
