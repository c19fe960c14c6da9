"""Problem 4: exact percentiles and ranks per group from cumulative frequencies.

Rows are reduced to (group, value, count) before anything is sorted, so a value that a
third of all rows share is one row. The values are cut into ranges at quantiles of the
whole column; each (group, range) cell is sorted and summed by a window of its own, the
totals of the lower ranges are added as offsets (:mod:`cairnstat.operators.frequencies`),
and a percentile is the first value whose cumulative count reaches its target. No group
is ever gathered in one task: a cell holds at most about 1/1024 of the distinct values of
the column.

Frequency tables of days, blocks or partitions add up (``merge_frequencies``) and stay
exact. ``summarize`` shortens each group's table to about 1/epsilon points; ranks read
from any merge of summaries are at most epsilon of the merged total too low, never too high.

Null and NaN values belong to no pool; 0.0 and -0.0 are one value; a null in a group
column is a group of its own; ties are one value with a count; an empty table gives no
rows. Group columns may have any names but those beginning with ``_cs_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from ..operators.frequencies import COUNT, VALUE, cumulate, split_points

__all__ = ["merge_frequencies", "misplaced_edges", "percentiles", "range_percentiles", "ranks", "split_points", "summarize", "value_frequencies"]


def _clean(df: DataFrame, groups: list[str], value: str, id_col: str | None) -> DataFrame:
    v = F.col(value).cast("double") + F.lit(0.0)
    cols = [F.col(g) for g in groups] + [v.alias(VALUE)] + ([F.col(id_col).alias("_cs_id")] if id_col else [])
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*cols)


def value_frequencies(df: DataFrame, groups: list[str], value: str, id_col: str | None = None) -> DataFrame:
    """groups, _cs_value, _cs_n. With id_col, rows of one id, group and value count once."""
    rows = _clean(df, groups, value, id_col)
    if id_col:
        rows = rows.where("_cs_id is not null").dropDuplicates().unionByName(rows.where("_cs_id is null"))
    return rows.groupBy(*groups, VALUE).agg(F.count("*").alias(COUNT))


def merge_frequencies(freq: DataFrame, groups: list[str]) -> DataFrame:
    """Add frequency tables (a union of them, or one at a finer grouping) up to the given groups."""
    return freq.groupBy(*groups, VALUE).agg(F.sum(COUNT).alias(COUNT))


def percentiles(freq: DataFrame, groups: list[str], probs: list[float], points: list[float]) -> DataFrame:
    """groups, p, value, n_values: the value of rank ceil(p n), n the group's count; p in [0, 1], rank 1 at least."""
    run = cumulate(freq, groups, points)
    target = lambda p: F.greatest(F.lit(1), F.ceil(p * F.col("_cs_total") - F.lit(1e-9)))
    hit = F.filter(F.array(*[F.lit(float(p)) for p in probs]), lambda p: (target(p) > F.col("_cs_cum") - F.col(COUNT)) & (target(p) <= F.col("_cs_cum")))
    return run.where(F.size(hit) > 0).select(*groups, F.explode(hit).alias("p"), F.col(VALUE).alias("value"), F.col("_cs_total").alias("n_values"))


def ranks(freq: DataFrame, groups: list[str], asked: DataFrame, keep: list[str], points: list[float]) -> DataFrame:
    """For each asked row (groups, _cs_value, keep): _cs_below, _cs_upto and _cs_total, counts in its group.

    The asked values are sorted in with the counted ones: a mark before the equal value
    reads the count below it, a mark after it the count up to it.
    """
    nothing = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in keep]
    counted = freq.select(*groups, VALUE, COUNT, F.lit(1).alias("_cs_mark"), *nothing)
    marks = asked.where(F.col(VALUE).isNotNull() & ~F.isnan(VALUE)).select(*groups, (F.col(VALUE) + F.lit(0.0)).alias(VALUE), F.lit(0).cast("long").alias(COUNT), F.explode(F.array(F.lit(0), F.lit(2))).alias("_cs_mark"), *keep)
    run = cumulate(counted.unionByName(marks), groups, points, ["_cs_mark"], "ranks").where("_cs_mark <> 1")
    at = lambda mark: F.max(F.when(F.col("_cs_mark") == mark, F.col("_cs_cum")))
    return run.groupBy(*groups, VALUE, *keep).agg(at(0).alias("_cs_below"), at(2).alias("_cs_upto"), F.max("_cs_total").alias("_cs_total"))


def summarize(freq: DataFrame, groups: list[str], epsilon: float, points: list[float]) -> DataFrame:
    """A frequency table of at most about 1/epsilon points a group; each kept value carries the count since the last kept one."""
    run = cumulate(freq, groups, points, tag="summary")
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_cs_total") * F.lit(epsilon)))
    before = F.col("_cs_cum") - F.col(COUNT)
    kept = run.where((F.floor(F.col("_cs_cum") / step) > F.floor(before / step)) | (F.col("_cs_cum") == F.col("_cs_total")))
    # a group holds about 1/epsilon points here, so its window is small
    last = F.lag("_cs_cum").over(W.partitionBy(*groups).orderBy(VALUE))
    return kept.select(*groups, VALUE, (F.col("_cs_cum") - F.coalesce(last, F.lit(0))).alias(COUNT))


def _cover(low, high, level: int, top: int, fan: int):
    """The nodes (level, node) that make up the blocks from low to high: node n of level l is the fan^l blocks from n fan^l."""
    kind = "array<struct<level:int,node:bigint>>"

    def own(a, b):
        return F.when(a <= b, F.transform(F.sequence(a, b), lambda x: F.struct(F.lit(level).alias("level"), x.alias("node")))).otherwise(F.array().cast(kind))

    if level == top:
        return own(low, high)
    first, last = F.floor((low + (fan - 1)) / fan), F.floor((high + 1) / fan) - 1
    parts = F.concat(own(low, first * fan - 1), _cover(first, last, level + 1, top, fan), own((last + 1) * fan, high))
    return F.when(first <= last, parts).otherwise(own(low, high))


def misplaced_edges(strata: DataFrame, scores: DataFrame, tolerance: float = 0.02, fan: int = 1024) -> DataFrame:
    """freeze_id of frozen edge pairs of which an edge's rank lies beyond the tolerance from 1/3 or 2/3 of its pool.

    The rank of an edge is any value between the share of the pool below it and the share
    up to it. Counts are read, exactly, per block and, where there are more than ``fan``
    blocks, per ``fan`` blocks and so on, and added over the nodes that make up the block
    range: 2 fan of a level at most, however many blocks a range spans. A pool without
    values and an edge that is null or NaN have no rank and are no case.
    """
    groups = ["model_key", "knowledge_group", "level", "node"]
    ranges = strata.where("block_from <= block_to")
    wanted = strata.select("model_key", "knowledge_group").distinct()
    pool = scores.join(wanted, ["model_key", "knowledge_group"], "left_semi")
    points = split_points(pool, "parametric_margin")
    first, last = ranges.agg(F.min("block_from"), F.max("block_to")).first()
    if first is None:
        return strata.select("freeze_id").limit(0)
    top, spanned = 0, last - first + 1
    while spanned > fan:
        top, spanned = top + 1, -(-spanned // fan)
    block = F.col("block_no").cast("bigint") - F.lit(first)
    nodes = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(block / F.lit(fan**k)).alias("node")) for k in range(top + 1)])).alias("x")
    freq = value_frequencies(pool, ["model_key", "knowledge_group", "block_no"], "parametric_margin", "score_id")
    freq = merge_frequencies(freq.select("model_key", "knowledge_group", VALUE, COUNT, nodes).select("model_key", "knowledge_group", "x.*", VALUE, COUNT), groups) if top else freq.select("model_key", "knowledge_group", F.lit(0).alias("level"), block.alias("node"), VALUE, COUNT)
    low, high = F.col("block_from").cast("bigint") - F.lit(first), F.col("block_to").cast("bigint") - F.lit(first)
    asked = (
        ranges.select("freeze_id", "model_key", "knowledge_group", F.explode(_cover(low, high, 0, top, fan)).alias("x"), "edges")
        .select("freeze_id", "model_key", "knowledge_group", "x.*", F.posexplode("edges").alias("edge_no", VALUE))
        .where("edge_no < 2")
    )
    read = ranks(freq, groups, asked, ["freeze_id", "edge_no"], points)
    target = (F.col("edge_no") + 1) / F.lit(3.0)
    return (
        read.groupBy("freeze_id", "edge_no")
        .agg(F.sum("_cs_below").alias("below"), F.sum("_cs_upto").alias("upto"), F.sum("_cs_total").alias("total"))
        .where("total > 0")
        .where((F.col("below") / F.col("total") > target + tolerance) | (F.col("upto") / F.col("total") < target - tolerance))
        .select("freeze_id")
        .distinct()
    )


def range_percentiles(strata: DataFrame, scores: DataFrame, probs: list[float], epsilon: float = 0.005) -> DataFrame:
    """freeze_id, p, value, n_values of each block range, from summaries kept per block; rank error below epsilon."""
    groups = ["model_key", "knowledge_group", "block_no"]
    wanted = strata.select("model_key", "knowledge_group").distinct()
    pool = scores.join(wanted, ["model_key", "knowledge_group"], "left_semi")
    points = split_points(pool, "parametric_margin")
    kept = summarize(value_frequencies(pool, groups, "parametric_margin", "score_id"), groups, epsilon, points)
    spans = strata.where("block_from <= block_to").select("freeze_id", "model_key", "knowledge_group", F.explode(F.sequence("block_from", "block_to")).alias("block_no"))
    merged = merge_frequencies(kept.join(spans, groups), ["freeze_id"])
    return percentiles(merged, ["freeze_id"], probs, points)
