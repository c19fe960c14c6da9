"""Paired comparisons of two conditions over the same items.

Survey operators: JN8-JN11, AGG10-AGG12, AGG28, AGG32, FLT16, FLT18, FLT19, JN15.

Two conditions are paired by one aggregation over (model, item), not by a self-join, and
all contrasts of a study are one grouped query: a row is labelled with the contrasts it
belongs to, paired, and counted. Interval and exact p are computed on the few rows left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import exact_p, holm, saturation, tango_interval

CELLS = ("both", "a_only", "b_only", "neither")


def pair_items(trials: DataFrame, keys: list[str], side: str, outcome: str, a: Column, b: Column, strict: bool = False) -> DataFrame:
    """JN8: keys, out_a, out_b of items that have both sides. A missing side leaves the item out.

    A repeated (item, side) is an error under ``strict``; else any true among repeats counts as true.
    """
    on_a, on_b = (F.col(side) == a), (F.col(side) == b)
    agg = [F.max(F.when(on_a, F.col(outcome))).alias("out_a"), F.max(F.when(on_b, F.col(outcome))).alias("out_b")]
    if strict:
        agg += [F.count_if(on_a).alias("_na"), F.count_if(on_b).alias("_nb")]
    paired = trials.where(on_a | on_b).groupBy(*keys).agg(*agg)
    if strict:
        twice = (F.col("_na") > 1) | (F.col("_nb") > 1)
        paired = paired.withColumn("out_a", F.when(twice, F.raise_error(F.lit("an item has a condition twice")).cast("boolean")).otherwise(F.col("out_a"))).drop("_na", "_nb")
    return paired.where("out_a is not null and out_b is not null")


def cells(paired: DataFrame, groups: list[str]) -> DataFrame:
    """AGG10: the 2 x 2 table of each group."""
    a, b = F.col("out_a"), F.col("out_b")
    return paired.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("a_only"), F.count_if(~a & b).alias("b_only"), F.count_if(~a & ~b).alias("neither"))


def report(tables: DataFrame) -> DataFrame:
    """AGG11: rates, risk difference, Tango interval, exact p and diagnostics of each 2 x 2 table; null rates for n = 0."""
    n = F.col("n").cast("double")
    rate = lambda c: F.when(F.col("n") > 0, (F.col("both") + F.col(c)) / n)
    out = tables.withColumns({
        "discordant_pairs": F.col("a_only") + F.col("b_only"), "rate_a": rate("a_only"), "rate_b": rate("b_only"),
        "risk_difference": F.when(F.col("n") > 0, (F.col("a_only") - F.col("b_only")) / n),
        "interval": tango_interval("a_only", "b_only", "n"), "exact_p": F.when(F.col("n") > 0, exact_p("a_only", "b_only")),
    })
    out = out.withColumns({"ci_lower": F.col("interval.lower"), "ci_upper": F.col("interval.upper"), "diagnostics": saturation("rate_a", "rate_b", "discordant_pairs")})
    return out.drop("interval")


def pooled_pairs(trials: DataFrame, keys: list[str], mapping: list[tuple[str, str, str]], group: str = "knowledge_group", condition: str = "condition", outcome: str = "context_adopted") -> DataFrame:
    """JN9: pairs whose two conditions depend on the item's group: mapping has (group, condition a, condition b)."""
    side = None
    for g, a, b in mapping:
        of = F.when(F.col(condition) == a, F.lit("a")).when(F.col(condition) == b, F.lit("b"))
        side = F.when(F.col(group) == g, of) if side is None else side.when(F.col(group) == g, of)
    sided = trials.withColumn("_side", side).where("_side is not null")
    return pair_items(sided, keys, "_side", outcome, F.lit("a"), F.lit("b"))


def leave_one_out(paired: DataFrame, groups: list[str], part: str) -> DataFrame:
    """AGG28: the table of each group without each part in turn: the whole less the part, from one aggregation."""
    per = cells(paired, [*groups, part])
    whole = per.groupBy(*groups).agg(*[F.sum(c).alias(f"_{c}") for c in ("n", *CELLS)])
    return per.join(whole, groups).select(*groups, F.col(part).alias("dropped"), *[(F.col(f"_{c}") - F.col(c)).alias(c) for c in ("n", *CELLS)])


def restrict(paired: DataFrame, column: str, value, keep: bool = True) -> DataFrame:
    """FLT16: rows with the value, or without it; a null is never the value."""
    same = F.col(column).eqNullSafe(F.lit(value))
    return paired.where(same if keep else ~same)


def within(paired: DataFrame, items: DataFrame, keys: list[str], inside: bool = True) -> DataFrame:
    """JN11: pairs of items in (or not in) another set of items."""
    return paired.join(items.select(*keys).distinct(), keys, "left_semi" if inside else "left_anti")


def excludes_zero() -> Column:
    return ~((F.col("ci_lower") <= 0) & (F.col("ci_upper") >= 0))


def replication_class(contrasts: DataFrame, point: float, alpha: float = 0.05) -> DataFrame:
    """FLT18: category of each primary contrast with the reasons for INCONCLUSIVE, in a fixed order."""
    holds_point = (F.col("ci_lower") <= point) & (F.col("ci_upper") >= point)
    reasons = F.array_compact(F.array(
        F.when(F.col("diagnostics.saturated"), F.lit("saturated")),
        F.when(F.col("discordant_pairs") < 5, F.lit("few_discordant")),
        F.when(F.coalesce(F.col("limited"), F.lit(False)) if "limited" in contrasts.columns else F.lit(False), F.lit("limited")),
        F.when(~excludes_zero() & holds_point, F.lit("wide_interval")),
    ))
    shown = (F.col("risk_difference") > 0) & excludes_zero() & (F.col("exact_p") < alpha)
    category = F.when((F.col("n") == 0) | (F.size("reasons") > 0), "INCONCLUSIVE").when(shown & holds_point, "FULL").when(shown, "ATTENUATED").otherwise("NON-REPLICATION")
    return contrasts.withColumn("reasons", reasons).withColumn("category", category)


def secondary_class(contrasts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """FLT19: category of each secondary contrast by its Holm-adjusted p. A contrast that shares another's observations (``counted_once_with``) has none of its own."""
    weak = F.col("diagnostics.saturated") | (F.col("discordant_pairs") < 5)
    shown = (F.col("risk_difference") > 0) & excludes_zero()
    once = F.coalesce(F.trim("counted_once_with") != "", F.lit(False)) if "counted_once_with" in contrasts.columns else F.lit(False)
    category = (
        F.when(F.col("n") == 0, "INCONCLUSIVE").when(once, "COUNTED ONCE").when(weak, "INCONCLUSIVE").when(shown & (F.col("holm_p") < alpha), "DIRECTIONAL EFFECT CONFIRMED")
        .when(shown, "DIRECTIONAL, NOT MULTIPLICITY-SURVIVING").otherwise("NON-REPLICATION")
    )
    return contrasts.withColumn("category", category)


def holm_family(registry: DataFrame, results: DataFrame, name: str, family: list[str], p: str) -> DataFrame:
    """JN15, VER11: every row of the registry, whether its result is a member of its family, why not, and the adjusted p of members.

    registry has the keys and may have gate_reason (not eligible, whatever the result).
    """
    keys = [*family, name]
    d = registry.join(results.select(*keys, F.col(p).alias("p_value"), F.lit(True).alias("_there")), keys, "left")
    gate = F.nullif(F.trim("gate_reason"), F.lit("")) if "gate_reason" in registry.columns else F.lit(None).cast("string")
    reason = F.when(F.col("_there").isNull(), "not computed").when(gate.isNotNull(), gate).when(F.col("p_value").isNull(), "no single test statistic").otherwise("included")
    d = d.withColumn("reason", reason).withColumn("included", F.col("reason") == "included")
    d = d.withColumn("_p", F.when(F.col("included"), F.col("p_value")))
    return holm(d, "_p", name, family).select(*keys, "included", "reason", "p_value", "holm_p")


def flagged_names(contrasts: DataFrame, flag: Column, name: str, groups: list[str]) -> DataFrame:
    """AGG32: the sorted names of flagged contrasts of each group."""
    return contrasts.groupBy(*groups).agg(F.array_sort(F.collect_list(F.when(flag, F.col(name)))).alias("names"))
