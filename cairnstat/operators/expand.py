"""Rows expanded into pairs, presentations and experimental conditions.

Survey operators: EXP1-EXP6, EXP8, FLT15, SET2, STR9.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


def unordered_pairs(df: DataFrame, groups: list[str], label: str, most: int = 10_000) -> DataFrame:
    """EXP1: every pair of different labels of a group, source_a before source_b in code-point order.

    A group's labels are a short list (bounded by ``most``, an error beyond); each label is
    exploded against the labels behind it in the sorted list.
    """
    lists = df.where(F.col(label).isNotNull()).groupBy(*groups).agg(F.array_sort(F.collect_set(label)).alias("_l")) if groups else df.where(F.col(label).isNotNull()).agg(F.array_sort(F.collect_set(label)).alias("_l"))
    sure = F.when(F.size("_l") <= most, F.col("_l")).otherwise(F.raise_error(F.lit("too many labels for a list of pairs")).cast("array<string>"))
    firsts = lists.select(*groups, sure.alias("_l")).select(*groups, F.posexplode("_l").alias("_p", "source_a"), "_l")
    return firsts.select(*groups, "source_a", F.explode(F.slice("_l", F.col("_p") + 2, F.size("_l"))).alias("source_b"))


def presentations(pairs: DataFrame) -> DataFrame:
    """EXP2: each pair in both orders."""
    both = F.array(
        F.struct(F.lit("AB").alias("presentation_order"), F.col("source_a").alias("displayed_source_1"), F.col("source_b").alias("displayed_source_2")),
        F.struct(F.lit("BA").alias("presentation_order"), F.col("source_b").alias("displayed_source_1"), F.col("source_a").alias("displayed_source_2")),
    )
    return pairs.select("*", F.inline(both))


@dataclass(frozen=True)
class Condition:
    """One condition of a group of items: its evidence and whose answer that asserts."""

    condition: str
    arm: str
    source_role: str
    evidence_truth: str
    conflict_status: str
    asserted: str | None  # column that holds the asserted answer


#: The conditions of the two designs by knowledge group.
PILOT = {
    "KC": [Condition("C0", "baseline", "none", "none", "none", None), *[Condition(c, "common", r, "true", "agreement", "gold_answer") for c, r in (("C1", "preferred"), ("C2", "dispreferred"))], *[Condition(c, "common", r, "false", "conflict", "foil_answer") for c, r in (("C3", "preferred"), ("C4", "dispreferred"))]],
    "KW": [Condition("C0", "baseline", "none", "none", "none", None), *[Condition(c, "common", r, "true", "conflict", "gold_answer") for c, r in (("C1", "preferred"), ("C2", "dispreferred"))], *[Condition(c, "common", r, "false", "agreement", "memory_answer") for c, r in (("C3", "preferred"), ("C4", "dispreferred"))]],
}
CONFIRMATORY = {
    "KC": [Condition("C0", "baseline", "none", "none", "none", None), *[Condition(c, "common", r, "true", "agreement", "gold_answer") for c, r in (("K1", "identity_a"), ("K2", "identity_b"))], *[Condition(c, "common", r, "false", "conflict", "foil_answer") for c, r in (("K3", "identity_a"), ("K4", "identity_b"))]],
    "KW": [Condition("C0", "baseline", "none", "none", "none", None), *[Condition(c, "common", r, "true", "conflict", "gold_answer") for c, r in (("K1", "identity_a"), ("K2", "identity_b"))], *[Condition(c, "common", r, "false", "agreement", "memory_answer") for c, r in (("K3", "identity_a"), ("K4", "identity_b"))]],
}
MODEL_ARM = {
    "KC": [Condition(c, "model_specific", r, "false", "conflict", "foil_answer") for c, r in (("M1", "preferred"), ("M2", "dispreferred"))],
    "KW": [Condition(c, "model_specific", r, "true", "conflict", "gold_answer") for c, r in (("M1", "preferred"), ("M2", "dispreferred"))],
}


def _structs(conditions: list[Condition], roles: dict[str, Column]) -> Column:
    made = []
    for c in conditions:
        made.append(F.struct(
            F.lit(c.condition).alias("condition"), F.lit(c.arm).alias("arm"), F.lit(c.source_role).alias("source_role"),
            roles.get(c.source_role, F.lit(None).cast("string")).cast("string").alias("source_label"),
            F.lit(c.evidence_truth).alias("evidence_truth"), F.lit(c.conflict_status).alias("conflict_status"),
            (F.col(c.asserted) if c.asserted else F.lit(None)).cast("string").alias("asserted_answer"),
        ))
    return F.array(*made)


def conditions(items: DataFrame, design: dict[str, list[Condition]], roles: dict[str, Column], extra: dict[str, list[Condition]] | None = None, enabled: Column | None = None, group: str = "knowledge_group") -> DataFrame:
    """EXP3, EXP4: each item in every condition of its group; the extra arm only where it is enabled.

    An item of another group gives no rows. A condition that asserts a missing answer is
    an error when the plan runs.
    """
    choice = None
    for name, own in design.items():
        rows = _structs(own, roles)
        if extra and enabled is not None:
            rows = F.when(F.coalesce(enabled, F.lit(False)), F.concat(rows, _structs(extra[name], roles))).otherwise(rows)
        choice = F.when(F.col(group) == name, rows) if choice is None else choice.when(F.col(group) == name, rows)
    out = items.select("*", F.inline(choice))
    missing = (F.col("evidence_truth") != "none") & F.col("asserted_answer").isNull()
    return out.withColumn("asserted_answer", F.when(missing, F.raise_error(F.lit("a condition asserts an answer that the item lacks")).cast("string")).otherwise(F.col("asserted_answer")))


def labels_long(df: DataFrame, id_cols: list[str], labels: str) -> DataFrame:
    """EXP8: one row for each label of an id."""
    return df.select(*id_cols, F.explode(labels).alias("label")).distinct()


def labels_wide(df: DataFrame, id_cols: list[str], label: str = "label") -> DataFrame:
    """EXP8: the sorted distinct labels of each id."""
    return df.groupBy(*id_cols).agg(F.array_sort(F.collect_set(label)).alias("labels"))
