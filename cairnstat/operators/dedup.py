"""Requests with the same prompt collapsed into one generation each.

Survey operators: AGG21-AGG25, WIN5, JN6, JN7, VER10.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.digest import observation_id, sha256

ALIAS_FIELDS = ("condition", "arm", "source_role", "source_label", "evidence_truth", "conflict_status")
SHARED = ("asserted_answer", "source_label", "evidence_truth", "conflict_status")


def identify(requests: DataFrame, prompt: str, revision: Column, version: str, fingerprint: Column, seed: int) -> DataFrame:
    """requests with prompt_hash and observation_id; the item is part of the identity, so equal prompts of two items stay apart."""
    hashed = requests.withColumn("prompt_hash", sha256(prompt))
    return hashed.withColumn("observation_id", observation_id(F.col("model_key"), revision, F.col("item_id"), F.col("prompt_hash"), version, fingerprint, seed))


def collapse(identified: DataFrame) -> DataFrame:
    """AGG21, WIN5: one row an observation: its aliases sorted by condition, its cohorts, the first condition as display name."""
    alias = F.struct(*[F.col(c) for c in ALIAS_FIELDS])
    cohorts = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("cohorts")))).alias("cohorts")] if "cohorts" in identified.columns else []
    grouped = identified.groupBy("observation_id", "model_key", "item_id", "prompt_hash").agg(F.array_sort(F.collect_list(alias)).alias("aliased_conditions"), *cohorts)
    return grouped.withColumns({"is_aliased": F.size("aliased_conditions") > 1, "primary_condition": F.array_min(F.transform("aliased_conditions", lambda a: a["condition"]))})


def alias_map(identified: DataFrame) -> DataFrame:
    """model_key, item_id, condition -> observation_id."""
    return identified.select("model_key", "item_id", "condition", "observation_id")


def accounting(identified: DataFrame) -> DataFrame:
    """AGG22: planned slots, unique generations, collapsed slots, aliased generations and items per model, and a total row (model_key null)."""
    per = identified.groupBy("model_key", "observation_id").agg(F.count("*").alias("_slots"), F.min("item_id").alias("_item"))
    return (
        per.rollup("model_key")
        .agg(F.sum("_slots").alias("nominal_slots"), F.count("*").alias("unique_observations"), (F.sum("_slots") - F.count("*")).alias("collapsed_slots"), F.count_if(F.col("_slots") > 1).alias("aliased_observations"), F.countDistinct("_item").alias("items"))
    )


def broken_aliases(identified: DataFrame) -> DataFrame:
    """AGG23: observations whose aliases differ in what they must share; null is a value of its own."""
    kinds = [F.size(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit("␀")))).alias(f"n_{c}") for c in SHARED]
    per = identified.groupBy("observation_id").agg(*kinds)
    return per.where(" or ".join(f"n_{c} > 1" for c in SHARED))


def degenerate_contrasts(aliases: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """AGG24: of each named pair of conditions, how many items have both, and how many have one observation for both."""
    spec = F.array(*[F.struct(F.lit(n).alias("contrast"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in pairs])
    sided = aliases.select("model_key", "item_id", "observation_id", F.col("condition").alias("_c"), F.explode(spec).alias("s")).where("_c = s.a or _c = s.b")
    per = sided.groupBy("model_key", "item_id", F.col("s.contrast").alias("contrast")).agg(F.max(F.when(F.col("_c") == F.col("s.a"), F.col("observation_id"))).alias("a"), F.max(F.when(F.col("_c") == F.col("s.b"), F.col("observation_id"))).alias("b"))
    both = per.where("a is not null and b is not null")
    return both.groupBy("model_key", "contrast").agg(F.count("*").alias("items"), F.count_if(F.col("a") == F.col("b")).alias("same_observation"))


def compare_counts(planned: DataFrame, recorded: DataFrame, key: str, number: str) -> DataFrame:
    """AGG25: keys at which a plan's count and a record's count differ, absent ones included."""
    p, r = planned.select(F.col(key), F.col(number).alias("planned")), recorded.select(F.col(key), F.col(number).alias("recorded"))
    return p.join(r, key, "full_outer").where("not (planned <=> recorded)")


def outcomes(aliases: DataFrame, observations: DataFrame, outcome: str) -> DataFrame:
    """JN7: every planned slot with its observation's outcome; a slot without one is an error when the plan runs.

    There are about as many observations as slots, and behind an expanded plan the optimizer
    takes them for few, so they must not be broadcast: both sides are sorted.
    """
    joined = aliases.join(observations.select("observation_id", outcome).hint("merge"), "observation_id", "left")
    return joined.withColumn(outcome, F.when(F.col(outcome).isNull(), F.raise_error(F.lit("a planned slot has no outcome")).cast("boolean")).otherwise(F.col(outcome)))


def run_plan(specs: DataFrame, identified: DataFrame, baselines: DataFrame) -> DataFrame:
    """JN6: one row an observation with what its aliases share and its item's baseline answers.

    ``baselines`` has model_key, item_id and the answers; an observation without a
    baseline keeps nulls there and is found by ``unplanned``.
    """
    shared = identified.groupBy("observation_id", "model_key", "item_id", "prompt_hash").agg(F.array_sort(F.collect_set("condition")).alias("conditions"), *[F.max(c).alias(c) for c in SHARED], F.max("prompt").alias("prompt"))
    return shared.join(baselines, ["model_key", "item_id"], "left")


def altered_prompts(plan: DataFrame, rendered: Column) -> DataFrame:
    """VER10: rows whose prompt, rendered again, has another digest."""
    return plan.where(~sha256(rendered).eqNullSafe(F.col("prompt_hash")))
