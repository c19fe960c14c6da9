"""Rates over recorded trials and what share of answers falls into which class.

Survey operators: AGG4-AGG9, AGG19, AGG26, FLT7, FLT8, FLT12, FLT13, REG1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import alias_set, normalize_answer


def answer_class(malformed, answer, decision, context, memory, gold, aliases) -> Column:
    """FLT7: class of an answer; the first rule that holds decides. Context and memory have no aliases, gold has."""
    form = normalize_answer(answer)
    same = lambda c: (form != "") & (form == normalize_answer(c))
    bad = F.coalesce(F.col(malformed) if isinstance(malformed, str) else malformed, F.lit(False))
    dec = F.col(decision) if isinstance(decision, str) else decision
    ans = F.col(answer) if isinstance(answer, str) else answer
    return (
        F.when(bad | ans.isNull(), "manual_review").when(dec == "uncertain", "uncertain").when(dec.isNull() | (dec != "answer"), "manual_review")
        .when(same(context), "context").when(same(memory), "memory").when((form != "") & F.array_contains(alias_set(gold, aliases), form), "gold").otherwise("other")
    )


def rate(df: DataFrame, groups: list[str], hit: Column, where: Column | None = None) -> DataFrame:
    """AGG4: rate and n of a predicate over a subset; without groups one row always comes out, rate null for n = 0."""
    inside = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    value = F.when(inside, F.coalesce(hit, F.lit(False)).cast("int"))
    agg = [F.avg(value).alias("rate"), F.count(value).alias("n")]
    return df.groupBy(*groups).agg(*agg) if groups else df.agg(*agg)


def conflict_only(df: DataFrame) -> DataFrame:
    """FLT12: the rows, if all are conflict trials; an error when the plan runs otherwise."""
    ok = F.col("conflict_status").eqNullSafe(F.lit("conflict"))
    return df.withColumn("conflict_status", F.when(ok, F.col("conflict_status")).otherwise(F.raise_error(F.lit("conflict trials only")).cast("string")))


def harmful() -> Column:
    return (F.col("knowledge_group") == "KC") & (F.col("evidence_truth") == "false") & (F.col("conflict_status") == "conflict")


def corrective() -> Column:
    return (F.col("knowledge_group") == "KW") & (F.col("evidence_truth") == "true") & (F.col("conflict_status") == "conflict")


def _share(where: Column) -> Column:
    return F.when(F.coalesce(where, F.lit(False)), F.coalesce(F.col("context_adopted"), F.lit(False)).cast("int"))


def overrides(df: DataFrame, groups: list[str]) -> DataFrame:
    """AGG5: harmful and corrective override rates with their n."""
    h, c = _share(harmful()), _share(corrective())
    return df.groupBy(*groups).agg(F.avg(h).alias("hor"), F.count(h).alias("hor_n"), F.avg(c).alias("cor"), F.count(c).alias("cor_n"))


def override_deltas(df: DataFrame, groups: list[str]) -> DataFrame:
    """AGG6: rate of preferred less that of dispreferred sources, null if either is."""
    pref, disp = F.col("source_role") == "preferred", F.col("source_role") == "dispreferred"
    avg = lambda cond, role: F.avg(_share(cond & role))
    return df.groupBy(*groups).agg((avg(harmful(), pref) - avg(harmful(), disp)).alias("delta_harm"), (avg(corrective(), pref) - avg(corrective(), disp)).alias("delta_correct"))


def condition_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """AGG7: n, adoption, accuracy and abstention by condition; rows with a null key are left out."""
    as_int = lambda c: F.col(c).cast("int")
    kept = df.where(" and ".join(f"{k} is not null" for k in keys))
    return kept.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(as_int("context_adopted")).alias("context_adoption_rate"), F.avg(as_int("final_correct")).alias("parsed_answer_accuracy"), F.avg(F.coalesce(F.col("decision") == "uncertain", F.lit(False)).cast("int")).alias("abstention_rate"))


def override_summary(df: DataFrame, model: str = "model_key") -> DataFrame:
    """AGG8: override rates of each model for both source roles, also where a role has no trial."""
    roles = F.array(F.lit("preferred"), F.lit("dispreferred"))
    grid = df.select(model).where(F.col(model).isNotNull()).distinct().select(model, F.explode(roles).alias("source_role"))
    zero = F.lit(0).cast("bigint")
    return grid.join(overrides(df, [model, "source_role"]), [model, "source_role"], "left").withColumns({"hor_n": F.coalesce("hor_n", zero), "cor_n": F.coalesce("cor_n", zero)})


def abstention_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """AGG9: abstention under conflict."""
    return df.where("conflict_status = 'conflict'").where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("decision") == "uncertain", F.lit(False)).cast("int")).alias("abstention_rate"))


def counts_by(df: DataFrame, rows: list[str], column: str, values: list[str]) -> DataFrame:
    """AGG19: how often each value stands in the column, one column a value; the values are given, so the plan is one aggregation."""
    return df.groupBy(*rows).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def histogram(df: DataFrame, groups: list[str], column: str) -> DataFrame:
    """AGG26: a map of value to count for each group, a null counted as '(null)'."""
    per = df.groupBy(*groups, F.coalesce(F.col(column), F.lit("(null)")).alias("_v")).agg(F.count("*").alias("_n"))
    return per.groupBy(*groups).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_v", "_n")))).alias("histogram"))


def diagnostics(df: DataFrame, groups: list[str]) -> DataFrame:
    """AGG26: rows, and the rates of abstention, right answers, review, failed parsing and asserted answers without commitment."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    tentative = (F.col("decision") == "uncertain") & (F.col("asserted_answer") != "") & (F.lower(F.trim("parsed_answer")) == F.lower(F.trim("asserted_answer")))
    rates = {"abstention_rate": F.col("decision") == "uncertain", "accuracy": F.col("final_correct"), "review_rate": F.col("manual_review"), "parse_failure_rate": F.col("malformed"), "tentative_rate": tentative}
    return df.groupBy(*groups).agg(F.count("*").alias("n"), *[F.avg(flag(c)).alias(k) for k, c in rates.items()])


def first_reason(*reasons: str) -> Column:
    """FLT13: the first reason that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(r), F.lit("")) for r in reasons])


def conflict_frame(df: DataFrame) -> DataFrame:
    """REG1: y adopted, b group KC, s preferred source, t evidence true, of conflict trials, as numbers."""
    of = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return df.where("conflict_status = 'conflict'").select("*", of(F.col("context_adopted")).alias("y"), of(F.col("knowledge_group") == "KC").alias("b"), of(F.col("source_role").isin("preferred", "identity_a")).alias("s"), of(F.col("evidence_truth") == "true").alias("t"))
