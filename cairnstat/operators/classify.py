"""Rows put into classes by ordered rules or tables, and several results bundled.

Survey operators: FLT2, FLT4, FLT5, FLT9, FLT10, FLT20, FLT21, JN16, AGG33, SMP7, RUN11.
The classes and their tables are parameters; none of a study's own is built in but the
uncertainty phrases and the group rule of the answer format.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import col, is_clean_candidate, is_match, normalize_answer
from .contrasts import cells, pair_items, report

#: Answers that say that there is none, compared in the normalised form.
UNCERTAIN = ("uncertain", "unknown", "i don't know", "i do not know", "cannot determine", "can't determine")


def by_table(value, classes: dict[str, list[str]], default: str) -> Column:
    """FLT2: the class whose list holds the value; the default for others and for null."""
    out = None
    for name, members in classes.items():
        hit = col(value).isin(*members)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def first_rule(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """FLT4: the name of the first rule that holds; a rule that comes out null doesn't hold."""
    out = None
    for rule, name in rules:
        held = F.coalesce(rule, F.lit(False))
        out = F.when(held, F.lit(name)) if out is None else out.when(held, F.lit(name))
    return out.otherwise(F.lit(otherwise).cast("string"))


def answer_status(answer, decision, malformed) -> Column:
    """FLT5: malformed, uncertain (by decision or by an answer that says so), or answer."""
    forms = F.array(*[normalize_answer(F.lit(p)) for p in UNCERTAIN])
    return first_rule([(F.coalesce(malformed, F.lit(True)) | col(answer).isNull(), "malformed"), (~col(decision).eqNullSafe(F.lit("answer")), "uncertain"), (F.array_contains(forms, normalize_answer(answer)), "uncertain")], "answer")


def knowledge_group(answer, decision, malformed, gold, aliases) -> Column:
    """FLT9, FLT10: excluded if there is no committed answer, KC if it is right, else KW if it is a clean candidate, else manual_review."""
    return first_rule([(answer_status(answer, decision, malformed) != "answer", "excluded"), (is_match(answer, gold, aliases), "KC"), (is_clean_candidate(answer), "KW")], "manual_review")


#: Why an item makes no conflict trial.
NOT_CONFLICT, REVIEW, UNRECOGNIZED, MULTI_OBJECT = "relation_not_primary_conflict", "relation_requires_review", "relation_unrecognized", "relation_multi_object"


def conflict_reason(relation, subject, multi_object, primary: list[str], review: list[str], excluded: list[str]) -> Column:
    """FLT2-FLT4: why an item makes no conflict trial, null if it does. The relation is judged first; without a relation or a subject it needs review."""
    r = col(relation)
    rules = [(r.isNull(), REVIEW), (r.isin(*excluded), NOT_CONFLICT), (r.isin(*review), REVIEW), (~r.isin(*primary), UNRECOGNIZED), (col(subject).isNull(), REVIEW), (col(multi_object), MULTI_OBJECT)]
    return first_rule(rules)


def assigned_group(group, foil) -> tuple[Column, Column]:
    """FLT9: the knowledge group and the reason for exclusion; a right answer without a foil is excluded."""
    lacks = (col(group) == "KC") & col(foil).isNull()
    return F.when(lacks, F.lit("excluded")).otherwise(col(group)), F.when(lacks, F.lit("no_defensible_foil"))


def eligible(group, conflict_reason_) -> Column:
    """FLT10: a known group, and nothing against a conflict trial."""
    return F.coalesce(col(group).isin("KC", "KW") & col(conflict_reason_).isNull(), F.lit(False))


def status_breaks(df: DataFrame, status: str, family: str, reason: str, legal: list[tuple[str, str]], unreasoned: str = "NOT APPLICABLE") -> DataFrame:
    """FLT20: rows with a pair that the table of legal ones lacks, or that aren't applicable without a reason; ``breach`` says which."""
    allowed = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in legal])
    known = F.coalesce(F.array_contains(allowed, F.struct(F.col(status).alias("x"), F.col(family).alias("y"))), F.lit(False))
    bare = (F.col(status) == unreasoned) & (F.coalesce(F.trim(reason), F.lit("")) == "")
    return df.withColumn("breach", first_rule([(~known, "illegal pair"), (bare, "no reason")])).where("breach is not null")


def illegal_pairs(df: DataFrame, a: str, b: str, legal: list[tuple[str, str]]) -> DataFrame:
    """FLT20: distinct (a, b) of the rows that the table of legal pairs lacks."""
    allowed = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in legal])
    return df.select(a, b).distinct().where(~F.coalesce(F.array_contains(allowed, F.struct(F.col(a).alias("x"), F.col(b).alias("y"))), F.lit(False)))


def mark_listed(df: DataFrame, key: str, listed: DataFrame, column: str, mark: str) -> DataFrame:
    """FLT21, JN16: df with the mark in the column where the key is listed; a null key never is."""
    ids = listed.select(F.col(key).alias("_key")).where("_key is not null").distinct()
    joined = df.join(ids, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(column, F.when(F.col("_key").isNotNull(), F.lit(mark)).otherwise(F.col(column))).drop("_key")


def combined_reason(df: DataFrame, groups: list[str], reason: str) -> DataFrame:
    """AGG33: the one reason of a group, or 'mixed:' and its reasons in order."""
    per = df.groupBy(*groups).agg(F.array_sort(F.collect_set(reason)).alias("_r")) if groups else df.agg(F.array_sort(F.collect_set(reason)).alias("_r"))
    return per.select(*groups, F.when(F.size("_r") == 1, F.col("_r")[0]).when(F.size("_r") > 1, F.concat(F.lit("mixed:"), F.concat_ws(",", "_r"))).alias("reason"))


def bundle(parts: dict[str, DataFrame], columns: list[str], label: str = "cohort") -> DataFrame:
    """SMP7: the parts' columns one below the other, each row with its part's name."""
    return reduce(lambda a, b: a.unionByName(b), [d.select(F.lit(name).alias(label), *columns) for name, d in parts.items()])


def study_table(trials: DataFrame, specs: list[dict], keys: list[str], condition: str = "condition", outcome: str = "context_adopted") -> DataFrame:
    """RUN11: all contrasts of a study from one pass: a trial is repeated for each contrast it has a side in, paired and counted.

    A spec has name, a, b (conditions) and may have where (a filter).
    """
    sides = F.array_compact(F.array(*[
        F.when(F.coalesce(s.get("where", F.lit(True)), F.lit(False)) & F.col(condition).isin(s["a"], s["b"]), F.struct(F.lit(s["name"]).alias("contrast"), F.when(F.col(condition) == s["a"], F.lit("a")).otherwise(F.lit("b")).alias("side")))
        for s in specs
    ]))
    long = trials.select(*keys, outcome, F.inline(sides))
    paired = pair_items(long, ["contrast", *keys], "side", outcome, F.lit("a"), F.lit("b"))
    return report(cells(paired, ["contrast"]))
