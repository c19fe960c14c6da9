"""Raw items to interim items; indexes over groups of items.

Survey operators: FLT1, FLT14, AGG1-AGG3, JN1, FLT3, SET1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import normalize_answer, parse_alias_field, strip


def exclusion_reason(question: str = "question", gold: str = "obj") -> Column:
    """FLT1: why a raw item is left out; the question is looked at first. Null if it stays."""
    blank = lambda c: strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    return F.when(blank(question), F.lit("empty_question")).when(blank(gold), F.lit("empty_gold_answer"))


def build_interim(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interim items and exclusions (id, reason). Aliases of both fields are joined, sorted and made distinct (SET1)."""
    marked = raw.withColumn("_reason", exclusion_reason())
    text = dict(raw.dtypes)
    read = lambda c: (F.coalesce(F.col(c), F.array().cast("array<string>")) if text[c].startswith("array") else parse_alias_field(c)) if c in text else F.array().cast("array<string>")
    kept = marked.where("_reason is null").select(
        F.col("id").cast("string").alias("id"), "subj", "prop", "obj", strip("question").alias("question"),
        F.array_sort(F.array_union(read("o_aliases"), read("possible_answers"))).alias("aliases"), normalize_answer("obj").alias("gold_normalized"),
    )
    return kept, marked.where("_reason is not null").select(F.col("id").cast("string").alias("id"), F.col("_reason").alias("reason"))


def require_ids(df: DataFrame, id_col: str = "item_id") -> DataFrame:
    """FLT14: the ids as strings; a null or empty one is an error when the plan runs."""
    ok = F.col(id_col).isNotNull() & (F.col(id_col).cast("string") != "")
    return df.withColumn(id_col, F.when(ok, F.col(id_col).cast("string")).otherwise(F.raise_error(F.lit(f"{id_col} is missing")).cast("string")))


def object_counts(items: DataFrame, keys: list[str], obj: str = "obj") -> DataFrame:
    """AGG1: number of different normalised objects of each key."""
    return items.groupBy(*keys).agg(F.countDistinct(normalize_answer(obj)).alias("n_objects"))


def with_multiplicity(items: DataFrame, keys: list[str], obj: str = "obj") -> DataFrame:
    """JN1, FLT3: each item with its key's number of objects; a key with a null part has 0 and isn't multiple."""
    counts = object_counts(items.where(" and ".join(f"{k} is not null" for k in keys)), keys, obj)
    out = items.join(counts, keys, "left").withColumn("n_objects", F.coalesce("n_objects", F.lit(0)))
    return out.withColumn("multi_object", F.col("n_objects") > 1)


def smallest_per_key(items: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """AGG3: of each key the row with the smallest id as text, whatever the order of the rows. One shuffle, no sort."""
    rest = [c for c in items.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.col(id_col).cast("string"))
    return items.groupBy(*keys).agg(row.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
