"""Integrity checks that return the rows that fail.

Survey operators: JN12-JN14, SET4, SET5, FLT11, VER1-VER3, VER12 (as to_json).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W


def bijection(planned: DataFrame, returned: DataFrame, key: str | list[str]) -> DataFrame:
    """JN12: key, planned, returned of keys (of one or several columns) that aren't exactly once on both sides."""
    key = [key] if isinstance(key, str) else key
    p = planned.groupBy(*key).agg(F.count("*").alias("planned"))
    r = returned.groupBy(*key).agg(F.count("*").alias("returned"))
    zero = F.lit(0).cast("bigint")
    return p.join(r, key, "full_outer").select(*key, F.coalesce("planned", zero).alias("planned"), F.coalesce("returned", zero).alias("returned")).where("planned <> 1 or returned <> 1")


def prefix_breaks(done: DataFrame, planned: DataFrame, id_col: str, position: str) -> DataFrame:
    """JN13: positions at which the rows done aren't the first rows planned."""
    d, p = done.select(F.col(position).alias("position"), F.col(id_col).alias("done_id")), planned.select(F.col(position).alias("position"), F.col(id_col).alias("planned_id"))
    return d.join(p, "position", "left").where("not (done_id <=> planned_id)")


def block_gaps(blocks: DataFrame, groups: list[str], block: str = "block_index") -> DataFrame:
    """JN14, SRC7: blocks behind the first gap of their group's numbering from 0."""
    rn = F.row_number().over(W.partitionBy(*groups).orderBy(block)) - 1
    return blocks.select(*groups, block).distinct().withColumn("expected", rn).where(F.col(block) != F.col("expected"))


def contiguous_prefix(blocks: DataFrame, groups: list[str], block: str = "block_index") -> DataFrame:
    """SRC7: the blocks of each group before its first gap."""
    rn = F.row_number().over(W.partitionBy(*groups).orderBy(block)) - 1
    return blocks.select(*groups, block).distinct().withColumn("_e", rn).where(F.col(block) == F.col("_e")).drop("_e")


def only_in_first(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """SET5: distinct keys of a that b lacks; nulls are compared as values."""
    return a.select(*keys).subtract(b.select(*keys))


def in_both(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """SET4: distinct keys of both."""
    return a.select(*keys).intersect(b.select(*keys))


def in_either(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """SET3: distinct keys of either."""
    return a.select(*keys).union(b.select(*keys)).distinct()


def forbidden_columns(df: DataFrame, forbidden: set[str]) -> list[str]:
    """FLT11: columns, nested ones included, that must not be there. Read from the schema, no job runs."""
    found = []

    def walk(schema, at):
        for field in schema.fields:
            if field.name in forbidden:
                found.append(f"{at}{field.name}")
            kind = getattr(field.dataType, "elementType", field.dataType)
            if hasattr(kind, "fields"):
                walk(kind, f"{at}{field.name}.")

    walk(df.schema, "")
    return sorted(found)


def failures(df: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """VER2, VER3: one row for each key and failed check; a check that comes out null has failed. All checks run."""
    marks = F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(name)) for name, ok in checks.items()]))
    return df.select(*keys, F.explode(marks).alias("failure"))


def checksums(lines: DataFrame) -> DataFrame:
    """VER1: sha256 and name of each line of a checksums file (column value); comments, blanks and the binary star are allowed."""
    pattern = r"^\s*([0-9a-fA-F]{64})\s+\*?(.+?)\s*$"
    return lines.select(F.lower(F.regexp_extract("value", pattern, 1)).alias("sha256"), F.regexp_extract("value", pattern, 2).alias("name")).where("sha256 <> ''")


def verify_files(files: DataFrame, expected: DataFrame) -> DataFrame:
    """VER1: name, failure: files that are missing or whose content has another digest. files: path, content (binaryFile)."""
    own = files.select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("found"))
    return expected.join(own, "name", "left").select("name", F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "altered").alias("failure")).where("failure is not null")


def raise_if_any(bad: DataFrame, what: str) -> None:
    """An error that names the first failing rows, if there are any."""
    rows = bad.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")
