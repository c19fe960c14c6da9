"""A wrong answer of the same kind for each item, drawn by a keyed hash.

Survey operators: AGG2, JN2.

The draw of one item depends on the item and the seed alone, not on the rows around it.
Objects of a relation are reduced to the distinct ones and put in hash order, once. An
item's draw is the first object at or after its own place in that ring that is no right
answer. An item is never paired with all objects: it is joined with the next few of the
ring by position and, only where all of them are right answers, with the first position
of the ring that none of its right answers holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from ..functions.digest import sha256
from ..functions.text import alias_set, normalize_answer


def relation_index(items: DataFrame, relation: str = "prop", obj: str = "obj", id_col: str = "item_id") -> DataFrame:
    """AGG2: relation, form, obj, source_item_id, n_ids: each distinct object of a relation with the smallest id that has it."""
    form = normalize_answer(obj)
    return (
        items.where(F.col(relation).isNotNull() & (form != ""))
        .groupBy(F.col(relation).alias("relation"), form.alias("form"))
        .agg(F.min_by(obj, F.col(id_col).cast("string")).alias("obj"), F.min(F.col(id_col).cast("string")).alias("source_item_id"))
    )


def draw_foils(items: DataFrame, seed: int = 42, relation: str = "prop", obj: str = "obj", aliases: str = "aliases", id_col: str = "item_id", tries: int = 8) -> DataFrame:
    """item_id, foil_answer, foil_source_item_id (null where the relation has no other answer).

    Each item of the relation has a place in the ring from its own hash; the foil is the
    first object behind that place which isn't one of its right answers. ``tries`` objects
    are looked at in the first pass; items for which all of them are right answers take
    the first object of the ring that is none, so no item is lost.
    """
    index = relation_index(items, relation, obj, id_col)
    # a relation's ring is cut into 4096 arcs by the hash, so no relation is one window
    placed = index.withColumn("place", sha256(F.concat_ws("|", F.lit("ring"), F.lit(str(seed)), "relation", "form"))).withColumn("arc", F.substring("place", 1, 3))
    arcs = placed.groupBy("relation", "arc").agg(F.count("*").alias("c"))
    over = W.partitionBy("relation")
    offsets = arcs.select("relation", "arc", F.coalesce(F.sum("c").over(over.orderBy("arc").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    objects = placed.withColumn("rank", F.row_number().over(W.partitionBy("relation", "arc").orderBy("place", "form"))).join(offsets, ["relation", "arc"]).withColumn("pos", F.col("rank") + F.col("offset") - 1)
    sized = arcs.groupBy("relation").agg(F.sum("c").alias("n"))
    right = alias_set(obj, aliases)
    own = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item_id"), F.col(relation).alias("relation"), right.alias("right"))
    start = F.pmod(F.conv(F.substring(sha256(F.concat_ws("|", F.lit(str(seed)), "item_id")), 1, 12), 16, 10).cast("bigint"), F.col("n"))
    probes = (
        own.join(sized, "relation")
        .withColumn("start", start)
        .select("item_id", "relation", "right", F.posexplode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(tries), F.col("n").cast("int")).cast("bigint") - 1), lambda k: F.pmod(F.col("start") + k, F.col("n")))).alias("step", "pos"))
        .join(objects.select("relation", "pos", "form", "obj", "source_item_id"), ["relation", "pos"])
        .where(~F.array_contains("right", F.col("form")))
    )
    first = probes.groupBy("item_id").agg(F.min_by(F.struct("obj", "source_item_id"), "step").alias("f"))
    # whole relations of right answers within the tries: rank the right answers away
    unmet = own.join(first.select("item_id"), "item_id", "left_anti")
    taken = unmet.join(sized, "relation").where(F.col("n") > tries).select("item_id", "relation", F.explode("right").alias("form")).join(objects.select("relation", "form", "pos"), ["relation", "form"])
    gaps = taken.groupBy("item_id", "relation").agg(F.array_sort(F.collect_set("pos")).alias("used"))
    free = gaps.select("item_id", "relation", F.filter(F.sequence(F.lit(0), F.size("used")), lambda k: ~F.array_contains("used", k))[0].alias("pos"))
    second = free.join(objects, ["relation", "pos"]).select("item_id", F.struct("obj", "source_item_id").alias("f"))
    found = first.unionByName(second)
    return own.select("item_id").join(found, "item_id", "left").select("item_id", F.col("f.obj").alias("foil_answer"), F.col("f.source_item_id").alias("foil_source_item_id"))
