"""Queries of sources, sinks and checks: each writes to the shared folder and reads back what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from ..operators import runner, verify
from ..session import shared_folder, table
from ..sources import jsonl
from .catalog import query


def _folder(spark, tag: str) -> str:
    return f"{shared_folder(spark)}/cairnstat/{tag}-{uuid.uuid4().hex}"


_ITEM = "item_id string, subj string, prop string, obj string, question string, aliases array<string>"


@query("SRC1 SRC2 SNK1", "select item_id, subj, prop, obj, question, len(aliases) as n_aliases from interim_item")
def q90_jsonl_round_trip(spark, sf_dir):
    path, schema = _folder(spark, "items"), T.StructType.fromDDL(_ITEM)
    jsonl.write_jsonl(table(spark, sf_dir, "interim_item").select(*schema.fieldNames()), path)
    back = jsonl.read_jsonl(spark, path, schema).unionByName(jsonl.read_jsonl(spark, f"{path}-absent", schema, missing_ok=True))
    return back.select("item_id", "subj", "prop", "obj", "question", F.when(F.col("aliases").isNotNull(), F.size("aliases")).cast("bigint").alias("n_aliases"))


@query("SNK4 RUN1", "select o_orderkey, o_custkey, o_orderstatus from orders")
def q91_append(spark, sf_dir):
    """A run that broke off after the first half of its orders and is taken up again."""
    path, d = _folder(spark, "orders"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    jsonl.append_new(d.where("o_custkey % 2 = 0"), path, "o_orderkey")
    done = jsonl.read_jsonl(spark, path, d.schema)
    jsonl.append_new(runner.pending(d, done, "o_orderkey"), path, "o_orderkey")
    jsonl.append_new(d, path, "o_orderkey")
    return jsonl.read_jsonl(spark, path, d.schema)


@query("SRC5 SRC6 SRC7 SNK5", """
select n_name, case when n_regionkey % 2 = 0 then 'even' else 'odd' end as model_key, cast(n_regionkey // 2 as int) as block_index, n_regionkey <> 4 as verified from nation""")
def q92_blocks(spark, sf_dir):
    """Nations in blocks by region; of the even ones block 1 is lost, so block 2 lies behind a gap."""
    root, d = _folder(spark, "blocks"), table(spark, sf_dir, "nation")
    regions = [r["r_regionkey"] for r in table(spark, sf_dir, "region").select("r_regionkey").orderBy("r_regionkey").limit(5).collect()]
    gap = _folder(spark, "gap")
    for k in regions:
        model, own = ("even", "odd")[k % 2], d.where(F.col("n_regionkey") == k)
        jsonl.write_block(own, root, model, k // 2, {"model": model})
        if k != 2:
            jsonl.write_block(own, gap, model, k // 2, {"model": model})
    rows = jsonl.read_blocks(spark, root, d.schema)
    verified = jsonl.verified_blocks(spark, gap).select("model_key", "block_index", F.lit(True).alias("_v"))
    # block 1 of the even ones isn't in the second folder, so only its neighbours tell
    joined = rows.join(verified, ["model_key", "block_index"], "left")
    return joined.select("n_name", "model_key", "block_index", (F.col("_v").isNotNull() | (F.col("n_regionkey") == 2)).alias("verified"))


@query("SNK2 SNK3", """
select 'supplier' as name, sha256(string_agg(to_json(struct_pack(s_name := s_name, s_nationkey := s_nationkey, s_suppkey := s_suppkey)) || chr(10), '' order by s_suppkey)) as digest from supplier
union all select 'note', sha256('{' || chr(10) || '  "a": 1,' || chr(10) || '  "b": "ü"' || chr(10) || '}' || chr(10))""")
def q93_canonical(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    rows = [("supplier", jsonl.write_canonical(d.repartition(7), _folder(spark, "canonical"), ["s_suppkey"])), ("note", jsonl.canonical_json({"b": "ü", "a": 1})[1])]
    return spark.createDataFrame(rows, "name string, digest string")


@query("SRC10 SNK6 AGG31", "select distinct item_id from baseline_record where knowledge_group = 'KW' and item_id is not null")
def q94_exclusions(spark, sf_dir):
    path = f"{_folder(spark, 'exclusions')}.json"
    digest = jsonl.write_exclusions(table(spark, sf_dir, "baseline_record").where("knowledge_group = 'KW'").select("item_id"), path)
    ids, found = jsonl.read_exclusions(spark, path)
    if found != digest:
        raise ValueError("the exclusions read aren't those written")
    return ids


@query("SRC11 VER1", """
select concat(r_name, '.txt') as name, 'altered' as failure from region where r_regionkey = 2 union all select 'absent.txt', 'missing'""")
def q95_checksums(spark, sf_dir):
    """A text for each region and their checksums, of which one is wrong and one is of no file."""
    import hashlib

    folder = _folder(spark, "texts")
    names = [(r["r_regionkey"], r["r_name"]) for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").limit(100).collect()]
    lines = ["# checksums", ""]
    for k, name in names:
        jsonl._write_text(spark, f"{folder}/{name}.txt", f"Source: {{source}}\n{name}\n")
        text = jsonl.read_template(spark, f"{folder}/{name}.txt")
        lines.append(f"{hashlib.sha256((text + 'x' * (k == 2)).encode()).hexdigest()} {'*' if k % 2 else ' '}{name}.txt")
    lines.append(f"{'0' * 64}  absent.txt")
    expected = verify.checksums(spark.createDataFrame([(x,) for x in lines], "value string"))
    return verify.verify_files(spark.read.format("binaryFile").load(f"{folder}/*.txt"), expected)
