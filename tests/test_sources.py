import hashlib
import json
import os

import pytest
from pyspark.sql import types as T

from cairnstat.sources import jsonl

SCHEMA = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("x", T.IntegerType())])


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_read_skips_blank_lines_and_fails_on_broken_ones(spark, tmp_path):
    good, bad = str(tmp_path / "g/a.jsonl"), str(tmp_path / "b/a.jsonl")
    write(good, '{"item_id": "a", "x": 1}\n\n{"item_id": "b"}\n')
    write(bad, '{"item_id": "a"\n')
    assert [tuple(r) for r in jsonl.read_jsonl(spark, good, SCHEMA).orderBy("item_id").collect()] == [("a", 1), ("b", None)]
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, bad, SCHEMA).collect()
    assert jsonl.read_jsonl(spark, str(tmp_path / "none"), SCHEMA, missing_ok=True).count() == 0
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, str(tmp_path / "none"), SCHEMA).collect()


def test_blocks_are_written_read_and_verified(spark, tmp_path):
    root = str(tmp_path / "run")
    for model, block in (("m1", 0), ("m1", 1), ("m1", 3), ("m2", 0)):
        jsonl.write_block(spark.createDataFrame([(f"{model}{block}", block)], SCHEMA), root, model, block, {"phase": "p"})
    got = {(r.model_key, r.block_index): r.item_id for r in jsonl.read_blocks(spark, root, SCHEMA).collect()}
    assert got == {("m1", 0): "m10", ("m1", 1): "m11", ("m1", 3): "m13", ("m2", 0): "m20"}
    assert jsonl.read_blocks(spark, root, SCHEMA, "m2").count() == 1
    assert sorted((r.model_key, r.block_index) for r in jsonl.verified_blocks(spark, root).collect()) == [("m1", 0), ("m1", 1), ("m2", 0)]
    with open(f"{root}/m1/blocks/block_0001.jsonl", "a") as f:
        f.write("{}\n")
    with pytest.raises(Exception):
        jsonl.verified_blocks(spark, root).collect()
    with pytest.raises(FileNotFoundError):
        jsonl.read_blocks(spark, str(tmp_path / "none"), SCHEMA)


def test_append_takes_each_key_once(spark, tmp_path):
    path = str(tmp_path / "log")
    kind = "record_key string, v int"
    assert jsonl.append_new(spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], kind), path) == 2
    assert jsonl.append_new(spark.createDataFrame([("b", 9), ("c", 3)], kind), path) == 1
    assert sorted(tuple(r) for r in spark.read.schema(kind).json(path).collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_canonical_lines_keep_nulls_and_order(spark, tmp_path):
    d = spark.createDataFrame([("b", None), ("a", 1)], SCHEMA)
    assert [r.value for r in jsonl.canonical_lines(d, ["item_id"]).collect()] == ['{"item_id":"a","x":1}', '{"item_id":"b","x":null}']
    one = jsonl.write_canonical(d, str(tmp_path / "c"), ["item_id"])
    two = jsonl.write_canonical(d.repartition(3), str(tmp_path / "d"), ["item_id"])
    assert len(one) == 64 and len(two) == 64
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "c")).collect()) == ['{"item_id":"a","x":1}', '{"item_id":"b","x":null}']
    text, digest = jsonl.canonical_json({"b": 1, "a": None})
    assert json.loads(text) == {"a": None, "b": 1} and digest == hashlib.sha256(text.encode()).hexdigest()


def test_exclusions_and_templates(spark, tmp_path):
    path, t = str(tmp_path / "e.json"), str(tmp_path / "t.txt")
    write(path, json.dumps({"item_ids": ["a", "b", "a"]}))
    write(t, "x {a}\n")
    ids, digest = jsonl.read_exclusions(spark, path)
    assert sorted(r.item_id for r in ids.collect()) == ["a", "b"] and len(digest) == 64
    assert jsonl.read_template(spark, t) == "x {a}\n"


def test_overwrite(spark, tmp_path):
    for x in (1, 2):
        jsonl.write_jsonl(spark.createDataFrame([("a", x)], SCHEMA), str(tmp_path / "o"))
    assert [r.x for r in spark.read.schema(SCHEMA).json(str(tmp_path / "o")).collect()] == [2]
