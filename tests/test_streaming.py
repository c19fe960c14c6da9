import json
import os

from pyspark.sql import functions as F

from cairnstat.operators.strata import blocks, first_block_met, supply_by_block
from cairnstat.streaming import screening


def test_stream_stops_at_the_block_of_the_batch_plan(spark, tmp_path):
    d = spark.createDataFrame([(f"i{k:04d}", "r", float((k * 37) % 101)) for k in range(600)], "item_id string, relation string, margin double")
    cut = blocks(d, "item_id", 50, groups=["relation"])
    expected = first_block_met(supply_by_block(cut, ["relation"], "margin", []), ["relation"], 3, 60).first().stop_block
    folder = tmp_path / "in"
    os.makedirs(folder)
    rows = cut.orderBy("row_no").collect()
    for b in range(12):
        path = folder / f"block_{b:04d}.json"
        path.write_text("".join(json.dumps(r.asDict()) + "\n" for r in rows if r.block_index == b))
        os.utime(path, (1_700_000_000 + b, 1_700_000_000 + b))
    state = screening.Screening(str(tmp_path / "seen"), ["relation"], "margin", [], 3, 60, 40)
    stream = screening.read_stream(spark, str(folder), cut.schema)
    q = stream.writeStream.foreachBatch(state.take).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert state.outcome() == "supply_criteria_met"
    assert spark.read.parquet(str(tmp_path / "seen")).agg(F.max("block_index")).first()[0] == expected


def test_keys_come_once_and_windows_count(spark, tmp_path):
    folder = tmp_path / "in"
    os.makedirs(folder)
    lines = [{"k": "a", "ts": "2025-01-01T00:00:00"}, {"k": "a", "ts": "2025-01-01T00:00:30"}, {"k": "b", "ts": "2025-01-01T00:02:00"}]
    (folder / "x.json").write_text("".join(json.dumps(x) + "\n" for x in lines))
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("ts", T.TimestampType())])
    out = {}
    for name, made in (("once", lambda s: screening.deduplicated(s, ["k"], "ts", "10 minutes")), ("counts", lambda s: screening.windowed_counts(s, ["k"], "ts", "1 minute", "10 minutes"))):
        q = made(screening.read_stream(spark, str(folder), schema)).writeStream.format("memory").queryName(name).outputMode("append" if name == "once" else "complete").option("checkpointLocation", str(tmp_path / f"cp{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        out[name] = spark.table(name).collect()
    assert sorted(r.k for r in out["once"]) == ["a", "b"]
    assert sorted((r.k, r.n) for r in out["counts"]) == [("a", 2), ("b", 1)]
