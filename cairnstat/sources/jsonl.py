"""JSON-lines sources and sinks.

Survey operators: SRC1, SRC2, SRC5-SRC7, SRC10-SRC12, SNK1-SNK6.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.digest import synthetic_id
from ..operators.verify import contiguous_prefix
from ..session import materialize


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, missing_ok: bool = False) -> DataFrame:
    """SRC1, SRC2: JSON lines with a fixed schema. Blank lines are skipped, a broken line is an error, and so is a missing file unless ``missing_ok``."""
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_blocks(spark: SparkSession, root: str, schema: T.StructType, model: str | None = None) -> DataFrame:
    """SRC5, SRC6: <root>/<model>/blocks/block_NNNN.jsonl with model_key and block_index read from the paths; none at all is an error."""
    pattern = f"{root.rstrip('/')}/{model or '*'}/blocks/block_*.jsonl"
    if not _exists(spark, pattern):
        raise FileNotFoundError(pattern)
    path = F.col("_metadata.file_path")
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(pattern)
    return rows.select("*", F.regexp_extract(path, r"([^/]+)/blocks/block_\d+\.jsonl$", 1).alias("model_key"), F.regexp_extract(path, r"block_(\d+)\.jsonl$", 1).cast("int").alias("block_index"))


def verified_blocks(spark: SparkSession, root: str) -> DataFrame:
    """SRC7: model_key, block_index, path of the blocks before each model's first gap; a digest that differs from its sidecar's is an error."""
    pattern = f"{root.rstrip('/')}/*/blocks/block_*"
    files = spark.read.format("binaryFile").load(pattern).select("path", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("_text"))
    own = F.regexp_extract("path", r"([^/]+)/blocks/block_\d+\.", 1).alias("model_key"), F.regexp_extract("path", r"block_(\d+)\.", 1).cast("int").alias("block_index")
    blocks = files.where("path like '%.jsonl'").select(*own, "path", "sha256")
    sidecars = files.where("path like '%.meta.json'").select(*own, F.get_json_object("_text", "$.sha256").alias("recorded"))
    joined = blocks.join(sidecars, ["model_key", "block_index"], "left")
    checked = joined.withColumn("path", F.when(F.col("sha256").eqNullSafe(F.col("recorded")), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), F.col("path"))).cast("string")))
    return checked.join(contiguous_prefix(blocks, ["model_key"]), ["model_key", "block_index"], "left_semi").select("model_key", "block_index", "path")


def read_exclusions(spark: SparkSession, path: str, field: str = "item_ids") -> tuple[DataFrame, str]:
    """SRC10: the ids of an exclusion document and the digest of its bytes."""
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    ids = spark.read.option("multiLine", True).schema(f"`{field}` array<string>").json(path).select(F.explode(field).alias("item_id")).distinct()
    return ids, hashlib.sha256(bytes(content)).hexdigest()


def read_template(spark: SparkSession, path: str) -> str:
    """SRC11: a text file as it is, its last line end included."""
    return spark.read.text(path, wholetext=True).first()[0]


def baseline_pool(spark: SparkSession, relations: list[str], groups: list[str], n: int) -> DataFrame:
    """SRC12: n records for each relation and group with evenly spread margins; made by range and arithmetic."""
    cells = [(r, g) for r in relations for g in groups]
    cell = F.floor(F.col("id") / n).cast("int")
    i = F.pmod(F.col("id"), F.lit(n))
    pick = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in cells]), cell + 1)
    rows = spark.range(len(cells) * n).select(pick(0).alias("relation"), pick(1).alias("knowledge_group"), i.alias("i"))
    return rows.select(
        F.concat(synthetic_id("relation", "i"), F.lit("-"), F.col("knowledge_group")).alias("item_id"), "relation", "knowledge_group",
        F.round((F.col("i") + 0.5) / n * 30, 6).alias("parametric_margin"), F.lit(True).alias("synthetic"),
    )


def write_jsonl(df: DataFrame, path: str) -> None:
    """SNK1: JSON lines, an earlier result overwritten; null fields are written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def canonical_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """SNK2: value: each row as JSON with its fields in name order, rows in the given order; null fields are written."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.orderBy(*order).select(row.alias("value"))


def write_canonical(df: DataFrame, path: str, order: list[str]) -> str:
    """SNK2: canonical lines, and the SHA-256 of the file that they make, whatever the partitioning.

    The lines are range-sorted and written in parallel. A digest of bytes in order can't be
    made in parts, so the lines then run through the driver once, one partition at a time.
    """
    lines = materialize(canonical_lines(df, order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "canonical")
    lines.repartitionByRange("at").sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)
    digest = hashlib.sha256()
    for r in lines.orderBy("part", "at").select("value").toLocalIterator(prefetchPartitions=True):
        digest.update(r["value"].encode() + b"\n")
    return digest.hexdigest()


def canonical_json(payload: dict) -> tuple[str, str]:
    """SNK3, SNK6: a small document with sorted keys, and its digest."""
    text = json.dumps(payload, sort_keys=True, ensure_ascii=False, indent=2) + "\n"
    return text, hashlib.sha256(text.encode()).hexdigest()


def write_exclusions(ids: DataFrame, path: str, expected: int | None = None, max_ids: int = 5_000_000) -> str:
    """SNK6, AGG31: the distinct ids, sorted, in one document; a number other than the expected one is an error. Returns the digest of its bytes."""
    spark = ids.sparkSession
    found = sorted(r[0] for r in ids.where(F.col(ids.columns[0]).isNotNull()).distinct().limit(max_ids + 1).collect())
    if len(found) > max_ids:
        raise ValueError(f"more than {max_ids} ids in one document")
    if expected is not None and len(found) != expected:
        raise ValueError(f"{len(found)} ids, expected {expected}")
    text, digest = canonical_json({"count": len(found), "item_ids": found})
    _write_text(spark, path, text)
    return digest


def _write_text(spark: SparkSession, name: str, body: str) -> None:
    """A small file, whole or not at all."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path, tmp = jvm.org.apache.hadoop.fs.Path(name), jvm.org.apache.hadoop.fs.Path(name + ".tmp")
    fs = path.getFileSystem(conf)
    out = fs.create(tmp, True)
    out.write(bytearray(body.encode()))
    out.close()
    fs.delete(path, False)
    fs.rename(tmp, path)


def append_new(df: DataFrame, path: str, key: str = "record_key") -> int:
    """SNK4: append the rows whose key isn't there yet, the first of equal keys within the batch; returns how many."""
    spark = df.sparkSession
    rows = df.dropDuplicates([key])
    if _exists(spark, path):
        rows = rows.join(spark.read.schema(df.schema).json(path).select(key).distinct(), key, "left_anti")
    rows = materialize(rows, "append")
    n = rows.count()
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)
    return n


def write_block(df: DataFrame, root: str, model: str, block: int, meta: dict, max_rows: int = 100_000) -> str:
    """SNK5: one block and then, once it is whole, its sidecar with the digest. A block of more than max_rows is an error."""
    spark = df.sparkSession
    rows = canonical_lines(df, df.columns[:1]).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"a block of more than {max_rows} rows")
    text = "".join(r["value"] + "\n" for r in rows)
    digest = hashlib.sha256(text.encode()).hexdigest()
    base = f"{root.rstrip('/')}/{model}/blocks/block_{block:04d}"
    for name, body in ((f"{base}.jsonl", text), (f"{base}.meta.json", json.dumps(meta | {"block_index": block, "record_count": len(rows), "sha256": digest}, sort_keys=True))):
        _write_text(spark, name, body)
    return digest
