"""Incremental versions for records that arrive in files.

Survey operators: RUN7, SNK4 as a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.strata import first_block_met, supply_by_block


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """New JSON-lines files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def deduplicated(stream: DataFrame, key: list[str], event_time: str, delay: str) -> DataFrame:
    """Rows whose key hasn't come within the delay; the state of older keys is dropped by the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, keys: list[str], event_time: str, width: str, delay: str) -> DataFrame:
    """Rows per key and window of event time, with late rows taken in up to the delay."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


class Screening:
    """RUN7: blocks are taken in until every cell has its supply or the ceiling is reached.

    ``take`` is a foreachBatch function. Rows seen so far are kept in a table, strata are
    computed again over all of them after each batch, as later blocks move the edges.
    """

    def __init__(self, table: str, groups: list[str], value: str, cell: list[str], cells: int, least: int, ceiling_blocks: int):
        self.table, self.groups, self.value, self.cell = table, groups, value, cell
        self.cells, self.least, self.ceiling = cells, least, ceiling_blocks
        self.reason: str | None = None

    def take(self, batch: DataFrame, batch_id: int) -> None:
        if self.reason:
            return
        spark = batch.sparkSession
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{self.table}/b={batch_id}")
        seen = spark.read.parquet(self.table)
        supply = supply_by_block(seen, self.groups, self.value, self.cell)
        groups, met = first_block_met(supply, self.groups, self.cells, self.least).agg(F.count("*"), F.count("stop_block")).first()
        blocks = seen.agg(F.max("block_index")).first()[0]
        if groups and groups == met:
            self.reason = "supply_criteria_met"
        elif blocks is not None and blocks + 1 >= self.ceiling:
            self.reason = "ceiling_reached"

    def outcome(self) -> str:
        return self.reason or "supply_not_met"
