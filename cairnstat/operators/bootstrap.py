"""Percentile interval of a mean paired difference over resamples.

Survey operator: AGG29.

A pair's difference is -1, 0 or 1, so a resample of n pairs is a draw of three counts.
Only each group's counts are needed: the resamples of all groups are drawn from them in
one task a (group, chunk), seeded by group and chunk, so the result is the same however
the work is spread.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import ship

CHUNKS = 20


def bootstrap_interval(tables: DataFrame, groups: list[str], resamples: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """groups, n, estimate, ci_lower, ci_upper of (a_only - b_only) / n; null for n = 0."""
    kinds = {f.name: f.dataType.simpleString() for f in tables.schema if f.name in groups}
    per = resamples // CHUNKS
    ship(tables.sparkSession)

    def draw(batches):
        for b in batches:
            for row in b.itertuples(index=False):
                own = row._asdict() if hasattr(row, "_asdict") else dict(zip(b.columns, row))
                n = int(own["n"])
                key = "|".join(str(own[g]) for g in groups)
                rng = np.random.default_rng([seed, zlib.crc32(key.encode()), int(own["chunk"])])
                got = rng.multinomial(n, [own["a_only"] / n, own["b_only"] / n, (n - own["a_only"] - own["b_only"]) / n], per)
                out = pd.DataFrame({"d": (got[:, 0] - got[:, 1]) / n})
                for g in groups:
                    out[g] = own[g]
                yield out[[*groups, "d"]]

    base = tables.select(*groups, "n", "a_only", "b_only")
    spread = base.where("n > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1))))
    drawn = spread.mapInPandas(draw, ", ".join([f"`{g}` {kinds[g]}" for g in groups] + ["d double"]))
    tail = (1 - level) / 2
    ci = drawn.groupBy(*groups).agg(F.percentile("d", F.array(F.lit(tail), F.lit(1 - tail))).alias("_q"))
    joined = base.join(ci, groups, "left") if groups else base.crossJoin(ci)
    return joined.select(*groups, "n", F.when(F.col("n") > 0, (F.col("a_only") - F.col("b_only")) / F.col("n")).alias("estimate"), F.col("_q")[0].alias("ci_lower"), F.col("_q")[1].alias("ci_upper"))
