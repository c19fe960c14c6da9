"""Problem 7: texts of several sources mixed to target shares of the total size in tokens.

The total is the largest for which every source that has texts can give its share without
using a text more than max_repeats times. It is dealt out in blocks of equal size by
Sainte-Lague apportionment: the next block goes to the source with the highest quotient
share / (2 blocks + 1); within a source, blocks are dealt to shards of its texts the same
way by the shards' sizes. Both are small tables (sources; shards of bounded size), solved
by bisection on the quotient, so no loop runs over blocks. In each shard, running sums of
the texts' sizes in the order of their ids cut them into blocks of about ``draw_tokens``,
and the blocks are drawn in a seeded order until the shard's quota is met: whole passes
first, then blocks of one more, of the last one only the texts that are needed.

A source without a target gives nothing; a target whose source has no text can't be met,
is reported with actual share 0, and the others keep their shares to each other. A null
source is a source of its own and has no target. Null and empty texts have no tokens and
are never drawn. A null or negative target or a null max_repeats counts as 0. Copies of
one text within a source, under one id or several, are one text, drawn under its smallest
id: its uses together keep to max_repeats. Empty tables give an empty mix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, functions as F, Window as W

from ..session import materialize
from .tokens import TOKENIZER, sizes


@dataclass(frozen=True)
class MixParams:
    seed: int = 42
    block_tokens: int = 256  # unit of the apportionment
    draw_tokens: int = 2048  # about the size of the blocks of texts that are drawn
    shard_tokens: int = 2_000_000  # least size of a shard of one source
    max_shards: int = 10_000  # about as many shards at most, however large the corpus: they grow with it
    total_tokens: int | None = None  # None: as much as the shares and max_repeats allow
    max_sources: int = 100_000
    tokenizer: str = TOKENIZER


def sainte_lague(weights: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by highest quotients weight / (2 k + 1), none above its cap; equal quotients in list order.

    A party has won k seats when its k-th quotient is above a threshold, so the threshold
    is bisected and only the last seats are dealt one by one.
    """
    n = len(weights)
    caps = [seats] * n if caps is None else caps
    w = [Fraction(x) if x and x > 0 else Fraction(0) for x in weights]
    able = [c if x > 0 else 0 for c, x in zip(caps, w)]
    if seats >= sum(able):
        return able

    def won(t: Fraction) -> list[int]:
        # quotients w / (2 k - 1) >= t for k = 1 .. (w / t + 1) / 2
        return [min(c, math.floor((x / t + 1) / 2)) if x > 0 else 0 for x, c in zip(w, able)]

    low, high = min(x for x in w if x > 0) / (2 * seats + 2 * max(able) + 1), max(w) * 2
    while sum(won(low)) <= seats:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        if sum(won(mid)) > seats:
            low = mid
        else:
            high = mid
            if sum(won(mid)) >= seats - n:
                break
    got = won(high)
    while sum(got) < seats:
        k = max((k for k in range(n) if got[k] < able[k]), key=lambda k: (w[k] / (2 * got[k] + 1), -k))
        got[k] += 1
    return got


def shard_sizes(documents: DataFrame, targets: DataFrame, params: MixParams = MixParams()) -> tuple[DataFrame, list[dict]]:
    """Texts of sources with a target (doc_id, source, shard, order, n_tokens), and the size of each shard."""
    goals = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    own = documents.where("doc_id is not null and text is not null").withColumn("text_key", F.sha2("text", 256)).join(goals.where("share > 0 and repeats > 0").select("source"), "source", "left_semi")
    sized = sizes(own, "doc_id", "text", ["source", "text_key"], params.tokenizer).where("n_tokens > 0")
    sized = materialize(sized.groupBy("source", "text_key").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens")), "sizes")
    held = {r["source"]: r["t"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t")).limit(params.max_sources + 1).collect()}
    if len(held) > params.max_sources:
        raise ValueError(f"more than {params.max_sources} sources")
    size = max(params.shard_tokens, -(-sum(held.values()) // params.max_shards))
    shards = {s: max(1, t // size) for s, t in held.items()}
    # as many rows as sources: a small table, whatever the size of the corpus
    counts = sized.sparkSession.createDataFrame(sorted(shards.items()), "source string, shards bigint")
    place = F.xxhash64(F.lit(params.seed), F.col("doc_id"))
    texts = sized.join(counts, "source").select("doc_id", "source", F.pmod(place, F.col("shards")).cast("int").alias("shard"), "n_tokens")
    sums = [r.asDict() for r in texts.groupBy("source", "shard").agg(F.sum("n_tokens").alias("tokens")).orderBy("source", "shard").collect()]
    return texts, sums


def quotas(goals: list[tuple[str, float, int]], shards: list[dict], params: MixParams) -> dict[tuple[str, int], int]:
    """Tokens that each shard of each source is to give."""
    size: dict[str, int] = {}
    for s in shards:
        size[s["source"]] = size.get(s["source"], 0) + s["tokens"]
    live = [(s, share, reps) for s, share, reps in goals if share and share > 0 and reps and reps > 0 and size.get(s)]
    if not live:
        return {}
    room = {s: reps * size[s] for s, _, reps in live}
    total = min(room[s] / share for s, share, _ in live) * sum(share for _, share, _ in live)
    if params.total_tokens is not None:
        total = params.total_tokens
    # small mixes are cut finer, so that a block is at most a 4096th of the whole
    block = max(1, min(params.block_tokens, int(total) // 4096))
    blocks = sainte_lague([share for _, share, _ in live], int(total) // block, [room[s] // block for s, _, _ in live])
    out = {}
    by_source: dict[str, list[dict]] = {}
    for x in shards:
        by_source.setdefault(x["source"], []).append(x)
    for (s, _, reps), k in zip(live, blocks):
        own = by_source[s]
        for x, q in zip(own, sainte_lague([float(x["tokens"]) for x in own], k, [reps * x["tokens"] // block for x in own])):
            out[(s, x["shard"])] = q * block
    return out


def mix(documents: DataFrame, targets: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """doc_id, source, n_tokens, copies: how often each drawn text is used."""
    spark = documents.sparkSession
    texts, shards = shard_sizes(documents, targets, params)
    goals = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).orderBy("source").limit(params.max_sources + 1).collect()]
    if len(goals) > params.max_sources:
        raise ValueError(f"more than {params.max_sources} sources")
    wanted = quotas(goals, shards, params)
    limit = {s: reps for s, _, reps in goals}
    held = {(x["source"], x["shard"]): x["tokens"] for x in shards}
    rows = [(s, k, q // held[(s, k)], q % held[(s, k)], limit[s]) for (s, k), q in sorted(wanted.items())]
    quota = spark.createDataFrame(rows, "source string, shard int, passes bigint, rest bigint, most int")
    # texts that lie together by id make a block; the blocks of a shard are drawn in a seeded order
    shard = W.partitionBy("source", "shard")
    before = F.sum("n_tokens").over(shard.orderBy("doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n_tokens")
    placed = texts.withColumn("block", F.floor(before / F.lit(params.draw_tokens)))
    run = shard.orderBy(F.xxhash64(F.lit(params.seed + 1), "block"), "block", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    drawn = placed.withColumn("upto", F.sum("n_tokens").over(run)).join(quota, ["source", "shard"])
    # the last text of the quota is taken if at least half of it lies within
    extra = (F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest")).cast("bigint")
    copies = F.least(F.col("passes") + extra, F.col("most").cast("bigint"))
    return drawn.select("doc_id", "source", "n_tokens", copies.cast("int").alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target with what was reached: tokens, share of the mix, texts, copies, and the difference from the target."""
    reached = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("texts"), F.sum("copies").alias("uses"), F.max("copies").alias("most_copies"))
    reached = materialize(reached, "shares")
    total = reached.agg(F.sum("tokens")).first()[0] or 1
    zero = F.lit(0).cast("bigint")
    share = F.coalesce(F.col("tokens") / F.lit(total), F.lit(0.0))
    return targets.join(reached, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", zero).alias("tokens"), share.alias("actual_share"), (share - F.col("target_share")).alias("difference"), F.coalesce("texts", zero).alias("texts"), F.coalesce("uses", zero).alias("uses"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
