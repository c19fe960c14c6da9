"""Votes of pairs of sources: statistics, matrix, ranking, stability.

Survey operators: AGG13-AGG16.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def pairwise_stats(trials: DataFrame) -> DataFrame:
    """AGG13: votes of each (source_a, source_b) over both presentation orders; an unread choice is a trial, not a vote."""
    voted = F.col("selected_source").isNotNull()
    n_valid = F.count_if(voted)
    a = F.count_if(F.col("selected_source") == F.col("source_a"))
    return trials.groupBy("source_a", "source_b").agg(F.count("*").alias("n_trials"), n_valid.alias("n_valid"), a.alias("a_wins"), F.count_if(F.col("selected_source") == F.col("source_b")).alias("b_wins"), F.when(n_valid > 0, a / n_valid).alias("p_a_preferred"))


def pooled(stats: DataFrame) -> DataFrame:
    """Statistics rows of one pair added up, source_a first in code-point order; a row delivered twice counts once."""
    rows = stats.select("stat_id", "source_a", "source_b", "n_trials", "n_valid", "a_wins", "b_wins").dropDuplicates().where("source_a is not null and source_b is not null and source_a <> source_b")
    swap = F.col("source_a") > F.col("source_b")
    rows = rows.select(F.least("source_a", "source_b").alias("source_a"), F.greatest("source_a", "source_b").alias("source_b"), "n_trials", "n_valid", F.when(swap, F.col("b_wins")).otherwise(F.col("a_wins")).alias("a_wins"), F.when(swap, F.col("a_wins")).otherwise(F.col("b_wins")).alias("b_wins"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    out = rows.groupBy("source_a", "source_b").agg(*[total(c) for c in ("n_trials", "n_valid", "a_wins", "b_wins")])
    return out.withColumn("p_a_preferred", F.when(F.col("n_valid") > 0, F.col("a_wins") / F.col("n_valid")))


def _sides(stats: DataFrame) -> DataFrame:
    both = F.array(
        F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("other"), F.col("p_a_preferred").alias("p"), F.col("a_wins").alias("wins")),
        F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("other"), (1 - F.col("p_a_preferred")).alias("p"), F.col("b_wins").alias("wins")),
    )
    return stats.select(F.inline(both), "n_valid")


def preference_matrix(stats: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """AGG14: long form source, other, p with p and 1 - p; with labels given, one column a label, null on the diagonal."""
    sides = _sides(stats).select("source", "other", "p")
    return sides if labels is None else sides.groupBy("source").pivot("other", labels).agg(F.max("p"))


def rank_sources(stats: DataFrame) -> DataFrame:
    """AGG15: mean pairwise rate, wins and valid trials of each source over pairs with a valid trial; ties by name."""
    return _sides(stats).where("p is not null").groupBy("source").agg(F.avg("p").alias("mean_pairwise_preference_rate"), F.sum("wins").alias("wins"), F.sum("n_valid").alias("total_valid_trials")).orderBy(F.desc("mean_pairwise_preference_rate"), "source")


def stability(stats: DataFrame) -> DataFrame:
    """AGG16: pairs, undivided and tied ones, and rows whose wins don't add up to their valid trials."""
    return stats.agg(F.count("*").alias("pairs"), F.count_if((F.col("n_valid") > 0) & ((F.col("a_wins") == 0) | (F.col("b_wins") == 0))).alias("stable_pairs"), F.count_if((F.col("n_valid") > 0) & (F.col("a_wins") == F.col("b_wins"))).alias("tied_pairs"), F.count_if(F.col("a_wins") + F.col("b_wins") != F.col("n_valid")).alias("inconsistent_rows"))
