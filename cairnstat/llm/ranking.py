"""Problem 1: one global ranking from pairwise outcomes by skew-symmetric spectral ranking.

Margins are shrunken log odds of each pair, one skew-symmetric matrix M with most pairs
missing; a compared pair's weight is normalised by the square roots of its items' total
weights, so that neither much-compared items nor few-compared ones rule the plane. M is
completed with a rank-two matrix ``s 1' - 1 s'``, s being the potential that fits the
compared pairs best; without the completion the leading plane of a thinly compared set
oscillates. The potential is solved for by conjugate gradients to a small residual. Pairs
at odds with the rest lose weight: first by Huber's rule, near to least absolute residuals,
which a single pair across the ranking can't bend, then by Tukey's biweight, each time with
a new solution. The ranking is read from the leading singular plane of the completed
matrix, which is never formed: its product with a vector is the sparse residual on compared
pairs, summed over the edge table, plus the product of the fit. Lanczos on that operator,
until the residual of the leading pair is small, gives the plane, its projection gives the
strengths, and they are oriented towards agreement with the outcomes. Where a solution
isn't reached within the steps allowed, an error is raised.

Distributed: rows -> pair totals (partial aggregation, so a hot pair is one row per task)
-> edge table in the shared folder -> one aggregation job per product. A table of no
more pairs than one task takes anyway is worked on within that task, in one job.
Driver: vectors of one double per item, checked against ``max_items``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T, Window as W

from ..session import materialize

RANKING_SCHEMA = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("strength", T.DoubleType()),
        T.StructField("strength_rank", T.IntegerType()),
        T.StructField("comparisons", T.LongType()),
        T.StructField("opponents", T.LongType()),
    ]
)


@dataclass(frozen=True)
class RankingParams:
    lanczos_steps: int = 60  # at most; it stops at the residual
    residual: float = 1e-4
    solver_steps: int = 20_000  # of conjugate gradients, in all
    solved: float = 1e-7
    settled: float = 1e-3  # change of a strength at which the weights are settled
    rounds: int = 60  # of new weights, at most, for each of the reweightings
    reweightings: int = 6
    huber_rounds: int = 4
    huber: float = 0.3
    extra_variance: float = 0.02
    biweight: float = 4.685
    max_items: int = 2_000_000
    rows_per_task: int = 500_000


def pair_totals(stats: DataFrame, id_col: str = "stat_id") -> DataFrame:
    """Wins of each unordered pair over all rows, a row delivered twice counting once.

    Rows with a null label, equal labels, null or negative counts or no decided trial are
    no comparison. Rows with a null id can't be known as repeats and all count.
    """
    rows = stats.select(
        F.col(id_col).alias("id"),
        F.col("source_a").alias("a"),
        F.col("source_b").alias("b"),
        F.col("a_wins").cast("long").alias("x"),
        F.col("b_wins").cast("long").alias("y"),
    ).where("a is not null and b is not null and a <> b and x >= 0 and y >= 0 and x + y > 0")
    rows = rows.where("id is not null").dropDuplicates().unionByName(rows.where("id is null"))
    first = F.col("a") < F.col("b")
    return (
        rows.select(
            F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"),
            F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"),
            F.when(first, F.col("x")).otherwise(F.col("y")).alias("x"),
            F.when(first, F.col("y")).otherwise(F.col("x")).alias("y"),
        )
        .groupBy("a", "b")
        .agg(F.sum("x").alias("a_wins"), F.sum("y").alias("b_wins"))
    )


def _lanczos_plane(product, start: np.ndarray, steps: int, residual: float = 1e-6) -> tuple[np.ndarray, float]:
    """Leading singular plane of a skew-symmetric operator and its singular value.

    A skew operator's Lanczos matrix is tridiagonal with a zero diagonal and off-diagonals
    of opposite sign; its singular values come in pairs, the first pair's left vectors
    span the plane. Full reorthogonalisation keeps the short basis exact. The basis grows
    until the residual of the leading pair is a small part of its singular value.
    """
    basis, betas = [start / np.linalg.norm(start)], []
    for _ in range(min(steps, len(start) - 1)):
        w = product(basis[-1])
        for _ in range(2):
            for v in basis:
                w = w - v * (v @ w)
        beta = float(np.linalg.norm(w))
        if beta <= 1e-10 * max([1e-30, *betas]):
            break
        betas.append(beta)
        basis.append(w / beta)
        left, sigma = _small(betas)
        # what of the leading plane lies in the newest direction is what the next step could change
        if len(betas) > 1 and beta * np.linalg.norm(left[-1, :2]) <= residual * sigma[0]:
            break
    left, sigma = _small(betas)
    plane = np.stack(basis, axis=1) @ left[:, :2]
    return plane, float(sigma[0])


def _small(betas: list[float]) -> tuple[np.ndarray, np.ndarray]:
    small = np.zeros((len(betas) + 1, len(betas) + 1))
    for k, beta in enumerate(betas):
        small[k + 1, k], small[k, k + 1] = beta, -beta
    left, sigma, _ = np.linalg.svd(small)
    return left, sigma


class _Edges:
    """The edge table and the jobs over it."""

    few = 1_000_000

    def __init__(self, edges: DataFrame, n: int):
        self.df, self.n, self.parts = edges, n, edges.rdd.getNumPartitions()

    def sums(self, s: np.ndarray, v: np.ndarray, keep) -> np.ndarray:
        """Product of the weighted residual matrix with v."""
        n = self.n

        def run(batches):
            total = np.zeros(n)
            for b in batches:
                i, j = b["i"].to_numpy(), b["j"].to_numpy()
                gap = b["margin"].to_numpy() - (s[i] - s[j])
                r = b["weight"].to_numpy() * keep(np.abs(gap) * np.sqrt(b["precision"].to_numpy())) * gap
                total += np.bincount(i, r * v[j], n) - np.bincount(j, r * v[i], n)
            at = np.flatnonzero(total)
            yield pd.DataFrame({"k": at, "x": total[at]})

        return self._added(run)

    def divergence(self, s: np.ndarray, v: np.ndarray | None, keep) -> np.ndarray:
        """Weighted differences of v along the pairs (None: their margins), summed at the items; s gives the weights."""
        n = self.n

        def run(batches):
            total = np.zeros(n)
            for b in batches:
                i, j = b["i"].to_numpy(), b["j"].to_numpy()
                margin = b["margin"].to_numpy()
                r = b["weight"].to_numpy() * keep(np.abs(margin - (s[i] - s[j])) * np.sqrt(b["precision"].to_numpy())) * (margin if v is None else v[i] - v[j])
                total += np.bincount(i, r, n) - np.bincount(j, r, n)
            at = np.flatnonzero(total)
            yield pd.DataFrame({"k": at, "x": total[at]})

        return self._added(run)

    def _added(self, run) -> np.ndarray:
        parts = self.df.mapInPandas(run, "k long, x double")
        # few numbers come back as they are; many are added up before they do
        got = (parts if self.parts * self.n <= self.few else parts.groupBy("k").agg(F.sum("x").alias("x"))).toPandas()
        return np.bincount(got["k"].to_numpy(dtype=np.int64), got["x"].to_numpy(dtype=float), self.n)

    def spread(self, s: np.ndarray) -> float:
        """Robust scale of the standardised residuals, 1 at least."""

        def run(batches):
            for b in batches:
                gap = b["margin"].to_numpy() - (s[b["i"].to_numpy()] - s[b["j"].to_numpy()])
                yield pd.DataFrame({"z": np.abs(gap) * np.sqrt(b["precision"].to_numpy())})

        got = self.df.mapInPandas(run, "z double").agg(F.percentile_approx("z", 0.5, 10000)).first()[0]
        return max(1.0, 1.4826 * float(got or 0.0))

    def agreement(self, s: np.ndarray) -> float:
        def run(batches):
            for b in batches:
                yield pd.DataFrame({"c": [float((b["weight"].to_numpy() * b["margin"].to_numpy() * np.sign(s[b["i"].to_numpy()] - s[b["j"].to_numpy()])).sum())]})

        return float(self.df.mapInPandas(run, "c double").agg(F.sum("c")).first()[0] or 0.0)


class _OwnEdges:
    """The edge table within one task."""

    def __init__(self, i: np.ndarray, j: np.ndarray, margin: np.ndarray, precision: np.ndarray, weight: np.ndarray, n: int):
        self.i, self.j, self.margin, self.root, self.weight, self.n = i, j, margin, np.sqrt(precision), weight, n

    def _gap(self, s: np.ndarray) -> np.ndarray:
        return self.margin - (s[self.i] - s[self.j])

    def sums(self, s: np.ndarray, v: np.ndarray, keep) -> np.ndarray:
        gap = self._gap(s)
        r = self.weight * keep(np.abs(gap) * self.root) * gap
        return np.bincount(self.i, r * v[self.j], self.n) - np.bincount(self.j, r * v[self.i], self.n)

    def divergence(self, s: np.ndarray, v: np.ndarray | None, keep) -> np.ndarray:
        r = self.weight * keep(np.abs(self._gap(s)) * self.root) * (self.margin if v is None else v[self.i] - v[self.j])
        return np.bincount(self.i, r, self.n) - np.bincount(self.j, r, self.n)

    def spread(self, s: np.ndarray) -> float:
        return max(1.0, 1.4826 * float(np.percentile(np.abs(self._gap(s)) * self.root, 50, method="inverted_cdf")))

    def agreement(self, s: np.ndarray) -> float:
        return float((self.weight * self.margin * np.sign(s[self.i] - s[self.j])).sum())


def _weight(done: int, scale: float, p: RankingParams):
    """How much of its weight a pair keeps, by its standardised residual."""
    if not done:
        return lambda z: 1.0
    if done <= p.huber_rounds:
        return lambda z: np.minimum(1.0, p.huber * scale / np.maximum(z, 1e-12))
    return lambda z: (1.0 - np.minimum(z / (p.biweight * scale), 1.0) ** 2) ** 2 + 1e-6


def spectral_strengths(edges: DataFrame, n: int, params: RankingParams = RankingParams(), pairs: int | None = None) -> np.ndarray:
    """Strength of items 0..n-1 in log odds, centred at zero.

    A table of no more pairs than one task takes anyway (``rows_per_task``) is worked on
    within that task; of a larger one each product is a job over all its partitions.
    """
    pairs = edges.count() if pairs is None else pairs
    if pairs > params.rows_per_task:
        return _strengths(_Edges(edges, n), n, params)

    def run(batches):
        held = pd.concat(list(batches))
        if len(held):
            job = _OwnEdges(*(held[c].to_numpy() for c in ("i", "j", "margin", "precision", "weight")), n)
            yield pd.DataFrame({"k": np.arange(n), "x": _strengths(job, n, params)})

    got = edges.coalesce(1).mapInPandas(run, "k long, x double").toPandas()
    return got.sort_values("k")["x"].to_numpy(dtype=float)


def _potential(job, s: np.ndarray, keep, p: RankingParams, left: list[int]) -> np.ndarray:
    """Strengths whose differences fit the margins best, by conjugate gradients from s; the weights are those at s."""
    x, goal = s, job.divergence(s, None, keep)
    r = goal - (job.divergence(s, s, keep) if s.any() else 0.0)
    d, size, enough = r, float(r @ r), (p.solved * float(np.linalg.norm(goal))) ** 2
    while size > enough:
        left[0] -= 1
        if left[0] < 0:
            raise ArithmeticError(f"the ranking isn't solved in {p.solver_steps} steps: the comparisons join the items too thinly")
        q = job.divergence(s, d, keep)
        step = size / float(d @ q)
        x, r = x + step * d, r - step * q
        d, size = r + float(r @ r) / size * d, float(r @ r)
    return x - x.mean()


def _strengths(job, n: int, p: RankingParams) -> np.ndarray:
    ones, left = np.ones(n), [p.solver_steps]
    s, scale = np.zeros(n), 1.0
    for done in range(p.reweightings + 1):
        keep = _weight(done, scale, p)
        for _ in range(p.rounds if done else 1):
            new = _potential(job, s, keep, p, left)
            moved, s = float(np.max(np.abs(new - s))), new
            if moved < p.settled:
                break
        if done < p.reweightings:
            scale = job.spread(s)

    def product(v):
        return job.sums(s, v, keep) + s * v.sum() - ones * (s @ v)

    plane, sigma = _lanczos_plane(product, ones, p.lanczos_steps, p.residual)
    if sigma == 0.0:
        return s
    # within the plane, the direction orthogonal to the part nearest to the ones vector
    c = plane.T @ ones
    q = plane @ np.array([-c[1], c[0]])
    q *= sigma / np.sqrt(n) / np.linalg.norm(q)
    q -= q.mean()
    return q if job.agreement(q) >= 0 else -q


def rank_items(stats: DataFrame, params: RankingParams = RankingParams(), id_col: str = "stat_id") -> DataFrame:
    """label, strength, strength_rank (1 = strongest), comparisons, opponents.

    Every non-null label of the input comes out. A label without a decided comparison has
    null strength and rank. Equal strengths are ranked by label. Labels in parts that no
    comparison joins are placed with each part centred near zero. An empty table gives an
    empty ranking.
    """
    spark = stats.sparkSession
    labels = stats.select(F.explode(F.array("source_a", "source_b")).alias("label")).where("label is not null").distinct()
    pairs = materialize(pair_totals(stats, id_col), "pairs")
    known = pairs.select(F.explode(F.array("a", "b")).alias("label")).groupBy("label").count()
    n = known.count()
    if n > params.max_items:
        raise ValueError(f"{n} items; the vectors of the ranking are bounded by {params.max_items}")
    if n == 0:
        return labels.select("label", F.lit(None).cast("double").alias("strength"), F.lit(None).cast("int").alias("strength_rank"), F.lit(0).cast("long").alias("comparisons"), F.lit(0).cast("long").alias("opponents"))
    index = known.select("label", (F.row_number().over(W.orderBy("label")) - 1).cast("long").alias("k"))
    x, y = F.col("a_wins") + 0.5, F.col("b_wins") + 0.5
    precision = 1.0 / (1.0 / x + 1.0 / y)
    flat = 1.0 / (1.0 / precision + params.extra_variance)
    flat_pairs = pairs.select("a", "b", flat.alias("w"))
    degree = flat_pairs.select(F.explode(F.array("a", "b")).alias("label"), "w").groupBy("label").agg(F.sum("w").alias("d"))
    index = materialize(index.join(degree, "label"), "items")
    edges = (
        pairs.join(index.select(F.col("label").alias("a"), F.col("k").alias("i"), F.col("d").alias("di")), "a")
        .join(index.select(F.col("label").alias("b"), F.col("k").alias("j"), F.col("d").alias("dj")), "b")
        .select("i", "j", F.log(x / y).alias("margin"), flat.alias("precision"), (F.lit(float(n)) * flat / (2 * F.sqrt(F.col("di") * F.col("dj")))).alias("weight"))
    )
    number = pairs.count()
    edges = materialize(edges.repartition(-(-number // params.rows_per_task)) if number > params.rows_per_task else edges.coalesce(1), "edges")
    strengths = spectral_strengths(edges, n, params, number)
    held = (
        pairs.select(F.explode(F.array(F.struct(F.col("a").alias("label")), F.struct(F.col("b").alias("label")))).alias("e"), (F.col("a_wins") + F.col("b_wins")).alias("c"))
        .groupBy("e.label")
        .agg(F.sum("c").alias("comparisons"), F.count("*").alias("opponents"))
    )
    # the strengths came to the driver, so their order does not cost another pass
    order = sorted(range(n), key=lambda k: (-strengths[k], k))
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(1, n + 1)
    scored = spark.createDataFrame(pd.DataFrame({"k": np.arange(n), "strength": strengths, "strength_rank": place}), "k long, strength double, strength_rank int")
    ranked = index.select("label", "k").join(scored, "k")
    return (
        labels.join(ranked, "label", "left")
        .join(held, "label", "left")
        .select("label", "strength", "strength_rank", F.coalesce("comparisons", F.lit(0)).alias("comparisons"), F.coalesce("opponents", F.lit(0)).alias("opponents"))
    )


def stronger_pairs(ranking: DataFrame, max_items: int = 20_000) -> DataFrame:
    """source_a < source_b with source_b the stronger: each label against those ranked above it, without a join."""
    order = [r["label"] for r in ranking.where("strength is not null").orderBy("strength_rank").select("label").limit(max_items + 1).collect()]
    if len(order) > max_items:
        raise ValueError("all pairs of so many labels aren't a report")
    above = F.slice(F.array(*[F.lit(x) for x in order]) if order else F.array().cast("array<string>"), F.lit(1), F.col("strength_rank") - 1)
    return (
        ranking.where("strength is not null")
        .select(F.col("label").alias("source_a"), F.explode(above).alias("source_b"))
        .where(F.col("source_a") < F.col("source_b"))
    )
