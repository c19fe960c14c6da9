"""Statistics of paired proportions as column expressions.

Survey operators: MTH1-MTH8, FLT17, WIN4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .text import col

Z975 = 1.959963984540054
BISECTIONS = 100
SATURATED_HIGH, SATURATED_LOW, LEAST_DISCORDANT = 0.95, 0.05, 5


def margin(memory, other) -> Column:
    """MTH1"""
    return col(memory) - col(other)


def mean_logprob(logprobs) -> Column:
    """MTH2: mean of the tokens' log-probabilities; no token is an error."""
    a = col(logprobs)
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) > 0, total / F.size(a)).otherwise(F.raise_error(F.lit("no tokens to score")).cast("double"))


def answer_boundary(prompt_ids, full_ids) -> Column:
    """MTH3: length of the common beginning of two token lists; it is an error if nothing follows it."""
    p, f = col(prompt_ids), col(full_ids)
    same = F.zip_with(p, f, lambda a, b: a.eqNullSafe(b) & a.isNotNull() & b.isNotNull())
    first = F.array_position(same, False)
    length = F.when(first > 0, first - 1).otherwise(F.least(F.size(p), F.size(f)).cast("bigint"))
    return F.when(length < F.size(f), length).otherwise(F.raise_error(F.lit("no answer token after the prompt")).cast("bigint"))


def tango_z(b, c, n, delta) -> Column:
    """MTH4: score statistic of b - c against n delta, the off-diagonal probability at its constrained estimate."""
    b, c, n, d = (col(x).cast("double") if not isinstance(x, (int, float)) else F.lit(float(x)) for x in (b, c, n, delta))
    q = d * (2 * n - b + c) - (b + c)
    x = (-q + F.sqrt(F.greatest(q * q + 8 * n * c * d * (1 - d), F.lit(0.0)))) / (4 * n)
    variance = n * (2 * x + d * (1 - d))
    over = b - c - n * d
    infinite = F.when(over > 0, F.lit(float("inf"))).when(over < 0, F.lit(float("-inf"))).otherwise(F.lit(0.0))
    return F.when(variance > 0, over / F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(infinite)


def _bisect(b: Column, c: Column, n: Column, low: Column, high: Column, level: float) -> Column:
    start = F.struct(low.alias("lo"), high.alias("hi"))

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        above = tango_z(b, c, n, mid) > level
        return F.struct(F.when(above, mid).otherwise(acc["lo"]).alias("lo"), F.when(above, acc["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, halve, lambda acc: (acc["lo"] + acc["hi"]) / 2)


def tango_interval(b, c, n, z: float = Z975) -> Column:
    """MTH5: struct(lower, upper) where the score statistic is z and -z, by bisection inside the plan; null for n = 0.

    Apply it after aggregation: it costs some hundred steps a row.
    """
    b, c, n = (col(x).cast("double") for x in (b, c, n))
    delta = (b - c) / n
    both = F.struct(_bisect(b, c, n, F.lit(-1.0), delta, z).alias("lower"), _bisect(b, c, n, delta, F.lit(1.0), -z).alias("upper"))
    return F.when(n > 0, both)


def exact_p(b, c) -> Column:
    """MTH6: two-sided exact p of b against c discordant pairs, 1 without any.

    Terms of the binomial distribution are summed relative to the largest one in the tail,
    C(m, k), whose logarithm is a sum of logarithms, so no m underflows.
    """
    b, c = col(b).cast("bigint"), col(c).cast("bigint")
    m, k = b + c, F.least(b, c)
    # log C(m, k) - m log 2
    top = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1))), F.lit(0.0), lambda acc, i: acc + F.when(k >= 1, F.log((m - k + i).cast("double") / i.cast("double"))).otherwise(0.0)) - m * F.log(F.lit(2.0))
    # C(m, i - 1) / C(m, i) = i / (m - i + 1), going down from k
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def down(acc, i):
        term = acc["term"] * (k - i + 1) / (m - k + i)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1))), start, lambda acc, i: F.when(k >= 1, down(acc, i)).otherwise(acc), lambda acc: acc["total"])
    return F.when(m == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(top) * total))


def saturation(rate_a, rate_b, discordant) -> Column:
    """FLT17: struct of the flags: an arm near 0 or 1, few discordant pairs, and both together."""
    high = (col(rate_a) > SATURATED_HIGH) | (col(rate_b) > SATURATED_HIGH)
    low = (col(rate_a) < SATURATED_LOW) | (col(rate_b) < SATURATED_LOW)
    few = col(discordant) < LEAST_DISCORDANT
    flags = {"ceiling": high, "floor": low, "few_discordant": few, "saturated": (high | low) & few}
    return F.struct(*[F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()])


def holm(df: DataFrame, p: str, name: str, family: list[str] | None = None, out: str = "holm_p") -> DataFrame:
    """WIN4: Holm's step-down adjustment within each family; ties by name, null p-values stay null and don't count."""
    keys = list(family or [])
    tested = F.col(p).isNotNull()
    by = W.partitionBy(*keys, tested) if keys else W.partitionBy(tested)
    order = by.orderBy(p, name)
    m, i = F.count("*").over(by), F.row_number().over(order) - 1
    steps = df.withColumn("_holm_step", F.least((m - i) * F.col(p), F.lit(1.0)))
    run = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return steps.withColumn(out, F.when(tested, F.max("_holm_step").over(run))).drop("_holm_step")
