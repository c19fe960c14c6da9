"""Logistic fits as iterated aggregations.

Survey operators: REG2-REG7.

Each step of a fit is one Spark aggregation: the design's products are summed in the plan
(k (k + 1) / 2 + k numbers a group), only those sums reach the driver, and any number of
groups is fitted at once. So a fit reads the rows once a step and never gathers them. The
penalised fit needs the inverse information inside its sums, which is k x k numbers sent
back as literals.

A rank-deficient, one-class, separated or unconverged group comes out with null numbers
and a status, as do groups below their least number of rows. Rows with a null in outcome
or design are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import Z975
from ..session import materialize

LIMIT = 25.0  # a coefficient or standard error beyond it means separation


@dataclass(frozen=True)
class FitParams:
    steps: int = 60
    tolerance: float = 1e-9
    firth_steps: int = 200
    firth_tolerance: float = 1e-8
    max_groups: int = 2000
    max_models: int = 1000


def _prepare(df: DataFrame, groups: list[str], y: str, design: dict[str, Column], cluster: str | None) -> DataFrame:
    cols = [F.col(g) for g in groups] + [F.col(y).cast("double").alias("_y")] + [e.cast("double").alias(f"_x{k}") for k, e in enumerate(design.values())]
    if cluster:
        cols.append(F.col(cluster).cast("string").alias("_c"))
    rows = df.select(*cols)
    return rows.where(" and ".join([f"{c} is not null" for c in rows.columns if c.startswith("_")]))


def _linear(betas: dict[tuple, np.ndarray], groups: list[str], k: int, scale: float = 1.0) -> Column:
    """x'beta with each group's beta as literals in a map; 0 for a group without one."""
    if not groups:
        (beta,) = betas.values()
        return sum((F.col(f"_x{j}") * F.lit(float(beta[j])) for j in range(k)), F.lit(0.0))
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(g).cast("string"), F.lit("\x00")) for g in groups])
    table = F.create_map(*[x for g, beta in betas.items() for x in (F.lit(_key(g)), F.array(*[F.lit(float(v)) for v in beta]))])
    beta = table[key]
    return sum((F.col(f"_x{j}") * F.coalesce(beta[j], F.lit(0.0)) for j in range(k)), F.lit(0.0))


def _key(group: tuple) -> str:
    return "\x1f".join("\x00" if g is None else (str(g).lower() if isinstance(g, bool) else str(g)) for g in group)


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _sums(rows: DataFrame, groups: list[str], k: int, weight: Column, residual: Column) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    r = rows.withColumns({"_w": weight, "_r": residual})
    agg = [F.sum(F.col("_w") * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_i{i}_{j}") for i, j in _pairs(k)] + [F.sum(F.col("_r") * F.col(f"_x{j}")).alias(f"_u{j}") for j in range(k)]
    out = {}
    for row in (r.groupBy(*groups).agg(*agg) if groups else r.agg(*agg)).collect():
        info = np.zeros((k, k))
        for i, j in _pairs(k):
            info[i, j] = info[j, i] = row[f"_i{i}_{j}"]
        out[tuple(row[g] for g in groups)] = (info, np.array([row[f"_u{j}"] for j in range(k)]))
    return out


def _p(eta: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), eta))))


def _newton(rows: DataFrame, groups: list[str], k: int, params: FitParams, firth: bool) -> dict[tuple, dict]:
    """Each group's beta, inverse information and whether it converged. Groups are fitted together, step by step."""
    first = rows.groupBy(*groups).agg(F.count("*").alias("_n"), F.avg("_y").alias("_mean")) if groups else rows.agg(F.count("*").alias("_n"), F.avg("_y").alias("_mean"))
    state = {tuple(r[g] for g in groups): {"n": r["_n"], "mean": r["_mean"], "beta": np.zeros(k), "ok": False, "dead": r["_n"] == 0} for r in first.limit(params.max_groups + 1).collect()}
    if len(state) > params.max_groups:
        raise ValueError(f"more than {params.max_groups} groups")
    inverse: dict[tuple, np.ndarray] = {}
    for _ in range(params.firth_steps if firth else params.steps):
        live = {g: s["beta"] for g, s in state.items() if not s["ok"] and not s["dead"]}
        if not live:
            break
        p = _p(_linear(live, groups, k))
        w = p * (1 - p)
        sums = _sums(rows.withColumn("_p", p), groups, k, w, F.col("_y") - F.col("_p"))
        if firth:
            # the hat diagonal needs the inverse information of this step, so a second pass adds its part of the score
            for g in list(live):
                try:
                    inverse[g] = np.linalg.inv(sums[g][0])
                except np.linalg.LinAlgError:
                    state[g]["dead"] = True
            live = {g: b for g, b in live.items() if not state[g]["dead"]}
            if not live:
                break
            hat = sum((F.col(f"_x{i}") * F.col(f"_x{j}") * _entry(inverse, live, groups, i, j) for i in range(k) for j in range(k)), F.lit(0.0)) * w
            more = _sums(rows.withColumn("_p", p), groups, k, w, hat * (0.5 - F.col("_p")))
        for g in live:
            info, score = sums[g]
            if firth:
                score = score + more[g][1]
            try:
                step = np.linalg.solve(info, score)
            except np.linalg.LinAlgError:
                state[g]["dead"] = True
                continue
            s = state[g]
            s["beta"] = s["beta"] + step
            s["inverse"] = np.linalg.pinv(info)
            if not np.all(np.isfinite(s["beta"])) or (not firth and np.max(np.abs(s["beta"])) > 4 * LIMIT):
                s["dead"] = True
            elif np.max(np.abs(step)) < (params.firth_tolerance if firth else params.tolerance):
                s["ok"] = True
    return state


def _entry(inverse: dict, live: dict, groups: list[str], i: int, j: int) -> Column:
    if not groups:
        (g,) = live
        return F.lit(float(inverse[g][i, j]))
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(g).cast("string"), F.lit("\x00")) for g in groups])
    table = F.create_map(*[x for g in live for x in (F.lit(_key(g)), F.lit(float(inverse[g][i, j])))])
    return F.coalesce(table[key], F.lit(0.0))


def _normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _rows(spark, groups: list[str], kinds: dict, names: list[str], found: list[tuple]) -> DataFrame:
    schema = ", ".join([f"`{g}` {kinds[g]}" for g in groups] + ["term string, estimate double, std_error double, z double, p_value double, ci_lower double, ci_upper double, n bigint, method string, status string"])
    return spark.createDataFrame(found, schema)


def _report(group, names, beta, cov, n, method, with_p=True) -> list[tuple]:
    out = []
    for k, name in enumerate(names):
        se = math.sqrt(max(cov[k, k], 0.0))
        z = float(beta[k] / se) if se > 0 else float("nan")
        out.append((*group, name, float(beta[k]), se, z, _normal_p(z) if with_p and se > 0 else None, float(beta[k] - Z975 * se), float(beta[k] + Z975 * se), n, method, "ok"))
    return out


def _empty(group, names, n, status) -> list[tuple]:
    return [(*group, name, None, None, None, None, None, None, n, "none", status) for name in names]


def _meat(rows: DataFrame, groups: list[str], k: int, betas: dict) -> dict[tuple, tuple[np.ndarray, int]]:
    """Sum over clusters of the outer product of their scores, and the number of clusters."""
    scored = rows.withColumn("_r", F.col("_y") - _p(_linear(betas, groups, k)))
    per = scored.groupBy(*groups, "_c").agg(*[F.sum(F.col("_r") * F.col(f"_x{j}")).alias(f"_s{j}") for j in range(k)])
    agg = [F.sum(F.col(f"_s{i}") * F.col(f"_s{j}")).alias(f"_m{i}_{j}") for i, j in _pairs(k)] + [F.count("*").alias("_clusters")]
    out = {}
    for row in (per.groupBy(*groups).agg(*agg) if groups else per.agg(*agg)).collect():
        m = np.zeros((k, k))
        for i, j in _pairs(k):
            m[i, j] = m[j, i] = row[f"_m{i}_{j}"]
        out[tuple(row[g] for g in groups)] = (m, row["_clusters"])
    return out


def fit_logit(df: DataFrame, groups: list[str], y: str, design: dict[str, Column], cluster: str | None = None, least: int = 0, fall_back: bool = False, params: FitParams = FitParams()) -> DataFrame:
    """REG2, REG3, REG5: a logistic fit of each group: term, estimate, std_error, z, p_value, interval, n, method, status.

    With a cluster the errors are the sandwich over clusters, times G / (G - 1) (N - 1) / (N - k).
    A fit is refused if the outcome is of one class, it doesn't converge, or an estimate or
    error is beyond 25. With fall_back such groups get the penalised fit (REG4).
    """
    spark, names, k = df.sparkSession, list(design), len(design)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema if f.name in groups}
    rows = materialize(_prepare(df, groups, y, design, cluster), "design")
    state = _newton(rows, groups, k, params, firth=False)
    good = {g: s for g, s in state.items() if s["ok"] and s["n"] >= max(least, k + 1) and 0 < s["mean"] < 1 and np.max(np.abs(s["beta"])) <= LIMIT}
    meats = _meat(rows, groups, k, {g: s["beta"] for g, s in good.items()}) if cluster and good else {}
    found, again = [], []
    for g, s in sorted(state.items(), key=str):
        if s["n"] < least or s["n"] == 0 or not 0 < s["mean"] < 1:
            found += _empty(g, names, s["n"], "not estimable")
            continue
        cov = None
        if g in good:
            cov = s["inverse"]
            if cluster:
                meat, clusters = meats[g]
                n = s["n"]
                factor = clusters / max(1, clusters - 1) * (n - 1) / max(1, n - k)
                cov = cov @ meat @ cov * factor
            se = np.sqrt(np.maximum(np.diag(cov), 0))
            if not np.all(np.isfinite(se)) or np.any(se == 0) or np.any(se > LIMIT):
                cov = None
        if cov is not None:
            found += _report(g, names, s["beta"], cov, s["n"], "clustered" if cluster else "logit")
        elif fall_back:
            again.append(g)
        else:
            found += _empty(g, names, s["n"], "not estimable")
    if again:
        keep = rows if not groups else rows.where(F.concat_ws("\x1f", *[F.coalesce(F.col(g).cast("string"), F.lit("\x00")) for g in groups]).isin([_key(g) for g in again]))
        for g, s in sorted(_newton(keep, groups, k, params, firth=True).items(), key=str):
            found += _report(g, names, s["beta"], s["inverse"], s["n"], "firth", with_p=False) if s["ok"] else _empty(g, names, s["n"], "not estimable")
    return _rows(spark, groups, kinds, names, found)


def fit_firth(df: DataFrame, groups: list[str], y: str, design: dict[str, Column], params: FitParams = FitParams()) -> DataFrame:
    """REG4: the penalised fit of each group with Wald intervals; no p-value."""
    names, k = list(design), len(design)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema if f.name in groups}
    rows = materialize(_prepare(df, groups, y, design, None), "design")
    found = []
    for g, s in sorted(_newton(rows, groups, k, params, firth=True).items(), key=str):
        found += _report(g, names, s["beta"], s["inverse"], s["n"], "firth", with_p=False) if s["ok"] else _empty(g, names, s["n"], "not estimable")
    return _rows(df.sparkSession, groups, kinds, names, found)


def pilot_design() -> dict[str, Column]:
    """REG2: intercept, b, s, b s, t, s t, b t."""
    b, s, t = F.col("b"), F.col("s"), F.col("t")
    return {"intercept": F.lit(1.0), "b": b, "s": s, "b:s": b * s, "t": t, "s:t": s * t, "b:t": b * t}


def with_zscore(df: DataFrame, groups: list[str], value: str, out: str = "z") -> DataFrame:
    """The value less its group's mean over the population deviation; from one aggregation joined back."""
    moments = df.groupBy(*groups).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(moments, groups).withColumn(out, F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def source_by_strength(df: DataFrame, groups: list[str], y: str, margin: str, source: str, cluster: str, least: int = 20) -> DataFrame:
    """REG6: clustered fit on z, z^2, source and their products, z the standardised margin."""
    z, s = F.col("z"), F.col(source).cast("double")
    design = {"intercept": F.lit(1.0), "z": z, "z2": z * z, "source": s, "source:z": s * z, "source:z2": s * z * z}
    return fit_logit(with_zscore(df, groups, margin), groups, y, design, cluster, least)


def chi2_sf(x: float, k: int) -> float:
    """Upper tail of chi-squared with k degrees of freedom, by the series or continued fraction of the incomplete gamma function."""
    a, x = k / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def model_by_source(df: DataFrame, y: str, model: str, source: str, cluster: str, least: int = 40, params: FitParams = FitParams()) -> DataFrame:
    """REG7: clustered fit with model x source products and the joint Wald test that all products are 0.

    The first model by name is the reference. term 'joint' has the statistic in z and its
    degrees of freedom in n.
    """
    models = [r[0] for r in df.select(model).where(F.col(model).isNotNull()).distinct().orderBy(model).limit(params.max_models + 1).collect()]
    if len(models) > params.max_models:
        raise ValueError(f"more than {params.max_models} models")
    s = F.col(source).cast("double")
    is_m = {m: F.coalesce((F.col(model) == m).cast("double"), F.lit(0.0)) for m in models[1:]}
    design = {"intercept": F.lit(1.0), "source": s, **{f"model[{m}]": e for m, e in is_m.items()}, **{f"model[{m}]:source": e * s for m, e in is_m.items()}}
    names, k = list(design), len(design)
    rows = materialize(_prepare(df, [], y, design, cluster), "design")
    state = _newton(rows, [], k, params, firth=False)[()]
    n = state["n"]
    if n < least or not state["ok"] or not 0 < state["mean"] < 1 or len(models) < 2:
        return _rows(df.sparkSession, [], {}, names, _empty((), [*names, "joint"], n, "not estimable"))
    meat, clusters = _meat(rows, [], k, {(): state["beta"]})[()]
    cov = state["inverse"] @ meat @ state["inverse"] * (clusters / max(1, clusters - 1) * (n - 1) / max(1, n - k))
    at = [i for i, name in enumerate(names) if name.endswith(":source")]
    b, v = state["beta"][at], cov[np.ix_(at, at)]
    wald = float(b @ np.linalg.pinv(v) @ b)
    joint = ("joint", None, None, wald, chi2_sf(wald, len(at)), None, None, len(at), "wald", "ok")
    return _rows(df.sparkSession, [], {}, names, [*_report((), names, state["beta"], cov, n, "clustered"), joint])
