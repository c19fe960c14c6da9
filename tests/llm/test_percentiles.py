import random

import pytest
from pyspark.sql import functions as F

from cairnstat.llm import percentiles as P
from cairnstat.operators import frequencies


@pytest.fixture()
def many_ranges(monkeypatch):
    monkeypatch.setattr(frequencies, "ROWS_PER_RANGE", 20)


def sample(seed=1, n=900):
    rng = random.Random(seed)
    return [(k, rng.choice(["a", "a", "b", None]), rng.choice([0.0, 0.0, -0.0, 1.5, rng.gauss(0, 3), rng.paretovariate(0.7), float("nan"), None]), "x") for k in range(n)]


SCHEMA = "id long, g string, v double, _cs string"


def groups(data):
    out = {}
    for _, g, v, _ in dict((r[0], r) for r in data).values():
        if v is not None and v == v:
            out.setdefault(g, []).append(v + 0.0)
    return {g: sorted(vs) for g, vs in out.items()}


def test_percentiles_against_sorting(spark, many_ranges):
    data = sample()
    d = spark.createDataFrame(data + data[:200], SCHEMA)
    points = P.split_points(d, "v")
    assert len(points) > 10
    probs = [0.0, 0.01, 1 / 3, 0.5, 0.9, 1.0]
    got = {(r.g, r.p): (r.value, r.n_values) for r in P.percentiles(P.value_frequencies(d, ["g"], "v", "id"), ["g"], probs, points).collect()}
    for g, vs in groups(data).items():
        for p in probs:
            k = max(1, -int(-(p * len(vs) - 1e-9) // 1))
            assert got[g, p] == (vs[k - 1], len(vs))
    assert len(got) == 3 * len(probs)


def test_ranks_of_asked_values(spark, many_ranges):
    data = sample(2)
    d = spark.createDataFrame(data, SCHEMA)
    asked = [(k, g, v) for k, (g, v) in enumerate([("a", 0.0), ("a", -99.0), ("b", 99.0), ("b", 1.5), (None, 0.3), ("a", None)])]
    q = spark.createDataFrame(asked, f"k int, g string, {P.VALUE} double")
    got = {r.k: (r._cs_below, r._cs_upto, r._cs_total) for r in P.ranks(P.value_frequencies(d, ["g"], "v"), ["g"], q, ["k"], P.split_points(d, "v")).collect()}
    own = groups(data)
    for k, g, v in asked:
        if v is not None:
            assert got[k] == (sum(x < v for x in own[g]), sum(x <= v for x in own[g]), len(own[g]))
    assert 5 not in got


@pytest.mark.parametrize("epsilon", [0.01, 0.1])
def test_merged_summaries_keep_their_bound(spark, many_ranges, epsilon):
    days = [[(k, "a", random.Random(d).gauss(d, 2) + k % 7, "") for k in range(500 + 300 * d)] for d in range(3)]
    parts = []
    for d, rows in enumerate(days):
        df = spark.createDataFrame([(k + 10_000 * d, g, v, x) for k, g, v, x in rows], SCHEMA)
        points = P.split_points(df, "v")
        s = P.summarize(P.value_frequencies(df, ["g"], "v", "id"), ["g"], epsilon, points)
        assert s.count() <= 1 / epsilon * 1.2 + 2
        parts.append(s)
    merged = P.merge_frequencies(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["g"])
    values = sorted(v for rows in days for _, _, v, _ in rows)
    n = len(values)
    for r in P.percentiles(merged, ["g"], [0.1, 0.5, 0.9], []).collect():
        upto, below = sum(v <= r.value for v in values), sum(v < r.value for v in values)
        assert r.n_values == n and below / n - epsilon <= r.p <= upto / n + epsilon


def test_one_group_of_one_value_and_empty(spark):
    d = spark.createDataFrame([(k, "a", 7.0, "") for k in range(50)], SCHEMA)
    f = P.value_frequencies(d, ["g"], "v", "id")
    assert f.count() == 1
    assert [(r.p, r.value) for r in P.percentiles(f, ["g"], [0.5], P.split_points(d, "v")).collect()] == [(0.5, 7.0)]
    e = spark.createDataFrame([], SCHEMA)
    assert P.split_points(e, "v") == [] and P.percentiles(P.value_frequencies(e, ["g"], "v"), ["g"], [0.5], []).count() == 0


def test_misplaced_edges_on_a_fixture(spark):
    scores = [(k, "m", "KC", k % 3, float(k)) for k in range(300)] + [(k, "m", "KC", k % 3, float(k)) for k in range(20)] + [(900, "m", "KC", 0, None), (901, "m", None, 0, 5.0)]
    s = spark.createDataFrame(scores, "score_id long, model_key string, knowledge_group string, block_no int, parametric_margin double")
    st = [(1, 0, 2, [100.0, 200.0]), (2, 0, 2, [100.0, 207.0]), (3, 0, 2, [92.0, 200.0]), (4, 1, 1, [100.0, 200.0]), (5, 7, 9, [0.0, 0.0]), (6, 2, 1, [0.0, 0.0]), (7, 0, 2, None), (8, 0, 2, [100.0, None]), (9, 0, 2, [105.9, 205.9])]
    strata = spark.createDataFrame([(i, "m", "KC", a, b, e) for i, a, b, e in st], "freeze_id long, model_key string, knowledge_group string, block_from int, block_to int, edges array<double>")
    assert sorted(r.freeze_id for r in P.misplaced_edges(strata, s).collect()) == [2, 3]


def test_misplaced_edges_over_many_blocks_against_counting(spark):
    import random

    rng = random.Random(7)
    scores = [(k, "m", "KC", rng.randrange(40), float(rng.randrange(60))) for k in range(1500)]
    s = spark.createDataFrame(scores, "score_id long, model_key string, knowledge_group string, block_no int, parametric_margin double")
    st = [(i, *sorted((rng.randrange(40), rng.randrange(40))), [rng.uniform(17, 23), rng.uniform(37, 43)]) for i in range(80)] + [(80, 0, 39, [20.0, 40.0]), (81, 3, 3, [20.0, 40.0]), (82, 30, 90, [10.0, 40.0])]
    strata = spark.createDataFrame([(i, "m", "KC", a, b, e) for i, a, b, e in st], "freeze_id long, model_key string, knowledge_group string, block_from int, block_to int, edges array<double>")
    want = []
    for i, a, b, edges in st:
        pool = [v for _, _, _, block, v in scores if a <= block <= b]
        if pool and any(sum(v < e for v in pool) / len(pool) > t / 3 + 0.02 or sum(v <= e for v in pool) / len(pool) < t / 3 - 0.02 for t, e in enumerate(edges, 1)):
            want.append(i)
    for fan in (2, 4, 64):
        assert sorted(r.freeze_id for r in P.misplaced_edges(strata, s, fan=fan).collect()) == want
