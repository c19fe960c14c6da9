import numpy as np

from cairnstat.llm import ranking

SCHEMA = "stat_id long, source_a string, source_b string, a_wins long, b_wins long, extra string"


def votes(n=14, seed=5, hops=3, trials=400):
    rng = np.random.default_rng(seed)
    strength = np.linspace(2.0, -2.0, n)
    names = [f"s{k:02d}" for k in rng.permutation(n)]
    rows, stat = [], 0
    for i in range(n):
        for j in range(i + 1, min(n, i + 1 + hops)):
            stat += 1
            t = int(rng.integers(trials // 10, trials))
            a = int(rng.binomial(t, 1 / (1 + np.exp(-(strength[i] - strength[j])))))
            rows.append((stat, names[i], names[j], a, t - a, "x") if stat % 2 else (stat, names[j], names[i], t - a, a, "x"))
    return names, rows


def order(df):
    return [r.label for r in df.where("strength is not null").orderBy("strength_rank").collect()]


def test_local_comparisons_give_the_global_order_despite_an_odd_pair(spark):
    names, rows = votes(12, hops=4)
    rows += [(900, names[2], names[9], 5, 300, "odd")]
    assert order(ranking.rank_items(spark.createDataFrame(rows, SCHEMA))) == names


def test_repeats_nulls_and_self_pairs_change_nothing(spark):
    names, rows = votes(8)
    plain = {r.label: round(r.strength, 6) for r in ranking.rank_items(spark.createDataFrame(rows, SCHEMA)).collect()}
    dirty = rows + rows[:5] + [(901, None, "s00", 3, 4, "n"), (902, "s01", "s01", 9, 0, "n"), (903, "s00", "s03", None, 5, "n"), (904, "s00", "s03", 0, 0, "n"), (905, "lonely", "s00", None, None, "n")]
    got = {r.label: r for r in ranking.rank_items(spark.createDataFrame(dirty, SCHEMA)).collect()}
    assert {k: round(r.strength, 6) for k, r in got.items() if r.strength is not None} == plain
    assert got["lonely"].strength is None and got["lonely"].comparisons == 0


def test_stronger_pairs_are_all_pairs_in_code_point_order(spark):
    names, rows = votes(6)
    got = {(r.source_a, r.source_b) for r in ranking.stronger_pairs(ranking.rank_items(spark.createDataFrame(rows, SCHEMA))).collect()}
    rank = {n: k for k, n in enumerate(names)}
    assert got == {(a, b) for a in names for b in names if a < b and rank[b] < rank[a]}


def test_tied_and_empty(spark):
    got = ranking.rank_items(spark.createDataFrame([(1, "b", "a", 5, 5, "")], SCHEMA))
    assert order(got) == ["a", "b"]
    assert ranking.stronger_pairs(got).count() == 0
    empty = ranking.rank_items(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and ranking.stronger_pairs(empty).count() == 0


def test_lanczos_plane_is_that_of_the_dense_decomposition():
    rng = np.random.default_rng(1)
    s = rng.normal(size=30)
    m = s[:, None] - s[None, :] + 0.05 * (lambda e: e - e.T)(rng.normal(size=(30, 30)))
    plane, sigma = ranking._lanczos_plane(lambda v: m @ v, np.ones(30), 12)
    u, d, _ = np.linalg.svd(m)
    assert abs(sigma - d[0]) < 1e-6
    assert np.allclose(np.linalg.svd(plane.T @ u[:, :2])[1], 1, atol=1e-6)


def chain(n, hops, seed=0):
    rng = np.random.default_rng(seed)
    perm, strength = rng.permutation(n), np.linspace(0.3 * n, -0.3 * n, n)
    i = np.concatenate([np.arange(n - h) for h in range(1, hops + 1)])
    j = i + np.repeat(np.arange(1, hops + 1), [n - h for h in range(1, hops + 1)])
    won = rng.binomial(60, 1 / (1 + np.exp(-(strength[i] - strength[j]))))
    x, y = won + 0.5, 60 - won + 0.5
    flat = 1 / (1 / x + 1 / y + 0.02)
    d = np.bincount(i, flat, n) + np.bincount(j, flat, n)
    return ranking._OwnEdges(perm[i], perm[j], np.log(x / y), flat, n * flat / (2 * np.sqrt(d[i] * d[j])), n), perm


def test_a_thin_chain_is_ordered_or_an_error():
    for n in (40, 200, 1000):
        for hops in (2, 10):
            job, perm = chain(n, hops)
            try:
                s = ranking._strengths(job, n, ranking.RankingParams())[perm]
            except ArithmeticError:
                assert n == 1000 and hops == 2
                continue
            assert np.mean(np.concatenate([s[k] > s[k + 1 :] for k in range(n - 1)])) >= 0.95


def test_too_few_steps_are_an_error():
    import pytest

    job, _ = chain(200, 2)
    with pytest.raises(ArithmeticError, match="too thinly"):
        ranking._strengths(job, 200, ranking.RankingParams(solver_steps=20))


def test_jobs_over_the_table_give_what_one_task_gives(spark):
    _, rows = votes(10)
    d = spark.createDataFrame(rows, SCHEMA)
    own = {r.label: r.strength for r in ranking.rank_items(d).collect()}
    few = ranking.RankingParams(rows_per_task=9, reweightings=1, rounds=2)
    far = {r.label: r.strength for r in ranking.rank_items(d, few).collect()}
    near = {r.label: r.strength for r in ranking.rank_items(d, ranking.RankingParams(reweightings=1, rounds=2)).collect()}
    assert all(abs(far[k] - near[k]) < 1e-6 for k in own)
