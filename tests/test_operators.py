import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairnstat.operators import bootstrap, calibration, contrasts, dedup, expand, foils, ingest, regression, runner, sampling, strata, summaries, verify


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_interim_looks_at_the_question_first(spark):
    raw = spark.createDataFrame([(1, "", "", None, None), (2, "q", " ", "['x']", None), (3, " q ", "The Obj", "['b', 'a']", "a"), (4, None, "x", None, None)], "id int, question string, obj string, o_aliases string, possible_answers string").withColumns({"subj": F.lit("s"), "prop": F.lit("p")})
    kept, out = ingest.build_interim(raw)
    assert rows(kept.select("id", "question", "aliases", "gold_normalized")) == [("3", "q", ["a", "b"], "obj")]
    assert rows(out) == [("1", "empty_question"), ("2", "empty_gold_answer"), ("4", "empty_question")]


def test_smallest_id_is_by_text(spark):
    d = spark.createDataFrame([("r", "10", "x"), ("r", "9", "y"), ("s", "1", "z")], "k string, id string, v string")
    assert rows(ingest.smallest_per_key(d, ["k"], "id")) == [("r", "10", "x"), ("s", "1", "z")]


def test_missing_id_is_an_error(spark):
    with pytest.raises(Exception):
        ingest.require_ids(spark.createDataFrame([("a",), (None,)], "item_id string")).collect()


@pytest.mark.parametrize("tries", [1, 2, 8])
def test_foils_never_match_and_none_is_lost(spark, tries):
    items = [(f"i{k}", "rel" if k < 9 else "one" if k == 9 else "same", f"Obj {k % 7}" if k < 9 else "only" if k == 9 else "The same", [f"obj {(k + 1) % 7}", f"obj {(k + 2) % 7}"]) for k in range(12)]
    d = spark.createDataFrame(items, "item_id string, prop string, obj string, aliases array<string>")
    got = {r.item_id: r for r in foils.draw_foils(d, tries=tries).collect()}
    assert len(got) == 12
    for item_id, relation, obj, aliases in items:
        r = got[item_id]
        if relation == "rel":
            assert r.foil_answer.lower() not in {obj.lower(), *aliases}
        else:
            assert r.foil_answer is None
    again = {r.item_id: r for r in foils.draw_foils(d.orderBy(F.desc("item_id")).repartition(3), tries=tries).collect()}
    assert again == got


def test_edges_are_order_statistics_with_halves_to_even(spark):
    d = spark.createDataFrame([("g", x) for x in [0.1, 0.5, 0.9, 1.3, 1.7, 2.1]] + [("h", 1.0)] * 4 + [("n", None), ("n", float("nan"))], "g string, m double")
    got = {r.g: (r.edges, r.n) for r in strata.edges(d, ["g"], "m").collect()}
    assert got == {"g": ([0.9, 1.3], 6), "h": ([1.0, 1.0], 4)}
    marked = strata.stratify(d.where("g <> 'n'"), ["g"], "m")
    assert sorted(r.stratum for r in marked.where("g = 'g'").collect()) == ["high", "high", "low", "low", "low", "medium"]


def test_edges_against_plain_python(spark):
    rng = random.Random(1)
    values = [(rng.choice("ab"), rng.choice([1.0, 2.0, 3.5, rng.random()])) for _ in range(500)]
    got = {r.g: r.edges for r in strata.edges(spark.createDataFrame(values, "g string, m double"), ["g"], "m").collect()}
    for g in "ab":
        own = sorted(v for k, v in values if k == g)
        assert got[g] == [own[round(i / 3 * (len(own) - 1))] for i in (1, 2)]


def test_blocks_number_all_rows(spark):
    d = spark.createDataFrame([(f"q{k}",) for k in range(1, 1001)], "id string")
    got = {r.id: (r.row_no, r.block_index) for r in strata.blocks(d, "id", 250).collect()}
    order = sorted(got)
    assert [got[i] for i in order] == [(k + 1, k // 250) for k in range(1000)]
    assert strata.blocks(d, "id", 250, 300).count() == 300


def test_samples_do_not_depend_on_row_order(spark):
    d = spark.createDataFrame([(f"i{k}", "abc"[k % 3] if k < 60 else "a") for k in range(80)], "id string, b string")
    shuffled = d.orderBy(F.rand(3)).repartition(5)
    for f in (lambda x: sampling.take(x, 10, 42, "id"), lambda x: sampling.take(x, 4, 42, "id", ["b"]), lambda x: sampling.balanced(x, 31, 42, "id", "b")):
        assert rows(f(d)) == rows(f(shuffled))
    assert rows(sampling.take(d, 10, 42, "id")) != rows(sampling.take(d, 10, 43, "id"))
    assert sampling.take(d, 500, 42, "id").count() == 80
    counts = {r.b: r["count"] for r in sampling.balanced(d, 31, 42, "id", "b").groupBy("b").count().collect()}
    assert counts == {"a": 11, "b": 10, "c": 10}
    full = {r.b: r["count"] for r in sampling.balanced(d, 70, 42, "id", "b").groupBy("b").count().collect()}
    assert full == {"a": 30, "b": 20, "c": 20}


@pytest.mark.parametrize("sizes,expected", [({"x": (9, 8, 12), "y": (8, 8, 8)}, 6 * 8), ({"x": (6, 9, 9), "y": (7, 7, 7)}, 6 * 6), ({"x": (5, 9, 9), "y": (7, 7, 7)}, 3 * 7), ({"x": (5, 9, 9), "y": (1, 7, 7)}, 0)])
def test_ladder_takes_what_the_smallest_qualifying_cell_has(spark, sizes, expected):
    data = [(f"{r}{s}{k}", "g", r, s) for r, own in sizes.items() for s, n in zip(("low", "medium", "high"), own) for k in range(n)]
    d = spark.createDataFrame(data, "id string, g string, r string, s string")
    got = sampling.ladder(d, ["g"], ["r"], "s", 3, 6, 8, 42, "id")
    assert got.count() == expected
    assert {r["count"] for r in got.groupBy("r", "s").count().collect()} <= {8, 6, 7}


def test_in_all_and_agreement(spark):
    d = spark.createDataFrame([("a", "m1", "x"), ("a", "m2", "x"), ("b", "m1", "x"), ("b", "m1", "y")], "i string, m string, l string")
    assert rows(sampling.in_all(d, "i", "m", 2)) == [("a",)]
    assert rows(sampling.label_agreement(d, "i", "l")) == [(1, 1)]


def items(spark):
    return spark.createDataFrame([("1", "KC", "g", "f", "m"), ("2", "KW", "g", "f", "m"), ("3", "other", "g", "f", "m")], "item_id string, knowledge_group string, gold_answer string, foil_answer string, memory_answer string")


def test_conditions_follow_the_group(spark):
    roles = {k: F.lit(k) for k in ("identity_a", "identity_b", "preferred", "dispreferred")}
    got = {(r.item_id, r.condition): (r.asserted_answer, r.conflict_status) for r in expand.conditions(items(spark), expand.CONFIRMATORY, roles, expand.MODEL_ARM, F.col("item_id") == "2").collect()}
    assert len(got) == 12
    assert got["1", "K1"] == ("g", "agreement") and got["1", "K3"] == ("f", "conflict")
    assert got["2", "K1"] == ("g", "conflict") and got["2", "K4"] == ("m", "agreement") and got["2", "M1"] == ("g", "conflict")
    assert got["1", "C0"] == (None, "none") and ("1", "M1") not in got


def test_condition_without_its_answer_is_an_error(spark):
    with pytest.raises(Exception):
        expand.conditions(items(spark).withColumn("foil_answer", F.lit(None).cast("string")), expand.PILOT, {}).collect()


def test_pairs_and_presentations(spark):
    d = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "l string")
    assert rows(expand.unordered_pairs(d, [], "l")) == [("a", "b"), ("a", "c"), ("b", "c")]
    assert expand.presentations(expand.unordered_pairs(d, [], "l")).count() == 6


def requests(spark):
    data = [("m1", "i1", "K1", "p", "a"), ("m1", "i1", "M1", "p", "a"), ("m1", "i1", "K2", "q", "a"), ("m1", "i2", "K1", "p", "a"), ("m2", "i1", "K1", "p", "b")]
    d = spark.createDataFrame(data, "model_key string, item_id string, condition string, prompt string, asserted_answer string")
    return d.withColumns({"arm": F.lit("x"), "source_role": F.lit("r"), "source_label": F.lit("s"), "evidence_truth": F.lit("true"), "conflict_status": F.lit("conflict"), "cohorts": F.array("condition")})


def test_equal_prompts_collapse_within_one_item_only(spark):
    ident = dedup.identify(requests(spark), "prompt", F.lit("rev"), "v1", F.lit("fp"), 42)
    got = {(r.model_key, r.item_id, r.primary_condition): (len(r.aliased_conditions), r.is_aliased, r.cohorts) for r in dedup.collapse(ident).collect()}
    assert got == {("m1", "i1", "K1"): (2, True, ["K1", "M1"]), ("m1", "i1", "K2"): (1, False, ["K2"]), ("m1", "i2", "K1"): (1, False, ["K1"]), ("m2", "i1", "K1"): (1, False, ["K1"])}
    totals = {r.model_key: (r.nominal_slots, r.unique_observations, r.collapsed_slots, r.items) for r in dedup.accounting(ident).collect()}
    assert totals == {"m1": (4, 3, 1, 2), "m2": (1, 1, 0, 1), None: (5, 4, 1, 2)}
    assert dedup.broken_aliases(ident).count() == 0
    odd = ident.withColumn("asserted_answer", F.when(F.col("condition") == "M1", F.lit(None)).otherwise(F.col("asserted_answer")))
    assert dedup.broken_aliases(odd).count() == 1
    other = dedup.identify(requests(spark), "prompt", F.lit("rev2"), "v1", F.lit("fp"), 42)
    assert ident.join(other, "observation_id").count() == 0
    assert rows(dedup.degenerate_contrasts(dedup.alias_map(ident), [("c", "K1", "M1")])) == [("m1", "c", 1, 1)]


def test_slot_without_outcome_is_an_error(spark):
    ident = dedup.identify(requests(spark), "prompt", F.lit("rev"), "v1", F.lit("fp"), 42)
    with pytest.raises(Exception):
        dedup.outcomes(dedup.alias_map(ident), spark.createDataFrame([], "observation_id string, y boolean"), "y").collect()


def test_outcomes_are_never_broadcast(spark):
    ident = dedup.identify(requests(spark), "prompt", F.lit("rev"), "v1", F.lit("fp"), 42)
    joined = dedup.outcomes(dedup.alias_map(ident), ident.select("observation_id").distinct().withColumn("y", F.lit(True)), "y")
    assert joined.count() == ident.count() and joined.where("y").count() == ident.count()
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_missing_side_leaves_the_item_out(spark):
    d = spark.createDataFrame([("i1", "a", True), ("i1", "b", False), ("i2", "a", True), ("i3", "b", True), ("i3", "a", None)], "i string, s string, y boolean")
    paired = contrasts.pair_items(d, ["i"], "s", "y", F.lit("a"), F.lit("b"))
    assert rows(paired) == [("i1", True, False)]
    twice = d.unionByName(d.limit(1))
    with pytest.raises(Exception):
        contrasts.pair_items(twice, ["i"], "s", "y", F.lit("a"), F.lit("b"), strict=True).collect()


@pytest.mark.parametrize("cells,category", [((2, 0, 97, 1), "INCONCLUSIVE"), ((1, 0, 0, 99), "INCONCLUSIVE"), ((4, 0, 40, 40), "INCONCLUSIVE"), ((7, 4, 5, 5), "INCONCLUSIVE"), ((24, 0, 56, 16), "FULL"), ((14, 0, 30, 156), "ATTENUATED"), ((3, 20, 30, 43), "NON-REPLICATION")])
def test_replication_classes(spark, cells, category):
    a, b, both, neither = cells
    t = spark.createDataFrame([(both, a, b, neither, sum(cells))], "both long, a_only long, b_only long, neither long, n long")
    assert contrasts.replication_class(contrasts.report(t), 0.2667).first().category == category


def test_rates_of_nothing(spark):
    empty = spark.createDataFrame([], "x boolean")
    assert rows(summaries.rate(empty, [], F.col("x"))) == [(None, 0)]


def test_conflict_only_refuses_agreement(spark):
    d = spark.createDataFrame([("conflict",), ("agreement",)], "conflict_status string")
    with pytest.raises(Exception):
        summaries.conflict_only(d).collect()


def test_override_summary_has_both_roles(spark):
    d = spark.createDataFrame([("m", "preferred", "KC", "false", "conflict", True)], "model_key string, source_role string, knowledge_group string, evidence_truth string, conflict_status string, context_adopted boolean")
    assert rows(summaries.override_summary(d)) == [("m", "dispreferred", None, 0, None, 0), ("m", "preferred", 1.0, 1, None, 0)]


def test_calibration(spark):
    d = spark.createDataFrame([("a", "b", "a"), ("a", "b", "b"), ("a", "b", None), ("a", "c", "a"), ("b", "c", None)], "source_a string, source_b string, selected_source string")
    s = calibration.pairwise_stats(d)
    assert rows(s) == [("a", "b", 3, 2, 1, 1, 0.5), ("a", "c", 1, 1, 1, 0, 1.0), ("b", "c", 1, 0, 0, 0, None)]
    assert rows(calibration.rank_sources(s)) == [("a", 0.75, 2, 3), ("b", 0.5, 1, 2), ("c", 0.0, 0, 1)]
    m = {r.source: r for r in calibration.preference_matrix(s, ["a", "b", "c"]).collect()}
    assert m["a"].a is None and m["b"].a == 0.5 and m["c"].a == 0.0 and m["c"].b is None
    assert rows(calibration.stability(s)) == [(3, 1, 1, 0)]


def test_verification(spark):
    p, r = spark.createDataFrame([("a",), ("b",), ("b",)], "k string"), spark.createDataFrame([("a",), ("c",)], "k string")
    assert rows(verify.bijection(p, r, "k")) == [("b", 2, 0), ("c", 0, 1)]
    b = spark.createDataFrame([("m", 0), ("m", 1), ("m", 3), ("n", 1)], "m string, block_index int")
    assert rows(verify.contiguous_prefix(b, ["m"])) == [("m", 0), ("m", 1)]
    assert [x[:2] for x in rows(verify.block_gaps(b, ["m"]))] == [("m", 3), ("n", 1)]
    done, plan = spark.createDataFrame([(1, "a"), (2, "x")], "n int, id string"), spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "n int, id string")
    assert rows(verify.prefix_breaks(done, plan, "id", "n")) == [(2, "x", "b")]
    bad = verify.failures(spark.createDataFrame([("a", 1), ("b", None)], "k string, x int"), ["k"], {"positive": F.col("x") > 0, "small": F.col("x") < 1})
    assert rows(bad) == [("a", "small"), ("b", "positive"), ("b", "small")]
    with pytest.raises(ValueError):
        verify.raise_if_any(bad, "rows failed")
    assert verify.forbidden_columns(spark.createDataFrame([], "a int, s struct<condition:string,x:int>, l array<struct<arm:int>>"), {"condition", "arm", "b"}) == ["l.arm", "s.condition"]
    lines = spark.createDataFrame([("# c",), ("",), ("A" * 64 + "  *f.txt",)], "value string")
    assert rows(verify.checksums(lines)) == [("a" * 64, "f.txt")]


def plain_logit(x, y, steps=60):
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p))
    return b, p


def test_logit_against_numpy(spark):
    rng = np.random.default_rng(3)
    n = 400
    x, c = rng.normal(size=n), rng.integers(0, 40, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + 0.8 * x)))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "c": c, "y": y, "g": np.where(c < 20, "a", "b")}))
    design = {"i": F.lit(1.0), "x": F.col("x")}
    got = {(r.g, r.term): r for r in regression.fit_logit(df, ["g"], "y", design, "c").collect()}
    for g, own in (("a", c < 20), ("b", c >= 20)):
        xs = np.c_[np.ones(own.sum()), x[own]]
        b, p = plain_logit(xs, y[own])
        inv = np.linalg.inv(xs.T @ (xs * (p * (1 - p))[:, None]))
        s = xs * (y[own] - p)[:, None]
        cl = np.array([s[c[own] == k].sum(0) for k in np.unique(c[own])])
        k, m = len(cl), own.sum()
        v = inv @ (cl.T @ cl) @ inv * (k / (k - 1)) * ((m - 1) / (m - 2))
        assert np.allclose([got[g, "i"].estimate, got[g, "x"].estimate], b, atol=1e-8)
        assert np.allclose([got[g, "i"].std_error, got[g, "x"].std_error], np.sqrt(np.diag(v)), atol=1e-8)


def test_separation_falls_back_to_the_penalised_fit(spark):
    d = spark.createDataFrame([(float(i), int(i > 5)) for i in range(12)], "x double, y int")
    design = {"i": F.lit(1.0), "x": F.col("x")}
    assert {r.status for r in regression.fit_logit(d, [], "y", design).collect()} == {"not estimable"}
    got = {r.term: r for r in regression.fit_logit(d, [], "y", design, None, 0, True).collect()}
    xs, ys = np.c_[np.ones(12), np.arange(12.0)], (np.arange(12) > 5).astype(int)
    b = np.array([got["i"].estimate, got["x"].estimate])
    p = 1 / (1 + np.exp(-xs @ b))
    w = p * (1 - p)
    info = xs.T @ (xs * w[:, None])
    h = np.einsum("ij,jk,ik->i", xs, np.linalg.inv(info), xs) * w
    assert np.allclose(xs.T @ (ys - p + h * (0.5 - p)), 0, atol=1e-5) and got["x"].method == "firth" and got["x"].p_value is None


def test_one_class_and_few_rows_are_not_estimable(spark):
    d = spark.createDataFrame([("a", 1.0, 1)] * 5 + [("b", 1.0, 0), ("b", 2.0, 1)], "g string, x double, y int")
    assert {r.status for r in regression.fit_logit(d, ["g"], "y", {"i": F.lit(1.0), "x": F.col("x")}, None, 3).collect()} == {"not estimable"}


def test_chi2():
    assert round(regression.chi2_sf(3.841458820694124, 1), 9) == 0.05 and round(regression.chi2_sf(10, 4), 6) == 0.040428


def test_bootstrap_is_fixed_by_its_seed(spark):
    t = spark.createDataFrame([("a", 96, 24, 0), ("b", 0, 0, 0)], "g string, n long, a_only long, b_only long")
    got = {r.g: r for r in bootstrap.bootstrap_interval(t, ["g"]).collect()}
    assert rows(bootstrap.bootstrap_interval(t.repartition(3), ["g"])) == rows(bootstrap.bootstrap_interval(t, ["g"]))
    assert got["a"].estimate == 0.25 and abs(got["a"].ci_lower - 0.167) < 0.012 and abs(got["a"].ci_upper - 0.344) < 0.012
    assert got["b"].estimate is None and got["b"].ci_lower is None


def test_runner_leaves_done_rows_out_and_takes_an_adapter(spark):
    d = spark.createDataFrame([("k1", "p1"), ("k2", "p2"), ("k2", "p2")], "record_key string, prompt string")
    todo = runner.pending(d, spark.createDataFrame([("k1",)], "record_key string"))
    got = runner.generate(todo, lambda: (lambda prompts: "Answer: " + prompts)).collect()
    assert [(r.record_key, r.raw_generation) for r in got] == [("k2", "Answer: p2")]
    dummy = runner.generate(d).select("raw_generation").distinct().collect()
    assert len(dummy) == 2 and all(r[0].startswith("Answer: ") for r in dummy)
    trials = runner.calibration_trials(spark.createDataFrame([("a",), ("b",)], "l string"), [], "l", "{source_1} or {source_2}?", lambda: (lambda prompts: prompts.map(lambda p: "Choice: 1")))
    assert sorted(r.selected_source for r in trials.collect()) == ["a", "b"]


def test_order_statistics_do_not_depend_on_the_number_of_ranges(spark, monkeypatch):
    from cairnstat.operators import frequencies

    rng = random.Random(7)
    values = [("ab"[rng.random() < 0.3], rng.choice([1.0, 1.0, rng.gauss(0, 2), rng.paretovariate(0.8)])) for _ in range(3000)]
    d = spark.createDataFrame(values, "g string, m double")
    plain = {g: sorted(v for k, v in values if k == g) for g in "ab"}
    index = [lambda n: n - n, lambda n: F.floor(n / 3), lambda n: n - 1]
    for rows_per_range in (200_000, 40):
        monkeypatch.setattr(frequencies, "ROWS_PER_RANGE", rows_per_range)
        got = {r.g: (r.found, r.n) for r in frequencies.order_statistics(d, ["g"], "m", index).collect()}
        assert got == {g: ([v[0], v[len(v) // 3], v[-1]], len(v)) for g, v in plain.items()}
        q = {r.g: r.quantiles for r in frequencies.linear_quantiles(d, ["g"], "m", [0.0, 0.25, 0.5, 1.0]).collect()}
        for g, v in plain.items():
            assert np.allclose(q[g], np.quantile(v, [0.0, 0.25, 0.5, 1.0]))
    assert frequencies.order_statistics(d.limit(0), ["g"], "m", index).count() == 0


def test_too_many_models_are_an_error(spark):
    d = spark.createDataFrame([(1, "a", 1, "x"), (0, "b", 0, "y"), (1, "c", 1, "z")], "y int, model string, source int, item string")
    with pytest.raises(ValueError, match="more than 2 models"):
        regression.model_by_source(d, "y", "model", "source", "item", params=regression.FitParams(max_models=2))
