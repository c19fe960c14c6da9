"""Cohorts, families and checks that refuse what isn't whole."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cairnstat.operators import classify, contrasts, frequencies, runner, sampling, strata, summaries, verify
from cairnstat.sources import jsonl


def test_a_member_without_a_record_is_an_error(spark):
    members = spark.createDataFrame([("m", "a"), ("m", "b")], "model_key string, item_id string")
    records = spark.createDataFrame([("m", "a", 1)], "model_key string, item_id string, x int")
    assert sampling.member_records(members.limit(1), records, ["model_key", "item_id"]).collect()[0].x == 1
    with pytest.raises(Exception, match="a member has no record: m|b"):
        sampling.member_records(members, records, ["model_key", "item_id"]).collect()


def test_conflict_reasons_in_their_order(spark):
    rows = [("p", "s", False, None), ("p", None, False, "relation_requires_review"), (None, "s", False, "relation_requires_review"), ("x", None, True, "relation_not_primary_conflict"), ("r", "s", True, "relation_requires_review"), ("odd", "s", False, "relation_unrecognized"), ("p", "s", True, "relation_multi_object")]
    d = spark.createDataFrame(rows, "relation string, subj string, multi boolean, want string")
    got = d.select("want", classify.conflict_reason("relation", "subj", "multi", ["p"], ["r"], ["x"]).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_a_right_answer_without_a_foil_is_excluded(spark):
    group, why = classify.assigned_group("g", "foil")
    d = spark.createDataFrame([("KC", None), ("KC", "f"), ("KW", None), (None, None)], "g string, foil string")
    assert [tuple(r) for r in d.select(group, why).collect()] == [("excluded", "no_defensible_foil"), ("KC", None), ("KW", None), (None, None)]


def test_supply_of_a_cohort(spark):
    d = spark.createDataFrame([("low",)] * 3 + [("high",)] * 5 + [(None,)], "s string")
    got = {r.s: (r.available, r.selected, r.shortfall, r.state) for r in sampling.cohort_supply(d, "s", ["low", "medium", "high"], 4).collect()}
    assert got == {"low": (3, 3, 1, "ELIGIBILITY_LIMITED"), "medium": (0, 0, 4, "ELIGIBILITY_LIMITED"), "high": (5, 4, 0, "ELIGIBILITY_LIMITED")}
    assert {r.state for r in sampling.cohort_supply(d, "s", ["low", "high"], 3).collect()} == {"COMPLETE"}


def test_shared_quota_wants_every_member_and_one_part(spark):
    rows = [(m, f"i{k}", "x" if k % 2 else "y") for m in "ab" for k in range(10)] + [("a", "only", "x"), ("a", "two", "x"), ("b", "two", "y"), ("a", "none", None), ("b", "none", None), ("a", "z", "unlisted"), ("b", "z", "unlisted")]
    d = spark.createDataFrame(rows, "m string, id string, part string")
    got = sampling.shared_quota(d, "id", "m", 2, "part", ["x", "y"], 6, 1, "C").collect()
    assert sorted(r.part for r in got) == ["x"] * 3 + ["y"] * 3 and all(r.id.startswith("i") for r in got)


def test_family_members_and_why_others_are_none(spark):
    registry = spark.createDataFrame([("f", n, g) for n, g in (("a", None), ("b", ""), ("c", "not eligible"), ("d", None), ("e", None))], "family string, name string, gate_reason string")
    results = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.001), ("f", "d", None), ("f", "unlisted", 0.2)], "family string, name string, p double")
    got = {r.name: (r.included, r.reason, r.holm_p) for r in contrasts.holm_family(registry, results, "name", ["family"], "p").collect()}
    assert got == {"a": (True, "included", 0.02), "b": (True, "included", 0.04), "c": (False, "not eligible", None), "d": (False, "no single test statistic", None), "e": (False, "not computed", None)}


def test_rates_by_stratum_and_diagnostics(spark):
    d = spark.createDataFrame([("m", "low", True), ("m", "low", None), ("m", None, True)], "model_key string, stratum string, y boolean")
    got = {r.stratum: (r.trials, r.adopted, r.rate) for r in strata.adoption_by_stratum(d, ["model_key"], "stratum", "y").collect()}
    assert got == {"low": (2, 1, 0.5), "medium": (0, 0, None), "high": (0, 0, None)}
    e = spark.createDataFrame([("m", "uncertain", " Paris", "paris", None, True, False), ("m", None, None, "", True, None, True)], "model_key string, decision string, parsed_answer string, asserted_answer string, final_correct boolean, manual_review boolean, malformed boolean")
    r = summaries.diagnostics(e, ["model_key"]).first()
    assert (r.n, r.abstention_rate, r.accuracy, r.review_rate, r.parse_failure_rate, r.tentative_rate) == (2, 0.5, 0.5, 0.5, 0.5, 0.5)


def test_status_breaks_and_unions(spark):
    d = spark.createDataFrame([(1, "S", "f", None), (2, "NOT APPLICABLE", "f", " "), (3, "NOT APPLICABLE", "f", "off"), (4, "S", None, "x")], "id int, status string, family string, reason string")
    got = {r.id: r.breach for r in classify.status_breaks(d, "status", "family", "reason", [("S", "f"), ("NOT APPLICABLE", "f")]).collect()}
    assert got == {2: "no reason", 4: "illegal pair"}
    assert sorted(r.id for r in verify.in_either(d.where("id < 3"), d.where("id > 1"), ["id"]).collect()) == [1, 2, 3, 4]


def test_the_canonical_digest_is_that_of_the_file(spark, tmp_path):
    d = spark.createDataFrame([(k, "ü" if k % 2 else None) for k in range(50)], "k long, v string")
    want = hashlib.sha256("".join(r.value + "\n" for r in jsonl.canonical_lines(d, ["k"]).collect()).encode()).hexdigest()
    assert {jsonl.write_canonical(d.repartition(n), f"file://{tmp_path}/c{n}", ["k"]) for n in (1, 7)} == {want}


def test_blocks_and_exclusions_have_bounds(spark, tmp_path):
    d = spark.createDataFrame([(k,) for k in range(5)], "item_id long")
    with pytest.raises(ValueError, match="more than 4 rows"):
        jsonl.write_block(d, f"file://{tmp_path}/b", "m", 0, {}, max_rows=4)
    with pytest.raises(ValueError, match="5 ids, expected 6"):
        jsonl.write_exclusions(d, f"file://{tmp_path}/x.json", expected=6)
    with pytest.raises(ValueError, match="more than 4 ids"):
        jsonl.write_exclusions(d, f"file://{tmp_path}/x.json", max_ids=4)


def test_default_calibration_answers_choose(spark):
    d = spark.createDataFrame([("g", x) for x in "abc"], "g string, label string")
    got = runner.calibration_trials(d, ["g"], "label", "1: {source_1}\n2: {source_2}").collect()
    assert len(got) == 6 and all(r.selected_source in (r.displayed_source_1, r.displayed_source_2) for r in got)


def test_the_number_of_ranges_follows_the_rows(spark, monkeypatch):
    monkeypatch.setattr(frequencies, "RANGES", 8)
    monkeypatch.setattr(frequencies, "ROWS_PER_RANGE", 100)
    d = spark.range(5000).select(F.col("id").cast("double").alias("v"))
    assert len(frequencies.split_points(d, "v")) == 49
    assert len(frequencies.split_points(d.limit(350), "v")) in (3, 4)
    assert frequencies.split_points(d.limit(90), "v") == []
