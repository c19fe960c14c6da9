from pyspark.sql import functions as F

from cairnstat.operators import classify


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_table_and_rules(spark):
    d = spark.createDataFrame([("a", 1), ("b", None), (None, 3), ("z", 9)], "k string, n int")
    got = d.select("k", classify.by_table("k", {"x": ["a"], "y": ["b"]}, "other"), classify.first_rule([(F.col("n") > 5, "big"), (F.col("n") > 0, "small")], "none"))
    assert rows(got) == [("a", "x", "small"), ("b", "y", "none"), ("z", "other", "big"), (None, "other", "small")]


def test_status_and_group(spark):
    cases = [
        (None, "answer", True, "malformed", "excluded"), ("Paris", "uncertain", False, "uncertain", "excluded"), ("I don't know!", "answer", False, "uncertain", "excluded"), ("Unknown", "answer", False, "uncertain", "excluded"),
        ("Paris", "answer", False, "answer", "KC"), ("city of light", "answer", False, "answer", "KC"), ("Rome", "answer", False, "answer", "KW"), ("Rome, Italy", "answer", False, "answer", "manual_review"), ("Rome or Bern", "answer", False, "answer", "manual_review"), ("Paris", None, True, "malformed", "excluded"),
    ]
    d = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, a string, d string, m boolean").withColumns({"g": F.lit("Paris"), "al": F.array(F.lit("City of Light"))})
    got = d.orderBy("i").select(classify.answer_status("a", "d", F.col("m")).alias("s"), classify.knowledge_group("a", "d", F.col("m"), "g", "al").alias("k")).collect()
    assert [(r.s, r.k) for r in got] == [c[3:] for c in cases]


def test_marks_reasons_and_bundles(spark):
    d = spark.createDataFrame([("a", "p", "r1"), ("b", "p", "r2"), (None, "q", "r1"), ("c", "z", None)], "k string, s string, r string")
    assert rows(classify.mark_listed(d, "k", spark.createDataFrame([("a",), (None,)], "k string"), "s", "off").select("k", "s")) == [("a", "off"), ("b", "p"), ("c", "z"), (None, "q")]
    assert rows(classify.combined_reason(d, ["s"], "r")) == [("p", "mixed:r1,r2"), ("q", "r1"), ("z", None)]
    assert classify.combined_reason(d, [], "r").first().reason == "mixed:r1,r2"
    assert rows(classify.illegal_pairs(d, "s", "r", [("p", "r1"), ("q", "r1")])) == [("p", "r2"), ("z", None)]
    assert classify.bundle({"x": d, "y": d.where("s = 'p'")}, ["k"]).groupBy("cohort").count().orderBy("cohort").collect() == [("x", 4), ("y", 2)]


def test_study_table_is_the_single_contrasts(spark):
    data = [(f"i{k}", c, (k * 7 + ord(c[1])) % 3 == 0) for k in range(40) for c in ("K1", "K2", "K3") if (k + ord(c[1])) % 5]
    d = spark.createDataFrame(data, "item string, condition string, context_adopted boolean")
    got = {r.contrast: r for r in classify.study_table(d, [{"name": "x", "a": "K1", "b": "K2"}, {"name": "y", "a": "K1", "b": "K3", "where": F.col("item") != "i1"}], ["item"]).collect()}
    own = {(i, c): y for i, c, y in data}
    for name, a, b, skip in (("x", "K1", "K2", None), ("y", "K1", "K3", "i1")):
        pairs = [(own[i, a], own[i, b]) for i in {i for i, _ in own} if (i, a) in own and (i, b) in own and i != skip]
        assert (got[name].n, got[name].a_only, got[name].b_only) == (len(pairs), sum(x and not y for x, y in pairs), sum(y and not x for x, y in pairs))
