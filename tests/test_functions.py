import math

import pytest
from pyspark.sql import functions as F

from cairnstat.functions import digest, stats, text


def column(spark, values, kind, expr):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(expr).collect()]


def test_normalize_answer(spark):
    cases = {"Barack Obama!": "barack obama", "  New   York  ": "new york", "The Beatles": "beatles", "An Apple": "apple", "A Study In Scarlet": "study in scarlet", "": "", None: "", "A": "", "!!!": "", "the the x": "the x", "L’été – x": "l’été – x", "a b": "b", "x　y": "x y"}
    assert column(spark, cases, "string", text.normalize_answer("v")) == list(cases.values())


def test_parse_response(spark):
    cases = [
        ("Answer: Paris\nDecision: answer\nConfidence: 85", ("Paris", "answer", 85, False)),
        ("Answer: Paris\nDecision: answer\nConfidence: 250", ("Paris", "answer", 100, False)),
        ("Answer: Paris\nDecision: answer", ("Paris", "answer", None, False)),
        ("Decision: answer\nConfidence: 1", (None, "answer", 1, True)),
        ("Answer: Paris\nConfidence: 99999999999999999999", ("Paris", None, 100, True)),
        ("Answer:\nDecision: answer", ("Decision: answer", "answer", None, False)),
        ("Answer: x\nDecision: answer | uncertain", ("x", None, None, True)),
        ("answer: x\ndecision: UNCERTAIN  ", (None, "uncertain", None, True)),
        (None, (None, None, None, True)),
        ("", (None, None, None, True)),
    ]
    got = column(spark, [c for c, _ in cases], "string", text.parse_response("v"))
    assert [tuple(g) for g in got] == [e for _, e in cases]


def test_parse_choice(spark):
    cases = {"Choice: 1": 1, "Choice:    1   ": 1, "Choice:\t2": 2, "Choice: 1 | 2": None, "Choice: 1 because": None, "Choice: 2 blah": None, "Choice: 12": None, "1/2": None, "": None, None: None}
    assert column(spark, cases, "string", text.parse_choice("v")) == list(cases.values())


def test_parse_alias_field(spark):
    cases = {"['Foo','B, r']": ["Foo", "B, r"], "[\"it's\"]": ["it's"], "['a\\'b', \"c\"]": ["a'b", "c"], "[]": [], "[1, 2]": ["1", "2"], "[oops": ["[oops"], "[a, b]": ["[a, b]"], " x ": ["x"], "": [], None: []}
    assert column(spark, cases, "string", text.parse_alias_field("v")) == list(cases.values())


def test_match_and_f1(spark):
    d = spark.createDataFrame([("The Alps!", "alps", None), ("x", "y", ["X "]), ("", "", ["", None]), (None, None, None), ("a b b", "b b c", [])], "c string, g string, a array<string>")
    rows = d.select(text.is_match("c", "g", "a").alias("m"), text.token_f1("c", "g").alias("f")).collect()
    assert [r.m for r in rows] == [True, True, False, False, False]
    assert [round(r.f, 6) for r in rows] == [1.0, 0.0, 1.0, 1.0, 0.8]


def test_render_never_reads_values_for_places(spark):
    d = spark.createDataFrame([("{b}", "x"), (None, "y")], "a string, b string")
    got = [r[0] for r in d.select(text.render("<{a}|{b}>", a=F.col("a"), b=F.col("b"))).collect()]
    assert got == ["<{b}|x>", "<None|y>"]


def test_clean_candidates(spark):
    cases = {"Paris": True, "Paris, France": False, "Paris or London": False, "Paris and London": False, "a b c d e f": True, "a b c d e f g": False, None: True}
    assert column(spark, cases, "string", text.is_clean_candidate("v")) == list(cases.values())


def test_digests(spark):
    import hashlib

    got = spark.range(1).select(digest.record_key("t", "m", "i", "c", "v1", 42), digest.settings_fingerprint({"do_sample": False, "top_p": None}), digest.observation_id(F.lit("m"), F.lit(None).cast("string"), F.lit("i"), F.lit("h"), "v1", F.lit("f"), 42)).first()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[0] == sha("t|m|i|c|v1|42")
    assert got[1] == sha("do_sample=False|top_p=None")[:16]
    assert got[2] == sha("phase3|m|UNRESOLVED|i|h|v1|f|42")[:32]
    assert column(spark, ["main", " HEAD ", "", None, "a1b2"], "string", digest.is_pinned("v")) == [False, False, False, False, True]


CELLS = [((56, 24, 0, 16), (0.25, 0.174140, 0.345098, 1.1920928955078125e-07)), ((17, 8, 0, 5), (0.266667, 0.122883, 0.444480, 0.0078125)), ((53, 0, 0, 1), (0.0, -0.066414, 0.066414, 1.0)), ((0, 0, 0, 30), (0.0, -0.113513, 0.113513, 1.0)), ((10, 12, 5, 33), (0.116667, -0.019466, 0.254022, 0.143463134765625))]


def test_intervals_and_exact_p(spark):
    from cairnstat.operators.contrasts import report

    d = spark.createDataFrame([(i, *c, sum(c)) for i, (c, _) in enumerate(CELLS)] + [(99, 0, 0, 0, 0, 0)], "i int, both long, a_only long, b_only long, neither long, n long")
    rows = {r.i: r for r in report(d).collect()}
    for i, (_, (delta, low, high, p)) in enumerate(CELLS):
        r = rows[i]
        assert (round(r.risk_difference, 6), round(r.ci_lower, 6), round(r.ci_upper, 6)) == (delta, low, high)
        assert math.isclose(r.exact_p, p, rel_tol=1e-9)
    assert rows[99].ci_lower is None and rows[99].exact_p is None and rows[99].rate_a is None


def test_interval_ends_meet_the_level(spark):
    d = spark.createDataFrame([(b, c, n) for b, c, n in [(5, 3, 40), (0, 9, 30), (120, 80, 1000)]], "b int, c int, n int").withColumn("t", stats.tango_interval("b", "c", "n"))
    for r in d.select(stats.tango_z("b", "c", "n", F.col("t.lower")).alias("l"), stats.tango_z("b", "c", "n", F.col("t.upper")).alias("u")).collect():
        assert math.isclose(r.l, stats.Z975, rel_tol=1e-6) and math.isclose(r.u, -stats.Z975, rel_tol=1e-6)


def test_exact_p_of_many_pairs_does_not_underflow(spark):
    got = column(spark, [3000], "int", stats.exact_p(F.col("v"), F.col("v") - 200))
    m, k = 5800, 2800
    top = math.lgamma(m + 1) - m * math.log(2)
    expected = min(1.0, 2 * sum(math.exp(top - math.lgamma(i + 1) - math.lgamma(m - i + 1)) for i in range(k + 1)))
    assert math.isclose(got[0], expected, rel_tol=1e-6)


def test_holm(spark):
    d = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5), ("e", None)], "name string, p double")
    got = {r.name: r.holm_p for r in stats.holm(d, "p", "name").collect()}
    assert {k: None if v is None else round(v, 9) for k, v in got.items()} == {"a": 0.04, "b": 0.09, "c": 0.09, "d": 0.5, "e": None}


def test_logprobs_and_boundary(spark):
    d = spark.createDataFrame([([1, 2, 3], [1, 2, 4, 5], [-1.0, -2.0])], "p array<int>, f array<int>, l array<double>")
    r = d.select(stats.answer_boundary("p", "f").alias("b"), stats.mean_logprob("l").alias("m")).first()
    assert (r.b, r.m) == (2, -1.5)
    same = spark.createDataFrame([([1, 2], [1, 2], [])], "p array<int>, f array<int>, l array<double>")
    for expr in (stats.answer_boundary("p", "f"), stats.mean_logprob("l")):
        with pytest.raises(Exception):
            same.select(expr).collect()
