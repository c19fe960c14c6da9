import random
from fractions import Fraction

import pytest

from cairnstat.llm import mixing

DOCS = "doc_id long, text string, source string, n_tokens string"
TARGET = "source string, target_share double, max_repeats int"


def slow(weights, seats, caps):
    got = [0] * len(weights)
    for _ in range(seats):
        open_ = [k for k, w in enumerate(weights) if got[k] < caps[k] and w > 0]
        if not open_:
            break
        got[max(open_, key=lambda k: (Fraction(weights[k]) / (2 * got[k] + 1), -k))] += 1
    return got


def test_seats_against_dealing_one_by_one():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 8)
        w = [rng.choice([0.0, 0.1, 0.25, 0.3, rng.random(), 5.0]) for _ in range(n)]
        seats, caps = rng.randint(0, 60), [rng.randint(0, 40) for _ in range(n)]
        assert mixing.sainte_lague(w, seats, caps) == slow(w, seats, caps)
    assert sum(mixing.sainte_lague([0.3, 0.7], 10**12)) == 10**12


def corpus(spark):
    rng = random.Random(4)
    rows = []
    for source, n in (("big", 400), ("mid", 90), ("small", 12), ("untargeted", 50), (None, 9)):
        rows += [(len(rows) + k, " ".join(rng.choice(["river", "boat", "king"]) for _ in range(rng.randrange(5, 60))), source, "") for k in range(n)]
    return spark.createDataFrame(rows + rows[:20] + [(9000, None, "big", ""), (9001, "", "mid", "")], DOCS)


def test_shares_repeats_and_report(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("absent", 0.05, 3), ("big2", None, 1)], TARGET)
    for params in (mixing.MixParams(), mixing.MixParams(shard_tokens=700)):
        mixed = mixing.mix(corpus(spark), targets, params)
        rows = mixed.collect()
        assert {r.source for r in rows} == {"big", "mid", "small"}
        assert all(r.copies <= {"big": 1, "mid": 2, "small": 4}[r.source] for r in rows)
        assert len({r.doc_id for r in rows}) == len(rows)
        report = {r.source: r for r in mixing.shares(mixed, targets).collect()}
        assert report["absent"].actual_share == 0 and report["absent"].tokens == 0
        for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.15)):
            assert abs(report[s].actual_share - share / 0.95) < 0.03
        assert report["small"].most_copies > 1


def test_copies_of_a_text_are_one_text(spark):
    rows = [(k, f"text number {k % 5} of the river", "big", "") for k in range(50)] + [(100 + k, f"another text {k} of the king", "mid", "") for k in range(5)]
    mixed = mixing.mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("big", 0.5, 2), ("mid", 0.5, 2)], TARGET)).collect()
    assert {r.doc_id for r in mixed if r.source == "big"} <= set(range(5)) and max(r.copies for r in mixed) <= 2


def test_same_seed_same_mix(spark):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.5, 1)], TARGET)
    draw = lambda d, seed: sorted((r.doc_id, r.copies) for r in mixing.mix(d, targets, mixing.MixParams(seed=seed)).collect())
    d = corpus(spark)
    assert draw(d, 1) == draw(d.repartition(7), 1) != draw(d, 2)


def test_empty(spark):
    targets = spark.createDataFrame([("big", 0.5, 1)], TARGET)
    assert mixing.mix(spark.createDataFrame([], DOCS), targets).count() == 0
    assert mixing.mix(corpus(spark), spark.createDataFrame([], TARGET)).count() == 0
    assert [r.actual_share for r in mixing.shares(mixing.mix(spark.createDataFrame([], DOCS), targets), targets).collect()] == [0.0]


def test_too_many_targets_are_an_error(spark):
    d = spark.createDataFrame([(1, "river boat", "a", "")], DOCS)
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], TARGET)
    with pytest.raises(ValueError, match="more than 1 sources"):
        mixing.mix(d, t, mixing.MixParams(max_sources=1))
