import random

from cairnstat.llm import truncation as C

SCHEMA = "record_id long, model_key string, run_id string, raw_generation string, generation_config struct<do_sample:boolean,max_new_tokens:int,num_beams:int>"
WORDS = "the reviewer leaves a question open after reading every printed page of this register again".split()


def responses(n=4000, seed=3, cut_share=0.06):
    """(id, text) in a format that the operator isn't told, some cut at a random place, and the ids of those whose ending shows it."""
    rng, out, cut = random.Random(seed), [], set()
    names = ["".join(rng.choice("aeioubdklmnrst") for _ in range(7)).capitalize() for _ in range(60)]
    for k in range(n):
        lines = [f"Finding: {rng.choice(names)} {rng.choice(names)}", f"Verdict: {rng.choice(['accept', 'accept | doubt', 'doubt'])}", f"Score: {rng.randrange(5, 100, 5)}"]
        prose = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 9)))
        if rng.random() < 0.4:
            lines.append(f"Grounds: See vol. {rng.randrange(1, 9)} of it. It {prose}.")
        if rng.random() < 0.2:
            lines.insert(0, f"As vol. {rng.randrange(1, 9)} has it, it {prose}.")
        text = "\n".join(lines)
        if rng.random() < cut_share:
            text = text[: rng.randrange(len(text) // 2, len(text) - 1)].rstrip()
            last = text.split("\n")[-1]
            if last.split(": ")[0] in ("Finding", "Score") and last[-1] != ":" or last in lines or last.endswith(" it.") or last in ("Verdict: accept", "Verdict: doubt"):
                continue
            cut.add(k)
        out.append((k, "m", "r", text, (False, 99, 1)))
    return out, cut


def test_incomplete_endings_are_learnt_without_being_told_the_format(spark):
    rows, cut = responses()
    got = {r.record_id: (r.cut, r.cause) for r in C.truncated(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = {k for k, (v, _) in got.items() if v}
    text = {r[0]: r[3] for r in rows}
    assert len(found & cut) >= 0.95 * len(cut), [text[k][-30:] for k in cut - found]
    assert len(found - cut) <= 0.003 * len(rows), [text[k][-30:] for k in found - cut]
    # an abbreviation ends no response
    assert all(k in found for k in cut if text[k].endswith("vol."))


def test_null_and_blank_are_no_cut_responses(spark):
    d = spark.createDataFrame([(k, "m", "r", t, (False, 99, 1)) for k, t in enumerate([None, "", " \n ", "Done.", "\u200b"])] + [(None, "m", "r", "Done.", None)], SCHEMA)
    assert {r.record_id: r.cut for r in C.truncated(d).collect()}.keys() <= {3, 4}


def test_without_walls_no_cut_is_by_a_limit(spark):
    rows, cut = limited()
    d = spark.createDataFrame(rows, SCHEMA)
    by_limit = {r.record_id for r in C.truncated(d).where("cause = 'limit'").collect()}
    assert len(by_limit & cut) >= 0.97 * len(cut) and len(by_limit - cut) <= 0.01 * len(rows)
    assert C.truncated(d, C.TruncationParams(wall=2.0)).where("cause = 'limit'").count() == 0


def test_discoveries_follow_benjamini_and_hochberg(spark):
    import math

    p = [1e-9, 1e-4, 0.004, 0.02, 0.3, 0.5, 0.7, 0.9]
    d = spark.createDataFrame([(-math.log(x),) for x in p], "e double")
    least = C._thresholds([("t", d, "e")], 0.05)["t"]
    assert [x for x in p if -math.log(x) >= least] == [1e-9, 1e-4, 0.004, 0.02]
    assert C._thresholds([("t", spark.createDataFrame([], "e double"), "e")], 0.05) == {}


def limited(seed=1, n=3000, limit=44):
    rng = random.Random(seed)
    rows, cut = [], set()
    for k in range(n):
        text = f"Answer: {rng.choice(WORDS)}\nDecision: answer\nConfidence: {rng.randrange(5, 100, 5)}\nReason: " + " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 30))) + "."
        import re

        pieces = list(re.finditer(r"\w{1,4}|\n|[^\w\s]", text))
        if len(pieces) > limit:
            text = text[: pieces[limit - 1].end()]
            cut.add(k)
        rows.append((k, "m", "r", text, (False, limit, 1)))
    return rows, cut


def test_the_limit_is_found_as_a_wall(spark):
    rows, cut = limited()
    d = spark.createDataFrame(rows + rows[:100], SCHEMA)
    table = C.hazard_table(C.length_table(C.features(d)))
    walls = {(r.unit, r.length) for r in table.where("significant and hazard >= 0.5 and scope = 'run'").collect()}
    assert ("pieces", 44) in walls
    got = {r.record_id: r.cut for r in C.truncated(d).collect()}
    assert len(got) == len(rows)
    found = {k for k, v in got.items() if v}
    assert len(found & cut) >= 0.97 * len(cut) and len(found - cut) <= 0.01 * len(rows)


def test_rates_and_empty(spark):
    rows = [(k, "m", "r", f"Answer: {'xy' * (k % 30 + 1)}\nDone.", (False, 9, 1)) for k in range(60)] + [(60 + k, "m", "r", "Answer:", (False, 9, 1)) for k in range(20)] + [(99, None, None, "Answer: x\nDone.", None)]
    rates = {(r.model_key, r.run_id): (r.responses, r.cut_responses, r.cut_rate) for r in C.truncation_rates(C.truncated(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert rates == {("m", "r"): (80, 20, 0.25), (None, None): (1, 0, 0.0)}
    assert C.truncated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_text(spark):
    d = spark.createDataFrame([(1, "m", "r", "word " * 200_000 + "end.", (False, 9, 1)), (2, "m", "r", "word " * 200_000, (False, 9, 1))], SCHEMA)
    assert {r.record_id: r.cut for r in C.truncated(d).collect()} == {1: False, 2: True}


def test_whole_endings_at_a_storage_limit_of_one_run(spark):
    """Run r stores 200 characters; what falls on a closing mark there looks whole."""
    rng, rows, cut = random.Random(5), [], set()
    for k in range(3000):
        run = "r" if k < 1000 else f"q{k % 4}"
        text = "Answer: x\nDecision: answer\nConfidence: 5\nReason: " + " ".join(rng.choice(WORDS) for _ in range(rng.randrange(10, 60))) + "."
        if run == "r" and len(text) > 200:
            text = text[:199] + "."
            cut.add(k)
        rows.append((k, "m", run, text, (False, 999, 1)))
    got = {r.record_id: r.cut for r in C.truncated(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = {k for k, v in got.items() if v}
    assert cut <= found and len(found - cut) <= 30
