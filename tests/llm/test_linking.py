import pytest

from cairnstat.llm import linking as L
from cairnstat.llm.textforms import Transducer

ENTRIES = [
    (1, "Upper Brirtwex", None), (2, "Lower Brirtwex", []), (3, "Oskel H. Zorärt", ["O. Zorärt", "Master Zorärt"]), (4, "Thanergjaik Rowing Club", ["Society of Thanergjaik"]),
    (5, "Tеskeathom", ["Гатсхотеам"]), (6, "Drezit", None), (7, "Saint-Klaizaklad", None), (8, "Kaithejart-on-Ree", ["Old Kaithejart Quay"]), (9, "Brunek-Tesmar Kealdusais", None),
]
EXTRA = [(100 + k, f"{first} {core}", None) for k, (first, core) in enumerate((f, c) for f in ("Upper", "Lower", "Brunek", "Oskel", "Saint", "Tesmar", "Rowing", "Club") for c in ("Aaldorn", "Bexquint", "Cruvidal", "Dwopnash", "Efflmorg", "Grastwin", "Hyclorid", "Jomparth", "Kvindost", "Lurhabig", "Mestrock", "Nofwindel", "Pabrongo"))]


@pytest.fixture(scope="module")
def linker():
    names = {n for _, g, a in ENTRIES + EXTRA for n in [g, *(a or [])]}
    frames = {("before", ("the", "answer", "is")), ("before", ("most", "likely")), ("before", ("the",)), ("before", ("dr",)), ("after", ("in", "the", "north"))}
    return L.Linker(ENTRIES + EXTRA, Transducer(names), L.LinkParams(common_names=8), frozenset(frames))


@pytest.mark.parametrize(
    "value,fits",
    [
        ("Drezit", [6]), ("the answer is Drezit", [6]), ("most likely drezit, in the north", [6]), ("DREZIT.", [6]), ('"Drezit"', [6]), ("Drezitt", [6]), ("Drzeit", [6]), ("Upper Drezit", []), ("Zorärt", [3]), ("zorart, oskel", [3]),
        ("Dr. Oskel Zorart", [3]), ("Tesmar Zorärt", []), ("H. Zorärt", [3]), ("the Rowing Club of Thanergjaik", [4]), ("Thanergjaik Club", [4]), ("Thanergjaik Weavers Guild", []), ("ГАТСХОТЕАМ", [5]), ("St. Klaizaklad", [7]), ("Kaithejart on Ree", [8]),
        ("Kealdusais, Brunek", [9]), ("Brirtwex", [1, 2]), ("Lower Brirtwex", [2]), ("lower brirtvex", [2]), ("unknown", []), ("", []), ("???", []), ("in the north", []), ("Boklixfead Weavers Guild", []), ("Ｄｒｅｚｉｔ", [6]), ("Dre​zit", [6]),
        ("Drezit and Zorärt", []), ("x" * 5000, []), ("x" * 10_000 + " drezit", []), ("South Drezit", []), ("Not Drezit", []), ("Drezit North", []), ("south drezitt", []), ("drezitt in the north", [6]), ("St Klaizaklad", [7]),
        ("Thanergjiak Rowing Club", [4]), ("Kealdussai", [9]), ("Upr Brirtwex", [1]), ("the answer is most likely Drezit", [6]),
    ],
)
def test_values(linker, value, fits):
    assert list(linker.link(value)[0]) == fits


def test_edits_against_walking_all_edits():
    def around(w):
        for k in range(len(w) + 1):
            for c in "abc":
                yield w[:k] + c + w[k:]
                yield w[:k] + c + w[k + 1 :]
            yield w[:k] + w[k + 1 :]
            yield w[:k] + w[k + 1 : k + 2] + w[k : k + 1] + w[k + 2 :]

    for start in ("", "ab", "abca", "caabb"):
        far, last = {start: 0}, {start}
        for d in (1, 2, 3):
            last = {v for w in last for v in around(w)} - set(far)
            far |= dict.fromkeys(last, d)
        for w, d in far.items():
            assert L.edits(start, w, 3) == d, (start, w)
    assert L.edits("abcabc", "cccccccccc", 3) == 4 and L.edits("skojixwem", "skioxwem", 3) == 2


def test_three_edits_of_a_long_word_are_met():
    linker = L.Linker([(1, "Klaizakladonim", None), (2, "k" * 15 + "lmnop" * 4, None)], Transducer([]))
    assert linker.link("Kxaizaxladoxim")[0] == (1,) and linker.link("Kxaizaxlxdoxim")[0] == ()
    assert linker.link("k" * 15 + "lmnop" * 3 + "lmxoq")[0] == (2,)


def test_names_without_a_telling_word_are_met_by_all_their_words():
    firsts, seconds = ["".join(c) + "er" for c in __import__("itertools").product("bdfgkl", "aou", "mn")][:14], ["Hall", "Bridge", "Quay", "Harbour", "Market", "Chapel", "Gardens", "Wharf", "Junction", "Meadow", "Orchard", "Priory", "Terrace", "Viaduct"]
    entries = [(100 * i + j, f"{a.title()} {b}", None) for i, a in enumerate(firsts) for j, b in enumerate(seconds)]
    linker = L.Linker(entries, Transducer([]), L.LinkParams(), frozenset({("before", ("the",))}))
    assert not linker.telling and len(linker.together) == 28
    first = firsts[3].title()
    for value, fits in [(f"Harbour, {first}", (303,)), (f"the Harbuor {first}", (303,)), (f"{first} Harbuor", (303,)), (f"Gardns, {first}", (306,)), (f"{first} Jct", (308,)), (f"{first} Jnctn", (308,)), ("Harbour", ()), (first, ()), (f"South {first} Harbour", ()), (f"Harbour {first} Quay", ())]:
        assert linker.link(value)[0] == fits, value


@pytest.mark.parametrize("whole", [18, 19, 20, 21, 22, 23, 24])
@pytest.mark.parametrize("change", [-3, -2, -1, 1, 2, 3])
def test_words_about_the_length_of_the_index_are_met(whole, change):
    name = "klaizakladonimortexuvwyb"[:whole]
    value = name[:5] + name[5 - change :] if change < 0 else name[:5] + "qqq"[:change] + name[5:]
    assert L.Linker([(1, name, None), (2, "Drezit", None)], Transducer([])).link(value)[0] == (1,)


def test_frames_of_any_length():
    phrase = tuple(f"w{k}x" for k in range(15))
    linker = L.Linker([(1, "Drezit", None)], Transducer([]), L.LinkParams(), frozenset({("before", phrase)}))
    assert linker.link(" ".join(phrase) + " Drezit")[0] == (1,) and linker.link(" ".join(phrase[1:]) + " Drezit")[0] == ()
    assert linker.around(" ".join(phrase) + " Drezit") == [("before", " ".join(phrase), 1)]


def test_frames_are_learnt_from_the_values(spark):
    names = ["".join(c) for c in __import__("itertools").product(("Dre", "Zor", "Kla", "Bri"), ("zit", "art", "klad", "twex", "gorn", "mip"))]
    e = spark.createDataFrame([(k, n, None) for k, n in enumerate(names)], "entity_id long, gold_answer string, gold_aliases array<string>")
    values = [x for n in names[:12] for x in (f"I guess {n}", f"{n} perhaps so")] + [f"South {names[0]}", f"South {names[1]}", f"Not {names[2]}", f"I guess {names[20]} perhaps so", names[21].lower(), f"{names[22]} nearby"]
    r = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "record_id long, parsed_answer string")
    got = {x.record_id: x.entity_id for x in L.link_records(r, e).collect()}
    assert [got[k] for k in range(24)] == [k // 2 for k in range(24)]
    assert [got[k] for k in range(24, 30)] == [None, None, None, 20, 21, None]


def test_records(spark):
    e = spark.createDataFrame([(i, "k", g, a) for i, g, a in ENTRIES + EXTRA], "entity_id long, kind string, gold_answer string, gold_aliases array<string>")
    r = spark.createDataFrame(
        [(1, "Drezit", None), (2, "drezit", None), (2, "drezit", None), (3, "O. Zorärt", "x"), (4, None, None), (5, "nothing", None), (6, "Brirtwex", "Upper Brirtwex"), (7, "Brirtwex", "Drezit"), (8, " ", None)],
        "record_id long, parsed_answer string, gold_answer string",
    )
    got = {(x.record_id, x.entity_id) for x in L.denoted(r, e).collect()}
    assert got == {(2, 6), (3, 3)}  # 6 fits two entries, whatever its own right answer
    links = {x.record_id: (x.entity_id, x.how) for x in L.link_records(r, e).collect()}
    assert links[1] == (6, "embedded") and links[5] == links[6] == (None, "unmatched") and links[7] == (None, "unmatched") and 4 not in links and links[8] == (None, "unmatched")
    empty = spark.createDataFrame([], r.schema)
    assert L.denoted(empty, e).count() == 0
    assert L.denoted(r, spark.createDataFrame([], e.schema)).count() == 0
