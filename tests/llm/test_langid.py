import numpy as np
import pytest

from cairnstat.llm import langid as G

TEXTS = {
    "en": ["The reviewer leaves the question open. The printed register gives no date for this item.", "An unnamed visitor cites a letter, and the older copy confirms the first answer."],
    "de": ["Der Prüfer lässt die Frage offen. Das gedruckte Register nennt kein Datum für diesen Fall.", "Ein namenloser Besucher zitiert einen Brief, und die ältere Abschrift bestätigt die erste Antwort."],
    "ru": ["Рецензент оставляет вопрос открытым. Печатный реестр не содержит даты для этого случая.", "Безымянный посетитель ссылается на письмо, и старая копия подтверждает первый ответ."],
    "es": ["El revisor deja abierta la pregunta. El registro impreso no da ninguna fecha para este caso.", "Un visitante sin nombre cita una carta, y la copia antigua confirma la primera respuesta."],
}
PARAMS = G.LangParams(sample_per_language=50)


@pytest.fixture(scope="module")
def model():
    return G.train([(c, t) for c, ts in TEXTS.items() for t in ts * 3], PARAMS)


def test_labels():
    cases = {"en": "en", "EN": "en", "en-GB": "en", "eng": "en", "English": "en", "pt_BR": "pt", "Deutsch": "de", "fra": "fr", "": "", "  ": "", "und": "", None: "", "xx": "?", "Klingon": "?"}
    assert {k: G.label_code(k) for k in cases} == cases


def test_label_column_is_the_same_rule(spark):
    from pyspark.sql import functions as F

    labels = ["en", "EN", "en-GB", "eng", "English", "pt_BR", "Deutsch", "fra", "", "  ", "und", None, "xx", "Українська", "Portuguese", "Flemish (Belgium)", "DA"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in labels], "l string").select(G.label_column(F.col("l"))).collect()]
    assert got == [G.label_code(x) for x in labels]


def test_forward_sums_all_cuts(model):
    def cuts(word):
        if not word:
            return np.ones(model.prob.shape[1])
        total = np.zeros(model.prob.shape[1])
        for e in range(1, min(len(word), model.longest) + 1):
            k = model.index.get(word[:e])
            if k is not None:
                total += model.prob[k] * cuts(word[e:])
            elif e == 1:
                total += model.prob[-1] * cuts(word[1:])
        return total

    for word in ("printed", "öl", "дата", "zqx", "a"):
        assert np.allclose(model.forward(word), np.log(cuts("▁" + word)), atol=1e-9)


def test_expected_counts_are_the_posterior(model):
    counts = np.zeros_like(model.prob)
    model.expected("printed", np.ones(len(model.languages)), counts)
    letters = np.array([len(p) for p in model.index] + [1])
    assert np.allclose((counts * letters[:, None]).sum(0), len("▁printed"), atol=1e-6)


def test_sentences():
    text = 'One is. Two in vol. 3, no. 4 of it. "Three?" Four!\nFive\n\n1. Six. end'
    assert [text[s:e] for s, e in G.sentences(text)] == ["One is.", "Two in vol. 3, no. 4 of it.", '"Three?"', "Four!", "Five", "1. Six. end"]
    small = "one is here. two is there. "
    assert len(G.sentences(small)) == 2
    assert G.sentences("  \n ") == []


def test_best_path_against_all_paths():
    import itertools

    rng = np.random.default_rng(2)
    for _ in range(20):
        s = rng.normal(size=(5, 3)) * 4
        score = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(itertools.product(range(3), repeat=5), key=score)
        assert np.isclose(score(G.best_path(s, 3.0)), score(best))


def test_segments(model):
    mixed = TEXTS["en"][0] + " " + TEXTS["de"][0] + "\n\n" + TEXTS["ru"][1]
    got = G.segments(mixed, model, PARAMS)
    assert [(n, lang) for n, lang, *_ in got] == [(1, "en"), (2, "de"), (3, "ru")]
    assert all(0.5 < c <= 1 for _, _, c, *_ in got)
    quoted = 'The reviewer ("die ältere Abschrift") leaves the question open. The printed register gives no date.'
    assert [lang for _, lang, *_ in G.segments(quoted, model, PARAMS)] == ["en"]
    assert [lang for _, lang, *_ in G.segments("Teh reviewr leavs the qestion opn.", model, PARAMS)] == ["en"]
    assert G.segments("", model, PARAMS) == [] and G.segments("12 345 !!!", model, PARAMS) == []
    assert [lang for _, lang, *_ in G.segments(TEXTS["es"][0] * 3000, model, PARAMS)] == ["es"]
    assert G.segments("ж" * 100_000, model, PARAMS)[0][1] == "ru"


def test_documents(spark):
    rows = [(1000 + k * 100 + i, t, c, "x") for k, (c, ts) in enumerate(TEXTS.items()) for i, t in enumerate(ts * 5)]
    rows += [(100, TEXTS["en"][0], None, ""), (101, TEXTS["de"][1], "en", ""), (102, TEXTS["es"][0], "Spanish", ""), (103, TEXTS["en"][1] + " " + TEXTS["de"][1], "en", ""), (104, None, None, ""), (105, "", "en", ""), (101, TEXTS["de"][1], "en", "again")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, confidence string")
    got = sorted((r.doc_id, r.seg_no, r.lang) for r in G.wrong_or_mixed(d, PARAMS).collect())
    assert got == [(100, 1, "en"), (101, 1, "de"), (103, 1, "en"), (103, 2, "de")]


def test_empty(spark):
    assert G.wrong_or_mixed(spark.createDataFrame([], "doc_id long, text string, lang string"), PARAMS).count() == 0
