import unicodedata

import pytest

from cairnstat.llm import textforms as X

SAME = [
    ("Port Stostat", "Ｐｏｒｔ　Ｓｔｏｓｔａｔ"), ("Port Stostat", "Port Stostat"), ("Port Stostat", "P​ort Sto­stat"), ("Port Stostat", "Роrt Ѕtоѕtаt"), ("Zorärt", "Zorärt"), ("Zorärt", "Zora͏̈rt"),
    ("Škataitrom", "Škataitrom"), ("Saint-Klad", "Saint‑Klad"), ("Kasaid", "Kasaid"), ("first", "ﬁrﬆ"), ("Zorärt", "Zorӓrt"), ("Ångø", "Ångø"), ("ё", "ë"), ("Oskel", "Oskel "), ("", "​﻿"),
]


@pytest.mark.parametrize("a,b", SAME)
def test_look_the_same(a, b):
    t = X.Transducer()
    assert t(a) == t(b)


@pytest.mark.parametrize("a,b", [("Port", "port"), ("Zorärt", "Zorart"), ("a.b", "a b"), ("a  b", "a b"), ("l", "I"), ("0", "O"), ("x²", "x2"), ("т", "t"), ("Drezit", "Drezlt")])
def test_look_different(a, b):
    t = X.Transducer()
    assert t(a) != t(b)


def test_form_of_a_form_is_itself():
    t = X.Transducer()
    for code in [*range(0x20, 0x3100), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFFEF)]:
        if unicodedata.category(chr(code)) not in ("Cn", "Cs", "Co"):
            once = t("a" + chr(code) + "b")
            assert t(once) == once, hex(code)


def test_pair_that_joins_two_canonical_strings_is_taken_out():
    t = X.Transducer({"Corp", "Соrp", "Ort"})
    assert t.dropped and t("Corp") != t("Соrp") and t("Оrt") == "Ort" or "О" in t.dropped


def test_the_conflict_check_is_the_same_in_every_process():
    import os
    import subprocess
    import sys

    code = "from cairnstat.llm.textforms import Transducer as T; t = T(['Corp', 'Соrp', 'a\\u200bb', 'ab', 'Ort', 'Оrt', 'Xy', 'Хy', 'same']); print(sorted(t.dropped), t.unresolved, t('Хy'), t('Соrp'))"
    said = {subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=os.environ | {"PYTHONHASHSEED": str(k)}).stdout for k in range(5)}
    assert len(said) == 1
    out = said.pop()
    assert out.startswith("['О', 'С', 'Х'] [('ab', 'a")


def test_only_the_pair_that_joins_two_names_is_taken_out():
    t = X.Transducer({"Corpе", "Соrpе"})
    assert t.dropped == ["С"] and t("Соrpе") == "Сorpe" and t("Corpе") == "Corpe"


def test_other_scripts_come_from_the_confusables_table(spark):
    others = X.confusables(spark)
    assert len(others) > 50 and others.get("օ") == "o" and others.get("Ꭺ") == "A" and "α" not in others and "ı" not in others
    assert X.Transducer((), others)("Ꭺօ") == "Ao"


def test_confusables_that_cannot_be_read_are_an_error(spark, monkeypatch):
    class Asked:
        """A JVM whose checker gives these forms, or fails."""

        def __init__(self, forms):
            self._jvm = self
            self.forms = forms

        def __getattr__(self, name):
            if self.forms is None:
                raise TypeError("'JavaPackage' object is not callable")
            return lambda *_: self.forms if name == "getSkeleton" else self

    monkeypatch.setattr(X, "_found", {})
    for asked in (None, Asked(None), Asked("a\nb"), Asked("")):
        with pytest.raises(RuntimeError, match="confusables can't be read"):
            X.confusables(asked)
    assert X._found == {} and len(X.confusables(spark)) > 50


def test_disguised(spark):
    e = spark.createDataFrame([(1, "Zorärt", ["Z. Ärt"]), (2, "Drezit", None), (3, None, [None, "Гат"])], "entity_id long, gold_answer string, gold_aliases array<string>")
    r = spark.createDataFrame(
        [(1, "Drezit", None), (2, "Dr​ezit", ["Drezit"]), (3, "drezit", ["Zorärt", None]), (4, None, []), (5, "Ｄｒｅｚｉｔ", ["Ｚ．　Äｒｔ"]), (5, "Ｄｒｅｚｉｔ", ["Ｚ．　Äｒｔ"]), (6, "Zorart", ["Гaт"]), (7, "", [""]), (8, "Drezit ", None)],
        "record_id long, parsed_answer string, gold_aliases array<string>",
    )
    got = sorted((x.record_id, x.field) for x in X.disguised(r, e).collect())
    assert got == [(2, "parsed_answer"), (3, "gold_aliases"), (5, "gold_aliases"), (5, "parsed_answer"), (6, "gold_aliases"), (8, "parsed_answer")]
    assert X.disguised(spark.createDataFrame([], r.schema), e).count() == 0
    assert X.disguised(r, spark.createDataFrame([], e.schema)).count() == 0
