"""Problem 5: one form for texts that look the same.

A transducer reads a text once, grapheme cluster by grapheme cluster, and writes each
cluster's form from a table. The table is computed before any text is read: widths,
presentation ligatures, spaces, hyphens and invisible characters by rule from the Unicode
data, accents by composition. Look-alike letters of the Cyrillic and Greek scripts are a list of
pairs, only those that print can't tell apart; those of all other scripts, and small
capitals, come from the public table of confusable characters that Spark's own ICU library
holds (``confusables``). The table is checked against the canonical strings, in a fixed
order: where two different canonical strings would become one, the pair that joins them is
taken out again. Longest matches are found by one compiled pattern: runs of characters
outside ASCII with the letter before them; all else is copied as it is.

Null gives null; an empty or invisible text gives the empty text; spaces at the ends,
which can't be seen, are dropped; plain ASCII text comes out as it is but for those
spaces. What can be seen in print (case, missing accents, punctuation, spelling, several
spaces in a row) is kept. Texts of any length are read whole.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship

#: Look-alike letters: Cyrillic and Greek letters drawn as a Latin letter.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ѵ": "V", "Ӏ": "I",
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ɡ": "g", "ⅼ": "l",
}
HYPHENS = "‐‑­"
#: Invisible characters that aren't of the category Cf.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, [*range(0x180B, 0x180F), *range(0xFE00, 0xFE10)]))
#: Compatibility characters that print as what they stand for.
SAME_IN_PRINT = ("<wide>", "<narrow>", "<noBreak>")


def _char_table() -> dict[str, str]:
    """Form of each single character that isn't its own form."""
    table = {}
    for code in [*range(0x80, 0x3400), *range(0xF900, 0x10000)]:
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind == "Zs":
            table[ch] = " "
        elif kind == "Cf":
            table[ch] = ""
        elif kind in ("Cn", "Co", "Cs"):
            continue
        else:
            apart = unicodedata.decomposition(ch)
            if apart.startswith(SAME_IN_PRINT) or (apart.startswith("<compat>") and 0xFB00 <= code <= 0xFB06):
                table[ch] = unicodedata.normalize("NFKC", ch)
    table.update(dict.fromkeys(INVISIBLE, ""))
    table.update({c: "-" for c in HYPHENS if c != "­"})
    return table


_SCRIPT = regex.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{Common}\p{Inherited}]")
_RUN = regex.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")
_found: dict[str, str] = {}


def confusables(spark: SparkSession) -> dict[str, str]:
    """Letters of other scripts than Latin, Greek and Cyrillic, and Latin small capitals, that are drawn as a plain letter of the same case.

    Read from the confusables of the ICU library on Spark's class path, in one call for all
    letters. Without that library, or with an answer that isn't one form for each letter, it
    is an error: an empty table would leave disguised values out without a sign.
    """
    if _found:
        return _found
    plain = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B))]
    odd = [c for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))) if unicodedata.category(c)[0] == "L" and unicodedata.normalize("NFKC", c) == c]
    odd = [c for c in odd if unicodedata.name(c, "").startswith("LATIN LETTER SMALL CAPITAL") or not _SCRIPT.match(c)]
    try:
        # a line feed is its own skeleton, so the answers can be told apart
        checker = getattr(spark._jvm, "com.ibm.icu.text.SpoofChecker$Builder")().build()
        drawn = checker.getSkeleton("\n".join(plain + odd)).split("\n")
    except Exception as failed:  # no such class, or a connection that has no JVM
        raise RuntimeError("the confusables can't be read: no com.ibm.icu.text.SpoofChecker on Spark's class path, or no JVM to ask") from failed
    if len(drawn) != len(plain) + len(odd):
        raise RuntimeError(f"the confusables can't be read: {len(drawn)} forms for {len(plain) + len(odd)} letters")
    of, found = dict(zip(plain + odd, drawn)), {}
    for c in odd:
        same = [x for x in plain if of[x] == of[c] and x.isupper() == (c.isupper() or unicodedata.category(c) == "Lo")]
        if len(same) == 1:
            found[c] = same[0]
    if not found:
        raise RuntimeError("the confusables can't be read: no letter looks like a plain one")
    _found.update(found)
    return _found


class Transducer:
    """Reads clusters, longest first, and writes their forms. others: look-alikes beside LOOK_ALIKES."""

    def __init__(self, canonical: Iterable[str] = (), others: dict[str, str] | None = None):
        self.chars = _char_table()
        self.pairs = LOOK_ALIKES | (others or {})
        self.chars.update(self.pairs)
        self.clusters: dict[str, str] = {}
        self.dropped: list[str] = []
        self.unresolved: list[tuple[str, str]] = []  # canonical strings that differ in what can't be seen
        self._check(sorted(set(canonical)))

    def _check(self, canonical: list[str]) -> None:
        """Take out pairs of look-alikes under which different canonical strings would become one."""
        again = True
        while again:
            again, self.unresolved, groups = False, [], defaultdict(list)
            for name in canonical:
                composed = unicodedata.normalize("NFC", name)
                held = groups[self(name)]
                if composed not in held:
                    held.append(composed)
            for _, names in sorted(groups.items()):
                for a, b in zip(names, names[1:]):
                    # the first place where they differ by a pair that is still in use
                    used = lambda c: c in self.pairs and self.chars.get(c) == self.pairs[c]
                    places = zip(a, b) if len(a) == len(b) else [(c, "") for c in sorted(set(a + b))]
                    apart = [c for x, y in places if x != y for c in (x, y) if used(c)]
                    if apart:
                        del self.chars[apart[0]]
                        self.dropped.append(apart[0])
                        again = True
                        break
                    self.unresolved.append((a, b))
            self.clusters.clear()

    def _form(self, cluster: str) -> str:
        """Form of one cluster: characters by the table, then marks put on their letter in canonical order."""
        parts = unicodedata.normalize("NFD", cluster)
        out = "".join(self.chars.get(c, c) for c in parts)
        out = unicodedata.normalize("NFC", out)
        if len(out) == 1 and out in self.chars:
            out = self.chars[out]
        return out

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text.strip(" ")
        # a mark that an invisible character at the very start had cut off joins its letter
        return unicodedata.normalize("NFC", _RUN.sub(self._run, text)).strip(" ")

    def _run(self, found) -> str:
        run = found.group()
        form = self.clusters.get(run)
        if form is None:
            form = self._read(run)
            if len(self.clusters) < 200_000 and len(run) < 64:
                self.clusters[run] = form
        return form

    def _read(self, text: str) -> str:
        out, chars, i, n = [], self.chars, 0, len(text)
        while i < n:
            j = i + 1
            # the longest cluster: a character and all marks and invisible characters after it
            while j < n and (unicodedata.category(text[j]) in ("Mn", "Me") or chars.get(text[j]) == ""):
                j += 1
            out.append(text[i:j] if text[i:j].isascii() else self._form(text[i:j]))
            i = j
        return "".join(out)


def same_form(df: DataFrame, value: str, out: str, canonical: frozenset[str]) -> DataFrame:
    """df with the column ``out``, the form of the string column ``value``."""
    ship(df.sparkSession)
    others = confusables(df.sparkSession)
    checked = _checked(canonical, tuple(sorted(others.items())))

    def form(texts: pd.Series) -> pd.Series:
        own = _local(checked)
        known = {x: own(x) for x in texts.dropna().unique()}
        return texts.map(lambda x: None if x is None or x != x else known[x])

    return df.withColumn(out, F.pandas_udf(form, "string")(F.col(value)))


_tables: dict[tuple, tuple] = {}


def _checked(canonical: frozenset[str], others: tuple) -> tuple:
    """The pairs that the conflict check leaves, worked out once in the driver."""
    if (canonical, others) not in _tables:
        if len(_tables) > 4:
            _tables.clear()
        made = Transducer(canonical, dict(others))
        _tables[canonical, others] = tuple(sorted((c, x) for c, x in made.pairs.items() if c not in made.dropped)), tuple(sorted(made.dropped))
    return _tables[canonical, others]


_locals: dict[tuple, Transducer] = {}


def _local(checked: tuple) -> Transducer:
    """In a worker: the table with the driver's outcome of the conflict check."""
    if checked not in _locals:
        _locals.clear()
        pairs, dropped = checked
        made = Transducer((), dict(pairs))
        for c in dropped:
            made.chars.pop(c, None)
        _locals[checked] = made
    return _locals[checked]


def canonical_strings(entities: DataFrame, max_names: int = 500_000) -> frozenset[str]:
    """gold_answer and all gold_aliases, on the driver; the bound is checked."""
    names = entities.select(F.explode(F.array_union(F.array("gold_answer"), F.coalesce("gold_aliases", F.array().cast("array<string>")))).alias("name")).where("name is not null").distinct()
    got = names.limit(max_names + 1).collect()
    if len(got) > max_names:
        raise ValueError(f"more than {max_names} canonical strings")
    return frozenset(r["name"] for r in got)


def disguised(records: DataFrame, entities: DataFrame) -> DataFrame:
    """record_id, field: values that look like a canonical string but equal none of them.

    field is 'parsed_answer', or 'gold_aliases' where at least one element is such a value.
    Null values and null elements are no case; a record delivered twice comes out once.
    """
    spark = records.sparkSession
    canonical = canonical_strings(entities)
    names = spark.createDataFrame([(x,) for x in sorted(canonical)], "name string")
    forms = same_form(names, "name", "name_form", canonical).select("name_form").distinct()
    values = records.select(
        "record_id",
        F.explode(
            F.array_append(
                F.transform(F.coalesce("gold_aliases", F.array().cast("array<string>")), lambda x: F.struct(F.lit("gold_aliases").alias("field"), x.alias("value"))),
                F.struct(F.lit("parsed_answer").alias("field"), F.col("parsed_answer").alias("value")),
            )
        ).alias("v"),
    ).select("record_id", "v.field", "v.value")
    odd = values.where("value is not null").join(names.withColumnRenamed("name", "value"), "value", "left_anti")
    # of an ASCII value the form is known without the transducer
    ascii_only = ~F.col("value").rlike(r"[^\x00-\x7F]")
    plain = odd.where(ascii_only).withColumn("name_form", F.trim("value"))
    other = same_form(odd.where(~ascii_only), "value", "name_form", canonical)
    return plain.unionByName(other).join(forms, "name_form", "left_semi").select("record_id", "field").distinct()
