"""Text rules of the answer format as column expressions (no UDF on any of them).

Survey operators: STR1-STR9, STR14, MTH7.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

#: White space as Unicode knows it, with the four ASCII separators that many engines leave out.
SPACE = r"[\s\x1c-\x1f\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The 32 ASCII punctuation characters.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = ("a", "an", "the")
DECISIONS = ("answer", "uncertain")


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(col(x), f"^{SPACE}+|{SPACE}+$", "")


def normalize_answer(x) -> Column:
    """STR1: lower case, ASCII punctuation deleted, white space joined, one leading article dropped; null gives ''."""
    low = F.lower(strip(F.coalesce(col(x), F.lit(""))))
    bare = strip(F.regexp_replace(F.regexp_replace(low, PUNCTUATION, ""), f"{SPACE}+", " "))
    return F.regexp_replace(bare, f"^(?:{'|'.join(ARTICLES)})(?: |$)", "")


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def alias_set(gold, aliases) -> Column:
    """STR2: distinct normalised forms of the gold answer and its aliases, blank entries dropped."""
    entries = F.concat(F.array(col(gold)), F.coalesce(col(aliases), _no_strings()))
    kept = F.filter(entries, lambda e: e.isNotNull() & (strip(e) != ""))
    return F.array_distinct(F.transform(kept, normalize_answer))


def is_match(candidate, gold, aliases=None) -> Column:
    """STR3: the normalised candidate, unless empty, is among the alias set."""
    form = normalize_answer(candidate)
    entries = alias_set(gold, _no_strings() if aliases is None else aliases)
    return (form != "") & F.array_contains(entries, form)


def words(x) -> Column:
    """Words of the normalised form."""
    return F.filter(F.split(normalize_answer(x), " "), lambda w: w != "")


def once(values: dict[str, Column], use) -> Column:
    """use(values by name) with each value computed once a row, however often it is used inside."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), use)[0]


def token_f1(candidate, gold) -> Column:
    """STR4: F1 of the two multisets of words; 1 if both are empty, 0 if one is."""

    def count(arr, w):
        return F.size(F.filter(arr, lambda v: v == w))

    def shared(p):
        return F.aggregate(F.array_distinct(p["a"]), F.lit(0), lambda acc, w: acc + F.least(count(p["a"], w), count(p["b"], w)))

    def score(q):
        a, b, common = q["a"], q["b"], q["common"]
        precision, recall = common / a, common / b
        return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0) | (common == 0), 0.0).otherwise(2 * precision * recall / (precision + recall))

    return once({"a": words(candidate), "b": words(gold)}, lambda p: once({"a": F.size(p["a"]), "b": F.size(p["b"]), "common": shared(p)}, score))


_ITEM = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|-?\d+(?:\.\d+)?|None|True|False"


def parse_alias_field(x) -> Column:
    """STR5: a string-encoded list to an array; other text is one alias; null and blank give an empty array.

    A bracketed text is read as a list if it consists of commas and quoted strings (either
    quote, backslash escapes), numbers, None, True or False; otherwise the whole text is one alias.
    """
    text = strip(x)
    is_list = text.rlike(rf"^\[\s*(?:(?:{_ITEM})\s*(?:,\s*(?:{_ITEM})\s*)*,?\s*)?\]$")
    items = F.regexp_extract_all(text, F.lit(f"({_ITEM})"), F.lit(1))
    quoted = lambda q: F.regexp_replace(F.substring(q, F.lit(2), F.length(q) - 2), r"\\(.)", "$1")
    plain = F.transform(items, lambda q: F.when(q.rlike("^['\"]"), quoted(q)).otherwise(q))
    return F.when(col(x).isNull() | (text == ""), _no_strings()).when(is_list, plain).otherwise(F.array(text))


def _first(raw: Column, pattern: str) -> Column:
    """First group of the first hit, null without one or if it is empty."""
    return F.nullif(F.regexp_extract(raw, pattern, 1), F.lit(""))


def clamp_percent(x) -> Column:
    """MTH7: 0 to 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), x)).cast("int")


def parse_response(raw) -> Column:
    """STR6: struct(answer, decision, confidence, malformed) of the three-field response.

    The answer is the rest of the first ``Answer:`` line (white space after the colon may
    run over a line end, as the format has always allowed); the decision must fill its
    line; the confidence is clamped; malformed if answer or decision is missing. Only a
    line feed ends a line.
    """
    r = F.coalesce(col(raw), F.lit(""))
    answer = F.nullif(strip(_first(r, rf"(?d)Answer:{SPACE}*(.+)")), F.lit(""))
    decision = F.lower(_first(r, rf"(?dim)^Decision:{SPACE}*(answer|uncertain){SPACE}*$"))
    digits = _first(r, rf"(?d)Confidence:{SPACE}*(\d+)")
    confidence = clamp_percent(F.coalesce(F.try_to_number(F.substring(F.lpad(digits, 12, "0"), -12, 12), F.lit("999999999999")), F.lit(0)).cast("bigint"))
    confidence = F.when(digits.isNotNull(), F.when(F.length(F.ltrim(F.lit("0"), digits)) > 3, F.lit(100)).otherwise(confidence))
    return F.struct(answer.alias("answer"), decision.alias("decision"), confidence.alias("confidence"), (answer.isNull() | decision.isNull()).alias("malformed"))


def parse_choice(raw) -> Column:
    """STR7: 1 or 2 of the one line ``Choice: n``, null otherwise."""
    return F.nullif(F.regexp_extract(F.coalesce(col(raw), F.lit("")), rf"(?dm)^Choice:{SPACE}*([12]){SPACE}*$", 1), F.lit("")).cast("int")


def selected_source(choice, first, second) -> Column:
    """STR8: the source displayed in the chosen place."""
    return F.when(col(choice) == 1, col(first)).when(col(choice) == 2, col(second))


def render(template: str, **values) -> Column:
    """STR9: the template with its ``{name}`` places filled; values are never read for places again.

    The template is cut at its places here, on the driver, so the plan is one concat. A null value is written as the text None.
    """
    parts, last = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        parts += [F.lit(template[last : m.start()]), F.coalesce(col(values[m.group(1)]).cast("string"), F.lit("None"))]
        last = m.end()
    parts.append(F.lit(template[last:]))
    return F.concat(*parts)


def split_key(key) -> Column:
    """STR14: parts of a key joined by bars."""
    return F.split(col(key), r"\|")


def word_count(x) -> Column:
    return F.size(F.filter(F.split(strip(F.coalesce(col(x), F.lit(""))), f"{SPACE}+"), lambda w: w != ""))


def is_clean_candidate(x, most: int = 6) -> Column:
    """FLT6: a short single answer: at most six words, no comma, no 'or' or 'and' between words."""
    low = F.lower(F.coalesce(col(x), F.lit("")))
    joined = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in (",", " or ", " and ")])
    return (word_count(x) <= most) & ~joined
