"""Problem 3: freely written values mapped to the entries of a canonical list.

Values are reduced to the distinct ones, brought to one form (:mod:`textforms`), folded
(case, accents) and cut into tokens. An Aho-Corasick automaton over all names and aliases
finds embedded mentions, the longest non-overlapping ones, wherever they stand. What stands
around a mention counts for nothing if it is a *frame*: a phrase before or after mentions
that the values themselves have with at least ``frame_entities`` different entries and
``frame_share`` of the list, without words of these entries' names; any other word tells
that something else is meant. Frames are learnt in a first pass over all distinct values,
so no list of words is needed, and a compass word or a negation before a name is no frame
unless the values use it with names of all kinds. What remains goes to token-set
similarity: every telling word of an entry must be met, exactly or within a bounded number
of edits, and every word of the value must belong to the entry, as a whole word, an
initial, a shortened word (its letters in order, the first one in place), a particle (a
word that the list writes small inside its names) or in a frame.
A name whose words all belong to many entries has no telling word; its words tell together,
so each of them must be met, at least one not only by an initial or a shortened word.
Candidates come from an index of the entry's words with up to three letters left out, so no
value is compared with all entries; words too long for that index meet the entry's words of
about their length. Names without a telling word are counted by their words that are met.

A value that fits several entries equally well is reported as unmatched. Null values have
no match and no row; blank values, and values of frames only, are unmatched. The list is
broadcast; its size is checked.
"""

from __future__ import annotations

import functools
import unicodedata
import uuid
from collections import Counter, defaultdict
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, ship
from .textforms import Transducer

_FOLDS = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ŧ": "t", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d"})
_TOKEN = regex.compile(r"[\p{L}\p{N}]+")
OPEN, CLOSE = "\x01", "\x02"


@dataclass(frozen=True)
class LinkParams:
    common_names: int = 12  # a word of that many entries doesn't tell one from another
    long_word: int = 7  # from this length on two edits are allowed, else one from four letters on
    three_edits: int = 10  # from this length on three edits, if every other word of the value is met exactly
    index_word: int = 20  # longer words aren't indexed with letters left out
    frame_entities: int = 5
    frame_share: float = 0.005
    max_frames: int = 100_000
    max_entities: int = 200_000


def fold(text: str, form: Transducer, lower_first: bool = False) -> str:
    """Form, lower case, no accents. A letter may have a look-alike in one case only, so both orders are needed."""
    text = form(text.lower()) if lower_first else form(text).lower()
    text = text.translate(_FOLDS)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text


def tokens(text: str, form: Transducer, lower_first: bool = False) -> list[str]:
    return _TOKEN.findall(fold(text, form, lower_first).replace("'", "").replace("’", ""))


def edits(a: str, b: str, most: int) -> int:
    """Edits from a to b (insert, delete, change, swap neighbours, one after another), most + 1 if there are more.

    Letters that a deletion made neighbours may be swapped, so the swap reaches back to the
    last place where the two letters stood the other way round.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    big, n = len(a) + len(b), len(b)
    table = [[big] * (n + 2), [big, *range(n + 1)]]
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        row, last = [big, i], 0
        above = table[i]
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), last
            cost = 1
            if x == y:
                cost, last = 0, j
            row.append(min(above[j] + cost, row[j] + 1, above[j + 1] + 1, table[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        table.append(row)
        seen[x] = i
    return min(table[-1][-1], most + 1)


def _shortened(word: str, most: int) -> set[str]:
    out, last = {word}, {word}
    for _ in range(most):
        last = {w[:k] + w[k + 1 :] for w in last for k in range(len(w))}
        out |= last
    return out


def shortens(word: str, whole: str) -> bool:
    """Whether the word is the whole one with letters left out behind the first: two at least, or all but one of the others."""
    if not 2 <= len(word) < len(whole) or word[0] != whole[0]:
        return False
    rest = iter(whole)
    return all(c in rest for c in word)


class Near:
    """Words by the words within a number of edits. most: of each word."""

    def __init__(self, words, most, params: LinkParams):
        self.words, self.most, self.p = words, most, params
        self.left_out: dict[str, set[str]] = defaultdict(set)
        self.long: dict[int, list[str]] = defaultdict(list)
        for w in words:
            if len(w) > params.index_word:
                self.long[len(w)].append(w)
            else:
                for s in _shortened(w, most(w)):
                    self.left_out[s].add(w)

    def __call__(self, word: str) -> dict[str, int]:
        if word in self.words:
            return {word: 0}
        p, near = self.p, {}
        met = {t for k in range(len(word) - 3, len(word) + 4) for t in self.long.get(k, ())}
        if len(word) <= p.index_word:
            most = 3 if len(word) >= p.three_edits - 3 else 2 if len(word) >= p.long_word - 1 else 0 if len(word) < 4 else 1
            met |= {t for s in _shortened(word, most) for t in self.left_out.get(s, ())}
        else:
            met |= {t for k in range(len(word) - 3, p.index_word + 1) for t in self.short_ends.get(k, ())}
        for t in met:
            d = edits(word, t, 3)
            if d <= self.most(t):
                near[t] = d
        return near

    @functools.cached_property
    def short_ends(self) -> dict[int, list[str]]:
        """The longest of the words that are indexed, by length."""
        out = defaultdict(list)
        for w in self.words:
            if self.p.index_word - 3 < len(w) <= self.p.index_word:
                out[len(w)].append(w)
        return out


class Linker:
    """The canonical list compiled for lookup. frames: (side, phrase) of phrases before or after a mention that tell nothing."""

    def __init__(self, entries: list[tuple], form: Transducer, params: LinkParams = LinkParams(), frames: frozenset[tuple[str, tuple[str, ...]]] = frozenset()):
        self.form, self.p, self.frames = form, params, frames
        self.frame_words = {w for _, phrase in frames for w in phrase}
        self.longest = max((len(phrase) for _, phrase in frames), default=0)
        self.names: list[tuple[int, tuple[str, ...]]] = []
        seen = set()
        self.own: dict[int, set[str]] = defaultdict(set)
        for entity_id, gold, aliases in entries:
            for name in [gold, *(aliases or [])]:
                for lower_first in (False, True):
                    words = tuple(tokens(name or "", form, lower_first))
                    self.own[entity_id].update(words)
                    if words and (entity_id, words) not in seen:
                        seen.add((entity_id, words))
                        self.names.append((entity_id, words))
        holders = defaultdict(set)
        for entity_id, words in self.names:
            for w in set(words):
                holders[w].add(entity_id)
        # a word of many entries, and any single letter, tells little
        self.common = {w for w, ids in holders.items() if len(ids) >= params.common_names or len(w) == 1}
        # particles: what the list writes in small letters between the words of capitalised names
        joined = defaultdict(set)
        for entity_id, gold, aliases in entries:
            for name in [gold, *(aliases or [])]:
                raw = _TOKEN.findall(form(name or ""))
                if raw and not raw[0].islower():
                    for w in raw[1:-1]:
                        if w.islower() and len(w) > 1:
                            joined[fold(w, form)].add(entity_id)
        self.particles = {w for w, ids in joined.items() if len(ids) >= params.common_names}
        self.telling: dict[str, list[int]] = defaultdict(list)
        for k, (_, words) in enumerate(self.names):
            for w in set(words) - self.common:
                self.telling[w].append(k)
        # names without a telling word, by each of their words
        self.together: dict[str, list[int]] = defaultdict(list)
        for k, (_, words) in enumerate(self.names):
            if self.common.issuperset(words):
                for w in set(words):
                    self.together[w].append(k)
        self.near = Near(self.telling, self._most, params)
        self.near_together = Near(self.together, self._allowed, params)
        exact = defaultdict(set)
        for entity_id, words in self.names:
            exact[self._key(words)].add(entity_id)
        self.automaton = ahocorasick.Automaton()
        for key, ids in exact.items():
            self.automaton.add_word(key, (key.count(CLOSE), tuple(sorted(ids))))
        if exact:
            self.automaton.make_automaton()
        self.empty = not exact
        self.memo: dict[tuple, tuple] = {}

    @staticmethod
    def _key(words) -> str:
        return "".join(OPEN + w + CLOSE for w in words)

    def _allowed(self, word: str) -> int:
        return 0 if len(word) < 4 else 1 if len(word) < self.p.long_word else 2

    def _most(self, word: str) -> int:
        return 3 if len(word) >= self.p.three_edits else self._allowed(word)

    def _framed(self, words: tuple[str, ...], side: str) -> bool:
        """Whether the words are frames of that side, one after another."""
        reached = [True] + [False] * len(words)
        for e in range(1, len(words) + 1):
            reached[e] = any(reached[b] and (side, words[b:e]) in self.frames for b in range(max(0, e - self.longest), e))
        return reached[-1]

    def _mentions(self, words: tuple[str, ...]) -> list[tuple[int, int, tuple[int, ...]]]:
        """(first word, word after the last, entries) of the longest mentions that don't overlap, in order."""
        ends = np.cumsum([len(w) + 2 for w in words]) - 1
        out = []
        for at, (size, ids) in self.automaton.iter_long(self._key(words)):
            last = int(np.searchsorted(ends, at)) + 1
            out.append((last - size, last, ids))
        return out

    def around(self, value: str) -> list[tuple[str, str, int]]:
        """(side, phrase, entry) of what stands before and after the one mention in a value."""
        words = tuple(tokens(value, self.form))
        if self.empty or not words:
            return []
        found = self._mentions(words)
        if len(found) != 1 or len(found[0][2]) != 1:
            return []
        first, last, (entity_id,) = found[0]
        sides = (("before", words[:first]), ("after", words[last:]))
        return [(side, " ".join(x), entity_id) for side, x in sides if x and not self.own[entity_id].intersection(x)]

    def link(self, value: str) -> tuple[tuple[int, ...], str]:
        """(entities that fit best, how): how is embedded, similar or unmatched."""
        for lower_first in (False, True):
            found = self._link(tuple(tokens(value, self.form, lower_first)))
            if found[0] or value.isascii():
                break
        return found

    def _link(self, words: tuple[str, ...]) -> tuple[tuple[int, ...], str]:
        if self.empty or not words:
            return (), "unmatched"
        found = self.memo.get(words)
        if found is None:
            found = self._embedded(words) or self._similar(words) or ((), "unmatched")
            if len(self.memo) < 500_000:
                self.memo[words] = found
        return found

    def _embedded(self, words):
        hits = self._mentions(words)
        if not hits or any(a[1] != b[0] for a, b in zip(hits, hits[1:])):
            return None
        if not (self._framed(words[: hits[0][0]], "before") and self._framed(words[hits[-1][1] :], "after")):
            return None
        ids = set(hits[0][2]).intersection(*[h[2] for h in hits[1:]])
        return (tuple(sorted(ids)), "embedded") if ids else ((), "unmatched")

    def _met_together(self, words) -> list[int]:
        """Names without a telling word all of whose words may be met."""
        met: Counter[int] = Counter()
        reached = {t for w in set(words) if w in self.together or w not in self.frame_words for t in self.near_together(w)}
        for t in reached:
            met.update(self.together[t])
        # what else meets a word: initials, and shortened words
        spare = [w for w in set(words) if len(w) == 1 or (w not in self.together and w not in self.telling)]
        out = []
        for k, number in met.items():
            own = set(self.names[k][1])
            if len(own) - number <= len(spare) and all(any(v == t[0] if len(v) == 1 else shortens(v, t) for v in spare) for t in own - reached):
                out.append(k)
        return out

    def _similar(self, words):
        candidates = set()
        for w in set(words):
            if w in self.common or (w in self.frame_words and w not in self.telling):
                continue
            for t in self.near(w):
                candidates.update(self.telling[t])
        if self.together:
            candidates.update(self._met_together(words))
        best, ids = None, set()
        for k in candidates:
            entity_id, name = self.names[k]
            cost = self._cost(words, name, entity_id)
            if cost is None:
                continue
            if best is None or cost < best:
                best, ids = cost, {entity_id}
            elif cost == best:
                ids.add(entity_id)
        return (tuple(sorted(ids)), "similar") if ids else None

    def _cost(self, words, name, entity_id):
        """(edits, words of the entry not met) if the value fits the entry, else None."""
        left, total, worst, open_at = list(name), 0, 0, []
        for i, w in enumerate(words):
            if w in left:
                left.remove(w)
            else:
                open_at.append(i)
        for i in list(open_at):
            w = words[i]
            if len(w) == 1:
                # an initial stands for a word that isn't a telling one, or for one of the entry's own initials
                t = next((t for t in left if t[0] == w and (len(t) == 1 or t in self.common)), None)
            else:
                t = next((t for t in left if t in self.common and shortens(w, t)), None) if w not in self.telling else None
            if t:
                left.remove(t)
                open_at.remove(i)
        for i in sorted(open_at, key=lambda i: -len(words[i])):
            w = words[i]
            options = [(edits(w, t, 3), t) for t in left if len(t) > 1 and len(w) > 1 and abs(len(t) - len(w)) <= 3]
            d, t = min(options, default=(9, ""))
            allowed = self._most(t) if t not in self.common else (1 if len(t) >= 4 else 0) + (1 if len(t) >= 7 else 0)
            if d <= allowed and not (w in self.frame_words and d > 0):
                left.remove(t)
                open_at.remove(i)
                total += d
                worst = max(worst, d)
        # joined or split words: nothing telling may be left of the entry
        if any(t not in self.common for t in left) or len(name) == len(left) or (left and self.common.issuperset(name)):
            return None
        if worst > 2 and total > worst or total > 3:
            return None
        # what the entry doesn't account for must be frames, or particles and words of its other names
        own = self.own[entity_id] | self.particles
        met = [i for i in range(len(words)) if i not in open_at]
        inner = [i for i in open_at if met[0] < i < met[-1]]
        if any(words[i] not in own for i in inner):
            return None
        before, after = (tuple(words[i] for i in open_at if (i < met[0] if first else i > met[-1]) and words[i] not in own) for first in (True, False))
        if not (self._framed(before, "before") and self._framed(after, "after")):
            return None
        return (total, sum(1 for t in left if len(t) > 1), len(left))


def _entries(entities: DataFrame, most: int) -> list[tuple]:
    got = entities.select("entity_id", "gold_answer", "gold_aliases").where("entity_id is not null").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} entries; link against parts of the list")
    return sorted((r["entity_id"], r["gold_answer"], tuple(r["gold_aliases"] or ())) for r in got)


_compiled: dict = {}


def _linker(key: str, entries: tuple, params: LinkParams, frames: frozenset) -> Linker:
    """The compiled list, one for each process."""
    if key not in _compiled:
        _compiled.clear()
        names = {n for _, gold, aliases in entries for n in (gold, *aliases) if n}
        _compiled[key] = Linker(list(entries), Transducer(names), params, frames)
    return _compiled[key]


def link_values(values: DataFrame, value: str, entities: DataFrame, params: LinkParams = LinkParams()) -> DataFrame:
    """value, fits array<bigint>, how: for each distinct non-null value the entries that fit best."""
    spark = values.sparkSession
    ship(spark)
    entries = tuple(_entries(entities, params.max_entities))
    # the values are few bytes but much work each: spread them over the cluster, whatever their size says
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    distinct = materialize(values.select(F.col(value).alias("value")).where("value is not null").distinct().repartition(tasks), "values")

    listed, own = spark.sparkContext.broadcast(entries), uuid.uuid4().hex

    def around(batches):
        linker = _linker(own, listed.value, params, frozenset())
        for b in batches:
            yield pd.DataFrame([x for v in b["value"] for x in linker.around(v)], columns=["side", "phrase", "entity"])

    least = max(params.frame_entities, int(params.frame_share * len(entries)))
    met = distinct.mapInPandas(around, "side string, phrase string, entity bigint").distinct().groupBy("side", "phrase").count().where(F.col("count") >= least)
    got = met.limit(params.max_frames + 1).collect()
    if len(got) > params.max_frames:
        raise ValueError(f"more than {params.max_frames} frames")
    handed = spark.sparkContext.broadcast((entries, frozenset((r["side"], tuple(r["phrase"].split(" "))) for r in got)))
    key = uuid.uuid4().hex

    def run(batches):
        entries, frames = handed.value
        linker = _linker(key, entries, params, frames)
        for b in batches:
            got = [linker.link(v) for v in b["value"]]
            yield pd.DataFrame({"value": b["value"], "fits": [list(ids) for ids, _ in got], "how": [how for _, how in got]})

    # by the number of files the values would be read in fewer tasks
    return distinct.repartition(tasks).mapInPandas(run, "value string, fits array<bigint>, how string")


def link_records(records: DataFrame, entities: DataFrame, params: LinkParams = LinkParams()) -> DataFrame:
    """record_id, parsed_answer, entity_id, how: one row for each record and answer; entity_id null where unmatched."""
    rows = records.where("parsed_answer is not null").select("record_id", F.col("parsed_answer").alias("value")).dropDuplicates()
    fits = link_values(rows, "value", entities, params)
    one = F.size("fits") == 1
    return rows.join(fits, "value").select("record_id", F.col("value").alias("parsed_answer"), F.when(one, F.col("fits")[0]).alias("entity_id"), F.when(one, F.col("how")).otherwise(F.lit("unmatched")).alias("how"))


def denoted(records: DataFrame, entities: DataFrame, params: LinkParams = LinkParams()) -> DataFrame:
    """record_id, entity_id of answers that denote an entry but aren't written as one is."""
    gold = entities.select(F.col("gold_answer").alias("parsed_answer")).where("parsed_answer is not null").distinct()
    odd = records.where("parsed_answer is not null").join(gold, "parsed_answer", "left_anti")
    return link_records(odd, entities, params).where("entity_id is not null").select("record_id", "entity_id").distinct()
