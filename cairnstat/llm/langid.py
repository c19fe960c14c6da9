"""Problem 8: the language of each document and of each part in another language.

A language is a unigram model over the pieces of a fixed public vocabulary. A word's
probability under it is the sum over all ways to cut the word into pieces, found by a
forward pass over the word, so neither a typing error nor a poor scan, which forces an
unusual cut, throws the score off. The piece probabilities are trained here by expectation
maximisation (forward-backward expected counts) on a bounded sample of labelled documents;
labels that the model disagrees with are put right sentence by sentence and the model is
trained again. A document is cut into sentences; each sentence's score under each language
is the sum over its words; the languages of the sentences are the best path that pays for
each change of language. A segment is a run of sentences of one language.

The words of a text are scored once per worker (bounded memory); texts are read whole.
Null texts and texts without a letter have no segment. Unknown characters cost the same in
every language. Ties go to the language that comes first in LANGUAGES.
"""

from __future__ import annotations

import base64
import pickle
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F, Window as W

from ..session import materialize, ship

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "sv", "da", "ru", "uk")
#: Other ways to name each language (ISO 639-2 and 639-3 codes, English and own names).
NAMES = {
    "en": "eng english", "de": "deu ger german deutsch", "fr": "fra fre french français francais", "es": "spa spanish español espanol castilian castellano",
    "pt": "por portuguese português portugues", "it": "ita italian italiano", "nl": "nld dut dutch nederlands flemish vlaams",
    "sv": "swe swedish svenska", "da": "dan danish dansk", "ru": "rus russian русский", "uk": "ukr ukrainian українська",
}
BLANK_LABELS = ("", "und", "undetermined", "unknown", "mis", "mul", "zxx", "none", "null", "n/a", "?", "-")

MOST_LETTERS = 64  # a longer run of letters isn't counted in training; it is scored whole
WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
_END = regex.compile(r"(?<=[.!?…。][\"'”’»)\]]{0,3})\s+(?=[\"'“‘«(\[¿¡]{0,2}[\p{Lu}\p{Lt}\d])|\n+")
_END_SMALL = regex.compile(r"(?<=[.!?…。][\"'”’»)\]]{0,3})\s+(?=[\"'“‘«(\[¿¡]{0,2}[\p{L}\d])|\n+")
_NO_END = regex.compile(r"(?:(?:^|[\s(\"])(?:vol|no|nos|nr|n|bd|vol|pp|p|s|t|dr|st|mr|mrs|ca|cf|z\.B|bzw|e\.g|i\.e|\p{Lu})|(?:^|[\s\"(])\d{1,3})\.$", regex.IGNORECASE)
_QUOTED = regex.compile(r"\(?[\"“„«”]([^\"“”„«»]{1,80})[\"”“»]\)?")


@dataclass(frozen=True)
class LangParams:
    vocabulary: str = VOCABULARY
    sample_per_language: int = 250  # labelled documents a language that the model is fitted on
    sample_chars: int = 20_000  # longest text taken into that sample
    rounds: int = 3  # of expectation maximisation, each time it is trained
    switch: float = 8.0  # cost of a change of language, in nats
    quoted_words: int = 8  # longest quotation inside a sentence that is left out of its score
    temper: float = 0.25  # words of a text aren't independent: weight of a nat in the confidence
    memory: int = 300_000  # words kept by a worker


def label_code(label) -> str | None:
    """The two-letter code a label names, '' for a missing label, '?' for one that names none of LANGUAGES."""
    if label is None or label != label:
        return ""
    text = str(label).strip().lower()
    if text in BLANK_LABELS:
        return ""
    for part in (text, regex.split(r"[-_ ()]", text)[0]):
        if part in LANGUAGES:
            return part
        for code, names in NAMES.items():
            if part in names.split():
                return code
    return "?"


def label_column(column):
    """label_code as a column expression."""
    text = F.lower(F.trim(column))
    first = F.regexp_extract(text, "^([^-_ ()]*)", 1)
    named = F.lit(None).cast("string")
    for code, names in NAMES.items():
        words = [code, *names.split()]
        named = F.coalesce(named, F.when(text.isin(*words) | first.isin(*words), F.lit(code)))
    return F.when(column.isNull() | text.isin(*BLANK_LABELS), F.lit("")).otherwise(F.coalesce(named, F.lit("?")))


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence; abbreviations and enumerators end none. In a text written in small letters any word may begin one."""
    out, start = [], 0
    small = sum(map(str.isupper, text)) * 200 < len(text)
    for m in (_END_SMALL if small else _END).finditer(text):
        if "\n" not in m.group() and _NO_END.search(text[max(start, m.start() - 12) : m.start()]):
            continue
        if text[start : m.start()].strip():
            out.append((start, m.start()))
            start = m.end()
        elif not out:
            start = m.end()
    if text[start:].strip():
        out.append((start, len(text)))
    return out


class PieceModel:
    """Per-language unigram probabilities of pieces; words are scored over all their cuts."""

    def __init__(self, pieces: list[str], prob: np.ndarray, languages=LANGUAGES, memory: int = 300_000):
        self.languages, self.memory = languages, memory
        self.index = {p: k for k, p in enumerate(pieces)}
        self.prob = prob  # pieces x languages; the last row is an unknown character
        self.longest = max((len(p) for p in pieces), default=1)
        self.cache: dict[str, int] = {}
        self.scores = np.zeros((1024, prob.shape[1]))

    def spans(self, word: str) -> list[list[tuple[int, int]]]:
        """For each end, the (start, piece) of every piece that ends there; -1 is an unknown character."""
        n, get = len(word), self.index.get
        out = []
        for e in range(1, n + 1):
            at = [(s, k) for s in range(max(0, e - self.longest), e) if (k := get(word[s:e])) is not None]
            if not any(s == e - 1 for s, _ in at):
                at.append((e - 1, -1))
            out.append(at)
        return out

    def forward(self, word: str) -> np.ndarray:
        """Log probability of the word under each language, all cuts summed."""
        word = "▁" + word
        alpha = np.zeros((len(word) + 1, self.prob.shape[1]))
        alpha[0] = 1.0
        scale = np.zeros(self.prob.shape[1])
        for e, at in enumerate(self.spans(word), 1):
            if len(at) == 1:
                s, k = at[0]
                alpha[e] = alpha[s] * self.prob[k]
            else:
                alpha[e] = (alpha[[s for s, _ in at]] * self.prob[[k for _, k in at]]).sum(0)
            if e % 24 == 0:  # long words would underflow
                top = np.maximum(alpha[max(0, e - self.longest) : e + 1].max(0), 1e-300)
                alpha[max(0, e - self.longest) : e + 1] /= top
                scale += np.log(top)
        return np.log(np.maximum(alpha[-1], 1e-300)) + scale

    def table(self, words: list[str]) -> np.ndarray:
        """Scores of each word under each language, words x languages."""
        cache = self.cache
        if len(cache) > self.memory:
            cache.clear()
        known = list(map(cache.get, words))
        if None in known:
            for i, k in enumerate(known):
                if k is None:
                    w = words[i]
                    k = cache.get(w)
                    if k is None:
                        k = cache[w] = len(cache)
                        if k >= len(self.scores):
                            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                        self.scores[k] = self.forward(w)
                    known[i] = k
        return self.scores[known]

    def lattice(self, word: str) -> tuple:
        """Starts, ends and pieces of all spans of the word, in order of their ends, and the spans of each start and end."""
        spans = [(s, e, k) for e, at in enumerate(self.spans("▁" + word), 1) for s, k in at]
        start, end, piece = np.array(spans, dtype=np.int64).T
        n = len(word) + 1
        return start, end, piece, [np.flatnonzero(end == e) for e in range(n + 1)], [np.flatnonzero(start == s) for s in range(n + 1)]

    def expected(self, word: str, weight: np.ndarray, counts: np.ndarray, lattice: tuple | None = None) -> None:
        """Add the expected number of each piece in the word, times the weight of each language."""
        start, end, piece, by_end, by_start = lattice or self.lattice(word)
        n = len(word) + 1
        prob = self.prob[piece]
        alpha, beta = np.zeros((n + 1, len(weight))), np.zeros((n + 1, len(weight)))
        alpha[0], beta[n] = 1.0, 1.0
        for e in range(1, n + 1):
            at = by_end[e]
            alpha[e] = (alpha[start[at]] * prob[at]).sum(0)
        for s in range(n - 1, -1, -1):
            at = by_start[s]
            if len(at):
                beta[s] = (beta[end[at]] * prob[at]).sum(0)
        np.add.at(counts, piece, alpha[start] * prob * beta[end] * (weight / np.maximum(alpha[n], 1e-300)))

    def sentence_scores(self, text: str, params: LangParams) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        """Spans of the sentences, their scores under each language, and their numbers of words."""
        spans = sentences(text)
        words, lengths = [], []
        for s, e in spans:
            own = WORD.findall(_unquoted(text[s:e], params).lower())
            words += own
            lengths.append(len(own))
        lengths = np.array(lengths, dtype=np.int64)
        if not words:
            return spans, np.zeros((len(spans), len(self.languages))), lengths
        table = self.table(words)
        total = np.concatenate([np.zeros((1, table.shape[1])), np.cumsum(table, axis=0)])
        ends = np.cumsum(lengths)
        return spans, total[ends] - total[ends - lengths], lengths


def _unquoted(part: str, params: LangParams) -> str:
    """The sentence without short quotations, unless too little would be left."""
    if not any(q in part for q in "\"“„«”"):
        return part
    bare = _QUOTED.sub(lambda m: " " if len(m.group(1).split()) <= params.quoted_words else m.group(), part)
    return bare if len(WORD.findall(bare)) >= 3 else part


def best_path(scores: np.ndarray, switch: float) -> np.ndarray:
    """Language of each sentence: the path of the highest score that pays ``switch`` for each change."""
    n, m = scores.shape
    back = np.zeros((n, m), dtype=np.int64)
    best = scores[0].copy()
    for i in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - switch
        back[i] = np.where(stay, np.arange(m), top)
        best = np.where(stay, best, best[top] - switch) + scores[i]
    path = np.zeros(n, dtype=np.int64)
    path[-1] = int(best.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def segments(text: str, model: PieceModel, params: LangParams) -> list[tuple[int, str, float, int, int, int]]:
    """(seg_no, lang, confidence, start, end, words) of each run of sentences of one language."""
    spans, scores, words = model.sentence_scores(text, params)
    if not spans or not words.sum():
        return []
    path = best_path(scores, params.switch)
    out, first = [], 0
    for i in range(1, len(spans) + 1):
        if i < len(spans) and path[i] == path[first]:
            continue
        total = scores[first:i].sum(0) * params.temper
        total -= total.max()
        share = np.exp(total)
        out.append((len(out) + 1, model.languages[path[first]], float(share[path[first]] / share.sum()), spans[first][0], spans[i - 1][1], int(words[first:i].sum())))
        first = i
    return out


def _vocabulary(path: str) -> list[str]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(k).lower() for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))}
    return sorted(p for p in pieces if p)


def train(labelled: list[tuple[str, str]], params: LangParams = LangParams()) -> PieceModel:
    """Fit the piece probabilities to (code, text) pairs, correct their labels by sentence, and fit again."""
    pieces = _vocabulary(params.vocabulary)
    n, m = len(pieces), len(LANGUAGES)
    # first guess: a longer piece is as likely as any other, an unknown character is rare
    prob = np.full((n + 1, m), 1.0 / n)
    prob[n] = 1e-7
    model = PieceModel(pieces, prob, memory=params.memory)
    split = [(code, [WORD.findall(_unquoted(text[s:e], params).lower()) for s, e in sentences(text)]) for code, text in labelled]
    counted = _count([(code, s) for code, parts in split for s in parts])
    lattices: dict[str, tuple] = {}
    for again in range(2):
        for _ in range(params.rounds):
            model = _step(model, counted, params, lattices)
        if again:
            break
        # sentences that the first model gives another language are counted under that one
        fixed = []
        for code, parts in split:
            parts = [p for p in parts if p]
            if not parts:
                continue
            table = np.array([_sum(model, p) for p in parts])
            for p, k in zip(parts, best_path(table, params.switch)):
                fixed.append((LANGUAGES[k], p))
        counted = _count(fixed)
    return model


def _sum(model: PieceModel, words: list[str]) -> np.ndarray:
    return model.table(words).sum(0)


def _count(parts: list[tuple[str, list[str]]]) -> dict[str, np.ndarray]:
    at = {code: k for k, code in enumerate(LANGUAGES)}
    counted: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGUAGES)))
    for code, words in parts:
        for w in words:
            counted[w][at[code]] += 1
    return counted


def _step(model: PieceModel, counted: dict[str, np.ndarray], params: LangParams, lattices: dict[str, tuple]) -> PieceModel:
    """One round: expected counts, smoothed with the pieces' share over all languages."""
    n = len(model.prob)
    counts = np.zeros_like(model.prob)
    for word, weight in counted.items():
        if len(word) > MOST_LETTERS:  # no word of a language
            continue
        lattice = lattices.get(word)
        if lattice is None:
            lattice = lattices[word] = model.lattice(word)
        model.expected(word, weight, counts, lattice)
    totals = counts.sum(0)
    shares = counts / np.maximum(totals, 1.0)
    overall = shares.sum(1, keepdims=True) / max(1, (totals > 0).sum())
    prob = 0.97 * shares + 0.02 * overall + 0.01 / n
    prob[:, totals == 0] = 1e-9
    prob[-1] = 1e-7
    return PieceModel(list(model.index), prob, memory=params.memory)


def fit(documents: DataFrame, params: LangParams = LangParams()) -> PieceModel:
    """A model fitted to at most sample_per_language labelled documents of each language.

    The sample is chosen by a hash of the id among labelled texts of at most sample_chars
    characters; it is the only part of the data that is bounded.
    """
    coded = documents.select("doc_id", label_column(F.col("lang")).alias("code"), F.length("text").alias("n")).where(F.col("code").isin(*LANGUAGES) & (F.col("n") > 40) & (F.col("n") <= params.sample_chars))
    order = W.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = coded.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= params.sample_per_language).select("doc_id", "code")
    got = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").select("doc_id", "code", "text").dropDuplicates(["doc_id"]).collect()
    return train([(r["code"], r["text"]) for r in sorted(got, key=lambda r: (str(r["doc_id"])))], params)


SEGMENTS = "doc_id bigint, seg_no int, lang string, confidence double, seg_start int, seg_end int, words int"
_models: dict[str, PieceModel] = {}


def detect(documents: DataFrame, model: PieceModel, params: LangParams = LangParams()) -> DataFrame:
    """doc_id, seg_no, lang, confidence, seg_start, seg_end (code points), words: every segment of every document."""
    ship(documents.sparkSession)
    packed = documents.sparkSession.sparkContext.broadcast(pickle.dumps((list(model.index), model.prob.astype(np.float32)), protocol=5))
    key = base64.b16encode(np.random.default_rng().bytes(8)).decode()

    def run(batches):
        if key not in _models:
            _models.clear()
            pieces, prob = pickle.loads(packed.value)
            _models[key] = PieceModel(pieces, prob.astype(float), memory=params.memory)
        own = _models[key]
        for b in batches:
            rows = [(i, *s) for i, text in zip(b["doc_id"], b["text"]) if text for s in segments(text, own, params)]
            yield pd.DataFrame(rows, columns=["doc_id", "seg_no", "lang", "confidence", "seg_start", "seg_end", "words"])

    return documents.select("doc_id", "text").where("text is not null and doc_id is not null").mapInPandas(run, SEGMENTS)


def wrong_or_mixed(documents: DataFrame, params: LangParams = LangParams()) -> DataFrame:
    """doc_id, seg_no, lang of documents whose label is missing or wrong, or that are in several languages."""
    found = materialize(detect(documents, fit(documents, params), params).select("doc_id", "seg_no", "lang"), "segments")
    labels = documents.select("doc_id", label_column(F.col("lang")).alias("code"))
    first = found.groupBy("doc_id").agg(F.max("seg_no").alias("segments"), F.min_by("lang", "seg_no").alias("first"))
    cases = labels.join(first, "doc_id").where((F.col("segments") > 1) | (F.col("code") != F.col("first"))).select("doc_id").distinct()
    return found.join(cases, "doc_id", "left_semi").select("doc_id", "seg_no", "lang").distinct()
