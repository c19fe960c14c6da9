"""Sizes of texts in tokens of a public tokenizer, counted in Python workers in Arrow batches."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that the vocabulary was made with, from the tokenizer's package; this one where the package is absent.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE_CHARS = 100_000

_encodings: dict[str, object] = {}


def encoding(path: str = TOKENIZER):
    """The tokenizer of a rank file, one for each process."""
    if path not in _encodings:
        import tiktoken

        try:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        except ImportError:
            pattern = PATTERN
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def encode(text: str, path: str = TOKENIZER) -> list[int]:
    """All tokens of the text. A very long text is encoded in parts cut before a space, where the pattern cuts too."""
    enc = encoding(path)
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE_CHARS)
        if end < len(text):
            cut = text.rfind(" ", at + 1, end)
            # a space between two characters that aren't space begins a new token
            while cut > at and (text[cut - 1].isspace() or text[cut + 1].isspace()):
                cut = text.rfind(" ", at + 1, cut)
            end = cut if cut > at else end
        out += enc.encode_ordinary(text[at:end])
        at = end
    return out


def sizes(docs: DataFrame, id_col: str, text_col: str, keep: list[str] = [], path: str = TOKENIZER) -> DataFrame:  # noqa: B006
    """id, keep, n_tokens; a null text has 0 tokens."""

    def run(batches):
        for b in batches:
            out = b.drop(columns=[text_col])
            out["n_tokens"] = [len(encode(x, path)) if x else 0 for x in b[text_col]]
            yield out

    ship(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (id_col, *keep)] + ["n_tokens bigint"])
    return docs.select(id_col, *keep, text_col).mapInPandas(run, schema)


def bags(docs: DataFrame, id_col: str, text_col: str, keep: list[str] = [], path: str = TOKENIZER) -> DataFrame:  # noqa: B006
    """id, keep, n_tokens, terms array<int> (distinct tokens, ascending), times array<int>."""

    def run(batches):
        for b in batches:
            rows = []
            for text in b[text_col]:
                ids = encode(text, path) if text else []
                terms, times = np.unique(np.array(ids, dtype=np.int32), return_counts=True)
                rows.append((len(ids), terms, times.astype(np.int32)))
            out = b.drop(columns=[text_col]).reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(rows, columns=["n_tokens", "terms", "times"])], axis=1)

    ship(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (id_col, *keep)] + ["n_tokens bigint, terms array<int>, times array<int>"])
    return docs.select(id_col, *keep, text_col).mapInPandas(run, schema)
