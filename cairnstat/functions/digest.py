"""Keys, hashes and hash-driven values as column expressions.

Survey operators: STR10-STR13, STR15-STR17.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col

SYMBOLIC_REVISIONS = ("main", "latest", "master", "head")


def _joined(*parts) -> Column:
    """Parts joined by bars; a null is written as None, since concat_ws would leave it out."""
    return F.concat_ws("|", *[F.coalesce((p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("None")) for p in parts])


def sha256(x) -> Column:
    return F.sha2(col(x), 256)


def record_key(kind, model, item, condition, version, seed) -> Column:
    """STR10: full digest of type|model|item|condition|version|seed."""
    return sha256(_joined(kind, model, item, condition, version, seed))


def settings_fingerprint(settings: dict[str, object]) -> Column:
    """STR12: first 16 hex digits of the digest of k=v pairs in their order; True, False and None as words."""

    def word(v):
        if isinstance(v, Column):
            return v
        return F.lit(str(v))

    parts = [F.concat(F.lit(f"{k}="), F.coalesce(word(v).cast("string"), F.lit("None"))) for k, v in settings.items()]
    return F.substring(sha256(F.concat_ws("|", *parts)), 1, 16)


def observation_id(model, revision, item, prompt_digest, version, fingerprint, seed, prefix: str = "phase3") -> Column:
    """First 32 hex digits that identify one generation; an absent revision is UNRESOLVED."""
    return F.substring(sha256(_joined(prefix, model, F.coalesce(col(revision), F.lit("UNRESOLVED")), item, prompt_digest, version, fingerprint, seed)), 1, 32)


def is_pinned(revision) -> Column:
    """STR13: a revision that names one state, not a moving name."""
    low = F.lower(F.trim(F.coalesce(col(revision), F.lit(""))))
    return (low != "") & ~low.isin(*SYMBOLIC_REVISIONS)


def is_sha256(x) -> Column:
    return F.coalesce(col(x).rlike("^[0-9a-f]{64}$"), F.lit(False))


def synthetic_id(relation, number) -> Column:
    """STR15: a stable id of relation and number."""
    return F.format_string("syn-%s-%04d", F.replace(col(relation), F.lit(" "), F.lit("-")), col(number).cast("int"))


def keyed_order(seed: int, salt, item) -> Column:
    """The order in which a seeded draw takes items: fixed for a seed, other for another, whatever the row order."""
    return sha256(_joined(seed, salt, item))


def uniform(x) -> Column:
    """A number from 0 to 1 from the first 8 hex digits of the text's digest."""
    return F.conv(F.substring(sha256(x), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def pseudo_outcome(text, rate) -> Column:
    """STR16: true for the given share of texts."""
    return uniform(text) < col(rate)


def dummy_generation(prompt) -> Column:
    """STR17: a model's reply made from the prompt's digest alone, so a whole run stays inside the plan."""
    digest = sha256(prompt)
    share = F.conv(F.substring(digest, 9, 4), 16, 10).cast("int") % 100
    decision = F.when(share < 85, F.lit("answer")).otherwise(F.lit("uncertain"))
    return F.concat(F.lit("Answer: candidate-"), F.substring(digest, 1, 4), F.lit("\nDecision: "), decision, F.lit("\nConfidence: "), share.cast("string"))


def dummy_choice(prompt) -> Column:
    """STR17: a model's reply to a prompt that asks for one of two sources, from the digest alone."""
    even = F.conv(F.substring(sha256(prompt), 1, 8), 16, 10).cast("bigint") % 2 == 0
    return F.concat(F.lit("Choice: "), F.when(even, F.lit("1")).otherwise(F.lit("2")))


def dummy_logprob(prompt, candidate) -> Column:
    """STR17: a candidate's mean token log-probability from the digest."""
    return -F.lit(0.5) - uniform(_joined(col(prompt), col(candidate))) * 4.0
