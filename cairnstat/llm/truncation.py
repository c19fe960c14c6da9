"""Problem 2: responses that stop before their end.

Two families of discrete hazards are computed and each one is set against its neighbours,
with Benjamini-Hochberg control of the false discoveries.

*Hazards of lengths.* A limit leaves a spike in the distribution of lengths: many more
responses end exactly there than at the neighbouring lengths. Lengths are counted in three
units (pieces of up to four word characters, a plain stand-in for subword tokens;
characters; bytes), and the hazard n(l) / n(>= l) of every length is set against the pooled
hazard of the lengths around it, per run and over all runs of one token limit. A
significant length whose hazard is ``wall`` or more is a wall.

*Hazards of endings.* Whether an ending is complete is learnt from the data as well. A line
is read as a path of tokens; the state at each token is the kind of the line (its leading
label, if enough lines have it and their values are short) and the last tokens, as shapes
and as they are. The hazard of a state is the share of its occurrences at which a line ends,
and its closed share is the share of these ends that another line follows, which no cut
explains. An ending is incomplete if

- its closed share, by shapes, is significantly below that of its kind (a label without
  its value, a cut label), or
- the hazard of its last token isn't significantly above that of the other states of its
  kind, and no closed line vouches for it (a token met fewer than ``least`` times tells
  nothing), or
- a finer state (more tokens of context) has a hazard significantly below that of the
  coarser one and never closes (an abbreviation, an enumerator, half a value), or
- its last token is the beginning of a more frequent token in the same place, in a kind in
  which such beginnings close significantly less often than others, or
- a bracket or quotation is open, or a mark says that text was left out.

A response is cut if its ending is incomplete. At a wall (``cause`` = 'limit') it is also
cut if white space ends it, if its last line never stands before another line though most
lines of its kind do, or if most responses of its kind of ending are in excess of what the
neighbouring lengths lead to expect. Incomplete endings elsewhere are cuts in transfer
(``cause`` = 'transfer'), which have no length in common.

Null, blank and invisible responses are no cut responses and have no length. A record delivered
twice counts once; of rows with one id and other content each content counts. Responses
of any length are read whole; a run of letters longer than ``word`` isn't looked at as the
beginning of another. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..session import materialize

PIECE = r"[\p{L}\p{N}_]{1,4}|\n|[^\p{L}\p{N}_\s\p{Z}]"
TOKEN = r"\p{L}[\p{L}\p{M}]*|\p{N}+|\.\.\.|[^\p{L}\p{N}\s\p{Z}]"
LEAD = r"^(\p{Lu}\p{L}+):(?=\s|$)"
OMISSION = r"(?:…|\.\.\.|\x{FFFD})$"
START, CLOSING_QUOTE = "^", "\ue000"

KEYS = ["model_key", "run_id", "max_new_tokens"]


@dataclass(frozen=True)
class TruncationParams:
    window: int = 5
    false_discovery: float = 0.01
    excess: float = 0.5
    wall: float = 0.5
    least: int = 5
    kind_share: float = 0.002  # of the lines: a leading label of fewer lines makes no kind
    kind_tokens: float = 8.0  # longer values on average are prose
    closing: float = 0.05  # share of closed ends from which a kind's closed ends are evidence
    mostly: float = 0.5  # share of closed ends from which an unseen last line is doubtful
    below: float = 0.5  # a hazard or share is compared with this part of its reference
    word: int = 64


def features(records: DataFrame) -> DataFrame:
    """One row for each record: its keys, lengths in three units, ``spaced`` and its non-blank lines."""
    raw = F.col("raw_generation")
    space = F.lit(" \t\r\n\x0b\x0c")
    text = F.rtrim(raw, space)
    seen = F.when(F.length(text) < F.octet_length(text), F.regexp_replace(text, r"\p{Cf}+", "")).otherwise(text)
    lines = F.filter(F.transform(F.split(seen, "\n"), lambda x: F.rtrim(x, space)), lambda x: x != "")
    d = records.where(F.col("record_id").isNotNull() & raw.isNotNull()).select(
        "record_id", "model_key", "run_id", F.col("generation_config.max_new_tokens").alias("max_new_tokens"),
        F.regexp_count(raw, F.lit(PIECE)).alias("pieces"), F.length(raw).alias("chars"), F.octet_length(raw).cast("int").alias("bytes"),
        (text != raw).alias("spaced"), F.when(F.length(F.trim(text)) > 0, lines).alias("lines"),
    )
    return d.where("size(lines) > 0").dropDuplicates()


def length_table(feats: DataFrame) -> DataFrame:
    """scope, model_key, run_id, max_new_tokens, kind, unit, length, n: how many responses have each length."""
    kind = F.col("kind") if "kind" in feats.columns else F.lit("").alias("kind")
    per_kind = feats.groupBy(*KEYS, kind, "pieces", "chars", "bytes").agg(F.count("*").alias("n"))
    unit = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("pieces", "chars", "bytes")])).alias("u")
    scope = F.explode(F.array(
        F.struct(F.lit("run").alias("scope"), F.col("model_key").alias("m"), F.col("run_id").alias("r")),
        F.struct(F.lit("limit").alias("scope"), F.lit(None).cast("string").alias("m"), F.lit(None).cast("string").alias("r")),
    )).alias("s")
    wide = per_kind.select(*KEYS, "kind", "n", unit).select(*KEYS, "kind", "n", "u.*", scope)
    return wide.groupBy(F.col("s.scope").alias("scope"), F.col("s.m").alias("model_key"), F.col("s.r").alias("run_id"), "max_new_tokens", "kind", "unit", "length").agg(F.sum("n").alias("n"))


def _hazards(counts: DataFrame, groups: list[str], window: int) -> DataFrame:
    """For each length that occurs: n, at_risk, the neighbours' near_n, near_risk within the window, and last_n of the length one less."""
    by = W.partitionBy(*groups)
    rows = counts.withColumn("at_risk", F.sum("n").over(by.orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, W.currentRow)))
    # lengths that no response has are neighbours too: as many as a window can reach
    rows = rows.withColumn("first", F.greatest(F.coalesce(F.lag("length").over(by.orderBy("length")) + 1, F.col("length") - window), F.col("length") - 2 * window))
    rows = rows.withColumn("at", F.explode(F.sequence("first", "length"))).drop("first").withColumn("n", F.when(F.col("at") == F.col("length"), F.col("n")).otherwise(F.lit(0)))
    near = by.orderBy("at").rangeBetween(-window, window)
    return (
        rows.withColumns({"near_n": F.sum("n").over(near) - F.col("n"), "near_risk": F.sum("at_risk").over(near) - F.col("at_risk"), "last_n": F.coalesce(F.lag("n").over(by.orderBy("at")), F.lit(0))})
        .where(F.col("at") == F.col("length"))
        .drop("at")
    )


def hazard_table(lengths: DataFrame, params: TruncationParams = TruncationParams()) -> DataFrame:
    """Per scope, run, limit and unit: each length with its hazard, the neighbours' hazard, a p-value and ``significant``."""
    groups = ["scope", *KEYS, "unit"]
    rows = _hazards(lengths.groupBy(*groups, "length").agg(F.sum("n").alias("n")), groups, params.window)
    h = F.col("n") / F.col("at_risk")
    h0 = (F.col("near_n") + 0.5) / (F.col("near_risk") + 1.0)
    # Chernoff's bound of the binomial tail: exp(-at_risk KL(h || h0)), 1 where h isn't above h0
    kl = h * F.log(h / h0) + F.when(h < 1, (1 - h) * F.log((1 - h) / (1 - h0))).otherwise(0.0)
    rows = rows.withColumns({"hazard": h, "near_hazard": h0})
    rows = rows.withColumn("p_value", F.when((h > h0) & (F.col("n") >= params.least), F.exp(-F.col("at_risk") * kl)).otherwise(F.lit(1.0)))
    by = W.partitionBy(*groups)
    rows = rows.withColumn("_cut", F.lit(params.false_discovery) * F.row_number().over(by.orderBy("p_value", "length")) / F.count("*").over(by))
    passed = F.max(F.when(F.col("p_value") <= F.col("_cut"), F.col("p_value"))).over(by)
    return rows.withColumn("significant", F.coalesce(F.col("p_value") <= passed, F.lit(False))).drop("_cut")


def _same(a: str, b: str, cols: list[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return cond


def _shape(token: Column) -> Column:
    word, number = token.rlike(r"^\p{L}"), token.rlike(r"^\p{N}")
    few = F.length(token)
    return F.when(token == START, START).when(word, F.when(few > 1, "w").otherwise("w1")).when(number, F.when(few <= 2, "n1").otherwise("n4")).otherwise(token)


def line_table(feats: DataFrame) -> DataFrame:
    """line, lead, closed, final: each different line, how often another line follows it and how often none does."""
    at = F.posexplode(F.transform("lines", lambda x, i: F.struct(x.alias("line"), (i == F.size("lines") - 1).alias("is_last")))).alias("k", "x")
    each = feats.select(at).select("x.*")
    counted = each.groupBy("line").agg(F.count_if(~F.col("is_last")).alias("closed"), F.count_if("is_last").alias("final"))
    return counted.select("line", F.regexp_extract("line", LEAD, 1).alias("lead"), "closed", "final")


def kinds(lines: DataFrame, params: TruncationParams) -> list[str]:
    """Leading labels that enough lines have and that short values follow: 1 / kind_share of them at most."""
    value = F.regexp_replace("line", LEAD, "")
    n = F.col("closed") + F.col("final")
    per = lines.where("lead <> ''").groupBy("lead").agg(F.sum(n).alias("n"), F.sum(n * F.regexp_count(value, F.lit(TOKEN))).alias("tokens"))
    total = lines.agg(F.sum(n)).first()[0] or 0
    found = per.where((F.col("n") >= params.kind_share * total) & (F.col("tokens") < params.kind_tokens * F.col("n"))).select("lead").orderBy("lead").collect()
    return [r["lead"] for r in found]


def _parsed(lines: DataFrame, labels: list[str]) -> DataFrame:
    """line, kind, closed, final, tokens (the first is START), open: whether a bracket or quotation is, marked: whether the line ends with a mark of omission."""
    kind = F.when(F.col("lead").isin(*labels), F.col("lead")).otherwise("") if labels else F.lit("")
    body = F.when(F.col("kind") != "", F.regexp_replace("line", LEAD, "")).otherwise(F.col("line"))
    paired = F.regexp_replace(body, r"\"([^\"]*)\"", f'"$1{CLOSING_QUOTE}')
    tokens = F.concat(F.array(F.lit(START)), F.regexp_extract_all(paired, F.lit(TOKEN), F.lit(0)))
    d = lines.withColumn("kind", kind).withColumn("tokens", tokens)
    left = F.regexp_count("line", F.lit(r"\(")) > F.regexp_count("line", F.lit(r"\)"))
    odd = F.pmod(F.regexp_count("line", F.lit('"')), F.lit(2)) == 1
    return d.select("line", "kind", "closed", "final", "tokens", (left | odd).alias("open"), F.col("line").rlike(OMISSION).alias("marked"))


def _before(tokens: str, k: int, i: Column) -> Column:
    return F.coalesce(F.get(F.col(tokens), i - k), F.lit(START))


STATE = ["kind", "shape2", "before", "token"]


def state_counts(parsed: DataFrame) -> DataFrame:
    """kind, shape2, before, token: occurrences n, ends, closed and final ends of each state."""
    last = F.size("tokens") - 1
    at = F.explode(F.transform("tokens", lambda t, i: F.struct(_before("tokens", 2, i).alias("t2"), _before("tokens", 1, i).alias("before"), t.alias("token"), (i == last).alias("at_end")))).alias("x")
    d = parsed.select("kind", "closed", "final", at).select("kind", _shape(F.col("x.t2")).alias("shape2"), "x.before", "x.token", "x.at_end", "closed", "final")
    n = F.col("closed") + F.col("final")
    ends = lambda c: F.sum(F.when(F.col("at_end"), c).otherwise(0))
    return d.groupBy(*STATE).agg(F.sum(n).alias("n"), ends(n).alias("ends"), ends(F.col("closed")).alias("closed"), ends(F.col("final")).alias("final"))


def _evidence(e: Column, n: Column, reference: Column, above: bool = False) -> Column:
    """Minus the logarithm of Chernoff's bound for e or fewer (above: or more) of n at this rate; 0 where e isn't on that side."""
    r = F.least(F.greatest(reference, F.lit(1e-9)), F.lit(1 - 1e-9))
    h = e / n
    kl = F.when(h > 0, h * F.log(h / r)).otherwise(0.0) + F.when(h < 1, (1 - h) * F.log((1 - h) / (1 - r))).otherwise(0.0)
    return F.coalesce(F.when((h > r) if above else (h < r), n * kl), F.lit(0.0))


STEP, MOST = 8, 800.0


def _thresholds(tests: list[tuple[str, DataFrame, str]], q: float) -> dict[str, float]:
    """Benjamini-Hochberg in each named family of tests: the least evidence that is a discovery.

    Evidence is rounded down to 1 / STEP, so a family comes to the driver as at most
    MOST * STEP counts, and the rule is at most that much stricter than the exact one.
    """
    parts = [df.select(F.lit(name).alias("family"), F.floor(F.least(F.col(col), F.lit(MOST)) * STEP).alias("bucket")) for name, df, col in tests]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    out = {}
    counted: dict[str, list] = {}
    for r in union.groupBy("family", "bucket").count().collect():
        counted.setdefault(r["family"], []).append((r["bucket"], r["count"]))
    for name, rows in counted.items():
        total, seen, least = sum(c for _, c in rows), 0, float("inf")
        for bucket, c in sorted(rows, reverse=True):
            seen += c
            if math.exp(-bucket / STEP) <= q * seen / total:
                least = bucket / STEP
        out[name] = least
    return out


def endings(lines: DataFrame, params: TruncationParams = TruncationParams()) -> DataFrame:
    """line, kind, incomplete, unseen of each line that ends a response."""
    parsed = materialize(_parsed(lines, kinds(lines, params)), "lines")
    states = materialize(state_counts(parsed), "states")
    sums = [F.sum(c).alias(c) for c in ("n", "ends", "closed", "final")]
    shaped = states.withColumns({"shape1": _shape(F.col("before")), "shape0": _shape(F.col("token"))})

    # levels of context, from the last token's shape to the last two tokens as they are
    keys = [["kind", "shape0"], ["kind", "shape1", "shape0"], ["kind", "shape2", "shape1", "shape0"], ["before", "token"]]
    parts = ("n", "ends", "closed")
    # three shapes of a kind are few, whatever the number of states
    by_shape = shaped.groupBy(*keys[2]).agg(*sums)
    over = lambda c, *cols: F.sum(c).over(W.partitionBy(*cols))
    wide = by_shape.select(
        *keys[2],
        *[F.col(c).alias(f"{c}_2") for c in parts], *[over(c, *keys[1]).alias(f"{c}_1") for c in parts], *[over(c, *keys[0]).alias(f"{c}_0") for c in parts], *[over(c, "kind").alias(f"kind_{c}") for c in parts],
        (over("ends", "shape0") / over("n", "shape0")).alias("parent"),
    ).withColumn("share", F.col("kind_closed") / F.col("kind_ends"))
    exact = states.groupBy(*keys[3]).agg(*sums).select(*keys[3], *[F.col(c).alias(f"{c}_3") for c in parts])
    ended = shaped.where("final > 0").select(*STATE, "shape1", "shape0").join(wide, keys[2]).join(exact, keys[3])

    # tokens that a more frequent token in the same place goes on from
    place = states.groupBy("kind", "before", "token").agg(*sums).where(F.col("token").rlike(r"^[\p{L}\p{N}]") & (F.length("token") <= params.word))
    heads = place.where(F.length("token") > 1).select("kind", "before", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda j: F.substring("token", F.lit(1), j))).alias("token"), F.col("n").alias("m"))
    begun = place.where("ends > 0").join(heads.groupBy("kind", "before", "token").agg(F.max("m").alias("m")), ["kind", "before", "token"]).where("m > n").select("kind", "before", "token", "ends", "closed")
    begun_kinds = begun.groupBy("kind").agg(F.sum("ends").alias("begun_ends"), F.sum("closed").alias("begun_closed"))
    ended = ended.join(begun.select("kind", "before", "token", F.lit(True).alias("is_begun")), ["kind", "before", "token"], "left").join(begun_kinds, "kind", "left")

    part = F.lit(params.below)
    closing = F.col("share") >= params.closing
    found = {}
    for k in range(len(keys)):
        if k < 3:
            found[f"closed_{k}"] = F.when(closing, _evidence(F.col(f"closed_{k}"), F.col(f"ends_{k}"), part * F.col("share"))).otherwise(0.0)
        if k:
            parent = F.col("parent") if k == 3 else F.col(f"ends_{k - 1}") / F.col(f"n_{k - 1}")
            found[f"low_{k}"] = F.when(F.col(f"closed_{k}") == 0, _evidence(F.col(f"ends_{k}"), F.col(f"n_{k}"), part * parent)).otherwise(0.0)
    others = (F.col("kind_ends") - F.col("ends_0") + 0.5) / (F.col("kind_n") - F.col("n_0") + 1.0)
    found["high_0"] = _evidence(F.col("ends_0"), F.col("n_0"), others, above=True)
    found["begun"] = F.when(closing, _evidence(F.col("begun_closed"), F.col("begun_ends"), part * F.col("share"))).otherwise(MOST)
    vouched = closing & (F.col("closed_0") >= part * F.col("share") * F.col("ends_0"))
    evidence = materialize(ended.select(*STATE, "shape1", "shape0", "share", "n_0", vouched.alias("vouched"), F.col("is_begun").isNotNull().alias("is_begun"), *[c.alias(f"e_{name}") for name, c in found.items()]), "evidence")

    # one test for each state of a level, however many finer ones it has
    of = {name: keys[int(name[-1])] if name != "begun" else ["kind"] for name in found}
    least = _thresholds([(name, evidence.groupBy(*of[name]).agg(F.max(f"e_{name}").alias("e")), "e") for name in found], params.false_discovery)
    sure = lambda name: F.col(f"e_{name}") >= F.lit(least.get(name, float("inf")))
    bad = (F.col("is_begun") & sure("begun")) | ~(F.col("vouched") | sure("high_0") | (F.col("n_0") < params.least))
    for name in found:
        if name.startswith(("closed", "low")):
            bad = bad | sure(name)
    judged = evidence.select(*STATE, "share", bad.alias("bad"))

    final = parsed.where("final > 0").select("line", "kind", "closed", "open", "marked", *[F.coalesce(F.get("tokens", F.size("tokens") - k), F.lit(START)).alias(c) for k, c in ((3, "t2"), (2, "before"), (1, "token"))])
    d = final.withColumn("shape2", _shape(F.col("t2"))).join(judged, STATE)
    return d.select("line", "kind", (F.col("open") | F.col("marked") | F.col("bad")).alias("incomplete"), ((F.col("closed") == 0) & (F.col("share") >= params.mostly)).alias("unseen"))


def truncated(records: DataFrame, params: TruncationParams = TruncationParams()) -> DataFrame:
    """record_id, model_key, run_id, cut, cause: every record with a response, whether it was cut off, and by a limit or in transfer (null: not cut)."""
    read = materialize(features(records), "responses")
    judged = endings(materialize(line_table(read), "linetable"), params)
    feats = read.withColumn("line", F.element_at("lines", -1)).drop("lines").join(judged, "line").drop("line")
    feats = materialize(feats, "endings")
    lengths = materialize(length_table(feats), "lengths")
    table = materialize(hazard_table(lengths, params).where("significant").where(F.col("hazard") >= params.wall).select("scope", *KEYS, "unit", "length"), "hazards")

    # kinds of whole endings most of which are in excess at a wall
    groups = ["scope", *KEYS, "kind", "unit"]
    whole = length_table(feats.where("not incomplete"))
    by_kind = _hazards(whole.groupBy(*groups, "length").agg(F.sum("n").alias("n")), groups, params.window)
    # a wall ends all, so the lengths just below it tell what is to be expected, not their hazard
    level = F.greatest(F.col("near_n") / F.lit(float(params.window)), F.col("last_n").cast("double"))
    excess = by_kind.where(F.col("n") >= params.least).where(level <= (1 - params.excess) * F.col("n")).withColumn("level", F.greatest(level, F.lit(0.5)))
    # significant lengths of each record, in any unit and scope
    unit = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("pieces", "chars", "bytes")])).alias("u")
    keyed = feats.groupBy(*KEYS, "pieces", "chars", "bytes").count().select(*KEYS, "pieces", "chars", "bytes", unit).select(*KEYS, "pieces", "chars", "bytes", "u.unit", "u.length")
    t = table.select(*[F.col(c).alias(f"t_{c}") for c in ("scope", *KEYS, "unit", "length")])
    meets = F.col("unit").eqNullSafe(F.col("t_unit")) & F.col("length").eqNullSafe(F.col("t_length")) & F.col("max_new_tokens").eqNullSafe(F.col("t_max_new_tokens"))
    fits = (F.col("t_scope") == "limit") | (F.col("model_key").eqNullSafe(F.col("t_model_key")) & F.col("run_id").eqNullSafe(F.col("t_run_id")))
    # a wall of one run ends the responses of that run, one of a limit all with that limit
    wall_kinds = excess.select(*groups, "length", "n", "level").join(t, meets & F.col("scope").eqNullSafe(F.col("t_scope")) & F.col("model_key").eqNullSafe(F.col("t_model_key")) & F.col("run_id").eqNullSafe(F.col("t_run_id")))
    # Chernoff's bound for so many more than the neighbouring lengths lead to expect
    more = F.col("n") * F.log(F.col("n") / F.col("level")) - F.col("n") + F.col("level")
    wall_kinds = materialize(wall_kinds.select("kind", more.alias("more"), *[F.col(f"t_{c}") for c in ("scope", *KEYS, "unit", "length")]).withColumnRenamed("kind", "t_kind"), "excess")
    wall_kinds = wall_kinds.where(F.col("more") >= F.lit(_thresholds([("more", wall_kinds, "more")], params.false_discovery).get("more", float("inf")))).drop("more")
    at_kind = feats.groupBy(*KEYS, "kind", "pieces", "chars", "bytes").count().select(*KEYS, "kind", "pieces", "chars", "bytes", unit).select(*KEYS, "kind", "pieces", "chars", "bytes", "u.unit", "u.length")
    excess_at = at_kind.join(wall_kinds, meets & fits & (F.col("kind") == F.col("t_kind"))).select(*KEYS, "kind", "pieces", "chars", "bytes").distinct().withColumn("excess", F.lit(True))
    at_limit = keyed.join(t, meets & fits).select(*KEYS, "pieces", "chars", "bytes").distinct().withColumn("at_limit", F.lit(True))

    cols = [*KEYS, "pieces", "chars", "bytes"]
    rows = feats.alias("f").join(at_limit.alias("a"), _same("f", "a", cols), "left").select("f.*", F.coalesce("a.at_limit", F.lit(False)).alias("at_limit"))
    rows = rows.alias("f").join(excess_at.alias("a"), _same("f", "a", [*cols, "kind"]), "left").select("f.*", F.coalesce("a.excess", F.lit(False)).alias("excess"))

    doubtful = F.col("at_limit") & (F.col("spaced") | F.col("unseen") | F.col("excess"))
    cut = F.col("incomplete") | doubtful
    out = rows.groupBy("record_id", "model_key", "run_id").agg(F.max(cut).alias("cut"), F.max(cut & F.col("at_limit")).alias("_limit"))
    return out.select("record_id", "model_key", "run_id", "cut", F.when(F.col("_limit"), "limit").when(F.col("cut"), "transfer").alias("cause"))


def truncation_rates(cuts: DataFrame) -> DataFrame:
    """Per model and run: responses, how many were cut, and their share."""
    return cuts.groupBy("model_key", "run_id").agg(F.count("*").alias("responses"), F.count_if("cut").alias("cut_responses"), F.avg(F.col("cut").cast("int")).alias("cut_rate"))
