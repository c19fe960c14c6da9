"""Query name -> plan and, where SQL can express it, the SQL that gives the same rows.

Every double is rounded to 9 places on both sides. The text in brackets behind a query
names the operators of the survey that it covers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import digest, stats, text
from ..operators import bootstrap, calibration, classify, contrasts, dedup, expand, foils, ingest, regression, runner, sampling, strata, summaries, verify
from ..session import table
from ..sources import jsonl
from .fixtures import cte, view

QUERIES: dict = {}
SQL: dict[str, str] = {}
OPS: dict[str, str] = {}


def query(ops: str, sql: str | None = None):
    """Register a query with the survey's operators that it covers and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        OPS[f.__name__] = ops
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# the answer form in SQL
_WS = r"[\s\x1c-\x1f\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_PUNCT = r"[!-/:-@\[-`{-~]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _norm(x: str) -> str:
    joined = f"regexp_replace(regexp_replace(lower({_strip(f'coalesce({x}, {chr(39)}{chr(39)})')}), '{_PUNCT}', '', 'g'), '{_WS}+', ' ', 'g')"
    return f"regexp_replace({_strip(joined)}, '^(a|an|the)( |$)', '')"


def _aliases(gold: str, aliases: str) -> str:
    return f"list_distinct(list_transform(list_filter(list_concat([{gold}], coalesce({aliases}, [])), lambda x: x is not null and {_strip('x')} <> ''), lambda x: {_norm('x')}))"


def r9(c, name=None):
    return F.round(F.col(c) if isinstance(c, str) else c, 9).alias(name or c)


# ---- text -------------------------------------------------------------------------------


@query("STR1", cte("response") + f"select parsed_answer, {_norm('parsed_answer')} as form from (select distinct parsed_answer from response)")
def q01_normalize(spark, sf_dir):
    return view(spark, sf_dir, "response").select("parsed_answer").distinct().withColumn("form", text.normalize_answer("parsed_answer"))


@query("STR2 STR3 SET1", cte("response") + f"select record_id, {_norm('parsed_answer')} <> '' and list_contains({_aliases('gold_answer', 'gold_aliases')}, {_norm('parsed_answer')}) as matched, len({_aliases('gold_answer', 'gold_aliases')}) as n_aliases from response")
def q02_alias_match(spark, sf_dir):
    d = view(spark, sf_dir, "response")
    return d.select("record_id", text.is_match("parsed_answer", "gold_answer", "gold_aliases").alias("matched"), F.size(text.alias_set("gold_answer", "gold_aliases")).cast("bigint").alias("n_aliases"))


_WORDS = "list_filter(string_split({0}, ' '), lambda w: w <> '')"


@query("STR4", cte("response") + f"""
, d as (select distinct parsed_answer, gold_answer from response),
w as (select parsed_answer, gold_answer, {_WORDS.format(_norm('parsed_answer'))} as a, {_WORDS.format(_norm('gold_answer'))} as b from d),
c as (select *, coalesce(list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda v: v = t)), len(list_filter(b, lambda v: v = t))))), 0) as common from w)
select parsed_answer, gold_answer, round(case when len(a) = 0 and len(b) = 0 then 1.0 when len(a) = 0 or len(b) = 0 or common = 0 then 0.0
       else 2 * (common / len(a)) * (common / len(b)) / ((common / len(a)) + (common / len(b))) end, 9) as f1 from c""")
def q03_token_f1(spark, sf_dir):
    return view(spark, sf_dir, "response").select("parsed_answer", "gold_answer").distinct().withColumn("f1", F.round(text.token_f1("parsed_answer", "gold_answer"), 9))


@query("STR6 MTH7", cte("response") + f"""
, e as (select record_id, nullif({_strip(f"regexp_extract(raw_generation, 'Answer:{_WS}*(.+)', 1)")}, '') as answer,
        lower(nullif(regexp_extract(raw_generation, '(?im)^Decision:{_WS}*(answer|uncertain){_WS}*$', 1), '')) as decision,
        nullif(regexp_extract(raw_generation, 'Confidence:{_WS}*([0-9]+)', 1), '') as digits from response)
select record_id, answer, decision, case when digits is not null then cast(least(100, cast(digits as hugeint)) as int) end as confidence, answer is null or decision is null as malformed from e""")
def q04_parse_response(spark, sf_dir):
    return view(spark, sf_dir, "response").select("record_id", text.parse_response("raw_generation").alias("p")).select("record_id", "p.*")


_CHOICE = "case stat_id % 8 when 0 then 'Choice: 1' when 1 then 'Choice: 2' when 2 then concat('Choice:    1   ', chr(10), 'x') when 3 then 'Choice: 1 | 2' when 4 then concat('Well', chr(10), 'Choice: 2') when 5 then 'Choice: 12' when 6 then '' end"


@query("STR7 STR8", f"""
with t as (select distinct stat_id, source_a, source_b, {_CHOICE} as raw from pairwise_stat),
c as (select *, try_cast(nullif(regexp_extract(raw, '(?m)^Choice:[ \\t]*([12])[ \\t]*$', 1), '') as int) as choice from t)
select stat_id, choice, case choice when 1 then source_a when 2 then source_b end as selected from c""")
def q05_parse_choice(spark, sf_dir):
    t = table(spark, sf_dir, "pairwise_stat").selectExpr("stat_id", "source_a", "source_b", f"{_CHOICE} as raw").distinct()
    return t.withColumn("choice", text.parse_choice("raw")).select("stat_id", "choice", text.selected_source("choice", "source_a", "source_b").alias("selected"))


_RAW_ITEM = """select item_id as id, subj, prop, case when subj is null then cast(null as string) else obj end as obj,
  case when length(obj) % 11 = 0 then '  ' else question end as question, aliases from {interim_item}"""


def _raw_items(spark, sf_dir):
    raw = spark.sql(_RAW_ITEM, interim_item=table(spark, sf_dir, "interim_item"))
    quote = lambda x: F.concat(F.lit("'"), F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\\\\\"), "'", r"\\\\'"), F.lit("'"))
    return raw.select("id", "subj", "prop", "obj", "question", F.concat(F.lit("["), F.concat_ws(", ", F.transform(F.coalesce("aliases", F.array().cast("array<string>")), quote)), F.lit("]")).alias("o_aliases"), F.when(F.col("obj").isNotNull(), F.col("obj")).alias("possible_answers"))


@query("STR5 FLT1", f"""
with r as ({_RAW_ITEM.format(interim_item='interim_item')}),
m as (select *, case when {_strip("coalesce(question, '')")} = '' then 'empty_question' when {_strip("coalesce(obj, '')")} = '' then 'empty_gold_answer' end as reason from r)
select id, reason, case when reason is null then array_to_string(list_sort(list_distinct(list_concat(coalesce(aliases, []), [{_strip('obj')}]))), '|') end as aliases,
       case when reason is null then {_norm('obj')} end as gold_normalized from m""")
def q06_interim(spark, sf_dir):
    kept, excluded = ingest.build_interim(_raw_items(spark, sf_dir))
    rows = kept.select("id", F.lit(None).cast("string").alias("reason"), F.concat_ws("|", "aliases").alias("aliases"), "gold_normalized")
    return rows.unionByName(excluded.select("id", "reason", F.lit(None).cast("string").alias("aliases"), F.lit(None).cast("string").alias("gold_normalized")))


# ---- items and groups -------------------------------------------------------------------


@query("AGG1 JN1 FLT3", cte("item") + f"""
, c as (select relation, subj, count(distinct {_norm('gold_answer')}) as k from item where relation is not null and subj is not null group by 1, 2)
select item_id, coalesce(k, 0) as n_objects, coalesce(k, 0) > 1 as multi_object from item left join c using (relation, subj)""")
def q07_multiplicity(spark, sf_dir):
    return ingest.with_multiplicity(view(spark, sf_dir, "item"), ["relation", "subj"], "gold_answer").select("item_id", "n_objects", "multi_object")


@query("AGG3 SRT1", cte("item") + "select relation, subj, item_id, gold_answer from item qualify row_number() over (partition by relation, subj order by item_id) = 1")
def q08_candidate_pool(spark, sf_dir):
    return ingest.smallest_per_key(view(spark, sf_dir, "item"), ["relation", "subj"], "item_id").select("relation", "subj", "item_id", "gold_answer")


@query("SMP1 LIM1", "select item_id, prop from interim_item order by sha256('42||' || item_id), item_id limit 500")
def q09_screen_sample(spark, sf_dir):
    return sampling.take(table(spark, sf_dir, "interim_item").select("item_id", "prop"), 500, 42, "item_id")


@query("AGG2 JN2 STR11", f"""
with i as (select item_id, prop as relation, obj, {_norm('obj')} as form, {_aliases('obj', 'aliases')} as rt from interim_item),
x as (select relation, form, arg_min(obj, item_id) as obj, min(item_id) as source_item_id from i where relation is not null and form <> '' group by 1, 2),
o as (select *, row_number() over (partition by relation order by sha256('ring|42|' || relation || '|' || form), form) - 1 as pos, count(*) over (partition by relation) as n from x),
s as (select i.item_id, i.relation, i.rt, z.n, cast('0x' || substr(sha256('42|' || item_id), 1, 12) as bigint) % z.n as start from i join (select distinct relation, n from o) z using (relation)),
p as (select item_id, relation, rt, unnest(range(least(8, n))) as step, start, n from s),
f as (select p.item_id, p.step, o.obj, o.source_item_id from p join o on o.relation = p.relation and o.pos = (p.start + p.step) % p.n where not list_contains(p.rt, o.form)),
b as (select item_id, arg_min(obj, step) as foil_answer, arg_min(source_item_id, step) as foil_source_item_id from f group by 1)
select i.item_id, foil_answer, foil_source_item_id from i left join b using (item_id)""")
def q10_foils(spark, sf_dir):
    return foils.draw_foils(table(spark, sf_dir, "interim_item"))


_CLASS = f"""case when malformed or answer is null then 'manual_review' when decision = 'uncertain' then 'uncertain' when decision is null or decision <> 'answer' then 'manual_review'
 when form <> '' and form = {_norm('context')} then 'context' when form <> '' and form = {_norm('memory')} then 'memory'
 when form <> '' and list_contains({_aliases('gold_answer', 'gold_aliases')}, form) then 'gold' else 'other' end"""


def _classified(spark, sf_dir):
    d = view(spark, sf_dir, "response").withColumns({"malformed": F.col("parsed_answer").isNull() | F.col("parsed_decision").isNull(), "context": F.when(F.col("record_id") % 2 == 0, F.col("gold_answer")).otherwise(F.col("subject")), "memory": F.col("subject")})
    return d.withColumn("class", summaries.answer_class("malformed", "parsed_answer", "parsed_decision", "context", "memory", "gold_answer", "gold_aliases"))


@query("FLT7 FLT8", cte("response") + f"""
, c as (select record_id, parsed_answer is null or parsed_decision is null as malformed, parsed_answer as answer, parsed_decision as decision, {_norm('parsed_answer')} as form,
        case when record_id % 2 = 0 then gold_answer else subject end as context, subject as memory, gold_answer, gold_aliases from response)
select record_id, {_CLASS} as class, {_CLASS} = 'context' as context_adopted from c""")
def q11_answer_class(spark, sf_dir):
    return _classified(spark, sf_dir).select("record_id", "class", (F.col("class") == "context").alias("context_adopted"))


@query("AGG26", cte("response") + f"""
, c as (select model_key, parsed_answer is null or parsed_decision is null as malformed, parsed_answer as answer, parsed_decision as decision, {_norm('parsed_answer')} as form,
        case when record_id % 2 = 0 then gold_answer else subject end as context, subject as memory, gold_answer, gold_aliases from response),
k as (select model_key, {_CLASS} as class, count(*) as n from c group by 1, 2)
select model_key, string_agg(class || '=' || n, ',' order by class) as classes from k group by 1""")
def q12_class_histogram(spark, sf_dir):
    h = summaries.histogram(_classified(spark, sf_dir), ["model_key"], "class")
    return h.select("model_key", F.concat_ws(",", F.transform(F.array_sort(F.map_entries("histogram")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))).alias("classes"))


@query("FLT6", cte("response") + f"""
, w as (select record_id, coalesce(parsed_answer, '') as a, len(list_filter(regexp_split_to_array({_strip("coalesce(parsed_answer, '')")}, '{_WS}+'), lambda x: x <> '')) as n_words,
        {_norm('parsed_answer')} <> '' and list_contains({_aliases('gold_answer', 'gold_aliases')}, {_norm('parsed_answer')}) as matched from response)
select record_id, n_words, n_words <= 6 and not (contains(lower(a), ',') or contains(lower(a), ' or ') or contains(lower(a), ' and ')) as clean, matched from w""")
def q13_clean_candidates(spark, sf_dir):
    return view(spark, sf_dir, "response").select("record_id", text.word_count("parsed_answer").cast("bigint").alias("n_words"), text.is_clean_candidate("parsed_answer").alias("clean"), text.is_match("parsed_answer", "gold_answer", "gold_aliases").alias("matched"))


# ---- strata, blocks, samples -------------------------------------------------------------


@query("WIN1", cte("margin") + """
, r as (select model_key, knowledge_group, margin, row_number() over (partition by model_key, knowledge_group order by margin) - 1 as i, count(*) over (partition by model_key, knowledge_group) as n from margin)
select model_key, knowledge_group, n, max(case when i = cast(round_even(1 / 3.0::double * (n - 1), 0) as bigint) then margin end) as lower_edge,
       max(case when i = cast(round_even(2 / 3.0::double * (n - 1), 0) as bigint) then margin end) as upper_edge from r group by 1, 2, 3""")
def q14_tertile_edges(spark, sf_dir):
    e = strata.edges(view(spark, sf_dir, "margin"), ["model_key", "knowledge_group"], "margin")
    return e.select("model_key", "knowledge_group", "n", F.col("edges")[0].alias("lower_edge"), F.col("edges")[1].alias("upper_edge"))


_EDGES = """
, r as (select relation, knowledge_group, margin, row_number() over (partition by relation, knowledge_group order by margin) - 1 as i, count(*) over (partition by relation, knowledge_group) as n from item),
e as (select relation, knowledge_group, max(case when i = cast(round_even(1 / 3.0::double * (n - 1), 0) as bigint) then margin end) as e1,
      max(case when i = cast(round_even(2 / 3.0::double * (n - 1), 0) as bigint) then margin end) as e2 from r group by 1, 2),
s as (select item.*, case when margin <= e1 then 'low' when margin <= e2 then 'medium' else 'high' end as stratum from item join e using (relation, knowledge_group))
"""


@query("WIN2 WIN3", cte("item") + _EDGES + "select item_id, stratum from s")
def q15_strata(spark, sf_dir):
    return strata.stratify(view(spark, sf_dir, "item"), ["relation", "knowledge_group"], "margin").select("item_id", "stratum")


@query("AGG20", cte("item") + _EDGES + "select relation, knowledge_group, count(*) as assigned_items, count(*) filter (stratum = 'low') as low, count(*) filter (stratum = 'medium') as medium, count(*) filter (stratum = 'high') as high from s group by 1, 2")
def q16_strata_record(spark, sf_dir):
    return strata.strata_record(view(spark, sf_dir, "item"), ["relation", "knowledge_group"], "margin").drop("edges")


@query("EXP7 JN14", "select item_id, cast(row_number() over (order by item_id) as bigint) as row_no, cast(floor((row_number() over (order by item_id) - 1) / 250) as int) as block_index from interim_item")
def q17_blocks(spark, sf_dir):
    return strata.blocks(table(spark, sf_dir, "interim_item").select("item_id"), "item_id").select("item_id", F.col("row_no").cast("bigint").alias("row_no"), "block_index")


def _screened(spark, sf_dir):
    return strata.blocks(view(spark, sf_dir, "item").where("knowledge_group = 'KW'"), "item_id", 500, groups=["relation"])


_SUPPLY = cte("item") + """
, b as (select relation, margin, cast(floor((row_number() over (partition by relation order by item_id) - 1) / 500) as int) as k from item where knowledge_group = 'KW'),
u as (select b.relation, b.margin, x.k as upto_block from b join (select distinct relation, k from b) x on x.relation = b.relation and b.k <= x.k),
r as (select *, row_number() over (partition by relation, upto_block order by margin) - 1 as i, count(*) over (partition by relation, upto_block) as n from u),
e as (select relation, upto_block, max(case when i = cast(round_even(1 / 3.0::double * (n - 1), 0) as bigint) then margin end) as e1,
      max(case when i = cast(round_even(2 / 3.0::double * (n - 1), 0) as bigint) then margin end) as e2 from r group by 1, 2),
s as (select relation, upto_block, case when margin <= e1 then 'low' when margin <= e2 then 'medium' else 'high' end as stratum, count(*) as supply from u join e using (relation, upto_block) group by 1, 2, 3)
"""


@query("WIN6 AGG17", _SUPPLY + "select relation, upto_block, stratum, supply from s")
def q18_supply_by_block(spark, sf_dir):
    return strata.supply_by_block(_screened(spark, sf_dir), ["relation"], "margin", []).select("relation", "upto_block", "stratum", "supply")


@query("WIN6", _SUPPLY + "select relation, min(case when ok >= 3 then upto_block end) as stop_block from (select relation, upto_block, count(*) filter (supply >= 40) as ok from s group by 1, 2) group by 1")
def q19_first_block_met(spark, sf_dir):
    return strata.first_block_met(strata.supply_by_block(_screened(spark, sf_dir), ["relation"], "margin", []), ["relation"], 3, 40)


@query("SMP2", cte("item") + """
, k as (select item_id, relation, row_number() over (partition by relation order by sha256('42|' || relation || '|' || item_id), item_id) as r from item)
select item_id, relation from k order by r, relation limit 100""")
def q20_balanced_sample(spark, sf_dir):
    return sampling.balanced(view(spark, sf_dir, "item").select("item_id", "relation"), 100, 42, "item_id", "relation")


@query("SMP3", cte("item") + _EDGES + """
select item_id, relation, stratum from s where knowledge_group = 'KW' qualify row_number() over (partition by relation, stratum order by sha256('42|A:' || relation || ':' || stratum || '|' || item_id), item_id) <= 8""")
def q21_stratified_take(spark, sf_dir):
    s = strata.stratify(view(spark, sf_dir, "item"), ["relation", "knowledge_group"], "margin").where("knowledge_group = 'KW'")
    return sampling.take(s, 8, 42, "item_id", ["relation", "stratum"], "A").select("item_id", "relation", "stratum")


@query("SMP5", cte("item") + _EDGES + """
, c as (select knowledge_group, relation, stratum, count(*) as n from s group by 1, 2, 3),
q as (select knowledge_group, relation, min(n) as least_n from c group by 1, 2 having count(*) filter (n >= 10) = 3),
z as (select knowledge_group, least(40, min(least_n)) as realized from q group by 1)
select item_id, knowledge_group, relation, stratum, realized from s join z using (knowledge_group) where exists (select 1 from q where q.knowledge_group = s.knowledge_group and q.relation = s.relation)
qualify row_number() over (partition by knowledge_group, relation, stratum order by sha256('42|' || knowledge_group || ':' || relation || ':' || stratum || '|' || item_id), item_id) <= realized""")
def q22_ladder(spark, sf_dir):
    s = strata.stratify(view(spark, sf_dir, "item"), ["relation", "knowledge_group"], "margin")
    return sampling.ladder(s, ["knowledge_group"], ["relation"], "stratum", 3, 10, 40, 42, "item_id").select("item_id", "knowledge_group", "relation", "stratum", F.col("realized").cast("bigint").alias("realized"))


@query("JN4 SET4", cte("response") + "select item_id from response where baseline_correct group by 1 having count(distinct model_key) = 4")
def q23_in_all_models(spark, sf_dir):
    return sampling.in_all(view(spark, sf_dir, "response").where("baseline_correct"), "item_id", "model_key", 4)


@query("JN3", "select item_id from interim_item where item_id not in (select distinct item_id from baseline_record where knowledge_group = 'KW' and item_id is not null)")
def q24_fresh_items(spark, sf_dir):
    used = table(spark, sf_dir, "baseline_record").where("knowledge_group = 'KW'")
    return sampling.without(table(spark, sf_dir, "interim_item"), used, "item_id").select("item_id")


@query("AGG18", cte("item") + "select knowledge_group, relation, count(*) as n, round(count(*) / sum(count(*)) over (partition by knowledge_group), 9) as share, max(count(*)) over (partition by knowledge_group) / sum(count(*)) over (partition by knowledge_group) > 0.6 as dominant from item group by 1, 2")
def q25_composition(spark, sf_dir):
    return sampling.composition(view(spark, sf_dir, "item"), ["knowledge_group"], "relation").withColumn("share", F.round("share", 9))


@query("AGG30", cte("response") + "select count(*) filter (k = 1) as agreeing, count(*) filter (k > 1) as differing from (select item_id, count(distinct knowledge_group) as k from response group by 1)")
def q26_label_agreement(spark, sf_dir):
    return sampling.label_agreement(view(spark, sf_dir, "response"), "item_id", "knowledge_group")


@query("EXP8 SET1", cte("response") + "select item_id, string_agg(distinct run_id, '|' order by run_id) as runs, count(distinct run_id) as n from response group by 1")
def q27_membership(spark, sf_dir):
    long = view(spark, sf_dir, "response").select("item_id", F.col("run_id").alias("label")).distinct()
    return expand.labels_wide(long, ["item_id"]).select("item_id", F.concat_ws("|", "labels").alias("runs"), F.size("labels").cast("bigint").alias("n"))


# ---- conditions, prompts, dedup ----------------------------------------------------------

#: A text of our own with the places that evidence has.
EVIDENCE = 'Asked about "{subj}", {source} gave this reply: "{asserted_answer}".\nHow would you reply?\n'
_SOURCE_A, _SOURCE_B = "a government website", "an anonymous online forum post"


def _planned(spark, sf_dir):
    """Each item in the confirmatory conditions, the extra arm for even sizes; the preferred source is the first one there."""
    roles = {"identity_a": F.lit(_SOURCE_A), "identity_b": F.lit(_SOURCE_B), "preferred": F.lit(_SOURCE_A), "dispreferred": F.lit(_SOURCE_B)}
    return expand.conditions(view(spark, sf_dir, "item"), expand.CONFIRMATORY, roles, expand.MODEL_ARM, F.col("p_size") % 4 < 2)


_PLANNED = cte("item") + f"""
, c as (select * from (values ('C0', 'none', 'none', 0), ('K1', 'true', 'a', 0), ('K2', 'true', 'b', 0), ('K3', 'false', 'a', 0), ('K4', 'false', 'b', 0), ('M1', 'm', 'a', 1), ('M2', 'm', 'b', 1)) v(condition, truth, src, extra)),
p as (select item.*, condition, case when truth = 'm' then (case when knowledge_group = 'KC' then 'false' else 'true' end) else truth end as evidence_truth,
      case src when 'a' then '{_SOURCE_A}' when 'b' then '{_SOURCE_B}' end as source_label from item join c on extra = 0 or p_size % 4 < 2),
q as (select *, case evidence_truth when 'none' then 'none' when 'true' then (case when knowledge_group = 'KC' then 'agreement' else 'conflict' end) else (case when knowledge_group = 'KC' then 'conflict' else 'agreement' end) end as conflict_status,
      case evidence_truth when 'true' then gold_answer when 'false' then (case when knowledge_group = 'KC' then foil_answer else memory_answer end) end as asserted_answer from p)
"""


@query("EXP4 EXP5 FLT15", _PLANNED + "select item_id, condition, evidence_truth, conflict_status, source_label, asserted_answer from q")
def q28_conditions(spark, sf_dir):
    return _planned(spark, sf_dir).select("item_id", "condition", "evidence_truth", "conflict_status", "source_label", "asserted_answer")


@query("EXP3 SET2", cte("item") + """
, c as (select * from (values ('C0', 'none'), ('C1', 'true'), ('C2', 'true'), ('C3', 'false'), ('C4', 'false')) v(condition, evidence_truth))
select condition, knowledge_group, evidence_truth, count(*) as n, count(distinct case when evidence_truth = 'true' then gold_answer when evidence_truth = 'false' then (case when knowledge_group = 'KC' then foil_answer else memory_answer end) end) as answers
from item cross join c group by 1, 2, 3""")
def q29_pilot_conditions(spark, sf_dir):
    rows = expand.conditions(view(spark, sf_dir, "item"), expand.PILOT, {"preferred": F.lit(_SOURCE_A), "dispreferred": F.lit(_SOURCE_B)})
    return rows.groupBy("condition", "knowledge_group", "evidence_truth").agg(F.count("*").alias("n"), F.countDistinct("asserted_answer").alias("answers"))


def _identified(spark, sf_dir):
    rows = _planned(spark, sf_dir).withColumn("prompt", F.when(F.col("condition") == "C0", F.lit("None")).otherwise(text.render(EVIDENCE, source=F.col("source_label"), subj=F.col("subj"), asserted_answer=F.col("asserted_answer"))))
    rows = rows.withColumn("model_key", F.when(F.col("p_size") % 3 == 0, F.lit("m1")).otherwise(F.lit("m2")))
    fingerprint = digest.settings_fingerprint({"do_sample": False, "num_beams": 1, "max_new_tokens": 32})
    return dedup.identify(rows, "prompt", F.lit(None).cast("string"), "v1", fingerprint, 42)


_IDENTIFIED = _PLANNED + """
, r as (select *, case when p_size % 3 = 0 then 'm1' else 'm2' end as model_key, case when condition = 'C0' then 'None' else
        concat('Asked about "', subj, '", ', source_label, ' gave this reply: "', asserted_answer, '".', chr(10), 'How would you reply?', chr(10)) end as prompt from q),
h as (select *, sha256(prompt) as prompt_hash from r),
o as (select *, substr(sha256(concat('phase3|', model_key, '|UNRESOLVED|', item_id, '|', prompt_hash, '|v1|', substr(sha256('do_sample=False|num_beams=1|max_new_tokens=32'), 1, 16), '|42')), 1, 32) as observation_id from h)
"""


@query("STR9 STR11 STR12", _IDENTIFIED + "select item_id, condition, prompt_hash, observation_id from o")
def q30_prompt_hashes(spark, sf_dir):
    return _identified(spark, sf_dir).select("item_id", "condition", "prompt_hash", "observation_id")


@query("AGG21 WIN5", _IDENTIFIED + "select observation_id, model_key, item_id, count(*) as aliases, string_agg(condition, '|' order by condition) as conditions, min(condition) as primary_condition from o group by 1, 2, 3")
def q31_observations(spark, sf_dir):
    c = dedup.collapse(_identified(spark, sf_dir))
    return c.select("observation_id", "model_key", "item_id", F.size("aliased_conditions").cast("bigint").alias("aliases"), F.concat_ws("|", F.transform("aliased_conditions", lambda a: a["condition"])).alias("conditions"), "primary_condition")


@query("AGG22", _IDENTIFIED + """
, k as (select model_key, observation_id, count(*) as s, min(item_id) as i from o group by 1, 2)
select model_key, cast(sum(s) as bigint) as nominal_slots, count(*) as unique_observations, cast(sum(s) - count(*) as bigint) as collapsed_slots, count(*) filter (s > 1) as aliased_observations, count(distinct i) as items from k group by rollup (model_key)""")
def q32_dedup_accounting(spark, sf_dir):
    return dedup.accounting(_identified(spark, sf_dir))


@query("AGG23", _IDENTIFIED + "select observation_id from o group by 1 having count(distinct coalesce(asserted_answer, '␀')) > 1 or count(distinct coalesce(source_label, '␀')) > 1 or count(distinct evidence_truth) > 1 or count(distinct conflict_status) > 1")
def q33_broken_aliases(spark, sf_dir):
    return dedup.broken_aliases(_identified(spark, sf_dir)).select("observation_id")


@query("AGG24", _IDENTIFIED + """
, s as (select model_key, item_id, max(case when condition = 'M1' then observation_id end) as m1, max(case when condition = 'M2' then observation_id end) as m2,
        max(case when condition = 'K1' then observation_id end) as k1, max(case when condition = 'K3' then observation_id end) as k3 from o group by 1, 2)
select model_key, 'K1=M1' as contrast, count(*) as items, count(*) filter (k1 = m1) as same_observation from s where k1 is not null and m1 is not null group by 1
union all select model_key, 'M1=M2', count(*), count(*) filter (m1 = m2) from s where m1 is not null and m2 is not null group by 1""")
def q34_degenerate_contrasts(spark, sf_dir):
    return dedup.degenerate_contrasts(dedup.alias_map(_identified(spark, sf_dir)), [("K1=M1", "K1", "M1"), ("M1=M2", "M1", "M2")])


@query("JN6", _IDENTIFIED + """
, g as (select observation_id, model_key, item_id, string_agg(distinct condition, '|' order by condition) as conditions, max(asserted_answer) as asserted_answer from o group by 1, 2, 3)
select observation_id, g.model_key, g.item_id, conditions, asserted_answer, gold_answer from g join item using (item_id)""")
def q35_run_plan(spark, sf_dir):
    ident = _identified(spark, sf_dir)
    base = ident.select("model_key", "item_id", "gold_answer").distinct()
    return dedup.run_plan(ident, ident, base).select("observation_id", "model_key", "item_id", F.concat_ws("|", "conditions").alias("conditions"), "asserted_answer", "gold_answer")


@query("JN7 STR16", _IDENTIFIED + """
, b as (select distinct observation_id, cast('0x' || substr(sha256(observation_id), 1, 8) as bigint) / 4294967295.0::double < 0.3 as outcome from o)
select model_key, condition, count(*) as n, count(*) filter (outcome) as adopted from o join b using (observation_id) group by 1, 2""")
def q36_outcome_lookup(spark, sf_dir):
    ident = _identified(spark, sf_dir)
    obs = ident.select("observation_id").distinct().withColumn("outcome", digest.pseudo_outcome("observation_id", F.lit(0.3)))
    return dedup.outcomes(dedup.alias_map(ident), obs, "outcome").groupBy("model_key", "condition").agg(F.count("*").alias("n"), F.count_if("outcome").alias("adopted"))


@query("STR10 STR14", cte("response") + "select record_id, sha256(concat('baseline|', model_key, '|', item_id, '|C0|v1|42')) as record_key, coalesce(split_part(concat(model_key, '|', item_id), '|', 2), '') as second from response")
def q37_record_keys(spark, sf_dir):
    d = view(spark, sf_dir, "response")
    return d.select("record_id", digest.record_key("baseline", F.col("model_key"), F.col("item_id"), "C0", "v1", 42).alias("record_key"), F.coalesce(F.element_at(text.split_key(F.concat_ws("|", "model_key", "item_id")), 2), F.lit("")).alias("second"))


@query("STR17 RUN4 RUN6", _IDENTIFIED + """
, g as (select distinct observation_id, cast('0x' || substr(sha256(prompt), 9, 4) as bigint) % 100 as share from o)
select case when share < 85 then 'answer' else 'uncertain' end as decision, cast(share as int) as confidence, count(*) as n from g group by 1, 2""")
def q38_dummy_run(spark, sf_dir):
    obs = _identified(spark, sf_dir).select("observation_id", "prompt", F.col("asserted_answer").alias("context_answer"), "memory_answer", "gold_answer", F.array().cast("array<string>").alias("gold_aliases")).dropDuplicates(["observation_id"])
    return runner.evidence_records(obs).groupBy("decision", "confidence").agg(F.count("*").alias("n"))


# ---- rates -------------------------------------------------------------------------------


@query("AGG4", cte("trial") + "select model_key, round(avg(cast(context_adopted as int)) filter (conflict_status = 'conflict'), 9) as rate, count(*) filter (conflict_status = 'conflict') as n from trial group by 1")
def q39_adoption_rate(spark, sf_dir):
    return summaries.rate(view(spark, sf_dir, "trial"), ["model_key"], F.col("context_adopted"), F.col("conflict_status") == "conflict").withColumn("rate", F.round("rate", 9))


_HARM = "knowledge_group = 'KC' and evidence_truth = 'false' and conflict_status = 'conflict'"
_CORR = "knowledge_group = 'KW' and evidence_truth = 'true' and conflict_status = 'conflict'"


@query("AGG5", cte("trial") + f"select model_key, round(avg(cast(context_adopted as int)) filter ({_HARM}), 9) as hor, count(*) filter ({_HARM}) as hor_n, round(avg(cast(context_adopted as int)) filter ({_CORR}), 9) as cor, count(*) filter ({_CORR}) as cor_n from trial group by 1")
def q40_overrides(spark, sf_dir):
    return summaries.overrides(view(spark, sf_dir, "trial"), ["model_key"]).withColumns({"hor": F.round("hor", 9), "cor": F.round("cor", 9)})


@query("AGG6", cte("trial") + f"""
select model_key, round(avg(cast(context_adopted as int)) filter ({_HARM} and source_role = 'preferred') - avg(cast(context_adopted as int)) filter ({_HARM} and source_role = 'dispreferred'), 9) as delta_harm,
       round(avg(cast(context_adopted as int)) filter ({_CORR} and source_role = 'preferred') - avg(cast(context_adopted as int)) filter ({_CORR} and source_role = 'dispreferred'), 9) as delta_correct from trial group by 1""")
def q41_override_deltas(spark, sf_dir):
    return summaries.override_deltas(view(spark, sf_dir, "trial"), ["model_key"]).withColumns({"delta_harm": F.round("delta_harm", 9), "delta_correct": F.round("delta_correct", 9)})


@query("AGG7", cte("trial") + """
select model_key, knowledge_group, condition, conflict_status, count(*) as n, round(avg(cast(context_adopted as int)), 9) as context_adoption_rate, round(avg(cast(final_correct as int)), 9) as parsed_answer_accuracy,
       round(avg(cast(decision = 'uncertain' as int)), 9) as abstention_rate from trial group by 1, 2, 3, 4""")
def q42_condition_summary(spark, sf_dir):
    s = summaries.condition_summary(view(spark, sf_dir, "trial"), ["model_key", "knowledge_group", "condition", "conflict_status"])
    return s.withColumns({c: F.round(c, 9) for c in ("context_adoption_rate", "parsed_answer_accuracy", "abstention_rate")})


@query("AGG8", cte("trial") + f"""
, g as (select m.model_key, r.source_role from (select distinct model_key from trial) m cross join (select unnest(['preferred', 'dispreferred']) as source_role) r)
select model_key, source_role, round(avg(cast(context_adopted as int)) filter ({_HARM}), 9) as hor, count(*) filter ({_HARM}) as hor_n, round(avg(cast(context_adopted as int)) filter ({_CORR}), 9) as cor, count(*) filter ({_CORR}) as cor_n
from g left join trial using (model_key, source_role) group by 1, 2""")
def q43_override_summary(spark, sf_dir):
    return summaries.override_summary(view(spark, sf_dir, "trial")).withColumns({"hor": F.round("hor", 9), "cor": F.round("cor", 9)})


@query("AGG9", cte("trial") + "select model_key, knowledge_group, evidence_truth, count(*) as n, round(avg(cast(decision = 'uncertain' as int)), 9) as abstention_rate from trial where conflict_status = 'conflict' group by 1, 2, 3")
def q44_abstention(spark, sf_dir):
    return summaries.abstention_summary(view(spark, sf_dir, "trial"), ["model_key", "knowledge_group", "evidence_truth"]).withColumn("abstention_rate", F.round("abstention_rate", 9))


@query("AGG19", cte("item") + "select relation, count(*) filter (knowledge_group = 'KC') as \"KC\", count(*) filter (knowledge_group = 'KW') as \"KW\" from item group by 1")
def q45_relation_groups(spark, sf_dir):
    return summaries.counts_by(view(spark, sf_dir, "item"), ["relation"], "knowledge_group", ["KC", "KW"])


# ---- paired comparisons ------------------------------------------------------------------

_PAIRED = cte("trial") + """
, pr as (select model_key, knowledge_group, relation, margin, item_id, bool_or(context_adopted) filter (source_role = 'preferred') as a, bool_or(context_adopted) filter (source_role = 'dispreferred') as b
         from trial where conflict_status = 'conflict' group by 1, 2, 3, 4, 5),
pp as (select * from pr where a is not null and b is not null)
"""
_CELLS = "count(*) as n, count(*) filter (a and b) as both, count(*) filter (a and not b) as a_only, count(*) filter (not a and b) as b_only, count(*) filter (not a and not b) as neither"


def _paired(spark, sf_dir):
    d = view(spark, sf_dir, "trial").where("conflict_status = 'conflict'")
    return contrasts.pair_items(d, ["model_key", "knowledge_group", "relation", "margin", "item_id"], "source_role", "context_adopted", F.lit("preferred"), F.lit("dispreferred"))


@query("JN8 AGG10", _PAIRED + f"select model_key, knowledge_group, {_CELLS} from pp group by 1, 2")
def q46_paired_cells(spark, sf_dir):
    return contrasts.cells(_paired(spark, sf_dir), ["model_key", "knowledge_group"])


# the interval and the exact p in SQL, from columns n, a_only, b_only
_Z = "1.959963984540054::double"
_SCORE = "(case when v > 0 then (b - c - n * d) / sqrt(v) when b - c - n * d > 0 then 'inf'::double when b - c - n * d < 0 then '-inf'::double else 0.0::double end)"


def _bisection(low: str, high: str, level: str) -> str:
    d = "((s.lo + s.hi) / 2)"
    q = f"({d} * (2 * n - b + c) - (b + c))"
    x = f"((-{q} + sqrt(greatest({q} * {q} + 8 * n * c * {d} * (1 - {d}), 0.0::double))) / (4 * n))"
    var = f"(n * (2 * {x} + {d} * (1 - {d})))"
    z = _SCORE.replace("v > 0", f"{var} > 0").replace("sqrt(v)", f"sqrt(greatest({var}, 0.0::double))").replace(" * d", f" * {d}")
    step = f"{{'lo': case when {z} > {level} then {d} else s.lo end, 'hi': case when {z} > {level} then s.hi else {d} end}}"
    return f"list_reduce(list_transform(range(100), lambda i: {{'lo': {low}, 'hi': {high}}}), lambda s, i: {step}, {{'lo': {low}, 'hi': {high}}})"


def _interval_sql(source: str, keys: str) -> str:
    return f"""
, w as (select {keys}, n as n0, a_only as b0, b_only as c0, cast(n as double) as n, cast(a_only as double) as b, cast(b_only as double) as c, "both" as nb from {source}),
ti as (select *, {_bisection('-1.0::double', '((b - c) / n)', _Z)} as l, {_bisection('((b - c) / n)', '1.0::double', '-' + _Z)} as u from w where n > 0),
tt as (select {keys}, n0, b0, c0, nb, round((b - c) / n, 9) as risk_difference, round((l.lo + l.hi) / 2, 9) as ci_lower, round((u.lo + u.hi) / 2, 9) as ci_upper,
       round(case when b0 + c0 = 0 then 1.0::double else least(1.0::double, 2 * list_sum(list_transform(range(least(b0, c0) + 1), lambda i: exp(lgamma(b0 + c0 + 1) - lgamma(i + 1) - lgamma(b0 + c0 - i + 1) - (b0 + c0) * ln(2))))) end, 9) as exact_p,
       round((nb + b0) / n, 9) as rate_a, round((nb + c0) / n, 9) as rate_b from ti)
"""


_REPORT = _PAIRED + f", cl as (select model_key, knowledge_group, {_CELLS} from pp group by 1, 2)" + _interval_sql("cl", "model_key, knowledge_group")


def _report(spark, sf_dir, keys=("model_key", "knowledge_group")):
    return contrasts.report(contrasts.cells(_paired(spark, sf_dir), list(keys)))


@query("MTH4 MTH5 MTH8", _REPORT + "select model_key, knowledge_group, risk_difference, ci_lower, ci_upper from tt")
def q47_tango(spark, sf_dir):
    return _report(spark, sf_dir).select("model_key", "knowledge_group", r9("risk_difference"), r9("ci_lower"), r9("ci_upper"))


@query("MTH6", _REPORT + "select model_key, knowledge_group, b0 as a_only, c0 as b_only, exact_p from tt")
def q48_exact_p(spark, sf_dir):
    return _report(spark, sf_dir).select("model_key", "knowledge_group", "a_only", "b_only", r9("exact_p"))


@query("FLT17", _REPORT + """
select model_key, knowledge_group, rate_a > 0.95 or rate_b > 0.95 as ceiling, rate_a < 0.05 or rate_b < 0.05 as floor, b0 + c0 < 5 as few_discordant,
       (rate_a > 0.95 or rate_b > 0.95 or rate_a < 0.05 or rate_b < 0.05) and b0 + c0 < 5 as saturated from tt""")
def q49_saturation(spark, sf_dir):
    return _report(spark, sf_dir).select("model_key", "knowledge_group", "diagnostics.*")


@query("AGG11 AGG12", _REPORT + "select model_key, knowledge_group, n0 as n, nb as \"both\", b0 as a_only, c0 as b_only, rate_a, rate_b, risk_difference, ci_lower, ci_upper, exact_p from tt")
def q50_contrast_report(spark, sf_dir):
    return _report(spark, sf_dir).select("model_key", "knowledge_group", "n", "both", "a_only", "b_only", *[r9(c) for c in ("rate_a", "rate_b", "risk_difference", "ci_lower", "ci_upper", "exact_p")])


@query("JN9", cte("trial") + f"""
, pr as (select model_key, item_id, bool_or(context_adopted) filter (condition in ('K1', 'K3')) as a, bool_or(context_adopted) filter (condition in ('K2', 'K4')) as b from trial group by 1, 2)
select model_key, {_CELLS} from pr where a is not null and b is not null group by 1""")
def q51_pooled_pairs(spark, sf_dir):
    return contrasts.cells(contrasts.pooled_pairs(view(spark, sf_dir, "trial"), ["model_key", "item_id"], [("KW", "K1", "K2"), ("KC", "K3", "K4")]), ["model_key"])


_BY_RELATION = _PAIRED + f", cl as (select model_key, relation, {_CELLS} from pp group by 1, 2)" + _interval_sql("cl", "model_key, relation")
_HOLM = _BY_RELATION + """
, ho as (select *, row_number() over (partition by model_key order by exact_p, relation) - 1 as i, count(*) over (partition by model_key) as m from tt),
hh as (select *, max(least((m - i) * exact_p, 1.0::double)) over (partition by model_key order by exact_p, relation rows unbounded preceding) as holm_p from ho)
"""


def _by_relation(spark, sf_dir):
    t = _report(spark, sf_dir, ("model_key", "relation")).withColumn("exact_p", F.round("exact_p", 9))
    return stats.holm(t, "exact_p", "relation", ["model_key"])


@query("WIN4", _HOLM + "select model_key, relation, exact_p, round(holm_p, 9) as holm_p from hh")
def q52_holm(spark, sf_dir):
    return _by_relation(spark, sf_dir).select("model_key", "relation", "exact_p", r9("holm_p"))


_EXCL = "not (ci_lower <= 0 and ci_upper >= 0)"
_HOLDS = "(ci_lower <= 0.2667 and ci_upper >= 0.2667)"
_SAT = "((rate_a > 0.95 or rate_b > 0.95 or rate_a < 0.05 or rate_b < 0.05) and b0 + c0 < 5)"


@query("FLT18", _BY_RELATION + f"""
select model_key, relation, case when {_SAT} or b0 + c0 < 5 or (not {_EXCL} and {_HOLDS}) then 'INCONCLUSIVE' when risk_difference > 0 and {_EXCL} and exact_p < 0.05 then (case when {_HOLDS} then 'FULL' else 'ATTENUATED' end) else 'NON-REPLICATION' end as category from tt""")
def q53_replication_class(spark, sf_dir):
    return contrasts.replication_class(_by_relation(spark, sf_dir), 0.2667).select("model_key", "relation", "category")


@query("FLT19", _HOLM + f"""
select model_key, relation, case when {_SAT} or b0 + c0 < 5 then 'INCONCLUSIVE' when risk_difference > 0 and {_EXCL} and holm_p < 0.05 then 'DIRECTIONAL EFFECT CONFIRMED' when risk_difference > 0 and {_EXCL} then 'DIRECTIONAL, NOT MULTIPLICITY-SURVIVING' else 'NON-REPLICATION' end as category from hh""")
def q54_secondary_class(spark, sf_dir):
    return contrasts.secondary_class(_by_relation(spark, sf_dir)).select("model_key", "relation", "category")


@query("AGG32", _HOLM + "select model_key, array_to_string(list_sort(coalesce(list(relation) filter (b0 + c0 < 400), [])), '|') as names from hh group by 1")
def q55_flagged_names(spark, sf_dir):
    return contrasts.flagged_names(_by_relation(spark, sf_dir), F.col("discordant_pairs") < 400, "relation", ["model_key"]).select("model_key", F.concat_ws("|", "names").alias("names"))


@query("AGG28", _PAIRED + f"""
select x.model_key, d.relation as dropped, {_CELLS} from pp x join (select distinct model_key, relation from pp) d on d.model_key = x.model_key and x.relation <> d.relation group by 1, 2""")
def q56_leave_one_out(spark, sf_dir):
    return contrasts.leave_one_out(_paired(spark, sf_dir), ["model_key"], "relation")


@query("FLT16 JN11", _PAIRED + f", i as (select distinct item_id from trial where model_key = 'R' and conflict_status = 'conflict') select model_key, {_CELLS} from pp where relation = 'country' and item_id in (select item_id from i) group by 1")
def q57_restrictions(spark, sf_dir):
    shared = view(spark, sf_dir, "trial").where("model_key = 'R' and conflict_status = 'conflict'")
    return contrasts.cells(contrasts.within(contrasts.restrict(_paired(spark, sf_dir), "relation", "country"), shared, ["item_id"]), ["model_key"])


@query("AGG17", cte("item") + _EDGES + """
, g as (select r.relation, k.knowledge_group, s.stratum from (select distinct relation from item) r cross join (select unnest(['KC', 'KW']) as knowledge_group) k cross join (select unnest(['low', 'medium', 'high']) as stratum) s)
select relation, knowledge_group, stratum, count(s.item_id) as n from g left join s using (relation, knowledge_group, stratum) group by 1, 2, 3""")
def q58_strata_grid(spark, sf_dir):
    s = strata.stratify(view(spark, sf_dir, "item"), ["relation", "knowledge_group"], "margin")
    cells = F.array(*[F.struct(F.lit(g).alias("knowledge_group"), F.lit(x).alias("stratum")) for g in ("KC", "KW") for x in strata.LABELS])
    grid = s.select("relation").distinct().select("relation", F.inline(cells))
    return strata.on_grid(s.groupBy("relation", "knowledge_group", "stratum").agg(F.count("*").alias("n")), grid, ["relation", "knowledge_group", "stratum"], ["n"])


@query("WIN7", cte("trial") + """
, q as (select model_key, quantile_cont(margin, 0.25) as q1, quantile_cont(margin, 0.5) as q2, quantile_cont(margin, 0.75) as q3, count(*) as n from trial group by 1),
b as (select trial.*, cast(margin >= q1 as int) + cast(margin >= q2 as int) + cast(margin >= q3 as int) as bin from trial join q using (model_key) where n >= 4)
select model_key, bin, count(*) as n, round(avg(margin), 6) as mean_value, round(avg(cast(context_adopted as int)), 9) as rate from b group by 1, 2""")
def q59_quantile_bins(spark, sf_dir):
    return strata.quantile_bins(view(spark, sf_dir, "trial"), ["model_key"], "margin", "context_adopted").withColumns({"mean_value": F.round("mean_value", 6), "rate": F.round("rate", 9)})


# ---- calibration -------------------------------------------------------------------------

_LABELS = "(select source_a as l from pairwise_stat union select source_b from pairwise_stat)"


@query("EXP1 EXP2", f"select a.l as source_a, b.l as source_b, o as presentation_order from {_LABELS} a join {_LABELS} b on a.l < b.l cross join (select unnest(['AB', 'BA']) as o)")
def q60_pair_enumeration(spark, sf_dir):
    d = table(spark, sf_dir, "pairwise_stat").select(F.explode(F.array("source_a", "source_b")).alias("label"))
    return expand.presentations(expand.unordered_pairs(d, [], "label")).select("source_a", "source_b", "presentation_order")


_VOTES = f"""select distinct stat_id, source_a, source_b, case {_CHOICE} when 'Choice: 1' then source_a when 'Choice: 2' then source_b end as selected_source from {{pairwise_stat}}"""


@query("AGG13", f"""with t as ({_VOTES.format(pairwise_stat='pairwise_stat')})
select source_a, source_b, count(*) as n_trials, count(selected_source) as n_valid, count(*) filter (selected_source = source_a) as a_wins, count(*) filter (selected_source = source_b) as b_wins,
       round(case when count(selected_source) > 0 then count(*) filter (selected_source = source_a) / count(selected_source) end, 9) as p_a_preferred from t group by 1, 2""")
def q61_pairwise_stats(spark, sf_dir):
    trials = spark.sql(_VOTES, pairwise_stat=table(spark, sf_dir, "pairwise_stat"))
    return calibration.pairwise_stats(trials).withColumn("p_a_preferred", F.round("p_a_preferred", 9))


_POOLED = """
with d as (select distinct stat_id, source_a, source_b, n_trials, n_valid, a_wins, b_wins from pairwise_stat where source_a <> source_b),
p as (select least(source_a, source_b) as source_a, greatest(source_a, source_b) as source_b, cast(coalesce(sum(n_trials), 0) as bigint) as n_trials, cast(coalesce(sum(n_valid), 0) as bigint) as n_valid,
      cast(coalesce(sum(case when source_a < source_b then a_wins else b_wins end), 0) as bigint) as a_wins, cast(coalesce(sum(case when source_a < source_b then b_wins else a_wins end), 0) as bigint) as b_wins from d group by 1, 2),
q as (select *, case when n_valid > 0 then a_wins / n_valid end as p_a_preferred from p)
"""


def _pooled(spark, sf_dir):
    return calibration.pooled(table(spark, sf_dir, "pairwise_stat"))


@query("AGG13", _POOLED + "select source_a, source_b, n_trials, n_valid, a_wins, b_wins, round(p_a_preferred, 9) as p_a_preferred from q")
def q62_pooled_stats(spark, sf_dir):
    return _pooled(spark, sf_dir).withColumn("p_a_preferred", F.round("p_a_preferred", 9))


@query("AGG14", _POOLED + "select source_a as source, source_b as other, round(p_a_preferred, 9) as p from q union all select source_b, source_a, round(1 - p_a_preferred, 9) from q")
def q63_preference_matrix(spark, sf_dir):
    return calibration.preference_matrix(_pooled(spark, sf_dir)).withColumn("p", F.round("p", 9))


@query("AGG15", _POOLED + """
, s as (select source_a as source, p_a_preferred as p, a_wins as w, n_valid from q where p_a_preferred is not null union all select source_b, 1 - p_a_preferred, b_wins, n_valid from q where p_a_preferred is not null)
select source, round(avg(p), 9) as mean_pairwise_preference_rate, cast(sum(w) as bigint) as wins, cast(sum(n_valid) as bigint) as total_valid_trials from s group by 1""")
def q64_source_ranking(spark, sf_dir):
    return calibration.rank_sources(_pooled(spark, sf_dir)).withColumn("mean_pairwise_preference_rate", F.round("mean_pairwise_preference_rate", 9))


@query("AGG16", _POOLED + "select count(*) as pairs, count(*) filter (n_valid > 0 and (a_wins = 0 or b_wins = 0)) as stable_pairs, count(*) filter (n_valid > 0 and a_wins = b_wins) as tied_pairs, count(*) filter (a_wins + b_wins <> n_valid) as inconsistent_rows from q")
def q65_stability(spark, sf_dir):
    return calibration.stability(_pooled(spark, sf_dir))


# ---- integrity ---------------------------------------------------------------------------


@query("JN12 SET5", """
with p as (select item_id, count(*) as planned from interim_item group by 1), r as (select item_id, count(*) as returned from baseline_record group by 1)
select item_id, coalesce(planned, 0) as planned, coalesce(returned, 0) as returned from p full join r using (item_id) where coalesce(planned, 0) <> 1 or coalesce(returned, 0) <> 1""")
def q66_bijection(spark, sf_dir):
    """Items against the responses of all runs together."""
    return verify.bijection(table(spark, sf_dir, "interim_item"), table(spark, sf_dir, "baseline_record"), "item_id")


@query("JN12 SET5", """
with d as (select distinct record_id, run_id, model_key, item_id from baseline_record),
p as (select run_id, model_key, item_id, count(*) as planned from interim_item cross join (select distinct run_id, model_key from d) group by all),
r as (select run_id, model_key, item_id, count(*) as returned from d group by all)
select run_id, model_key, item_id, coalesce(planned, 0) as planned, coalesce(returned, 0) as returned from p full join r using (run_id, model_key, item_id)
where coalesce(planned, 0) <> 1 or coalesce(returned, 0) <> 1""")
def q66_bijection_runs(spark, sf_dir):
    """Each run and model against the whole plan."""
    key = ["run_id", "model_key", "item_id"]
    d = table(spark, sf_dir, "baseline_record").select("record_id", *key).distinct()
    planned = table(spark, sf_dir, "interim_item").select("item_id").crossJoin(d.select("run_id", "model_key").distinct())
    return verify.bijection(planned, d, key)


@query("JN14", """
with b as (select distinct model_key, relation, item_id, block_no from margin_score where block_no is not null),
e as (select *, row_number() over (partition by model_key, relation, item_id order by block_no) - 1 as expected from b)
select model_key, relation, item_id, block_no, cast(expected as int) as expected from e where block_no <> expected""")
def q67_block_gaps(spark, sf_dir):
    """Blocks behind the first one in which an item wasn't scored by a model."""
    d = table(spark, sf_dir, "margin_score").where("block_no is not null")
    return verify.block_gaps(d, ["model_key", "relation", "item_id"], "block_no").withColumn("expected", F.col("expected").cast("int"))


@query("JN14", """
with b as (select distinct model_key, block_no from margin_score where block_no is not null),
e as (select *, row_number() over (partition by model_key order by block_no) - 1 as expected from b)
select model_key, block_no, cast(expected as int) as expected from e where block_no <> expected""")
def q67_block_gaps_all(spark, sf_dir):
    """Blocks behind the first one that a model lacks altogether."""
    return verify.block_gaps(table(spark, sf_dir, "margin_score").where("block_no is not null"), ["model_key"], "block_no").withColumn("expected", F.col("expected").cast("int"))


@query("VER2 VER3", """
with f as (select distinct record_id, unnest(list_filter([case when not coalesce(model_revision is not null and lower(trim(model_revision)) not in ('', 'main', 'latest', 'master', 'head'), false) then 'revision' end,
  case when not coalesce(parsed_confidence between 0 and 100, false) then 'confidence' end, case when not coalesce(received_at >= generated_at, false) then 'late' end,
  case when not coalesce(knowledge_group in ('KC', 'KW', 'excluded', 'manual_review'), false) then 'group' end], lambda x: x is not null)) as failure from baseline_record)
select record_id, failure from f""")
def q68_verify_records(spark, sf_dir):
    d = table(spark, sf_dir, "baseline_record")
    checks = {"revision": digest.is_pinned("model_revision"), "confidence": F.col("parsed_confidence").between(0, 100), "late": F.col("received_at") >= F.col("generated_at"), "group": F.col("knowledge_group").isin("KC", "KW", "excluded", "manual_review")}
    return verify.failures(d, ["record_id"], checks).distinct()


@query("SET5", "select item_id from interim_item except select item_id from baseline_record")
def q69_set_difference(spark, sf_dir):
    return verify.only_in_first(table(spark, sf_dir, "interim_item"), table(spark, sf_dir, "baseline_record"), ["item_id"])


@query("MTH1 MTH2 MTH3", "select l_orderkey, l_linenumber, round((-l_discount - l_tax - l_quantity / 50) / 3 - (-l_tax), 9) as margin, case when l_quantity > 25 then 2 else 3 end as boundary from lineitem")
def q70_margins(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    score = stats.mean_logprob(F.array(-F.col("l_discount"), -F.col("l_tax"), -F.col("l_quantity") / 50))
    prompt, full = F.array(F.lit(1), F.lit(2), F.lit(3)), F.when(F.col("l_quantity") > 25, F.array(F.lit(1), F.lit(2), F.lit(9), F.lit(4))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)))
    return d.select("l_orderkey", "l_linenumber", F.round(stats.margin(score, -F.col("l_tax")), 9).alias("margin"), stats.answer_boundary(prompt, full).cast("int").alias("boundary"))


@query("SRC12 STR15", "select 'syn-' || replace(r, ' ', '-') || '-' || printf('%04d', i) || '-' || g as item_id, r as relation, g as knowledge_group, round((i + 0.5) / 1000 * 30, 6) as parametric_margin from range(1000) t(i) cross join (select unnest(['country', 'place of birth']) as r) cross join (select unnest(['KC', 'KW']) as g)")
def q71_synthetic_pool(spark, sf_dir):
    return jsonl.baseline_pool(spark, ["country", "place of birth"], ["KC", "KW"], 1000).select("item_id", "relation", "knowledge_group", "parametric_margin")


@query("AGG26 AGG4", cte("trial") + "select condition, count(*) as n, round(avg(confidence), 9) as mean_confidence, count(*) filter (decision = 'uncertain') as abstained from trial group by 1")
def q72_confidence_by_condition(spark, sf_dir):
    return view(spark, sf_dir, "trial").groupBy("condition").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 9).alias("mean_confidence"), F.count_if(F.col("decision") == "uncertain").alias("abstained"))


# ---- classes -----------------------------------------------------------------------------


@query("FLT2 FLT3 FLT4", cte("item") + f"""
, c as (select relation, subj, count(distinct {_norm('gold_answer')}) as k from item where relation is not null and subj is not null group by 1, 2)
select item_id, case when relation in ('genre') then 'not_primary' when relation in ('father') then 'review' when relation not in ('country', 'sport', 'place of birth', 'mother') or relation is null then 'unrecognized'
       when coalesce(k, 0) > 1 then 'multi_object' else 'primary' end as status from item left join c using (relation, subj)""")
def q73_relation_policy(spark, sf_dir):
    d = ingest.with_multiplicity(view(spark, sf_dir, "item"), ["relation", "subj"], "gold_answer")
    kind = classify.by_table("relation", {"primary": ["country", "sport", "place of birth", "mother"], "review": ["father"], "not_primary": ["genre"]}, "unrecognized")
    return d.withColumn("kind", kind).select("item_id", classify.first_rule([(F.col("kind") != "primary", ""), (F.col("multi_object"), "multi_object")], "primary").alias("status"), "kind").select("item_id", F.when(F.col("status") == "", F.col("kind")).otherwise(F.col("status")).alias("status"))


_UNCERTAIN = ", ".join(_norm("'" + p.replace("'", "''") + "'") for p in classify.UNCERTAIN)


@query("FLT5 FLT9 FLT10", cte("response") + f"""
, s as (select record_id, parsed_answer, gold_answer, gold_aliases, case when parsed_answer is null or parsed_decision is null then 'malformed' when parsed_decision <> 'answer' then 'uncertain' when {_norm('parsed_answer')} in ({_UNCERTAIN}) then 'uncertain' else 'answer' end as status from response),
w as (select *, len(list_filter(regexp_split_to_array({_strip("coalesce(parsed_answer, '')")}, '{_WS}+'), lambda x: x <> '')) <= 6 and not (contains(lower(parsed_answer), ',') or contains(lower(parsed_answer), ' or ') or contains(lower(parsed_answer), ' and ')) as clean from s)
select record_id, status, case when status <> 'answer' then 'excluded' when {_norm('parsed_answer')} <> '' and list_contains({_aliases('gold_answer', 'gold_aliases')}, {_norm('parsed_answer')}) then 'KC' when clean then 'KW' else 'manual_review' end as knowledge_group from w""")
def q74_knowledge_groups(spark, sf_dir):
    d = view(spark, sf_dir, "response").withColumn("malformed", F.col("parsed_answer").isNull() | F.col("parsed_decision").isNull())
    return d.select("record_id", classify.answer_status("parsed_answer", "parsed_decision", F.col("malformed")).alias("status"), classify.knowledge_group("parsed_answer", "parsed_decision", F.col("malformed"), "gold_answer", "gold_aliases").alias("knowledge_group"))


@query("AGG33", cte("response") + "select item_id, case when count(distinct knowledge_group) = 1 then min(knowledge_group) else 'mixed:' || string_agg(distinct knowledge_group, ',' order by knowledge_group) end as reason from response group by 1")
def q75_combined_reasons(spark, sf_dir):
    return classify.combined_reason(view(spark, sf_dir, "response"), ["item_id"], "knowledge_group")


@query("RUN11 AGG11", cte("trial") + f"""
, l as (select 'corrective' as contrast, model_key, item_id, condition = 'K1' as is_a, context_adopted from trial where condition in ('K1', 'K2') and conflict_status = 'conflict'
        union all select 'harmful', model_key, item_id, condition = 'K3', context_adopted from trial where condition in ('K3', 'K4') and conflict_status = 'conflict'
        union all select 'country only', model_key, item_id, condition = 'K1', context_adopted from trial where condition in ('K1', 'K2') and relation = 'country'),
pr as (select contrast, model_key, item_id, bool_or(context_adopted) filter (is_a) as a, bool_or(context_adopted) filter (not is_a) as b from l group by 1, 2, 3),
cl as (select contrast, {_CELLS} from pr where a is not null and b is not null group by 1)""" + _interval_sql("cl", "contrast") + "select contrast, n0 as n, b0 as a_only, c0 as b_only, risk_difference, ci_lower, ci_upper, exact_p from tt")
def q76_study_table(spark, sf_dir):
    conflict = F.col("conflict_status") == "conflict"
    specs = [{"name": "corrective", "a": "K1", "b": "K2", "where": conflict}, {"name": "harmful", "a": "K3", "b": "K4", "where": conflict}, {"name": "country only", "a": "K1", "b": "K2", "where": F.col("relation") == "country"}]
    t = classify.study_table(view(spark, sf_dir, "trial"), specs, ["model_key", "item_id"])
    return t.select("contrast", "n", "a_only", "b_only", *[r9(c) for c in ("risk_difference", "ci_lower", "ci_upper", "exact_p")])


@query("SMP7 FLT21 JN16", """
with m as (select distinct item_id from baseline_record where knowledge_group = 'KW' and item_id is not null)
select 'all' as cohort, i.item_id, case when m.item_id is not null then 'used' else i.prop end as status from interim_item i left join m using (item_id)
union all select 'named', i.item_id, i.prop from interim_item i where subj is not null""")
def q77_bundle(spark, sf_dir):
    items = table(spark, sf_dir, "interim_item").withColumn("status", F.col("prop"))
    used = table(spark, sf_dir, "baseline_record").where("knowledge_group = 'KW'")
    return classify.bundle({"all": classify.mark_listed(items, "item_id", used, "status", "used"), "named": items.where("subj is not null")}, ["item_id", "status"])


# ---- fits: no SQL ------------------------------------------------------------------------


@query("REG1 REG2")
def q80_pilot_logit(spark, sf_dir):
    # both groups assert true answers in one condition and false ones in another, so truth is crossed with the group here
    d = view(spark, sf_dir, "trial").withColumns({"evidence_truth": F.when(F.col("confidence") % 2 == 0, F.lit("true")).otherwise(F.lit("false")), "conflict_status": F.lit("conflict")})
    return regression.fit_logit(summaries.conflict_frame(d), ["model_key"], "y", regression.pilot_design())


@query("REG3 REG5")
def q81_margin_effect(spark, sf_dir):
    d = view(spark, sf_dir, "trial").where("conflict_status = 'conflict'").withColumn("y", F.col("context_adopted").cast("int"))
    return regression.fit_logit(d, ["model_key"], "y", {"intercept": F.lit(1.0), "margin": F.col("margin")}, "item_id", 10, True)


@query("REG4")
def q82_firth(spark, sf_dir):
    d = view(spark, sf_dir, "trial").withColumn("y", F.col("context_adopted").cast("int"))
    return regression.fit_firth(d, ["relation"], "y", {"intercept": F.lit(1.0), "preferred": (F.col("source_role") == "preferred").cast("double")})


@query("REG6")
def q83_source_by_strength(spark, sf_dir):
    d = view(spark, sf_dir, "trial").where("conflict_status = 'conflict'").withColumns({"y": F.col("context_adopted").cast("int"), "s": (F.col("source_role") == "preferred").cast("int")})
    return regression.source_by_strength(d, ["model_key"], "y", "margin", "s", "item_id")


@query("REG7")
def q84_model_by_source(spark, sf_dir):
    d = view(spark, sf_dir, "trial").where("conflict_status = 'conflict'").withColumns({"y": F.col("context_adopted").cast("int"), "s": (F.col("source_role") == "preferred").cast("int"), "c": F.concat_ws("|", "model_key", "item_id")})
    return regression.model_by_source(d, "y", "model_key", "s", "c")


@query("AGG29")
def q85_bootstrap(spark, sf_dir):
    return bootstrap.bootstrap_interval(contrasts.cells(_paired(spark, sf_dir), ["model_key", "knowledge_group"]), ["model_key", "knowledge_group"])


from . import artifacts, study  # noqa: E402,F401 - they register their queries here


def flagship(spark, sf_dir):
    return q50_contrast_report(spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
