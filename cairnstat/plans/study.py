"""Queries of cohorts, groups, families and checks of a study."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import digest, text
from ..operators import classify, contrasts, dedup, expand, ingest, runner, sampling, strata, summaries, verify
from ..session import table
from .catalog import QUERIES, _BY_RELATION, _EDGES, _IDENTIFIED, EVIDENCE, _by_relation, _identified, query
from .fixtures import RELATIONS, cte, view

_PRIMARY, _REVIEW, _EXCLUDED = ["country", "sport", "genre", "father"], ["mother"], ["place of birth"]
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def _policy(spark, sf_dir):
    item = view(spark, sf_dir, "item").withColumns({"subj": F.when(F.col("p_size") % 11 != 0, F.col("subj")), "relation": F.when(F.col("p_size") % 13 != 0, F.col("relation")), "foil_answer": F.when(F.col("p_size") % 10 != 0, F.col("foil_answer"))})
    item = ingest.with_multiplicity(item, ["relation", "subj"], "gold_answer")
    group, why = classify.assigned_group("knowledge_group", "foil_answer")
    item = item.withColumns({"conflict_reason": classify.conflict_reason("relation", "subj", "multi_object", _PRIMARY, _REVIEW, _EXCLUDED), "exclusion_reason": why, "knowledge_group": group})
    return item.withColumn("eligible", classify.eligible("knowledge_group", "conflict_reason"))


_POLICY = cte("item") + f"""
, a as (select item_id, case when p_size % 13 <> 0 then relation end as relation, case when p_size % 11 <> 0 then subj end as subj, gold_answer, margin, p_size, knowledge_group as g0, case when p_size % 10 <> 0 then foil_answer end as foil from item),
k as (select relation, subj, count(distinct lower(gold_answer)) as k from a where relation is not null and subj is not null group by 1, 2),
c as (select a.*, case when relation is null then 'relation_requires_review' when relation in {_IN(_EXCLUDED)} then 'relation_not_primary_conflict' when relation in {_IN(_REVIEW)} then 'relation_requires_review'
      when relation not in {_IN(_PRIMARY)} then 'relation_unrecognized' when subj is null then 'relation_requires_review' when k > 1 then 'relation_multi_object' end as conflict_reason from a left join k using (relation, subj)),
po as (select *, case when g0 = 'KC' and foil is null then 'excluded' else g0 end as knowledge_group, case when g0 = 'KC' and foil is null then 'no_defensible_foil' end as exclusion_reason from c)
"""


@query("FLT2 FLT4 FLT9 FLT10 FLT13", _POLICY + "select item_id, knowledge_group, conflict_reason, knowledge_group in ('KC', 'KW') and conflict_reason is null as eligible, coalesce(exclusion_reason, conflict_reason) as first_reason from po")
def q100_policy(spark, sf_dir):
    return _policy(spark, sf_dir).select("item_id", "knowledge_group", "conflict_reason", "eligible", summaries.first_reason("exclusion_reason", "conflict_reason").alias("first_reason"))


@query("SMP4 JN3", cte("item") + _EDGES + """
, f as (select * from s where knowledge_group = 'KW' and relation in ('country', 'sport') and p_size % 3 <> 0),
n as (select stratum, count(*) as available from f group by 1),
g as (select b.stratum, coalesce(available, 0) as available from (values ('low'), ('medium'), ('high')) b(stratum) left join n using (stratum))
select stratum, available, least(available, 32) as selected, greatest(32 - available, 0) as shortfall, case when sum(greatest(32 - available, 0)) over () > 0 then 'ELIGIBILITY_LIMITED' else 'COMPLETE' end as state from g""")
def q101_cohort_supply(spark, sf_dir):
    s = strata.stratify(view(spark, sf_dir, "item"), ["relation", "knowledge_group"], "margin").where("knowledge_group = 'KW' and relation in ('country', 'sport')")
    used = view(spark, sf_dir, "item").where("p_size % 3 = 0").select("item_id")
    return sampling.cohort_supply(sampling.without(s, used, "item_id"), "stratum", ["low", "medium", "high"], 32).withColumns({c: F.col(c).cast("bigint") for c in ("available", "selected", "shortfall")})


@query("SMP6 JN4", """
with d as (select distinct model_key, item_id, relation from baseline_record where knowledge_group in ('KC', 'KW') and item_id is not null),
s as (select item_id, min(relation) as relation from d group by 1 having count(distinct model_key) = 4 and count(*) filter (relation is null) = 0 and min(relation) = max(relation)),
p as (select relation from (select relation, count(*) as n from s group by 1) order by n desc, relation limit 3)
select item_id, relation from s where relation in (select relation from p) qualify row_number() over (partition by relation order by sha256('42|C:' || relation || '|' || item_id), item_id) <= 20""")
def q102_shared_quota(spark, sf_dir):
    d = table(spark, sf_dir, "baseline_record").where("knowledge_group in ('KC', 'KW') and item_id is not null").select("model_key", "item_id", "relation").distinct()
    every = sampling.shared_quota(d, "item_id", "model_key", 4, "relation", [r["relation"] for r in _largest(d)], 60, 42, "C")
    return every.select("item_id", "relation")


def _largest(d):
    """The three relations with most shared items."""
    s = d.groupBy("item_id").agg(F.countDistinct("model_key").alias("m"), F.count_if(F.col("relation").isNull()).alias("z"), F.min("relation").alias("relation"), F.max("relation").alias("other")).where("m = 4 and z = 0 and relation = other")
    return s.groupBy("relation").count().orderBy(F.desc("count"), "relation").limit(3).collect()


@query("AGG27", cte("trial") + """
, e as (select *, case when margin < 5 then 'low' when margin < 10 then 'medium' end as stratum from trial),
g as (select distinct t.model_key, t.knowledge_group, b.stratum from trial t, (values ('low'), ('medium'), ('high')) b(stratum)),
n as (select model_key, knowledge_group, stratum, count(*) as trials, count(*) filter (context_adopted) as adopted from e where stratum is not null group by 1, 2, 3)
select model_key, knowledge_group, stratum, coalesce(trials, 0) as trials, coalesce(adopted, 0) as adopted, round(adopted / trials, 9) as rate from g left join n using (model_key, knowledge_group, stratum)""")
def q103_adoption_by_stratum(spark, sf_dir):
    d = view(spark, sf_dir, "trial").withColumn("stratum", F.when(F.col("margin") < 5, "low").when(F.col("margin") < 10, "medium"))
    return strata.adoption_by_stratum(d, ["model_key", "knowledge_group"], "stratum", "context_adopted").withColumn("rate", F.round("rate", 9))


@query("AGG26", """
with d as (select distinct record_id, model_key, run_id, parsed_decision, parsed_answer, gold_answer, baseline_correct, manual_review from baseline_record)
select model_key, count(*) as n, round(avg(cast(coalesce(parsed_decision = 'uncertain', false) as int)), 9) as abstention_rate, round(avg(cast(coalesce(baseline_correct, false) as int)), 9) as accuracy,
       round(avg(cast(coalesce(manual_review, false) as int)), 9) as review_rate, round(avg(cast(parsed_answer is null or parsed_decision is null as int)), 9) as parse_failure_rate,
       round(avg(cast(coalesce(parsed_decision = 'uncertain' and gold_answer <> '' and lower(trim(parsed_answer)) = lower(trim(gold_answer)), false) as int)), 9) as tentative_rate from d group by 1""")
def q104_diagnostics(spark, sf_dir):
    d = table(spark, sf_dir, "baseline_record").select("record_id", "model_key", "run_id", F.col("parsed_decision").alias("decision"), "parsed_answer", F.col("gold_answer").alias("asserted_answer"), F.col("baseline_correct").alias("final_correct"), "manual_review").distinct()
    d = d.withColumn("malformed", F.col("parsed_answer").isNull() | F.col("decision").isNull())
    out = summaries.diagnostics(d, ["model_key"])
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c.endswith("rate") or c == "accuracy"})


@query("JN15 VER11 WIN4", _BY_RELATION + f"""
, re as (select distinct tt.model_key, v.relation from tt, (values {', '.join(f"('{x}')" for x in [*RELATIONS.values(), 'religion'])}) v(relation)),
jo as (select re.model_key, re.relation, tt.exact_p, case when tt.relation is null then 'not computed' when re.relation = 'genre' then 'not eligible' when tt.exact_p is null then 'no single test statistic' else 'included' end as reason
       from re left join tt on tt.model_key = re.model_key and tt.relation = re.relation),
me as (select *, row_number() over (partition by model_key order by exact_p, relation) - 1 as i, count(*) over (partition by model_key) as m from jo where reason = 'included'),
ad as (select model_key, relation, max(least((m - i) * exact_p, 1.0::double)) over (partition by model_key order by exact_p, relation rows unbounded preceding) as holm_p from me)
select jo.model_key, jo.relation, reason = 'included' as included, reason, exact_p as p_value, round(holm_p, 9) as holm_p from jo left join ad on ad.model_key = jo.model_key and ad.relation = jo.relation""")
def q105_holm_family(spark, sf_dir):
    """A registry of every relation for each model; one is not eligible, one was never computed."""
    found = _by_relation(spark, sf_dir).drop("holm_p")
    listed = F.explode(F.array(*[F.lit(x) for x in [*RELATIONS.values(), "religion"]])).alias("relation")
    registry = found.select("model_key").distinct().select("model_key", listed).withColumn("gate_reason", F.when(F.col("relation") == "genre", "not eligible"))
    return contrasts.holm_family(registry, found, "relation", ["model_key"], "exact_p").withColumn("holm_p", F.round("holm_p", 9))


@query("FLT19", _BY_RELATION + """
select model_key, relation from tt where relation = 'sport'""")
def q106_counted_once(spark, sf_dir):
    """Contrasts that rest on another's observations have no category of their own."""
    d = _by_relation(spark, sf_dir).withColumn("counted_once_with", F.when(F.col("relation") == "sport", "country"))
    return contrasts.secondary_class(d).where("category = 'COUNTED ONCE'").select("model_key", "relation")


@query("JN5", cte("response") + """
, m as (select distinct model_key, item_id from response where knowledge_group in ('KC', 'KW') and item_id is not null),
r as (select model_key, item_id, count(*) as responses from response group by 1, 2)
select model_key, item_id, responses from m join r using (model_key, item_id)""")
def q107_member_records(spark, sf_dir):
    d = view(spark, sf_dir, "response")
    members = d.where("knowledge_group in ('KC', 'KW') and item_id is not null").select("model_key", "item_id").distinct()
    return sampling.member_records(members, d.groupBy("model_key", "item_id").agg(F.count("*").alias("responses")), ["model_key", "item_id"])


@query("JN13", """
with p as (select item_id, row_number() over (order by item_id) - 1 as position from interim_item), d as (select item_id, row_number() over (order by question, item_id) - 1 as position from interim_item)
select d.position, d.item_id as done_id, p.item_id as planned_id from d left join p using (position) where d.item_id <> p.item_id""")
def q108_prefix_breaks(spark, sf_dir):
    from pyspark.sql import Window as W

    # the item list is fixed, so one order over all of it is small
    d = table(spark, sf_dir, "interim_item").select("item_id", "question")
    at = lambda *by: (F.row_number().over(W.orderBy(*by)) - 1).cast("bigint")
    return verify.prefix_breaks(d.withColumn("position", at("question", "item_id")), d.withColumn("position", at("item_id")), "item_id", "position")


@query("VER10", _IDENTIFIED + "select item_id, condition from o where condition <> 'C0' and p_size % 10 = 0")
def q109_altered_prompts(spark, sf_dir):
    """Rendered again with another statement for some items."""
    plan = _identified(spark, sf_dir)
    answer = F.when(F.col("p_size") % 10 == 0, F.concat("asserted_answer", F.lit("!"))).otherwise(F.col("asserted_answer"))
    again = F.when(F.col("condition") == "C0", F.lit("None")).otherwise(text.render(EVIDENCE, source=F.col("source_label"), subj=F.col("subj"), asserted_answer=answer))
    return dedup.altered_prompts(plan, again).select("item_id", "condition")


@query("AGG25", _IDENTIFIED + """
, pn as (select model_key, count(distinct observation_id) as planned from o group by 1), rn as (select model_key, count(*) as recorded from o where model_key = 'm1' or condition <> 'C0' group by 1)
select model_key, planned, recorded from pn full join rn using (model_key) where planned is distinct from recorded""")
def q110_compare_counts(spark, sf_dir):
    ident = _identified(spark, sf_dir)
    planned = ident.groupBy("model_key").agg(F.countDistinct("observation_id").alias("n"))
    recorded = ident.where("model_key = 'm1' or condition <> 'C0'").groupBy("model_key").agg(F.count("*").alias("n"))
    return dedup.compare_counts(planned, recorded, "model_key", "n")


@query("SET3", cte("response") + "select distinct item_id from response where knowledge_group in ('KC', 'KW')")
def q111_in_either(spark, sf_dir):
    d = view(spark, sf_dir, "response")
    return verify.in_either(d.where("knowledge_group = 'KC'"), d.where("knowledge_group = 'KW'"), ["item_id"])


@query("EXP6 SMP1", cte("item") + """
, p as (select item_id, knowledge_group from item qualify row_number() over (partition by knowledge_group order by sha256('42|P:' || knowledge_group || '|' || item_id), item_id) <= 30)
select item_id, knowledge_group, condition from p, (values ('C0'), ('C1'), ('C2'), ('C3'), ('C4')) v(condition)""")
def q112_pilot_trials(spark, sf_dir):
    drawn = sampling.take(view(spark, sf_dir, "item"), 30, 42, "item_id", ["knowledge_group"], "P")
    return expand.conditions(drawn, expand.PILOT, {"preferred": F.lit("a"), "dispreferred": F.lit("b")}).select("item_id", "knowledge_group", "condition")


_CHOOSE = "Which source?\n1: {source_1}\n2: {source_2}\n"


@query("RUN5 STR17", """
with p as (select a.r_name as x, b.r_name as y from region a join region b on a.r_regionkey < b.r_regionkey),
s as (select x as s1, y as s2 from p union all select y, x from p),
c as (select *, case when cast('0x' || substr(sha256('Which source?' || chr(10) || '1: ' || s1 || chr(10) || '2: ' || s2 || chr(10)), 1, 8) as bigint) % 2 = 0 then 1 else 2 end as choice from s)
select s1 as displayed_source_1, s2 as displayed_source_2, cast(choice as int) as parsed_choice, case choice when 1 then s1 else s2 end as selected_source from c""")
def q113_calibration_run(spark, sf_dir):
    sources = table(spark, sf_dir, "region").select(F.lit("all").alias("g"), "r_name")
    return runner.calibration_trials(sources, ["g"], "r_name", _CHOOSE).select("displayed_source_1", "displayed_source_2", "parsed_choice", "selected_source")


@query("JN10 FLT12", cte("item", "trial") + """
select i.relation, i.knowledge_group, count(*) as n, count(*) filter (t.context_adopted) as adopted, max(i.margin) as largest_margin from trial t join item i using (item_id) where t.conflict_status = 'conflict' group by 1, 2""")
def q114_outcome_attributes(spark, sf_dir):
    outcome = summaries.conflict_only(view(spark, sf_dir, "trial").where("conflict_status = 'conflict'")).select("item_id", "context_adopted", "conflict_status")
    item = view(spark, sf_dir, "item").select("item_id", "relation", "knowledge_group", "margin")
    joined = outcome.join(item, "item_id").where("conflict_status = 'conflict'")
    return joined.groupBy("relation", "knowledge_group").agg(F.count("*").alias("n"), F.count_if("context_adopted").alias("adopted"), F.max("margin").alias("largest_margin"))


@query("FLT11", "select * from (values ('baseline_correct'), ('parsed_answer'), ('generation_config.num_beams')) v(field)")
def q115_forbidden_columns(spark, sf_dir):
    found = verify.forbidden_columns(table(spark, sf_dir, "baseline_record"), {"baseline_correct", "parsed_answer", "num_beams", "not_there"})
    return spark.createDataFrame([(x,) for x in found], "field string")


@query("FLT20", """
with d as (select distinct score_id, knowledge_group, model_key, parametric_margin from margin_score),
b as (select score_id, case when coalesce(knowledge_group not in ('KC', 'KW'), true) then 'illegal pair' when knowledge_group = 'KW' and model_key = 'cedar' and (parametric_margin is null or isnan(parametric_margin)) then 'no reason' end as breach from d)
select score_id, breach from b where breach is not null""")
def q116_status_breaks(spark, sf_dir):
    d = table(spark, sf_dir, "margin_score").select("score_id", "knowledge_group", "model_key", "parametric_margin").distinct()
    bad = F.col("parametric_margin").isNull() | F.isnan("parametric_margin")
    status = F.when((F.col("knowledge_group") == "KW") & (F.col("model_key") == "cedar"), "NOT APPLICABLE").otherwise("SECONDARY")
    d = d.withColumns({"status": status, "reason": F.when(bad, " ").otherwise("disabled")})
    legal = [(s, g) for s in ("SECONDARY", "NOT APPLICABLE") for g in ("KC", "KW")]
    return classify.status_breaks(d, "status", "knowledge_group", "reason", legal).select("score_id", "breach")


@query("REG3 REG5", "with recursive " + cte("trial")[5:] + """
, d as (select model_key, item_id, cast(context_adopted as int) as y, margin as x from trial where conflict_status = 'conflict' and margin is not null and context_adopted is not null),
st as (
  select 0 as k, model_key, 0.0::double as b0, 0.0::double as b1 from (select distinct model_key from d)
  union all
  select k + 1, model_key, b0 + (h11 * u0 - h01 * u1) / (h00 * h11 - h01 * h01), b1 + (h00 * u1 - h01 * u0) / (h00 * h11 - h01 * h01)
  from (select k, model_key, max(b0) as b0, max(b1) as b1, sum(p * (1 - p)) as h00, sum(p * (1 - p) * x) as h01, sum(p * (1 - p) * x * x) as h11, sum(y - p) as u0, sum((y - p) * x) as u1
        from (select k, st.model_key, b0, b1, x, y, 1 / (1 + exp(-(b0 + b1 * x))) as p from st join d on d.model_key = st.model_key) group by k, model_key)
  where k < 25),
f as (select d.*, b0, b1, 1 / (1 + exp(-(b0 + b1 * x))) as p from d join st on st.model_key = d.model_key and st.k = 25),
i as (select model_key, max(b0) as b0, max(b1) as b1, count(*) as n, sum(p * (1 - p)) as h00, sum(p * (1 - p) * x) as h01, sum(p * (1 - p) * x * x) as h11 from f group by 1),
c as (select model_key, item_id, sum(y - p) as s0, sum((y - p) * x) as s1 from f group by 1, 2),
m as (select model_key, count(*) as g, sum(s0 * s0) as m00, sum(s0 * s1) as m01, sum(s1 * s1) as m11 from c group by 1),
v as (select *, h11 / (h00 * h11 - h01 * h01) as a, -h01 / (h00 * h11 - h01 * h01) as b, h00 / (h00 * h11 - h01 * h01) as e, g::double / (g - 1) * (n - 1) / (n - 2) as fa from i join m using (model_key))
select model_key, 'intercept' as term, round(b0, 6) as estimate, round(sqrt(fa * (a * a * m00 + 2 * a * b * m01 + b * b * m11)), 6) as std_error, n from v
union all select model_key, 'margin', round(b1, 6), round(sqrt(fa * (b * b * m00 + 2 * b * e * m01 + e * e * m11)), 6), n from v""")
def q117_margin_estimates(spark, sf_dir):
    """Newton steps and the sandwich over items, as in q81, in places that two engines agree on."""
    return QUERIES["q81_margin_effect"](spark, sf_dir).select("model_key", "term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"), "n")


@query("REG4", cte("trial") + """
, c as (select relation, source_role = 'preferred' as s, count(*) as n, count(*) filter (context_adopted) as y from trial where context_adopted is not null and relation is not null group by 1, 2),
q as (select relation, max(case when not s then ln((y + 0.5) / (n - y + 0.5)) end) as l0, max(case when s then ln((y + 0.5) / (n - y + 0.5)) end) as l1, cast(sum(n) as bigint) as n,
      max(case when not s then (n + 1.0) * (n + 1.0) / (n * (y + 0.5) * (n - y + 0.5)) end) as v0, max(case when s then (n + 1.0) * (n + 1.0) / (n * (y + 0.5) * (n - y + 0.5)) end) as v1 from c group by 1)
select relation, 'intercept' as term, round(l0, 6) as estimate, round(sqrt(v0), 6) as std_error, n from q union all select relation, 'preferred', round(l1 - l0, 6), round(sqrt(v0 + v1), 6), n from q""")
def q118_firth_estimates(spark, sf_dir):
    """With one binary term the penalised fit has a closed form: half a case more in each cell."""
    out = QUERIES["q82_firth"](spark, sf_dir).where("relation is not null")
    return out.select("relation", "term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"), "n")
