"""Queries of the eight problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from . import langid, linking, mixing, packing, percentiles, ranking, textforms, truncation


def p1_found(spark, sf_dir):
    return ranking.stronger_pairs(ranking.rank_items(table(spark, sf_dir, "pairwise_stat")))


def p1_ranking(spark, sf_dir):
    return ranking.rank_items(table(spark, sf_dir, "pairwise_stat")).select("label", F.round("strength", 3).alias("strength"), "strength_rank", "comparisons", "opponents")


def p1_pair_totals(spark, sf_dir):
    return ranking.pair_totals(table(spark, sf_dir, "pairwise_stat")).select(F.col("a").alias("source_a"), F.col("b").alias("source_b"), "a_wins", "b_wins")


P1_PAIR_TOTALS_SQL = """
with d as (select distinct stat_id, source_a, source_b, a_wins, b_wins from pairwise_stat
           where source_a is not null and source_b is not null and source_a <> source_b and a_wins >= 0 and b_wins >= 0 and a_wins + b_wins > 0)
select least(source_a, source_b) as source_a, greatest(source_a, source_b) as source_b,
       cast(sum(case when source_a < source_b then a_wins else b_wins end) as bigint) as a_wins,
       cast(sum(case when source_a < source_b then b_wins else a_wins end) as bigint) as b_wins
from d group by 1, 2
"""


THIRDS = [0.1, 0.25, 1 / 3, 0.5, 2 / 3, 0.75, 0.9, 0.99]


def p4_found(spark, sf_dir):
    return percentiles.misplaced_edges(table(spark, sf_dir, "final_margin_strata"), table(spark, sf_dir, "margin_score"))


P4_FOUND_SQL = """
with m as (select distinct score_id, model_key, knowledge_group, block_no, parametric_margin as v from margin_score
           where parametric_margin is not null and not isnan(parametric_margin)),
f as (select freeze_id, model_key, knowledge_group, block_from, block_to, edges[1] as lo, edges[2] as hi from final_margin_strata),
r as (select freeze_id, count(*) as n,
             sum(case when v < lo then 1 else 0 end) as lb, sum(case when v <= lo then 1 else 0 end) as lu,
             sum(case when v < hi then 1 else 0 end) as hb, sum(case when v <= hi then 1 else 0 end) as hu
      from f join m on m.model_key = f.model_key and m.knowledge_group = f.knowledge_group and m.block_no between f.block_from and f.block_to
      group by freeze_id)
select freeze_id from r
where lb / n > 1 / 3.0 + 0.02 or lu / n < 1 / 3.0 - 0.02 or hb / n > 2 / 3.0 + 0.02 or hu / n < 2 / 3.0 - 0.02
"""


def p4_percentiles(spark, sf_dir):
    scores, groups = table(spark, sf_dir, "margin_score"), ["model_key", "knowledge_group"]
    freq = percentiles.value_frequencies(scores, groups, "parametric_margin", "score_id")
    return percentiles.percentiles(freq, groups, THIRDS, percentiles.split_points(scores, "parametric_margin")).withColumn("p", F.round("p", 6))


P4_PERCENTILES_SQL = """
with m as (select distinct score_id, model_key, knowledge_group, parametric_margin as v from margin_score
           where parametric_margin is not null and not isnan(parametric_margin)),
r as (select model_key, knowledge_group, v, row_number() over (partition by model_key, knowledge_group order by v) as rn,
             count(*) over (partition by model_key, knowledge_group) as n_values from m),
p as (select unnest([0.1, 0.25, 1.0 / 3, 0.5, 2.0 / 3, 0.75, 0.9, 0.99]::double[]) as p)
select model_key, knowledge_group, round(p, 6) as p, v as value, n_values from r join p on rn = greatest(1, ceil(p * n_values - 1e-9))
"""


def p4_range_percentiles(spark, sf_dir):
    out = percentiles.range_percentiles(table(spark, sf_dir, "final_margin_strata"), table(spark, sf_dir, "margin_score"), [1 / 3, 0.5, 2 / 3])
    return out.withColumn("p", F.round("p", 6))


P4_RANGE_PERCENTILES_SQL = """
with m as (select distinct score_id, model_key, knowledge_group, block_no, parametric_margin as v from margin_score
           where parametric_margin is not null and not isnan(parametric_margin)),
q as (select model_key, knowledge_group, block_no, v, count(*) as n from m group by all),
c as (select *, sum(n) over (partition by model_key, knowledge_group, block_no order by v) as cum,
             sum(n) over (partition by model_key, knowledge_group, block_no) as total from q),
k as (select *, greatest(1, floor(total * 0.005)) as step from c),
s as (select * from k where floor(cum / step) > floor((cum - n) / step) or cum = total),
w as (select model_key, knowledge_group, block_no, v, cum - coalesce(lag(cum) over (partition by model_key, knowledge_group, block_no order by v), 0) as mass from s),
g as (select f.freeze_id, v, sum(mass) as mass from final_margin_strata f join w on w.model_key = f.model_key and w.knowledge_group = f.knowledge_group
      and w.block_no between f.block_from and f.block_to group by all),
h as (select freeze_id, v, mass, sum(mass) over (partition by freeze_id order by v) as cum, sum(mass) over (partition by freeze_id) as total from g),
p as (select unnest([1.0 / 3, 0.5, 2.0 / 3]::double[]) as p)
select freeze_id, round(p, 6) as p, v as value, cast(total as bigint) as n_values
from h join p on greatest(1, ceil(p * total - 1e-9)) > cum - mass and greatest(1, ceil(p * total - 1e-9)) <= cum
"""


def p2_found(spark, sf_dir):
    return truncation.truncated(table(spark, sf_dir, "baseline_record")).where("cut").select("record_id").distinct()


def p2_rates(spark, sf_dir):
    return truncation.truncation_rates(truncation.truncated(table(spark, sf_dir, "baseline_record"))).withColumn("cut_rate", F.round("cut_rate", 6))


def p2_hazards(spark, sf_dir):
    feats = truncation.features(table(spark, sf_dir, "baseline_record"))
    lengths = truncation.length_table(feats).where("scope = 'run' and unit <> 'pieces'")
    return truncation.hazard_table(lengths).select("model_key", "run_id", "max_new_tokens", "unit", "length", "n", "at_risk", F.round("hazard", 9).alias("hazard"), "near_n", "near_risk")


def p2_hazards_all(spark, sf_dir):
    """Both scopes, all units, the p-value and the flag; p2_hazards is the part that its SQL covers."""
    table_ = truncation.hazard_table(truncation.length_table(truncation.features(table(spark, sf_dir, "baseline_record"))))
    cols = ["scope", "model_key", "run_id", "max_new_tokens", "unit", "length", "n", "at_risk", F.round("hazard", 9).alias("hazard"), "near_n", "near_risk"]
    return table_.select(*cols, F.round("near_hazard", 9).alias("near_hazard"), "p_value", "significant")


P2_HAZARDS_SQL = """
with d as (select distinct record_id, model_key, run_id, generation_config.max_new_tokens as max_new_tokens, raw_generation as t from baseline_record
           where record_id is not null and raw_generation is not null and trim(raw_generation, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
u as (select *, 'chars' as unit, cast(length(t) as int) as length from d union all select *, 'bytes', cast(strlen(t) as int) from d),
c as (select model_key, run_id, max_new_tokens, unit, length, count(*) as n from u group by all),
r as (select *, sum(n) over (partition by model_key, run_id, max_new_tokens, unit order by length desc) as at_risk,
             lag(length) over (partition by model_key, run_id, max_new_tokens, unit order by length) as prev from c),
f as (select * exclude (n, prev), case when pos = length then n else 0 end as n from
      (select *, unnest(range(greatest(coalesce(prev + 1, length - 5), length - 10), length + 1)) as pos from r)),
w as (select *, sum(n) over (partition by model_key, run_id, max_new_tokens, unit order by pos range between 5 preceding and 5 following) - n as near_n,
             sum(at_risk) over (partition by model_key, run_id, max_new_tokens, unit order by pos range between 5 preceding and 5 following) - at_risk as near_risk from f)
select model_key, run_id, max_new_tokens, unit, length, cast(n as bigint) as n, cast(at_risk as bigint) as at_risk, round(n / at_risk, 9) as hazard,
       cast(near_n as bigint) as near_n, cast(near_risk as bigint) as near_risk from w where pos = length
"""


def p2_hazard_tests(spark, sf_dir):
    """Every length of both scopes and all units with its hazard, its neighbours' and the outcome of the test, to nine places."""
    out = truncation.hazard_table(truncation.length_table(truncation.features(table(spark, sf_dir, "baseline_record"))))
    return out.select("scope", "model_key", "run_id", "max_new_tokens", "unit", "length", "n", "at_risk", *[F.round(c, 9).alias(c) for c in ("hazard", "near_hazard", "p_value")], "significant")


P2_HAZARD_TESTS_SQL = r"""
with d as (select distinct record_id, model_key, run_id, generation_config.max_new_tokens as max_new_tokens, raw_generation as t from baseline_record
           where record_id is not null and raw_generation is not null and trim(raw_generation, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
u as (select *, 'chars' as unit, cast(length(t) as int) as length from d union all select *, 'bytes', cast(strlen(t) as int) from d
      union all select *, 'pieces', cast(len(regexp_extract_all(t, '[\p{L}\p{N}_]{1,4}|\n|[^\p{L}\p{N}_\s\p{Z}]')) as int) from d),
c as (select 'run' as scope, model_key, run_id, max_new_tokens, unit, length, count(*) as n from u group by all
      union all select 'limit', null, null, max_new_tokens, unit, length, count(*) from u group by all),
r as (select *, sum(n) over (partition by scope, model_key, run_id, max_new_tokens, unit order by length desc) as at_risk,
             lag(length) over (partition by scope, model_key, run_id, max_new_tokens, unit order by length) as prev from c),
f as (select * exclude (n, prev), case when pos = length then n else 0 end as n from
      (select *, unnest(range(greatest(coalesce(prev + 1, length - 5), length - 10), length + 1)) as pos from r)),
w as (select *, sum(n) over (partition by scope, model_key, run_id, max_new_tokens, unit order by pos range between 5 preceding and 5 following) - n as near_n,
             sum(at_risk) over (partition by scope, model_key, run_id, max_new_tokens, unit order by pos range between 5 preceding and 5 following) - at_risk as near_risk from f),
h as (select *, n / at_risk as h, (near_n + 0.5::double) / (near_risk + 1.0::double) as h0 from w where pos = length),
p as (select *, case when h > h0 and n >= 5 then exp(-at_risk * (h * ln(h / h0) + case when h < 1 then (1 - h) * ln((1 - h) / (1 - h0)) else 0 end)) else 1.0::double end as p from h),
k as (select *, 0.01 * row_number() over (partition by scope, model_key, run_id, max_new_tokens, unit order by p, length) / count(*) over (partition by scope, model_key, run_id, max_new_tokens, unit) as cut from p),
s as (select *, max(case when p <= cut then p end) over (partition by scope, model_key, run_id, max_new_tokens, unit) as passed from k)
select scope, model_key, run_id, max_new_tokens, unit, length, cast(n as bigint) as n, cast(at_risk as bigint) as at_risk, round(h, 9) as hazard, round(h0, 9) as near_hazard, round(p, 9) as p_value, coalesce(p <= passed, false) as significant from s
"""


def p2_causes(spark, sf_dir):
    """How many responses each cause cut, per model."""
    cut = truncation.truncated(table(spark, sf_dir, "baseline_record")).where("cut")
    return cut.groupBy("model_key", "cause").agg(F.count("*").alias("responses"))


def p5_found(spark, sf_dir):
    return textforms.disguised(table(spark, sf_dir, "baseline_record"), table(spark, sf_dir, "answer_entity"))


def p5_forms(spark, sf_dir):
    names = textforms.canonical_strings(table(spark, sf_dir, "answer_entity"))
    values = table(spark, sf_dir, "baseline_record").where("parsed_answer is not null").groupBy("parsed_answer").agg(F.countDistinct("record_id").alias("records"))
    return textforms.same_form(values, "parsed_answer", "form", names)


def p3_found(spark, sf_dir):
    return linking.denoted(table(spark, sf_dir, "baseline_record"), table(spark, sf_dir, "answer_entity"))


def p3_links(spark, sf_dir):
    return linking.link_records(table(spark, sf_dir, "baseline_record"), table(spark, sf_dir, "answer_entity"))


def p3_unmatched(spark, sf_dir):
    links = p3_links(spark, sf_dir)
    return links.where("entity_id is null").groupBy("parsed_answer").agg(F.countDistinct("record_id").alias("records"))


def p8_found(spark, sf_dir):
    return langid.wrong_or_mixed(table(spark, sf_dir, "documents"))


def p8_segments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.detect(docs, langid.fit(docs)).withColumn("confidence", F.round("confidence", 6))


def p7_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))


def p7_shares(spark, sf_dir):
    targets = table(spark, sf_dir, "mix_target")
    mixed = mixing.mix(table(spark, sf_dir, "documents"), targets)
    return mixing.shares(mixed, targets).withColumns({"actual_share": F.round("actual_share", 6), "difference": F.round("difference", 6)})


def p6_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "context_budget"))


def p6_fill(spark, sf_dir):
    return packing.fill(p6_pack(spark, sf_dir)).withColumn("filled", F.round("filled", 6))


def p6_recall(spark, sf_dir):
    """What the choice of shards costs: the ten best of the whole index that the probed shards give."""
    return packing.recall(table(spark, sf_dir, "documents")).withColumn("recall", F.round("recall", 6))


def queries():
    return {"p1_found": p1_found, "p1_ranking": p1_ranking, "p1_pair_totals": p1_pair_totals, "p2_found": p2_found, "p2_rates": p2_rates, "p2_hazards": p2_hazards, "p2_hazards_all": p2_hazards_all, "p2_hazard_tests": p2_hazard_tests, "p2_causes": p2_causes, "p3_found": p3_found, "p3_links": p3_links, "p3_unmatched": p3_unmatched, "p4_found": p4_found, "p4_percentiles": p4_percentiles, "p4_range_percentiles": p4_range_percentiles, "p5_found": p5_found, "p5_forms": p5_forms, "p6_pack": p6_pack, "p6_fill": p6_fill, "p6_recall": p6_recall, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_segments": p8_segments}


def oracle_sql():
    return {"p1_pair_totals": P1_PAIR_TOTALS_SQL, "p2_hazards": P2_HAZARDS_SQL, "p2_hazard_tests": P2_HAZARD_TESTS_SQL, "p4_found": P4_FOUND_SQL, "p4_percentiles": P4_PERCENTILES_SQL, "p4_range_percentiles": P4_RANGE_PERCENTILES_SQL}
