"""Domain views over the given tables, one SQL text for both engines.

A text names its tables in braces; Spark gets DataFrames for them, other engines the names.
"""

from __future__ import annotations

import re

from ..session import table

RELATIONS = {"STANDARD": "country", "PROMO": "sport", "SMALL": "place of birth", "LARGE": "mother", "ECONOMY": "genre", "MEDIUM": "father"}
_RELATION = "case split_part(p_type, ' ', 1) " + " ".join(f"when '{k}' then '{v}'" for k, v in RELATIONS.items()) + " end"

VIEWS = {
    # one screened item for each part
    "item": f"""
select cast(p_partkey as string) as item_id, {_RELATION} as relation, case when p_size % 2 = 0 then 'KC' else 'KW' end as knowledge_group,
       concat(p_name, ' ', cast(p_size as string)) as subj, p_brand as gold_answer, p_name as memory_answer, concat(p_brand, '-foil') as foil_answer,
       cast(cast(round(p_retailprice * 100) as bigint) % 3000 as double) / 100 as margin, p_size
from {{part}}""",
    # one trial for each model, item and source role
    "trial": f"""
select l_returnflag as model_key, cast(l_partkey as string) as item_id, case when p_size % 2 = 0 then 'KC' else 'KW' end as knowledge_group, {_RELATION} as relation,
       case when l_linestatus = 'O' then 'preferred' else 'dispreferred' end as source_role,
       case when p_size % 2 = 0 then (case when l_linestatus = 'O' then 'K3' else 'K4' end) else (case when l_linestatus = 'O' then 'K1' else 'K2' end) end as condition,
       case when p_size % 2 = 0 then 'false' else 'true' end as evidence_truth,
       case when p_size % 10 = 0 then 'agreement' else 'conflict' end as conflict_status,
       cast(cast(round(p_retailprice * 100) as bigint) % 3000 as double) / 100 as margin,
       sum(cast(round(l_discount * 100) as bigint)) >= 5 * count(*) as context_adopted,
       cast(sum(cast(l_quantity as bigint)) as bigint) % 3 = 0 as final_correct,
       case when cast(sum(cast(l_quantity as bigint)) as bigint) % 7 = 0 then 'uncertain' else 'answer' end as decision,
       cast(cast(sum(cast(l_quantity as bigint)) as bigint) % 101 as int) as confidence
from {{lineitem}} join {{part}} on l_partkey = p_partkey
group by l_returnflag, l_partkey, l_linestatus, p_size, p_type, p_retailprice""",
    # one response for each record, a record delivered twice counting once
    "response": """
select distinct record_id, run_id, model_key, item_id, subject, relation, gold_answer, gold_aliases, raw_generation, parsed_answer, parsed_decision, parsed_confidence,
       knowledge_group, baseline_correct
from {baseline_record}""",
    # one margin for each score
    "margin": """
select distinct score_id, item_id, relation, model_key, knowledge_group, block_no, parametric_margin as margin
from {margin_score} where parametric_margin is not null and not isnan(parametric_margin)""",
}


def view(spark, sf_dir: str, name: str):
    """A view as a DataFrame."""
    text = VIEWS[name]
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in names})


def cte(*names: str) -> str:
    """The views as the beginning of a query."""
    return "with " + ",\n".join(f"{n} as ({re.sub(r'{(\w+)}', lambda m: m.group(1), VIEWS[n])})" for n in names) + "\n"
