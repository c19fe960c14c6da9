"""Running a text-generating function over rows that aren't done yet.

Survey operators: RUN1, RUN2, RUN4-RUN6, VER14 (by a test on imports).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.digest import dummy_choice, dummy_generation
from ..session import ship
from ..functions.text import is_match, parse_choice, parse_response, render, selected_source
from .expand import presentations, unordered_pairs
from .summaries import answer_class

#: Makes a function from prompts to texts; called once in each worker, so a model is loaded once.
Adapter = Callable[[], Callable[[pd.Series], pd.Series]]


def pending(inputs: DataFrame, done: DataFrame | None, key: str = "record_key") -> DataFrame:
    """RUN1: the rows whose key isn't recorded; of rows with one key any one, as they have one prompt."""
    rows = inputs.dropDuplicates([key])
    return rows if done is None else rows.join(done.select(key).distinct(), key, "left_anti")


def generate(inputs: DataFrame, adapter: Adapter | None = None, prompt: str = "prompt", out: str = "raw_generation") -> DataFrame:
    """RUN2, RUN4: inputs with the generated text. Without an adapter the dummy one, which stays inside the plan.

    A prompt that occurs on several rows should be made distinct before (``dedup``): Catalyst doesn't join equal calls.
    """
    if adapter is None:
        return inputs.withColumn(out, dummy_generation(prompt))
    ship(inputs.sparkSession)
    schema = T.StructType([*inputs.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = adapter()
        for b in batches:
            b[out] = call(b[prompt])
            yield b

    return inputs.mapInPandas(run, schema)


def calibration_trials(sources: DataFrame, groups: list[str], label: str, template: str, adapter: Adapter | None = None) -> DataFrame:
    """RUN5: all pairs of sources in both orders, prompted, answered and read."""
    shown = presentations(unordered_pairs(sources, groups, label))
    asked = shown.withColumn("prompt", render(template, source_1=F.col("displayed_source_1"), source_2=F.col("displayed_source_2")))
    made = asked.withColumn("raw_generation", dummy_choice("prompt")) if adapter is None else generate(asked, adapter)
    made = made.withColumn("parsed_choice", parse_choice("raw_generation"))
    return made.withColumn("selected_source", selected_source("parsed_choice", "displayed_source_1", "displayed_source_2"))


def evidence_records(plan: DataFrame, adapter: Adapter | None = None) -> DataFrame:
    """RUN6: generated, parsed and classified records of planned observations.

    plan has prompt, context_answer, memory_answer, gold_answer, gold_aliases.
    """
    made = generate(plan, adapter).withColumn("_p", parse_response("raw_generation"))
    made = made.select("*", F.col("_p.answer").alias("parsed_answer"), F.col("_p.decision").alias("decision"), F.col("_p.confidence").alias("confidence"), F.col("_p.malformed").alias("malformed")).drop("_p")
    kind = answer_class("malformed", "parsed_answer", "decision", "context_answer", "memory_answer", "gold_answer", "gold_aliases")
    made = made.withColumn("answer_class", kind)
    return made.withColumns({"context_adopted": F.col("answer_class") == "context", "final_correct": is_match("parsed_answer", "gold_answer", "gold_aliases"), "manual_review": F.col("answer_class") == "manual_review"})
