"""Measures on generated text: throughput and overlap of two models, adherence to a signature, prompt structure.

signature: struct<name, description, inputs array<struct<field, type, desc>>, outputs array<struct<field, type, desc>>>
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from skein.functions.text import token_overlap, trim_white
from skein.sources.clients import ChatClient, GenerateClient, ask, generate_with

PREVIEW, DEMO_CHARS = 160, 500


@F.pandas_udf(BooleanType())
def is_json(texts: pd.Series) -> pd.Series:
    """Whether each text is one JSON value and nothing else (no NaN or Infinity)."""

    def bad(_: str):
        raise ValueError

    def test(t: str | None) -> bool:
        try:
            json.loads(t or "", parse_constant=bad)
            return True
        except (ValueError, RecursionError):
            return False

    return texts.map(test)


def throughput(tokens: Column, nanoseconds: Column) -> Column:
    """Tokens a second, rounded to 2 digits; 0 if either is 0 or missing."""
    rate = F.when((tokens > 0) & (nanoseconds > 0), F.round(tokens / (nanoseconds / 1e9), 2))
    return F.coalesce(rate, F.lit(0.0))


def draft_target(runs: DataFrame) -> DataFrame:
    """speedup, acceptance and previews for draft and target runs of the same prompts.

    ``runs``: prompt columns plus draft_text, draft_tps, target_text, target_tps.
    """
    speed = F.when(F.col("target_tps") > 0, F.col("draft_tps") / F.col("target_tps")).otherwise(0.0)
    overlap = token_overlap(F.col("draft_text"), F.col("target_text"))
    return (
        runs.withColumn("speedup", F.format_string("%.2fx", speed))
        .withColumn("acceptance", F.format_string("%.1f%%", overlap * 100))
        .withColumn("draft_preview", F.substring("draft_text", 1, PREVIEW))
        .withColumn("target_preview", F.substring("target_text", 1, PREVIEW))
    )


def benchmark(prompts: DataFrame, draft: GenerateClient | ChatClient, target: GenerateClient | ChatClient) -> DataFrame:
    """Both models asked for every prompt at once; tokens a second as the models report them; errors are columns."""
    out = generate_with(prompts, {"draft": draft, "target": target})
    for name in ("draft", "target"):
        out = out.withColumn(f"{name}_tps", throughput(F.col(f"{name}_tokens"), F.col(f"{name}_seconds") * 1e9)).drop(f"{name}_seconds")
    return draft_target(out)


def adherence(signature: Column, output: Column) -> Column:
    """0 to 1: how far an output keeps to a signature's output fields and form; blank outputs get 0."""
    outputs = F.coalesce(signature["outputs"], F.array().cast("array<struct<field:string,type:string,desc:string>>"))
    text = trim_white(output)
    wants_json = F.exists(outputs, lambda o: o["type"].isin("json", "object"))
    braces = F.when(F.contains(output, F.lit("{")) & F.contains(output, F.lit("}")), 0.1).otherwise(0.0)
    form = F.when(~wants_json, 0.15).when(is_json(text), 0.3).otherwise(braces)
    named = F.size(F.filter(outputs, lambda o: F.contains(F.lower(output), F.lower(o["field"])))) * 0.1
    length = F.when((F.length(text) > 20) & (F.length(text) < 4000), 0.15).otherwise(0.0)
    fence = F.when(F.contains(output, F.lit("```")), 0.1).otherwise(0.0)
    score = F.round(F.lit(0.3) + form + named + length + fence, 3)
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def _fields(fields: Column) -> Column:
    lines = F.transform(fields, lambda f: F.concat(F.lit("  - "), f["field"], F.lit(" ("), f["type"], F.lit("): "), F.coalesce(f["desc"], F.lit(""))))
    return F.when(F.coalesce(F.size(fields), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(F.lit("  - (no fields)"))


def compiled_prompt(signature: Column, prompt: Column, demo: Column) -> Column:
    """A prompt built from a signature: task, fields, a demonstration if there is one, the task's input."""
    task = F.when(F.coalesce(signature["description"], F.lit("")) != "", F.concat(F.lit("Task: "), signature["description"]))
    shown = F.concat(F.lit("[Demonstration]\nInput: "), prompt, F.lit("\nOutput: "), F.substring(trim_white(demo), 1, DEMO_CHARS))
    blocks = [
        F.concat(F.lit("[Signature: "), F.coalesce(signature["name"], F.lit("Unnamed")), F.lit("]")),
        task,
        F.concat(F.lit("[Input fields]\n"), _fields(signature["inputs"])),
        F.concat(F.lit("[Output fields]\n"), _fields(signature["outputs"])),
        F.coalesce(shown, F.lit("[Demonstration]\n(no model answered; structure only)")),
        F.concat(F.lit("[Input]\n"), prompt),
        F.lit("Answer with the output fields only, in the types given above."),
    ]
    return F.concat_ws("\n\n", *blocks)


def gain(base: Column, compiled: Column) -> Column:
    """The change from base to compiled in percent, signed."""
    change = F.when(base > 0, (compiled - base) / base * 100).otherwise(0.0)
    return F.concat(F.when(change >= 0, "+").otherwise(""), F.format_string("%.1f%%", change))


def offline_scores(prompt: Column) -> tuple[Column, Column]:
    """(base, compiled) scores of a prompt's structure without any model: 0.3, and 0.1 each for instruction and format words."""
    # The words that count as instructions and as a form.
    steps = F.when(prompt.rlike("(?i)istruzioni|step|instructions"), 0.1).otherwise(0.0)
    form = F.when(prompt.rlike("(?i)json|output"), 0.1).otherwise(0.0)
    base = F.round(F.lit(0.3) + steps + form, 2)
    return base, F.round(base + 0.2, 2)


def compile_signature(rows: DataFrame, client: ChatClient | None = None) -> DataFrame:
    """``rows(signature, prompt, ...)`` with compiled_prompt, live, base_score, compiled_score, gain.

    With a client its answer to the plain prompt is the demonstration, and its answers to both prompts are scored; where
    it fails, the prompt's structure is scored instead and ``live`` is false. A failed second answer counts as the first.
    """
    sig, prompt = F.col("signature"), F.col("prompt")
    if client is None:
        asked = rows.withColumn("_first", F.lit(None).cast("string")).withColumn("compiled_prompt", compiled_prompt(sig, prompt, F.col("_first"))).withColumn("_second", F.lit(None).cast("string"))
    else:
        asked = ask(rows, client, "", "prompt", "_first").drop("error", "latency_ms")
        asked = asked.withColumn("compiled_prompt", compiled_prompt(sig, prompt, F.col("_first")))
        asked = ask(asked, client, "", "compiled_prompt", "_second").drop("error", "latency_ms")
    base, better = offline_scores(prompt)
    live = F.col("_first").isNotNull()
    first = adherence(sig, F.col("_first"))
    second = F.when(F.col("_second").isNotNull(), adherence(sig, F.col("_second"))).otherwise(first)
    out = asked.withColumn("live", live).withColumn("base_score", F.when(live, first).otherwise(base)).withColumn("compiled_score", F.when(live, second).otherwise(better))
    return out.withColumn("gain", gain(F.col("base_score"), F.col("compiled_score"))).drop("_first", "_second")
