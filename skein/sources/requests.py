"""Requests and answers as JSON lines: one object a line, read and written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.fusion import RRF_K
from skein.sources.tables import numbered


def with_defaults(rows: DataFrame, line: str = "line") -> DataFrame:
    """``rows`` with prompt, mode, rrf_k of the JSON object in ``line``; every field that is missing, empty, null, false or 0 has its default.

    prompt: text, else empty. mode: text, else hybrid. rrf_k: a number, or text or a truth value that is one, else RRF_K. A line
    that is no object is an empty request.
    """
    v = F.try_parse_json(F.col(line))
    kind = lambda f: F.regexp_replace(F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")), r"\(.*", "")
    text = lambda f: F.when(kind(f) == "STRING", F.nullif(F.try_variant_get(v, f"$.{f}", "string"), F.lit("")))
    k = F.when(kind("rrfK").isin("ARRAY", "OBJECT"), None).otherwise(F.trim(F.try_variant_get(v, "$.rrfK", "string")))
    k = F.when(kind("rrfK") == "BOOLEAN", F.try_variant_get(v, "$.rrfK", "boolean").cast("double")).otherwise(k.try_cast("double"))
    k = F.when((k != 0) & ~F.isnan(k), k)
    return rows.withColumns({"prompt": F.coalesce(text("prompt"), F.lit("")), "mode": F.coalesce(text("mode"), F.lit("hybrid")), "rrf_k": F.coalesce(k, F.lit(float(RRF_K)))})


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """query_id, prompt, mode, rrf_k of the objects under ``path``, one a line, with their defaults.

    Requests are numbered by prompt, mode and rrf_k.
    """
    asked = with_defaults(spark.read.text(path).withColumnRenamed("value", "line")).drop("line")
    return numbered(asked, ["prompt", "mode", "rrf_k"], "query_id")


def write_answers(answers: DataFrame, path: str) -> None:
    """One object for each answer of the query plan, its fields in camel case; null fields are written, too."""
    fields = {"success": F.lit(True), "prompt": F.col("prompt"), "mode": F.col("mode"), "context": F.col("context"), "synthesis": F.col("synthesis"), "synthesisError": F.col("synthesis_error"), "llmUsed": F.col("llm_used")}
    answers.select(F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
