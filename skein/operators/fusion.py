"""Joining ranked lists: hybrid context text, reciprocal rank fusion, rerank order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.graph import PATHS_SHOWN

RRF_K = 60


def reciprocal_rank_fusion(graph: DataFrame, vector: DataFrame, k: int | None = RRF_K, own: DataFrame | None = None) -> DataFrame:
    """query_id, rank, id, text, sources, rrf_score from ``graph`` and ``vector`` (query_id, id, text, rank).

    The score is the sum of 1 / (k + rank); of texts with one id the graph's stays; ties: the graph's order, then the vector list's.
    ``own(query_id, rrf_k)`` holds queries with a k of their own.
    """
    k = k or RRF_K
    rows = graph.select("query_id", "id", "text", "rank", F.lit(0).alias("s")).unionByName(vector.select("query_id", "id", "text", "rank", F.lit(1).alias("s")))
    each = F.lit(k)
    if own is not None:
        rows, each = rows.join(own.select("query_id", "rrf_k"), "query_id", "left"), F.coalesce(F.nullif("rrf_k", F.lit(0)), F.lit(k))
    fused = rows.groupBy("query_id", "id").agg(
        F.min(F.struct("s", "rank", "text")).alias("first"),
        F.sort_array(F.collect_set("s")).alias("found"),  # one entry a list
        F.sum(1.0 / (F.col("rank") + each)).alias("rrf_score"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), "first.s", "first.rank", "id")
    names = F.array_join(F.transform("found", lambda s: F.when(s == 0, "graph").otherwise("vector")), "+")
    return fused.select("query_id", F.row_number().over(order).alias("rank"), "id", F.col("first.text").alias("text"), names.alias("sources"), "rrf_score")


def rerank_candidates(graph: DataFrame, vector: DataFrame) -> DataFrame:
    """query_id, id, text, source, original_score, original_rank, input_seq: graph candidates, then vector candidates."""
    a = graph.select("query_id", "id", "text", F.lit("graph").alias("source"), F.lit(None).cast("double").alias("original_score"), F.col("rank").alias("original_rank"), F.col("rank").cast("long").alias("input_seq"))
    b = vector.select("query_id", "id", "text", F.lit("vector").alias("source"), F.col("similarity").alias("original_score"), F.col("rank").alias("original_rank"), (F.col("rank") + F.lit(1 << 32)).cast("long").alias("input_seq"))
    return a.unionByName(b)


def rerank_score(raw: Column) -> Column:
    """The number in the field ``score`` of a JSON answer, within 0..10; null if there is none."""
    v = F.try_parse_json(raw)
    text = F.try_variant_get(v, "$.score", "string")
    number = F.when(F.trim(text) == "", 0.0).otherwise(F.try_variant_get(v, "$.score", "double"))
    number = F.when(F.is_variant_null(F.try_variant_get(v, "$.score", "variant")), 0.0).otherwise(number)
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), F.greatest(F.lit(0.0), F.least(F.lit(10.0), number)))


def rerank_order(candidates: DataFrame, score: str = "llm_score") -> DataFrame:
    """``candidates`` with new_rank, rank_delta (against the rank in its own list) and input_rank_delta (against the joint list).

    By score, highest first; candidates without one come last by their old rank; ties in input order.
    """
    order = [F.desc_nulls_last(score), F.when(F.col(score).isNull(), F.col("original_rank")).asc_nulls_first(), F.col("input_seq")]
    by = Window.partitionBy("query_id")
    out = candidates.withColumn("new_rank", F.row_number().over(by.orderBy(*order))).withColumn("_in", F.row_number().over(by.orderBy("input_seq")))
    return out.withColumn("rank_delta", F.col("original_rank") - F.col("new_rank")).withColumn("input_rank_delta", F.col("_in") - F.col("new_rank")).drop("_in")


def rerank_summary(ranked: DataFrame, score: str = "llm_score") -> DataFrame:
    """query_id, candidates_scored, candidates_failed, rank_changed, total_latency_ms (of all calls; null if none was timed)."""
    took = F.sum("latency_ms") if "latency_ms" in ranked.columns else F.lit(None).cast("double")
    return ranked.groupBy("query_id").agg(
        F.count(score).alias("candidates_scored"),
        (F.count("*") - F.count(score)).alias("candidates_failed"),
        F.bool_or(F.col("rank_delta") != 0).alias("rank_changed"),
        took.alias("total_latency_ms"),
    )


def _lines(rows: DataFrame, line: Column, order: str, out: str) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["l"]), "\n").alias(out))


def hybrid_context(prompts: DataFrame, matches: DataFrame, paths: DataFrame, vector: DataFrame) -> DataFrame:
    """query_id, context: labelled lists of themes, entities, relations and retrieved chunks.

    ``matches`` as from dual_level, ``paths`` as from relational_paths, ``vector(query_id, rank, id, text, similarity)``.
    Every list is bounded by its top-k.
    """
    high, low = matches.where("level = 'high_level'"), matches.where("level = 'low_level'")
    order = Window.partitionBy("query_id").orderBy("seq")
    shown = paths.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PATHS_SHOWN)
    dot = "• "
    theme = F.concat(F.lit(dot), "name", F.lit(": "), "description")
    entity = F.concat(F.lit(dot), "name", F.lit(" ("), "type", F.lit("): "), "description", F.lit(" ["), F.coalesce("file_location", F.lit("workspace")), F.lit("]"))
    path = F.concat(F.lit(dot + "("), "from", F.lit(") --["), "relation", F.lit("]--> ("), "to", F.lit(")"))
    chunk = F.concat(F.lit(dot), F.format_string("[sim=%.3f] (%s) ", "similarity", F.col("id").cast("string")), "text")
    parts = [("Themes", _lines(high, theme, "rank", "a")), ("Entities", _lines(low, entity, "rank", "b")), ("Relations", _lines(shown, path, "rank", "c")), ("Text chunks", _lines(vector, chunk, "rank", "d"))]
    out = prompts.select("query_id")
    for _, lines in parts:
        out = out.join(lines, "query_id", "left")
    blocks = [F.concat_ws("\n", F.lit(f"[{title}]"), F.coalesce(F.col(c), F.lit(dot + "(none)") if c == "d" else F.lit(None))) for (title, _), c in zip(parts, "abcd")]
    return out.select("query_id", F.concat_ws("\n\n", *blocks).alias("context"))


def rrf_context(fused: DataFrame) -> DataFrame:
    """query_id, block: the fused list as text."""
    line = F.concat(F.format_string("• [rrfScore=%.5f, sources=%s] ", "rrf_score", "sources"), "text")
    return _lines(fused, line, "rank", "block")


def rerank_context(ranked: DataFrame, score: str = "llm_score") -> DataFrame:
    """query_id, block: the reranked list as text, with each candidate's move."""
    label = F.when(F.col(score).isNull(), F.lit("FAILED")).otherwise(F.concat(F.lit("score="), F.regexp_replace(F.col(score).cast("string"), r"\.0$", ""), F.lit("/10")))
    move = F.when(F.col("rank_delta") > 0, F.concat(F.lit("▲"), "rank_delta")).when(F.col("rank_delta") < 0, F.concat(F.lit("▼"), F.abs("rank_delta"))).otherwise("=")
    line = F.concat(F.lit("• ["), label, F.format_string(", rank %d was %d ", "new_rank", "original_rank"), move, F.format_string(", source=%s] ", "source"), "text")
    return _lines(ranked, line, "new_rank", "block")
