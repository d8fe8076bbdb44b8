"""The query plan: prompts in, contexts (and answers) out, in one of seven modes.

Only the branches that a mode needs get into the plan: ``keyword`` reads no chunks, the vector modes read no graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.embed import embed, embed_remote
from skein.operators import fusion, graph
from skein.operators.knn import knn
from skein.sources.clients import ChatClient, EmbeddingClient, ask, hypothetical_documents, rerank_calls
from skein.sources.tables import settled

MODES = ("keyword", "vector", "hybrid", "hybrid_rerank", "hybrid_rrf", "vector_hyde", "hybrid_hyde")
TOP_CHUNKS = 4


def _graph(prompts: DataFrame, nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """matches and paths of any number of prompts."""
    matches = settled(graph.dual_level(nodes, prompts), "matches")
    return {"matches": matches, "paths": graph.relational_paths(edges, matches)}


def _hyde(prompts: DataFrame, client: ChatClient) -> DataFrame:
    return settled(hypothetical_documents(prompts, client), "hyde")


def _near(asked: DataFrame, chunks: DataFrame, k: int, embedder: EmbeddingClient | None) -> DataFrame:
    """The chunks nearest to ``asked(query_id, search_text)``, for any number of prompts."""
    vectors = embed(asked, "search_text", "q") if embedder is None else embed_remote(asked, embedder, "search_text", "q")
    queries = vectors.select(F.col("query_id").alias("q_id"), "q")
    near = knn(chunks.select("id", F.col("vector").alias("v")), settled(queries, "queries"), k)
    return settled(near.withColumnRenamed("q_id", "query_id").join(chunks.select("id", "text"), "id").select("query_id", "rank", "id", "text", "similarity", "distance"), "near")


def retrieve(prompts: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, mode: str = "hybrid", client: ChatClient | None = None, k: int = TOP_CHUNKS, rrf_k: int | None = None, embedder: EmbeddingClient | None = None, found: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """matches, paths, vector, context (and fused or reranked) for ``prompts(query_id, prompt)``.

    ``chunks(id, text, vector)`` with numbers or text as ids, as ``ingest_documents`` makes them; an unknown mode acts as ``hybrid``. Modes with a model need a client; where it fails the
    plain prompt is searched, and candidates without a score rank last. ``found`` holds matches, paths and vector of these prompts and
    others, where they have been looked up together.
    """
    mode = mode if mode in MODES else "hybrid"
    out: dict[str, DataFrame] = {}
    empty_matches = nodes.limit(0).withColumns({"query_id": F.lit(0).cast("long"), "rank": F.lit(0), "score": F.lit(0), "is_fallback": F.lit(False)})
    own = lambda name: found[name].join(prompts.select("query_id").distinct(), "query_id", "left_semi")
    if not mode.startswith("vector"):
        out |= _graph(prompts, nodes, edges) if found is None else {"matches": own("matches"), "paths": own("paths")}
    else:
        spark = prompts.sparkSession
        out["matches"] = spark.createDataFrame([], empty_matches.schema)
        out["paths"] = spark.createDataFrame([], "query_id long, seq long, from string, to string, relation string")
    if mode != "keyword" and found is not None:
        out["vector"] = own("vector")
    elif mode != "keyword":
        asked = prompts.select("query_id", "prompt", F.col("prompt").alias("search_text"))
        if mode.endswith("hyde"):
            asked = out["hyde"] = _hyde(prompts, client)
        out["vector"] = _near(asked, chunks, k, embedder)
    else:
        kind = chunks.schema["id"].dataType.simpleString()
        out["vector"] = prompts.sparkSession.createDataFrame([], f"query_id long, rank int, id {kind}, text string, similarity double, distance double")
    context = fusion.hybrid_context(prompts, out["matches"], out["paths"], out["vector"])
    low = out["matches"].where("level = 'low_level'").select("query_id", "id", F.concat_ws(": ", "name", "description").alias("text"), "rank")
    near = out["vector"].withColumn("id", F.col("id").cast("string"))
    block = None
    if mode == "hybrid_rrf":
        out["fused"] = fusion.reciprocal_rank_fusion(low, near, rrf_k, prompts if "rrf_k" in prompts.columns else None)
        block = fusion.rrf_context(out["fused"])
    elif mode == "hybrid_rerank":
        scored = rerank_calls(fusion.rerank_candidates(low, near), prompts, client)
        out["reranked"] = fusion.rerank_order(settled(scored, "scored"))
        out["summary"] = fusion.rerank_summary(out["reranked"])
        block = fusion.rerank_context(out["reranked"])
    if block is not None:
        context = context.join(block, "query_id", "left").select("query_id", F.concat_ws("\n\n", "block", "context").alias("context"))
    out["context"] = context
    return out


def answer(prompts: DataFrame, context: DataFrame, client: ChatClient) -> DataFrame:
    """query_id, prompt, context, synthesis, synthesis_error, llm_used."""
    rows = prompts.select("query_id", "prompt").join(context, "query_id")
    rows = rows.withColumn("_user", F.concat(F.lit("Context:\n"), "context", F.lit("\n\nQuestion: "), "prompt"))
    asked = ask(rows, client, "Answer from the context.", "_user", "synthesis")
    return asked.select("query_id", "prompt", "context", "synthesis", F.col("error").alias("synthesis_error"), F.col("synthesis").isNotNull().alias("llm_used"))


def answer_requests(requests: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, client: ChatClient, embedder: EmbeddingClient | None = None) -> DataFrame:
    """``answer`` and mode for ``requests(query_id, prompt, mode)``, and rrf_k if it is there, as ``read_requests`` gives them; an unknown mode acts as hybrid."""
    mode = F.when(F.col("mode").isin(*MODES), F.col("mode")).otherwise("hybrid")
    own = ["rrf_k"] if "rrf_k" in requests.columns else []
    # Requests are known by their row from here on: two modes may have one id with two prompts.
    asked = settled(requests.select(F.monotonically_increasing_id().alias("row"), "query_id", "prompt", mode.alias("mode"), *own), "requests")
    rows = asked.select(F.col("row").alias("query_id"), "prompt", "mode", *own)
    modes = [name for (name,) in sorted(asked.select("mode").distinct().collect())] or ["hybrid"]  # at most seven
    # Graph and chunks are read once for all requests, not once a mode.
    found: dict[str, DataFrame] = {}
    if any(not name.startswith("vector") for name in modes):
        found = _graph(rows.where(~F.col("mode").startswith("vector")).select("query_id", "prompt"), nodes, edges)
        found["paths"] = settled(found["paths"], "paths")
    if any(name != "keyword" for name in modes):
        hyde = F.col("mode").endswith("hyde")
        texts = rows.where((F.col("mode") != "keyword") & ~hyde).select("query_id", F.col("prompt").alias("search_text"))
        if any(name.endswith("hyde") for name in modes):
            texts = texts.unionByName(_hyde(rows.where(hyde).select("query_id", "prompt"), client).select("query_id", "search_text"))
        found["vector"] = _near(texts, chunks, TOP_CHUNKS, embedder)
    made = []
    for name in modes:
        some = rows.where(F.col("mode") == name).select("query_id", "prompt", *own)
        context = retrieve(some, nodes, edges, chunks, name, client, found=found)["context"]
        made.append(answer(some, context, client).withColumnRenamed("query_id", "row").withColumn("mode", F.lit(name)))
    ids = asked.select("row", "query_id")
    out = reduce(DataFrame.unionByName, made).join(ids, "row")
    return out.select("query_id", *(c for c in out.columns if c not in ("row", "query_id")))
