"""Queries over the test tables by name; each takes (spark, folder) and has flat, uniquely named columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import tables
from skein.functions import text as T
from skein.functions import vector as V
from skein.functions.embed import embed, embedding_rows
from skein.operators import evaluate, fusion, graph, ingest, knn, proximity
from skein.plans import retrieval
from skein.sources import clients, exchange, ledger, requests
from skein.sources.tables import read_table, settled, shared_folder

DIMENSIONS = 64  # of the embeddings table
PROMPTS = [
    (0, "Which small ring does Supplier#000000007 send to ASIA or EUROPE?"),
    (1, "red RED widget nation_1"),
    (2, "zz q"),
    (3, "tell me about the blue bolt and economy parts in AMERICA"),
]
SIGNATURE_SQL = (
    "named_struct('name', 'answering', 'description', 'Answer the turn', "
    "'inputs', array(named_struct('field', 'question', 'type', 'string', 'desc', 'what was said')), "
    "'outputs', array(named_struct('field', 'the', 'type', 'string', 'desc', 'an article'), named_struct('field', 'Json', 'type', '{kind}', 'desc', cast(null as string))))"
)


def prompts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROMPTS, "query_id long, prompt string")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Parts and suppliers as entities, nations and regions as themes."""

    def of(table: str, base: int, kind: str, level: str, key: str, name: str, description: str, tags: str) -> DataFrame:
        return read_table(spark, sf, table).selectExpr(
            f"cast({base} + {key} as long) as seq", f"concat('{table}-', {key}) as id", f"{name} as name", f"'{kind}' as type",
            f"'{level}' as level", f"{description} as description", "cast(null as string) as file_location", f"{tags} as tags",
        )

    none = "cast(array() as array<string>)"
    return (
        of("part", 0, "database", "low_level", "p_partkey", "p_name", "concat(p_brand, ' ', p_type)", "array(p_type)")
        .unionByName(of("supplier", 10**12, "database", "low_level", "s_suppkey", "s_name", "'supplier of parts'", none))
        .unionByName(of("nation", 2 * 10**12, "theme", "high_level", "n_nationkey", "n_name", "'a nation'", none))
        .unionByName(of("region", 3 * 10**12, "theme", "high_level", "r_regionkey", "r_name", "'a region of nations'", none))
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """part supplied_by supplier, supplier belongs_to nation, nation belongs_to region."""
    pick = lambda df, s, t, a, b, r, base: df.select(
        (F.col(s).cast("long") * 1_000_000_000 + F.col(t) + base).alias("seq"),
        F.concat_ws("-", F.lit(a), F.col(s).cast("string")).alias("source"),
        F.concat_ws("-", F.lit(b), F.col(t).cast("string")).alias("target"),
        F.lit(r).alias("relation"),
        F.lit(1.0).alias("weight"),
    )
    supplied = read_table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return (
        pick(supplied, "l_partkey", "l_suppkey", "part", "supplier", "supplied_by", 0)
        .unionByName(pick(read_table(spark, sf, "supplier"), "s_suppkey", "s_nationkey", "supplier", "nation", "belongs_to", 1 << 60))
        .unionByName(pick(read_table(spark, sf, "nation"), "n_nationkey", "n_regionkey", "nation", "region", "belongs_to", 1 << 61))
    )


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return v, v.where("id % 20 = 0").select(F.col("id").alias("q_id"), F.col("v").alias("q"))


def cosine_knn(spark, sf):
    return knn.knn(*_vectors(spark, sf), k=5).withColumnRenamed("id", "vec_id")


def proximity_links(spark, sf):
    """The lists of a proximity graph over all vectors; approximate, so without SQL."""
    return proximity.build(_vectors(spark, sf)[0]).edges().withColumnsRenamed({"node": "vec_id", "neighbour": "neighbour_id"})


def proximity_knn(spark, sf):
    """The queries of ``cosine_knn`` asked of a proximity graph; approximate, so without SQL."""
    v, q = _vectors(spark, sf)
    return proximity.search(proximity.build(v), q, k=5, ef=128, width=64).withColumnRenamed("id", "vec_id")


def l2_normalize(spark, sf):
    v, _ = _vectors(spark, sf)
    return v.select(F.col("id").alias("vec_id"), F.posexplode(V.l2_normalize(F.col("v"))).alias("pos", "val")).withColumn("val", F.col("val") + 0.0)


def index_stats_layers(spark, sf):
    return knn.level_counts(_vectors(spark, sf)[0], "id")


def upsert_latest(spark, sf):
    return knn.upsert_latest(read_table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


def _chunk_rows(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "chunk_index", "char_count", F.md5("text").alias("text_md5"))


def chunk_sentences(spark, sf):
    return _chunk_rows(ingest.chunks(read_table(spark, sf, "documents"), "doc_id", "text"))


def chunk_paragraphs(spark, sf):
    docs = read_table(spark, sf, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return _chunk_rows(ingest.chunks(docs, "doc_id", "text", "paragraph"))


def sql_sentence_chunks(spark, sf):
    """The chunks of ``chunk_sentences``, asked for in SQL."""
    tables.register(spark)
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return spark.sql("select d.doc_id, c.chunk_index, c.char_count, md5(c.text) as text_md5 from {docs} d, lateral sentence_chunks(d.text, 800) c", docs=docs)


def sql_paragraph_chunks(spark, sf):
    tables.register(spark)
    docs = read_table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return spark.sql("select d.doc_id, c.chunk_index, c.char_count, md5(c.text) as text_md5 from {docs} d, lateral paragraph_chunks(d.text) c", docs=docs)


def fnv_hash_words(spark, sf):
    words = read_table(spark, sf, "documents").select(F.explode(T.embed_tokens(F.col("text"))).alias("word")).distinct()
    h = words.select("word", V.fnv1a(F.col("word")).alias("h"))
    return h.select("word", "h", (F.abs("h") % V.DIMENSIONS).cast("int").alias("bucket"), F.when(F.col("h") > 0, 1).otherwise(-1).alias("sign"))


def hash_embedding(spark, sf):
    return embedding_rows(read_table(spark, sf, "documents"), "doc_id")


def text_knn(spark, sf):
    docs = embed(read_table(spark, sf, "documents").select("doc_id", "text"), out="v").select(F.col("doc_id").alias("id"), "v")
    asked = embed(read_table(spark, sf, "benchmark").select("item_id", "text"), out="q").select(F.col("item_id").alias("q_id"), "q")
    return knn.knn(docs, asked, k=4).select("q_id", "rank", F.col("id").alias("doc_id"), "similarity")


def keyword_scores(spark, sf):
    return graph.keyword_scores(nodes(spark, sf), prompts(spark)).select("query_id", "id", "score")


def dual_level_topk(spark, sf):
    return graph.dual_level(nodes(spark, sf), prompts(spark)).select("query_id", "level", "rank", "id", "score", "is_fallback")


def relational_paths(spark, sf):
    found = graph.dual_level(nodes(spark, sf), prompts(spark))
    return graph.relational_paths(edges(spark, sf), found).select("query_id", F.col("from").alias("src"), F.col("to").alias("dst"), "relation")


def laid_out_paths(spark, sf):
    """The same paths with the graph laid out first: nodes by trigram, edges by either end."""
    every, p = nodes(spark, sf), prompts(spark)
    found = graph.dual_level(every, p, graph.trigram_index(every))
    return graph.relational_paths(graph.lay_out_edges(edges(spark, sf)), found).select("query_id", F.col("from").alias("src"), F.col("to").alias("dst"), "relation")


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes named by the first two words of a turn: names that conversations do mention."""
    first = F.regexp_extract("text", r"^(\S+ \S+)", 1)
    rows = _turns(spark, sf).where("turn = 0").select(F.col("conv_id").alias("seq"), F.concat(F.lit("title-"), "conv_id").alias("id"), first.alias("name"))
    return rows.unionByName(_turns(spark, sf).where("turn = 1").select((F.col("conv_id") + 10**9).alias("seq"), F.concat(F.lit("word-"), "conv_id").alias("id"), F.regexp_extract("text", r"^(\S+)", 1).alias("name")))


def _spoken(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select(F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), "text")


def mentions(spark, sf):
    return graph.mentions(_spoken(spark, sf), _titles(spark, sf)).withColumnsRenamed({"start": "start_char", "end": "end_char"})


def slugify_names(spark, sf):
    of = lambda t, k, n: read_table(spark, sf, t).select(F.lit(t).alias("kind"), F.col(k).cast("long").alias("key"), T.slugify(F.col(n)).alias("slug"))
    return of("part", "p_partkey", "p_name").unionByName(of("supplier", "s_suppkey", "s_name")).unionByName(of("customer", "c_custkey", "c_name"))


def merge_nodes(spark, sf):
    every = nodes(spark, sf)
    new, _ = graph.merge_nodes(every.where("type = 'theme'"), every.where("type = 'database'"), "tables")
    return new.select("seq", "id", "name", "file_location")


def _relations(spark, sf) -> DataFrame:
    li = read_table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("seq"), "l_partkey", "l_suppkey", F.col("l_discount").cast("double").alias("weight"))
    part = read_table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.upper("p_name").alias("source"))
    supp = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit(" "), "s_name").alias("target"))
    return li.join(part, "l_partkey").join(supp, "l_suppkey").select("seq", "source", "target", F.lit("supplied_by").alias("relation"), "weight")


def merge_edges(spark, sf):
    return graph.merge_edges(nodes(spark, sf), edges(spark, sf), _relations(spark, sf)).select("source", "target", "relation", "weight")


def _lists(spark, sf, k) -> tuple[DataFrame, DataFrame]:
    v, q = _vectors(spark, sf)
    shape = lambda df, *more: df.select(F.col("q_id").alias("query_id"), "id", F.concat(F.lit("v"), "id").alias("text"), "rank", *more)
    return shape(knn.knn(v, q, k)), shape(knn.quantized_search(v, q, k), F.col("score").alias("similarity"))


def rrf_fusion(spark, sf):
    a, b = _lists(spark, sf, 20)
    return fusion.reciprocal_rank_fusion(a, b).select("query_id", "rank", F.col("id").alias("vec_id"), "sources", F.round("rrf_score", 6).alias("rrf_score"))


def rerank_order(spark, sf):
    return _reranked(spark, sf).select("query_id", F.col("id").alias("vec_id"), "source", "original_rank", "llm_score", "new_rank", "rank_delta")


def hybrid_context_text(spark, sf):
    p = prompts(spark)
    found = graph.dual_level(nodes(spark, sf), p)
    docs = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = embed(p.withColumnRenamed("prompt", "text"), out="q").select(F.col("query_id").alias("q_id"), "q")
    near = knn.knn(embed(docs, out="v"), asked, 4).withColumnRenamed("q_id", "query_id").join(docs, "id")
    return fusion.hybrid_context(p, found, graph.relational_paths(edges(spark, sf), found), near)


def rrf_block(spark, sf):
    return fusion.rrf_context(fusion.reciprocal_rank_fusion(*_lists(spark, sf, 20)))


def _reranked(spark, sf):
    score = F.when(F.col("id") % 7 > 0, (F.col("id") % 11).cast("double"))
    return fusion.rerank_order(fusion.rerank_candidates(*_lists(spark, sf, 6)).withColumn("llm_score", score))


def rerank_block(spark, sf):
    return fusion.rerank_context(_reranked(spark, sf))


def rerank_tally(spark, sf):
    return fusion.rerank_summary(_reranked(spark, sf)).drop("total_latency_ms")


def rerank_calls(spark, sf):
    """A model stands in that rates a passage by its characters, out of range or without JSON at times."""
    candidates = fusion.rerank_candidates(*_lists(spark, sf, 6))
    asked = candidates.select("query_id").distinct().select("query_id", F.concat(F.lit("question "), "query_id").alias("prompt"))

    def rate(system: str, user: str) -> str:
        n = sum(map(ord, user.split("Passage: ")[1])) % 14
        return "no rating" if n == 13 else f'{{"score": {n}}}'

    return clients.rerank_calls(candidates, asked, clients.CannedChat(rate)).select("query_id", F.col("id").alias("vec_id"), "source", "llm_score", F.col("rerank_error").isNotNull().alias("failed"))


def rerank_scores(spark, sf):
    raw = """case p_partkey % 7 when 0 then '{"score": 12}' when 1 then '{"score": -1}' when 2 then '{"score": "7"}' when 3 then 'none'
      when 4 then '{}' when 5 then '{"score": null}' else concat('{"score": ', p_partkey % 11, '.5}') end"""
    return read_table(spark, sf, "part").selectExpr("p_partkey", f"{raw} as raw").select("p_partkey", fusion.rerank_score(F.col("raw")).alias("score"))


def hyde_search_text(spark, sf):
    """A model stands in that writes a turn in capitals, nothing for some and fails for others; by length, so that letters need no rule."""

    def write(system: str, user: str) -> str:
        if len(user) % 5 == 0:
            raise TimeoutError("no answer")
        return " " if len(user) % 5 == 1 else f" {len(user)} characters "

    asked = _turns(spark, sf).select((F.col("conv_id") * 100_000 + F.col("turn")).alias("query_id"), F.col("text").alias("prompt"))
    return clients.hypothetical_documents(asked, clients.CannedChat(write)).select("query_id", F.md5("search_text").alias("search_md5"), "hyde_error")


def ledger_answers(spark, sf):
    """Every turn asked of a model through a ledger: equal texts are one call. The model stands in and fails for some lengths."""

    def count(system: str, user: str) -> str:
        if len(user) % 7 == 0:
            raise TimeoutError("no answer")
        return f"{len(user)} characters"

    calls = ledger.Ledger(spark, f"{shared_folder(spark)}/skein-ledger-{uuid.uuid4().hex}", every=1024)
    made = ledger.ask_once(_turns(spark, sf).select("conv_id", "turn", "text"), calls, clients.CannedChat(count), "Count", "text")
    return made.select("conv_id", "turn", "answer", "error")


def exchanged_requests(spark, sf):
    """Every turn as a request: written and read back as JSON lines, false fields with their defaults."""
    exchange.register(spark)
    folder = f"{shared_folder(spark)}/skein-exchange-{uuid.uuid4().hex}"
    mode = F.when(F.col("role") == "user", F.lit("")).otherwise("keyword")
    _turns(spark, sf).select("conv_id", "turn", F.col("text").alias("prompt"), mode.alias("mode"), (F.col("turn") % 3 * 10).alias("rrfK")).write.format("exchange").mode("append").save(folder)
    back = spark.read.format("exchange").schema("conv_id long, turn long, line string").load(folder)
    return requests.with_defaults(back).select("conv_id", "turn", "mode", "rrf_k", F.md5("prompt").alias("prompt_md5"))


def extract_graph(spark, sf):
    """Every paragraph chunk asked for entities; the model stands in, answers by the chunk's length, fails or gives no JSON at times."""

    def extract(system: str, user: str) -> str:
        n = len(user)
        if n % 5 == 0:
            raise TimeoutError("no answer")
        if n % 5 == 1:
            return "no JSON"
        return f'{{"entities": [{{"name": " Entity {n} ", "type": "api"}}, {{"name": "Other"}}], "relations": [{{"source": "other", "target": "OTHER", "weight": {n % 4}}}]}}'

    docs = read_table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    got = ingest.extract_graph(docs, "doc_id", "text", clients.CannedChat(extract))
    return got.select("doc_id", "chunk_index", "error", F.col("entities")[0]["name"].alias("first_name"), F.size("entities").alias("n_entities"), F.get("relations", F.lit(0))["weight"].alias("weight"))


def compile_gain(spark, sf):
    """Signatures compiled with a model that echoes a prompt, fails for some, and answers compiled prompts in their form."""

    def say(system: str, user: str) -> str:
        if not user.startswith("[Signature:"):
            if len(user) % 3 == 0:
                raise TimeoutError("no answer")
            return user
        if len(user.rsplit("\n\n[Input]\n", 1)[1].rsplit("\n\n", 1)[0]) % 2:
            raise TimeoutError("no answer")
        return '{"the": 1, "Json": 2}'

    rows = _turns(spark, sf).select("conv_id", "turn", _signature("json").alias("signature"), F.col("text").alias("prompt"))
    return evaluate.compile_signature(rows, clients.CannedChat(say)).select("conv_id", "turn", "live", "base_score", "compiled_score", "gain")


def answered_requests(spark, sf):
    """Every prompt in every mode through the whole query plan, half of them with a k of their own.

    A model stands in: it writes a prompt in capitals for the passage (which has the prompt's own vector), rates by length, and answers with
    a length.
    """

    def say(system: str, user: str) -> str:
        if system == clients.HYDE_PROMPT:
            return user.upper()
        if system == clients.RERANK_PROMPT:
            return f'{{"score": {len(user.split("Passage: ", 1)[1]) % 11}}}'
        return str(len(user))

    docs = settled(embed(read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")), "chunks")
    rows = [(i + 10 * m, text, mode, 10.0 if i % 2 else 0.0) for m, mode in enumerate(retrieval.MODES) for i, text in PROMPTS]
    asked = spark.createDataFrame(rows, "query_id long, prompt string, mode string, rrf_k double")
    made = retrieval.answer_requests(asked, nodes(spark, sf), edges(spark, sf), docs, clients.CannedChat(say))
    return made.select("query_id", "mode", F.md5("context").alias("context_md5"), "synthesis", "synthesis_error", "llm_used")


def draft_target_rates(spark, sf):
    a = _turns(spark, sf).select("conv_id", "turn", F.col("text").alias("draft_text"), (F.length("text") % 50 + 1).cast("double").alias("draft_tps"))
    b = _turns(spark, sf).select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target_text"), F.lit(7.0).alias("target_tps"))
    made = evaluate.draft_target(a.join(b, ["conv_id", "turn"]))
    return made.select("conv_id", "turn", "speedup", "acceptance", F.md5("draft_preview").alias("draft_md5"), F.md5("target_preview").alias("target_md5"))


def merge_tally(spark, sf):
    """One row: what a merge adds and what the graph holds then."""
    every = nodes(spark, sf)
    after, joined, tally = graph.merge(every.where("type = 'theme'"), edges(spark, sf), every.where("type = 'database'"), _relations(spark, sf))
    return tally.crossJoin(after.agg(F.count("*").alias("n_nodes"))).crossJoin(joined.agg(F.count("*").alias("n_edges")))


def ingest_report(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 10 > 0, F.col("text")).otherwise(" ").alias("text"))
    return ingest.ingest_documents(docs, "doc_id", "text", nodes(spark, sf), edges(spark, sf))["report"]


def tq_compress(spark, sf):
    return knn.compress(_vectors(spark, sf)[0], DIMENSIONS).select(F.col("id").alias("vec_id"), "data", "residual_bits", "norm", "ratio")


def tq_search(spark, sf):
    return knn.quantized_search(*_vectors(spark, sf)).withColumnRenamed("id", "vec_id")


RAW_SQL = """concat('{"entities":[{"name":"  ', p_name, '","type":"', case p_partkey % 3 when 0 then 'theme' when 1 then 'zzz' else 'api' end,
  '","level":', case p_partkey % 2 when 0 then '"high_level"' else '5' end, ',"description":', case p_partkey % 5 when 0 then '7' else '"d"' end,
  ',"tags":["a",1,"b"]},{"name":', case p_partkey % 4 when 0 then '3' else '"second"' end, '}', case p_partkey % 10 when 0 then ']' else ']}' end)"""


def validate_extraction(spark, sf):
    raw = read_table(spark, sf, "part").selectExpr("p_partkey as chunk_index", f"{RAW_SQL} as raw")
    checked = ingest.validate_extraction(raw)
    rows = checked.select(F.col("chunk_index").cast("long").alias("chunk_index"), "error", F.explode_outer("entities").alias("e"))
    return rows.select("chunk_index", "error", "e.name", "e.type", "e.level", "e.description", F.array_join("e.tags", ",").alias("tags"))


RELATIONS_SQL = """concat('{"entities":[{"name":"', p_name, '"},{"name":" second "}],"relations":[{"source":"', upper(p_name), '","target":"Second","relation":" ","weight":',
  case p_partkey % 3 when 0 then '2' when 1 then '0.25' else '"x"' end, '},{"source":"', p_name, '","target":"missing"},{"source":"second","target":"', p_name, '","relation":" r ","weight":1},{"target":"second"}',
  case p_partkey % 10 when 0 then ']' else ']}' end)"""


def validate_relations(spark, sf):
    raw = read_table(spark, sf, "part").selectExpr("p_partkey as chunk_index", f"{RELATIONS_SQL} as raw")
    rows = ingest.listed_rows(ingest.validate_extraction(raw), "chunk_index", "relations")
    return rows.select(F.col("chunk_index").cast("long").alias("chunk_index"), "item.*")


def _turns(spark, sf) -> DataFrame:
    return read_table(spark, sf, "conversations")


def token_overlap(spark, sf):
    a = _turns(spark, sf).select("conv_id", "turn", "text")
    b = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", T.token_overlap(F.col("text"), F.col("reply")).alias("rate"))


def _signature(kind: str):
    return F.expr(SIGNATURE_SQL.format(kind=kind))


def adherence_score(spark, sf):
    t = _turns(spark, sf)
    one = lambda kind: t.select("conv_id", "turn", F.lit(kind).alias("kind"), evaluate.adherence(_signature(kind), F.col("text")).alias("score"))
    return one("string").unionByName(one("json"))


def offline_prompt_score(spark, sf):
    base, better = evaluate.offline_scores(F.col("text"))
    rows = _turns(spark, sf).select("conv_id", "turn", base.alias("base_score"), better.alias("compiled_score"))
    return rows.withColumn("gain", evaluate.gain(F.col("base_score"), F.col("compiled_score")))


def compiled_prompt(spark, sf):
    made = evaluate.compiled_prompt(_signature("json"), F.col("text"), F.when(F.col("role") == "user", F.col("text")))
    return _turns(spark, sf).select("conv_id", "turn", F.md5(made).alias("prompt_md5"), F.length(made).alias("n_chars"))


def status_counts(spark, sf):
    return graph.status(nodes(spark, sf), edges(spark, sf), read_table(spark, sf, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        cosine_knn, l2_normalize, index_stats_layers, upsert_latest, chunk_sentences, chunk_paragraphs, sql_sentence_chunks, sql_paragraph_chunks, fnv_hash_words, hash_embedding,
        text_knn, keyword_scores, dual_level_topk, relational_paths, laid_out_paths, mentions, slugify_names, merge_nodes, merge_edges, rrf_fusion, rerank_order,
        hybrid_context_text, rrf_block, rerank_block, rerank_tally, rerank_calls, rerank_scores, hyde_search_text, draft_target_rates, merge_tally,
        ingest_report, tq_compress, tq_search, validate_extraction, validate_relations, token_overlap, adherence_score, offline_prompt_score,
        compiled_prompt, status_counts, ledger_answers, exchanged_requests, extract_graph, compile_gain, answered_requests,
    )
}

#: Queries whose answer is approximate, so no SQL gives the same rows; tests hold them against exact search.
APPROXIMATE = {f.__name__: f for f in (proximity_links, proximity_knn)}
