import json
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import vector as V
from skein.functions.embed import HashEmbedder, embed, embed_remote, embedding_rows
from skein.operators import evaluate, fusion, graph, ingest, knn
from skein.plans.retrieval import MODES, answer, answer_requests, retrieve
from skein.sources.clients import CannedChat, CannedEmbed, CannedGenerate, Generation, ask, hypothetical_documents, rerank_calls
from skein.sources.requests import read_requests, write_answers
from skein.sources.tables import numbered

T_WORDS = re.compile("[^a-z0-9_]+")
QUESTION = "How does the HNSW vector index perform approximate nearest neighbor search and how does it relate to quantization?"
# Fixed test values: the question and chunk texts whose vectors and similarities are known.
CHUNKS = [
    "Speculative decoding uses a smaller draft model to predict future tokens validated in parallel by the target LLM.",
    "HNSW Hierarchical Navigable Small World graphs enable logarithmic time approximate nearest neighbor search.",
]


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.lit(v))
    return row.select(column.alias("x")).first().x


# --- text


def test_names(spark):
    assert one(spark, T.slugify(F.col("n")), n="Engine.execute() !") == "engine-execute"
    assert one(spark, T.name_key(F.col("n")), n="   Ab C\t﻿") == "ab c"
    assert one(spark, T.trigrams(F.col("n")), n="ab") == []
    assert one(spark, T.trigrams(F.col("n")), n="abcd") == ["abc", "bcd"]


def test_sentences_and_packing(spark):
    text = 'Bun.serve() starts. It uses qwen2.5:7b! "Yes" ok'
    assert one(spark, T.sentences(F.col("t")), t=text) == ["Bun.serve() starts.", "It uses qwen2.5:7b!", '"Yes" ok']
    packed = one(spark, T.sentence_chunks(F.col("t"), 20), t="Aa bb. Cc dd. Ee ff gg hh. " + "X" * 45 + ". Zz.")
    assert packed == ["Aa bb. Cc dd.", "Ee ff gg hh.", "X" * 20, "X" * 20, "X" * 5 + ".", "Zz."]
    assert one(spark, T.sentence_chunks(F.col("t")), t=" \n ") == []
    assert one(spark, T.paragraph_chunks(F.col("t"), 10), t="aaa\n\nbbb\n \nccccccc\n\n" + "d" * 12) == ["aaa\n\nbbb", "ccccccc", "d" * 10, "dd"]
    with pytest.raises(ValueError):
        T.sentence_chunks(F.col("t"), 0)


def test_packing_loses_no_characters(spark):
    rows = [(i, " ".join("Word%d %s." % (k, "x" * (k * i % 37)) for k in range(40))) for i in range(20)]
    got = ingest.chunks(spark.createDataFrame(rows, "id long, text string"), "id", "text", size=60).collect()
    for i, t in rows:
        parts = [r.text for r in sorted((r for r in got if r.id == i), key=lambda r: r.chunk_index)]
        assert "".join("".join(parts).split()) == "".join(t.split()) and max(map(len, parts)) <= 60


def test_overlap(spark):
    assert one(spark, T.token_overlap(F.col("a"), F.col("b")), a="a b c", b="A x c d") == 0.667
    assert one(spark, T.token_overlap(F.col("a"), F.col("b")), a=" ", b="A") == 0.0


# --- vectors


def test_hash_values(spark):
    want = {"hnsw": 763821949, "index": 151693739, "the": -1274105316, "vec": 1932546277, "vector": -1886787582, "a": -468965076}
    for word, h in want.items():
        assert V.fnv1a_py(word) == h and one(spark, V.fnv1a(F.col("w")), w=word) == h


def test_embedding_values():
    e = HashEmbedder(dtype=np.float32)
    v = e(CHUNKS[1])
    assert np.count_nonzero(v) == 71
    for i, x in {4: 0.073325, 21: 0.127002, 25: 0.054154, 27: -0.063501, 30: 0.176816, 36: 0.103697}.items():
        assert v[i] == pytest.approx(x, abs=1.5e-6)
    q = e(QUESTION)
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    assert round(cos(q, v), 4) == 0.2340 and round(cos(q, e(CHUNKS[0])), 4) == 0.1117
    assert not e("").any() and not e(None).any() and len(e(" ! ")) == 384


def test_relational_embedding_equals_the_other(spark):
    texts = [(0, CHUNKS[0]), (1, CHUNKS[1]), (2, ""), (3, "a a b")]
    rows = embedding_rows(spark.createDataFrame(texts, "id long, text string"), "id").collect()
    e = HashEmbedder()
    for i, t in texts:
        v = np.zeros(384)
        for r in rows:
            if r.id == i:
                v[r.dim] = r.val
        assert np.allclose(v, e(t), atol=1.1e-6)


def test_cosine_and_normal_form(spark):
    d = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0, 9.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [-2.0, 0.0])], "a array<double>, b array<double>")
    assert [r.x for r in d.select(V.cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 0.0, -1.0]
    assert d.select(V.l2_normalize(F.col("a")).alias("x")).first().x == [0.6, 0.8]


def test_quantiser_values(spark):
    x = [np.sin(20 + np.arange(64) * 0.2), np.sin(np.arange(64) * 0.2), np.zeros(64)]
    d = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>")
    r = {r.id: r for r in knn.compress(d, 64).collect()}
    assert round(r[0].norm, 4) == 5.6924 and r[0].data == "iIiHeIiIh3iIiHeIiIh3iIiId4iIiHeIiIh3iIiId4g="
    assert round(r[1].norm, 4) == 5.6051
    assert (r[0].ratio, r[0].original_kb, r[0].compressed_kb) == ("6.4x", 0.25, 0.04)
    assert r[2].norm == 1.0 and r[2].residual_bits == "1" * 64
    _, codes, bits = V.quantize(np.stack(x[:2]))
    assert (codes[1] == 0).all()
    assert V.estimate(np.stack(x[:2]), codes, bits).diagonal().tolist() == [0.3549, 0.0163]


@given(st.lists(st.floats(-5, 5), min_size=8, max_size=8))
@settings(max_examples=100, deadline=None)
def test_codes_stay_in_range(v):
    _, codes, _ = V.quantize(np.array([v]))
    assert codes.min() >= -8 and codes.max() <= 7


def test_knn_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 6))
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    q = c.where("id < 7").select(F.col("id").alias("q_id"), F.col("v").alias("q"))
    whole = knn.knn(c, q, 3).orderBy("q_id", "rank").collect()
    monkeypatch.setattr(knn, "QUERY_BLOCK", 2)
    monkeypatch.setattr(knn, "CORPUS_BLOCK", 9)
    assert knn.knn(c, q, 3).orderBy("q_id", "rank").collect() == whole
    assert [r.id for r in whole if r["rank"] == 1] == list(range(7))
    assert knn.knn(c.limit(0), q, 3).count() == 0


def test_upsert_and_levels(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), ("a", 2, "w")], "id string, seq int, text string")
    assert sorted(map(tuple, knn.upsert_latest(d, "id", "seq", "text").collect())) == [("a", 3, "y"), ("b", 2, "z")]
    assert knn.level_counts(spark.range(5000), "id").where("layer = 0").first().node_count == 5000


def test_numbering(spark):
    d = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1000)).alias("id")).repartition(5)
    assert all(r.id == r.n for r in numbered(d, ["id"]).collect())
    assert numbered(d.limit(0), ["id"]).count() == 0


# --- graph


NODE = "seq long, id string, name string, type string, level string, description string, file_location string, tags array<string>"
EDGE = "seq long, source string, target string, relation string, weight double"


def small_graph(spark):
    nodes = [
        (0, "t-search", "Search theme", "theme", "high_level", "finding things quickly", None, ["search"]),
        (1, "t-store", "Storage", "theme", "high_level", "keeping things", None, []),
        (2, "f-find", "find()", "function", "low_level", "runs a search over the index", "src/find.py", ["index", "search"]),
        (3, "c-store", "Store", "class", "low_level", "keeps rows", None, []),
        (4, "f-sandbox", "Sandbox.run", "function", "low_level", "runs code", None, []),
        (5, "f-last", "Last", "function", "low_level", "is last", None, []),
    ]
    edges = [(0, "f-find", "t-search", "belongs_to", 1.0), (1, "c-store", "t-store", "belongs_to", 1.0), (2, "f-last", "f-last", "loops", 0.5)]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def test_dual_level(spark):
    nodes, edges = small_graph(spark)
    p = spark.createDataFrame([(1, "Search the index and search"), (2, "zz")], "query_id long, prompt string")
    got = {(r.query_id, r.level, r["rank"]): (r.id, r.score, r.is_fallback) for r in graph.dual_level(nodes, p).collect()}
    # "search" counts twice; "the" hits "theme"; "and" is part of "sandbox".
    assert got[1, "low_level", 1] == ("f-find", 8, False) and got[1, "low_level", 2] == ("f-sandbox", 6, False)
    assert got[1, "high_level", 1] == ("t-search", 18, False) and (1, "high_level", 2) not in got
    assert [got[2, "low_level", k] for k in (1, 2, 3)] == [("f-find", 0, True), ("c-store", 0, True), ("f-sandbox", 0, True)]
    assert [got[2, "high_level", k][0] for k in (1, 2)] == ["t-search", "t-store"]
    paths = graph.relational_paths(edges, graph.dual_level(nodes, p)).orderBy("query_id", "seq").collect()
    assert [(r.query_id, r["from"], r["to"]) for r in paths] == [(1, "f-find", "t-search"), (2, "f-find", "t-search"), (2, "c-store", "t-store")]


def test_merge(spark):
    nodes, edges = spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE)
    ent = spark.createDataFrame([(0, "A", "concept", "low_level", "", []), (1, " a ", "api", "low_level", "", []), (2, "B", "concept", "low_level", "", [])], "seq long, name string, type string, level string, description string, tags array<string>")
    rel = spark.createDataFrame([(0, "A", "B", "rel", 0.7), (1, "a", "b ", "rel", 0.9), (2, "A", "Missing", "rel", 0.5)], EDGE)
    n, e, tally = graph.merge(nodes, edges, ent, rel, "doc")
    assert tuple(tally.first()) == (2, 1, 1)
    assert sorted(r.id for r in n.collect()) == ["ing-a-0", "ing-b-1"]
    assert [(r.source, r.target, r.weight) for r in e.collect()] == [("ing-a-0", "ing-b-1", 0.7)]
    _, _, again = graph.merge(n, e, ent, rel, "doc")
    assert tuple(again.first()) == (0, 3, 0)


# --- fusion


def test_rrf(spark):
    a = spark.createDataFrame([(1, "x", "gx", 1), (1, "y", "gy", 2)], "query_id long, id string, text string, rank int")
    b = spark.createDataFrame([(1, "y", "vy", 1), (1, "z", "vz", 2)], "query_id long, id string, text string, rank int")
    got = [(r.id, r.text, r.sources, round(r.rrf_score, 6)) for r in fusion.reciprocal_rank_fusion(a, b, 0).orderBy("rank").collect()]
    assert got == [("y", "gy", "graph+vector", round(1 / 62 + 1 / 61, 6)), ("x", "gx", "graph", round(1 / 61, 6)), ("z", "vz", "vector", round(1 / 62, 6))]


def test_rerank(spark):
    rows = [(1, "a", "graph", 1, 1, 9.0), (1, "b", "graph", 2, 2, None), (1, "c", "vector", 1, 3, 9.0), (1, "d", "vector", 1, 4, None)]
    d = spark.createDataFrame(rows, "query_id long, id string, source string, original_rank int, input_seq long, llm_score double")
    ranked = fusion.rerank_order(d)
    assert [r.id for r in ranked.orderBy("new_rank").collect()] == ["a", "c", "d", "b"]
    assert tuple(fusion.rerank_summary(ranked).first())[1:] == (2, 2, True, None)
    timed = fusion.rerank_summary(ranked.withColumn("latency_ms", F.lit(2.5))).first()
    assert timed.total_latency_ms == 10.0
    raw = ['{"score": 12}', '{"score": -1}', '{"score": null}', '{"score": "7"}', "{}", "no", '{"score": ""}', '{"score": true}', '{"score": 3.25}']
    got = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string").select("i", fusion.rerank_score(F.col("raw")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [10.0, 0.0, 0.0, 7.0, None, None, 0.0, 1.0, 3.25]


# --- ingestion


def test_validate_extraction(spark):
    answers = [
        json.dumps({"entities": [{"type": "api"}, {"name": " A ", "type": "zzz", "level": "x", "description": 3, "tags": ["t", 1]}, {"name": "B", "type": "class"}],
                    "relations": [{"source": "a", "target": "B", "relation": " ", "weight": 2}, {"source": "A", "target": "B", "weight": "0.9", "relation": " r "},
                                  {"source": "A", "target": "C"}, {"source": "A", "target": "B", "relation": "w", "weight": 0.25}]}),
        "not json", "5", "{}", "null",
    ]
    got = ingest.validate_extraction(spark.createDataFrame(list(enumerate(answers)), "chunk_index int, raw string")).orderBy("chunk_index").collect()
    assert [tuple(e) for e in got[0].entities] == [("A", "concept", "low_level", "", ["t"]), ("B", "class", "low_level", "", [])]
    assert [tuple(r) for r in got[0].relations] == [("a", "B", "relates_to", 0.5), ("A", "B", "r", 0.5), ("A", "B", "w", 0.25)]
    assert [r.error is None for r in got] == [True, False, False, True, False] and got[3].entities == []


def test_ingest_documents(spark):
    d = spark.createDataFrame([(1, "Alpha calls Beta. It works."), (2, "broken text"), (3, " ")], "doc_id long, text string")

    def reply(system, user):
        if "broken" in user:
            raise TimeoutError("no answer")
        return json.dumps({"entities": [{"name": "Alpha"}, {"name": "Beta"}], "relations": [{"source": "Alpha", "target": "Beta", "relation": "calls", "weight": 0.8}]})

    out = ingest.ingest_documents(d, "doc_id", "text", spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE), CannedChat(reply))
    assert sorted(r.chunk_id for r in out["chunks"].collect()) == ["1-chunk-0", "2-chunk-0"]
    assert sorted(r.name for r in out["nodes"].collect()) == ["Alpha", "Beta"] and out["edges"].first().relation == "calls"
    report = {r.doc_id: r for r in out["report"].collect()}
    assert report[1].extraction_error is None and "TimeoutError" in report[2].extraction_error and report[3].error == "no text"


# --- evaluation


def signature(outputs):
    fields = ", ".join(f"named_struct('field', '{f}', 'type', '{t}', 'desc', cast(null as string))" for f, t in outputs)
    return F.expr(f"named_struct('name', 's', 'description', '', 'inputs', cast(array() as array<struct<field:string,type:string,desc:string>>), 'outputs', array({fields}))")


def test_adherence(spark):
    s = signature([("answer", "json")])
    score = lambda t: one(spark, evaluate.adherence(s, F.col("t")), t=t)
    assert score("  ") == 0.0
    assert score('{"answer": 1}') == 0.7
    assert score('{"answer": NaN}') == 0.5
    assert score("some long enough text with an ANSWER in ``` fences") == 0.65


def test_offline_scores(spark):
    for text, want in {"hello": (0.3, 0.5, "+66.7%"), "step": (0.4, 0.6, "+50.0%"), "instructions for JSON": (0.5, 0.7, "+40.0%")}.items():
        base, better = evaluate.offline_scores(F.col("t"))
        assert (one(spark, base, t=text), one(spark, better, t=text), one(spark, evaluate.gain(base, better), t=text)) == want


def test_compile_signature(spark):
    d = spark.createDataFrame([(1, "say it"), (2, "fail")], "id long, prompt string").withColumn("signature", signature([("answer", "string")]))

    def reply(system, user):
        if "fail" in user:
            raise ConnectionError("down")
        return "the answer is here, long enough" if "[Signature" in user else "short"

    got = {r.id: r for r in evaluate.compile_signature(d, CannedChat(reply)).collect()}
    assert got[1].live and got[1].base_score == 0.45 and got[1].compiled_score == 0.7 and got[1].gain == "+55.6%"
    assert not got[2].live and got[2].base_score == 0.3
    assert "(no fields)" in got[1].compiled_prompt
    assert not evaluate.compile_signature(d).where("live").count()


def test_benchmark(spark):
    d = spark.createDataFrame([(1, "p")], "id long, prompt string")
    r = evaluate.benchmark(d, CannedChat(lambda s, u: "a b c"), CannedChat(lambda s, u: "A x c d")).first()
    assert r.acceptance == "66.7%" and r.draft_error is None and r.speedup.endswith("x")
    assert one(spark, evaluate.throughput(F.col("n"), F.col("t")), n=671, t=66_500_000_000) == 10.09


# --- clients and the whole plan


def test_ask_reports_failures(spark):
    d = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "id long, t string")

    def reply(system, user):
        if user == "bad":
            raise ValueError("no")
        return user.upper()

    got = {r.id: (r.answer, r.error) for r in ask(d, CannedChat(reply), "", "t", parallel=2).collect()}
    assert got == {1: ("OK", None), 2: (None, "ValueError: no"), 3: ("", None)}


def test_hypothetical_documents(spark):
    p = spark.createDataFrame([(1, "q"), (2, "empty")], "query_id long, prompt string")
    got = {r.query_id: r for r in hypothetical_documents(p, CannedChat(lambda s, u: "passage " if u == "q" else " ")).collect()}
    assert got[1].search_text == "passage" and got[2].search_text == "empty" and got[2].hyde_error == "empty passage"


@pytest.mark.parametrize("mode", [*MODES, "other"])
def test_modes(spark, mode):
    nodes, edges = small_graph(spark)
    chunks = embed(spark.createDataFrame(list(enumerate(CHUNKS)), "id long, text string"))
    p = spark.createDataFrame([(1, QUESTION)], "query_id long, prompt string")
    client = CannedChat(lambda s, u: '{"score": 5}' if "JSON" in s else "a passage about search")
    out = retrieve(p, nodes, edges, chunks, mode, client)
    context = out["context"].first().context
    assert (out["vector"].count() == 0) == (mode == "keyword")
    assert (out["matches"].count() == 0) == mode.startswith("vector")
    assert ("rrfScore=" in context) == (mode == "hybrid_rrf") and ("score=5/10" in context) == (mode == "hybrid_rerank")
    if mode in ("vector", "hybrid"):
        first = out["vector"].where("rank = 1").first()
        assert (first.id, first.similarity) == (1, 0.234)
    said = answer(p, out["context"], CannedChat(lambda s, u: "so")).first()
    assert said.llm_used and said.synthesis == "so" and said.synthesis_error is None


def test_rerank_calls_keep_failures(spark):
    c = spark.createDataFrame([(1, "a", "x", "graph", 1, 1), (1, "b", "y", "graph", 2, 2)], "query_id long, id string, text string, source string, original_rank int, input_seq long")
    p = spark.createDataFrame([(1, "q")], "query_id long, prompt string")
    got = {r.id: r for r in rerank_calls(c, p, CannedChat(lambda s, u: '{"score": 3}' if "x" in u.split("Passage")[1] else "no")).collect()}
    assert got["a"].llm_score == 3.0 and got["b"].llm_score is None and got["b"].rerank_error


def test_remote_embedding_falls_back(spark):
    d = spark.createDataFrame([(1, " ok "), (2, "down"), (3, " "), (4, None), (5, "empty")], "id long, text string")

    def reply(text):
        if text == "down":
            raise TimeoutError("late")
        return [] if text == "empty" else [3.0, 4.0]

    got = {r.id: r for r in embed_remote(d, CannedEmbed(reply)).collect()}
    assert got[1].vector == [0.6, 0.8] and got[1].embedded_by == "client" and got[1].embed_error is None
    assert got[2].vector == HashEmbedder()("down").tolist() and got[2].embedded_by == "hash" and "TimeoutError" in got[2].embed_error
    assert got[3].vector == [0.0] * 384 and got[3].embed_error is None and not any(got[4].vector)
    assert got[5].embedded_by == "hash" and "no vector" in got[5].embed_error


def test_reported_tokens_and_time(spark):
    d = spark.createDataFrame([(1, "p"), (2, "bad")], "id long, prompt string")

    def draft(prompt):
        if prompt == "bad":
            raise ConnectionError("down")
        return Generation("a b c", 90, 1.5)

    got = {r.id: r for r in evaluate.benchmark(d, CannedGenerate(draft), CannedGenerate(lambda p: Generation("a x c", 40, 2.0))).collect()}
    assert (got[1].draft_tps, got[1].target_tps, got[1].speedup, got[1].draft_tokens) == (60.0, 20.0, "3.00x", 90)
    assert got[2].draft_error.startswith("ConnectionError") and got[2].draft_tps == 0.0 and got[2].speedup == "0.00x"


def test_insert(spark):
    first = embed(spark.createDataFrame([("a", "one"), ("b", "two")], "id string, text string"))
    rows = spark.createDataFrame([("b", 1, "old"), ("b", 2, "new"), ("c", 1, "three")], "id string, seq int, text string")
    got = {r.id: r for r in knn.insert(first, rows).collect()}
    assert {i: r.text for i, r in got.items()} == {"a": "one", "b": "new", "c": "three"}
    assert got["b"].vector == HashEmbedder()("new").tolist()


def test_keyword_scores_equal_brute_force(spark):
    """Every word of every prompt in every node; with an index kept in the catalogue as without."""
    import random

    rng = random.Random(4)
    words = ["search", "index", "sea", "arc", "aaa", "aaaa", "über", "x😀y", "c++", "the", "then", "rows", "ro", "q?a"]
    rows = [(i, f"n{i}", rng.choice([None, " ".join(rng.choices(words, k=2))]), "t", rng.choice(["low_level", "high_level"]), rng.choice([None, "", "-".join(rng.choices(words, k=9)).upper()]), None, rng.choice([None, ["The tag", None], []])) for i in range(150)]
    nodes = spark.createDataFrame(rows, "seq long, id string, name string, type string, level string, description string, file_location string, tags array<string>")
    asked = [(i, " ".join(rng.choices([*words, "aa", "zzz", "SEARCH", "the"], k=rng.randint(0, 6)))) for i in range(40)] + [(40, None), (41, "")]
    p = spark.createDataFrame(asked, "query_id long, prompt string")
    want = set()
    for q, prompt in asked:
        for seq, _, name, _, _, description, _, tags in rows:
            text, low = " ".join([name or "", description or "", " ".join(t for t in tags or [] if t)]).lower(), (name or "").lower()
            score = sum(2 * (t in text) + 4 * (t in low) for t in (prompt or "").lower().split() if len(t) > 2)
            want |= {(q, seq, score)} if score else set()
    assert len(want) > 500
    for index in (None, graph.trigram_index(nodes)):
        made = graph.keyword_scores(nodes, p, index)
        assert {(r.query_id, r.seq, r.score) for r in made.collect()} == want
        plan = made._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert graph.keyword_scores(nodes, p.limit(0)).count() == graph.keyword_scores(nodes.limit(0), p).count() == 0


def test_edges_stay_where_they_lie(spark, tmp_path):
    """Paths deal no edges, also after an insert; the inserted ones are found."""
    edges = spark.createDataFrame([(i, f"n{i % 40}", f"n{i * 7 % 40}", "r", 1.0) for i in range(400)], "seq long, source string, target string, relation string, weight double")
    more = spark.createDataFrame([(1000, "n1", "new", "r", 1.0)], edges.schema)
    picked = spark.createDataFrame([(1, "n1"), (1, "n2"), (2, "n3"), (2, "n3")], "query_id long, id string")
    want = lambda df: sorted(map(str, graph.relational_paths(df, picked).collect()))
    pair = graph.lay_out_edges(edges, "test_edges")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for step in range(3):
            laid = (pair, graph.lay_out_edges(edges))[step] if step < 2 else graph.insert_edges("test_edges", more)
            plain = edges if step < 2 else edges.unionByName(more)
            for table, end in zip(laid, ("source", "target")):
                joined = table.join(picked.withColumnRenamed("id", end), end)
                plan = joined._jdf.queryExecution().executedPlan().toString()
                assert plan.count("Exchange") == 1 and "Bucketed: true" in plan, plan
            assert want(laid) == want(plain)
        assert any("new" in row for row in want(graph.lay_out_edges(edges.unionByName(more))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for end in ("source", "target"):
            spark.sql(f"DROP TABLE IF EXISTS test_edges_by_{end}")


def test_mentions_let_both_lists_share_ids(spark):
    nodes = spark.createDataFrame([(1, "a", "Vector Index"), (2, "b", "index"), (3, "c", "vector  index"), (4, "d", None), (5, "e", "--"), (6, "f", "Äpfel"), (7, "g", "a b c d")], "seq long, id string, name string")
    chunks = spark.createDataFrame([("x", "The vector-INDEX, an index. äpfel!"), ("y", "a b c d e"), ("z", None), ("w", "")], "chunk_id string, text string")
    found = graph.mentions(chunks, nodes)
    assert sorted(map(tuple, found.collect())) == [("x", "a", 4, 16), ("x", "b", 21, 26), ("x", "f", 28, 33), ("y", "g", 0, 7)]
    assert graph.mentions(chunks, nodes.limit(0)).count() == graph.mentions(chunks.limit(0), nodes).count() == 0
    low = spark.createDataFrame([(1, "a", "Vector Index", 1), (1, "q", "other", 2)], "query_id long, id string, text string, rank int")
    near = spark.createDataFrame([(1, "x", "The vector", 1), (1, "y", "a b c d e", 2), (1, "w", "", 3)], low.schema)
    mapped = graph.as_nodes(near, found)
    assert sorted((r.id, r["rank"]) for r in mapped.collect()) == [("a", 1), ("b", 2), ("f", 3), ("g", 4), ("w", 5)]
    first = fusion.reciprocal_rank_fusion(low, mapped).orderBy("rank").first()
    assert (first.id, first.sources) == ("a", "graph+vector") and abs(first.rrf_score - 2 / 61) < 1e-12
    assert all("+" not in r.sources for r in fusion.reciprocal_rank_fusion(low, near).collect())


def test_table_functions_equal_the_columns(spark):
    from skein.functions import tables

    tables.register(spark)
    texts = ["Aa bb. Cc dd. Ee ff gg hh. " + "X" * 45 + ". Zz.", None, "", " \n ", "a\r\n\r\nb\n \n" + "é😀" * 30, "\ufeffOne.  (Two) three!\x0b'Four' five? six. 7", "word " * 50, "x\n\n\n\ny\n\n z"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for name, column in (("sentence_chunks", T.sentence_chunks), ("paragraph_chunks", T.paragraph_chunks)):
        for size in (1, 7, 20, 800):
            got = spark.sql(f"select d.id, c.* from {{df}} d, lateral {name}(d.text, {size}) c", df=df).collect()
            want = df.select("id", F.posexplode(column(F.col("text"), size)).alias("i", "t")).collect()
            assert sorted((r.id, r.chunk_index, r.text, r.char_count) for r in got) == sorted((r.id, r.i, r.t, len(r.t)) for r in want), (name, size)
        for bad in ("0", "'x'", "d.id"):
            with pytest.raises(Exception, match="chunk|constant"):
                spark.sql(f"select c.* from {{df}} d, lateral {name}(d.text, {bad}) c", df=df).collect()


def test_merge_counts_while_it_writes(spark):
    """The tally is right, and each entity passes once."""
    nodes, edges = small_graph(spark)
    seen = spark.sparkContext.accumulator(0)

    def through(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = [(i, f" Name {i % 7} ", "t", "low_level", "d", ["x"]) for i in range(50)]
    entities = spark.createDataFrame(rows, "seq long, name string, type string, level string, description string, tags array<string>")
    relations = spark.createDataFrame([(1, "name 1", "NAME 2", "r", 1.0), (2, "name 1", "name 2", "r", 0.5), (3, "name 1", "nobody", "r", 1.0)], "seq long, source string, target string, relation string, weight double")
    every, joined, tally = graph.merge(nodes, edges, entities.mapInPandas(through, entities.schema), relations)
    assert tuple(tally.first()) == (7, 43, 1) and seen.value == 50
    assert every.count() == nodes.count() + 7 and joined.count() == edges.count() + 1
    assert tuple(graph.merge(nodes, edges, entities.limit(0), relations.limit(0))[2].first()) == (0, 0, 0)


def test_long_texts_are_trimmed_and_cut_in_one_go(spark):
    import time

    blanks = "A b." + " " * 1_000_000 + "c. D."
    began = time.perf_counter()
    assert one(spark, F.length(T.trim_white(F.col("t"))), t=" " + blanks + "\n") == len(blanks)
    assert one(spark, F.size(T.sentence_chunks(F.col("t"), 800)), t="é😀" * 500_000) == 1250
    assert time.perf_counter() - began < 20
    assert one(spark, T.sentence_chunks(F.col("t"), 3), t="é😀" * 4) == ["é😀é", "😀é😀", "é😀"]
    deep = spark.createDataFrame([("[" * 100_000,), ("[1]",)], "t string").select(evaluate.is_json("t").alias("x")).collect()
    assert [r.x for r in deep] == [False, True]


@pytest.mark.parametrize("ids", [[2**45 + 1, 2**45 + 2, 2**45 + 3], ["doc-b", "doc-a", "x/y"]])
def test_ingested_documents_can_be_retrieved(spark, ids):
    """Ids beyond 2 ** 40 and text ids, from documents to an answer."""
    kind = "string" if isinstance(ids[0], str) else "long"
    d = spark.createDataFrame([(ids[0], CHUNKS[0]), (ids[1], CHUNKS[1]), (ids[2], "Gamma uses Delta.\n\n" + "Delta calls Alpha. " * 120)], f"doc_id {kind}, text string")

    def reply(system, user):
        names = [w for w in ("HNSW", "Gamma", "Delta", "Alpha") if w in user]
        relations = [{"source": a, "target": b, "relation": "uses"} for a, b in zip(names, names[1:])]
        return json.dumps({"entities": [{"name": n} for n in names], "relations": relations})

    out = ingest.ingest_documents(d, "doc_id", "text", spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE), CannedChat(reply), embedder=CannedEmbed(lambda t: HashEmbedder()(t).tolist()))
    assert sorted(r.name for r in out["nodes"].collect()) == ["Alpha", "Delta", "Gamma", "HNSW"]
    assert out["report"].where("extraction_error is null").count() == 3 and out["tally"].first().nodes_added == 4
    p = spark.createDataFrame([(1, QUESTION)], "query_id long, prompt string")
    got = retrieve(p, out["nodes"], out["edges"], out["chunks"], "hybrid")
    first = got["vector"].where("rank = 1").first()
    assert first.id == f"{ids[1]}-chunk-0" and first.similarity == 0.234
    assert f"({ids[1]}-chunk-0)" in got["context"].first().context


def test_requests_and_answers_as_json(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"prompt": "Search the index", "mode": "keyword"}\n{"prompt": "Search it"}\n{"mode": "vector"}\n[1]\n')
    asked = read_requests(spark, str(tmp_path / "in"))
    assert sorted((r.prompt, r.mode) for r in asked.collect()) == [("", "hybrid"), ("", "vector"), ("Search it", "hybrid"), ("Search the index", "keyword")]
    nodes, edges = small_graph(spark)
    chunks = embed(spark.createDataFrame(list(enumerate(CHUNKS)), "id long, text string"))
    answers = answer_requests(asked, nodes, edges, chunks, CannedChat(lambda s, u: "so"))
    write_answers(answers, str(tmp_path / "out"))
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(rows) == 4 and all(r["success"] and r["llmUsed"] and r["synthesis"] == "so" and r["synthesisError"] is None for r in rows)
    assert sorted(r["mode"] for r in rows) == ["hybrid", "hybrid", "keyword", "vector"]


@given(st.lists(st.text(alphabet="ab1_ -ZÉ", max_size=90), max_size=6))
@settings(max_examples=60, deadline=None)
def test_texts_embedded_together(texts):
    e = HashEmbedder()
    v, touched = e.matrix(texts + ["x" * 70 + " y"])
    for row, hit, t in zip(v, touched, texts):
        want = np.zeros(384)
        words = [w for w in T_WORDS.split(t.lower()) if w]
        for i, w in enumerate(words):
            for k, g in enumerate([w, *(w[j : j + 3] for j in range(len(w) - 2))]):
                h = V.fnv1a_py(g)
                want[abs(h) % 384] += (1 if h > 0 else -1) * (0.45 if k else 1.0) / np.sqrt(i + 1)
                assert hit[abs(h) % 384]
        n = np.sqrt(want @ want) or 1.0
        assert np.allclose(row, want / n, atol=1.1e-6)


def test_approximate_knn(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 12))[rng.integers(0, 30, 2500)] + 0.3 * rng.normal(size=(2500, 12))
    c = spark.createDataFrame([(f"d{i:04}", v.tolist()) for i, v in enumerate(x)], "id string, v array<double>")
    q = c.where("substring(id, 5, 1) = '0'").select(F.col("id").alias("q_id"), F.col("v").alias("q"))
    exact = {(r.q_id, r["rank"]): (r.id, r.distance) for r in knn.knn(c, q, 5).collect()}
    near = knn.approximate_knn(c, q, 5).collect()
    want = {}
    for (query, _), (i, _) in exact.items():
        want.setdefault(query, set()).add(i)
    assert len(near) == len(exact) and np.mean([r.id in want[r.q_id] for r in near]) >= 0.9
    monkeypatch.setattr(knn, "CORPUS_BLOCK", 40)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 30)
    every = {(r.q_id, r["rank"]): (r.id, r.distance) for r in knn.approximate_knn(c, q, 5, probes=10**6).collect()}
    assert every == exact
    assert knn.approximate_knn(c.limit(0), q, 5).count() == 0


def test_answers_are_checked_once_and_in_many_tasks(spark, sf):
    """A small file is one partition; neither the checks nor a filter made of them may stay in its one task."""
    from skein.queries import QUERIES

    plan = QUERIES["validate_relations"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and "parse" in plan.lower()
    assert "parse_json" not in plan[plan.index("Repartition") :].lower() and "parseJson" not in plan[plan.index("Repartition") :]
    assert "size(" not in plan


def test_memory_of_a_worker_does_not_follow_batch_or_text_size():
    """Long texts are embedded a few at a time, with the vectors of one text at a time."""
    from skein.functions.embed import CHARS, TEXTS, runs

    texts = ["a b" * (CHARS // 2), None, "x", *["word " * 2000] * 60, *["y"] * 300]
    parts = list(runs(texts))
    assert [i for p in parts for i in range(p.start, p.stop)] == list(range(len(texts)))
    assert all(p.stop - p.start == 1 or (p.stop - p.start <= TEXTS and sum(len(t or "") for t in texts[p]) <= CHARS) for p in parts)
    assert list(runs([])) == []


def test_asking_sees_only_the_texts_and_a_few_rows_at_a_time(spark):
    from skein.sources import clients

    rows = spark.range(1000).selectExpr("id", "concat('t', id) as text", "named_struct('a', id, 'b', array(id)) as other").repartition(1)
    plan = ask(rows, CannedChat(lambda s, u: u.upper()), "", "text")
    assert "MapInArrow" in plan._jdf.queryExecution().executedPlan().toString() and clients.ROWS < 1000
    got = {r.id: (r.answer, r.other.a, r.other.b) for r in plan.collect()}
    assert got == {i: (f"T{i}", i, [i]) for i in range(1000)}


def test_requests_of_all_modes_read_graph_and_chunks_once(spark, monkeypatch):
    """And two modes may have one id with two prompts."""
    from skein.plans import retrieval

    calls = []
    for name in ("knn",):
        monkeypatch.setattr(retrieval, name, lambda *a, f=getattr(retrieval, name), **b: calls.append("knn") or f(*a, **b))
    for name in ("dual_level", "relational_paths"):
        monkeypatch.setattr(retrieval.graph, name, lambda *a, f=getattr(graph, name), n=name, **b: calls.append(n) or f(*a, **b))
    nodes = spark.createDataFrame([(0, "n0", "red bolt", "api", "low_level", "d", None, []), (1, "n1", "blue ring", "api", "low_level", "d", None, [])], "seq long, id string, name string, type string, level string, description string, file_location string, tags array<string>")
    edges = spark.createDataFrame([(0, "n0", "n1", "near", 1.0)], "seq long, source string, target string, relation string, weight double")
    chunks = embed(spark.createDataFrame([(1, "red bolt text"), (2, "blue ring text")], "id long, text string"))
    rows = [(7, "red bolt", "keyword"), (7, "blue ring", "hybrid"), (8, "red bolt", "hybrid_rrf"), (9, "blue", "vector_hyde")]
    made = answer_requests(spark.createDataFrame(rows, "query_id long, prompt string, mode string"), nodes, edges, chunks, CannedChat(lambda s, u: "blue ring"))
    got = {(r.query_id, r.mode): r.context for r in made.collect()}
    assert sorted(calls) == ["dual_level", "knn", "relational_paths"]
    assert set(got) == {(i, m) for i, _, m in rows}
    assert "• red bolt" in got[7, "keyword"] and "blue ring (" not in got[7, "keyword"]
    assert "• blue ring (" in got[7, "hybrid"] and "red bolt (" not in got[7, "hybrid"]
