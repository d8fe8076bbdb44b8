import itertools
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import pieces as q
from tests.llm.fixtures import docs, table

TABLE = q.PieceTable.load(q.model_path())
ODD = ["", None, " ", "  two  blanks ", "line\nbreak\t tab", "é 中文 🙂 ▁mark", "x" * 3000, "word " * 40000, "a", "a", "Hello world"]


def ids(b):
    return np.frombuffer(b, "<u4").tolist()


@pytest.fixture(scope="module")
def library():
    """The library with the same pieces and scores, told to take the best-scoring path (field 3 of the trainer's message)."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=open(q.model_path(), "rb").read() + b"\x12\x02\x18\x01")


def brute(word):
    """The best sum over all segmentations."""
    best = None
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in zip(at, at[1:])]
        if any(len(p) > 1 and p not in TABLE.scores for p in parts):
            continue
        s = sum(TABLE.scores[p][1] if p in TABLE.scores else TABLE.unknown for p in parts)
        best = s if best is None or s > best else best
    return best


@given(st.text(alphabet="thering▁éß中🙂\n", min_size=1, max_size=9))
@settings(max_examples=200, deadline=None)
def test_fold_finds_the_best_path(word):
    got, s, run = ids(TABLE.encode_word(word)), 0.0, b""
    for i in got:
        if TABLE.byte_zero <= i < TABLE.byte_zero + 256:
            run += bytes([i - TABLE.byte_zero])
        else:
            s += TABLE.scores[TABLE.texts[i]][1]
    s += len(run.decode()) * TABLE.unknown
    assert s == pytest.approx(brute(word), rel=1e-12)


def encoded(text):
    """A text's ids from its words, one at a time."""
    return [i for w in q.split_words(text or "") for i in ids(TABLE.encode_word(q.marked(w)))]


def path_score(word_ids):
    return sum(TABLE.scores[TABLE.texts[i]][1] for i in word_ids)


def test_same_as_the_library(library, sf):
    """The first of the library's n-best paths; of paths with equal sums it may name another."""
    texts = pd.read_parquet(f"{sf}/documents.parquet").text.tolist()
    words = list({w for t in texts for w in t.split() if w})[:6000]
    same = 0
    for w in words:
        got, want = encoded(w), library.nbest_encode_as_ids(w, 2)[0]
        same += got == want
        if not any(TABLE.byte_zero <= i < TABLE.byte_zero + 256 for i in got):
            assert path_score(got) == path_score(want), w
    assert same > 0.99 * len(words)


def test_spark_fold_equals_the_tasks_fold(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    words = d.select(q.F.explode(q.F.split("text", " ")).alias("word")).where("length(word) between 1 and 64").distinct()
    odd = [("é中🙂x",), ("\n",), ("a\nb",), ("ñ",), ("▁▁▁",), ("▁▁a",), ("thering" * 9,)]
    words = words.union(spark.createDataFrame(odd, "word string"))
    words = words.select(q.F.monotonically_increasing_id().alias("id"), q.F.lit(0).alias("part"), q.F.concat(q.F.lit(q.MARK), "word").alias("word"), q.F.col("word").alias("payload"))
    got = q.best_paths(words, TABLE).collect()
    assert len(got) == words.count() > 5000
    for r in got:
        flat = [j for i in r.ids for j in ((i,) if i >= 0 else TABLE.byte_ids(chr(-i)))]
        assert flat == ids(TABLE.encode_word(q.MARK + r.payload)), r.payload


@given(st.lists(st.text(alphabet="thering▁éß中🙂\n.,A(", min_size=1, max_size=12), max_size=8))
@settings(max_examples=150, deadline=None)
def test_units_have_the_path_of_their_word(words):
    words = [w for t in words for w in q.split_words(t)]
    units, counts = TABLE.cut(words)
    assert len(counts) == len(words) and counts.sum() == len(units)
    at = np.cumsum([0, *counts])
    for w, a, b in zip(words, at, at[1:]):
        assert "".join(units[a:b]) == q.marked(w)
        assert sum((ids(TABLE.encode_word(u)) for u in units[a:b]), []) == ids(TABLE.encode_word(q.marked(w)))


def test_no_word_is_missed_by_small_blocks(spark, sf):
    """Blocks of a few documents, and of one, against each word's own fold: every id comes back to its block."""
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in rows.collect()}
    for chars in (20_000, 1):
        got = {r.doc_id: r.ids for r in q.encode(rows, chars=chars).collect()}
        assert got == {i: encoded(t) for i, t in texts.items()}


def test_grouping_by_word_needs_no_shuffle(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    plan = q.unit_ids(d, spark.sparkContext.broadcast(TABLE), 4)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?<!Broadcast)Exchange ", plan)) == 1


def test_query_and_round_trip(spark, tmp_path):
    sf = table(spark, tmp_path, "documents", docs(spark, ODD))
    got = {r.doc_id: r for r in q.op2_sentencepiece(spark, sf).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        assert got[i].n_tokens == len(got[i].ids)
        assert got[i].ids == encoded(t)
        assert got[i].round_trip == (q.MARK not in (t or ""))
    back = {r.doc_id: r.text for r in q.decode(spark, q.op2_sentencepiece(spark, sf)).collect()}
    assert all(back[i] == (t or "").replace(q.MARK, " ") for i, t in enumerate(ODD))


def test_test_table_round_trips(spark, sf):
    assert q.op2_sentencepiece(spark, sf).where("not round_trip").count() == 0


def test_empty_table(spark, tmp_path):
    assert q.op2_sentencepiece(spark, table(spark, tmp_path, "documents", docs(spark, []))).count() == 0
