import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from skein.llm import decontaminate, pii, quality
from skein.llm.common import read_table
from tests.llm.fixtures import docs, table
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_pieces import encoded
from tests.llm.test_pii import NOT_DIGITS, finder


def brute(spark, sf):
    """The same decisions one document at a time."""
    d = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id")
    model = quality.fit_on(read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))
    weights = dict(zip(model.keys.tolist(), model.weights.tolist()))
    scores = np.array([sum(weights.get(f, 0.0) for f in quality.features(t)) for t in d.text])
    d = d[model.tail(scores) >= quality.KEEP_TAIL]
    d = d[d.doc_id.isin(brute_kept(d.doc_id.tolist(), d.text.tolist()))]
    b = pd.read_parquet(f"{sf}/benchmark.parquet")
    match = decontaminate.Matcher(list(zip(b.item_id, b.text)))
    d = d[[not match(t) for t in d.text]]
    find = finder()
    out = {}
    for i, t in zip(d.doc_id, d.text):
        out[i] = encoded(pii.redact(t, find([t])[0][1]))
    return out


def test_run_equals_brute_force(spark, sf):
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    want = brute(spark, sf)
    assert 0 < len(want) < read_table(spark, sf, "documents").count()
    assert got == want


def test_stages_keep_the_columns(spark, sf):
    d = read_table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == d.columns


@pytest.mark.parametrize("texts", [[], [None, "", None, "x", "x"]])
def test_odd_documents(spark, tmp_path, texts):
    sf = table(spark, tmp_path, "documents", docs(spark, texts))
    table(spark, tmp_path, "labels", spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    table(spark, tmp_path, "benchmark", spark.createDataFrame([], "item_id long, text string"))
    rows = corpus_pipeline.run(spark, sf).collect()
    assert len(rows) == (2 if texts else 0)


def test_long_texts_clashing_columns_and_ties(spark, tmp_path):
    """Awkward rows through all stages: what is left is each text redacted and encoded, whatever the other columns are called."""
    long = "one very long text " * 12_000
    texts = [long, long + "more", None, "", "tie of two equal texts here now", "tie of two equal texts here now", "a-1-" * 30_000, "q" * 150_000, "mail a.b@c.de \n now and then", "é中🙂 ▁ mark", NOT_DIGITS]
    ids = [9, 4, 3, None, 8, 2, 7, 7, 6, None, 10]
    d = docs(spark, texts, ids)
    d = d.withColumnsRenamed({"start": "row", "rank": "node"}).withColumn("grade", d.n_chars).withColumn("found", d.text).withColumn("keep", d.doc_id)
    sf = table(spark, tmp_path, "documents", d)
    table(spark, tmp_path, "labels", spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    table(spark, tmp_path, "benchmark", spark.createDataFrame([(1, "no such passage in any text")], "item_id long, text string"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in corpus_pipeline.run(spark, sf).collect())
    # Rows 0 and 1 share their shingles but for two, 2 and 3 are blank, 4 and 5 equal.
    find, kept = finder(), [(4, texts[1]), (3, None), (2, texts[5]), (7, texts[6]), (7, texts[7]), (6, texts[8]), (None, texts[9]), (10, texts[10])]
    want = sorted((i is None, i or 0, encoded(pii.redact(t, find([t])[0][1])) if t else []) for i, t in kept)
    assert got == want
    stage = d
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, stage, sf)
        assert out.columns == d.columns
