import random
import re

import numpy as np
import pandas as pd
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import simhash as q
from tests.llm.fixtures import docs, table


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def brute_groups(ids, fps):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in zip(ids, fps):
        for j, b in zip(ids, fps):
            if i < j and (a ^ b).bit_count() <= 3:
                r, s = sorted((find(i), find(j)))
                parent[s] = r
    return {i: find(i) for i in ids}


@given(st.text(alphabet="aB c\t\n\x0b\x1f é Z", max_size=60))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert q.fingerprint(text) == brute_fp(text)


def test_any_three_bits_share_a_key_and_pass_its_chain():
    rng = random.Random(1)
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for k in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << k
        hit = False
        for start, mask in q.key_masks():
            if x & mask == y & mask:
                hit |= all(((x ^ y) & m).bit_count() <= 3 * (k + 1) // 8 for k, m in enumerate(q.chain_masks(start)))
        assert hit


def test_groups_of_close_fingerprints(spark, monkeypatch):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(350):
        x = rng.choice(fps)
        for k in rng.sample(range(64), rng.randint(1, 5)):
            x ^= 1 << k
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    want = brute_groups(range(len(fps)), fps)
    for block in (1024, 3):  # whole keys, and keys cut into blocks
        monkeypatch.setattr(q, "BLOCK", block)
        d = spark.createDataFrame([(q._signed(x),) for x in fps], "fp long")
        edges = [(r.a, r.b) for r in q.links(d).collect()]
        at = {q._signed(x): i for i, x in enumerate(fps)}
        assert all((int(np.uint64(np.int64(a)) ^ np.uint64(np.int64(b)))).bit_count() <= 3 for a, b in edges)
        got = brute_groups_from_edges(len(fps), [(at[a], at[b]) for a, b in edges])
        assert got == want


def brute_groups_from_edges(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        r, s = sorted((find(a), find(b)))
        parent[s] = r
    return {i: find(i) for i in range(n)}


def test_query_on_test_table(spark, sf):
    pdf = pd.read_parquet(f"{sf}/documents.parquet")
    fps = [brute_fp(t) for t in pdf.text]
    want = brute_groups(pdf.doc_id.tolist(), fps)
    got = q.op9_simhash(spark, sf).toPandas().set_index("doc_id").sort_index()
    assert got.fingerprint.tolist() == [f"{f:016x}" for f in fps]
    assert got.component_id.to_dict() == want


def test_awkward_rows(spark, tmp_path):
    texts = ["", None, " \n", "one", "ONE", "one two", "x " * 40000, "x " * 40001, "same text here now", "same text here now"]
    ids = [9, 8, 7, 6, 5, 4, 3, 2, 1, None]
    got = q.op9_simhash(spark, table(spark, tmp_path, "documents", docs(spark, texts, ids))).toPandas()
    assert len(got) == len(texts)
    by = got.dropna(subset="doc_id").set_index("doc_id")
    assert by.fingerprint[[9, 8, 7]].tolist() == ["0" * 16] * 3 and by.component_id[[9, 8, 7]].tolist() == [7, 7, 7]
    assert by.component_id[6] == 5 and by.component_id[3] == 2
    assert got[got.doc_id.isna()].component_id.tolist() == [1]
    assert q.op9_simhash(spark, table(spark, tmp_path, "documents", docs(spark, []))).count() == 0


def test_stage(spark, tmp_path, sf):
    d = docs(spark, ["a b c d e", "a b c d e", "other words entirely here ok", None], [3, 2, 7, None])
    out = q.dedup_stage(spark, d, sf)
    assert out.columns == d.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [2, 7, None]


def test_rows_of_a_hot_fingerprint(spark, tmp_path, monkeypatch):
    from skein.llm import common

    texts = ["same junk again here"] * 60 + [None] * 30 + [f"text number {i} of many others" for i in range(20)]
    sf = table(spark, tmp_path, "documents", docs(spark, texts))
    want = sorted(map(str, q.op9_simhash(spark, sf).collect()))
    monkeypatch.setattr(common, "HOT", 4)  # both large groups are hot
    assert sorted(map(str, q.op9_simhash(spark, sf).collect())) == want and len(want) == len(texts)
