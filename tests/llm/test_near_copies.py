import random
import types

import pandas as pd
import pytest

from skein.llm import near_copies
from skein.llm import simhash as q
from skein.llm.common import read_table
from tests.llm.fixtures import docs
from tests.llm.test_simhash import brute_groups_from_edges


def brute_kept(ids, texts):
    """Ids that stay: exact Jaccard of 5-word shingles over all pairs."""
    sets = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    edges = [
        (i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or 5 * len(a & b) >= 4 * len(a | b)
    ]
    of = brute_groups_from_edges(len(ids), edges)
    best = {}
    for i, r in of.items():
        best[r] = min(best.get(r, ids[i]), ids[i])
    return sorted(best.values())


def mutated(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.getrandbits(40)}"
    return words


@pytest.mark.parametrize("large, block", [(64, 512), (1, 3)])  # pairs as rows, and blocks inside tasks
def test_stage_equals_brute_force_on_near_copies(spark, sf, monkeypatch, large, block):
    monkeypatch.setattr(near_copies, "LARGE", large)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(5)
    texts = []
    for base in range(12):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([8, 40, 120, 300]))]
        for _ in range(12):  # around the threshold, copies of copies among them
            texts.append(" ".join(words))
            words = mutated(rng, words, max(1, len(words) // rng.choice([20, 40, 80])))
    texts += ["one two three", "ONE  two three", "one two", "", " "]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    want = brute_kept(ids, texts)
    assert 20 < len(want) < len(texts) - 20
    got = q.dedup_stage(spark, docs(spark, texts, ids), sf)
    assert sorted(r.doc_id for r in got.collect()) == want


def test_hot_shingles_are_dealt_by_run(spark, sf, monkeypatch):
    """A line that all rows hold: no part gets all rows of its shingles, and the groups stay exact."""
    import numpy as np
    import pyarrow as pa

    line = "this license line stands in every one of the documents"
    rows = [f"{line} w{i} x{i} y{i} z{i} v{i}" for i in range(5000)]
    keys = np.sort(near_copies.shingles(line)[1])
    batches = [pa.RecordBatch.from_pydict({"row": pa.array(range(lo, lo + 500), pa.int64()), "text": rows[lo : lo + 500]}) for lo in range(0, 5000, 500)]
    counted = {}
    for out in near_copies._repeated(5, iter(batches)):
        for key, n in zip(*(c.to_pylist() for c in out.columns)):
            counted[key] = counted.get(key, 0) + n
    assert all(counted[k] == 5000 for k in keys.tolist())
    hot = types.SimpleNamespace(value=(keys, np.full(len(keys), 5000, np.int64)))
    held = {}
    for out in near_copies._packed(5, 4, hot, iter(batches)):
        for part, packed in zip(out.column("part").to_pylist(), out.column("keys").to_pylist()):
            held.setdefault(part, []).append(np.isin(np.frombuffer(packed, np.int64), keys).sum())
    assert sum(sum(v) for p, v in held.items() if p < 4) == 0 and {p for p in held if p >= 4} == {4, 5, 6, 7}
    monkeypatch.setattr(near_copies, "CHUNK", 0)
    monkeypatch.setattr(near_copies, "HOT", 10**9)
    texts = [f"{line} {' '.join(f'w{i}x{k}' for k in range(i % 9))} tail{i % 3}" for i in range(300)]
    got = q.dedup_stage(spark, docs(spark, texts), sf)
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(list(range(300)), texts)


def test_stage_equals_brute_force_on_test_table(spark, sf):
    pdf = pd.read_parquet(f"{sf}/documents.parquet")
    got = q.dedup_stage(spark, read_table(spark, sf, "documents"), sf)
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(pdf.doc_id.tolist(), pdf.text.tolist())


@pytest.mark.parametrize("shift", [0, 1])
def test_one_row_of_repeated_rows_and_null_ids(spark, sf, shift):
    long = " ".join(f"w{i}" for i in range(100))
    near = long.replace("w50", "other")
    texts = [long, long, near, "a b", "a b", "a b", "second text of one id", long]
    ids = [5, 5, None, None, None, 9, 5, None]
    texts, ids = texts[shift:] + texts[:shift], ids[shift:] + ids[:shift]
    got = [(r.doc_id, r.text) for r in q.dedup_stage(spark, docs(spark, texts, ids), sf).collect()]
    assert sorted(got) == [(5, "second text of one id"), (5, long), (9, "a b")]
    only = q.dedup_stage(spark, docs(spark, ["x y", "x y", None], [None, None, None]), sf).collect()
    assert sorted(str(r.text) for r in only) == ["None", "x y"]


def test_simhash_links_come_first_and_the_join_gives_the_rest(spark, sf, monkeypatch):
    """The stage takes verified SimHash links of 5-word shingles, and no other pair is compared where they connect all."""
    rng = random.Random(8)
    texts = []
    for base in range(6):
        words = [f"w{rng.randrange(4000)}" for _ in range(400)]
        texts += [" ".join(words + [f"end{k}"] * (k > 0)) for k in range(4)]  # one shingle of about 400 more: few bits differ
        texts.append(" ".join(mutated(rng, words, 6)))  # near, but bits far apart
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").withColumn("doc_id", q.F.col("row"))
    marked = q.marks(rows).persist()
    prints = {r.row: r.fp for r in marked.collect()}
    assert all(q._signed(q.fingerprint(t, 5)) == prints[i] for i, t in enumerate(texts))
    node = {r.row: r.node for r in marked.collect()}
    want = brute_groups_from_edges(len(texts), [(i, j) for i in prints for j in range(i) if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= q.BITS])
    at = {n: i for i, n in node.items()}
    pairs = [(at[r.a], at[r.b]) for r in q.alike(marked).collect()]
    assert pairs and brute_groups_from_edges(len(texts), pairs) == want
    seen = {}
    inner = near_copies._verified

    def verified(pairs, sets):
        seen.setdefault("rounds", []).append({(r.a, r.b) for r in pairs.collect()})
        return inner(pairs, sets)

    monkeypatch.setattr(near_copies, "_verified", verified)
    got = q.dedup_stage(spark, docs(spark, texts), sf)
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(list(range(len(texts))), texts)
    first, *later = seen["rounds"]
    assert brute_groups_from_edges(len(texts), [(at[a], at[b]) for a, b in first]) == want
    assert not any(want[at[a]] == want[at[b]] for pairs in later for a, b in pairs)


def test_rows_that_cannot_have_a_partner_are_not_dealt_whole(spark):
    """The counting pass keeps every row of a pair at the threshold and drops rows that share too little, hot shingles among them."""
    rng = random.Random(9)
    words = [[f"a{rng.getrandbits(40)}" for _ in range(60)] for _ in range(40)]
    texts = [" ".join(w) for w in words] + [" ".join(w[:-1] + ["x"]) for w in words[:10]] + [" ".join(w[:20]) + f" b{i} c{i} d{i} e{i} " + " ".join(w[24:]) for i, w in enumerate(words[10:15])]
    rows = spark.createDataFrame([(i + 1000, t) for i, t in enumerate(texts)], "row long, text string").withColumn("doc_id", q.F.col("row"))
    marked = q.marks(rows)
    total = marked.agg({"n": "sum"}).first()[0]
    for common in ([], near_copies.shingles(texts[0])[1]):
        hot = spark.sparkContext.broadcast((common, [2] * len(common)))
        got = {r.row - 1000 for r in near_copies._possible(rows.select("row", "text"), marked, total, hot, 5).collect()}
        assert got == {*range(15), *range(40, 55)}
    few = spark.createDataFrame([(1003,), (1024,), (1053,)], "row long")
    assert sorted(r.row for r in near_copies.chosen(rows, few).collect()) == [1003, 1024, 1053]
