import random

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import decontaminate as q
from skein.llm.common import read_table
from tests.llm.fixtures import docs, table


def brute(item, text):
    """Smallest edit distance between the item and any substring."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def items_df(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=40))
@settings(max_examples=300, deadline=None)
def test_myers(item, text):
    want = brute(item, text)
    assert q.myers(q.char_masks(item), len(item), text, 99) == want


@given(st.lists(st.text("ab ", min_size=8, max_size=30), min_size=1, max_size=3), st.text("ab ", max_size=120), st.sampled_from([0.0, 0.1, 0.3]))
@settings(max_examples=300, deadline=None)
def test_matcher_equals_brute_force(items, text, rate):
    want = {}
    for i, raw in enumerate(items):
        item = q.normal(raw)
        if item and (d := brute(item, q.normal(text))) <= int(rate * len(item)):
            want[i] = d
    assert q.Matcher(list(enumerate(items)), rate)(text) == want


def planted(n=30):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    items = [" ".join(word() for _ in range(rng.randint(4, 30))) for _ in range(12)]
    texts = []
    for _ in range(n):
        body = [word() for _ in range(60)]
        item = rng.choice(items)
        chars = list(item)
        for _ in range(rng.randint(0, max(1, len(item) // 15))):
            k = rng.randrange(len(chars))
            chars[k : k + 1] = rng.choice([[], ["z"], [chars[k], "y"]])
        if rng.random() < 0.7:
            body[30:30] = ["".join(chars).upper().replace(" ", " \n ")]
        texts.append(" ".join(body))
    return items, texts


def test_query_equals_brute_force(spark, tmp_path):
    items, texts = planted()
    texts += [None, "", items[0], items[0], "x" * 200000 + " " + items[1]]
    items += ["", None, items[0]]
    want = set()
    for i, t in enumerate(texts):
        for j, it in enumerate(items):
            n = q.normal(it)
            if not n:
                continue
            body = q.normal(t)[-2000:] if t and len(t) > 5000 else q.normal(t)
            if (d := brute(n, body)) <= int(q.ERROR_RATE * len(n)):
                want.add((i, j, d))
    sf = table(spark, tmp_path, "documents", docs(spark, texts))
    table(spark, tmp_path, "benchmark", items_df(spark, list(enumerate(items))))
    got = [tuple(r) for r in q.op5_decontamination(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10
    d, b = read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark")
    assert {tuple(r) for r in q.contaminated(d, b, batch_items=4).collect()} == want
    kept = q.decontamination_stage(spark, d, sf)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {x[0] for x in want}


def test_empty_tables(spark, tmp_path):
    sf = table(spark, tmp_path, "documents", docs(spark, ["abc"]))
    table(spark, tmp_path, "benchmark", items_df(spark, []))
    assert q.op5_decontamination(spark, sf).count() == 0
    assert q.decontamination_stage(spark, read_table(spark, sf, "documents"), sf).count() == 1


def test_test_table_holds_its_planted_passages(spark, sf):
    d, b = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/benchmark.parquet")
    exact = {(i, j) for i, t in zip(d.doc_id, d.text.map(q.normal)) for j, x in zip(b.item_id, b.text.map(q.normal)) if x in t}
    got = {(r.doc_id, r.item_id) for r in q.op5_decontamination(spark, sf).where("distance = 0").collect()}
    assert got == exact


def test_items_without_an_id_match(spark, tmp_path):
    big = 2**53 + 1
    sf = table(spark, tmp_path, "documents", docs(spark, ["so the hidden question text is here", "clean", "the other item stands here"]))
    items = [(None, "the hidden question text"), (None, "the hidden question text is"), (None, None), (big, "the other item stands")]
    table(spark, tmp_path, "benchmark", spark.createDataFrame(items, "item_id long, text string"))
    got = [tuple(r) for r in q.op5_decontamination(spark, sf).collect()]
    assert sorted(got) == [(0, None, 0), (2, big, 0)]
    kept = q.decontamination_stage(spark, read_table(spark, sf, "documents"), sf)
    assert [r.doc_id for r in kept.collect()] == [1]


def test_the_number_of_passes_changes_nothing(spark):
    items, texts = planted()
    # Ids with several texts, and the same text under several ids: all must meet across passes.
    rows = [(k % 3, t) for k, t in enumerate(items)] + [(None, t + " x") for t in items[:4]] + [(7, items[0]), (8, items[0]), (7, items[0] + " y")]
    d, b = docs(spark, texts + texts[:3], [k % 11 for k in range(len(texts) + 3)]), items_df(spark, rows)
    want = None
    for size in ({"batch_items": 100}, {"batch_items": 1}, {"batch_items": 2}, {"batch_chars": 200}):
        got = sorted(map(str, (tuple(r) for r in q.contaminated(d, b, **size).collect())))
        want = got if want is None else want
        assert got == want and len(got) > 10


def test_plans_hold_few_passes(spark):
    """Forty passes: no plan holds more than TOGETHER of them, so no task needs more workers."""
    items = [f"item number {k} of the benchmark with a few words" for k in range(40)]
    texts = [f"before {t} after" for t in items] + ["clean"]
    made = q.contaminated(docs(spark, texts), items_df(spark, list(enumerate(items))), batch_items=1)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("MapInArrow") <= q.TOGETHER
    got = {tuple(r)[:2] for r in made.where("distance = 0").collect()}
    assert got == {(k, k) for k in range(40)}
