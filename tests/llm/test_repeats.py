import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from skein.llm import passages, recurring
from skein.llm import repeats as q
from tests.llm.fixtures import docs, table


def brute(texts, length=400):
    datas = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(c for c, g in zip(d, gone) if not g)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = [prose(rng.randint(60, 400)) for _ in range(8)]
    passages = [prose(rng.randint(55, 130)) for _ in range(5)]
    exact = [x[:k] for x, k in zip(passages, (398, 399, 400, 401, 430))]
    texts = list(base)
    for _ in range(30):
        b = rng.choice(base)
        kind = rng.randrange(7)
        if kind == 0:
            texts.append(b)
        elif kind == 1:  # a near copy
            w = b.split(" ")
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        elif kind == 2:
            texts.append(prose(40) + rng.choice(passages) + prose(30) + rng.choice(passages))
        elif kind == 3:
            texts.append(prose(20) + rng.choice(exact) + prose(3))
        elif kind == 4:  # an excerpt that begins and ends inside phrases
            a = rng.randrange(0, 200)
            texts.append(prose(5) + b[a : a + rng.randint(380, 900)] + prose(5))
        elif kind == 5:
            texts.append("".join(rng.choice(base)[x : x + 450] for x in (3, 100, 50)))
        else:
            texts.append(rng.choice(["ab" * 500, "x" * 700, "abc" * 140, "y" * 399, "", prose(2)]))
    return texts + [None, "z" * 401, "q" * 400, "abcdefgh" * 60 + prose(30)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_query_equals_brute_force(spark, tmp_path, seed):
    texts = made(seed)
    sf = table(spark, tmp_path, "documents", docs(spark, texts).repartition(5))
    got = q.op1_repeats(spark, sf).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == brute(texts)
    assert all(r.repeated == (r.n_removed > 0) for r in got)
    assert any(r.n_removed for r in got) and any(r.n_bytes and not r.n_removed for r in got)


@pytest.mark.parametrize("places", [2, 16, 128])
def test_other_triggers_change_nothing(spark, places):
    texts = made(4)
    got = q.remove_repeats(docs(spark, texts).repartition(3), places).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute(texts)


def test_triggers_depend_on_the_window_alone(monkeypatch):
    rng = random.Random(6)
    for alphabet in ("ab", "abcdefgh ", "a"):
        s = "".join(rng.choice(alphabet) for _ in range(1500)).encode()
        at = q.triggers(s)
        for x in range(0, 1101, 13):
            assert (at[x : x + 300] - x == q.triggers(s[x : x + 400])[:300]).all()
    whole = q.triggers(made_long := s * 2 + b"tail" * 30)
    monkeypatch.setattr(q, "CHUNK", 1 << 11)
    assert (whole == q.triggers(made_long)).all()


def test_null_and_repeated_ids(spark, tmp_path):
    long = "".join(random.Random(5).choice("abcdefgh ") for _ in range(900))
    texts, ids = [long, long, long[100:700], "short", None], [7, 7, None, None, 7]
    got = sorted((tuple(r)[:5] for r in q.op1_repeats(spark, table(spark, tmp_path, "documents", docs(spark, texts, ids))).collect()), key=str)
    assert got == sorted([(i, *b) for i, b in zip(ids, brute(texts))], key=str)
    assert q.op1_repeats(spark, table(spark, tmp_path, "documents", docs(spark, []))).count() == 0


def test_general_outputs(spark, sf):
    pdf = pd.read_parquet(f"{sf}/documents.parquet")
    want = dict(zip(pdf.doc_id, brute(pdf.text.tolist())))
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for r in q.remove_repeats(d).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_the_catalogue_is_left_as_it_was(spark, tmp_path):
    before = {t.name for t in spark.catalog.listTables()}
    sf = table(spark, tmp_path, "documents", docs(spark, ["x" * 900, "x" * 900, None]))
    out = q.op1_repeats(spark, sf)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert sorted(r.n_removed for r in out.collect()) == [0, 900, 900]
    kept, starts = q.repeated_windows(docs(spark, ["x" * 900]))
    plan = kept.join(starts.hint("shuffle_hash"), "rid")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(rid") == 1  # the bucketed side stays where it is


def brute_passages(texts, n=51):
    """(runs, words) of words that a run of ``n`` words covers which another text holds too."""
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    held = Counter(w for s in split for w in {tuple(s[i : i + n]) for i in range(len(s) - n + 1)})
    out = []
    for s in split:
        on = [False] * len(s)
        for i in range(len(s) - n + 1):
            if held[tuple(s[i : i + n])] > 1:
                on[i : i + n] = [True] * n
        out.append((sum(x and (not i or not on[i - 1]) for i, x in enumerate(on)), sum(on)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_passages_equal_brute_force(spark, tmp_path, seed, monkeypatch):
    """Passages of over 50 words are found in any spacing and however few bytes they have; what one text alone repeats is not shared."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    short = [prose(n) for n in (49, 50, 51, 52, 60, 83)]
    respaced = lambda x: "".join(rng.choice([" ", "  ", "\n", "\t \r\n"]) if c == " " else c for c in x)
    alone = [prose(70), "x " * 300]
    texts = made(seed) + [prose(60) + " " + x + " " + prose(60) for x in alone for _ in range(1)] + [alone[0] + "\n" + alone[0] + " " + prose(9)]
    texts += [respaced(" ".join([prose(rng.randint(0, 40)), rng.choice(short), prose(rng.randint(0, 40)), rng.choice(short)])) for _ in range(40)]
    texts += ["\u00a0".join(["q"] * 60) + " " + short[4], "b " * 51, " c" * 50, "c " * 50, " \n ", "d " * 120, prose(51)]
    want = brute_passages(texts)
    monkeypatch.setattr(passages, "SLICE", 700)
    got = q.op1_repeats(spark, table(spark, tmp_path, "documents", docs(spark, texts).repartition(4))).orderBy("doc_id").collect()
    assert [(r.n_shared, r.shared_words) for r in got] == want
    assert any(r.shared_words and not r.repeated for r in got) and any(r.repeated and not r.shared_words for r in got)


def test_word_triggers_depend_on_the_window_alone(monkeypatch):
    rng = random.Random(8)
    words = [rng.choice(["a", "b", "cd", "efghijklm", "nopqrstuvwxyzabcdefgh"]) for _ in range(400)]
    text, starts, firsts = passages.words([" ".join(words).encode()])
    assert firsts.tolist() == [0, 400] and text == (" ".join(words) + " ").encode()
    whole = passages.word_triggers(text, starts)
    for x in range(0, 350, 7):
        part, at, _ = passages.words([" ".join(words[x : x + 51]).encode()])
        assert passages.word_triggers(part, at)[0] + x == whole[x]
    monkeypatch.setattr(passages, "PART", 100)
    assert (passages.word_triggers(text, starts) == whole).all()


def test_hashes_travel_packed(spark, monkeypatch):
    """Contexts and windows are no rows of their own: no table on the way has more than a row a region."""
    rng, rows = random.Random(9), {}
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    base = prose(400).split(" ")
    texts = [" ".join(base[:k] + [prose(1)] + base[k + 1 :]) for k in range(20, 380, 8)]

    def counting(df, tag, write=q.written):
        out = write(df, tag)
        rows[tag] = max(rows.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(q, "written", counting)
    monkeypatch.setattr(passages, "written", counting)
    got = q.remove_repeats(docs(spark, texts).repartition(3)).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute(texts)
    assert [(r.n_shared, r.shared_words) for r in got] == brute_passages(texts)
    regions = sum(len(q.runs(q.triggers(t.encode()))[0]) for t in texts)
    assert rows["open"] and max(rows.values()) <= regions, (regions, rows)


@pytest.mark.parametrize("width, apart", [(1, False), (2, False), (1, True), (2, True)])
def test_recurring_hashes_equal_a_count(width, apart):
    """Slices, parts and answers give what a count of all entries gives, and a hash reaches its part once a slice that settles it."""
    rng = random.Random(width)
    entries = [(d, x, rng.choice([0, 1, rng.randrange(60), rng.randrange(4000)]), rng.random() < 0.2) for d in range(30) for x in range(rng.randint(0, 40))]
    held = {}
    for d, x, k, known in entries:
        held.setdefault(k, []).append("known" if known else d if apart else (d, x))
    want = sorted((d, x) for d, x, k, known in entries if not known and ("known" in held[k] or len(set(held[k])) > 1))
    key = lambda k: [k // 7, k % 7] if width == 2 else [k]
    rows = []
    for lo in range(0, 30, 6):
        mine = [e for e in entries if lo <= e[0] < lo + 6]
        columns = [np.array([e[i] for e in mine]) for i in range(2)]
        keys = np.array([key(e[2]) for e in mine], np.uint64)
        out = recurring.packed(4, np.arange(lo, lo + 6) + 100, keys, columns[0] - lo, columns[1], np.array([e[3] for e in mine]), apart)
        rows.append(out.to_pandas())
        told = b"".join(rows[-1].known)
        told = [told[i : i + 8 * width] for i in range(0, len(told), 8 * width)]
        assert len(told) == len(set(told))
    rows = pd.concat(rows)
    answers = pd.concat([recurring._answer(4, width, apart, g) for _, g in rows.groupby("part")])
    got = pd.concat([recurring._ranges(g) for _, g in answers.groupby("sid")])
    assert sorted((r - 100, x) for r, a, b in got.itertuples(index=False) for x in range(a, b + 1)) == want
    got = pd.concat([recurring._places(g) for _, g in answers.groupby("sid")])
    assert sorted((r - 100, x) for r, p in got.itertuples(index=False) for x in np.frombuffer(p, "<u4").tolist()) == want
