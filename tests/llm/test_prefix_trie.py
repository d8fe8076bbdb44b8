import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from skein.llm import prefix_trie as trie
from tests.llm.fixtures import table

ROW = T.StructType([T.StructField(n, k) for n, k in (("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("low", T.StringType()), ("i", T.StringType()))])


def lists(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0, key), (role, text)))
    return {c: [t for _, t in sorted(x)] for c, x in convs.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(convs):
    """A dict of all prefixes, each looked at on its own."""
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    rows, done = [], {}
    for p in sorted(members, key=len, reverse=True):
        below = [done[q] for q in children[p]]
        leaves = sum(x[0] for x in below) or 1
        saved = sum(x[1] for x in below) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        done[p] = (leaves, saved)
        ends = ",".join(str(c) for c in members[p] if len(convs[c]) == len(p))
        rows.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def result(df):
    assert df.dtypes == [tuple(x.split()) if not x.endswith("long") else (x.split()[0], "bigint") for x in trie.NODES.split(", ")]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_on_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(trie.op13_prefix_trie(spark, sf)) == brute(rebuilt(lists(rows)))


def made(seed, convs, depth, words):
    """Conversations with many shared beginnings, copies, prefixes of each other, and odd rows."""
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for k in range(rng.randint(1, depth)):
            rows.append((c * rng.choice([1, 1, 1, 5]), rng.choice([k, k, k, None]) if rng.random() < 0.05 else k, rng.choice(["user", "user", None]), rng.choice(words)))
    return rows


@pytest.mark.parametrize("block", [1, 2, 3, 7, 65_536])
def test_any_blocks_equal_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "RUN", 2)
    rows = [*made(block, 60, 6, ["a", "b", "", None, "é"]), (None, 1, "user", "lost"), (3, 0, "user", "a"), (3, 0, "user", "a"), (1_000, 0, "user", "x" * 50_000)]
    df = spark.createDataFrame([(*r, "u", "v") for r in rows], ROW).repartition(3)
    assert result(trie.op13_prefix_trie(spark, table(spark, tmp_path, "conversations", df))) == brute(rebuilt(lists(rows)))


def test_chains_copies_and_one_conversation(spark):
    """Each conversation begins the next one; all equal; a single one; long ones."""
    for convs in ([(c, k, "user", str(k)) for c in range(9) for k in range(c + 1)], [(c, k, "user", str(k)) for c in range(9) for k in range(3)], [(7, 0, "user", "a")], [(c, k, "u", str(k if k < 290 else c)) for c in range(4) for k in range(300)]):
        df = spark.createDataFrame([(*r, "u", "v") for r in convs], ROW)
        assert result(trie.prefix_trie(trie.sequences(trie.conversations_as_lists(df)))) == brute(lists(convs))


def test_turnless_and_empty(spark, tmp_path):
    """An absent base leaves a conversation without turns, a member of the root only."""
    short = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1][:6]
    rows = [(c, 0, "user", "only") for c in short]
    df = spark.createDataFrame([(*r, "u", "v") for r in rows], ROW)
    got = result(trie.op13_prefix_trie(spark, table(spark, tmp_path, "conversations", df)))
    assert got == brute(rebuilt(lists(rows))) and len(got) == 1
    none = table(spark, tmp_path / "none", "conversations", spark.createDataFrame([], ROW))
    assert trie.op13_prefix_trie(spark, none).collect() == []


def test_last_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, None, "b"), (2, 0, "user", "a")]
    df = spark.createDataFrame([(*r, "u", "v") for r in rows], ROW)
    nodes = trie.prefix_trie(trie.sequences(trie.conversations_as_lists(df)))
    assert sorted((r.depth, r.role, r.text) for r in trie.last_turns(nodes, df).where("depth > 0").collect()) == [(1, "user", "a"), (2, "", "b")]
