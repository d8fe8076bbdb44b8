"""Prefix trie of conversations: a Cartesian tree over the LCP array of the sorted conversations.

1. A turn's key is the MD5 of its role and text, a sequence the row of its keys. Sequences are sorted (ranges of the order, copies of a
   conversation spread over ranges by their ids); equal ones become one row with their number, smallest id and the hash of their ids.
2. Neighbours in the order give the LCP array: turns that a sequence shares with the one before.
3. All nearest smaller values, in parallel: each BLOCK of the array resolves what it can by itself and sends out its falling minima from
   both ends. A value without a smaller one in its block finds the nearest block with a smaller minimum, and there the nearest such value.
4. Each value's nearest smaller ones bound an interval of sequences; values with the same interval are one node of the tree. A sequence on
   its own is a leaf. A node stands for the depths below its parent's value down to its own: these are all the trie's nodes.
5. Sums over an interval are differences of running sums, smallest ids come with the bounds from step 3.

Nothing here grows on the driver but one row a partition and one a BLOCK of distinct sequences. One sequence is one row of 16 bytes a
turn: conversations are never gathered with their texts.

Cases: rows without conv_id take no part; null roles and texts are empty; equal turns of a conversation stand in the order of their keys, and
repeated rows are turns of their own; conversations without turns belong to the root; an empty table gives an empty result, without a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import discard, read_table, slices, written

BLOCK = 65_536  # places of the LCP array that one task resolves
RUN = 1024  # ids of equal conversations in one row
KEY = 16  # bytes of a turn's key
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_FAR = np.iinfo(np.int64).max


def conversations_as_lists(conversations: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<turn, key, bytes>> in order, for conversations(conv_id, turn, role, text)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.md5(F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")).cast("binary"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), key.alias("key"), F.octet_length(text("text")).cast("long").alias("bytes")).alias("t")
    )
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def sequences(lists: DataFrame) -> DataFrame:
    """conv_id, keys binary, bytes array<long>: what the trie is built from."""
    return lists.select("conv_id", F.unhex(F.array_join("turns.key", "")).alias("keys"), F.col("turns.bytes").alias("bytes"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """Each conversation c with its first h turns replaced by the first h of conversation c - c mod 5; h = crc32(decimal c) mod 9."""
    heads = lists.select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    rows = lists.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(5))).withColumn("h", h).join(heads, "base", "left")
    empty = F.slice("turns", 1, 0)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.concat(F.slice(F.coalesce("head", empty), F.lit(1), F.col("h")), rest).alias("turns"))


# --- 1. distinct sequences in order ---------------------------------------------------------------


def _runs(run: int, batches: Iterator) -> Iterator:
    """Sorted rows: equal sequences that follow each other as one row for each ``run`` of them, their ids as text."""
    import pyarrow as pa

    keys, sizes, ids = None, None, []

    def row():
        return keys, sizes, ids[0], len(ids), ",".join(map(str, ids))

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()))], names=["keys", "bytes", "conv", "mult", "ids"])

    for batch in slices(batches):
        out = []
        for k, b, c in zip(*(batch.column(n).to_pylist() for n in ("keys", "bytes", "conv_id"))):
            if ids and (k != keys or len(ids) == run):
                out.append(row())
                ids = []
            keys, sizes = k, b
            ids.append(c)
        if out:
            yield packed(out)
    if ids:
        yield packed([row()])


def _distinct(batches: Iterator) -> Iterator:
    """Runs sorted by their sequence's hash, then first id: one row a sequence. Ids are hashed as they pass, none are kept."""
    import pyarrow as pa

    kind = (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string())
    now, keys, sums, conv, mult, sha = None, None, None, None, 0, None

    def row():
        return keys, sums, conv, mult, sha.hexdigest()

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind)], names=["keys", "sums", "conv", "mult", "ends"])

    for batch in slices(batches):
        out = []
        for h, k, b, c, m, ids in zip(*(batch.column(n).to_pylist() for n in ("hash", "keys", "bytes", "conv", "mult", "ids"))):
            if h != now:
                if mult:
                    out.append(row())
                now, keys, sums, conv, mult, sha = h, k, np.cumsum([0, *b]).tolist(), c, 0, hashlib.sha256()
            sha.update(f",{ids}".encode() if mult else ids.encode())
            mult += m
        if out:
            yield packed(out)
    if mult:
        yield packed([row()])


def _common(a: bytes, b: bytes) -> int:
    """Keys that two sequences begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // KEY
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // KEY


def _neighbours(batches: Iterator) -> Iterator:
    """Sorted sequences with ``at``, their place in this part, ``lcp`` with the one before (null for the part's first), and its number of turns."""
    import pyarrow as pa

    at, last = 0, None
    for batch in slices(batches):
        lcp, before = [], []
        for k in batch.column("keys").to_pylist():
            lcp.append(None if last is None else _common(last, k))
            before.append(None if last is None else len(last) // KEY)
            last = k
        more = [pa.array(range(at, at + len(lcp)), pa.int64()), pa.array(lcp, pa.int64()), pa.array(before, pa.int64())]
        at += len(lcp)
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "at", "lcp", "before"])


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def lcp_array(seqs: DataFrame) -> DataFrame:
    """i, keys, sums (of bytes up to each depth), conv, mult, ends, lcp, before: distinct sequences in order, written."""
    parts = _parts(seqs)
    seqs = written(seqs, "sequences")
    runs = seqs.repartitionByRange(parts, "keys", "conv_id").sortWithinPartitions("keys", "conv_id").mapInArrow(partial(_runs, RUN), "keys binary, bytes array<long>, conv long, mult long, ids string")
    runs = runs.withColumn("hash", F.md5("keys")).repartition(parts, "hash").sortWithinPartitions("hash", "conv")
    one = written(runs.mapInArrow(_distinct, "keys binary, sums array<long>, conv long, mult long, ends string"), "distinct")
    ranged = one.repartitionByRange(parts, "keys").sortWithinPartitions("keys").withColumn("part", F.spark_partition_id())
    kinds = "keys binary, sums array<long>, conv long, mult long, ends string, part int, at long, lcp long, before long"
    placed = written(ranged.mapInArrow(_neighbours, kinds), "order")
    discard(seqs, one)
    # One row a part: where it begins, and the last sequence of the part before.
    counts = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for k, (part, n) in enumerate(counts):
        starts.append((part, total, counts[k + 1][0] if k + 1 < len(counts) else -1, n - 1))
        total += n
    starts = seqs.sparkSession.createDataFrame(starts or [(-1, 0, -1, 0)], "part int, start long, next int, last long")
    ends = placed.join(F.broadcast(starts), "part").where("at = last").select(F.col("next").alias("part"), F.col("keys").alias("end"))
    seams = placed.where("at = 0").select("part", "keys").join(ends, "part")

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"part": pdf["part"], "seam": [_common(bytes(a), bytes(b)) for a, b in zip(pdf["end"], pdf["keys"])], "turns": [len(a) // KEY for a in pdf["end"]]})

    seams = seams.mapInPandas(met, "part int, seam long, turns long")
    rows = placed.join(F.broadcast(starts.select("part", "start")), "part").join(F.broadcast(seams), "part", "left")
    first = F.col("at") == 0
    lcp = F.when(first, F.coalesce("seam", F.lit(-1))).otherwise(F.col("lcp"))
    before = F.when(first, F.coalesce("turns", F.lit(-2))).otherwise(F.col("before"))
    out = written(rows.select((F.col("start") + F.col("at")).alias("i"), "keys", "sums", "conv", "mult", "ends", lcp.alias("lcp"), before.alias("before")), "lcp")
    discard(placed)
    return out


# --- 2. all nearest smaller values -----------------------------------------------------------------

_LOCAL = "block long, i long, lcp long, a long, a_min long, b long, b_min long, convs long, member_bytes long, new_bytes long, inner long"


def _nearest(lcp: list[int], conv: list[int], lo: int) -> tuple[list, list]:
    """For each place: the nearest earlier place in the list with a smaller value (None if none), and the smallest id from there up to it."""
    place, least, stack = [], [], []
    for j, v in enumerate(lcp):
        low = _FAR if j == 0 else conv[j - 1]
        while stack and lcp[stack[-1]] >= v:
            low = min(low, least[stack.pop()])
        # What lies between the smaller place and this one; all from the list's start if there is none.
        place.append(lo + stack[-1] if stack else None)
        least.append(low)
        stack.append(j)
    return place, least


def _within(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's own nearest smaller values and running sums; element i lies between places i and i + 1."""
    pdf = pdf.sort_values("i")
    i, lcp, conv = (pdf[c].to_numpy(np.int64) for c in ("i", "lcp", "conv"))
    lo, hi = int(i[0]), int(i[-1]) + 1
    a, a_min = _nearest(lcp.tolist(), conv.tolist(), 0)
    # The same from the right: the list is turned round, and place i has element i to its right.
    turned = [-2, *lcp[::-1].tolist()]
    b, b_min = _nearest(turned, conv[::-1].tolist(), 0)
    b, b_min = b[:0:-1], b_min[:0:-1]
    # Place p of the turned list is hi - p; its own first entry stands for the next block's start and settles nothing.
    b = [None if not x else hi - x for x in b]
    running = lambda c: np.cumsum(pdf[c].to_numpy(np.int64)) - pdf[c].to_numpy(np.int64)
    whole = lambda x: pd.array(x, "Int64")
    return pd.DataFrame({
        "block": pdf["block"], "i": i, "lcp": lcp, "a": whole([None if x is None else lo + x for x in a]), "a_min": whole(a_min), "b": whole(b), "b_min": whole(b_min),
        **{name: running(name) for name in ("convs", "member_bytes", "new_bytes", "inner")},
    })


class _Blocks:
    """Minima of blocks in order; finds the next block with a smaller value and the smallest id on the way, in log steps."""

    def __init__(self, least: list[int], conv: list[int]):
        self.levels = [(np.array(least, np.int64), np.array(conv, np.int64))]
        while len(self.levels[-1][0]) > 1 << (len(self.levels) - 1):
            values, ids = self.levels[-1]
            step = 1 << (len(self.levels) - 1)
            pair = lambda x: np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]  # noqa: B023, E731
            self.levels.append((pair(values), pair(ids)))

    def after(self, block: int, value: int) -> tuple[int, int]:
        """(the first block past ``block`` with a value below ``value``, or their number; the smallest id between)."""
        at, low = block + 1, _FAR
        for level in range(len(self.levels) - 1, -1, -1):
            values, ids = self.levels[level]
            if at < len(values) and values[at] >= value:
                low = min(low, int(ids[at]))
                at += 1 << level
        return at, low


def _beyond(chains: DataFrame, targets: DataFrame, blocks: _Blocks, n_blocks: int, forward: bool) -> DataFrame:
    """block, lcp, place, low for the open values ``chains(block, lcp)``: the nearest smaller place in other blocks among
    ``targets(block, lcp, place, low)``, and the smallest id from the own block's edge to it. Place is null if there is none."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [blocks.after(b if forward else n_blocks - 1 - b, v) for b, v in zip(pdf["block"].tolist(), pdf["lcp"].tolist())]
            yield pdf[["block", "lcp"]].assign(target=[q if forward else n_blocks - 1 - q for q, _ in found], between=[m for _, m in found])

    asked = chains.select("block", "lcp").mapInPandas(ask, "block long, lcp long, target long, between long")
    there = targets.select(F.col("block").alias("target"), F.col("lcp").alias("smaller"), "place", "low")
    pairs = asked.join(there, "target").where("smaller < lcp")
    pick = F.min if forward else F.max
    nearest = pairs.groupBy("block", "lcp").agg(pick(F.struct("place", "low")).alias("x"))
    return asked.join(nearest, ["block", "lcp"], "left").select("block", "lcp", F.col("x.place").alias("place"), F.least("between", F.coalesce("x.low", F.lit(_FAR))).alias("low"))


def intervals(array: DataFrame) -> DataFrame:
    """Each place of the LCP array (i, lcp) with its interval a to b, the smallest id in it, and running sums up to it; written.

    ``array(i, lcp, conv, convs, member_bytes, new_bytes, inner)``; place 0 has -1 and bounds nothing.
    """
    spark = array.sparkSession
    grouped = array.withColumn("block", F.expr(f"i div {BLOCK}")).groupBy("block")
    sums = ("convs", "member_bytes", "new_bytes", "inner")
    totals = sorted(grouped.agg(F.min("lcp").alias("lcp"), F.min("conv").alias("conv"), F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sums)).collect())
    local = written(grouped.applyInPandas(_within, _LOCAL), "within")
    n_blocks, end = len(totals), sum(r.n for r in totals)
    offsets, so_far = [], [0] * len(sums)
    for r in totals:
        offsets.append((r.block, *so_far))
        so_far = [x + r[c] for x, c in zip(so_far, sums)]
    # Falling minima from both ends of each block: they are open on that side, and nearest smaller places for other blocks.
    left = written(local.where("a is null").groupBy("block", "lcp").agg(F.min(F.struct(F.col("i").alias("place"), F.col("a_min").alias("low"))).alias("x")).select("block", "lcp", "x.*"), "chains")
    right = written(local.where("b is null").groupBy("block", "lcp").agg(F.max(F.struct(F.col("i").alias("place"), F.col("b_min").alias("low"))).alias("x")).select("block", "lcp", "x.*"), "chains")
    ahead = _Blocks([r.lcp for r in totals], [r.conv for r in totals])
    back = _Blocks([r.lcp for r in totals[::-1]], [r.conv for r in totals[::-1]])
    a = _beyond(left, right, back, n_blocks, False).select("block", "lcp", F.col("place").alias("a2"), F.col("low").alias("a_low"), F.lit(True).alias("a_open"))
    b = _beyond(right, left, ahead, n_blocks, True).select("block", "lcp", F.coalesce("place", F.lit(end)).alias("b2"), F.col("low").alias("b_low"), F.lit(True).alias("b_open"))
    base = spark.createDataFrame(offsets, "block long, " + ", ".join(f"{c}_0 long" for c in sums))
    closed_a, closed_b = local.where("a is not null"), local.where("a is null").join(a, ["block", "lcp"], "left")
    rows = closed_a.withColumn("a2", F.lit(None).cast("long")).withColumn("a_low", F.lit(_FAR)).withColumn("a_open", F.lit(False)).unionByName(closed_b)
    shut, open_ = rows.where("b is not null"), rows.where("b is null").join(b, ["block", "lcp"], "left")
    rows = shut.withColumn("b2", F.lit(None).cast("long")).withColumn("b_low", F.lit(_FAR)).withColumn("b_open", F.lit(False)).unionByName(open_)
    rows = rows.join(F.broadcast(base), "block")  # one row a block
    out = written(
        rows.select(
            "i", "lcp", F.coalesce("a", "a2").alias("a"), F.coalesce("b", "b2").alias("b"), F.least("a_min", "a_low", "b_min", "b_low").alias("low"),
            *((F.col(c) + F.col(f"{c}_0")).alias(c) for c in sums),
        ),
        "intervals",
    )
    discard(local, left, right)
    last = spark.createDataFrame([(end, -1, None, None, None, *so_far)], out.schema)
    return out.unionByName(last)


# --- 3. the trie ------------------------------------------------------------------------------------


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each distinct prefix.

    ``seqs(conv_id, keys, bytes)``: a conversation's turn keys and the UTF-8 bytes of their texts.
    """
    array = lcp_array(seqs)
    if not array.take(1):
        return seqs.sparkSession.createDataFrame([], NODES)
    turns = F.size("sums") - 1
    at = lambda d: F.element_at("sums", (d + 1).cast("int"))
    new = at(turns) - at(F.greatest("lcp", F.lit(0)))
    inner = (F.col("lcp") == F.col("before")).cast("long")  # the sequence before begins this one: it is no leaf
    numbers = array.select("i", "lcp", "conv", F.col("mult").alias("convs"), (F.col("mult") * at(turns)).alias("member_bytes"), new.alias("new_bytes"), inner.alias("inner"))
    places = intervals(numbers)
    leaves = array.select(F.col("i").alias("a"), (F.col("i") + 1).alias("b"), turns.cast("long").alias("lcp"), F.lit(0).cast("long").alias("cuts"), F.col("conv").alias("low"))
    inside = places.where("lcp >= 0").groupBy("a", "b", "lcp").agg(F.count("*").alias("cuts"), F.min("low").alias("low")).select("a", "b", "lcp", "cuts", "low")
    sums = ("convs", "member_bytes", "new_bytes", "inner")
    left = places.select(F.col("i").alias("a"), F.col("lcp").alias("a_lcp"), F.col("low").alias("a_low"), *(F.col(c).alias(f"a_{c}") for c in sums))
    left = left.join(array.select(F.col("i").alias("a"), "sums", turns.cast("long").alias("turns"), "ends", new.alias("own_new"), inner.alias("own_inner")), "a")
    right = places.select(F.col("i").alias("b"), F.col("lcp").alias("b_lcp"), F.col("low").alias("b_low"), *(F.col(c).alias(f"b_{c}") for c in sums))
    nodes = leaves.unionByName(inside).join(left, "a").join(right, "b")
    nodes = nodes.withColumn("above", F.greatest("a_lcp", "b_lcp")).where("above < lcp")
    nodes = nodes.select(
        "low", "above", "turns", "ends", "lcp",
        F.when(F.col("above") >= 0, F.when(F.col("a_lcp") >= F.col("b_lcp"), F.col("a_low")).otherwise(F.col("b_low"))).alias("parent"),
        (F.col("b_convs") - F.col("a_convs")).alias("n_convs"),
        (F.col("b_member_bytes") - F.col("a_member_bytes")).alias("member_bytes"),
        # New bytes of the first sequence from its start, of the others from where they leave it.
        (F.col("b_new_bytes") - F.col("a_new_bytes") - F.col("own_new") + at(F.col("turns"))).alias("trie_bytes"),
        F.when(F.col("cuts") > 0, F.col("cuts") + 1 - (F.col("turns") == F.col("lcp")).cast("long")).otherwise(0).alias("below"),
        (F.col("b") - F.col("a") - F.col("b_inner") + F.col("a_inner") + F.col("own_inner")).alias("n_leaves"),
        # Bytes above each depth.
        F.transform(F.sequence(F.col("above") + 1, F.col("lcp")), lambda d: at(F.greatest(d - 1, F.lit(0)))).alias("over"),
    )
    each = nodes.select("*", F.posexplode("over").alias("k", "bytes_above")).withColumn("depth", F.col("above") + 1 + F.col("k"))
    return each.select(
        F.col("low").alias("conv_id"), "depth", F.when(F.col("k") == 0, F.col("parent")).otherwise(F.col("low")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("depth") < F.col("lcp"), 1).otherwise(F.col("below")).cast("long").alias("n_children"), "n_leaves",
        (F.col("member_bytes") - F.col("n_convs") * F.col("bytes_above") - F.col("trie_bytes") + F.col("bytes_above")).alias("saved_tokens"),
        F.when(F.col("depth") == F.col("turns"), F.col("ends")).otherwise(F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def last_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of a trie of ``conversations`` as they are, with role and text of each one's last turn (null for the root)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.md5(F.concat(F.length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")).cast("binary"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), key)
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.row_number().over(order).cast("long").alias("depth"), text("role").alias("role"), text("text").alias("text"))
    return nodes.join(turns, ["conv_id", "depth"], "left")


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt by its contract's rule."""
    return prefix_trie(sequences(rebuilt(conversations_as_lists(read_table(spark, sf_dir, "conversations")))))
