"""SimHash near-duplicates with pigeonring candidates.

Fingerprint: 64 bits; bit k is 1 if over half of a text's shingle hashes have it. Two fingerprints
link at 3 or fewer differing bits; a document's group is the smallest doc_id it reaches by links.

Candidates. The 64 bits form a ring of 8 segments of 8 bits. If at most 3 bits differ, then from
some segment on, every chain of l consecutive segments (l = 1 .. 8) differs in at most 3*l/8 bits:
nothing in 2 segments, at most one bit in 5. So the first two segments of that chain are equal, and
of the next three at least two: 24 keys of 32 bits for a fingerprint. Pairs that share a key must
pass the whole chain of budgets from its start, then the full Hamming check.

Equal fingerprints are one node from the start. A key's fingerprints are compared inside a task by
xor and bit counts; only a spanning forest of the links found leaves the task. Keys with many
fingerprints are cut into blocks, and each pair of blocks is compared on its own.

Cases: a null or empty text has no word and gets fingerprint zero, which links like any other; fewer
words than a shingle form one shingle; repeated rows share a fingerprint; an empty table gives an
empty result; rows with a null doc_id get the group of their fingerprint's smallest doc_id, or null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import near_copies
from skein.llm.common import counted_join, discard, id_text, read_table, slices, written
from skein.llm.components import components

SHINGLE = 3
SEED = 42
BITS = 3
SEGMENTS = 8
BLOCK = 1024

_words = re.compile(rb"[^\x20\x09-\x0D]+")
_upper = bytes(range(65, 91))
_to_lower = bytes.maketrans(_upper, _upper.lower())


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text."""
    words = _words.findall((text or "").encode("utf-8", "replace").translate(_to_lower))
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths)
        starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
        stops = (ends - 1)[shingle - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, stops)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 for none."""
    total, n = np.zeros(64, np.int64), len(hashes)
    raw = hashes.astype(">u8").view("u1")
    for lo in range(0, len(raw), 8 * 8192):
        total += np.unpackbits(raw[lo : lo + 8 * 8192].reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _fingerprints(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in slices(batches):
        found = pa.array([_signed(fingerprint(t)) for t in batch.column("text").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (as a signed 64-bit number)."""
    return id_text(docs).mapInArrow(_fingerprints, "doc_id long, fp long")


def chain_masks(start: int, segments: int = SEGMENTS) -> list[int]:
    """Bit masks of the chains of 1 .. ``segments`` segments from ``start`` on."""
    width, out, mask = 64 // segments, [], 0
    for k in range(segments):
        mask |= ((1 << width) - 1) << (64 - width * ((start + k) % segments + 1))
        out.append(mask)
    return out


def key_masks() -> list[tuple[int, int]]:
    """(start, mask) of the 24 keys: two segments, and two of the three that follow."""
    out = []
    for start in range(SEGMENTS):
        seg = [chain_masks((start + k) % SEGMENTS)[0] for k in range(5)]
        out += [(start, seg[0] | seg[1] | seg[a] | seg[b]) for a, b in ((2, 3), (2, 4), (3, 4))]
    return out


@lru_cache
def _budgets(start: int) -> list[tuple[np.uint64, int]]:
    """(mask, most differing bits) of each chain from a start on."""
    return [(np.uint64(m), BITS * (k + 1) // SEGMENTS) for k, m in enumerate(chain_masks(start))]


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def linked(a: np.ndarray, b: np.ndarray, start: int, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks that pass the chain from ``start`` and the Hamming check."""
    parent, out = np.arange(len(a) + (0 if same else len(b))), []
    budgets = _budgets(start)
    for i in range(len(a)):
        rest = b[i + 1 :] if same else b
        x, at = rest ^ a[i], np.arange(i + 1, len(b)) if same else np.arange(len(b)) + len(a)
        for mask, most in budgets:
            ok = np.bitwise_count(x & mask) <= most
            x, at = x[ok], at[ok]
            if not len(x):
                break
        for j in at:
            r, s = _find(parent, i), _find(parent, int(j))
            if r != s:
                parent[max(r, s)] = min(r, s)
                out.append((i, int(j)))
    return out


def _compare(masks: list[tuple[int, int]]):
    cols = ["k", "key", "i", "j", "block", "fp"]

    def forest(g: np.ndarray) -> list[tuple[int, int]]:
        """Links within one key's block, or between its two blocks; ``g`` holds the columns of its rows."""
        (k, _, i, j), mine, fps = g[0, :4], g[:, 4], g[:, 5].view(np.uint64)
        a, b = (fps, fps) if i == j else (fps[mine == i], fps[mine == j])
        every = g[:, 5] if i == j else np.concatenate([a, b]).view(np.int64)
        return [(int(every[x]), int(every[y])) for x, y in linked(a, b, masks[k][0], bool(i == j))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by key and pair of blocks; the last group of a batch may go on in the next.
        rest = np.empty((0, len(cols)), np.int64)

        def result(groups: list[np.ndarray]) -> pd.DataFrame:
            found = [link for g in groups for link in forest(np.ascontiguousarray(g))]
            return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

        for pdf in batches:
            rows = np.concatenate([rest, pdf[cols].to_numpy(np.int64)])
            cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            groups = np.split(rows, cuts)
            rest = groups.pop()
            yield result(groups)
        if len(rest):
            yield result([rest])

    return run


def links(distinct: DataFrame) -> DataFrame:
    """A spanning forest a, b of the links between the distinct fingerprints ``fp``."""
    masks = key_masks()
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, (_, m) in enumerate(masks)])
    rows = distinct.select("fp", F.explode(keys).alias("x")).select("fp", "x.k", "x.key")
    # A key that one fingerprint has is no candidate; the others learn how many blocks they need.
    shared = rows.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1").select("k", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(shared, ["k", "key"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = rows.withColumn("other", other).select("k", "key", "fp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # A fixed number of parts: comparing costs far more than the few bytes of these rows tell.
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartition(n, "k", "key", "i", "j").sortWithinPartitions("k", "key", "i", "j")
    return dealt.mapInPandas(_compare(masks), "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row of docs(doc_id, text).

    Rows of a fingerprint that a large share of all rows has (junk, copies) meet its group where they are.
    """
    marked = written(fingerprints(docs), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    roots = components(links(classes.select("fp"))).select(F.col("node").alias("fp"), "root")
    least = classes.join(roots, "fp").groupBy("root").agg(F.min("first").alias("least"))
    group = classes.join(roots, "fp", "left").join(least, "root", "left").select("fp", "n", F.coalesce("least", "first").alias("component_id"))
    groups = written(group, "groups")
    discard(classes)
    return counted_join(marked, groups, ["fp"]).select("doc_id", "fp", "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    out = near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _marks(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in slices(batches):
        found = [near_copies.hashed(t) for t in batch.column("text").to_pylist()]
        nodes, sizes = pa.array([d for d, _ in found], pa.int64()), pa.array([len(np.unique(h)) for _, h in found], pa.int64())
        fps = pa.array([_signed(majority(h)) for _, h in found], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), nodes, sizes, fps], names=["row", "doc_id", "node", "n", "fp"])


def marks(rows: DataFrame) -> DataFrame:
    """row, doc_id, node, n, fp for rows(row, doc_id, text): ``near_copies``' node and size of its set, and the fingerprint of its shingles."""
    return rows.select("row", "doc_id", "text").mapInArrow(_marks, "row long, doc_id long, node long, n long, fp long")


def alike(marked: DataFrame) -> DataFrame:
    """Pairs a, b of nodes that connect what SimHash links in marked(node, fp): the first node of each fingerprint with its others and those of linked ones."""
    nodes = written(marked.groupBy("node").agg(F.min("fp").alias("fp")), "fingerprints")
    classes = written(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "classes")
    within = counted_join(nodes, classes, ["fp"]).where("node <> first").select("first", "node")
    end = lambda fp, node: classes.select(F.col("fp").alias(fp), F.col("first").alias(node))
    across = links(classes.select("fp")).join(end("a", "first"), "a").join(end("b", "node"), "b").select("first", "node")
    pairs = within.unionByName(across).select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b"))
    pairs = written(pairs, "alike")
    discard(nodes, classes)
    return pairs


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies (5-word shingles, similarity 0.8) one row.

    SimHash links, found by pigeonring keys over fingerprints of those shingles, are verified first; ``near_copies`` then finds, among what
    they leave apart, the pairs whose fingerprints lie further from each other.
    The row with the smallest doc_id stays, null ids last; of repeated rows one. Groups do not depend on ids.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = written(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "rows")
    key, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    rows = plain.select("row", F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    marked = written(marks(rows), "nodes")
    kept = near_copies.first_rows(rows, marked, alike(marked))
    return near_copies.chosen(plain, kept).select(*names).toDF(*docs.columns)
