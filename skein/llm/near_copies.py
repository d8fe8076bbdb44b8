"""Near copies by an exact set join: Jaccard similarity of word shingles, prefix filter, verified pairs.

A text's set holds the 64-bit hashes of its shingles of ``shingle`` words (ASCII lower case, white space
apart; fewer words form one shingle). Texts with equal words are one node, a 64-bit hash of them: of 10^9 different texts any two share
theirs with odds of 3 in 100, and one of such two would count as a copy.

Candidates. Of a set of n shingles a partner at similarity 4/5 holds at least ceil(4n/5). So in any order of all shingles
the first n - ceil(4n/5) + 1 of both sets have one in common. The order is by the number of rows that hold a shingle, rarest
first: shingles of one row alone fill the prefix and match nothing, and most nodes drop out with that.

A text with a partner shares ceil(4n/5) of its n shingles with other rows. So a first pass only counts, for each row, the shingles that some other
row has too: five bytes a shingle are dealt by its hash, 32 bits of it and its text's place in a run of rows. Equal bits of different shingles
make a count too large, never too small, so rows that fall short have no partner and go. The rest, one row a node, is dealt again with whole hashes, ten
bytes a shingle. Shingles that repeat within runs are counted before, with an aggregate that combines; hot ones, over
one in HOT of all shingles, are known everywhere and dealt by their run, so no group holds all rows of one. Only shingles of two rows or more come back, and they tell the sizes of all overlaps.

Pairs that SimHash finds are verified first. Then, in a key that still holds several components, nodes are
verified against those of its smallest and largest one; keys that hold several even then compare
all their pairs: small keys as rows, large ones in blocks inside tasks, from which only a spanning forest of verified
links comes out. No pair at or over the threshold is lost but by equal hashes.

Cases: null and empty texts have no shingle and are one node; equal rows are one node; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import HOT, discard, slices, written
from skein.llm.components import components

SHINGLE = 5
SIMILARITY = (4, 5)
SEED = 42
CHUNK = 1024  # texts whose shingles are packed at once
OFTEN = 4  # texts of a run that share a shingle before its run counts it
COLUMNS = 4096  # shingles of a large key's sets that are compared at once
PART = 1_000_000  # shingles a part holds at most, on average
LARGE = 64  # nodes of a key; the pairs of larger keys are compared inside tasks
BLOCK = 512  # nodes of a large key that meet another such block in one group

_words = re.compile(rb"[^\x20\x09-\x0D]+")
_upper = bytes(range(65, 91))
_to_lower = bytes.maketrans(_upper, _upper.lower())


def hashed(text: str | None, shingle: int = SHINGLE) -> tuple[int, np.ndarray]:
    """A node's number and the hashes of its shingles, repeats included."""
    words = _words.findall((text or "").encode("utf-8", "replace").translate(_to_lower))
    line = b" ".join(words)
    node = xxhash.xxh3_64_intdigest(line, SEED)
    digest = xxhash.xxh64_intdigest
    if not words:
        hashes = []
    elif len(words) <= shingle:
        hashes = [digest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-shingle].tolist()]
        stops = (ends[shingle - 1 :] - 1).tolist()
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))
    return node - (node >> 63 << 64), np.asarray(hashes, np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> tuple[int, np.ndarray]:
    """A node's number and its distinct shingle hashes (signed)."""
    node, hashes = hashed(text, shingle)
    return node, np.unique(hashes).view(np.int64)


def _runs(shingle: int, batches: Iterator) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(start, shingles, their rows' places from it) of rows in one CHUNK of row numbers; rows in between may be missing."""
    import pyarrow as pa

    for batch in slices(batches, CHUNK):
        rows = batch.column("row").to_numpy()
        order = np.argsort(rows, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(rows[order] // CHUNK)) + 1):
            found, seen = [], set()
            for t in batch.column("text").take(pa.array(run)).to_pylist():
                node, keys = shingles(t, shingle)
                # Copies in a run are sent once, in the first row's place: a node's smallest row is the first of its run.
                found.append(keys[:0] if node in seen else keys)
                seen.add(node)
            keys, start = np.concatenate(found), int(rows[run[0]]) // CHUNK * CHUNK
            if len(keys):
                yield start, keys, np.repeat((rows[run] - start).astype("<u2"), list(map(len, found)))


def _repeated(shingle: int, batches: Iterator) -> Iterator:
    """key, n: the shingles that OFTEN texts or more of a run hold."""
    import pyarrow as pa

    for _, keys, _ in _runs(shingle, batches):
        key, n = np.unique(keys, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key[n >= OFTEN]), pa.array(n[n >= OFTEN].astype(np.int64))], names=["key", "n"])


def _packed(shingle: int, parts: int, hot: Broadcast, batches: Iterator) -> Iterator:
    """part, row, keys, places: the shingles of one part in a run of rows, whose places count from ``row``.

    Hot shingles come in parts of their own, from ``parts`` on, by their run.
    """
    import pyarrow as pa

    common = hot.value[0]
    for row, keys, places in _runs(shingle, batches):
        part = (keys.view(np.uint64) % np.uint64(parts)).astype(np.int64)
        part[np.isin(keys, common)] = parts + row // CHUNK % parts
        order = np.argsort(part, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(part[order])) + 1)
        columns = [
            pa.array([int(part[at[0]]) for at in groups], pa.int64()),
            pa.array([row] * len(groups), pa.int64()),
            pa.array([keys[at].tobytes() for at in groups], pa.binary()),
            pa.array([places[at].tobytes() for at in groups], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "row", "keys", "places"])


def _shared(parts: int, hot: Broadcast, pdf: pd.DataFrame) -> pd.DataFrame:
    """row, key, df of the shingles in one part that two rows or more hold; a hot one's df is what its runs told."""
    if len(pdf) and pdf["part"].iloc[0] >= parts:
        out, (common, counts) = [], hot.value
        for row, keys, places in zip(pdf["row"], pdf["keys"], pdf["places"]):
            keys = np.frombuffer(keys, np.int64)
            out.append(pd.DataFrame({"row": row + np.frombuffer(places, "<u2").astype(np.int64), "key": keys, "df": counts[np.searchsorted(common, keys)]}))
        return pd.concat(out)
    keys = np.concatenate([np.frombuffer(b, np.int64) for b in pdf["keys"]])
    rows = np.concatenate([r + np.frombuffer(b, "<u2").astype(np.int64) for r, b in zip(pdf["row"], pdf["places"])])
    order = np.argsort(keys, kind="stable")
    sizes = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(keys[order])) + 1, [len(keys)]]))
    df = np.repeat(sizes, sizes)
    order, df = order[df > 1], df[df > 1]
    return pd.DataFrame({"row": rows[order], "key": keys[order], "df": df.astype(np.int64)})


def _steps(places: np.ndarray) -> bytes:
    """Rising places as their differences, a byte each unless one needs two."""
    steps = np.diff(places.astype(np.int64), prepend=0)
    return steps.astype("u1" if steps.max(initial=0) < 256 else "<u2").tobytes()


def _places(steps: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, "u1" if len(steps) == n else "<u2").astype(np.int64))


def _thin(shingle: int, parts: int, hot: Broadcast, batches: Iterator) -> Iterator:
    """part, row, n, bits, steps: as ``_packed``, with 32 bits of a hash beside its part; hot shingles without bits, as all know that they are shared."""
    import pyarrow as pa

    for batch in _packed(shingle, parts, hot, batches):
        n, bits, steps = [], [], []
        for part, keys, places in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "places"))):
            rest = np.frombuffer(keys, np.uint64) // np.uint64(parts)
            n.append(len(rest))
            bits.append(rest.astype("<u4").tobytes() if part < parts else b"")
            steps.append(_steps(np.frombuffer(places, "<u2")))
        columns = [batch.column("part"), batch.column("row"), pa.array(n, pa.int32()), pa.array(bits, pa.binary()), pa.array(steps, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "row", "n", "bits", "steps"])


def _met(parts: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """row, n, steps: the places of a part's shingles that two rows or more seem to hold."""
    places = [_places(s, n) for s, n in zip(pdf["steps"], pdf["n"])]
    if pdf["part"].iloc[0] < parts:
        bits = np.concatenate([np.frombuffer(b, "<u4") for b in pdf["bits"]])
        order = np.argsort(bits, kind="stable")
        same = bits[order[1:]] == bits[order[:-1]]
        twice = np.zeros(len(bits), bool)
        twice[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        places = [p[t] for p, t in zip(places, np.split(twice, np.cumsum(pdf["n"].to_numpy())[:-1]))]
    out = pd.DataFrame({"row": pdf["row"], "n": [len(p) for p in places], "steps": [_steps(p) for p in places]})
    return out[out["n"] > 0].astype({"n": "int32"})


def _tallied(pdf: pd.DataFrame) -> pd.DataFrame:
    """row, met: how many shingles of each row of a run other rows seem to hold."""
    met = np.zeros(CHUNK, np.int64)
    for steps, n in zip(pdf["steps"], pdf["n"]):
        met += np.bincount(_places(steps, n), minlength=CHUNK)
    at = np.flatnonzero(met)
    return pd.DataFrame({"row": pdf["row"].iloc[0] + at, "met": met[at]})


def _hot(plain: DataFrame, total: int, shingle: int) -> Broadcast:
    """The hot shingles, sorted, and the number of rows that hold each."""
    often = plain.mapInArrow(partial(_repeated, shingle), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = sorted((r.key, r.n) for r in often.where(F.col("n") > max(total / HOT, CHUNK)).collect())  # fewer than HOT
    return plain.sparkSession.sparkContext.broadcast(tuple(np.array([x[i] for x in found], np.int64) for i in (0, 1)))


def _parts(spark, total: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))


def _possible(plain: DataFrame, marked: DataFrame, total: int, hot: Broadcast, shingle: int) -> DataFrame:
    """row, node, n of the nodes, in their smallest rows, that share enough shingles with other rows to have a partner."""
    num, den = SIMILARITY
    parts = _parts(plain.sparkSession, total)
    thin = plain.mapInArrow(partial(_thin, shingle, parts, hot), "part long, row long, n int, bits binary, steps binary")
    met = thin.groupBy("part").applyInPandas(lambda pdf: _met(parts, pdf), "row long, n int, steps binary")
    tallies = met.groupBy("row").applyInPandas(_tallied, "row long, met long")
    one = marked.groupBy("node").agg(F.min(F.struct("row", "n")).alias("x")).select("node", "x.row", "x.n")
    return written(one.join(tallies, "row").where(F.col("met") * den >= F.col("n") * num).select("row", "node", "n"), "possible")


def chosen(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``table`` whose ``row`` is in ``rows``, joined by runs of row numbers: two bytes a row and no text has to move while those are few."""
    run, place = F.shiftright("row", 10), F.col("row").bitwiseAND(F.lit(1023)).cast("short")
    places = written(rows.select(run.alias("run"), place.alias("place")).groupBy("run").agg(F.collect_set("place").alias("places")), "places")
    return table.withColumn("run", run).join(places, "run").where(F.array_contains("places", place)).drop("run", "places")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose sets reach the similarity; shingles of one node alone cannot be in an overlap."""
    num, den = SIMILARITY
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("keys").alias("keys_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("keys").alias("keys_b"))
    both = F.size(F.array_intersect("keys_a", "keys_b"))
    return pairs.join(left, "a").join(right, "b").where(both * (num + den) >= (F.col("n_a") + F.col("n_b")) * num).select("a", "b")


def _find(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest a, b of the verified links within one block of a key, or between its two blocks, that join components."""
    num, den = SIMILARITY
    node, n, of = (pdf[c].to_numpy(np.int64) for c in ("node", "n", "of"))
    row = np.repeat(np.arange(len(pdf)), [len(k) for k in pdf["keys"]])
    _, column = np.unique(np.concatenate([np.asarray(k, np.int64) for k in pdf["keys"]]), return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(pdf), len(pdf)), np.float32)
    for lo in range(0, int(column[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        held = np.zeros((len(pdf), COLUMNS), np.float32)
        held[row[a:b], column[a:b] - lo] = 1
        both += held @ held.T
    ok = np.triu(both.astype(np.int64) * (num + den) >= (n[:, None] + n) * num, 1) & (of[:, None] != of)
    parent, out = {}, []
    for x, y in zip(*np.nonzero(ok)):
        r, s = _find(parent, int(of[x])), _find(parent, int(of[y]))
        if r != s:
            parent[r] = s
            out.append((min(node[x], node[y]), max(node[x], node[y])))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _large(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links a, b within large keys: each pair of blocks of a key is one group."""
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    rows = rows.select("key", "i", "j", "node", "n", "of").join(sets.select("node", "keys"), "node")
    # ``key`` names the group, ``keys`` the set.
    return rows.groupBy("key", "i", "j").applyInPandas(_forest, "a long, b long").distinct()


def near_links(texts: DataFrame, marked: DataFrame, alike: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Pairs a, b of nodes at or over the similarity, enough of them to connect all that such pairs connect.

    ``texts(row, text)``; ``marked(row, node, n)`` with the node and the number of shingles of each row; ``alike(a, b)``: pairs of
    nodes that are likely links, which are verified before all others.
    """
    spark, (num, den) = texts.sparkSession, SIMILARITY
    plain = texts.select("row", "text")
    total = marked.agg(F.sum("n")).first()[0] or 0
    hot = _hot(plain, total, shingle)
    one = _possible(plain, marked, total, hot, shingle)
    parts = _parts(spark, one.agg(F.sum("n")).first()[0] or 0)
    packed = chosen(plain, one).mapInArrow(partial(_packed, shingle, parts, hot), "part long, row long, keys binary, places binary")
    shared = packed.groupBy("part").applyInPandas(lambda pdf: _shared(parts, hot, pdf), "row long, key long, df long")
    # A node's shingles come from one of its rows, and any order of all shingles will do: the one by the number of nodes that hold them.
    rows = shared.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("s"))
    sets = rows.join(one, "row").select("node", "n", "s")
    # The prefix less the shingles that no other row holds, which come first.
    length = F.size("s") - F.expr(f"(n * {num} + {den - 1}) div {den}") + 1
    sets = sets.withColumn("length", length.cast("int")).where("length > 0")
    sets = written(sets.select("node", "n", F.col("s.key").alias("keys"), F.slice("s.key", F.lit(1), F.col("length")).alias("prefix")), "sets")
    linked = written(_verified(alike, sets), "linked")
    roots = components(linked).withColumnRenamed("root", "of")
    held = sets.select("node", "n", F.explode("prefix").alias("key")).join(roots, "node", "left").withColumn("of", F.coalesce("of", "node"))
    end = F.struct("of", "node", "n")
    ends = held.groupBy("key").agg(F.min(end).alias("lo"), F.max(end).alias("hi")).where("lo.of < hi.of")
    held = written(held.join(ends, "key"), "held")
    near = lambda n: (F.col("n") * den >= F.col(n) * num) & (F.col(n) * den >= F.col("n") * num)
    stars = held.select("node", "n", "of", F.explode(F.array("lo", "hi")).alias("x")).where((F.col("x.of") != F.col("of")) & near("x.n"))
    stars = stars.select(F.least("x.node", "node").alias("a"), F.greatest("x.node", "node").alias("b")).distinct()
    first = written(_verified(stars, sets).unionByName(linked), "stars")
    roots = components(first).withColumnRenamed("root", "of")
    open_ = held.select("key", "node", "n").join(roots, "node", "left").withColumn("of", F.coalesce("of", "node"))
    several = open_.groupBy("key").agg(F.min("of").alias("lo"), F.max("of").alias("hi"), F.count("*").alias("held")).where("lo < hi").select("key", "held")
    open_ = written(open_.join(several, "key"), "open")
    few = open_.where(F.col("held") <= LARGE)
    other = few.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("of").alias("of_b"))
    pairs = few.join(other, "key").where((F.col("node") < F.col("b")) & (F.col("of") != F.col("of_b")) & near("n_b"))
    few = _verified(pairs.select(F.col("node").alias("a"), "b").distinct(), sets)
    links = written(first.unionByName(few).unionByName(_large(open_.where(F.col("held") > LARGE), sets)), "links")
    discard(one, alike, linked, sets, held, first, open_)
    return links


def first_rows(rows: DataFrame, marked: DataFrame, alike: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The ``row`` that stays of each group of near copies in rows(row, text): smallest doc_id, nulls last, then smallest row.

    ``marked(row, doc_id, node, n)`` and ``alike(a, b)`` as in ``near_links``.
    """
    links = near_links(rows, marked, alike, shingle)
    roots = components(links)
    discard(links)
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    # Equal rows combine before the shuffle.
    nodes = marked.groupBy("node").agg(F.min(order).alias("best")).join(roots, "node", "left")
    return nodes.groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
