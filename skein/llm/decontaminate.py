"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is cut into k + 1 pieces of nearly equal length: a
passage within k edits of the item holds at least one piece unchanged. An Aho-Corasick automaton over
all pieces finds the exact piece hits in a text; around each hit Myers' bit-parallel algorithm gives
the smallest edit distance between the item and any passage there, and hits beyond k are dropped.

Texts and items are lower-cased, and runs of white space become one blank. The budget is
``error_rate`` of the item's normalised length, rounded down.

The automaton is built from the benchmark table, whose size is checked: about ``batch_items`` items and
``batch_chars`` characters are matched in one pass over the documents, in as many passes as it takes. Each
row takes what it holds from pass to pass, so their number changes no result. After every ``TOGETHER`` passes rows are written: so many
workers, automata and broadcasts live at once, however large the benchmark is.

Cases: null or empty texts and items match nothing; items with equal texts each get their row; equal
item_ids stay apart by text and the smallest distance counts; items without an id match like any other
and share the null id; repeated documents each get theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import discard, id_text, read_table, slices, written

ERROR_RATE = 0.05
BATCH_ITEMS = 20_000
TOGETHER = 4  # passes in one stage
BATCH_CHARS = 1_000_000  # of the items of one pass: its automaton takes about 50 bytes for each


def normal(text: str | None) -> str:
    """Lower case, single blanks."""
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) for budget + 1 pieces whose lengths differ by one at most."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def char_masks(pattern: str) -> dict[str, int]:
    """For each character, the bits of its places in the pattern."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str, most: int) -> int:
    """The smallest edit distance between the pattern and any passage of ``text`` (most + 1 if larger)."""
    if not m:
        return 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    return 0
        ph <<= 1  # no carry at the start: a passage may begin anywhere
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return min(best, most + 1)


class Matcher:
    """The items of one pass: their pieces in an automaton, their masks for verification."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float = ERROR_RATE):
        import ahocorasick

        self.items = []
        where: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            text = normal(raw)
            if not text:
                continue
            budget = int(error_rate * len(text))
            for offset, piece in pieces(text, budget):
                where.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, text, budget, char_masks(text)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def __call__(self, raw: str | None) -> dict[int | None, int]:
        """Smallest distance within its budget for each item found in a whole text."""
        found: dict[int | None, int] = {}
        text = normal(raw)
        if not self.items or not text:
            return found
        begins: dict[int, set[int]] = {}
        for end, (n, places) in self.automaton.iter(text):
            for item, offset in places:
                begins.setdefault(item, set()).add(end + 1 - n - offset)
        for item, starts in begins.items():
            item_id, pattern, budget, masks = self.items[item]
            best, done = budget + 1, -1
            for start in sorted(starts):
                # Any passage within the budget that holds this piece lies between these bounds.
                lo, hi = max(0, start - budget), start + len(pattern) + budget
                if hi <= done:
                    continue
                window = text[lo:hi]
                best = min(best, 0 if pattern in window else myers(masks, len(pattern), window, budget))
                done = hi
                if not best:
                    break
            if best <= budget:
                found[item_id] = min(best, found.get(item_id, best))
        return found


def _passes(benchmark: DataFrame, batch_items: int, batch_chars: int) -> Iterator[list[Broadcast]]:
    """The items in parts of about ``batch_items`` items and ``batch_chars`` characters, each broadcast on its own, TOGETHER at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna(subset=["text"]).distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    n = max(1, -(-size.n // batch_items), -(-size.chars // batch_chars))
    part = lambda i: items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
    for lo in range(0, n, TOGETHER):
        yield [spark.sparkContext.broadcast(sorted(((r.item_id, r.text) for r in part(i)), key=_by_id)) for i in range(lo, min(n, lo + TOGETHER))]


def _passed(rows: DataFrame, groups: Iterator[list[Broadcast]], run) -> DataFrame:
    """``rows`` after every pass: ``run(rows, items)`` adds one to the plan, which ends in a written table after each group but the last."""
    before, done = None, []
    for group in groups:
        if before is not None:
            table = written(rows, "passes")
            discard(*done)
            for items in before:
                items.destroy()
            rows, done = table, [table]
        for items in group:
            rows = run(rows, items)
        before = group
    return rows


def _by_id(row: tuple) -> tuple:
    """Sorting key of rows that begin with an item_id: null ids last."""
    return (row[0] is None, row[0] or 0, *row[1:])


def _pass(items: Broadcast, error_rate: float, batches: Iterator) -> Iterator:
    """Add what one pass finds to each row's list; the smaller distance of an id counts."""
    import pyarrow as pa

    matcher = Matcher(items.value, error_rate)
    for batch in slices(batches):
        ids, distances, ends = [], [], [0]
        for text, before in zip(batch.column("text"), batch.column("found").to_pylist()):
            found = matcher(text.as_py())
            for old in before:
                found[old["item_id"]] = min(old["distance"], found.get(old["item_id"], old["distance"]))
            for item, distance in sorted(found.items(), key=_by_id):
                ids.append(item)
                distances.append(distance)
            ends.append(len(ids))
        matches = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(distances, pa.int32())], names=["item_id", "distance"])
        columns = {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "found": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), matches)}
        yield pa.RecordBatch.from_pydict(columns)


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, batch_items: int = BATCH_ITEMS, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """doc_id, item_id, distance: each benchmark item that a document holds within the item's error budget.

    A row carries what earlier passes found through the later ones, so the number of passes changes no result.
    """
    found = "found array<struct<item_id: long, distance: int>>"
    rows = id_text(docs).withColumn("found", F.expr("cast(array() as array<struct<item_id: long, distance: int>>)"))
    run = lambda df, items: df.mapInArrow(partial(_pass, items, error_rate), f"doc_id long, text string, {found}")
    rows = _passed(rows, _passes(benchmark, batch_items, batch_chars), run)
    return rows.select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.item_id", "m.distance")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every (document, item) pair within the item's error budget."""
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that hold no benchmark item; their columns stay as they are.

    The matcher runs on each row as it passes, so nothing is shuffled and rows with equal or null ids are judged alone.
    """
    import pyarrow as pa

    names = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    plain = docs.toDF(*names)

    def one(df: DataFrame, items: Broadcast) -> DataFrame:
        def run(batches):
            matcher = Matcher(items.value)
            for batch in slices(batches):
                yield batch.filter(pa.array([not matcher(t.as_py()) for t in batch.column("text")], pa.bool_()))

        return df.mapInArrow(run, plain.schema)

    passes = _passes(read_table(spark, sf_dir, "benchmark"), BATCH_ITEMS, BATCH_CHARS)
    return _passed(plain, passes, one).toDF(*docs.columns)
