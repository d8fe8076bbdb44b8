"""Connected components by alternating star contractions, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import counted_join, discard, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node it can reach) for every node of ``edges(a, b)``.

    Large-star links every node's larger neighbours to its smallest neighbour, small-star its
    smaller ones; both keep the components and end in stars. Each round is written to the shared
    folder, and only counts reach the driver. Aggregates combine before they shuffle, a node is never gathered
    with all its neighbours, and the links of a hub meet its smallest neighbour where they are (``counted_join``).
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
        total = 2 * now.count()
        large = counted_join(both.where("b > a"), least, ["a"], total=total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large")
        # A node keeps the links to its smaller neighbours only, so no key of this join is a hub's.
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        links = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.withColumnRenamed("m", "b"))
        then = written(links.where("a <> b").distinct(), "small")
        discard(now, least, large)
        # A forest of stars: every node has one parent, and no parent has one.
        if then.count() == then.select("a").distinct().count() and then.join(then.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty():
            return _with_roots(then)
        now = then
    raise RuntimeError(f"no components after {rounds} rounds")


def _with_roots(stars: DataFrame) -> DataFrame:
    """The stars' leaves and their roots themselves."""
    leaves = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
