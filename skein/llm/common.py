"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is missing on one machine (master ``local``, as in tests) a temporary folder stands in.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="skein-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


HOT = 20_000  # a key is hot if it has over one in HOT of all rows, so there are fewer than HOT hot keys


def counted_join(rows: DataFrame, counts: DataFrame, keys: list[str], how: str = "inner", total: int | None = None, hint: str | None = None) -> DataFrame:
    """``rows`` joined ("left", "inner" or "left_semi") with ``counts``, a written table of keys that occur ``n`` times in them.

    Rows of hot keys meet a broadcast of fewer than HOT keys where they are; only the others are dealt by their key, with a join ``hint`` if given.
    """
    total = rows.count() if total is None else total
    hot = F.broadcast(counts.where(F.col("n") > total / HOT))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(counts.hint(hint) if hint else counts, keys, how)
    return cold.unionByName(rows.join(hot, keys, "left_semi" if how == "left_semi" else "inner"))


def tidy() -> None:
    """Give memory that is free back to the system: Python workers live on from task to task and would hold on to it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches cut into slices of a few rows, so that a task holds the Python objects of one slice only."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
        del batch
        tidy()


@contextmanager
def _cleaned_shuffles(spark: SparkSession):
    """Let Spark delete a query's shuffle files when the query ends (a session setting of Spark 4.1, put back after)."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{tag}-{uuid.uuid4().hex}"
    with _cleaned_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing will read again: what was made from them stands in tables of its own."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if path.getName().startswith("skein-"):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, column: str, tag: str) -> DataFrame:
    """Write ``df`` dealt by ``column`` as a bucketed table in the shared folder: joins on it shuffle only their other side."""
    spark = df.sparkSession
    name = f"skein_{tag}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _cleaned_shuffles(spark):
        df.repartition(n, column).write.bucketBy(n, column).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved: files and buckets are known from here on
    spark.sql(f"DROP TABLE {name}")  # the entry in the catalogue only, the files stay
    return table


def id_text(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads; extra columns cannot clash with its own names."""
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
