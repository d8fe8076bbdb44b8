"""Reading tables, and tables written on the way so that plans end there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is missing on one machine (master ``local``, as in tests) a temporary folder stands in.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="skein-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def settled(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder, and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/skein-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, columns: str | list[str], tag: str, buckets: int | None = None, name: str | None = None) -> DataFrame:
    """``df`` laid out by ``columns`` in buckets: an equi-join on them deals only the other side.

    With a ``name`` the table stays in the catalogue, and rows inserted into it keep the layout; without one only its files stay.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = name or f"skein_{tag}_{uuid.uuid4().hex}"
    keys = [columns] if isinstance(columns, str) else columns
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys)
    (writer.mode("overwrite") if name else writer.option("path", f"{shared_folder(spark)}/{made}")).saveAsTable(made)
    table = spark.table(made)
    table.schema  # resolved: files and buckets are known from here on
    if not name:
        spark.sql(f"DROP TABLE {made}")
    return table


def numbered(df: DataFrame, order: list[str], out: str = "n") -> DataFrame:
    """``df`` with its place (from 0) in the given order, without sorting in one task.

    Ranges of the order are sorted on their own and written; a count for each range gives the offsets.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    low = (1 << 33) - 1
    placed = settled(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit(low)))
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row a range
    total, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, total))
        total += counts[part]
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_part long, _offset long")
    return placed.join(F.broadcast(table), "_part").withColumn(out, F.col("_at") + F.col("_offset")).drop("_id", "_part", "_at", "_offset")
