"""Inserts as a stream with state: for each key the latest row, however the rows are split into batches.

State is the greatest (order, values) of a key, so late and repeated rows change nothing and the result is that of
``upsert_latest`` over all rows. Keys whose latest row changes are written, batch by batch; a batch that runs again after a failure
replaces its own files. State and sources go on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import DataType, FractionalType, IntegralType, StringType, StructField, StructType

from skein.operators.knn import upsert_latest

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _read(kind: DataType):
    """How a value that travels as text is compared."""
    return int if isinstance(kind, IntegralType) else float if isinstance(kind, FractionalType) else str


class _Latest(StatefulProcessor):
    """Values travel and are kept as text, as pandas would turn whole numbers beside nulls into fractions."""

    def __init__(self, kept: StructType):
        self.columns, self.read = kept.names, [_read(f.dataType) for f in kept]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("latest", StructType([StructField(c, StringType()) for c in self.columns]))

    def _rank(self, row: tuple) -> tuple:
        """A row in Spark's order: null first."""
        return tuple((False,) if x is None else (True, read(x)) for x, read in zip(row, self.read))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.held.get()) if self.held.exists() else None
        best = before
        for pdf in rows:
            for row in pdf[self.columns].itertuples(index=False, name=None):
                row = tuple(None if pd.isna(x) else x for x in row)
                if best is None or self._rank(row) > self._rank(best):
                    best = row
        if best != before:
            self.held.update(best)
            yield pd.DataFrame([(*key, *best)], columns=["_key", *self.columns], dtype=object)

    def close(self) -> None:
        pass


def stream_upserts(rows: DataFrame, key: str, order: str, *values: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write each key's new latest row of a stream of rows(key, order, values) under ``out``, one folder a batch.

    Keys, orders and values are numbers or texts; a null key is a key. The session's state store has to be PROVIDER.
    """
    columns = [order, *values]
    kept = StructType([rows.schema[c] for c in columns])
    made = StructType([StructField(c, StringType()) for c in ("_key", *columns)])
    texts = rows.select(*(F.col(c).cast("string").alias(c) for c in (key, *columns)))
    latest = texts.groupBy(key).transformWithStateInPandas(_Latest(kept), made, "Update", "None")

    def write(batch: DataFrame, number: int) -> None:
        typed = batch.select(F.col("_key").cast(rows.schema[key].dataType).alias(key), *(F.col(c).cast(rows.schema[c].dataType).alias(c) for c in columns))
        typed.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = latest.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, out: str, key: str, order: str, *values: str) -> DataFrame:
    """The latest row of each key that the stream has written."""
    return upsert_latest(spark.read.parquet(out), key, order, *values)
