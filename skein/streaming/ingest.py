"""Streaming ingestion: new document files become embedded chunks, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from skein.functions.embed import embed
from skein.operators.ingest import chunks


def stream_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def stream_chunks(docs: DataFrame, key: str, text: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Chunk and embed a stream of documents into Parquet files under ``out``; the file sink writes each batch exactly once."""
    made = embed(chunks(docs, key, text))
    writer = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
