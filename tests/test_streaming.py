import random

from skein.operators.knn import upsert_latest
from skein.streaming.ingest import stream_chunks, stream_documents
from skein.streaming.upserts import current, stream_upserts


def test_new_files_become_chunks(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "One two. Three four.")], schema).write.parquet(folder)
    for k in range(2):
        stream_chunks(stream_documents(spark, folder, schema), "doc_id", "text", out, str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(out).count() == k + 1
        spark.createDataFrame([(2, "Five.")], schema).write.mode("append").parquet(folder)
    assert {r.chunk_id for r in spark.read.parquet(out).collect()} == {"1-chunk-0", "2-chunk-0"}


def test_upserts_in_any_batches_equal_the_batch_upsert(spark, tmp_path):
    """Repeated and late rows, nulls, several splits into batches; each batch is a restart from the checkpoint."""
    rng = random.Random(8)
    schema = "id string, seq long, text string, n int"
    rows = [(rng.choice(["a", "b", "c", "d", None]), rng.choice([None, 9, 10, 2**60, 2**60 + 1]), rng.choice([None, "x", "y", ""]), rng.choice([None, 5])) for _ in range(60)]
    want = sorted(map(str, upsert_latest(spark.createDataFrame(rows, schema), "id", "seq", "text", "n").collect()))
    for split in (1, 3):
        rng.shuffle(rows)
        folder, out, check = (str(tmp_path / f"{name}{split}") for name in ("in", "out", "check"))
        for k in range(split):
            spark.createDataFrame(rows[k::split] + rows[:3], schema).coalesce(1).write.mode("append").parquet(folder)
            stream_upserts(stream_documents(spark, folder, schema), "id", "seq", "text", "n", out=out, checkpoint=check).awaitTermination()
        assert sorted(map(str, current(spark, out, "id", "seq", "text", "n").collect())) == want
        # Rows seen before change nothing: nothing is written for them.
        before = spark.read.parquet(out).count()
        spark.createDataFrame(rows[:20], schema).write.mode("append").parquet(folder)
        stream_upserts(stream_documents(spark, folder, schema), "id", "seq", "text", "n", out=out, checkpoint=check).awaitTermination()
        assert spark.read.parquet(out).count() == before
