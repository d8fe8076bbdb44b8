"""Small awkward document tables shared by the tests of this subpackage."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("start", T.StringType()),
        T.StructField("rank", T.StringType()),
    ]
)


def docs(spark, texts, ids=None):
    """Documents with two extra columns whose names clash with the operators' own."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", "y") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS)


def table(spark, tmp_path, name, df):
    """Write ``df`` as one of the tables of a scale-factor folder."""
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
