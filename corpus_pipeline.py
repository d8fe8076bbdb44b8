"""A training-corpus pipeline from the operators of ``skein.llm``: filter, deduplicate, decontaminate, redact, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import read_table, written
from skein.llm.decontaminate import decontamination_stage
from skein.llm.pieces import encoding_stage
from skein.llm.pii import redaction_stage
from skein.llm.quality import quality_stage
from skein.llm.simhash import dedup_stage

#: Rejected documents go; one document of each near-duplicate group stays; documents that hold a benchmark item go;
#: personal data is replaced in the text; what is left is encoded.
STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", redaction_stage),
    ("sentencepiece", encoding_stage),
]

#: A trained classifier and a trained field stand in the way of SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: doc_id, n_tokens, ids, round_trip of every document that is left."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
