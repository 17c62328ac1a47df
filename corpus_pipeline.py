"""The corpus pipeline: documents without toxic ones and copies, mixed and packed.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terraspan.llm._spark import as_table, drop_tables
from terraspan.llm.stages import STAGES

#: Learned scores and the knapsack can't be stated in SQL.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; each result is written to the
    shared folder and read back, and removed when the next one is written.

    Null ids and texts, empty and repeated rows and extra columns are treated
    as ``terraspan.llm.stages`` says; an empty table gives no piece.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = as_table(stage(spark, docs, sf_dir), name)
        drop_tables(before)
        before = docs
    return docs
