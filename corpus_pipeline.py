"""A training-data pipeline over ``documents``: five operators, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Between stages the rows are written to the shared folder and read
again, so no stage runs twice. All stages but the last return the columns of their input; the last returns
packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import op01_minhash_forest, op02_quality_rules, op05_decontamination, op06_packing, op09_language_id
from parlance.llm.common import load, written

STAGES = [
    ("quality rules", op02_quality_rules.stage),
    ("language ID", op09_language_id.stage),
    ("MinHash near-dedup", op01_minhash_forest.stage),
    ("benchmark decontamination", op05_decontamination.stage),
    ("packing", op06_packing.stage),
]

#: SQL can't express the MinHash forest, the profiles or the tokenizer; tests/llm holds the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the whole table ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
