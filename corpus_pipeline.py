"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import common, line_dedup, mixing, ngram_join, packing, quality

#: (name, function of (spark, docs, sf_dir)); each stage's result is written and read again as the next one's docs.
STAGES = [
    ("quality_classifier", quality.stage),
    ("line_dedup", line_dedup.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("mixing", mixing.stage),
    ("best_fit_packing", packing.stage),
]

#: The trained model, the tokenizer and the packing have no twin in SQL. tests/llm/test_stages.py holds run() against plain Python
#: from the documents that the classifier keeps on, and the stages on edge cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = common.shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
