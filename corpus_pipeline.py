"""Cleaning a corpus: each stage reads what the one before it kept.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame.  Every result is written as Parquet and read again as the
next stage's input.  All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import minhash, packing, positional_index, run_length_index, tables, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("minhash_near_dedup", minhash.stage),
    ("suffix_array_dedup", run_length_index.stage),
    ("benchmark_decontamination", positional_index.stage),
    ("packing", packing.stage),
]

#: No SQL: the first stage is a fitted classifier and the last a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    docs = tables.load(spark, sf_dir, "documents")
    last = len(STAGES) - 1
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == last:
            return out
        docs = tables.keep(out, f"stage-{name}")
    return docs
