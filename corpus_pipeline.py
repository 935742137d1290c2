"""Documents to packed training sequences, in five stages.

Each stage is one operator of `deltascope.llm` applied to all that its predecessor kept, and
hands on the columns of documents; the last returns where every piece was packed. A stage's
result is written to the shared folder and read again, so lost executors cost no more than
the stage they were busy with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deltascope.llm.common import ship_package
from deltascope.llm.jaccard import drop_near_duplicates
from deltascope.llm.line_dedup import without_repeats
from deltascope.llm.packing import pack
from deltascope.llm.quality import keep_good
from deltascope.llm.queries import tokenizer_path
from deltascope.llm.secrets import redact_secrets
from deltascope.sources.materialize import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rules reject go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated chunks go; exact copies, and documents that lose their last word by it, go whole."""
    return without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 of their five-word shingles, the smallest id stays."""
    ship_package(spark)
    return drop_near_duplicates(docs, words=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece lies in the sequences of 2048 tokens."""
    ship_package(spark)
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

# a byte-level tokenizer can't be written in SQL: the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
