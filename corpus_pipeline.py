"""From raw documents to packed windows: quality, rules, repeated lines, near copies, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as
Parquet and read again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import line_dedup, ngram_join, packing, quality_classifier, quality_rules
from tessella.llm.common import materialize
from tessella.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the importance-resampling classifier rejects."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a quality rule rejects."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that nearly repeat an earlier one; all documents stay, n_chars is that of the new text."""
    out = line_dedup.without_lines(docs, line_dedup.removed_lines(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return ngram_join.keep_one_per_class(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("quality rules", rules), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("packing", pack)]

#: No SQL: the classifier, the joins and the tokenizer are beyond it; see tests/llm for brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
