"""From raw documents to packed sequences: five stages, each one operator of tarnwick.llm.

Every stage takes what its predecessor kept and returns the columns of documents, the last one
the placed pieces. Between stages the rows are written to the shared scratch folder, so a stage
neither repeats what came before nor depends on the executors that did it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm.common import joined_if_small, stash, table, unused
from tarnwick.llm.decontaminate import decontaminated
from tarnwick.llm.jaccard_join import BROADCAST_ROWS, jaccard_components
from tarnwick.llm.packing import pack
from tarnwick.llm.quality_rules import quality_filter
from tarnwick.llm.queries import tokenizer
from tarnwick.llm.secret_scan import redacted


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or stand far from their language go."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays, of repeated rows with the same id and text one.

    Rows of one doc_id with different texts are documents of their own. Documents without id stay.
    """
    groups = stash(jaccard_components(docs, n=5, percent=80), "pipeline-groups")
    if groups.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        gone = groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id")
        return docs.join(joined_if_small(gone.count(), BROADCAST_ROWS, gone), "doc_id", "left_anti").select(docs.columns)
    # ids that stand on several rows tell no rows apart: the rows get numbers, which a table holds fast
    (number,) = unused(docs.columns, 1)
    rows = stash(docs.withColumn(number, F.monotonically_increasing_id()), "pipeline-rows")
    ids = rows.select(F.col("doc_id").alias("id"), F.col(number).alias("doc_id")).filter("id is not null")
    groups = jaccard_components(rows.filter("doc_id is not null").select(F.col(number).alias("doc_id"), "text"), n=5, percent=80)
    groups = stash(groups.select("doc_id", "component_id").join(ids, "doc_id"), "pipeline-groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct("id", "doc_id"))["doc_id"].alias("first"))
    gone = stash(groups.join(first, "component_id").filter("doc_id != first").select(F.col("doc_id").alias(number)), "pipeline-gone")
    return rows.join(joined_if_small(gone.count(), BROADCAST_ROWS, gone), number, "left_anti").select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are struck out; the documents stay."""
    return redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 1024 tokens."""
    return pack(docs, tokenizer(), capacity=1024, end_id=2, kept_words=100_000)  # workers still hold what earlier stages left


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: No SQL: near duplicates and packing are not expressible. tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
