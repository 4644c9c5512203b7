"""Documents to training batches, stage by stage.

Each stage takes what the one before kept and returns the columns of ``documents``; the last returns
the places of the documents in batches.

Defined cases: a null text has no words, so the quality rules reject it; a stage that gets one keeps it as
it is; line dedup drops it, as it drops what is left without a word. Documents are told apart by doc_id and text: rows that share only the doc_id are documents of their
own, of rows that share both the join keeps one. Null doc_ids come first. Further columns, of any name and
type, are carried along. An empty table gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import credentials, lines, packing, quality, setjoin
from tidewell.llm.workspace import Workspace, documents, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list accept."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that another has in the same or a similar form first; those left without a word go."""
    return _counted(lines.dedup(docs).drop("n_removed_lines")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def jaccard_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links join: the one of least doc_id, null first."""
    ws = Workspace(spark, "groups")
    row = next(c for c in (f"row{n}" for n in range(len(docs.columns) + 1)) if c not in docs.columns)
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text", F.col("doc_id").isNull()))
    groups = setjoin.join(keyed.select(row, "text"), row).select(row, "component_id").distinct()
    named = groups.join(keyed.select(row, "doc_id").distinct(), row)
    first = ws.put(named.groupBy("component_id").agg(F.min(F.struct("doc_id", row)).alias("first")).select(f"first.{row}"), "first")
    return keyed.join(first, row, "left_semi").dropDuplicates([row]).select(*[f"`{c}`" for c in docs.columns])


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the spans of secrets masked."""
    return _counted(credentials.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_dedup),
    ("secret scans", secret_scan),
    ("packing", pack),
]

#: The learned list and the signatures of lines are not for SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = ws.put(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
