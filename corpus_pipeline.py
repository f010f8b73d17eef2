"""The corpus pipeline: toxicity, exact dedup, near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read
again as the next stage's docs. All stages but the last give the columns of documents.

The dedup stages number the rows of their input in a table of their own, so that rows which share a
doc_id, or have none, are told apart: of each group exactly one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelon.llm import exact_dedup, near_dedup, packing, secrets, toxicity
from parcelon.llm.common import numbered, shared_dir, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model, "score").where("score < 0.5").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, one with the largest doc_id."""
    folder = shared_dir(spark)
    rows = numbered(docs.select(*COLUMNS), folder)
    return only(rows, exact_dedup.exact_dedup(rows, folder, row="row"), folder)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays, one with the smallest doc_id."""
    folder = shared_dir(spark)
    rows = numbered(docs.select(*COLUMNS), folder)
    return only(rows, near_dedup.near_dedup(rows, folder, row="row"), folder)


def only(rows: DataFrame, found: DataFrame, folder: str) -> DataFrame:
    # The list of rows grows with the input: a merge join at every size, never a broadcast.
    kept = written(found.where("kept").select("row"), folder, "kept")
    return rows.join(kept.hint("merge"), "row", "left_semi").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No document goes; secrets are replaced in the text, where they stand."""
    return secrets.redact(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_rows(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: Tokenizers and trained models have no SQL; tests/llm/test_pipeline.py holds run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return docs
