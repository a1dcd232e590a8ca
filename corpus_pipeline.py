"""A corpus pipeline: documents in, a mixed training corpus out.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and is written as Parquet and read again before the next one. Stages see
only the columns of ``documents``; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontam, mixing, neardup, pii, site_quality
from tidewatch.llm.store import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = COLUMNS[1:]


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality posterior is at least one half. Rows are judged each for itself, with null or repeated ids too; a null or empty
    text has the evidence of zero statistics, a null source or language is a site of its own."""
    return site_quality.site_quality(docs, table(spark, sf_dir, "labels"), keep=REST).filter("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. Rows equal in id and text count once."""
    row = F.concat_ws(":", F.col("doc_id"), F.col("text_key")).alias("row")
    kept = neardup.near_duplicates(docs, shingle=5).filter("kept").select(row)
    keyed = docs.withColumn("text_key", F.xxhash64("text")).select(*COLUMNS, row)
    return keyed.join(kept, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text. Rows are judged on their own text; null and empty texts are clean."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=REST).filter("not contaminated").select(*COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the name of the kind in place of each span of personal data, and n_chars of the new text. Null and empty texts, and
    texts without a span, stay as they are, with their n_chars."""
    found, _ = pii.find_personal_data(docs, keep=REST)
    hidden = found.withColumn("text", pii.redact(F.col("text"), F.col("spans")))
    return hidden.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times. A null source is a source; a text without words has size 0 and is taken at
    its source's rate."""
    return mixing.emit_copies(mixing.systematic_copies(docs, keep=REST)).select(*COLUMNS)


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", hide_personal_data),
    ("mixing", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
