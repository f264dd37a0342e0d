"""A training corpus from raw documents, in five stages, each one operator of plumbline.llm.

quality rules -> one document of each near-duplicate group -> no benchmark passages ->
personal data masked -> the mix of the sources. Every stage but the last returns the columns of `documents`; each stage's result is
written as Parquet and read again, so a stage starts from files that all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import minhash, simhash
from plumbline.llm.common import written
from plumbline.llm.decontaminate import RESULTS, mark
from plumbline.llm.mixing import mix
from plumbline.llm.pii import mask
from plumbline.llm.quality import judge
from plumbline.llm.simhash import numbered

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BROADCAST_ROWS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return judge(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the least doc_id (rows without one last), of repeated rows the first.

    Groups are SimHash's (three-word shingles, two bits) and then, of the rows that stay, those linked by a verified
    five-word Jaccard similarity of 0.8 or more, which two bits mostly miss. The others' row numbers are
    joined out: broadcast up to BROADCAST_ROWS, by a shuffle beyond.
    """
    rows = numbered(docs.select(*COLUMNS))
    for find in (simhash.others, minhash.others):
        gone = written(find(rows), "others")
        rows = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "row__", "left_anti")
    return rows.select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    found = mark(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(F.size("hits") == 0).drop(*RESULTS).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each span of personal data replaced by its kind; n_chars is the new length."""
    masked = mask(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix(docs, keep=[]).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("personal_data", personal_data), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs


#: The fingerprints need XXH64, which SQL lacks; the pipeline is tested against plain Python instead.
ORACLE_SQL = None
