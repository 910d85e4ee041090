"""Corpus pipeline: documents through five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet to the shared folder and rereads it as the next stage's input.  All stages but the
last return the columns of documents.  Null texts, null ids, repeated rows, empty tables
and extra columns are handled as each operator's docstring states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelab.llm.decontaminate import drop_contaminated
from featurelab.llm.mixture import mix_documents
from featurelab.llm.near_dedup import drop_near_duplicates
from featurelab.llm.queries import TRAINED
from featurelab.llm.reshard import reshard
from featurelab.llm.stage import written
from featurelab.llm.toxicity import drop_toxic
from featurelab.sources.tables import read_table

OLD_SHARDS, NEW_SHARDS = 6, 8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels", ["doc_id", "toxic"]), use=F.expr(TRAINED))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, 0.8 or more)."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: 150 % of all words, none more than twice."""
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """From six shards (dealt by text hash) to eight of near equal bytes, written as files."""
    return reshard(docs, F.pmod(F.xxhash64("text"), F.lit(OLD_SHARDS)), NEW_SHARDS)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("source_mixture", source_mixture), ("sharding", sharding)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
