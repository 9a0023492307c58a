"""The training-data pipeline: five stages over the documents table, each written as Parquet and read again.

Each stage works on all rows of the one before and returns the columns of documents; the last returns the packed
pieces. Null texts pass the filters that do not judge them and are packed as a single end token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataframe.llm.common import shared_dir
from strataframe.llm.minhash import one_of_each
from strataframe.llm.mixing import mix
from strataframe.llm.packing import pack_documents
from strataframe.llm.quality import fit_quality, score_quality
from strataframe.llm.queries import vocabulary
from strataframe.llm.suffix_dedup import without_repeats

MIX_TEMPER = {"source": 0.9, "lang": 0.9, "topic": 0.95}  # gentle: most documents stay


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network accepts."""
    net = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, net).where("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs).select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every 200-byte string that occurs more than once is cut out of the texts."""
    return without_repeats(docs).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics follow their tempered shares."""
    return mix(docs, MIX_TEMPER).where("mix_kept").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of at most 2048 tokens."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None  # a trained network's decisions are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
