"""A training corpus from raw documents: five stages, each of which works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlake.llm import toxicity
from burstlake.llm.decontaminate import decontaminate
from burstlake.llm.labels import held_out, one_label
from burstlake.llm.mixing import take
from burstlake.llm.ngram_join import keep_one
from burstlake.llm.shared import cut
from burstlake.llm.sharding import shuffle_into_shards
from burstlake.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.7. It learns from labels of the fold that op5 learns from.

    Null and empty texts are scored like others; rows with one id are judged one by one, null ids as well; columns stay.
    """
    ship_package(spark)
    labels = one_label(spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic")
    net = toxicity.learn(docs.where(~held_out("doc_id", 3, 1)), labels)
    return toxicity.score(docs, net, out="toxicity").where(F.col("toxicity") < 0.7).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words with a Jaccard similarity of 0.8 or more.

    The one with the smallest id stays. Documents without words link with nothing and stay; of rows that share an id one
    stays; rows with a null id stay; columns stay.
    """
    ship_package(spark)
    return keep_one(docs, width=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover less than half of every benchmark item.

    Null and empty texts cover nothing and stay; rows with one id are judged one by one; columns stay.
    """
    ship_package(spark)
    judged = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.where(~F.col("leaked")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight; a document stands in it as often as it is taken, twice at most.

    Null sources are one source, the last; documents without words are never taken; repeated rows are taken one by one; columns stay.
    """
    ship_package(spark)
    return take(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in random order over 24 shards, with the columns of documents, shard and slot.

    Null ids and texts are rows like others; rows that are equal in all columns are interchangeable, all others get one place in every run.
    """
    ship_package(spark)
    return shuffle_into_shards(docs, shards=24)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: Learnt scores, tiling, and random rounding and order have no twin in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
