"""A training corpus from raw documents: one stage after the other, each written and read again.

Rows that share an id are taken for repeats of one document: of near duplicates the document with the
smallest id stays, once. Rows with a null id stay. The mix may hold a document several times, and its last copy cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill.llm import decontamination, jaccard_join, language_id, mixing, sharding
from proofmill.llm.common import id_filter, table, word_count
from proofmill.session import written_once


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without a letter go."""
    profiles = language_id.fit_profiles(docs)
    found = docs.withColumn("_found", language_id.identify(F.col("text"), profiles))
    return found.filter(F.col("_found.lang") != language_id.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    groups = jaccard_join.near_duplicates(docs).filter("doc_id IS NOT NULL")
    ids = groups.groupBy("doc_id").agg(F.count("*").alias("_rows"), F.min("component_id").alias("_first"))
    # only documents that may have to go are shuffled
    doubtful = written_once(ids.filter("_rows > 1 OR _first <> doc_id"), "doubtful")
    maybe = id_filter(doubtful.select("doc_id"))
    once = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    looked_at = docs.filter(maybe(F.col("doc_id"))).join(doubtful, "doc_id", "left").withColumn("_n", F.row_number().over(once))
    stay = looked_at.filter("_rows IS NULL OR (_first = doc_id AND _n = 1)")
    return docs.filter(~maybe(F.col("doc_id"))).unionByName(stay.select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and the last of a source's budget as far, as the mix takes them."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    mixed = mixing.take(docs, mixing.mix(rows))
    return mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else mixed


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place in it of every copy."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    return sharding.interleave(rows, "source", "doc_id", ("size", "text_crc32"))


STAGES = [
    ("language id", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("sharding", shard),
]

#: Language identification is no SQL; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written_once(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
