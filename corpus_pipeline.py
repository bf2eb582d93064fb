"""From documents to token ids: quality, line dedup, near-dedup, mix, encoding.

Each stage takes (spark, docs, sf_dir) and gives a table that the next one reads. All but the
last keep the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regdata.llm import bpe, lines, mixing, near, quality
from regdata.llm.arrow import parcel
from regdata.llm.queries import VOCABULARY, table
from regdata.session import shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from those of them that are labelled."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that earlier ones hold; those of which nothing is left go."""
    rows, columns = parcel(docs, doc_id="doc_id", text="text", n_chars="n_chars")
    done = lines.line_dedup(rows).where("n_removed < n_lines or n_lines = 0")
    changed = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(*columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    rows, columns = parcel(docs, doc_id="doc_id", text="text")
    return near.near_duplicates(rows).where("kept").select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number and digest, after the way back was checked."""
    codec = bpe.load_codec(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    coded = bpe.encode_and_back(docs.select("doc_id", "lang", "source", "text"), codec)
    same = F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")) == F.col("decoded")
    return coded.select(
        "doc_id", "lang", "source", F.when(same, F.col("ids")).otherwise(F.raise_error(F.lit("ids do not decode to the text"))).alias("ids"),
        F.size("ids").cast("long").alias("n_tokens"), "ids_sha256",
    )


STAGES = [
    ("quality", keep_quality),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("mix", mix_sources),
    ("encode", encode_texts),
]
# classifier, alignment and vocabulary are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name.replace(' ', '_')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
