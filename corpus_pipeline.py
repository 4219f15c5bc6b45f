"""A training corpus from raw documents, in five stages of the llm operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, jaccard_join, mixing, pieces, toxicity
from plumbline.session import drop_folder, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network does not reject; it learns from this stage's input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    return exact_dedup.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every group linked by five-word shingles, 0.8 or more.

    Texts without words are linked with nothing and stay, as do null ids and
    rows that share an id that stays.  The columns travel as one value.
    """
    found, _ = jaccard_join.join(docs, size=5, percent=80)
    stay = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("stay_id")).distinct()
    rows = docs.select(F.struct("*").alias("whole"), F.col("doc_id").alias("id"))
    return rows.join(stay, F.col("id").eqNullSafe(F.col("stay_id")), "left_semi").select("whole.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights, in blocks of about 1,024 words."""
    return mixing.apply_mix(docs, block=1024)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every mixed text, and whether they decode to it."""
    return pieces.encode(docs, pieces.vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: SQL cannot state the trained network or the seeded draw; tests compare by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet for the next.

    A stage's table goes once the next is written; the last one stays, since
    the result reads it.
    """
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for place, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{place}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if read is not None:
            drop_folder(spark, read)
        docs, read = spark.read.parquet(path), path
    return docs
