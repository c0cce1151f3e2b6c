"""A training corpus from raw documents: reject toxic texts, drop copies, drop near copies, mix to weights, pack.

Each stage is one operator over all rows that the stage before it kept. All stages but the last return the columns of
`documents`; the last returns the place of every piece of every document. A stage's rows are written as Parquet in the
shared folder and read again, so lost executors cost at most the stage that runs.

Oddities are handled as each operator says: null texts are empty, rows that repeat are one document to the two dedup
stages, an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farescope.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from farescope.llm.common import documents, labels, saved

#: Shares of the tokens by predicted quality. Toxic texts are gone by then, so that domain has no target.
WEIGHTS = {"high": 0.9, "low": 0.1}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, labels(spark, sf_dir), WEIGHTS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Trained models and signatures can't be put in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
