"""The corpus pipeline: quality rules, line de-duplication, near-duplicate removal,
mixing to target weights, and packing, each stage on what the one before it kept.

A stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of
``docs``. ``run`` writes every stage's result as Parquet in the cluster's shared folder
and reads it again for the next.
"""
from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semsift.llm.common import collected, read_table, release
from semsift.llm.jaccard_join import keep_one_per_component
from semsift.llm.line_dedup import line_dedup
from semsift.llm.mixing import label_domains, mix
from semsift.llm.packing import pack
from semsift.llm.quality_rules import quality_filter
from semsift.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"
#: Token shares to mix to. Rates stop at 1 (no document is repeated); a lower rate is the
#: probability, fixed by the id's hash, that a document stays.
WEIGHTS = {"clean": 0.85, "poor": 0.15, "toxic": 0.0}


_LEFT: list[DataFrame] = []


def step(function):
    """A stage whose working tables are deleted when the next stage begins: by then its
    result has been written."""
    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(*_LEFT)
        _LEFT.clear()
        with collected(_LEFT):
            return function(spark, docs, sf_dir)
    return run


@step
def drop_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules, or their host's verdict, reject go."""
    return quality_filter(docs)


@step
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted; a document left without a word goes."""
    return line_dedup(docs).where(~F.col("_l_emptied")).select(*[F.col(f"`{c}`") for c in docs.columns])


@step
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return keep_one_per_component(docs)


@step
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay with the rate that mixing gives them, as their hashed copies say."""
    mixed = mix(docs, label_domains(read_table(spark, sf_dir, "labels")), WEIGHTS, budget="clean", max_rate=1.0)
    return mixed.where(F.col("_m_copies") >= 1).select(*[F.col(f"`{c}`") for c in docs.columns])


@step
def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token streams in sequences of 1024."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", drop_rejected),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Line runs, similarity components, the fitted rates and token ids are beyond SQL; the
#: stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
