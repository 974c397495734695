"""Small shared helpers of the training-data operators."""
from __future__ import annotations

import ctypes
import gc
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semsift.session import passing_shuffles, release, scratch_path  # noqa: F401  (re-exported)

#: Java regex for a run of word separators; a word is a run of anything else.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_COLLECTORS: list[list[DataFrame]] = []


@contextmanager
def collected(into: list[DataFrame]):
    """Tables staged inside are listed in ``into``, for a caller that knows when what was
    made of them has been written and ``release`` may delete them."""
    _COLLECTORS.append(into)
    try:
        yield
    finally:
        _COLLECTORS.remove(into)


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the cluster's shared folder and read it back with its own
    schema: cuts lineage, fixes generated row ids, and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_path = path
    for into in _COLLECTORS:
        into.append(table)
    return table


def give_back(collect: bool = True) -> None:
    """Returns a task's freed memory to the system (call it when the task's rows are out):
    a worker process lives on, and what it holds on to counts against later tasks. Where
    nothing is held in cycles, ``collect=False`` saves the search for them."""
    import pyarrow as pa
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns under private names, so that extra input columns cannot clash."""
    return df.select(*[F.col(f"`{src}`").alias(new) for new, src in cols.items()])


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(col: str | Column) -> Column:
    """Words of a text as an array (empty for a null, empty or blank text)."""
    parts = F.split(text_or_empty(col), SPACES)
    return F.filter(parts, lambda w: w != "")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
