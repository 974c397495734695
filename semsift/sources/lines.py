"""Line numbers of text files, and capped reads of files in path order."""
from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Files of the first run of a capped read; each later run has twice as many.
FIRST_FILES = 8


def files_in(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """The files of a folder, or a file itself, by path; hidden ones left out."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(p) if s.isFile()]
    return sorted(full for name, full in found if name.endswith(suffix) and not name.startswith(("_", ".")))


def capped_runs(files: list[str], read: Callable[[list[str]], DataFrame], keep: str | None, cap: int,
                first: int = FIRST_FILES) -> Iterator[DataFrame]:
    """Rows of growing runs of files, up to the cap: those up to the first row from ordinal
    ``cap`` on (1-based, over all files) for which ``keep`` holds. Files behind it are not
    opened. ``read(files)`` gives rows with their ``ordinal`` from 0 in these files."""
    before, lo, size = 0, 0, first
    while lo < len(files):
        rows = read(files[lo:lo + size]).withColumn("ordinal", F.col("ordinal") + before + 1)
        hit = F.col("ordinal") >= cap
        n, bound = rows.agg(F.count(F.lit(1)), F.min(F.when(hit & F.expr(keep) if keep else hit, F.col("ordinal")))).first()
        if bound is not None:
            yield rows.where(F.col("ordinal") <= bound)
            return
        yield rows
        before, lo, size = before + n, lo + size, 2 * size


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``value, ordinal`` (from 0) for text lines read from files: files in path order,
    lines in file order. Ordinals are line positions within each file split plus the
    splits' offsets, one row per split."""
    rows = lines.select("value", F.col("_metadata.file_path").alias("f"),
                        F.col("_metadata.file_block_start").alias("b"),
                        F.monotonically_increasing_id().alias("m"))
    splits = rows.groupBy("f", "b").agg(F.min("m").alias("m0"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("f", "b", "m0", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    return rows.join(F.broadcast(offsets), ["f", "b"]).select("value", (F.col("off") + F.col("m") - F.col("m0")).alias("ordinal"))
