"""Session helpers: builder defaults and the shared scratch/checkpoint folder."""
from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Defaults for settings that neither the platform, spark-submit nor a running session has
# set; a value that is already there is never changed.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # one model/encoder call per this many rows (the ingest batch of the original)
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.driver.memory": "16g",
    # short candidate-id IN lists (an interactive search: k x 1.5 ids) reach Parquet as
    # exact sets; Parquet nests one OR per value, so the bound stays small (longer lists
    # are pushed as a min/max range and filtered exactly by Spark)
    "spark.sql.parquet.pushdown.inFilterThreshold": "256",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "semsift") -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    active = SparkSession.getActiveSession()
    known = active.conf.getAll if active else dict(SparkConf().getAll())
    for k, v in LOCAL_CONF.items():
        if k not in known:
            b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_LOCAL_FALLBACK = "/tmp/semsift-checkpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Read from the session (the cluster's shared location). Only when it is unset
    (local tests) is a folder chosen, through ``SparkContext.setCheckpointDir``
    (``spark.checkpoint.dir`` itself cannot be changed at runtime). With executors on
    other machines a folder of this one would lose rows, so there it must be set.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = sc._conf.get("spark.checkpoint.dir") if hasattr(sc, "_conf") else None
    if not d:
        cur = sc.getCheckpointDir()
        if not cur and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = cur.rsplit("/", 1)[0] if cur else _LOCAL_FALLBACK
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (never machine-local)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/semsift/{name}-{uuid.uuid4().hex[:12]}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing_shuffles(spark: SparkSession):
    """Inside, the shuffle files of a query are deleted when it ends rather than when the
    driver's garbage is collected: for chains of steps whose results are all written."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def materialize(df, name: str):
    """Compute ``df`` once into a Parquet table in the shared checkpoint folder and
    read it back: cuts lineage (survives executor loss) without the second
    computation an unpersisted ``checkpoint()`` costs. Its shuffle files go when it is
    written; ``release`` deletes the table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with passing_shuffles(spark):
        df.write.mode("overwrite").parquet(path)
    table = spark.read.parquet(path)
    table._staged_path = path
    return table


def release(*tables) -> None:
    """Deletes staged tables that nothing is computed from any more."""
    for table in tables:
        path = table.__dict__.pop("_staged_path", None)
        if path:
            jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
