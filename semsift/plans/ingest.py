"""Index build and load (P5-P7, S11-S13, A1-A3 at ingest).

``build_index`` turns article rows ``(title, text[, link][, id])`` into the
stored index schema in one narrow projection (no shuffle): title cleaned,
text kept as the description, link derived, embedding from the encoder
(quantised), token statistics per row.

Batch and stream loads share one table layout, ``load_id=.../epoch=N/``. A load id
belongs to one batch append or one stream checkpoint and is never used again, so a
load only adds its own partitions, and writing a micro-batch again replaces exactly
its own. Loads become visible by commit records and get dense row keys
(``semsift.plans.commits``).
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semsift import constants as C
from semsift.functions.text import clean_string, token_stats
from semsift.functions.vectors import quantize
from semsift.operators.ann import append_ivf
from semsift.operators.embed import HashingEncoder
from semsift.operators.keyword import append_postings
from semsift.plans import commits
from semsift.schemas import INDEX_SCHEMA
from semsift.session import materialize

INDEX_COLUMNS = [f.name for f in INDEX_SCHEMA.fields]
PARTITIONS = ["load_id", "epoch"]
#: Column of the dense keys that rows without an id get.
KEY = "_key"


def article_link(title_col) -> F.Column:
    """Link = fixed prefix + raw title (no URL encoding)."""
    return F.concat(F.lit(C.LINK_PREFIX), F.coalesce(title_col, F.lit("")))


def load_id_of(spark: SparkSession, checkpoint: str) -> str:
    """The load id kept in a stream's checkpoint folder, made on first use."""
    path = f"{checkpoint.rstrip('/')}/semsift_load_id"
    commits.create_once(spark, path, uuid.uuid4().hex)
    return commits.read_small(spark, path)


def index_columns(*, encoder=None, id_col: str | None = None, title_col: str = "title", text_col: str = "text",
                  link_col: str | None = None, embedding_col: str | None = None, keep_rejected: bool = False) -> tuple[list[F.Column], bool]:
    """The columns of ``build_index``, and whether rows may be without a vector. A stream makes
    them once for all its micro-batches."""
    if not id_col:
        raise ValueError("rows without an id need one of with_dense_keys()")
    title = F.coalesce(F.col(title_col), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    link = F.col(link_col) if link_col else article_link(title)
    enc = None
    if embedding_col:
        emb = F.col(embedding_col)
    else:
        enc = encoder or HashingEncoder()
        emb = enc.embed(text)
    out = [
        F.col(id_col).cast("long").alias("id"),
        clean_string(title).alias("title"),
        text.alias("description"),
        link.alias("link"),
        quantize(emb).alias("embedding"),
        token_stats(text).alias("token_stats"),
    ]
    # The built-in encoders always return a dim-length vector, so P6 cannot fire;
    # leaving the filter out also keeps the encoder out of every other read of the
    # index (a pushed-down filter would evaluate the model once more per row).
    return out, not (keep_rejected or (enc is not None and getattr(enc, "never_empty", False)))


def build_index(articles: DataFrame, *, encoder=None, id_col: str | None = None,
                title_col: str = "title", text_col: str = "text", link_col: str | None = None,
                embedding_col: str | None = None, keep_rejected: bool = False) -> DataFrame:
    """Index rows ``(id, title, description, link, embedding, token_stats)``.

    ``embedding_col`` uses precomputed vectors instead of the encoder. Rows whose
    embedding is empty are dropped (P6) unless ``keep_rejected``. Sources without an id
    get one of ``commits.with_dense_keys`` first, like a serial column: exact duplicates
    stay separate rows with separate ids.
    """
    columns, may_lack = index_columns(encoder=encoder, id_col=id_col, title_col=title_col, text_col=text_col, link_col=link_col,
                                      embedding_col=embedding_col, keep_rejected=keep_rejected)
    out = articles.select(*columns)
    return out.filter(~_no_vector()) if may_lack else out


def _no_vector():
    return F.col("embedding").isNull() | (F.size("embedding") == 0)


def rejected_rows(index_candidates: DataFrame) -> DataFrame:
    """Rows P6 drops (empty embedding)."""
    return index_candidates.filter(_no_vector())


def create_index_table(spark: SparkSession, name: str, location: str) -> None:
    """``CREATE TABLE IF NOT EXISTS`` over the index folder (S11); call ``refresh_index_table``
    to see loads that came after."""
    fs, Path, _ = commits.file_system(spark, location)
    fs.mkdirs(Path(location))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in INDEX_SCHEMA.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}, load_id string, epoch int) USING parquet "
              f"PARTITIONED BY (load_id, epoch) LOCATION '{location}'")
    refresh_index_table(spark, name)


def refresh_index_table(spark: SparkSession, name: str) -> None:
    """Lists the committed loads as the table's partitions (all, if it keeps no records)."""
    location = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]
    seen = commits.visible(spark, location)
    if seen is None:
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        return
    part = lambda load, epoch: f"PARTITION (load_id = '{load}', epoch = {epoch})"
    listed = {tuple(x.split("=", 1)[1] for x in r["partition"].split("/")) for r in spark.sql(f"SHOW PARTITIONS {name}").collect()}
    for load, epoch in sorted({(load, int(epoch)) for load, epoch in listed} - seen):
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {part(load, epoch)}")
    if seen:
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS " + " ".join(part(*s) for s in sorted(seen)))


def write_load(index_rows: DataFrame, path: str, load_id: str, epoch: int = 0, *, sort_by_id: bool = True,
               cluster_files: int | None = None) -> None:
    """Writes index rows as the partition of this load and epoch, replacing only that one."""
    out = index_rows.select(*INDEX_COLUMNS)
    if cluster_files:
        out = out.repartitionByRange(int(cluster_files), "id")
    if sort_by_id:
        out = out.sortWithinPartitions("id")
    (out.withColumn("load_id", F.lit(load_id)).withColumn("epoch", F.lit(int(epoch)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*PARTITIONS).parquet(path))


def append_index(index_rows: DataFrame, path: str, *, load_id: str | None = None, sort_by_id: bool = True,
                 cluster_files: int | None = None) -> str:
    """Append index rows that have ids as one new load (S12); returns its load id.

    Sorting within files by id keeps row-group min/max statistics tight, so id
    IN-list lookups (the detail fetch of a search) skip most row groups.
    ``cluster_files`` additionally range-partitions by id into that many files (one
    shuffle at build time) so a lookup touches only the files covering its ids.
    """
    load_id = load_id or uuid.uuid4().hex
    commits.check_load_id(load_id)
    commits.begin(index_rows.sparkSession, path)
    write_load(index_rows, path, load_id, 0, sort_by_id=sort_by_id, cluster_files=cluster_files)
    commits.commit_load(index_rows.sparkSession, path, load_id)
    return load_id


def load_articles(articles: DataFrame, path: str, *, load_id: str | None = None, epoch: int = 0,
                  rejects_path: str | None = None, ivf_path: str | None = None, postings_path: str | None = None,
                  columns: tuple[list[F.Column], bool] | None = None, **build) -> str:
    """One load of article rows: index rows to the table, rows without a vector to
    ``rejects_path`` in the same layout (with neither path nor rejects they are dropped,
    P6), new vectors to the IVF index in ``ivf_path`` and token statistics to the posting
    table in ``postings_path``. All of it is visible at once, when the load is committed,
    and nothing of a load that ends before. ``columns``: ``index_columns`` of the same settings,
    made before. Returns the load id."""
    spark, path = articles.sparkSession, path.rstrip("/")
    load_id = load_id or uuid.uuid4().hex
    commits.check_load_id(load_id)
    commits.begin(spark, path)
    if not build.get("id_col"):
        articles, n = commits.numbered(articles, path, load_id, epoch, KEY, spread=True)
        build["id_col"] = KEY
        if not n:                                # a micro-batch of which nothing is kept
            for companion in (rejects_path, ivf_path and f"{ivf_path}/vectors", postings_path):
                if companion:
                    commits.follow(spark, companion, path)
            commits.commit_load(spark, path, load_id, epoch)
            return load_id
    if columns:
        rows = articles.select(*columns[0])
        rows = rows.filter(~_no_vector()) if columns[1] else rows
    else:
        rows = build_index(articles, keep_rejected=bool(rejects_path), **build)
    if rejects_path:
        rows = materialize(rows, "load")      # the encoder runs once for both tables
        commits.follow(spark, rejects_path, path)
        write_load(rejected_rows(rows), rejects_path, load_id, epoch)
        rows = rows.filter(~_no_vector())
    write_load(rows, path, load_id, epoch)
    if ivf_path or postings_path:
        folders = commits.load_folders(spark, path, [(load_id, int(epoch))])
        stored = _scan(spark, path, folders)
        if ivf_path:
            commits.follow(spark, f"{ivf_path}/vectors", path)
            append_ivf(stored, ivf_path, load_id, epoch)
        if postings_path:
            commits.follow(spark, postings_path, path)
            append_postings(stored, postings_path, load_id, epoch)
    commits.commit_load(spark, path, load_id, epoch)
    return load_id


def _scan(spark: SparkSession, path: str, folders: list[str] | None) -> DataFrame:
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in INDEX_SCHEMA.fields) + ", load_id string, epoch int"
    if folders == []:
        return spark.createDataFrame([], ddl).select(*INDEX_COLUMNS)
    return spark.read.schema(ddl).option("basePath", path).parquet(*(folders or [path])).select(*INDEX_COLUMNS)


def read_index(spark: SparkSession, path: str, load_id: str | None = None, epoch: int | None = None) -> DataFrame:
    """Index rows of all committed loads, or of one. Only their folders are opened."""
    path = path.rstrip("/")
    seen = commits.visible(spark, path)
    if seen is None:
        return _scan(spark, path, None)
    chosen = [(x, e) for x, e in seen if load_id in (None, x) and epoch in (None, e)]
    return _scan(spark, path, commits.load_folders(spark, path, chosen))


def compact_index(spark: SparkSession, path: str, rows_per_file: int = 1_000_000) -> str | None:
    """Merges the loads of an index table into large files sorted by id (M1)."""
    return commits.compact(
        spark, path, lambda loads: _scan(spark, path, commits.load_folders(spark, path, loads)),
        lambda rows, load_id, files: write_load(rows, path, load_id, 0, cluster_files=files), rows_per_file)
