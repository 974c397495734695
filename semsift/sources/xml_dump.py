"""Compressed MediaWiki XML dump scan.

The dump is read as text records split at ``</page>`` (splittable for bz2 through
the Hadoop codec), so one malformed page is isolated to its own record. Each
record is parsed with ``from_xml`` in PERMISSIVE mode: ``title`` is the direct
child, ``text`` the first revision's text; unparsable pages are dropped.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semsift.sources.lines import capped_runs, files_in, numbered_lines

PAGE_SCHEMA = ("title string, revision array<struct<text:struct<_VALUE:string>>>, "
               "_corrupt_record string")


def read_dump(spark: SparkSession, path: str, max_pages: int | None = None) -> DataFrame:
    """``(title, raw)`` per parsable ``<page>`` of the dump files at ``path``.

    ``max_pages`` caps pages *seen* (malformed and redirect pages count), before any
    filter: the first ones of the files in path order. Files behind them are not opened.
    """
    def pages_of(paths) -> DataFrame:
        return spark.read.option("lineSep", "</page>").text(paths).filter(F.col("value").contains("<page>"))

    if max_pages is None:
        rec = pages_of(path)
    else:
        rec = spark.createDataFrame([], "value string")
        if max_pages > 0:
            read = lambda files: numbered_lines(pages_of(files))
            for run in capped_runs(files_in(spark, path), read, None, int(max_pages)):
                rec = rec.unionByName(run.select("value"))
    pages = rec.select(F.concat(F.lit("<page>"), F.substring_index("value", "<page>", -1), F.lit("</page>")).alias("xml"))
    parsed = pages.select(F.from_xml("xml", PAGE_SCHEMA, {
        "rowTag": "page", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false",
        "columnNameOfCorruptRecord": "_corrupt_record"}).alias("p"))
    return (parsed.filter(F.col("p._corrupt_record").isNull())
            .select(F.col("p.title").alias("title"),
                    F.col("p.revision")[0]["text"]["_VALUE"].alias("raw")))


def xml_escape(c):
    """Escape ``& < >`` for element text."""
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))


def render_pages(df: DataFrame, title_col: str = "title", text_col: str = "text") -> DataFrame:
    """One ``<page>`` text record per row (title + one revision), for writing dumps."""
    page = F.concat(
        F.lit("  <page>\n    <title>"), xml_escape(F.col(title_col)), F.lit("</title>\n"),
        F.lit("    <revision>\n      <text>"), xml_escape(F.col(text_col)),
        F.lit("</text>\n    </revision>\n  </page>"))
    return df.select(page.alias("value"))


def write_dump(df: DataFrame, path: str, title_col: str = "title", text_col: str = "text") -> None:
    """Write rows as bz2-compressed ``<page>`` records (no root element needed by ``read_dump``)."""
    render_pages(df, title_col, text_col).write.mode("overwrite").option(
        "compression", "bzip2").text(path)
