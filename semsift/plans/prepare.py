"""Prepare stage: dump pages -> cleaned, lower-cased articles.

One fused projection/filter stage over the dump records, no shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semsift.functions.wikitext import has_text, is_prepare_redirect, normalize_article
from semsift.sources.xml_dump import read_dump


def prepare_pages(pages: DataFrame, title_col: str = "title", raw_col: str = "raw",
                  decode_entities: bool = True) -> DataFrame:
    """Keep pages with text that are not redirects; clean and normalise the text."""
    kept = pages.filter(has_text(F.col(raw_col)) & ~is_prepare_redirect(F.col(raw_col)))
    return kept.select(F.col(title_col).alias("title"),
                       normalize_article(F.col(raw_col), decode_entities).alias("text"))


def prepare_dump(spark: SparkSession, path: str, max_pages: int | None = None) -> DataFrame:
    """``(title, text)`` articles from a bz2 XML dump (S1-S4 + P1, P2, P4)."""
    return prepare_pages(read_dump(spark, path, max_pages))
