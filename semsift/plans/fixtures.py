"""Derived inputs built from the supplied tables, identically in Spark and SQL.

Every registered query reads whole tables; nothing here filters rows away. The
same derivations are spelled in DuckDB SQL next to each Spark builder.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semsift.functions.text import first_words
from semsift.operators.embed import HashingEncoder
from semsift.operators.partitioning import ensure_parallelism
from semsift.plans import sqlfrag as S


# Components of the supplied vectors.
VECTOR_DIM = 64
# Tables whose rows carry long texts: per-row work on them is CPU-bound.
TEXT_TABLES = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return ensure_parallelism(df) if name in TEXT_TABLES else df


def joined_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a vector ``(doc_id, text, embedding)``: the supplied one, or for
    documents without one that of the default encoder."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    e = e.withColumn("supplied", F.lit(True))
    has = F.col("supplied").isNotNull()          # the texts meet the vectors once; a supplied vector may be null
    encoded = HashingEncoder(VECTOR_DIM).embed(F.when(~has, F.col("text")))
    return d.join(e, "doc_id", "left").select("doc_id", "text", F.when(has, F.col("embedding")).otherwise(encoded).alias("embedding"))


JOINED_SQL = f"""
SELECT d.doc_id, d.text, e.embedding FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id
UNION ALL
SELECT doc_id, text, {S.unit('v', 'nrm')} AS embedding FROM (
  SELECT doc_id, text, v, {S.vec_norm('v')} AS nrm FROM (
    SELECT doc_id, text, {S.pool_dims('dims', VECTOR_DIM)} AS v FROM (
      SELECT doc_id, text, {S.hash_dims(S.model_tokens('text'), VECTOR_DIM)} AS dims FROM documents
      WHERE doc_id NOT IN (SELECT vec_id FROM embeddings))))"""


def raw_title(text_col="text"):
    """Title of a document: its first three words."""
    return first_words(text_col, 3)


def raw_title_sql(x="text") -> str:
    return S.first_words(x, 3)


def _words_slice(text_col, start: int, n: int):
    return F.array_join(F.slice(F.split(F.col(text_col), "[ \n]+"), start, n), " ")


def _words_slice_sql(x: str, start: int, n: int) -> str:
    return f"array_to_string(regexp_split_to_array({x}, '[ \n]+')[{start}:{start + n - 1}], ' ')"


def query_text(id_col="doc_id", text_col="text"):
    """One query per document, by ``id % 4``: exact title / first two title words /
    ``What is`` + two words / words four and five (not in the title)."""
    k = F.pmod(F.col(id_col), F.lit(4))
    two = _words_slice(text_col, 1, 2)
    return (F.when(k == 0, raw_title(text_col)).when(k == 1, two)
            .when(k == 2, F.concat(F.lit("What is "), two))
            .otherwise(_words_slice(text_col, 4, 2)))


def query_text_sql(id_col="doc_id", x="text") -> str:
    two = _words_slice_sql(x, 1, 2)
    return (f"(CASE ({id_col} % 4) WHEN 0 THEN {raw_title_sql(x)} WHEN 1 THEN {two} "
            f"WHEN 2 THEN 'What is ' || {two} ELSE {_words_slice_sql(x, 4, 2)} END)")


# -- wiki markup wrapper (prefix added to every document) ----------------------
WIKI_PREFIX_PARTS = (
    "{{Infobox|id=", None, "}}",
    "<!-- multi\nline comment -->",
    "== Head ==\n",
    "[[File:a.png|thumb]] ",
    "[[Target page|Label ", None, "]] ",
    "[[Plain]] ",
    "[https://e.org/x Ext] ",
    "<ref name=a/>",
    "<ref>src</ref> ",
)


def wikitext(id_col="doc_id", text_col="text"):
    parts = []
    for p in WIKI_PREFIX_PARTS:
        parts.append(F.col(id_col).cast("string") if p is None else F.lit(p))
    return F.concat(*parts, F.col(text_col))


def wikitext_sql(id_col="doc_id", x="text") -> str:
    parts = [f"CAST({id_col} AS VARCHAR)" if p is None else S.q(p) for p in WIKI_PREFIX_PARTS]
    return "(" + " || ".join(parts + [x]) + ")"


def redirect_text(id_col="doc_id", text_col="text"):
    """Every tenth document becomes ``#REDIRECT [[x]]``, every tenth + 1 ``#Redirect [[x]]``."""
    k = F.pmod(F.col(id_col), F.lit(10))
    return (F.when(k == 0, F.lit("#REDIRECT [[x]]")).when(k == 1, F.lit("  #Redirect [[x]]"))
            .otherwise(F.col(text_col)))


def redirect_text_sql(id_col="doc_id", x="text") -> str:
    return (f"(CASE ({id_col} % 10) WHEN 0 THEN '#REDIRECT [[x]]' "
            f"WHEN 1 THEN '  #Redirect [[x]]' ELSE {x} END)")
