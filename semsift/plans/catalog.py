"""Registered queries: one Spark builder per operator group, with DuckDB oracle SQL.

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
supplied tables. Floats are rounded to 6 places and integer types cast the same
way on both sides so results compare value for value.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semsift import constants as C
from semsift.functions import text as T
from semsift.functions import vectors as V
from semsift.operators import knn as K
from semsift.operators.partitioning import ensure_parallelism
from semsift.operators.scoring import title_score
from semsift.operators.search import hybrid_search
from semsift.plans import fixtures as X
from semsift.plans import sqlfrag as S
from semsift.plans.derived import derived
from semsift.plans.ingest import build_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

KNN_K = 15
SEARCH_K = 10
STREAM_FILES_PER_TRIGGER = 10


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), 6))
    return df


# ---------------------------------------------------------------------------
# shared SQL building blocks
# ---------------------------------------------------------------------------

def _index_sql() -> str:
    return f"""
    j AS ({X.JOINED_SQL}),
    jt AS (SELECT *, {X.raw_title_sql('text')} AS first3 FROM j),
    ix AS (
      SELECT doc_id AS id, {S.clean('first3')} AS title, text AS description,
             {S.q(C.LINK_PREFIX)} || first3 AS link, {S.quantize('embedding')} AS emb
      FROM jt)"""


def vector_index(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> DataFrame:
    j = (docs or X.joined_docs(spark, sf)).withColumn("raw_title", X.raw_title("text"))
    return build_index(j, id_col="doc_id", title_col="raw_title", text_col="text",
                       embedding_col="embedding")


def stored_vector_index(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents with vectors and the index over them, each computed once for the files."""
    inputs = [X.table(spark, sf, t) for t in ("documents", "embeddings")]
    docs = derived(inputs, f"joined-docs {X.VECTOR_DIM}", lambda: X.joined_docs(spark, sf))
    return docs, derived(inputs, f"vector-index {X.VECTOR_DIM}",
                         lambda: vector_index(spark, sf, docs).sortWithinPartitions("id"))


def fixture_queries(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> DataFrame:
    j = docs or X.joined_docs(spark, sf)
    return j.select(F.col("doc_id").alias("query_id"), X.query_text().alias("query"),
                    F.col("embedding").alias("query_vec"))


_DOC_TOKENS_SQL = f"""
    dtok AS (
      SELECT id, tok, least(count(*), {C.FREQ_CAP}) AS freq
      FROM (SELECT id, unnest({S.kw_tokens(S.clean('description'))}) AS tok FROM ix)
      GROUP BY id, tok)"""


def _hybrid_tail_sql(k: int) -> str:
    ek = K.overfetch_k(k)
    return f"""
    qt AS (SELECT query_id, qvec, cq, {S.token_set('cq')} AS toks
           FROM (SELECT query_id, qvec, {S.clean('query')} AS cq FROM qs)),
    pairs AS (SELECT qt.query_id, ix.id, {S.cos_dist('ix.emb', 'qt.qvec')} AS distance
              FROM qt CROSS JOIN ix),
    cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
               ORDER BY round(distance, 6), id) AS rn FROM pairs) WHERE rn <= {ek}),
    {_DOC_TOKENS_SQL},
    qtok AS (SELECT query_id, unnest(toks) AS tok, len(toks) AS nq FROM qt),
    kw AS (SELECT c.query_id, c.id, sum(ln(1 + dtok.freq)) / max(qtok.nq) AS s
           FROM cand c JOIN qtok ON c.query_id = qtok.query_id
           JOIN dtok ON dtok.id = c.id AND dtok.tok = qtok.tok GROUP BY c.query_id, c.id),
    sc AS (
      SELECT c.query_id, c.id, ix.title, ix.description, ix.link,
             1.0 / (1.0 + c.distance) AS knn_score, coalesce(kw.s, 0.0) AS keyword_score,
             {S.title_score(S.clean('ix.title'), 'qt.toks', 'qt.cq')} AS title_score
      FROM cand c JOIN ix ON ix.id = c.id JOIN qt ON qt.query_id = c.query_id
      LEFT JOIN kw ON kw.query_id = c.query_id AND kw.id = c.id),
    fin AS (SELECT *, knn_score * {C.W_KNN}::DOUBLE + keyword_score * {C.W_KEYWORD}::DOUBLE
                      + title_score * {C.W_TITLE}::DOUBLE AS score FROM sc),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id)
                  AS rank FROM fin)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score, title,
           description, link, round(knn_score, 6) AS knn_score,
           round(keyword_score, 6) AS keyword_score, round(title_score, 6) AS title_score
    FROM rk WHERE rank <= {k}"""


# ---------------------------------------------------------------------------
# Hybrid search (flagship)
# ---------------------------------------------------------------------------

HYBRID_SQL = f"""
WITH {_index_sql()},
    qs AS (SELECT doc_id AS query_id, {X.query_text_sql('doc_id', 'text')} AS query,
                  {S.quantize('embedding')} AS qvec FROM j),
    {_hybrid_tail_sql(SEARCH_K)}
"""


@register("hybrid_search", HYBRID_SQL)
def q_hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    docs, ix = stored_vector_index(spark, sf)
    res = hybrid_search(fixture_queries(spark, sf, docs), ix, SEARCH_K, query_vec="query_vec")
    return r6(res, "score", "knn_score", "keyword_score", "title_score")


# ---------------------------------------------------------------------------
# K1-K4, K6: nearest neighbours over the embeddings table
# ---------------------------------------------------------------------------

def _emb(spark, sf):
    return ensure_parallelism(X.table(spark, sf, "embeddings")).select(F.col("vec_id").alias("id"), "embedding", "label")


def _self_knn(spark, sf, strategy):
    e = _emb(spark, sf)
    q = e.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    res = K.knn_join(q, e, KNN_K, strategy=strategy)
    return r6(res.select("query_id", "rank", "id", "distance"), "distance")


KNN_BATCH_SQL = f"""
WITH pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS id, {S.cos_dist('b.embedding', 'a.embedding')} AS distance
  FROM embeddings a CROSS JOIN embeddings b),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 6), id) AS rank
       FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(distance, 6) AS distance
FROM rk WHERE rank <= {KNN_K}
"""


@register("knn_topk_batch", KNN_BATCH_SQL)
def q_knn_topk_batch(spark, sf):
    """Every vector's 15 nearest vectors (itself included), strategy chosen from the
    measured query-matrix size (K3)."""
    return _self_knn(spark, sf, "auto")


@register("knn_topk_arrow", KNN_BATCH_SQL)
def q_knn_topk_arrow(spark, sf):
    """The same through the broadcast + per-partition Arrow top-k path explicitly."""
    return _self_knn(spark, sf, "broadcast")


@register("knn_topk_blocked", KNN_BATCH_SQL)
def q_knn_topk_blocked(spark, sf):
    """Same result through the strategy for query sides that cannot be broadcast: both sides
    partitioned by cells."""
    return _self_knn(spark, sf, "blocked")


def _self_pruned(spark, sf, growth):
    from semsift.operators.pruned import deal, pruned_knn_join
    e = _emb(spark, sf)
    q = e.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    res, _ = pruned_knn_join(q, deal(e, top=KNN_K), KNN_K, growth=growth)
    return r6(res.select("query_id", "rank", "id", "distance"), "distance")


@register("knn_join_pruned", KNN_BATCH_SQL)
def q_knn_join_pruned(spark, sf):
    """Exact join of two partitioned sides (K3, J4): each query's own cell bounds its k-th
    distance, then only cells that the triangle inequality on angles cannot exclude."""
    return _self_pruned(spark, sf, None)


@register("knn_probe_until_exact", KNN_BATCH_SQL)
def q_knn_probe_until_exact(spark, sf):
    """Probing until it is right (K5): rounds of doubling numbers of cells, which a query
    leaves once the bound of its next cell is beyond its k-th distance."""
    return _self_pruned(spark, sf, 2)


KNN_SCORE_SQL = f"""
WITH pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS id, {S.cos_dist('b.embedding', 'a.embedding')} AS distance
  FROM embeddings a CROSS JOIN embeddings b),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 6), id) AS rank
       FROM pairs)
SELECT query_id, id, round(1.0 / (1.0 + distance), 6) AS knn_score
FROM rk WHERE rank <= {KNN_K}
"""


@register("knn_score", KNN_SCORE_SQL)
def q_knn_score(spark, sf):
    e = _emb(spark, sf)
    q = e.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    res = K.knn_join(q, e, KNN_K)
    return r6(res.select("query_id", "id", V.knn_score("distance").alias("knn_score")), "knn_score")


def _centroid_sql() -> str:
    return """
    ex AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos
           FROM embeddings),
    cen AS (SELECT label, list(m ORDER BY pos) AS centroid
            FROM (SELECT label, pos, avg(x::DOUBLE) AS m FROM ex GROUP BY label, pos) GROUP BY label)"""


def label_centroids(e: DataFrame) -> DataFrame:
    """Mean vector per label: ``Summarizer.mean`` (vector partial aggregation)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    return (e.groupBy("label").agg(Summarizer.mean(array_to_vector("embedding")).alias("m"))
            .select("label", vector_to_array("m", "float64").alias("centroid")))


COSINE_SQL = f"""
WITH {_centroid_sql().strip()}
SELECT e.vec_id, e.label, round({S.cos_dist('e.embedding', 'c.centroid')}, 6) AS distance
FROM embeddings e JOIN cen c ON e.label = c.label
"""


@register("cosine_distance", COSINE_SQL)
def q_cosine_distance(spark, sf):
    """Cosine distance of every vector to its label's centroid (K1, no pairs)."""
    e = X.table(spark, sf, "embeddings")
    cen = label_centroids(e)
    out = e.join(cen, "label").select(   # AQE broadcasts it at runtime if small
        "vec_id", "label", V.cosine_distance("embedding", "centroid").alias("distance"))
    return r6(out, "distance")


KNN_SINGLE_SQL = f"""
WITH ex AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
g AS (SELECT list(m ORDER BY pos) AS qv FROM (SELECT pos, avg(x::DOUBLE) AS m FROM ex GROUP BY pos)),
d AS (SELECT e.vec_id AS id, {S.cos_dist('e.embedding', 'g.qv')} AS distance FROM embeddings e, g)
SELECT id, round(distance, 6) AS distance FROM d ORDER BY round(distance, 6), id LIMIT {KNN_K}
"""


@register("knn_topk_single", KNN_SINGLE_SQL)
def q_knn_topk_single(spark, sf):
    """One query (the mean of all vectors, computed by Spark) against every vector (K2)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    e = X.table(spark, sf, "embeddings")
    mean = e.agg(Summarizer.mean(array_to_vector("embedding")).alias("m")).first()["m"]
    res = K.knn_topk_single(list(mean.toArray()), e, KNN_K, id_col="vec_id")
    return r6(res, "distance")


# ---------------------------------------------------------------------------
# Text analysis
# ---------------------------------------------------------------------------

CLEAN_STRING_SQL = f"""
SELECT doc_id, {S.clean('text')} AS clean_text FROM documents
"""


@register("clean_string", CLEAN_STRING_SQL)
def q_clean_string(spark, sf):
    d = X.table(spark, sf, "documents")
    return d.select("doc_id", T.clean_string("text").alias("clean_text"))


TOKEN_SET_SQL = f"""
SELECT item_id, tok AS token FROM (
  SELECT item_id, unnest({S.token_set(S.clean('text'))}) AS tok FROM benchmark)
"""


@register("token_set", TOKEN_SET_SQL)
def q_token_set(spark, sf):
    b = X.table(spark, sf, "benchmark")
    return b.select("item_id", F.explode(T.token_set(T.clean_string("text"))).alias("token"))


TOKEN_FREQ_SQL = f"""
SELECT doc_id, tok AS token, CAST(least(count(*), {C.FREQ_CAP}) AS SMALLINT) AS freq
FROM (SELECT doc_id, unnest({S.kw_tokens(S.clean('text'))}) AS tok FROM documents)
GROUP BY doc_id, tok
"""


@register("token_freq", TOKEN_FREQ_SQL)
def q_token_freq(spark, sf):
    """Per-document token counts, computed per row (sort + run length, no shuffle)."""
    d = X.table(spark, sf, "documents")
    c = d.select("doc_id", F.explode(T.token_counts(T.keyword_tokens(T.clean_string("text")))).alias("c"))
    return c.select("doc_id", F.col("c.token").alias("token"),
                    F.least(F.col("c.freq"), F.lit(C.FREQ_CAP)).cast("smallint").alias("freq"))


TOKEN_STATS_SQL = f"""
WITH t AS (SELECT doc_id, tok, least(count(*), {C.FREQ_CAP}) AS freq
           FROM (SELECT doc_id, unnest({S.kw_tokens(S.clean('text'))}) AS tok FROM documents)
           GROUP BY doc_id, tok)
SELECT d.doc_id, CAST(count(t.tok) AS INTEGER) AS n_tokens,
       CAST(coalesce(sum(t.freq), 0) AS BIGINT) AS total_freq,
       round(coalesce(sum(ln(1 + t.freq)), 0.0), 6) AS sum_log1p
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id GROUP BY d.doc_id
"""


@register("token_stats_roundtrip", TOKEN_STATS_SQL)
def q_token_stats_roundtrip(spark, sf):
    """Stored ``array<struct<hash,freq>>`` -> map (A4) -> per-document summaries."""
    d = X.table(spark, sf, "documents")
    s = d.select("doc_id", T.token_stats("text").alias("ts"))
    m = s.select("doc_id", F.map_from_entries("ts").alias("m"))
    vals = F.map_values("m")
    return m.select(
        "doc_id", F.size("m").cast("int").alias("n_tokens"),
        F.aggregate(vals, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("total_freq"),
        F.round(F.aggregate(vals, F.lit(0.0).cast("double"),
                            lambda a, x: a + F.log1p(x.cast("double"))), 6).alias("sum_log1p"))


ENTITY_PREFIXES_FIXTURE = ("", "What is ", "what are the ", "Define ", "Definition of an ",
                           "explain a ")

ENTITY_SQL = f"""
SELECT item_id, prefix, {S.entity("prefix || text")} AS entity
FROM benchmark, (VALUES {", ".join("(" + S.q(p) + ")" for p in ENTITY_PREFIXES_FIXTURE)}) v(prefix)
"""


@register("query_entity", ENTITY_SQL)
def q_query_entity(spark, sf):
    """Entity string of every benchmark text under each question prefix."""
    b = X.table(spark, sf, "benchmark")
    pf = F.explode(F.array(*[F.lit(p) for p in ENTITY_PREFIXES_FIXTURE])).alias("prefix")
    x = b.select("item_id", "text", pf)
    return x.select("item_id", "prefix",
                    T.extract_entity(F.concat("prefix", "text")).alias("entity"))


# ---------------------------------------------------------------------------
# Vector transforms
# ---------------------------------------------------------------------------

def arr6(c):
    """Array of floats -> array of doubles rounded to 6 places (comparison form)."""
    return F.transform(c, lambda x: F.round(x.cast("double"), 6))


def arr6_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: round(x::DOUBLE, 6))"


L2_SQL = f"""
WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS v
           FROM embeddings),
n AS (SELECT vec_id, v, {S.vec_norm('v')} AS nrm FROM s)
SELECT vec_id, {arr6_sql(S.unit('v', 'nrm'))} AS unit_vec FROM n
"""


@register("l2_normalize", L2_SQL)
def q_l2_normalize(spark, sf):
    """Vectors scaled by (label + 1), normalised back to unit length."""
    e = X.table(spark, sf, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    return e.select("vec_id", arr6(V.l2_normalize(scaled)).alias("unit_vec"))


QUANT_SQL = f"""
SELECT vec_id, {arr6_sql(S.quantize('embedding'))} AS qvec FROM embeddings
"""


@register("vector_quantize", QUANT_SQL)
def q_vector_quantize(spark, sf):
    """Every component rounded half-even to 6 decimals, stored as float."""
    e = X.table(spark, sf, "embeddings")
    return e.select("vec_id", arr6(V.quantize("embedding")).alias("qvec"))


POOL_SQL = f"""
WITH ex AS (SELECT label, embedding[1] >= 0 AS keep, unnest(embedding) AS x,
                   generate_subscripts(embedding, 1) AS pos FROM embeddings),
m AS (SELECT label, pos, sum(CASE WHEN keep THEN x::DOUBLE ELSE 0 END)
                         / sum(CASE WHEN keep THEN 1 ELSE 0 END) AS mu
      FROM ex GROUP BY label, pos),
p AS (SELECT label, list(mu ORDER BY pos) AS v FROM m GROUP BY label),
n AS (SELECT label, v, {S.vec_norm('v')} AS nrm FROM p)
SELECT label, {arr6_sql(S.unit('v', 'nrm'))} AS pooled FROM n
"""


@register("masked_mean_pool", POOL_SQL)
def q_masked_mean_pool(spark, sf):
    """Rows of a label are the token vectors of one text; rows whose first component is
    negative are padding (masked). Masked mean (A5) + L2 normalise (E6), computed with
    ``Summarizer`` weighted means (map-side partial aggregation, skew-safe)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    e = X.table(spark, sf, "embeddings").withColumn(
        "w", F.when(F.get("embedding", 0) >= 0, 1.0).otherwise(0.0))
    m = e.groupBy("label").agg(Summarizer.mean(array_to_vector("embedding"), F.col("w")).alias("m"))
    pooled = V.l2_normalize(vector_to_array("m", "float64"))
    return m.select("label", arr6(pooled).alias("pooled"))


# ---------------------------------------------------------------------------
# Default encoder (E1-like tokens, E4 hashing model, A5, E6, E7)
# ---------------------------------------------------------------------------

HASH_DIM = 64


def _hash_embed_ctes(src: str, key: str, text: str, name: str) -> str:
    """CTEs ``{name}`` = (key, emb) embedding ``text`` of ``src`` with the default encoder."""
    return f"""
    {name}_t AS (SELECT {key} AS k, {S.hash_dims(S.model_tokens(text), HASH_DIM)} AS dims FROM {src}),
    {name}_p AS (SELECT k, {S.pool_dims('dims', HASH_DIM)} AS v FROM {name}_t),
    {name}_n AS (SELECT k, v, {S.vec_norm('v')} AS nrm FROM {name}_p),
    {name} AS (SELECT k AS {key}, {S.quantize(S.unit('v', 'nrm'))} AS emb FROM {name}_n)"""


FEATURE_HASH_SQL = f"""
WITH {_hash_embed_ctes('benchmark', 'item_id', 'text', 'he').strip()}
SELECT item_id, {arr6_sql('emb')} AS embedding FROM he
"""


@register("feature_hash_embed", FEATURE_HASH_SQL)
def q_feature_hash_embed(spark, sf):
    from semsift.operators.embed import HashingEncoder, embed
    b = X.table(spark, sf, "benchmark")
    out = embed(b, "text", HashingEncoder(HASH_DIM))
    return out.select("item_id", arr6(F.col("embedding")).alias("embedding"))


# ---------------------------------------------------------------------------
# K7 keyword score (posting-list join form), K8 title score, P8 lookup
# ---------------------------------------------------------------------------

KEYWORD_SQL = f"""
WITH {_index_sql()},
    qs AS (SELECT doc_id AS query_id, {X.query_text_sql('doc_id', 'text')} AS query,
                  {S.quantize('embedding')} AS qvec FROM j),
    qt AS (SELECT query_id, qvec, {S.token_set(S.clean('query'))} AS toks FROM qs),
    pairs AS (SELECT qt.query_id, ix.id, {S.cos_dist('ix.emb', 'qt.qvec')} AS distance
              FROM qt CROSS JOIN ix),
    cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
               ORDER BY round(distance, 6), id) AS rn FROM pairs) WHERE rn <= {K.overfetch_k(SEARCH_K)}),
    {_DOC_TOKENS_SQL},
    qtok AS (SELECT query_id, unnest(toks) AS tok, len(toks) AS nq FROM qt),
    kw AS (SELECT c.query_id, c.id, sum(ln(1 + dtok.freq)) / max(qtok.nq) AS s
           FROM cand c JOIN qtok ON c.query_id = qtok.query_id
           JOIN dtok ON dtok.id = c.id AND dtok.tok = qtok.tok GROUP BY c.query_id, c.id)
SELECT c.query_id, c.id, round(coalesce(kw.s, 0.0), 6) AS keyword_score
FROM cand c LEFT JOIN kw ON kw.query_id = c.query_id AND kw.id = c.id
"""


@register("keyword_score", KEYWORD_SQL)
def q_keyword_score(spark, sf):
    """Keyword score of every (query, candidate) pair through the posting-list
    equi-join on ``(id, hash)`` (J2), candidates from the exact kNN join."""
    from semsift.operators.search import prepare_queries
    from semsift.operators.keyword import keyword_scores_join
    from semsift.session import materialize
    docs, ix = stored_vector_index(spark, sf)
    qf = materialize(prepare_queries(fixture_queries(spark, sf, docs), query_vec="query_vec"), "kw_queries")
    cands = materialize(K.knn_join(qf.select("query_id", "query_vec"), ix,
                                   K.overfetch_k(SEARCH_K), with_rank=False), "kw_cands")
    out = keyword_scores_join(cands.select("query_id", "id"), qf, ix)
    return r6(out, "keyword_score")


@register("keyword_posting_index", KEYWORD_SQL)
def q_keyword_posting_index(spark, sf):
    """The same from a posting table stored by two loads (J2): inverted lists bucketed by a
    key of load, hash and list, joined where they lie."""
    from semsift.operators.keyword import keyword_scores_stored
    from semsift.operators.search import prepare_queries
    from semsift.plans.ingest import load_articles, read_index
    from semsift.session import materialize, release, scratch_path
    base = scratch_path(spark, "postings")
    j = materialize(X.joined_docs(spark, sf).withColumn("raw_title", X.raw_title("text")), "kw_docs")
    for half in (0, 1):
        load_articles(j.where(F.pmod("doc_id", F.lit(2)) == half), f"{base}/table", id_col="doc_id", title_col="raw_title",
                      embedding_col="embedding", postings_path=f"{base}/postings")
    ix = read_index(spark, f"{base}/table")
    qf = materialize(prepare_queries(fixture_queries(spark, sf, j), query_vec="query_vec"), "kw_queries")
    release(j)
    cands = materialize(K.knn_join(qf.select("query_id", "query_vec"), ix, K.overfetch_k(SEARCH_K), with_rank=False),
                        "kw_cands")
    return r6(keyword_scores_stored(cands.select("query_id", "id"), qf, f"{base}/postings"), "keyword_score")


def _page_title(html="html"):
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)


_PAGE_TITLE_SQL = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"

TITLE_SQL = f"""
WITH p AS (SELECT page_id, {_PAGE_TITLE_SQL} AS title FROM pages),
t AS (SELECT page_id, {S.clean(S.clean('title'))} AS ct, {S.clean(X.query_text_sql('page_id', 'title'))} AS cq FROM p)
SELECT page_id, round({S.title_score('ct', S.token_set('cq'), 'cq')}, 6) AS title_score FROM t
"""


@register("title_score", TITLE_SQL)
def q_title_score(spark, sf):
    """Title score of every page's title against its fixture query."""
    p = X.table(spark, sf, "pages").select("page_id", _page_title().alias("title"))
    t = p.select("page_id", T.clean_string(T.clean_string("title")).alias("ct"),
                 T.clean_string(X.query_text("page_id", "title")).alias("cq"))
    return r6(t.select("page_id", title_score("ct", T.token_set(F.col("cq")), "cq").alias("title_score")),
              "title_score")


LOOKUP_SQL = f"""
WITH {_index_sql()},
    pairs AS (SELECT a.id AS query_id, b.id, {S.cos_dist('b.emb', 'a.emb')} AS distance
              FROM ix a CROSS JOIN ix b),
    cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
               ORDER BY round(distance, 6), id) AS rn FROM pairs) WHERE rn <= {K.overfetch_k(SEARCH_K)})
SELECT c.query_id, c.id, ix.title, ix.link, round(c.distance, 6) AS distance
FROM cand c JOIN ix ON ix.id = c.id
"""


@register("candidate_lookup", LOOKUP_SQL)
def q_candidate_lookup(spark, sf):
    """Candidate ids -> detail columns by id (P8/J3, late materialisation)."""
    from semsift.operators.search import fetch_candidates
    _, ix = stored_vector_index(spark, sf)
    q = ix.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    from semsift.session import materialize
    cands = materialize(K.knn_join(q, ix, K.overfetch_k(SEARCH_K), with_rank=False), "lookup")
    det = fetch_candidates(cands, ix, cands.count(), cols=("title", "link"))
    return r6(det.select("query_id", "id", "title", "link", "distance"), "distance")


# ---------------------------------------------------------------------------
# Markup cleaning and article filters
# ---------------------------------------------------------------------------

_RE2_WS = ("\\t\\n\\x0b\\x0c\\r \\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
           "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}")
# fixed values: the cleaning patterns in the oracle's syntax, in their order
RE2_STEPS = (
    ("(?s)<!--.*?-->", ""),
    ("(?s)<ref[^>/]*?>.*?</ref>", ""),
    ("<ref[^/>]*/>", ""),
    ("(?s)\\{\\{.*?\\}\\}", ""),
    ("(?i)\\[\\[(File|Image|Category):.*?\\]\\]", ""),
    ("\\[\\[[^|\\]]+\\|([^\\]]+)\\]\\]", "\\1"),
    ("\\[\\[([^\\]]+)\\]\\]", "\\1"),
    ("\\[https?://[^" + _RE2_WS + "\\]]+[" + _RE2_WS + "]?([^\\]]*)\\]", "\\1"),
    ("[\\[\\]]", ""),
    ("==+.*?==+", ""),
)


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, {S.q('^[' + _RE2_WS + ']+|[' + _RE2_WS + ']+$')}, '', 'g')"


def _sql_clean_markup(x: str) -> str:
    for pat, rep in RE2_STEPS:
        x = f"regexp_replace({x}, {S.q(pat)}, {S.q(rep)}, 'g')"
    x = f"regexp_replace({x}, {S.q('[' + _RE2_WS + ']+')}, ' ', 'g')"
    return _sql_strip(x)


def _sql_normalize(x: str) -> str:
    return f"replace(lower({_sql_clean_markup(_sql_strip(x))}), '’', '''')"


def _sql_has_text(x: str) -> str:
    return f"({x} IS NOT NULL AND regexp_matches({x}, {S.q('[^' + _RE2_WS + ']')}))"


def _sql_prepare_redirect(x: str) -> str:
    return f"starts_with(lower({_sql_strip(x)}), '#redirect')"


WIKITEXT_SQL = f"""
SELECT doc_id, {_sql_normalize(X.wikitext_sql('doc_id', 'text'))} AS clean_text FROM documents
"""


@register("wikitext_clean", WIKITEXT_SQL)
def q_wikitext_clean(spark, sf):
    """Every document wrapped in wiki markup, cleaned and normalised."""
    from semsift.functions.wikitext import normalize_article
    d = X.table(spark, sf, "documents")
    return d.select("doc_id", normalize_article(X.wikitext()).alias("clean_text"))


def _entity_sql() -> str:
    from semsift.functions.wikitext import ENTITIES, OPEN_NAMES, REFERENCE
    names = ", ".join(f"({S.q(n)}, {S.q(v)})" for n, v in ENTITIES.items())
    reference = REFERENCE.replace("\\t", "\t").replace("\\n", "\n").replace("\\f", "\f")
    return f"""
WITH names(name, value) AS (VALUES {names}),
p AS (SELECT page_id, unnest(string_split(html, '&')) AS part, generate_subscripts(string_split(html, '&'), 1) AS i
      FROM pages),
r AS (SELECT *, regexp_extract(part, {S.q(reference)}, 1) AS ref,
             regexp_extract(part, {S.q("^(" + "|".join(OPEN_NAMES) + ")")}, 1) AS short FROM p),
d AS (SELECT r.page_id, r.i, CASE WHEN r.i = 1 THEN part
             WHEN ref LIKE '#%' THEN chr(CAST(CASE WHEN ref[2] IN ('x', 'X') THEN '0x' || regexp_extract(ref, '^#[xX]([0-9a-fA-F]+)', 1)
                                             ELSE regexp_extract(ref, '^#([0-9]+)', 1) END AS INT)) || part[length(ref) + 1:]
             WHEN a.name IS NOT NULL THEN a.value || part[length(ref) + 1:]
             WHEN b.name IS NOT NULL THEN b.value || part[length(short) + 1:]
             ELSE '&' || part END AS text
      FROM r LEFT JOIN names a ON a.name = r.ref LEFT JOIN names b ON b.name = r.short)
SELECT page_id, string_agg(text, '' ORDER BY i) AS html FROM d GROUP BY page_id
"""


ENTITY_DECODE_SQL = _entity_sql()


@register("html_entity_decode", ENTITY_DECODE_SQL)
def q_html_entity_decode(spark, sf):
    """HTML entities of every page decoded."""
    from semsift.functions.wikitext import html_unescape
    p = X.table(spark, sf, "pages")
    return p.select("page_id", html_unescape("html").alias("html"))


REDIRECT_SQL = f"""
WITH r AS (SELECT doc_id, {X.raw_title_sql('text')} AS title,
                  {X.redirect_text_sql('doc_id', 'text')} AS body FROM documents)
SELECT doc_id, {S.q(C.LINK_PREFIX)} || title AS link,
       ({_sql_has_text('body')} AND NOT {_sql_prepare_redirect('body')}) AS kept_at_prepare
FROM r WHERE NOT contains(body, '#REDIRECT')
"""


@register("article_filter_redirects", REDIRECT_SQL)
def q_article_filter_redirects(spark, sf):
    """Injected redirects: ingest drops ``#REDIRECT`` anywhere (P3), prepare drops
    any-case ``#redirect`` prefixes and blank text (P1, P2); link derived (P5)."""
    from semsift.functions.wikitext import has_text, is_prepare_redirect
    from semsift.plans.ingest import article_link
    from semsift.sources.jsonl import drop_ingest_redirects
    d = X.table(spark, sf, "documents").select(
        "doc_id", X.raw_title().alias("title"), X.redirect_text().alias("body"))
    kept = drop_ingest_redirects(d, "body")
    return kept.select("doc_id", article_link(F.col("title")).alias("link"),
                       (has_text("body") & ~is_prepare_redirect("body")).alias("kept_at_prepare"))


# ---------------------------------------------------------------------------
# Vocabulary encoding
# ---------------------------------------------------------------------------

ENCODE_SQL = f"""
WITH w AS (SELECT DISTINCT unnest({S.words('text')}) AS token FROM benchmark),
vocab AS (SELECT token, 3 + row_number() OVER (ORDER BY token) AS token_id FROM w
          WHERE token NOT IN ('[PAD]', '[UNK]', '[CLS]', '[SEP]')
          UNION ALL SELECT * FROM (VALUES ('[PAD]', 0), ('[UNK]', 1), ('[CLS]', 2), ('[SEP]', 3)) v(token, token_id)),
dw AS (SELECT doc_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos
       FROM (SELECT doc_id, ({S.words('text')})[1:{C.MAX_SEQ_LEN - 2}] AS ws FROM documents)),
ids AS (SELECT dw.doc_id, list(coalesce(v.token_id, 1)::BIGINT ORDER BY dw.pos) AS body
        FROM dw LEFT JOIN vocab v ON v.token = dw.token GROUP BY dw.doc_id),
seqs AS (SELECT d.doc_id, list_concat([2::BIGINT], coalesce(i.body, []::BIGINT[]), [3::BIGINT]) AS s
         FROM documents d LEFT JOIN ids i ON i.doc_id = d.doc_id)
SELECT doc_id,
       list_concat(s, list_transform(range({C.MAX_SEQ_LEN} - len(s)), lambda x: 0::BIGINT)) AS input_ids,
       list_concat(list_transform(s, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END::BIGINT),
                   list_transform(range({C.MAX_SEQ_LEN} - len(s)), lambda x: 0::BIGINT)) AS attention_mask,
       list_transform(range({C.MAX_SEQ_LEN}), lambda x: 0::BIGINT) AS token_type_ids
FROM seqs
"""


@register("token_encode", ENCODE_SQL)
def q_token_encode(spark, sf):
    """Documents encoded against a vocabulary built from the benchmark words."""
    from semsift.operators.encode import encode_tokens, vocab_from_words
    vocab = vocab_from_words(X.table(spark, sf, "benchmark"), "text")
    d = X.table(spark, sf, "documents")
    return encode_tokens(d, "text", vocab, C.MAX_SEQ_LEN, key="doc_id")


# ---------------------------------------------------------------------------
# E8 + K11: text-in hybrid search with the default encoder
# ---------------------------------------------------------------------------

TEXT_SEARCH_SQL = f"""
WITH dt AS (SELECT doc_id, text, {X.raw_title_sql('text')} AS first3 FROM documents),
    {_hash_embed_ctes('dt', 'doc_id', 'text', 'de').strip()},
    ix AS (SELECT dt.doc_id AS id, {S.clean('first3')} AS title, text AS description,
                  {S.q(C.LINK_PREFIX)} || first3 AS link, de.emb FROM dt JOIN de USING (doc_id)),
    bq AS (SELECT item_id, text, {S.entity('text')} AS ent FROM benchmark),
    {_hash_embed_ctes('bq', 'item_id', 'ent', 'qe').strip()},
    qs AS (SELECT bq.item_id AS query_id, bq.text AS query, qe.emb AS qvec
           FROM bq JOIN qe USING (item_id)),
    {_hybrid_tail_sql(SEARCH_K)}
"""


def text_index(spark, sf):
    from semsift.operators.embed import HashingEncoder
    d = X.table(spark, sf, "documents").withColumn("raw_title", X.raw_title())
    return build_index(d, encoder=HashingEncoder(HASH_DIM), id_col="doc_id", title_col="raw_title")


@register("hybrid_search_text", TEXT_SEARCH_SQL)
def q_hybrid_search_text(spark, sf):
    """Benchmark texts as queries: entity -> default encoder -> hybrid search over
    an index built from every document (E8 + K11)."""
    from semsift.operators.embed import HashingEncoder
    b = X.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"),
                                                F.col("text").alias("query"))
    ix = derived([X.table(spark, sf, "documents")], f"text-index hashing {HASH_DIM}",
                 lambda: text_index(spark, sf).sortWithinPartitions("id"))
    res = hybrid_search(b, ix, SEARCH_K, encoder=HashingEncoder(HASH_DIM))
    return r6(res, "score", "knn_score", "keyword_score", "title_score")


@register("search_located", TEXT_SEARCH_SQL)
def q_search_located(spark, sf):
    """The same over a stored index: the kNN scan hands on each candidate's file and row, and
    the detail fetch reads only there (K11, P8)."""
    from semsift.operators.embed import HashingEncoder
    from semsift.operators.locate import located_search
    from semsift.plans.ingest import append_index, read_index
    from semsift.session import scratch_path
    path = scratch_path(spark, "located-index")
    append_index(text_index(spark, sf), path)
    b = X.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    res = located_search(b, read_index(spark, path), SEARCH_K, encoder=HashingEncoder(HASH_DIM))
    return r6(res, "score", "knn_score", "keyword_score", "title_score")


# ---------------------------------------------------------------------------
# Sources, sinks, index table, incremental ingest
# ---------------------------------------------------------------------------

def _articles(spark, sf):
    d = X.table(spark, sf, "documents")
    return d.select("doc_id", X.raw_title().alias("title"), "text")


def _hadoop_fs(spark, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _write_lines_as(spark, df: DataFrame, folder: str, suffix: str) -> None:
    """Write a one-column text DataFrame into ``folder`` with file suffix ``suffix``
    (text part files are renamed through the Hadoop FileSystem API)."""
    tmp = folder.rstrip("/") + "/_staging" + suffix.replace(".", "_")
    df.write.mode("overwrite").text(tmp)
    fs, p, jvm = _hadoop_fs(spark, tmp)
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("part-"):
            fs.rename(st.getPath(), jvm.org.apache.hadoop.fs.Path(
                folder.rstrip("/") + "/" + name.split(".")[0] + suffix))
    fs.delete(p, True)


JSONL_SQL = f"""
SELECT {X.raw_title_sql('text')} AS title, text, {S.q(C.LINK_PREFIX)} || {X.raw_title_sql('text')} AS link
FROM documents WHERE NOT contains(text, '#REDIRECT')
"""


@register("jsonl_roundtrip", JSONL_SQL)
def q_jsonl_roundtrip(spark, sf):
    """Articles written as JSON lines (S5) next to malformed ``.json`` lines and an
    ignored ``.jsonl`` copy, read back with the ingest reader (S6-S9, P3, P5)."""
    from semsift.session import scratch_path
    from semsift.sources.jsonl import read_articles, write_articles
    arts = _articles(spark, sf)
    base = scratch_path(spark, "jsonl")
    write_articles(arts, base)
    bad = arts.select(F.explode(F.array(
        F.concat(F.lit('{"title": "'), F.col("title")),                 # truncated object
        F.concat(F.lit("not json "), F.col("doc_id").cast("string")),    # not JSON
        F.lit(""),                                                       # blank line
    )).alias("value"))
    _write_lines_as(spark, bad, base, ".json")
    _write_lines_as(spark, arts.select(F.to_json(F.struct("title", "text")).alias("value")),
                    base, ".jsonl")
    return read_articles(spark, base).select("title", "text", "link")


DUMP_SQL = f"""
WITH r AS (SELECT {X.raw_title_sql('text')} AS title, {X.redirect_text_sql('doc_id', 'text')} AS body
           FROM documents)
SELECT title, {_sql_normalize('body')} AS text FROM r
WHERE {_sql_has_text('body')} AND NOT {_sql_prepare_redirect('body')}
"""


@register("xml_dump_scan", DUMP_SQL)
def q_xml_dump_scan(spark, sf):
    """Documents (with injected redirects) rendered as a bz2 XML dump with a malformed
    page after every good one, then scanned and prepared (S1-S4, P1, P2, P4)."""
    from semsift.plans.prepare import prepare_dump
    from semsift.session import scratch_path
    from semsift.sources.xml_dump import render_pages
    d = X.table(spark, sf, "documents").select(X.raw_title().alias("title"),
                                              X.redirect_text().alias("text"))
    good = render_pages(d)
    broken = d.select(F.concat(F.lit("  <page>\n    <title>"), F.lit("x</titl>\n"),
                               F.lit("    <revision><text>y</text></revision>\n  </page>")).alias("value"))
    pages = good.unionByName(broken)
    path = scratch_path(spark, "dump")
    pages.write.mode("overwrite").option("compression", "bzip2").text(path)
    return prepare_dump(spark, path)


PAGE_CAP_SQL = f"""
WITH r AS (SELECT {X.raw_title_sql('text')} AS title, {X.redirect_text_sql('doc_id', 'text')} AS body,
                  2 * row_number() OVER (ORDER BY doc_id) - 1 AS page, count(*) OVER () AS n FROM documents)
SELECT title, {_sql_normalize('body')} AS text FROM r
WHERE page <= n AND {_sql_has_text('body')} AND NOT {_sql_prepare_redirect('body')}
"""


@register("dump_page_cap", PAGE_CAP_SQL)
def q_dump_page_cap(spark, sf):
    """A dump in several files, a malformed page after every good one, scanned up to a cap of
    half its pages: malformed and redirect pages count, files behind the cap stay closed (S4)."""
    from semsift.plans.prepare import prepare_dump
    from semsift.session import scratch_path
    from semsift.sources.xml_dump import render_pages
    d = X.table(spark, sf, "documents").repartitionByRange(24, "doc_id").sortWithinPartitions("doc_id")
    d = d.select(X.raw_title().alias("title"), X.redirect_text().alias("text"))
    broken = F.lit("\n  <page>\n    <title>x</titl>\n    <revision><text>y</text></revision>\n  </page>")
    path = scratch_path(spark, "dump-cap")
    render_pages(d).select(F.concat("value", broken).alias("value")).write.mode("overwrite").text(path)
    return prepare_dump(spark, path, max_pages=d.count())


def _stats_summary(idx: DataFrame, keep_id: bool = False) -> DataFrame:
    return idx.select(
        *(["id"] if keep_id else []),
        "title", "link", "description", arr6(F.col("embedding")).alias("embedding"),
        F.size("token_stats").cast("int").alias("n_tokens"),
        F.aggregate("token_stats", F.lit(0).cast("long"),
                    lambda a, s: a + s["freq"].cast("long")).alias("total_freq"))


INGEST_SQL = f"""
WITH dt AS (SELECT doc_id, text, {X.raw_title_sql('text')} AS first3 FROM documents),
    {_hash_embed_ctes('dt', 'doc_id', 'text', 'de').strip()},
    tk AS (SELECT doc_id, tok, least(count(*), {C.FREQ_CAP}) AS freq
           FROM (SELECT doc_id, unnest({S.kw_tokens(S.clean('text'))}) AS tok FROM dt)
           GROUP BY doc_id, tok),
    ts AS (SELECT dt.doc_id, CAST(count(tk.tok) AS INTEGER) AS n_tokens,
                  CAST(coalesce(sum(tk.freq), 0) AS BIGINT) AS total_freq
           FROM dt LEFT JOIN tk ON tk.doc_id = dt.doc_id GROUP BY dt.doc_id)
SELECT {{id}}{S.clean('first3')} AS title, {S.q(C.LINK_PREFIX)} || first3 AS link, text AS description,
       {arr6_sql('de.emb')} AS embedding, ts.n_tokens, ts.total_freq
FROM dt JOIN de USING (doc_id) JOIN ts USING (doc_id) {{where}}
"""


@register("ingest_batch_table", INGEST_SQL.replace("{id}", "dt.doc_id AS id, ").replace("{where}", ""))
def q_ingest_batch_table(spark, sf):
    """Batch ingest: index rows appended to a Parquet table and read back."""
    from semsift.operators.embed import HashingEncoder
    from semsift.plans.ingest import append_index, read_index
    from semsift.session import scratch_path
    arts = _articles(spark, sf)
    idx = build_index(arts, encoder=HashingEncoder(HASH_DIM), id_col="doc_id")
    path = scratch_path(spark, "index")
    append_index(idx, path)
    return _stats_summary(read_index(spark, path), keep_id=True)


@register("stream_ingest", INGEST_SQL.replace("{id}", "").replace(
    "{where}", "WHERE NOT contains(text, '#REDIRECT')"))
def q_stream_ingest(spark, sf):
    """Incremental ingest: JSON-lines files (250 articles each) loaded by a Structured
    Streaming file source, one file per micro-batch, into the Parquet index (M1)."""
    from semsift.operators.embed import HashingEncoder
    from semsift.session import scratch_path
    from semsift.sources.jsonl import write_articles
    from semsift.streaming.ingest_stream import ingest_stream, read_index
    base = scratch_path(spark, "stream")
    write_articles(_articles(spark, sf), f"{base}/in", records_per_file=C.INGEST_BATCH)
    ingest_stream(spark, f"{base}/in", f"{base}/table", f"{base}/_checkpoint",
                  encoder=HashingEncoder(HASH_DIM), files_per_trigger=STREAM_FILES_PER_TRIGGER)
    return _stats_summary(read_index(spark, f"{base}/table"))


APPEND_SQL = f"""
WITH a AS (SELECT {S.clean(X.raw_title_sql('text'))} AS title, text, doc_id % 10 = 0 AS redirect FROM documents),
kept AS (SELECT title, text FROM a WHERE NOT redirect AND NOT contains(text, '#REDIRECT'))
SELECT title, md5(text) AS text_md5, 4 * count(*) AS n_rows, 4 * count(*) AS n_ids, CAST(4 AS BIGINT) AS n_loads
FROM kept GROUP BY title, text
"""


@register("ingest_append_twice", APPEND_SQL)
def q_ingest_append_twice(spark, sf):
    """Two batch appends and two stream loads with checkpoints of their own into one
    table, the second of them run twice (S12, S13, M1): every row is there four times,
    under four ids."""
    from semsift.operators.embed import HashingEncoder
    from semsift.plans.ingest import load_articles
    from semsift.session import scratch_path
    from semsift.sources.jsonl import read_articles, write_articles
    from semsift.streaming.ingest_stream import ingest_stream
    base = scratch_path(spark, "append")
    arts = X.table(spark, sf, "documents").select(
        X.raw_title().alias("title"),
        F.when(F.col("doc_id") % 10 == 0, F.lit("#REDIRECT [[x]]")).otherwise(F.col("text")).alias("text"))
    write_articles(arts, f"{base}/in", records_per_file=C.INGEST_BATCH)
    enc, table = HashingEncoder(8), f"{base}/table"
    for _ in range(2):
        load_articles(read_articles(spark, f"{base}/in"), table, encoder=enc)
    for checkpoint in ("a", "b", "b"):
        ingest_stream(spark, f"{base}/in", table, f"{base}/_{checkpoint}", encoder=enc,
                      files_per_trigger=STREAM_FILES_PER_TRIGGER)
    return spark.read.parquet(table).groupBy("title", F.col("description").alias("text")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_ids"),
        F.countDistinct("load_id").alias("n_loads")).select(
        "title", F.md5("text").alias("text_md5"), "n_rows", "n_ids", "n_loads")


DENSE_SQL = "SELECT unnest(range(3 * count(*))) AS id FROM documents WHERE NOT contains(text, '#REDIRECT')"


@register("ingest_dense_keys", DENSE_SQL)
def q_ingest_dense_keys(spark, sf):
    """Keys of three loads into one table, the second of rows that a shuffle deals and the
    third a repeated attempt: the numbers from 0 on, each once (S13)."""
    from semsift.operators.embed import HashingEncoder
    from semsift.plans.ingest import load_articles, read_index
    from semsift.session import scratch_path
    from semsift.sources.jsonl import read_articles, write_articles
    base, enc = scratch_path(spark, "dense"), HashingEncoder(8)
    write_articles(_articles(spark, sf), f"{base}/in", records_per_file=C.INGEST_BATCH)
    arts = read_articles(spark, f"{base}/in")
    for rows, load in ((arts, "first"), (arts.repartition("title"), "second"), (arts, "third"), (arts, "third")):
        load_articles(rows, f"{base}/table", encoder=enc, load_id=load)
    return read_index(spark, f"{base}/table").select("id")


BROKEN_SQL = """
SELECT t.kind, doc_id AS id FROM documents, (SELECT unnest(['index', 'vectors', 'rejects']) AS kind) t
WHERE doc_id % 2 = 0 AND (t.kind = 'rejects') = (doc_id % 6 = 0)
"""


@register("ingest_broken_load", BROKEN_SQL)
def q_ingest_broken_load(spark, sf):
    """What readers see when one load is whole and the next ended between the index and the
    approximate index: of all three tables only the first load (S12)."""
    from pyspark.errors import AnalysisException
    from semsift.operators.ann import build_ivf, read_ivf, write_ivf
    from semsift.plans.ingest import load_articles, read_index
    from semsift.session import scratch_path
    base = scratch_path(spark, "broken")
    docs = X.table(spark, sf, "documents").select("doc_id", "text", X.raw_title().alias("title"))
    vector = F.when(F.col("doc_id") % 6 == 0, F.array().cast("array<float>")).otherwise(
        F.transform(F.array(*[F.lit(k) for k in range(1, 5)]), lambda k: F.pmod(F.col("doc_id") * k, F.lit(7)).cast("float")))
    docs = docs.withColumn("embedding", vector)
    cells = spark.createDataFrame([(0, [1.0, 1.0, 1.0, 1.0])], "cell long, centroid array<double>")
    write_ivf(build_ivf(docs.limit(0), centroids=cells, id_col="doc_id"), f"{base}/ivf")
    load = dict(id_col="doc_id", embedding_col="embedding", rejects_path=f"{base}/rejects")
    load_articles(docs.where("doc_id % 2 = 0"), f"{base}/table", ivf_path=f"{base}/ivf", **load)
    try:
        load_articles(docs.where("doc_id % 2 = 1"), f"{base}/table", ivf_path=f"{base}/no-such-index", **load)
    except AnalysisException:
        pass                                    # the index rows are written, the vectors are not
    named = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), "id")
    return named(read_index(spark, f"{base}/table"), "index").union(
        named(read_ivf(spark, f"{base}/ivf").vectors, "vectors")).union(named(read_index(spark, f"{base}/rejects"), "rejects"))


COMPACT_SQL = f"""
SELECT {S.clean(X.raw_title_sql('text'))} AS title, md5(text) AS text_md5, count(*) AS n_rows, count(*) AS n_ids,
       CAST(1 AS BIGINT) AS n_loads
FROM documents WHERE NOT contains(text, '#REDIRECT') GROUP BY {S.clean(X.raw_title_sql('text'))}, text
"""


@register("stream_compaction", COMPACT_SQL)
def q_stream_compaction(spark, sf):
    """Micro-batches, some without a row that is kept (M2), merged into one sorted load that
    a single commit swaps in (M1); the replaced ones are deleted."""
    from semsift.operators.embed import HashingEncoder
    from semsift.plans import commits
    from semsift.plans.ingest import compact_index
    from semsift.session import scratch_path
    from semsift.sources.jsonl import write_articles
    from semsift.streaming.ingest_stream import ingest_stream
    base, arts = scratch_path(spark, "compact"), _articles(spark, sf)
    table = f"{base}/table"
    write_articles(arts, f"{base}/in", records_per_file=4 * C.INGEST_BATCH)
    write_articles(arts.select("title", F.lit("#REDIRECT [[x]]").alias("text")), f"{base}/in",
                   records_per_file=4 * C.INGEST_BATCH, mode="append")
    ingest_stream(spark, f"{base}/in", table, f"{base}/_checkpoint", encoder=HashingEncoder(8), files_per_trigger=2)
    compact_index(spark, table)
    commits.expire(spark, table)
    return spark.read.parquet(table).groupBy("title", F.col("description").alias("text")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_ids"), F.countDistinct("load_id").alias("n_loads")) \
        .select("title", F.md5("text").alias("text_md5"), "n_rows", "n_ids", "n_loads")


CAP_PERCENT = 60
TEXT_FILE_BYTES = 16 << 20


def _text_files(docs: DataFrame) -> int:
    """Files to write for the documents' texts: four, or as many as keep them to a size."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(4, -(-size // TEXT_FILE_BYTES))

CAP_SQL = f"""
WITH l AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS n, count(*) OVER () AS total FROM documents),
k AS (SELECT *, doc_id % 10 NOT IN (0, 3) AND NOT contains(text, '#REDIRECT') AS keep FROM l),
cap AS (SELECT coalesce(min(n), max(total)) AS upto FROM k WHERE keep AND n >= total * {CAP_PERCENT} // 100)
SELECT {X.raw_title_sql('text')} AS title, md5(text) AS text_md5 FROM k, cap WHERE keep AND n <= upto
"""


@register("ingest_exact_cap", CAP_SQL)
def q_ingest_exact_cap(spark, sf):
    """The ingest cap by its exact rule (L1): files of articles in id order, some lines
    redirects, malformed or indented, read up to the first kept line at the cap."""
    from semsift.session import scratch_path
    from semsift.sources.jsonl import read_articles_exact_cap
    d = X.table(spark, sf, "documents").select("doc_id", "text", X.raw_title().alias("title"))
    line = F.to_json(F.struct("title", F.when(F.col("doc_id") % 10 == 0, F.lit("#REDIRECT [[x]]"))
                              .otherwise(F.col("text")).alias("text")))
    line = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("not json "), line)) \
        .when(F.col("doc_id") % 10 == 4, F.concat(F.lit("  "), line)).otherwise(line)
    base = scratch_path(spark, "cap")
    lines = d.select("doc_id", line.alias("value")).repartitionByRange(_text_files(d), "doc_id").sortWithinPartitions("doc_id")
    _write_lines_as(spark, lines.select("value"), base, ".json")
    cap = d.count() * CAP_PERCENT // 100
    return read_articles_exact_cap(spark, base, cap).select("title", F.md5("text").alias("text_md5"))


REJECT_SQL = f"""
SELECT d.doc_id AS id, {S.clean(X.raw_title_sql('d.text'))} AS title,
       CASE WHEN e.vec_id IS NULL OR d.doc_id % 7 = 0 THEN 'rejected' ELSE 'stored' END AS table_name
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
"""


@register("ingest_rejects", REJECT_SQL)
def q_ingest_rejects(spark, sf):
    """A load of documents with the supplied vectors, some missing and some empty: those
    rows go to the rejects table (P6), the others to the index, read by the name that
    ``CREATE TABLE IF NOT EXISTS`` gave it (S11)."""
    import uuid
    from semsift.plans.ingest import create_index_table, load_articles, read_index, refresh_index_table
    from semsift.session import scratch_path
    d = X.table(spark, sf, "documents").select("doc_id", "text", X.raw_title().alias("title"))
    e = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    vector = F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<float>")).otherwise(F.col("embedding"))
    arts = d.join(e, "doc_id", "left").withColumn("embedding", vector)
    base, name = scratch_path(spark, "rejects"), f"index_{uuid.uuid4().hex}"
    create_index_table(spark, name, f"{base}/table")
    create_index_table(spark, name, f"{base}/table")
    load_articles(arts, f"{base}/table", rejects_path=f"{base}/rejects", id_col="doc_id", embedding_col="embedding")
    refresh_index_table(spark, name)
    stored = spark.table(name).select("id", "title", F.lit("stored").alias("table_name"))
    return stored.unionByName(read_index(spark, f"{base}/rejects").select(
        "id", "title", F.lit("rejected").alias("table_name")))


VOCAB_SQL = f"""
WITH w AS (SELECT doc_id, {S.words('text')} AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS token, unnest(range(len(ws))) AS i FROM w),
l AS (SELECT token, row_number() OVER (ORDER BY doc_id, i) - 1 AS n FROM x)
SELECT token, max(n) AS token_id FROM l GROUP BY token
"""


@register("vocab_scan", VOCAB_SQL)
def q_vocab_scan(spark, sf):
    """A vocabulary file of all words of the documents, with repeats: ids are line numbers,
    the last one counts (S10)."""
    from semsift.operators.encode import read_vocab
    from semsift.session import scratch_path
    d = X.table(spark, sf, "documents")
    words = d.select("doc_id", F.posexplode(T.split_words(F.col("text"))).alias("i", "value"))
    path = scratch_path(spark, "vocab")
    words.repartitionByRange(_text_files(d), "doc_id", "i").sortWithinPartitions("doc_id", "i").select("value").write.text(path)
    return read_vocab(spark, path)


# ---------------------------------------------------------------------------
# K5: IVF approximate join
# ---------------------------------------------------------------------------

IVF_CELLS, IVF_NPROBE = 8, 8


def cell_centroids(spark, sf) -> DataFrame:
    """Given centroids: the mean vector of every label, rounded like stored vectors."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    e = X.table(spark, sf, "embeddings")
    m = e.groupBy("label").agg(Summarizer.mean(array_to_vector("embedding")).alias("m"))
    return m.select(F.col("label").cast("long").alias("cell"),
                    V.quantize(vector_to_array("m", "float64")).cast("array<double>").alias("centroid"))


def _cells_sql(src: str, key: str, vec: str, n: int, name: str) -> str:
    """CTE ``{name}(key, cell)``: the ``n`` nearest label centroids of each row of ``src``."""
    return f"""
    {name}_d AS (SELECT x.{key}, c.cell, {S.cos_dist('c.centroid', f'x.{vec}')} AS d FROM {src} x CROSS JOIN cents c),
    {name} AS (SELECT {key}, cell FROM (SELECT *, row_number() OVER (PARTITION BY {key}
               ORDER BY round(d, 6), cell) AS rn FROM {name}_d) WHERE rn <= {n})"""


_CENTROIDS_SQL = f"""
    ce AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    cm AS (SELECT label, pos, avg(x) AS mu FROM ce GROUP BY label, pos),
    cents AS (SELECT label AS cell, {S.quantize('list(mu ORDER BY pos)')} AS centroid FROM cm GROUP BY label)"""

ANN_SQL = f"""
WITH e AS (SELECT vec_id AS id, embedding AS emb FROM embeddings), {_CENTROIDS_SQL},
    {_cells_sql('e', 'id', 'emb', 1, 'home')},
    {_cells_sql('e', 'id', 'emb', IVF_NPROBE, 'probe')},
    pairs AS (SELECT p.id AS query_id, h.id, {S.cos_dist('b.emb', 'a.emb')} AS distance
              FROM probe p JOIN home h ON h.cell = p.cell JOIN e a ON a.id = p.id JOIN e b ON b.id = h.id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 6), id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(distance, 6) AS distance FROM rk WHERE rank <= {KNN_K}
"""

HYBRID_IVF_SQL = f"""
WITH {_index_sql()}, {_CENTROIDS_SQL},
    qs AS (SELECT doc_id AS query_id, {X.query_text_sql('doc_id', 'text')} AS query,
                  {S.quantize('embedding')} AS qvec FROM j),
    {_cells_sql('ix', 'id', 'emb', 1, 'home')},
    {_cells_sql('qs', 'query_id', 'qvec', IVF_NPROBE, 'probe')},
    {_hybrid_tail_sql(SEARCH_K).replace('FROM qt CROSS JOIN ix),', 'FROM qt JOIN probe p ON p.query_id = qt.query_id '
                                        'JOIN home h ON h.cell = p.cell JOIN ix ON ix.id = h.id),')}
"""


@register("ann_ivf_full_probe", KNN_BATCH_SQL)
def q_ann_ivf_full_probe(spark, sf):
    """IVF join over trained cells probing every one: must equal the exact join."""
    from semsift.operators.ann import ann_join, build_ivf
    e = _emb(spark, sf)
    q = e.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    res = ann_join(q, build_ivf(e, IVF_CELLS), KNN_K, nprobe=IVF_CELLS)
    return r6(res.select("query_id", "rank", "id", "distance"), "distance")


@register("ann_ivf_recall", ANN_SQL)
def q_ann_ivf_recall(spark, sf):
    """IVF join over given centroids (label means) probing 8 cells a query, from a stored
    index to which the second half of the vectors was appended; recall is over 0.9."""
    from semsift.operators.ann import ann_join, append_ivf, build_ivf, read_ivf, write_ivf
    from semsift.session import scratch_path
    e = _emb(spark, sf)
    path = scratch_path(spark, "ivf")
    write_ivf(build_ivf(e.where("id % 2 = 0"), centroids=cell_centroids(spark, sf)), path)
    append_ivf(e.where("id % 2 = 1"), path, "second-half")
    q = e.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    res = ann_join(q, read_ivf(spark, path), KNN_K, nprobe=IVF_NPROBE)
    return r6(res.select("query_id", "rank", "id", "distance"), "distance")


@register("hybrid_search_ivf", HYBRID_IVF_SQL)
def q_hybrid_search_ivf(spark, sf):
    """Hybrid search whose candidates come from 8 cells of an IVF index, the approximate
    candidate stage of the original, with given centroids (label means)."""
    from semsift.operators.ann import build_ivf
    docs, ix = stored_vector_index(spark, sf)
    ivf = build_ivf(ix, centroids=cell_centroids(spark, sf))
    res = hybrid_search(fixture_queries(spark, sf, docs), ix, SEARCH_K, query_vec="query_vec", ivf=ivf,
                        nprobe=IVF_NPROBE)
    return r6(res, "score", "knn_score", "keyword_score", "title_score")


ZERO_SQL = f"""
WITH e AS (SELECT vec_id AS id, embedding, vec_id % 10 = 0 AS zero FROM embeddings),
pairs AS (SELECT a.vec_id AS query_id, e.id,
                 CASE WHEN NOT e.zero THEN {S.cos_dist('e.embedding', 'a.embedding')} END AS distance
          FROM embeddings a CROSS JOIN e WHERE a.vec_id % 5 <> 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 6) NULLS LAST, id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, coalesce(round(distance, 6), -1) AS distance FROM rk
"""


@register("knn_zero_vectors", ZERO_SQL)
def q_knn_zero_vectors(spark, sf):
    """All rows ranked for every query, every tenth of them a zero vector (no distance,
    last, by id) and every fifth query without a vector (K12: no rows)."""
    e = _emb(spark, sf)
    n = e.count()
    ix = e.select("id", F.when(F.col("id") % 10 == 0, F.transform("embedding", lambda x: x * F.lit(0).cast("float")))
                  .otherwise(F.col("embedding")).alias("embedding"))
    q = e.select(F.col("id").alias("query_id"),
                 F.when(F.col("id") % 5 != 0, F.col("embedding")).alias("query_vec"))
    out = r6(K.knn_join(q, ix, n).select("query_id", "rank", "id", "distance"), "distance")
    return out.withColumn("distance", F.coalesce("distance", F.lit(-1.0)))
