"""K1-K4, K6: exact kNN strategies agree with brute force; edge cases."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from semsift.functions import vectors as V
from semsift.operators import knn as K


def brute(Q, M, ids, qids, k):
    out = []
    for qi, q in zip(qids, Q):
        sims = (M @ q) / (np.linalg.norm(M, axis=1) * np.linalg.norm(q))
        d = np.round(1 - np.clip(sims, -1, 1), 6)
        order = sorted(range(len(ids)), key=lambda j: (d[j], ids[j]))[:k]
        out += [(int(qi), r + 1, int(ids[j])) for r, j in enumerate(order)]
    return sorted(out)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    M = rng.normal(size=(60, 8)).astype(np.float32)
    M[5] = M[4]                     # exact duplicate -> tie broken by id
    M[7] = 2 * M[6]                 # scaled copy -> same distance as M[6]
    M[9] = -M[8]                    # negated copy
    Q = rng.normal(size=(7, 8)).astype(np.float32)
    ids = np.arange(100, 160)
    ix = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, M)],
                               "id long, embedding array<float>")
    q = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(Q)],
                              "query_id long, query_vec array<float>")
    return M.astype(np.float64), Q.astype(np.float64), ids, ix, q


@pytest.mark.parametrize("k", [1, 10, 100])
@pytest.mark.parametrize("strategy", ["broadcast", "blocked"])
def test_strategies_match_brute_force(spark, data, k, strategy):
    M, Q, ids, ix, q = data
    got = sorted(tuple(r) for r in K.knn_join(q, ix, k, strategy=strategy)
                 .select("query_id", "rank", "id").collect())
    assert got == brute(Q, M, ids, range(len(Q)), k)


def test_k_zero_and_partition_independence(spark, data):
    M, Q, ids, ix, q = data
    assert K.knn_join(q, ix, 0).count() == 0
    a = K.knn_join(q, ix.repartition(1), 5).select("query_id", "rank", "id").collect()
    b = K.knn_join(q, ix.repartition(7), 5).select("query_id", "rank", "id").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_wrong_dimension_rows_skipped(spark):
    ix = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, []), (4, None)],
                               "id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query_vec array<float>")
    assert [r["id"] for r in K.knn_join(q, ix, 10).collect()] == [1]


def test_overfetch():
    assert [K.overfetch_k(k) for k in (0, 1, 10, 3)] == [0, 1, 15, 4]


def test_native_distance_and_single(spark, data):
    M, Q, ids, ix, q = data
    qv = list(Q[0])
    single = K.knn_topk_single(qv, ix, 10).select("id").collect()
    assert [(0, r + 1, r_id["id"]) for r, r_id in enumerate(single)] == \
        [t for t in brute(Q[:1], M, ids, [0], 10)]
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert zero.select(V.cosine_distance("a", "b")).first()[0] is None
    s = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "d double").select(V.knn_score("d")).collect()
    assert [round(r[0], 6) for r in s] == [1.0, 0.5, round(1 / 3, 6)]


def test_queries_without_vector_get_no_rows(spark):
    ix = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [])], "query_id long, query_vec array<float>")
    got = K.knn_join(q, ix, 5).select("query_id", "id").collect()
    assert sorted(map(tuple, got)) == [(0, 1), (0, 2)]


@pytest.mark.parametrize("k", [3, 60])
def test_broadcast_takes_more_queries_than_it_sends_at_once(spark, data, monkeypatch, k):
    M, Q, ids, ix, q = data
    monkeypatch.setattr(K, "MAX_BROADCAST_QUERIES", 4)
    monkeypatch.setattr(K, "MAX_HELD", 100)
    got = sorted(tuple(r) for r in K.knn_join(q, ix, k, strategy="broadcast").select("query_id", "rank", "id").collect())
    assert got == brute(Q, M, ids, range(len(Q)), k)


@pytest.mark.parametrize("k", [1, 15, 700])
def test_top_rows_of_blocks_equal_brute_force(monkeypatch, k):
    monkeypatch.setattr(K, "TILE_QUERIES", 7)
    rng = np.random.default_rng(0)
    M = rng.normal(size=(600, 16))
    M[100:200], M[300:310] = M[0], 0
    Q, ids = np.vstack([M[:40], M[100:105] * 3]), rng.permutation(600)
    top = K.TopK(np.vstack([Q, np.zeros((2, 16))]), k)
    for at in range(0, 600, 70):
        top.add(ids[at:at + 70], M[at:at + 70])
    got = sorted(zip(top.rows.tolist(), top.ids.tolist()))
    with np.errstate(invalid="ignore"):
        sims = (Q @ M.T) / (np.linalg.norm(Q, axis=1)[:, None] * np.linalg.norm(M, axis=1))
    d = np.where(np.isnan(sims), np.inf, np.round(1 - np.clip(sims, -1, 1), 6))
    want = [(q, int(i)) for q in range(len(Q)) for i in ids[np.lexsort((ids, d[q]))[:k]]]
    want += [(q, i) for q in (len(Q), len(Q) + 1) for i in range(min(k, 600))]
    assert got == sorted(want)


def test_zero_vectors_query_ranks_every_row(spark):
    from semsift.plans.catalog import q_knn_zero_vectors
    from conftest import SF_SMALL
    out = q_knn_zero_vectors(spark, SF_SMALL)
    assert out.count() == 400 * 500 and out.where("distance = -1").count() == 400 * 50
