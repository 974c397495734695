"""Disk and work of the large paths: nothing wide is copied for a pair, passes are bounded."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from semsift import session
from semsift.operators import knn as K
from semsift.operators import pruned as P
from semsift.operators import search as S
from semsift.plans import catalog as CT

from conftest import SF_SMALL


def nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def vectors(spark, n, seed, key="id", vec="embedding", dim=12):
    rows = np.random.default_rng(seed).normal(size=(n, dim)).round(3)
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], f"{key} long, {vec} array<float>")


def test_token_statistics_are_not_copied_for_each_candidate(spark, monkeypatch):
    """Finding F2: the documents' token statistics meet the candidates by id and go no further."""
    monkeypatch.setattr(S, "MAX_LOCAL_CANDIDATES", 0)
    monkeypatch.setattr(S, "MAX_PUSHED_IDS", 0)
    monkeypatch.setattr(S, "MAX_WIDE_CANDIDATES", 0)
    monkeypatch.setattr(S, "MAX_BROADCAST_CANDIDATES", 0)
    seen, keep = {}, S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, name: seen.setdefault(name, df) and keep(df, name))
    ix = CT.vector_index(spark, SF_SMALL)
    q = CT.fixture_queries(spark, SF_SMALL)
    ref = sorted(map(tuple, S.hybrid_search(q, ix, 3, query_vec="query_vec").select("query_id", "rank", "id", "score").collect()))
    assert len(ref) == 3 * q.count()
    plan = seen["ranked"]._jdf.queryExecution().optimizedPlan()
    joins = [n for n in nodes(plan) if n.nodeName() == "Join" and "query_id" in n.condition().toString()]
    assert joins and not any("token_stats" in n.output().toString() for n in joins)


def test_written_tables_leave_no_shuffle_files_and_can_be_released(spark):
    table = session.materialize(spark.range(1000).repartition(5, "id"), "t")
    path = table._staged_path
    assert table.count() == 1000 and os.path.isdir(path)
    session.release(table)
    assert not os.path.exists(path)


@pytest.mark.parametrize("growth", [None, 2])
def test_passes_are_bounded_and_equal_the_broadcast_join(spark, monkeypatch, growth):
    """Findings F5, F6, F7: what a pass shuffles is a multiple of both sides, not their product."""
    monkeypatch.setattr(P, "TARGET_ROWS", 25)
    monkeypatch.setattr(P, "TARGET_QUERIES", 20)
    monkeypatch.setattr(P, "PASS_SIDES", 2)
    costs, passes = [], P._passes

    def spy(asked, cells, chunks, n):
        out = passes(asked, cells, chunks, n)
        size = {c: cells.size[chunks.cells[c]].sum() / chunks.salts[c] for c in asked}
        costs.append([sum(asked[c] + size[c] * q_salts for c, _, q_salts in pieces) / (n + cells.size.sum()) for pieces in out])
        return out

    monkeypatch.setattr(P, "_passes", spy)
    ix, q = vectors(spark, 300, 1), vectors(spark, 250, 2, "query_id", "query_vec")
    got, _ = P.pruned_knn_join(q, P.deal(ix, 30, top=5), 5, growth=growth)
    want = K.knn_join(q, ix, 5, strategy="broadcast")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in df.collect())
    assert rows(got) == rows(want)
    assert max(map(len, costs)) > 1 and max(map(max, costs)) < 2 + 1


def test_one_cell_of_all_rows_is_taken_in_passes_too(spark, monkeypatch):
    monkeypatch.setattr(P, "TARGET_ROWS", 20)
    monkeypatch.setattr(P, "TARGET_QUERIES", 20)
    monkeypatch.setattr(P, "PASS_SIDES", 2)
    ix, q = vectors(spark, 160, 3), vectors(spark, 160, 4, "query_id", "query_vec")
    cells = P.deal(ix, 1)
    chunks = P._packed(cells)
    assert len(P._passes({0: 160}, cells, chunks, 160)) > 1
    rows = lambda df: sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())
    assert rows(P.pruned_knn_join(q, cells, 4, growth=None)[0]) == rows(K.knn_join(q, ix, 4, strategy="broadcast"))


def test_supplied_vectors_stay_and_texts_are_shuffled_once(spark, tmp_path):
    from semsift.plans import fixtures as X
    spark.createDataFrame([(1, "a b"), (2, "c"), (2, "c"), (3, None), (None, "d")], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (2, [1.0]), (2, [2.0])], "vec_id long, embedding array<float>").write.parquet(
        f"{tmp_path}/embeddings.parquet")
    j = X.joined_docs(spark, str(tmp_path))
    got = sorted((r["doc_id"] or 0, r["text"] or "", len(r["embedding"] or [])) for r in j.collect())
    assert got == [(0, "d", 64), (1, "a b", 0)] + [(2, "c", 1)] * 4 + [(3, "", 64)]
    scans = [n for n in nodes(j._jdf.queryExecution().optimizedPlan()) if "Relation" in n.nodeName()]
    assert len(scans) == 2


def test_a_micro_batch_is_worked_on_by_all_slots_and_an_empty_one_writes_nothing(spark, tmp_path, monkeypatch):
    """Findings F1, F8, F9: few files of a trigger do not mean few tasks, and no job is started for no rows."""
    from semsift.operators.embed import HashingEncoder
    from semsift.plans import ingest as I
    table, slots = f"{tmp_path}/t", spark.sparkContext.defaultParallelism
    spark.range(40).selectExpr("concat('t', id) AS title", "concat('a b ', id) AS text").coalesce(1).write.json(f"{tmp_path}/in")
    raw = spark.read.schema("title string, text string").json(f"{tmp_path}/in")
    parts, write = [], I.write_load
    monkeypatch.setattr(I, "write_load", lambda rows, *a, **k: (parts.append(rows.rdd.getNumPartitions()), write(rows, *a, **k)))
    I.load_articles(raw, table, load_id="full", encoder=HashingEncoder(8))
    assert parts == [slots]
    assert sorted(r["id"] for r in I.read_index(spark, table).collect()) == list(range(40))
    I.load_articles(raw.where("title IS NULL"), table, load_id="empty", encoder=HashingEncoder(8), rejects_path=f"{tmp_path}/rejects")
    assert len(parts) == 1 and I.read_index(spark, table).count() == 40 and I.read_index(spark, table, "empty").count() == 0
    assert I.read_index(spark, f"{tmp_path}/rejects").count() == 0


def test_the_code_of_a_micro_batch_does_not_hold_its_first_key(spark, tmp_path):
    from semsift.plans import commits
    spark.range(30).selectExpr("id AS v").coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = spark.read.parquet(f"{tmp_path}/in")
    plans = [commits.with_dense_keys(rows, f"{tmp_path}/t", load) for load in ("a", "b")]
    assert [sorted(r["_key"] for r in p.collect()) for p in plans] == [list(range(30)), list(range(30, 60))]
    code = [p._jdf.queryExecution().debug().codegenToSeq().apply(0)._2() for p in plans]
    assert code[0] == code[1]


@pytest.mark.parametrize("k", [3, 70, 500])
def test_all_pairs_are_ranked_without_a_shuffle_of_pairs(spark, monkeypatch, k):
    """Finding F4: a query is ranked whole in one task; zero vectors, ties and repeated ids as before."""
    rng = np.random.default_rng(8)
    rows = [list(map(float, r)) for r in rng.integers(-2, 3, size=(90, 3))] + [[0.0] * 3] * 4 + [None, [1.0, 2.0]]
    ix = spark.createDataFrame(list(enumerate(rows)), "id long, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(i % 40, r) for i, r in enumerate(rows)], "query_id long, query_vec array<float>").repartition(2)
    got = lambda df: sorted((r["query_id"], r["rank"], r["id"], -1 if r["distance"] is None else round(r["distance"], 9))
                            for r in df.collect())
    want = got(K.knn_join(q, ix, k, strategy="broadcast"))
    monkeypatch.setattr(K, "MAX_HELD", 1)
    whole = K.knn_join(q, ix, k, strategy="broadcast")
    assert got(whole) == want
    plan = whole._jdf.queryExecution().optimizedPlan()
    assert not any(n.nodeName() == "Window" for n in nodes(plan))
    monkeypatch.setattr(K, "MAX_BROADCAST_BYTES", 8)
    assert got(K.knn_join(q, ix, k, strategy="broadcast", max_broadcast_bytes=8 * 3 * 20)) == want      # an index too large to send


def test_cells_are_taken_in_passes(spark, monkeypatch):
    """Finding F3: an approximate join in several bounded passes finds what one pass finds."""
    from semsift.operators import ann as A
    ix, q = vectors(spark, 200, 6), vectors(spark, 180, 7, "query_id", "query_vec")
    ivf = A.build_ivf(ix, 5)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())
    one = rows(A.ann_join(q, ivf, 4, 3))
    pieces, join = [], A._in_cells
    monkeypatch.setattr(A, "_in_cells", lambda *a: pieces.append(a[3]) or join(*a))
    monkeypatch.setattr(A, "PASS_SIDES", 0.5)
    assert rows(A.ann_join(q, ivf, 4, 3, target_cell_rows=15, target_cell_queries=20)) == one and len(pieces) > 1
    assert rows(A.ann_join(q.limit(0), ivf, 4, 3)) == []


def test_postings_are_shuffled_once(spark, monkeypatch, tmp_path):
    """Finding F5: of hashes only those with several lists are joined, and postings go once to their buckets."""
    from semsift.operators import keyword as W
    monkeypatch.setattr(W, "LIST_DOCUMENTS", 3)
    rows = [(i, [(7, 1), (100 + i, 2)]) for i in range(20)]
    ix = spark.createDataFrame(rows, "id long, token_stats array<struct<hash:bigint,freq:smallint>>").repartition(2)
    moved, insert = [], type(spark).sql
    def spy(self, text, *a, **k):
        if text.startswith("INSERT") and "/lists" not in text and "list_key" in k["rows"].columns:
            moved.append(sum("RepartitionByExpression" == n.nodeName() or n.nodeName() == "Repartition"
                             for n in nodes(k["rows"]._jdf.queryExecution().optimizedPlan())))
        return insert(self, text, *a, **k)
    monkeypatch.setattr(type(spark), "sql", spy)
    for _ in range(2):                          # again: replaces
        W.append_postings(ix, f"{tmp_path}/p", "load", 0, buckets=4)
    assert moved and max(moved) == 1 + 1        # to the buckets, and the two parts of the test's own index
    lists, terms = W.posting_tables(spark, f"{tmp_path}/p", 4)
    got = sorted((r["hash"], i, f) for r in lists.collect() for i, f in zip(r["ids"], r["freqs"]))
    assert got == sorted((h, i, f) for i, stats in rows for h, f in stats)
    assert lists.where("hash = 7").count() > 1 and {r["hash"]: r["df"] for r in terms.collect()}[7] == 20
