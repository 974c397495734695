"""The corpus pipeline's stages on their own input, and the registered queries."""
import corpus_pipeline
from tests.llm.helpers import planted, words
from tests.llm.test_documents import brute_links, rule_features


def test_stages(spark):
    from semsift.llm.common import stage
    sf = "/root/testdata/sf0.001"
    docs, kept = planted(spark), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "mixing", "packing"]
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(step(spark, docs, sf), f"test-{name}")
        if name == "packing":
            break
        assert docs.columns == columns
        after = kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before) and after
        if name == "quality_rules":
            want = set()
            for i, t in before.items():
                f = rule_features(t)
                if not (f[0] < 10 or 100 * f[4] > 20 * f[0]):
                    want.add(i)
            assert set(after) == want
        if name == "line_dedup":      # exact copies keep no line; a shared passage stays once
            assert not any(1000 <= i < 2000 for i in after
                           if before[i] == before.get(i - 1000) and len(words(before[i])) >= 50)
            assert sum("shared7 " in t for t in after.values()) == 1
        if name == "jaccard_join":
            links = brute_links(spark.createDataFrame(list(before.items()), "doc_id long, text string"))
            assert set(after) == {i for i, (_, top, _) in links.items() if i == top}
    pieces = docs.collect()
    assert {r["doc_id"] for r in pieces} == set(kept["mixing"])
    assert all(r["length"] <= 1024 for r in pieces)


def test_mixing_stage_meets_the_shares(spark, tmp_path):
    """With twice as much poor text as clean, poor text is thinned to its share."""
    import random
    rng = random.Random(3)
    poor = lambda i: i % 3 != 0
    rows = [(i, " ".join(rng.choice("bad" if poor(i) else "good") + str(rng.randint(0, 30)) for _ in range(40)))
            for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(i, int(not poor(i)), 0) for i in range(0, 3000, 2)], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    kept = [r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()]
    share = sum(map(poor, kept)) / len(kept)        # every text has 40 tokens
    assert abs(share - corpus_pipeline.WEIGHTS["poor"]) < 0.04
    assert len(kept) - sum(map(poor, kept)) >= 950   # of 1,000 clean ones


def test_queries_are_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names


def test_sql_oracles(spark):
    """The driver's comparison, on the smallest tables."""
    import duckdb
    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.001"
    sql = {k: v for k, v in entry.oracle_sql().items() if k.startswith("op")}
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    for name, text in sql.items():
        df = entry.queries()[name](spark, sf)
        cols = sorted(df.columns)
        rel = con.sql(text)
        assert sorted(rel.columns) == cols
        want = sorted(map(repr, con.sql(f"SELECT {', '.join(cols)} FROM ({text})").fetchall()))
        assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want, name
