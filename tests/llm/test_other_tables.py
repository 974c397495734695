"""Chat formatting, URL lists, mixing and components."""
import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.helpers import documents


def _path():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _digests(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1] if t[0] else 0, t[2], t[3]))
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(),
                     len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("section_chars", [1 << 20, 200])
def test_chat_round_trip(spark, section_chars):
    """Digests read back from the output are those of the input, in one section or many."""
    from semsift.llm.chat_format import format_conversations, read_back
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    bad = r"\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", bad), (-7, 1, "assistant", bad), (-8, 0, "assistant", "\n\n lead"), (-8, 1, "assistant", None),
             (-8, 1, None, "x"), (-8, None, "odd\nrole ### \\n", "\\\\</turn>\n### user\n"), (-8, 2, "assistant", "end <"),
             (-8, 2, "assistant", "end <"), (-9, 3, "assistant", "é日本😀 " * 300), (None, 0, "assistant", " "),
             (-10, 0, "user", ""), (-10, 0, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sections = format_conversations(turns, _path(), section_chars=section_chars)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
           for r in read_back(sections).collect()}
    assert got == _digests(rows)
    assert (sections.where("section > 0").count() > 0) == (section_chars == 200)


def test_chat_masks_tokens(spark):
    from semsift.llm.chat_format import format_conversations
    turns = spark.createDataFrame([(1, 0, "user", "question"), (1, 1, "assistant", "the answer")],
                                  "conv_id long, turn long, role string, text string")
    r = format_conversations(turns, _path()).first()
    shown = [r["formatted"][a:b] for a, b, m in zip(r["starts"], r["ends"], r["loss"]) if m]
    assert "".join(shown) == "the answer" and len(r["ids"]) == len(r["loss"])


def test_chat_empty(spark):
    from semsift.llm.chat_format import format_conversations, read_back
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, section long")
    assert read_back(format_conversations(none, _path())).collect() == []


def test_intervals_and_captures(spark):
    from pyspark.sql import functions as F
    from semsift.llm.url_filter import judge_captures, validity_intervals
    log = spark.createDataFrame(
        [("l", "bad.example", "2024-01-10", "add"), ("l", "bad.example", "2024-02-10", "remove"),
         ("l", "bad.example", "2024-02-01", "add"), ("l", "bad.example", "2024-09-01", "add"),
         ("m", "Sub.BAD.example", "2024-01-20", "add"), ("l", "day.example", "2024-03-01", "add"),
         ("l", "day.example", "2024-03-01", "remove"), ("l", None, "2024-01-01", "add"), ("l", "x", None, "add"),
         ("l", "com", "2020-01-01", "add"), ("l", "com", "2020-06-01", None)],
        "list string, entry string, day string, action string").withColumn("day", F.col("day").cast("date"))
    spans = sorted((r["entry"], str(r["from_day"]), str(r["to_day"])) for r in validity_intervals(log).collect())
    assert spans == [("bad.example", "2024-01-10", "2024-02-01"), ("bad.example", "2024-02-01", "2024-02-10"),
                     ("bad.example", "2024-09-01", "None"), ("com", "2020-01-01", "2020-06-01"),
                     ("sub.bad.example", "2024-01-20", "None")]
    captures = spark.createDataFrame(
        [(1, "http://bad.example/a", "2024-01-09"), (2, "http://bad.example/a", "2024-01-10"),
         (3, "HTTPS://u:p@WWW.Bad.Example.:8080/x?y", "2024-02-09"), (4, "http://bad.example", "2024-02-10"),
         (5, "http://a.sub.bad.example", "2024-12-01"), (6, "http://day.example", "2024-03-01"),
         (7, "not a url", "2024-02-02"), (8, None, "2024-02-02"), (9, "http://bad.example", None),
         (2, "http://bad.example/a", "2024-01-10"), (10, "http://notbad.example", "2024-02-02")],
        "page_id long, url string, day string").withColumn("entry", F.lit("clash")).withColumn("list", F.lit("clash"))
    got = sorted((r["page_id"], ",".join(r["_u_matches"] or [])) for r in judge_captures(captures, log).collect())
    assert got == [(1, ""), (2, "l:bad.example"), (2, "l:bad.example"), (3, "l:bad.example"), (4, ""),
                   (5, "l:bad.example,m:sub.bad.example"), (6, ""), (7, ""), (8, ""), (9, ""), (10, "")]
    assert judge_captures(captures.limit(0), log).collect() == []
    assert all(r["_u_matches"] is None for r in judge_captures(captures, log.limit(0)).collect())


def test_mixing_rates(spark):
    """The fitted rates are those of projected gradient descent in one place, and meet the targets."""
    from semsift.llm.mixing import fit_rates
    rng = np.random.default_rng(3)
    n, p = rng.integers(0, 500, 300), rng.dirichlet([0.4, 0.3, 0.3], 300)
    docs = spark.createDataFrame([(i, int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(n, p))],
                                 "i int, tokens long, posterior array<double>")
    goal = n.sum() * np.array([0.7, 0.25, 0.05])
    got = {r["i"]: r["rate"] for r in fit_rates(docs, goal.tolist()).collect()}
    rate, inverse = np.ones(300), np.linalg.inv((p * n[:, None]).T @ p)
    for _ in range(60):
        residual = (rate * n) @ p - goal
        if np.abs(residual).sum() <= 1e-4 * goal.sum():
            break
        rate = np.maximum(0, rate - p @ (inverse @ residual))
    assert np.allclose([got[i] for i in range(300)], rate, atol=1e-4)
    assert np.abs((rate * n) @ p - goal).sum() <= 1e-3 * goal.sum() and rate.min() == 0
    capped = fit_rates(docs, goal.tolist(), max_rate=1.0)
    assert capped.selectExpr("max(rate)").first()[0] <= 1.0


def test_classifier_on_held_out_labels(spark):
    from pyspark.sql import functions as F
    from semsift.llm.mixing import label_domains, mix
    sf = "/root/testdata/sf0.1"
    labels = label_domains(spark.read.parquet(f"{sf}/labels.parquet"))
    docs = documents(spark, sf).join(labels.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    out = mix(docs, labels.where("id % 3 < 2"), {"clean": 0.9, "poor": 0.1, "toxic": 0.0}, carry=["doc_id"])
    toxic = F.get("_m_posterior", F.lit(2)) > 0.5
    seen = out.join(labels.withColumnRenamed("id", "doc_id"), "doc_id").where("doc_id % 3 = 2") \
        .groupBy((F.col("domain") == "toxic").alias("is")).agg(
            F.avg(toxic.cast("double")).alias("said"), F.avg("_m_rate").alias("rate")).collect()
    by = {r["is"]: r for r in seen}
    assert by[True]["said"] > 0.8 and by[False]["said"] < 0.02 and by[True]["rate"] < 0.5 * by[False]["rate"]


def test_components(spark):
    from semsift.llm.components import connected_components
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    top = {}

    def find(a):
        top.setdefault(a, a)
        while top[a] != a:
            a = top[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: find(a) for a in top}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
