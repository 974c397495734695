"""E6, E7, A5 and the default encoder."""
import numpy as np
from pyspark.sql import functions as F

from semsift.functions import vectors as V
from semsift.operators.embed import HashingEncoder, OnnxEncoder, pool_token_vectors


def test_normalize_and_quantize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), ([1 / 128, -1 / 128],)],
                               "v array<double>")
    out = df.select(V.l2_normalize("v").alias("n"), V.quantize("v").alias("q")).collect()
    assert [round(x, 6) for x in out[0]["n"]] == [0.6, 0.8]
    assert out[1]["n"] == [0.0, 0.0]                    # zero vector unchanged
    assert out[2]["n"] == []
    # 1/128 = 0.0078125: half-even at 6 places -> 0.007812
    assert [round(x, 7) for x in out[3]["q"]] == [0.007812, -0.007812]


def test_scaled_and_negated_copies(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0], [-1.0, -2.0])],
                               "a array<double>, b array<double>, c array<double>")
    r = df.select(V.cosine_distance("a", "b").alias("ab"), V.cosine_distance("a", "c").alias("ac")).first()
    assert abs(r["ab"]) < 1e-12 and abs(r["ac"] - 2.0) < 1e-12


def test_hashing_encoder_unit_and_deterministic(spark):
    df = spark.createDataFrame([("alpha beta beta",), ("",), ("alpha beta beta",)], "t string")
    enc = HashingEncoder(16)
    v = [r[0] for r in df.select(enc.embed(F.col("t"))).collect()]
    assert abs(np.linalg.norm(v[0]) - 1) < 1e-6 and v[0] == v[2]
    assert abs(np.linalg.norm(v[1]) - 1) < 1e-6        # CLS + SEP only, still a vector


def test_hashing_encoder_reads_whole_texts(spark):
    words = " ".join(f"w{i}" for i in range(5000))
    df = spark.createDataFrame([(words,), (words + " extra" * 900,)], "t string")
    v = [r[0] for r in df.select(HashingEncoder(32).embed(F.col("t"))).collect()]
    assert v[0] != v[1]


def test_model_hook_pooling(spark):
    # a fake "model": token vector = one-hot of (id mod 4), so pooling is checkable
    def runner(ids, mask, types):
        return np.eye(4, dtype=np.float32)[ids % 4]
    df = spark.createDataFrame([([5, 6, 6, 0, 0],), ([0, 0, 0, 0, 0],)], "ids array<long>")
    df = df.withColumn("m", F.transform("ids", lambda x: (x != 0).cast("long"))) \
           .withColumn("t", F.transform("ids", lambda x: F.lit(0).cast("long")))
    enc = OnnxEncoder(pad_id=0, runner=runner)
    out = [r[0] for r in df.select(enc.embed_ids("ids", "m", "t")).collect()]
    exp = pool_token_vectors(np.eye(4)[np.array([[5, 6, 6, 0, 0]]) % 4], np.array([[5, 6, 6, 0, 0]]), 0)[0]
    assert np.allclose(out[0], exp) and abs(np.linalg.norm(out[0]) - 1) < 1e-6
    assert np.allclose(out[1], [0, 0, 0, 0])            # all padding -> zero vector


def test_model_encoder_text_interface(spark, tmp_path):
    from semsift.operators.encode import encode_tokens, read_vocab
    vocab = tmp_path / "vocab.txt"
    vocab.write_text("[PAD]\n[UNK]\n[CLS]\n[SEP]\nalpha\nbeta\n")

    def runner(ids, mask, types):
        return np.eye(6, dtype=np.float32)[ids]
    enc = OnnxEncoder(pad_id=0, runner=runner, vocab_path=str(vocab), max_len=8)
    df = spark.createDataFrame([(1, "alpha beta gamma"), (2, "")], "doc_id long, t string")
    via_text = {r[0]: r[1] for r in df.select("doc_id", enc.embed(F.col("t"))).collect()}
    ids = encode_tokens(df, "t", read_vocab(spark, str(vocab)), 8)
    via_ids = {r[0]: r[1] for r in ids.select("doc_id", enc.embed_ids("input_ids", "attention_mask",
                                                                      "token_type_ids")).collect()}
    for k in (1, 2):
        assert np.allclose(via_text[k], via_ids[k])
    # CLS, alpha, beta, UNK(gamma), SEP -> mean of one-hots 2,4,5,1,3, normalised
    exp = np.zeros(6)
    exp[[2, 4, 5, 1, 3]] = 1
    assert np.allclose(via_text[1], exp / np.linalg.norm(exp), atol=1e-6)


def test_real_onnx_runtime_path(spark, tmp_path):
    import onnxruntime  # noqa: F401  (installed in this environment)
    from onnx_tiny import tiny_gather_model
    rng = np.random.default_rng(1)
    W = rng.normal(size=(6, 5)).astype(np.float32)
    model = tmp_path / "tiny.onnx"
    model.write_bytes(tiny_gather_model(W))
    vocab = tmp_path / "vocab.txt"
    vocab.write_text("[PAD]\n[UNK]\n[CLS]\n[SEP]\nalpha\nbeta\n")
    enc = OnnxEncoder(model_path=str(model), pad_id=0, vocab_path=str(vocab), max_len=8)
    df = spark.createDataFrame([("alpha beta gamma",), ("",)], "t string")
    got = [r[0] for r in df.select(enc.embed(F.col("t"))).collect()]
    ids = [[2, 4, 5, 1, 3], [2, 3]]
    for g, i in zip(got, ids):
        m = W[i].astype(np.float64).mean(axis=0)
        assert np.allclose(g, m / np.linalg.norm(m), atol=1e-6)
