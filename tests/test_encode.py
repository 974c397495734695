"""Vocabulary encoding edge cases."""
from semsift.operators.encode import encode_tokens, read_vocab


def test_encode_cases(spark, tmp_path):
    vocab_file = tmp_path / "vocab.txt"
    vocab_file.write_text("[PAD]\n[UNK]\n[CLS]\n[SEP]\nhello\nworld\nhello\n")
    vocab = read_vocab(spark, str(vocab_file))
    ids = {r["token"]: r["token_id"] for r in vocab.collect()}
    assert ids["hello"] == 6                 # later duplicate wins
    docs = spark.createDataFrame(
        [(1, ""), (2, " ".join(["hello"] * 126)), (3, " ".join(["world"] * 127)),
         (4, "hello nope [PAD] Hello")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in encode_tokens(docs, "text", vocab, 128).collect()}
    assert out[1]["input_ids"] == [2, 3] + [0] * 126
    assert out[2]["input_ids"] == [2] + [6] * 126 + [3]
    assert out[3]["input_ids"] == [2] + [5] * 126 + [3]      # word 127 dropped
    assert out[4]["input_ids"][:6] == [2, 6, 1, 0, 1, 3]     # unknown, literal [PAD], case-sensitive
    assert out[4]["attention_mask"][:6] == [1, 1, 1, 0, 1, 1]
    assert all(len(r["input_ids"]) == 128 and r["token_type_ids"] == [0] * 128 for r in out.values())


def test_words_hash_alike_in_tasks_and_expressions(spark):
    from semsift.operators import embed as E
    texts = spark.createDataFrame([("a b a  héé\t語 x",), ("",), (None,), ("[SEP] zz " * 40,)], "t string")
    for dim in (8, 64):
        enc = E.HashingEncoder(dim)
        for r in texts.select(enc.embed("t").alias("v"), enc._pool(enc.token_dims("t")).alias("w")).collect():
            assert r["v"] == r["w"]
    plan = texts.select(E.HashingEncoder(8).embed("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan
