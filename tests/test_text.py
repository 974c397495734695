"""Clean, tokens, plural strip, stop words, entity, counts (hand-worked)."""
from pyspark.sql import functions as F

from semsift import constants as C
from semsift.functions import text as T


def one(spark, col_fn, value, schema="s string"):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(col_fn(F.col("s")).alias("r")).first()["r"]


def test_clean_string_cases(spark):
    assert one(spark, T.clean_string, "state-of-the-art") == "stateoftheart"
    assert one(spark, T.clean_string, "What's") == "whats"
    assert one(spark, T.clean_string, "École") == "École"          # non-ASCII untouched
    assert one(spark, T.clean_string, "a\tB") == "a\tb"
    assert one(spark, T.clean_string, C.ASCII_PUNCT) == ""
    assert len(C.ASCII_PUNCT) == 32
    assert one(spark, T.clean_string, "") == ""
    assert one(spark, T.clean_string, None) == ""


def test_clean_string_idempotent(spark):
    s = "Hello, World! À-la-carte"
    once = one(spark, T.clean_string, s)
    assert one(spark, T.clean_string, once) == once


def test_keyword_tokens(spark):
    toks = one(spark, lambda c: T.keyword_tokens(T.clean_string(c)),
               "was class this définis és éés definitions word word")
    # was: 3 bytes, kept then stop word; class->clas; this->thi; définis (8 bytes)->défini;
    # és (3 bytes) kept; éés (5 bytes)->éé; definitions->definition (stop word)
    assert toks == ["clas", "thi", "défini", "és", "éé", "word", "word"]


def test_plural_regex_equals_wordwise_rule(spark):
    text = "class this és éés aas €s 𝄞s ss s   glass\tbus"
    a = one(spark, lambda c: T.raw_words(T.strip_plurals(c)), text)
    b = one(spark, lambda c: F.transform(T.split_words(c), T.strip_plural), text)
    assert a == b


def test_token_set_and_counts(spark):
    ts = one(spark, lambda c: T.token_set(T.clean_string(c)), "b a b the c a")
    assert ts == ["b", "c"]                       # a, the are stop words
    counts = one(spark, lambda c: T.keyword_counts(T.clean_string(c)), "b x b y b x")
    assert [(r["token"], r["freq"]) for r in counts] == [("b", 3), ("x", 2), ("y", 1)]


def test_stop_words_after_plural_strip(spark):
    # what's -> whats -> what (stop word)
    assert one(spark, lambda c: T.keyword_tokens(T.clean_string(c)), "What's up") == ["up"]


def test_token_stats_clamp_and_empty(spark):
    big = " ".join(["zz"] * 40000)
    st = one(spark, T.token_stats, big)
    assert len(st) == 1 and st[0]["freq"] == 32767
    assert one(spark, T.token_stats, "") == []
    assert one(spark, T.token_stats, "the a of") == []


def test_entity(spark):
    assert one(spark, T.extract_entity, "What is a neural network?") == "neural network"
    assert one(spark, T.extract_entity, "defined terms") == "d term"
    assert one(spark, T.extract_entity, " what is x") == "what is x"
    assert one(spark, T.extract_entity, "define") == ""
    assert one(spark, T.extract_entity, "") == ""
    assert one(spark, T.extract_entity, "Explain the networks") == "network"


def test_row_wise_counts_equal_exploded_groupby(spark):
    from conftest import SF_SMALL
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    row = d.select("doc_id", F.explode(T.keyword_counts(T.clean_string("text"))).alias("c")) \
        .select("doc_id", "c.token", "c.freq")
    exp = d.select("doc_id", F.explode(T.keyword_tokens(T.clean_string("text"))).alias("token")) \
        .groupBy("doc_id", "token").agg(F.count(F.lit(1)).cast("int").alias("freq"))
    assert sorted(map(tuple, row.collect())) == sorted(map(tuple, exp.collect()))
