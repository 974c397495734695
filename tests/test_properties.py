"""Property checks over hypothesis-generated batches, one DataFrame each."""
import re

import numpy as np
from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st
from pyspark.sql import functions as F

from semsift import constants as C
from semsift.functions import text as T
from semsift.functions import vectors as V
from semsift.functions import wikitext as W

ALPHABET = list("abcAB sS\t\n.,'-[]{}|=<>!/:é€𝄞  ") + ["[[", "]]", "{{", "}}", "==", "<!--", "-->"]
texts = st.lists(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join), min_size=20, max_size=40)
SETTINGS = dict(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def spec_clean(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s if c not in C.ASCII_PUNCT)


def spec_tokens(clean):
    out = []
    for w in re.split(r"[ \t\n\x0b\f\r]+", clean):
        if not w:
            continue
        if len(w.encode()) > 3 and w.endswith("s"):
            w = w[:-1]
        if w not in C.STOP_WORDS:
            out.append(w)
    return out


@settings(**SETTINGS)
@given(texts)
def test_clean_and_tokens_match_spec(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, t string")
    rows = df.select("i", "t", T.clean_string("t").alias("c"),
                     T.keyword_tokens(T.clean_string("t")).alias("k"),
                     T.keyword_counts(T.clean_string("t")).alias("n")).collect()
    for r in rows:
        assert r["c"] == spec_clean(r["t"])
        assert spec_clean(r["c"]) == r["c"]                       # idempotent
        assert r["k"] == spec_tokens(r["c"])
        assert sum(x["freq"] for x in r["n"]) == len(r["k"])
        assert sorted(x["token"] for x in r["n"]) == sorted(set(r["k"]))


@settings(**SETTINGS)
@given(texts)
def test_markup_output_shape(spark, batch):
    df = spark.createDataFrame([(t,) for t in batch], "t string")
    for r in df.select(W.strip_markup("t").alias("o")).collect():
        o = r["o"]
        assert "[" not in o and "]" not in o
        assert not re.search(r"\s\s", o) and o == o.strip()


@settings(**SETTINGS)
@given(st.lists(st.lists(st.floats(-1e3, 1e3, allow_nan=False), min_size=4, max_size=4),
                min_size=5, max_size=20))
def test_normalize_unit_or_zero(spark, vecs):
    df = spark.createDataFrame([(v,) for v in vecs], "v array<double>")
    for r in df.select(V.l2_normalize("v").alias("n")).collect():
        n = np.linalg.norm(np.array(r["n"], dtype=np.float64))
        assert abs(n - 1) < 1e-5 or n == 0
