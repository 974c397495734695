"""C0-C12, P1, P2, P4 edge cases (expected values worked out by hand)."""
from pyspark.sql import functions as F

from semsift.functions import wikitext as W


def one(spark, fn, value):
    df = spark.createDataFrame([(value,)], "s string")
    return df.select(fn(F.col("s")).alias("r")).first()["r"]


def test_markup_steps(spark):
    assert one(spark, W.clean_wikitext, "a {{x {{y}} z}} b") == "a z}} b"   # nested: tail left
    assert one(spark, W.clean_wikitext, "a <!-- open") == "a <!-- open"    # unclosed comment kept
    assert one(spark, W.clean_wikitext, "x [[category:Foo]] y") == "x y"
    assert one(spark, W.clean_wikitext, "a == H\rx == b") == "a b"          # \r inside a heading
    assert one(spark, W.clean_wikitext, "[[Target|Label]] and [[Plain]]") == "Label and Plain"
    assert one(spark, W.clean_wikitext, "see [https://e.org/x Ext site] now") == "see Ext site now"
    assert one(spark, W.clean_wikitext, "r<ref name=a/>s<ref>src</ref>t") == "rst"
    assert one(spark, W.clean_wikitext, "[[File:a.png|thumb]]z") == "z"


def test_unicode_whitespace(spark):
    s = "a b c\u001cd\u0085e f"
    assert one(spark, W.clean_wikitext, s) == "a b c d e f"


def test_entities(spark):
    # one decoding pass: &amp;nbsp; -> &nbsp; (not decoded again)
    assert one(spark, W.clean_wikitext, "a&amp;nbsp;b") == "a&nbsp;b"
    # &nbsp; -> U+00A0, which the whitespace collapse turns into a space
    assert one(spark, W.clean_wikitext, "a&nbsp;b") == "a b"
    assert one(spark, W.html_unescape, "x &copy; &#233; &quot;") == 'x © é "'
    assert one(spark, W.html_unescape, "plain") == "plain"


def test_entities_like_the_standard_library(spark):
    import html
    texts = ["&amp", "&ampx;", "&notit;", "&notin;", "&am", "&", "&&amp;;", "&#0;&#x80;&#129;&#13;&#11;&#xfffe;&#55296;",
             "&#1114112;&#99999999999999999999;&#xfffffffffffff;&#x1F600;", "&#;&#x;&# ;", "&copy&reg;&COPY;",
             "&CounterClockwiseContourIntegral;&nosuchname;", "a & b &lt;c&gt;", "&#65&#x42;", "&sup1x&sup;", None, "",
             "&ThickSpace;&bne;", "&aMp;&\n&amp ;", "x" * 40 + "&" + "y" * 40 + ";", "&#0065;&#x0041", "&fjlig;&ngE;"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = {r["i"]: r["t"] for r in df.select("i", W.html_unescape(F.col("s")).alias("t")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else html.unescape(t)), t


def test_prepare_filters(spark):
    df = spark.createDataFrame(
        [(1, "  #Redirect [[x]]"), (2, "text #REDIRECT later"), (3, " \u00a0\n"), (4, None),
         (5, "Hello == H == World’s")], "id int, raw string")
    out = df.select("id", (W.has_text("raw") & ~W.is_prepare_redirect("raw")).alias("keep"),
                    W.normalize_article("raw").alias("t")).orderBy("id").collect()
    assert [r["keep"] for r in out] == [False, True, False, False, True]
    assert out[4]["t"] == "hello world's"
