"""Removal of repeated line runs by a suffix array over line ids (operator 8).

A document is the sequence of its lines that hold a word. Lines found once end every
match, so only lines found again, in unbroken segments, take part. Their suffixes are
sorted by distributed prefix doubling: after step ``k`` a suffix has a name that orders
and identifies its first ``2^k`` lines, and step ``k + 1`` names the pairs of a suffix's
name and that of the suffix ``2^k`` lines on. Doubling ends when a step splits no name:
then the names order the whole suffixes, the suffix array.

Suffixes that agree on their first ``l`` lines are an interval of that array, the
longest-common-prefix interval of depth ``l``. Two overlapping names of ``2^k <= l``
lines identify it. For every line, the shortest runs of ``min_words`` words that start
or end there are looked up; every longer repeated run is a union of such. The first
member of an interval in document order stays, the other runs are deleted, and touching
deleted runs merge to the maximal repeated ones.

Lines are equal if all their characters are (two 64-bit hashes stand for them). Document
order is by id (nulls last), then by position in the staged table, so repeated rows are
documents of their own. A null or empty text has no lines. Blank lines inside a deleted
run go with it, others stay. An empty table gives an empty result. Joins on a line or
name that a third of all rows share are plain equi-joins, which adaptive execution splits;
counts are aggregated before they are shuffled. Windows are over one document's lines.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semsift.llm.common import SPACES, WORD, pick, release, stage, text_or_empty

MIN_WORDS = 50


def document_lines(docs: DataFrame) -> DataFrame:
    """``(row, id, i, p, h1, h2, words)`` of each line with a word in ``docs`` (``row, id,
    text``): ``i`` counts such lines, ``p`` all lines of the text."""
    lines = F.filter(F.transform(F.split(text_or_empty("text"), "\n"), lambda s, p: F.struct(
        s.alias("s"), p.alias("p"))), lambda x: x["s"].rlike(WORD))
    out = docs.select("row", "id", F.posexplode(lines).alias("i", "x"))
    line = F.col("x.s")
    words = F.size(F.split(F.regexp_replace(line, f"^{SPACES}|{SPACES}$", ""), SPACES))
    return out.select("row", "id", "i", F.col("x.p").alias("p"), F.xxhash64(line).alias("h1"),
                      F.xxhash64(F.lit("line"), line).alias("h2"), words.cast("long").alias("words"))


def _named(pairs: DataFrame, a: str, b: str, name: str, at_least: int = 1) -> DataFrame:
    """A name for each distinct ``(a, b)`` found ``at_least`` times; names sort as the pairs do."""
    keys = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least)
    # a total sort numbers its rows upwards, partition by partition
    return stage(keys.select(a, b).orderBy(a, b).withColumn(name, F.monotonically_increasing_id()),
                 "line-names")


def suffix_names(lines: DataFrame) -> tuple[DataFrame, int]:
    """``(repeated, last)``: the repeated lines with ``seg`` and ``n0 .. n<last>``, where
    ``n<k>`` names the suffix's first ``2^k`` lines within its segment."""
    first = _named(lines, "h1", "h2", "n0", at_least=2)
    in_doc = Window.partitionBy("row").orderBy("i")
    rows = lines.join(first, ["h1", "h2"]).drop("h1", "h2") \
        .withColumn("seg", F.col("i") - F.row_number().over(in_doc))
    rows = stage(rows, "line-suffixes")
    names, k = first.count(), 0
    release(first)
    in_seg = Window.partitionBy("row", "seg").orderBy("i")
    while True:
        pairs = rows.withColumn("_b", F.coalesce(F.lead(f"n{k}", 1 << k).over(in_seg), F.lit(-1).cast("long")))
        step = _named(pairs, f"n{k}", "_b", f"n{k + 1}")
        found = step.count()
        if found == names:
            release(step)
            return rows, k
        longer = stage(pairs.join(step, [f"n{k}", "_b"]).drop("_b"), "line-suffixes")
        release(rows, step)
        rows, names, k = longer, found, k + 1


def repeated_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(row, runs)``: for each document with repeats, its merged later copies of runs of
    ``min_words`` or more as ``[first line, last line]`` positions in the text."""
    whole, last = suffix_names(lines)
    rows = whole
    seg = Window.partitionBy("row", "seg")
    rows = rows.withColumn("upto", F.sum("words").over(seg.orderBy("i"))) \
        .withColumn("before", F.col("upto") - F.col("words"))
    ends = seg.orderBy("before").rangeBetween(min_words, Window.unboundedFollowing)
    begins = seg.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words)
    low, high, total = F.min("i").over(seg), F.max("i").over(seg), F.max("upto").over(seg)
    rows = rows.withColumns({
        "stop": F.coalesce(F.min("i").over(ends), F.when(total - F.col("before") >= min_words, high + 1)),
        "start": F.coalesce(F.max("i").over(begins) + 1, F.when(F.col("upto") >= min_words, low)),
        "names": F.array(*[F.col(f"n{k}") for k in range(last + 1)])})
    rows = stage(rows.select("row", "id", "seg", "i", "p", "start", "stop", "names"), "line-runs")
    release(whole)
    ahead = rows.where("stop is not null").select("row", "id", F.col("i").alias("s"), F.col("stop").alias("e"))
    back = rows.where("start is not null").select("row", "id", F.col("start").alias("s"),
                                                  (F.col("i") + 1).alias("e"))
    size = F.col("e") - F.col("s")
    level = F.least(F.floor(F.log2(size.cast("double"))).cast("int"), F.lit(last))
    span = reduce(lambda value, k: F.when(F.col("k") == k, 1 << k).otherwise(value), range(last + 1), F.lit(1))
    runs = ahead.union(back).distinct().withColumn("k", level).withColumn("mid", F.col("e") - span)
    at = lambda col, name, pos: rows.select(
        F.col("row"), F.col("i").alias(col), F.col("names").alias(name), F.col("p").alias(pos))
    runs = runs.join(at("s", "names_s", "p_s"), ["row", "s"]).join(at("mid", "names_m", "p_m"), ["row", "mid"]) \
        .select("row", "id", "s", "e", "p_s", size.alias("size"),
                F.get("names_s", F.col("k")).alias("a"), F.get("names_m", F.col("k")).alias("b"))
    runs = stage(runs, "line-windows")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "s")
    firsts = runs.groupBy("size", "a", "b").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")) \
        .where("n > 1").drop("n")
    # written, so that the join below has exchanges of its own on both sides and a run that
    # many documents hold can be split
    firsts = stage(firsts, "line-firsts")
    later = runs.join(firsts, ["size", "a", "b"]) \
        .where((F.col("row") != F.col("first.row")) | (F.col("s") != F.col("first.s")))
    stop = rows.select("row", (F.col("i") + 1).alias("e"), F.col("p").alias("p_e"))
    found = later.select("row", "e", "p_s").join(stop, ["row", "e"]) \
        .groupBy("row").agg(F.sort_array(F.collect_set(F.struct("p_s", "p_e"))).alias("all"))

    def merge(done, run):
        tail = F.get(done, F.size(done) - 1)
        touching = (F.size(done) > 0) & (run["p_s"] <= tail["p_e"] + 1)
        return F.when(touching, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            tail["p_s"].alias("p_s"), F.greatest(tail["p_e"], run["p_e"]).alias("p_e"))))
        ).otherwise(F.concat(done, F.array(run)))

    none = F.array().cast("array<struct<p_s:int,p_e:int>>")
    return found.select("row", F.aggregate("all", none, merge).alias("runs"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with its text replaced by what stays, and ``_l_lines``, ``_l_deleted``
    (line counts), ``_l_runs`` (deleted runs as ``first-last``) and ``_l_emptied`` (it had
    words and has none left).

    The input is staged once to fix its rows' numbers, and texts are shuffled once, to
    meet their deleted runs."""
    keyed = stage(docs.withColumn("_l_row", F.monotonically_increasing_id()), "line-docs")
    lines = stage(document_lines(pick(keyed, row="_l_row", id=id_col, text=text_col)
                                 .withColumn("id", F.col("id").cast("long"))), "lines")
    found = stage(repeated_runs(lines, min_words), "line-deletions")
    release(lines)
    runs = found.select(F.col("row").alias("_l_row"), F.col("runs").alias("_l_found"))
    text = text_or_empty(F.col(f"`{text_col}`"))
    parts = F.split(text, "\n")
    stay = F.filter(parts, lambda s, p: ~F.exists("_l_found", lambda r: (r["p_s"] <= p) & (p <= r["p_e"])))
    out = keyed.join(runs, "_l_row", "left").withColumns({
        "_l_lines": F.size(parts).cast("long"),
        "_l_deleted": F.coalesce(F.aggregate("_l_found", F.lit(0), lambda n, r: n + r["p_e"] - r["p_s"] + 1),
                                 F.lit(0)).cast("long"),
        "_l_runs": F.coalesce(F.array_join(F.transform("_l_found", lambda r: F.concat_ws(
            "-", r["p_s"].cast("string"), r["p_e"].cast("string"))), ","), F.lit("")),
        "_l_text": F.when(F.col("_l_found").isNull(), F.col(f"`{text_col}`"))
        .otherwise(F.array_join(stay, "\n"))})
    cols = [F.col("_l_text").alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    emptied = (F.col("_l_deleted") > 0) & ~F.col("_l_text").rlike(WORD)
    return out.select(*cols, "_l_lines", "_l_deleted", "_l_runs", emptied.alias("_l_emptied"))
