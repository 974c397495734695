"""Quality rules per document and per host (operator 10).

Every document is tested by fixed rules on its whole text. Failures are summed by
host, each host's failure rate is shrunk towards the corpus by an empirical beta
prior fitted by moments, and hosts whose shrunk rate is over the limit are rejected
with all their documents.

Nulls: a null text has no words and fails; a null host is a host of its own. Repeated
rows are separate documents. An empty table gives an empty result. Only DataFrame
expressions run; features are one row of numbers per document and texts never move.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semsift.llm.common import SPACES, WORD, stage, text_or_empty

NOT_SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host goes when its shrunk failure rate is over this.
MAX_HOST_RATE = 0.6

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 5-word window found twice or more in the text."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)) \
        .otherwise(F.array().cast("array<int>"))

    def over(h: Column) -> Column:
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))

    def marked(windows: Column) -> Column:
        """Sorted starts of the windows found again."""
        order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(order, lambda s: F.array_sort(F.transform(F.filter(
            F.transform(s, lambda x, i: F.struct(
                x["i"].alias("i"),
                (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                 | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))).alias("again"))),
            lambda x: x["again"]), lambda x: x["i"])))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda a, i: F.least(
            F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - a, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    return _let(_let(hashed, over), lambda windows: F.when(
        F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)
    ).otherwise(_let(marked(windows), covered)))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rule_features(docs: DataFrame, text_col: str = "text", prefix: str = "_q_") -> DataFrame:
    """``docs`` with the columns ``<prefix><feature>`` and ``<prefix>base_failed``."""
    text = text_or_empty(F.col(f"`{text_col}`"))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(WORD))
    out = docs.withColumn(f"{prefix}words", F.filter(F.split(text, SPACES), lambda w: w != ""))
    words = F.col(f"{prefix}words")
    out = out.withColumns({
        f"{prefix}n_words": F.size(words).cast("long"),
        f"{prefix}word_chars": F.length(F.regexp_replace(text, SPACES, "")).cast("long"),
        f"{prefix}n_symbols": F.length(F.regexp_replace(text, NOT_SYMBOLS, "")).cast("long"),
        f"{prefix}n_dup_lines": _let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
        f"{prefix}n_repeat_words": _repeat_words(words).cast("long"),
    }).drop(f"{prefix}words")
    n, repeat = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return out.withColumn(f"{prefix}base_failed",
                          (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n))


def host_verdicts(flags: DataFrame, host_col: str, failed_col: str,
                  max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``(host, docs, failures, shrunk_rate, rejected)`` for every host.

    The beta prior has the hosts' mean rate and, by moments, their variance beyond
    what sampling alone would give; with no such extra variance every host is drawn to
    the mean with the weight of a mean-sized host's documents."""
    per_host = flags.groupBy(F.col(f"`{host_col}`").alias("host")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.col(failed_col).cast("long")).alias("failures"))
    per_host = stage(per_host, "host-failures")
    rate = F.col("failures") / F.col("docs")
    hosts, docs, failures, mean_rate, var_rate, inverse = per_host.agg(
        F.count(F.lit(1)), F.sum("docs"), F.sum("failures"), F.avg(rate), F.var_pop(rate),
        F.avg(1 / F.col("docs"))).first()
    if not hosts:
        a, b = 1.0, 1.0
    else:
        mean = min(max(mean_rate, 1e-6), 1 - 1e-6)
        spread = mean * (1 - mean)
        extra = max(var_rate - spread * inverse, 0.0)
        weight = min(max(spread / extra - 1, 1.0), docs / hosts) if extra > 0 else docs / hosts
        a, b = mean * weight, (1 - mean) * weight
    shrunk = (F.col("failures") + F.lit(float(a))) / (F.col("docs") + F.lit(float(a + b)))
    return per_host.select("host", "docs", "failures", shrunk.alias("shrunk_rate"),
                           (shrunk > F.lit(max_rate)).alias("rejected"))


def apply_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source",
                carry: list[str] | None = None, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Documents (all columns, or only ``carry``) with their features, the host's shrunk
    rate and ``_q_kept``. Features are computed once and staged without the text unless
    ``carry`` asks for it. The verdict table has a row per host and joins by Spark's own
    choice: broadcast while its measured file size is under the session's threshold, else
    a sort-merge join whose hot hosts adaptive execution splits."""
    with_rules = rule_features(docs.withColumn("_q_host", F.col(f"`{host_col}`")), text_col)
    keep = [F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]
    flags = stage(with_rules.select(
        *keep, "_q_host", *[f"_q_{f}" for f in FEATURES], "_q_base_failed"), "rule-flags")
    hosts = stage(host_verdicts(flags, "_q_host", "_q_base_failed", max_rate)
                  .select(F.col("host").alias("_q_h"), F.col("shrunk_rate").alias("_q_host_rate"),
                          F.col("rejected").alias("_q_host_rejected")), "host-verdicts")
    joined = flags.join(hosts, F.col("_q_host").eqNullSafe(F.col("_q_h")), "left").drop("_q_h")
    return joined.withColumn("_q_kept", ~F.col("_q_base_failed") & ~F.col("_q_host_rejected"))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per document with the features, the host's rate and the verdict."""
    out = apply_rules(docs, text_col, host_col, carry=[id_col], max_rate=max_rate)
    return out.select(F.col(f"`{id_col}`").alias("doc_id"), *[F.col(f"_q_{f}").alias(f) for f in FEATURES],
                      F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"),
                      F.col("_q_host").alias("host"), F.col("_q_host_rate").alias("host_rate"))


def quality_filter(docs: DataFrame, text_col: str = "text", host_col: str = "source",
                   max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that pass, with the columns of ``docs``."""
    out = apply_rules(docs, text_col, host_col, max_rate=max_rate)
    return out.where("_q_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
