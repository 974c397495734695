"""Soft-membership mixing of sources to target weights (operator 7).

A classifier fitted on the labelled table gives every document a posterior over domains.
Each document then gets a nonnegative rate (expected copies) such that the expected
token totals of the domains, sum over documents of rate * tokens * posterior, meet the
targets in the least-squares sense. The fit is projected gradient descent over all
documents: an iteration is one aggregation to as many sums as there are domains, a
small step on the driver, and a column expression for the new rates, which are cut at 0
(and at a highest rate, where texts must not repeat).

Steps are taken in units of tokens per document and with the residual weighted by the
inverse of the domains' second moments, so that a step changes a document's rate by its
posterior alone, whatever its length. Rates start at 1 and move only as far as the
targets ask.

Labels: at most ``max_train_rows`` labelled rows (those with the smallest hash of the id)
are chosen, and those whose document exists fit the classifier; a document with several
labels is one row for each. With no usable label or a single domain, posteriors are
constant. Nulls: a null text has no tokens and keeps rate 1 unless its posterior
moves it. Repeated rows get the same rate each. An empty table gives an empty result.
Everything runs on DataFrame expressions and the DataFrame API of ``pyspark.ml``.
"""
from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semsift.llm.common import pick, release, stage, text_or_empty, words_of

#: Words that the classifier looks at, and the bound on labelled rows that fit it.
FEATURES, MAX_TRAIN_ROWS = 4096, 4000
#: Between words, and between a word and symbols next to it.
PARTS = (r"[\x20\x09-\x0D]+|(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N}\x20\x09-\x0D])"
         r"|(?<=[^\p{L}\p{N}\x20\x09-\x0D])(?=[\p{L}\p{N}])")
ITERATIONS, TOLERANCE = 60, 1e-4
#: Rate expressions are written to a table after so many nested steps.
STEPS_PER_STAGE = 10


def label_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, domain)`` of the quality/toxicity labels: ``toxic``, ``clean`` or ``poor``."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean") \
        .when(F.col("quality") == 0, "poor")
    return labels.select(F.col(id_col).alias("id"), domain.alias("domain")).where("domain is not null")


class DomainClassifier:
    """Posteriors over ``domains`` from the words that tell them apart: the words of the
    labelled texts with the largest chi-square over the domains, present or not, in a
    sparse multinomial logistic regression."""

    def __init__(self, train: DataFrame, domains: list[str], features: int = FEATURES):
        """``train``: ``text, domain``."""
        self.domains, self.model = domains, None
        rows = stage(train.select(self._words(), "domain"), "mix-train")
        counts = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
        total = sum(counts.values())
        self.share = [(counts.get(d, 0) + 1) / (total + len(domains)) for d in domains]
        present = [d for d in domains if counts.get(d)]
        if len(present) < 2:
            return
        seen = rows.select("domain", F.explode(F.array_distinct("_m_words")).alias("word")).groupBy("word").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum((F.col("domain") == d).cast("int")).alias(f"n{k}")
                                            for k, d in enumerate(present)]).where("n > 1 AND word != ''")
        chi = sum(((F.col(f"n{k}") - F.col("n") * counts[d] / total) ** 2 / (F.col("n") * counts[d] / total)
                   for k, d in enumerate(present)), F.lit(0.0))
        chosen = [r["word"] for r in seen.orderBy(chi.desc(), "word").limit(features).select("word").collect()]
        if not chosen:
            return
        self.count = CountVectorizerModel.from_vocabulary(chosen, inputCol="_m_words", outputCol="_m_x")
        self.count.setBinary(True)
        number = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")) - 1
        # few partitions of the bounded rows: gradients come back without a shuffle
        points = stage(self.count.transform(rows).select("_m_x", number.cast("double").alias("label")).coalesce(4),
                       "mix-points")
        self.model = LogisticRegression(
            featuresCol="_m_x", labelCol="label", family="multinomial", regParam=1e-3, elasticNetParam=1.0,
            maxIter=30, probabilityCol="_m_p", rawPredictionCol="_m_raw", predictionCol="_m_label").fit(points)

    @staticmethod
    def _words() -> Column:
        """Words and runs of symbols, as an array."""
        return F.split(F.lower(text_or_empty("text")), PARTS).alias("_m_words")

    def posteriors(self, docs: DataFrame) -> DataFrame:
        """``docs`` (with ``text``) with an array ``posterior`` in the order of ``domains``."""
        if self.model is None:
            return docs.withColumn("posterior", F.array(*[F.lit(float(s)) for s in self.share]))
        out = self.model.transform(self.count.transform(docs.withColumn("_m_words", self._words())))
        p = F.concat(vector_to_array("_m_p"), F.array_repeat(F.lit(0.0), len(self.domains) - self.model.numClasses))
        return out.withColumn("posterior", p).drop(*[c for c in out.columns if c.startswith("_m_")])


def _sums(docs: DataFrame, k: int, weight: Column) -> np.ndarray:
    row = docs.agg(*[F.sum(weight * F.get("posterior", F.lit(j))) for j in range(k)]).first()
    return np.array([x or 0.0 for x in row])


def fit_moves(docs: DataFrame, targets: list[float], iterations: int = ITERATIONS,
              tolerance: float = TOLERANCE, max_rate: float | None = None) -> list[list[float]]:
    """The steps of the fit for ``docs`` (``tokens`` and ``posterior``): by how much each
    lowers a document's rate, per unit of its posterior. ``targets``: expected tokens per
    domain. Ends when the sums meet the targets or no longer move."""
    k, goal = len(targets), np.array(targets, dtype=float)
    docs = docs.select("tokens", "posterior")
    tokens = F.col("tokens").cast("double")
    p = [F.get("posterior", F.lit(j)) for j in range(k)]
    moments = docs.agg(*[F.sum(tokens * p[i] * p[j]) for i in range(k) for j in range(k)]).first()
    second = np.array([x or 0.0 for x in moments]).reshape(k, k)
    inverse = np.linalg.pinv(second + 1e-9 * np.trace(second) * np.eye(k) / k) if second.any() else np.zeros((k, k))
    docs = docs.withColumn("rate", F.lit(1.0))
    scale, before, moves, staged = max(np.abs(goal).sum(), 1.0), None, [], []
    for step in range(iterations):
        sums = _sums(docs, k, tokens * F.col("rate"))
        residual = sums - goal
        still = before is not None and np.abs(sums - before).sum() <= 0.01 * tolerance * scale
        if still or np.abs(residual).sum() <= tolerance * scale:
            break
        before = sums
        moves.append([float(x) for x in inverse @ residual])
        docs = docs.withColumn("rate", _moved(F.col("rate"), p, moves[-1], max_rate))
        if step % STEPS_PER_STAGE == STEPS_PER_STAGE - 1:
            docs = stage(docs, "mix-rates")
            staged.append(docs)
            release(*staged[:-1])
    release(*staged)
    return moves


def _moved(rate: Column, p: list[Column], move, max_rate: float | None) -> Column:
    value = [m if isinstance(m, Column) else F.lit(m) for m in move]
    rate = F.greatest(F.lit(0.0), rate - sum((a * b for a, b in zip(p[1:], value[1:])), p[0] * value[0]))
    return rate if max_rate is None else F.least(rate, F.lit(float(max_rate)))


def fit_rates(docs: DataFrame, targets: list[float], max_rate: float | None = None, **fit) -> DataFrame:
    """``docs`` (``tokens`` and ``posterior``, and any other columns) with ``rate``. A rate
    follows from its document's posterior and the steps, so nothing is joined."""
    moves = fit_moves(docs, targets, max_rate=max_rate, **fit)
    if not moves:
        return docs.withColumn("rate", F.lit(1.0))
    p = [F.get("posterior", F.lit(j)) for j in range(len(targets))]
    steps = F.array(*[F.array(*[F.lit(x) for x in m]) for m in moves])
    return docs.withColumn("rate", F.aggregate(steps, F.lit(1.0), lambda rate, move: _moved(
        rate, p, [F.get(move, F.lit(j)) for j in range(len(p))], max_rate)))


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], id_col: str = "doc_id",
        text_col: str = "text", budget: float | str | None = None, max_train_rows: int = MAX_TRAIN_ROWS,
        features: int = FEATURES, seed: int = 0, max_rate: float | None = None,
        carry: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or ``carry``) with ``_m_tokens, _m_posterior, _m_rate, _m_copies``.

    ``labelled``: ``id, domain``. ``weights``: target shares of the domains. ``budget``:
    expected tokens in all, or a domain whose tokens are to stay as many as they are; by
    default as many in all as there are. ``_m_copies`` is the rate rounded at a fixed random
    fraction per id, so that copies meet the rates in expectation and every run agrees."""
    domains = sorted(weights)
    total_weight = sum(weights.values())
    shares = [weights[d] / total_weight for d in domains]
    chosen = stage(labelled.where(F.col("domain").isin(domains)).select("id", "domain")
                   .orderBy(F.xxhash64("id", F.lit(seed)), "domain").limit(max_train_rows), "mix-labels")
    # at most max_train_rows rows of an id and a short name are sent to every task
    train = pick(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id")
    classifier = DomainClassifier(stage(train.select("text", "domain"), "mix-labelled"), domains, features)
    keep = [F.col(f"`{c}`").alias(f"_k_{c}") for c in (docs.columns if carry is None else carry)]
    rows = docs.select(*keep, F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
                       .alias("text")).withColumn("_n", F.size(words_of("text")).cast("long"))
    rows = classifier.posteriors(rows).drop("text")
    rows = stage(rows.withColumnRenamed("_n", "tokens"), "mix-posteriors")
    now = _sums(rows, len(domains), F.col("tokens").cast("double"))
    if budget is None:
        budget = float(now.sum())
    elif isinstance(budget, str):
        budget = float(now[domains.index(budget)] / shares[domains.index(budget)])
    rows = fit_rates(rows, [budget * s for s in shares], max_rate=max_rate)
    unit = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(F.col("rate") + unit).cast("long")
    return rows.select(*[F.col(f"`_k_{c}`").alias(c) for c in (docs.columns if carry is None else carry)],
                       F.col("tokens").alias("_m_tokens"), F.col("posterior").alias("_m_posterior"),
                       F.col("rate").alias("_m_rate"), copies.alias("_m_copies"))
