"""Quality classifier learnt from positive and unlabelled documents.

Trusted positives are the training rows of `labels` with label 1; every document, labelled or
not, is unlabelled text. Label 0 is never read. A logistic model over text statistics minimises
the non-negative unbiased risk

    prior * E_positive[l(+)] + max(0, E_unlabelled[l(-)] - prior * E_positive[l(-)])

with the class prior estimated before: a classifier of positives against unlabelled ranks both,
and the prior is the least ratio of their shares above a threshold, each share moved by its
sampling error against the estimate.

Statistics are Spark expressions over the whole text. The model is fitted on the driver on a
sample of about `SAMPLE` rows of either kind at most (chosen by a hash of the id) and scores every
row as a Spark expression.

Null texts count as empty; empty texts have statistics of zero and a score like any other. A null
id is never held out and never a training row. Contradicting labels of one id drop out. Without
any positive every score is 0.5 and every document is accepted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroute.llm.common import (
    crc_class,
    fraction_for,
    in_sample,
    labels_of,
    let,
    words,
)

SAMPLE = 12_000
STEPS = 400
MODULUS, HELD_OUT = 3, 1
SYMBOLS = "[#*$%&<>]"
BLANK = r"[\x20\x09-\x0D]"
STATISTICS = (
    "length", "word_length", "symbols", "bars", "shouts", "capitals", "digits", "distinct",
    "repeats", "lines",
)


def _share(part: Column, whole: Column) -> Column:
    """log(1 + 50 * part / whole): small shares stand out, large ones level off."""
    return F.log1p(50 * part / F.greatest(whole, F.lit(1)))


def statistics(text: Column) -> Column:
    """Array of the statistics of a text, in the order of `STATISTICS`."""

    def of(t: Column, w: Column, bare: Column, lines: Column) -> Column:
        n = F.size(w)
        # Words equal to the one before; compared as whole arrays shifted by one.
        pairs = F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(n, F.lit(1))).alias("b"))
        again = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
        return F.array(
            F.log1p(n.cast("double")),
            F.log1p(bare / F.greatest(n, F.lit(1))),
            _share(F.regexp_count(t, F.lit(SYMBOLS)), bare),
            _share(F.regexp_count(t, F.lit("[|]")), bare),
            _share(F.regexp_count(t, F.lit("!")), bare),
            _share(F.regexp_count(t, F.lit("[A-Z]")), bare),
            _share(F.regexp_count(t, F.lit("[0-9]")), bare),
            F.size(F.array_distinct(w)) / F.greatest(n, F.lit(1)),
            _share(again, n),
            F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        )

    def measured(t: Column) -> Column:
        bare = F.length(t) - F.regexp_count(t, F.lit(BLANK))
        lines = F.filter(F.split(t, "\n"), lambda s: F.length(F.trim(s)) > 0)
        return let(
            words(t), lambda w: let(bare, lambda b: let(lines, lambda rows: of(t, w, b, rows)))
        )

    return let(F.coalesce(text, F.lit("")), measured)


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -6, 6)
        # Squares of all but the length: no length is bad by itself.
        return np.concatenate([z, z * z * (np.arange(z.shape[1]) > 0)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weights + self.bias, -30, 30)))

    def expression(self, x: Column) -> Column:
        """The same score as a Spark expression over an array of statistics."""
        total, n = F.lit(float(self.bias)), len(self.center)
        for i in range(n):
            z = (F.element_at(x, i + 1) - float(self.center[i])) / float(self.scale[i])
            z = F.least(F.greatest(z, F.lit(-6.0)), F.lit(6.0))
            total = total + z * float(self.weights[i])
            if i:
                total = total + z * z * float(self.weights[n + i])
        total = F.least(F.greatest(total, F.lit(-30.0)), F.lit(30.0))
        return 1 / (1 + F.exp(-total))


def _sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


def _descend(gradient, size: int, steps: int) -> np.ndarray:
    """Adam from zero; the last entry is the bias, weights carry a small penalty."""
    w, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        g = gradient(w) + 1e-4 * np.append(w[:-1], 0)
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w = w - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.1) -> float:
    """Share of positives among the unlabelled from the ranks of both.

    Only thresholds above which at least `least` of the positives lie are considered.
    """
    cuts = np.quantile(positive, np.linspace(0, 1 - least, 91))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    slack = math.sqrt(math.log(20) / 2) * (1 / math.sqrt(len(positive)) + 1 / math.sqrt(len(unlabelled)))
    bounds = (u + slack) / np.maximum(p - slack, 1e-9)
    best = np.argmin(np.where(p > slack, bounds, np.inf))
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = STEPS) -> Model:
    n = len(STATISTICS)
    blank = Model(np.zeros(n), np.ones(n), np.zeros(2 * n), 0.0, 0.5)
    if not len(positive) or not len(unlabelled):
        return blank
    center = np.median(unlabelled, axis=0)
    scale = np.maximum(unlabelled.std(axis=0), 1e-3)
    model = Model(center, scale, np.zeros(2 * n), 0.0, 0.5)
    p, u = (np.c_[model.inputs(x), np.ones(len(x))] for x in (positive, unlabelled))

    def apart(w):  # positives against unlabelled, both with weight one half
        return -p.T @ _sigmoid(-p @ w) / len(p) / 2 + u.T @ _sigmoid(u @ w) / len(u) / 2

    ranks = _descend(apart, 2 * n + 1, steps // 2)
    prior = class_prior(p @ ranks, u @ ranks)

    def risk(w):
        up, uu = p @ w, u @ w
        negative = np.logaddexp(0, uu).mean() - prior * np.logaddexp(0, up).mean()
        of_negative = u.T @ _sigmoid(uu) / len(u) - prior * p.T @ _sigmoid(up) / len(p)
        if negative < 0:  # the estimate of the negative risk fell below 0: step back
            return -of_negative
        return -prior * p.T @ _sigmoid(-up) / len(p) + of_negative

    w = _descend(risk, 2 * n + 1, steps)
    return Model(center, scale, w[:-1], float(w[-1]), prior)


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from the texts of at most about `sample` positives and as many documents."""
    known = labels_of(labels, "quality").filter(
        (F.col("label") == 1) & (crc_class("doc_id", MODULUS) != HELD_OUT)
    )
    trusted = known.filter(in_sample("doc_id", fraction_for(known, sample), 51)).select("doc_id")
    texts = docs.select("doc_id", "text")
    positive = texts.join(F.broadcast(trusted), "doc_id")
    free = texts.filter(in_sample("doc_id", fraction_for(docs, sample), 52))

    def rows(df: DataFrame) -> np.ndarray:
        # In a fixed order, so that reruns sum in the same order.
        found = sorted(r.x for r in df.select(statistics(F.col("text")).alias("x")).collect())
        return np.array(found, float).reshape(-1, len(STATISTICS))

    return fit(rows(positive), rows(free))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    score = let(statistics(F.col("text")), trained(docs, labels).expression)
    held_out = F.coalesce(crc_class("doc_id", MODULUS) == HELD_OUT, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is at least 0.5; columns as given."""
    model = trained(docs, labels)
    return docs.filter(let(statistics(F.col("text")), model.expression) >= 0.5)
