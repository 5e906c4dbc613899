"""Quality rules learnt as a decision list by sequential covering.

A rule is a conjunction of thresholds on text statistics and rejects what it covers; a text no
rule covers is kept. Rules are found one after the other on labelled documents: a rule grows
condition by condition by the gain in information on two thirds of the documents not yet covered,
is cut back to the prefix that does best on the last third, and enters the list if it is precise
enough on both. Growing reads a small table: labelled documents are binned by their statistics
and counted once; each step is one aggregation by feature and bin, and only its sums (features
times bins) reach the driver. The list becomes one ordered conditional expression.

Everything is DataFrame code. Repeated five-word windows are found inside each row: windows
are hashed to 64 bits, and only texts with an equal pair of hashes sort them.

Null texts have no words and fail the base check. Contradicting labels of one id drop out;
without labels there is no rule. Repeated rows are judged each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroute.llm.common import SPACES, labels_of, let, stored, without, words

# Fixed values of the base check.
SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, REPEAT_PERCENT = 5, 10, 20
FEATURES = (
    "n_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "marks", "digits",
)
BINS = 24
MAX_RULES, MAX_CONDITIONS = 12, 4
PRECISION, SUPPORT = 0.97, 5


def repeated_words(w: Column) -> Column:
    """Words in five-word windows that the text has twice or more, the first included."""
    last = F.size(w) - WINDOW

    def covered(hashes: Column) -> Column:
        numbered = F.sort_array(
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        )

        def twice(s: Column) -> Column:
            same = lambda i, x: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
            kept = F.filter(s, lambda x, i: same(i - 1, x) | same(i + 1, x))
            return F.sort_array(F.transform(kept, lambda x: x["at"]))

        def length(at: Column) -> Column:
            # `least` passes over the null that pads the last window.
            gaps = F.zip_with(
                at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.lit(WINDOW), b - a)
            )
            return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

        some = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(some, let(let(numbered, twice), length)).otherwise(0)

    hashes = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
    )
    return F.when(last >= 0, let(hashes, covered)).otherwise(0)


def statistics(text: Column) -> Column:
    """Struct of the counts of the contract and of those only the rules read."""

    def of(t: Column, w: Column) -> Column:
        bare = without(t, SPACES)
        lines = F.filter(F.split(t, "\n"), lambda s: F.length(without(s, SPACES)) > 0)
        count = lambda c: c.cast("bigint")
        return F.struct(
            count(F.size(w)).alias("n_words"),
            count(F.length(bare)).alias("word_chars"),
            count(F.length(t) - F.length(without(t, SYMBOLS))).alias("n_symbols"),
            let(lines, lambda x: count(F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
            count(repeated_words(w)).alias("n_repeat_words"),
            count(F.size(lines)).alias("n_lines"),
            count(F.regexp_count(t, F.lit("[A-Z]"))).alias("n_capitals"),
            count(F.length(t) - F.length(without(t, "!?"))).alias("n_marks"),
            count(F.regexp_count(t, F.lit("[0-9]"))).alias("n_digits"),
        )

    return let(F.coalesce(text, F.lit("")), lambda t: let(words(t), lambda w: of(t, w)))


def features() -> list[Column]:
    """The statistics the rules speak of, from the columns of `statistics`."""
    per = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    return [
        F.col("n_words").cast("double").alias("n_words"),
        per("word_chars", "n_words").alias("word_length"),
        per("n_symbols", "word_chars").alias("symbols"),
        per("n_dup_lines", "n_lines").alias("dup_lines"),
        per("n_repeat_words", "n_words").alias("repeats"),
        per("n_capitals", "word_chars").alias("capitals"),
        per("n_marks", "word_chars").alias("marks"),
        per("n_digits", "word_chars").alias("digits"),
    ]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    at: int
    threshold: float

    def on_bins(self) -> Column:
        bin_ = F.col(self.feature)
        return bin_ > self.at if self.above else bin_ <= self.at

    def on_values(self, value: Column) -> Column:
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = list[Condition]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _cells(labelled: DataFrame) -> tuple[DataFrame, dict[str, list[float]]]:
    """Binned counts (grow, features, bad, good) and the thresholds of each feature.

    `labelled` has the features, a label and the column `grow`. Thresholds are quantiles of all
    labelled documents and of the bad ones alone.
    """
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    cuts: dict[str, set] = {f: set() for f in FEATURES}
    quantiles = [
        F.percentile_approx(F.when(where, F.col(f)), shares, 10_000).alias(f"{f}_{i}")
        for i, where in enumerate([F.lit(True), F.col("label") == 0])
        for f in FEATURES
    ]
    row = labelled.agg(*quantiles).first()
    for f in FEATURES:
        for i in range(2):
            cuts[f].update(row[f"{f}_{i}"] or [])
    ordered = {f: sorted(c) for f, c in cuts.items()}
    bins = [
        sum(((F.col(f) > c).cast("int") for c in ordered[f]), F.lit(0)).alias(f) for f in FEATURES
    ]
    counted = (
        labelled.select("grow", *bins, "label")
        .groupBy("grow", *FEATURES)
        .agg(F.count_if(F.col("label") == 0).alias("bad"), F.count_if(F.col("label") == 1).alias("good"))
    )
    return stored(counted, "rule-cells"), ordered


def _grow(left: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    rule: Rule = []
    pairs = ", ".join(f"'{f}', {f}" for f in FEATURES)
    while len(rule) < MAX_CONDITIONS:
        sums = (
            left.filter(_all([F.col("grow"), *(c.on_bins() for c in rule)]))
            .select("bad", "good", F.expr(f"stack({len(FEATURES)}, {pairs}) AS (feature, bin)"))
            .groupBy("feature", "bin")
            .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
            .collect()
        )
        by: dict[str, list] = {f: [] for f in FEATURES}
        for r in sorted(sums, key=lambda r: (r.feature, r.bin)):
            by[r.feature].append((r.bin, r.bad, r.good))
        bad = sum(r[1] for r in by[FEATURES[0]])
        good = sum(r[2] for r in by[FEATURES[0]])
        if not bad or not good:
            break
        best, gain = None, 1e-9
        before = math.log(bad / (bad + good))
        for f in FEATURES:
            low_bad = low_good = 0
            for at, b, g in by[f]:
                low_bad, low_good = low_bad + b, low_good + g
                if at >= len(cuts[f]):
                    continue
                for above, p, n in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                    now = p * (math.log(p / (p + n)) - before) if p else 0
                    if now > gain:
                        best, gain = Condition(f, above, at, cuts[f][at]), now
        if best is None:
            break
        rule.append(best)
    return rule


def _prune(left: DataFrame, rule: Rule) -> tuple[Rule, bool]:
    """The best prefix of a grown rule on the other third, and whether it may enter the list."""
    sums = []
    for i in range(1, len(rule) + 1):
        inside = _all([c.on_bins() for c in rule[:i]])
        for fold in ("grow", "prune"):
            for kind in ("bad", "good"):
                here = inside & (F.col("grow") if fold == "grow" else ~F.col("grow"))
                sums.append(F.sum(F.when(here, F.col(kind)).otherwise(0)).alias(f"{fold}_{kind}_{i}"))
    row = left.agg(*sums).first()
    worth = []
    for i in range(1, len(rule) + 1):
        p, n = row[f"prune_bad_{i}"] or 0, row[f"prune_good_{i}"] or 0
        worth.append((p - n) / (p + n) if p + n else -1.0)
    cut = worth.index(max(worth)) + 1
    p = (row[f"grow_bad_{cut}"] or 0) + (row[f"prune_bad_{cut}"] or 0)
    n = (row[f"grow_good_{cut}"] or 0) + (row[f"prune_good_{cut}"] or 0)
    return rule[:cut], p >= SUPPORT and p >= PRECISION * (p + n)


def learn(labelled: DataFrame) -> list[Rule]:
    """Ordered rules from rows (doc_id, label, features)."""
    fold = labelled.withColumn("grow", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(3)) != 0)
    left, cuts = _cells(fold)
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        rule = _grow(left, cuts)
        if not rule:
            break
        rule, good = _prune(left, rule)
        if not good:
            break
        rules.append(rule)
        left = left.filter(~_all([c.on_bins() for c in rule]))
    return rules


def verdict(rules: list[Rule], values: dict[str, Column]) -> Column:
    """Number of the first rule that covers a row, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(_all([c.on_values(values[c.feature]) for c in rule]), number).otherwise(out)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base check, verdict and the text of the rule that rejected a document."""
    stats = stored(docs.select("doc_id", statistics(F.col("text")).alias("s")).select("doc_id", "s.*"), "counts")
    known = labels_of(labels, "quality")
    rules = learn(stats.select("doc_id", *features()).join(known, "doc_id"))
    values = dict(zip(FEATURES, features()))
    names = F.lit(None).cast("string")
    for number, rule in enumerate(rules, 1):
        names = F.when(F.col("hit") == number, " and ".join(map(str, rule))).otherwise(names)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )
    return (
        stats.withColumn("hit", verdict(rules, values))
        .withColumn("base_failed", failed)
        .select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "base_failed",
            (~F.col("base_failed") & F.col("hit").isNull()).alias("kept"),
            names.alias("rule"),
        )
    )
