"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies. Of all rates of at most
`MAX_COPIES` under which each source yields its target number of words, entropy balancing takes
the closest to one copy each in relative entropy: r = min(MAX_COPIES, exp(lambda * x)) with x
the document's size over the mean size in its source and one lambda per source. The convex dual

    sum over documents of integral(r) - lambda * target / mean size

is minimised by Newton steps, each one Spark aggregation (rates and their slope summed per
source) with a bisection bracket as safeguard. Documents of one source and size have one rate,
so the steps read a table of (source, size, number of documents), not the documents.

Rates become whole copies in two exact steps. The documents of a source and size together get
a whole number of copies; what rounding leaves over is carried on to the next smaller size, so
a source misses its target by about half of its smallest document. Within a size the copies
are dealt out by a hash of the id: documents fall into `BUCKETS` buckets, cumulative counts
tell how many extra copies each bucket holds, and a rank inside the bucket tells which
documents have them. No window spans more than one bucket of one size of one source.

On the driver: one row per source. Null texts have size 0 and are never taken; a null source
is a source of its own; repeated ids are told apart by a hash of the text, and rows that agree
in both are alike, so that it does not matter which of them has the copy.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroute.llm.common import WORD, fresh, stored, with_row

# Fixed values of the mix: weights by the order of the sources, copies of one document at most.
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BUCKETS = 256
STEPS = 60
TOLERANCE = 1e-7


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_key(source: str | Column) -> Column:
    """A text that is never null: null sources sort last."""
    column = F.col(source) if isinstance(source, str) else source
    return F.when(column.isNull(), "n").otherwise(F.concat(F.lit("a"), column.cast("string")))


def targets_of(totals: dict[str, int], weights: tuple[int, ...] = WEIGHTS) -> dict[str, float]:
    """Words wanted of each source: shares by weight, at most `MAX_COPIES` times its size.

    What a source cannot take is shared again by weight among the others.
    """
    order = sorted(totals, key=lambda s: s.encode("utf-8", "surrogatepass"))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    open_, left, targets = set(order), sum(totals.values()), {}
    while open_:
        share = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] > MAX_COPIES * totals[s] * share]
        if not full:
            return targets | {s: left * weight[s] / share for s in open_}
        for s in full:
            targets[s] = float(MAX_COPIES * totals[s])
            left -= MAX_COPIES * totals[s]
            open_.discard(s)
    return targets


def tilts(sizes: DataFrame, targets: dict[str, float], totals: dict) -> dict[str, float]:
    """The lambda of every source whose target lies between 0 and its limit.

    `sizes`: source, size and number n of documents. `totals`: words and documents by source.
    """
    spark = sizes.sparkSession
    mean = {s: words / n for s, (words, n) in totals.items() if words}
    low, high, now = {}, {}, {}
    for s, target in targets.items():
        if 0 < target < MAX_COPIES * totals[s][0]:
            low[s], high[s], now[s] = -math.inf, math.inf, 0.0
    done: dict[str, float] = {}
    for _ in range(STEPS):
        if not now:
            break
        state = spark.createDataFrame(
            [(s, now[s], mean[s]) for s in now], "source string, tilt double, mean double"
        )
        x = F.col("size") / F.col("mean")
        power = F.col("tilt") * x
        rate = F.when(power >= math.log(MAX_COPIES), float(MAX_COPIES)).otherwise(F.exp(power))
        slope = F.when(power >= math.log(MAX_COPIES), 0.0).otherwise(rate * x)
        sums = (
            sizes.join(F.broadcast(state), "source")
            .groupBy("source")
            .agg(
                F.sum(F.col("n") * F.col("size") * rate).alias("words"),
                F.sum(F.col("n") * F.col("size") * slope).alias("slope"),
            )
            .collect()
        )
        for row in sums:
            s = row.source
            gap = row.words - targets[s]
            if abs(gap) <= TOLERANCE * targets[s]:
                done[s] = now.pop(s)
                continue
            (high if gap > 0 else low)[s] = now[s]
            step = now[s] - gap / row.slope if row.slope > 0 else math.nan
            if not low[s] < step < high[s]:
                if math.isinf(high[s]):
                    step = 2 * now[s] + 1
                elif math.isinf(low[s]):
                    step = 2 * now[s] - 1
                else:
                    step = (low[s] + high[s]) / 2
            now[s] = step
    return done | now


def _whole_copies(keys: list[str]):
    """Copies for each (source, size): rates rounded, the rest carried to smaller sizes."""

    def round_source(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False)
        carry, copies = 0.0, []
        for size, n, rate in zip(rows["size"], rows["n"], rows["rate"]):
            wanted = n * rate + carry / size
            whole = min(max(math.floor(wanted + 0.5), 0), MAX_COPIES * n)
            carry = (wanted - whole) * size
            copies.append(whole)
        return rows.assign(copies=copies)[keys]

    return round_source


def copies(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, rate and copies of each row of `docs`.

    `row` names a column to be carried along.
    """
    carried = [] if row is None else [row]
    rows = stored(
        docs.select(
            *carried,
            "doc_id",
            source_key("source").alias("source"),
            word_count("text").alias("size"),
            F.xxhash64("text").alias("text_hash"),
        ).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(BUCKETS)).cast("int")),
        "sizes",
    )
    counted = rows.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("in_bucket"))
    counted = stored(counted, "size-buckets")
    sizes = stored(counted.groupBy("source", "size").agg(F.sum("in_bucket").alias("n")), "size-counts")
    summed = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("n")
    )
    totals = {r.source: (r.words, r.n) for r in summed.collect()}
    targets = targets_of({s: words for s, (words, _) in totals.items()})
    tilt = tilts(sizes, targets, totals)
    spark = docs.sparkSession
    facts = spark.createDataFrame(
        [
            (s, words, float(targets[s]), tilt.get(s), words / n)
            for s, (words, n) in totals.items()
        ],
        "source string, source_size bigint, target double, tilt double, mean double",
    )
    x = F.col("size") / F.col("mean")
    limit = F.when(F.col("target") > 0, float(MAX_COPIES)).otherwise(0.0)
    rated = (
        sizes.filter("size > 0")
        .join(F.broadcast(facts), "source")
        .withColumn(
            "rate",
            F.when(F.col("tilt").isNull(), limit).otherwise(
                F.least(F.lit(float(MAX_COPIES)), F.exp(F.col("tilt") * x))
            ),
        )
        .select("source", "size", "n", "rate")
    )
    schema = "source string, size bigint, n bigint, rate double, copies bigint"
    keys = ["source", "size", "n", "rate", "copies"]
    dealt = rated.groupBy("source").applyInPandas(_whole_copies(keys), schema)
    upto = Window.partitionBy("source", "size").orderBy("bucket")
    share = lambda c: F.expr(f"(copies % n) * ({c}) div n")
    buckets = (
        counted.join(dealt, ["source", "size"])
        .withColumn("through", F.sum("in_bucket").over(upto))
        .select(
            "source",
            "size",
            "bucket",
            "rate",
            F.expr("copies div n").alias("each"),
            (share("through") - share("through - in_bucket")).alias("extra"),
        )
    )
    rank = Window.partitionBy("source", "size", "bucket").orderBy(
        F.xxhash64(F.lit(1), "doc_id", "text_hash"), F.col("doc_id"), "text_hash"
    )
    return (
        rows.withColumn("rank", F.row_number().over(rank))
        .join(buckets, ["source", "size", "bucket"], "left")
        .join(F.broadcast(facts.select("source", "source_size", "target")), "source")
        .select(
            *carried,
            "doc_id",
            "size",
            "source_size",
            "target",
            "rate",
            F.coalesce(F.col("each") + (F.col("rank") <= F.col("extra")).cast("bigint"), F.lit(0))
            .cast("bigint")
            .alias("copies"),
        )
    )


def mix_report(docs: DataFrame) -> DataFrame:
    """Words taken of each document under the mix, repeats counted."""
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return copies(docs).select("doc_id", "size", "source_size", "target", taken, "rate", "copies")


def mix(docs: DataFrame) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; columns as given."""
    row = fresh(docs, "_row")
    keyed = with_row(docs, row)
    number = fresh(docs, "_copies")
    taken = copies(keyed, row).filter("copies > 0").select(row, F.col("copies").alias(number))
    each = F.explode(F.sequence(F.lit(1), F.col(number).cast("int")))
    return keyed.join(taken, row).select(*docs.columns, each.alias(number)).drop(number)
