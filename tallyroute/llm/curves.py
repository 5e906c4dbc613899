"""Approximate nearest neighbours along shifted space-filling curves.

Every vector is projected to `DIMENSIONS` random orthogonal directions, once for each of `CURVES`
orderings; the coordinates are shifted and cut to `BITS` bits, and their place on a Hilbert
curve is the vector's key. Spark range-partitions the rows of each ordering by key into blocks of
about `BLOCK` rows. A query looks into the blocks around its own in every ordering; each block
ranks its rows by cosine for its queries, and the best of all blocks are ranked again by the exact
cosine in double precision.

How many blocks a query looks into is measured, not guessed: for `PROBES` queries the true
neighbours are found by brute force over all rows, and the window is the least one within which
a share `RECALL` of those neighbours lies in at least one ordering. On vectors without structure this
is a good part of all blocks, on clustered ones a few; at a window of all blocks the search is
exact. Every row is indexed and there is no cap on candidates.

Equal vectors are one entry, represented by their smallest ids: a vector that a third of all
rows share is one candidate. Near-equal ones share a key and are told apart by a hash in the
key's low bits, so blocks stay even. Vectors that are null, zero or hold a null or non-finite
component take no part, nor do those whose length is not the most frequent one. A repeated id
counts as one row (that of the smallest vector). Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroute.llm.common import stored

CURVES, DIMENSIONS, BITS = 3, 6, 8
BLOCK = 2_048
QUERIES = 512  # queries that meet a block at once
PROBES, RECALL = 120, 0.95
NEAREST = 5
SPARE = 3
HASH_BITS = 62 - DIMENSIONS * BITS


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer points (n, d) on a d-dimensional Hilbert curve of `bits` bits a side.

    From the highest bit down, the cell's coordinates are Gray-decoded, and reflections and
    exchanges of axes turn the frame into that of the next smaller cell.
    """
    x = points.astype(np.int64).copy()
    n, d = x.shape
    high = 1 << (bits - 1)
    q = high
    while q > 1:
        low = q - 1
        for i in range(d):
            flip = (x[:, i] & q) != 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(flip, low, 0) ^ swap
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, np.int64)
    q = high
    while q > 1:
        turn ^= np.where((x[:, d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(n, np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> bit) & 1)
    return key


def frames(length: int, seed: int = 17) -> list[tuple[np.ndarray, np.ndarray]]:
    """Projection and shift of each ordering."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(CURVES):
        d = min(DIMENSIONS, length)
        basis, _ = np.linalg.qr(rng.normal(size=(length, d)))
        out.append((basis, rng.random(d)))
    return out


def curve_keys(vectors: np.ndarray, ties: np.ndarray, seed: int = 17) -> np.ndarray:
    """(n, CURVES) keys of vectors; `ties` orders what lies in one cell."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    spread = 2 / np.sqrt(vectors.shape[1])
    keys = []
    for basis, shift in frames(vectors.shape[1], seed):
        at = np.clip((unit @ basis) / (4 * spread) + 0.5, 0, 1) * 0.5 + shift * 0.5
        cell = np.minimum((at * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
        keys.append((hilbert(cell, BITS) << HASH_BITS) | (ties & ((1 << HASH_BITS) - 1)))
    return np.stack(keys, axis=1)


def matrix(column: pd.Series, length: int) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column]).reshape(-1, length)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so that no square overflows or vanishes.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, summed in the order of the components."""
    return np.sum(a * b, axis=1) / np.sqrt(np.sum(a * a, axis=1) * np.sum(b * b, axis=1))


def usable(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v) of vectors that take part, as doubles, and their length."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    plain = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    )
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    plain = plain.filter(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    lengths = plain.groupBy(F.size("v").alias("length")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    length = most.length if most else 0
    return plain.filter(F.size("v") == length), length


def entries(rows: DataFrame, keep: int) -> DataFrame:
    """(v, ids): every distinct vector with its `keep` smallest ids, in order.

    The ranks are cut while they are taken, so no task gathers all ids of a frequent vector.
    """
    # The sign of zero does not tell vectors apart.
    plain = rows.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    once = plain.groupBy("vec_id").agg(F.min("v").alias("v"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = once.withColumn("r", rank).filter(F.col("r") <= keep)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def indexed(entry: DataFrame, length: int, blocks: int) -> list[DataFrame]:
    """For each ordering: entry number, vector and ids with the block on the curve."""

    def keyed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            m = matrix(vectors, length)
            ties = pd.util.hash_array(np.ascontiguousarray(m).view(f"V{8 * length}").ravel().astype(object)) if len(m) else np.empty(0, np.uint64)
            ties = (ties >> np.uint64(2)).astype(np.int64)
            yield pd.Series(list(curve_keys(m, ties)), dtype=object)

    keys = stored(entry.withColumn("key", F.pandas_udf(keyed, "array<bigint>")(F.col("v"))), "curve-keys")
    out = []
    for c in range(CURVES):
        # Range partitioning samples its input: places are stored, never computed twice. The low
        # bits of the id are a row's place in its partition, the high ones the partition.
        placed = keys.select("n", "v", F.col("key")[c].alias("key"))
        placed = placed.repartitionByRange(blocks, "key").sortWithinPartitions("key", "n")
        number = F.monotonically_increasing_id()
        part, at = F.shiftright(number, 33), number.bitwiseAND(F.lit((1 << 33) - 1))
        rows = stored(placed.select("n", "v", part.alias("part"), at.alias("at")), f"curve-{c}")
        # One row per partition comes to the driver.
        sizes = sorted((r.part, r["count"]) for r in rows.groupBy("part").count().collect())
        before = np.cumsum([0] + [n for _, n in sizes]).tolist()
        begins = keys.sparkSession.createDataFrame(
            [(part, begin) for (part, _), begin in zip(sizes, before)], "part bigint, begin bigint"
        )
        block = F.expr(f"(begin + at) div {BLOCK}").cast("int").alias("block")
        out.append(rows.join(F.broadcast(begins), "part").select("n", "v", block))
    return out


def _block_search(length: int, best: int):
    def search(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"q": [], "n": [], "score": []})
        there = unit_rows(matrix(rows["v"], length))
        numbers = rows["n"].to_numpy(np.int64)
        asked = queries["q"].to_numpy(np.int64)
        found = unit_rows(matrix(queries["v"], length)) @ there.T
        k = min(best, len(numbers))
        top = np.argpartition(-found, k - 1, axis=1)[:, :k]
        return pd.DataFrame(
            {
                "q": np.repeat(asked, k),
                "n": numbers[top].ravel(),
                "score": np.take_along_axis(found, top, axis=1).ravel(),
            }
        )

    return search


def window(entry: DataFrame, orders: list[DataFrame], length: int, probes: DataFrame, k: int) -> int:
    """Blocks to either side that hold a share `RECALL` of the probes' true neighbours."""
    asked = probes.orderBy(F.xxhash64(F.lit(2), "n"), "n").limit(PROBES).collect()
    if not asked:
        return 0
    numbers = np.array([r.n for r in asked])
    units = entry.sparkSession.sparkContext.broadcast(
        (numbers, unit_rows(np.array([r.v for r in asked], np.float64)))
    )

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, asked_units = units.value
        for batch in batches:
            n = batch["n"].to_numpy(np.int64)
            score = asked_units @ unit_rows(matrix(batch["v"], length)).T
            score[mine[:, None] == n[None, :]] = -2
            best = min(k, len(n))
            top = np.argpartition(-score, best - 1, axis=1)[:, :best]
            yield pd.DataFrame(
                {"q": np.repeat(mine, best), "n": n[top].ravel(),
                 "score": np.take_along_axis(score, top, axis=1).ravel()}
            )

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "n"))
    truth = entry.select("n", "v").mapInPandas(nearest, "q bigint, n bigint, score double")
    truth = truth.withColumn("r", rank).filter((F.col("r") <= k) & (F.col("score") > -2)).collect()
    wanted = sorted({r.q for r in truth} | {r.n for r in truth})
    if not truth:
        return 0
    # At most PROBES * (k + 1) entries are looked up.
    places = []
    for order in orders:
        rows = order.filter(F.col("n").isin(wanted)).select("n", "block").collect()
        places.append({r.n: r.block for r in rows})
    away = sorted(min(abs(p[r.q] - p[r.n]) for p in places) for r in truth)
    return away[min(len(away) - 1, int(np.ceil(RECALL * len(away))) - 1)]


def nearest(embeddings: DataFrame, is_query: Column, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score: the `k` nearest other rows found for each query row.

    `is_query` is a condition on vec_id.
    """
    spark = embeddings.sparkSession
    rows, length = usable(embeddings)
    rows = stored(rows, "vectors")
    entry = entries(rows, k + 1).select(F.monotonically_increasing_id().alias("n"), "v", "ids")
    entry = stored(entry, "entries")
    total = entry.count()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not total:
        return spark.createDataFrame([], schema)
    blocks = max(1, -(-total // BLOCK))
    orders = indexed(entry, length, blocks)
    queries = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "v")
    queries = queries.groupBy("query_id").agg(F.min(F.transform("v", lambda x: x + F.lit(0.0))).alias("v"))
    asked = stored(queries.join(entry.select("n", "v"), "v").select("query_id", "n"), "queries")
    vectors = stored(asked.select("n").distinct().join(entry.select("n", "v"), "n"), "query-vectors")
    reach = window(entry, orders, length, vectors, k)
    portions = max(1, -(-vectors.count() // QUERIES))
    portion = F.pmod(F.xxhash64("n"), F.lit(portions)).cast("int").alias("portion")
    found = None
    for c, order in enumerate(orders):
        around = F.explode(F.sequence(F.greatest(F.col("block") - reach, F.lit(0)), F.least(F.col("block") + reach, F.lit(blocks - 1))))
        mine = vectors.join(order.select("n", "block"), "n").select(
            F.col("n").alias("q"), "v", portion, around.alias("block")
        )
        every = order.withColumn("portion", F.explode(F.sequence(F.lit(0), F.lit(portions - 1))))
        part = (
            every.groupBy("block", "portion")
            .cogroup(mine.groupBy("block", "portion"))
            .applyInPandas(_block_search(length, k + 1 + SPARE), "q bigint, n bigint, score double")
        )
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("q", "n").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "n"))
    best = best.withColumn("r", rank).filter(F.col("r") <= k + 1 + SPARE).select("q", "n")

    def exact(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series(cosines(matrix(a, length), matrix(b, length)))

    pair = (
        best.join(vectors.select(F.col("n").alias("q"), F.col("v").alias("qv")), "q")
        .join(entry, "n")
        .select("q", "ids", F.pandas_udf(exact, "double")("qv", "v").alias("score"))
    )
    each = (
        asked.withColumnRenamed("n", "q")
        .join(pair, "q")
        .select("query_id", "score", F.explode("ids").alias("vec_id"))
        .filter("vec_id != query_id")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        each.withColumn("rank", place)
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
