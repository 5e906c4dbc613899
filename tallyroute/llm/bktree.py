"""SimHash near-duplicates found through BK-trees.

A fingerprint is 64 bits wide; bit b is 1 if it is set in more than half of the XXH64 hashes
of a text's word shingles. Equal fingerprints are one entry, so copies cost nothing beyond
their count. Two fingerprints within `MAX_BITS` differing bits agree on at least one of
`MAX_BITS` + 1 bit blocks, so each entry goes to one shard per block, keyed by block and value,
and every link lies inside some shard. A shard with more than `SHARD` entries is split again by
the blocks of the bits it has not yet fixed, as often as needed: no link is lost by a split.

Every shard is a BK-tree: a child hangs on the edge named by its Hamming distance to its parent.
A task builds the trees of all its shards together, one level at a time, and a search follows
only edges within `MAX_BITS` of the distance just measured. Trees live where their shard lies.
They are not broadcast: together they hold the fingerprints of all documents, which must not
pass through the driver.

Inside a shard links become a forest (at most one link per entry) before they leave the task.
Components over all shards are found by alternating large-star and small-star rounds, whose
tables hold linked fingerprints only.

Null texts count as empty. Empty texts have fingerprint zero and link like any other. Rows with
a null id get a fingerprint and a component, but never name one unless no member has an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroute.llm.common import fresh, stored, with_row

# Fixed values of the contract.
SHINGLE, SEED, MAX_BITS = 3, 42, 2
BITS = 64
SHARD = 20_000
SEARCH = 200_000
PORTION = 50_000


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of a text as a signed 64-bit number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        windows = [b" ".join(words)]
    else:
        windows = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w, SEED) for w in windows], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), PORTION):
        part = hashes[at : at + PORTION].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: Column) -> Column:
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(
                [simhash(t if isinstance(t, str) else None) for t in batch], dtype="int64"
            )

    return F.pandas_udf(hashed, "bigint")(text)


class Forest:
    """BK-trees of many shards, built together; entries are numbered, a root stands per shard."""

    def __init__(self, shard: np.ndarray, prints: np.ndarray):
        """`shard`: sorted shard numbers from 0; `prints`: fingerprints as uint64."""
        n = len(prints)
        self.prints = prints
        begins = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        self.root = np.repeat(begins, np.diff(np.append(begins, n)))
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        rest = np.setdiff1d(np.arange(n), begins, assume_unique=True)
        at = self.root[rest]
        while len(rest):
            distance = np.bitwise_count(prints[rest] ^ prints[at]).astype(np.int64)
            key = at * (BITS + 1) + distance
            _, first, slot = np.unique(key, return_index=True, return_inverse=True)
            child = rest[first]
            parent[child], edge[child] = at[first], distance[first]
            stays = np.ones(len(rest), bool)
            stays[first] = False
            at, rest = child[slot][stays], rest[stays]
        hung = np.flatnonzero(parent >= 0)
        key = parent[hung] * (BITS + 1) + edge[hung]
        order = np.argsort(key, kind="stable")
        self.child, self.key = hung[order], key[order]

    def near(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (entry, nearby other entry of its shard), in portions."""
        for begin in range(0, len(self.prints), SEARCH):
            entry = np.arange(begin, min(begin + SEARCH, len(self.prints)))
            waiting = [(entry, self.root[entry])]
            while waiting:
                entry, node = waiting.pop()
                if len(entry) > SEARCH:
                    waiting += [(entry[SEARCH:], node[SEARCH:])]
                    entry, node = entry[:SEARCH], node[:SEARCH]
                distance = np.bitwise_count(self.prints[entry] ^ self.prints[node]).astype(np.int64)
                hit = (distance <= radius) & (entry != node)
                if hit.any():
                    yield entry[hit], node[hit]
                base = node * (BITS + 1)
                low = np.searchsorted(self.key, base + np.maximum(distance - radius, 0), "left")
                high = np.searchsorted(self.key, base + np.minimum(distance + radius, BITS), "right")
                count = high - low
                if count.any():
                    start = np.cumsum(count) - count
                    slot = np.repeat(low - start, count) + np.arange(count.sum())
                    waiting.append((np.repeat(entry, count), self.child[slot]))


def spanning(shard: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each linked entry with the first entry of its component inside the shard."""
    label = np.arange(len(prints))
    for a, b in Forest(shard, prints).near(radius):
        while True:
            low = np.minimum(label[a], label[b])
            high = np.maximum(label[a], label[b])
            open_ = low != high
            if not open_.any():
                break
            # Hang the higher label below the lower, then shorten all paths.
            np.minimum.at(label, high[open_], low[open_])
            while (label != label[label]).any():
                label = label[label]
    linked = np.flatnonzero(label != np.arange(len(label)))
    return linked, label[linked]


def _blocks(free: list[tuple[int, int]], parts: int) -> list[list[tuple[int, int]]]:
    """The free bit ranges (first, width) cut into `parts` blocks of about equal width."""
    bits = [b for first, width in free for b in range(first, first + width)]
    cut = [round(i * len(bits) / parts) for i in range(parts + 1)]
    out = []
    for a, b in zip(cut, cut[1:]):
        block: list[tuple[int, int]] = []
        for bit in bits[a:b]:
            if block and sum(block[-1]) == bit:
                block[-1] = (block[-1][0], block[-1][1] + 1)
            else:
                block.append((bit, 1))
        out.append(block)
    return out


def _value(block: list[tuple[int, int]]) -> Column:
    """Bits of a fingerprint inside a block, packed."""
    packed, at = F.lit(0).cast("bigint"), 0
    for first, width in block:
        part = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        packed = packed.bitwiseOR(F.shiftleft(part, at))
        at += width
    return packed


def sharded(prints: DataFrame, radius: int = MAX_BITS, limit: int = SHARD) -> DataFrame:
    """Rows (shard, fp): every link lies in a shard; none has more than `limit` entries
    unless all its bits are fixed but fewer than there are blocks."""
    parts = radius + 1
    whole = [(0, BITS)]
    done: list[DataFrame] = []
    # One frame for each way to fix blocks so far: its rows and the bits still free.
    level = [(prints.select("fp", F.lit(0).cast("bigint").alias("shard")), whole, 0)]
    while level:
        deeper = []
        for frame, free, depth in level:
            for i, block in enumerate(_blocks(free, parts)):
                if not block:
                    continue
                key = F.xxhash64(F.lit(depth), F.lit(i), "shard", _value(block))
                split = frame.select("fp", key.alias("shard"))
                fixed = {b for first, width in block for b in range(first, first + width)}
                left = _merge_bits(
                    [b for f, w in free for b in range(f, f + w) if b not in fixed]
                )
                crowded = split.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
                crowded = crowded.filter(F.col("n") > limit).select("shard")
                if sum(w for _, w in left) >= parts and crowded.limit(1).count():
                    # At most (entries / limit) shards can be crowded.
                    few = F.broadcast(crowded)
                    done.append(split.join(few, "shard", "left_anti").select("fp", "shard"))
                    big = stored(split.join(few, "shard", "left_semi").select("fp", "shard"), "big")
                    deeper.append((big, left, depth + 1))
                else:
                    done.append(split)
        level = deeper
    out = done[0]
    for frame in done[1:]:
        out = out.unionByName(frame)
    return out


def _merge_bits(bits: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for bit in bits:
        if out and sum(out[-1]) == bit:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((bit, 1))
    return out


def links(prints: DataFrame, radius: int = MAX_BITS, limit: int = SHARD) -> DataFrame:
    """(a, b): a forest over linked fingerprints; `prints` has distinct fingerprints `fp`."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"shard": [], "fp": []}, dtype="int64"), *batches])
        shard, fp = rows["shard"].to_numpy(np.int64), rows["fp"].to_numpy(np.int64)
        order = np.lexsort((fp, shard))
        shard, fp = shard[order], fp[order]
        new = np.append(True, (shard[1:] != shard[:-1]))[: len(shard)]
        linked, head = spanning(np.cumsum(new), fp.view(np.uint64), radius)
        yield pd.DataFrame({"a": fp[linked], "b": fp[head]})

    return sharded(prints, radius, limit).repartition("shard").mapInPandas(search, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(fp, component): the smallest fingerprint each linked fingerprint can reach."""
    star = stored(edges.select("a", "b").distinct(), "links")
    state = None
    while True:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        # Stored, so that the joins below shuffle both sides and a hub can be split as skew.
        least = stored(least.select("a", F.least("a", "m").alias("m")), "least")
        large = (
            both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        large = large.filter("a != b").distinct()
        # Small star: every entry's lower neighbours hang on the lowest of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = stored(down.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        small = (
            down.join(low, "a")
            .select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
            .select("e.a", F.col("e.m").alias("b"))
            .filter("a != b")
            .distinct()
        )
        star = stored(small, "stars")
        now = star.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now == state:
            return star.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "fp")
        state = now


def classes(rows: DataFrame, doc_id: str, fp: str, radius: int = MAX_BITS) -> DataFrame:
    """(fp, component, component_id): the smallest fingerprint each fingerprint reaches, and the
    smallest id of the documents there. Ids that repeat may name two components alike."""
    prints = stored(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least")), "prints")
    found = components(links(prints.select("fp"), radius))
    linked = prints.join(found, "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    ids = stored(linked.groupBy("component").agg(F.min("least").alias("component_id")), "ids")
    return linked.join(ids, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = stored(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "fingerprints")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(classes(rows, "doc_id", "fp"), "fp").select("doc_id", digits, "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest id; columns as given."""
    row = fresh(docs, "_row")
    keyed = with_row(docs, row)
    ids = stored(
        keyed.select(F.col(row).alias("row"), "doc_id", fingerprint(F.col("text")).alias("fp")),
        "fingerprints",
    )
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    kept = (
        ids.join(classes(ids, "doc_id", "fp"), "fp")
        .groupBy("component")
        .agg(F.min_by("row", order).alias(row))
    )
    return keyed.join(kept.select(row), row, "left_semi").select(*docs.columns)


