"""Spelling variants: words one edit apart, each pointing at a much more frequent form.

Words: maximal runs of `[A-Za-zÀ-ÿ]` of every text, only A-Z lower-cased. A run whose
crc32 of `<doc_id>:<run>` (UTF-8, unsigned) is divisible by 199 loses its code point at
crc % length (a planted misspelling). Words are the distinct results of at least `MIN_LENGTH` code
points and at least `MIN_COUNT` occurrences (n) over all documents.

Two words are near if one insertion, deletion or replacement turns one into the other. A word's
form is its near word of largest n (ties: smallest in code-point order) if that n is at least
`FACTOR` times its own; root follows forms to the end (n grows at least fivefold a step, so chains
are short and end).

Method, dense prefix-suffix tiling. For a pair of lengths L and L or L + 1, the edit sits either
at or after h = L // 2, and then both share their first h code points, or before it, and then both
share their last L - h. So each word is put into at most four blocks (prefix or suffix key, for L
its own length or one less). A block is cut into tiles whose size keeps a tile pair's code-point
matrix under `CELLS`; every tile pair is one group. There the words become padded code-point
matrices, and all pairs are compared at once: common prefix plus common suffix reaching the longer
length minus one is a single edit. A pair sharing its prefix key is found in the prefix block only,
so each pair comes out once. Hot blocks (one key shared by many words) become many tile pairs on
many tasks; no pair list of a block is built.

Edge cases: null texts have no runs; a null doc_id hashes as no text (no deletion); empty tables
give no rows; repeated rows count twice; extra columns of any name are ignored; a word of any
length only meets words of its own length and one more, in tiles sized by that length.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroute.llm.common import stored

# Fixed values of the contract.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH = 6
MIN_COUNT = 5
FACTOR = 5
NOISE = 199

#: Cells (pairs times code points) of one tile pair's comparison, which sets the tile size.
CELLS = 4_000_000


def noised_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all runs of all texts after the planted deletions, before any length cut."""
    runs = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.explode(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(RUN), 0)).alias("run"),
    ).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id"), F.lit(":"), F.col("run")).cast("binary"))
    at = h % F.length("run")
    word = F.when(
        (h % NOISE) == 0,
        F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.length("run"))),
    ).otherwise(F.col("run"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _tile_words(length: Column) -> Column:
    """Words of a tile for block length L: a tile pair compares at most CELLS code points."""
    return F.greatest(F.lit(1), F.floor(F.sqrt(F.lit(float(CELLS)) / (length + 1))))


def _blocks(words: DataFrame) -> DataFrame:
    """Each word in its blocks: kind, L, key, short (its length is L), word, n."""
    size = F.length("word")
    entries = []
    for shift, short in ((0, True), (1, False)):
        ell = size - shift
        half = F.floor(ell / 2).cast("int")
        for kind in ("p", "s"):
            key = (
                F.substring("word", F.lit(1), half)
                if kind == "p"
                else F.expr(f"substring(word, -(length(word) - {shift} - floor((length(word) - {shift}) / 2)))")
            )
            entries.append(
                F.when(
                    ell >= MIN_LENGTH,
                    F.struct(F.lit(kind).alias("kind"), ell.alias("L"), key.alias("key"), F.lit(short).alias("short")),
                )
            )
    return words.select("word", F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("b")).select(
        F.col("b.kind").alias("kind"), F.col("b.L").alias("L"), F.col("b.key").alias("key"), F.col("b.short").alias("short"), "word"
    )


def _codes(words: list[str], width: int, right: bool, pad: int) -> np.ndarray:
    """Padded code-point matrix, left- or right-aligned."""
    out = np.full((len(words), width), pad, dtype=np.int32)
    for i, w in enumerate(words):
        c = np.frombuffer(w.encode("utf-32-le"), dtype=np.int32)
        if right:
            out[i, width - len(c):] = c
        else:
            out[i, : len(c)] = c
    return out


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common leading run of every row pair of two padded matrices."""
    return np.cumprod(x[:, None, :] == y[None, :, :], axis=2, dtype=np.int8).sum(axis=2, dtype=np.int32)


def single_edits(xs: list[str], ys: list[str]) -> np.ndarray:
    """Boolean matrix: xs[i] and ys[j] are one insertion, deletion or replacement apart."""
    if not xs or not ys:
        return np.zeros((len(xs), len(ys)), dtype=bool)
    lx = np.array([len(w) for w in xs])
    ly = np.array([len(w) for w in ys])
    width = int(max(lx.max(), ly.max()))
    prefix = _common(_codes(xs, width, False, -1), _codes(ys, width, False, -2))
    suffix = _common(
        _codes(xs, width, True, -1)[:, ::-1], _codes(ys, width, True, -2)[:, ::-1]
    )
    longer = np.maximum(lx[:, None], ly[None, :])
    close = np.abs(lx[:, None] - ly[None, :]) <= 1
    differ = ~((lx[:, None] == ly[None, :]) & (prefix == lx[:, None]))
    return close & differ & (prefix + suffix >= longer - 1)


def _pairs_of(kind, half, xs, ys, hit, same, found):
    for i, j in zip(*np.nonzero(hit)):
        a, b = xs[i], ys[j]
        if same and len(a) == len(b) and a > b:
            continue  # a pair of short words of one tile is met twice
        if kind[i] == "s" and a[:half] == b[:half]:
            continue  # found in the prefix block
        found.append((a, b) if (len(a), a) < (len(b), b) else (b, a))


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Near pairs of one group: a bucket of small blocks of one length, or a tile pair of a big one."""
    ell = int(pdf["L"].iat[0])
    half = ell // 2
    found: list[tuple[str, str]] = []
    if pdf["nt"].iat[0] == 1:
        # Small blocks packed together: one dense comparison, pairs kept within a block.
        block = (pdf["kind"] + "\x00" + pdf["key"]).to_numpy()
        short = pdf["short"].to_numpy(dtype=bool)
        xs_all = pdf["word"].tolist()
        xs = [w for w, k in zip(xs_all, short) if k]
        hit = single_edits(xs, xs_all) & (block[short][:, None] == block[None, :])
        _pairs_of(pdf["kind"].to_numpy()[short], half, xs, xs_all, hit, True, found)
        return pd.DataFrame(found, columns=["a", "b"])
    t1, t2 = int(pdf["t1"].iat[0]), int(pdf["t2"].iat[0])
    first = pdf[pdf["t"] == t1]
    second = pdf[pdf["t"] == t2]
    plans = [(first[first["short"]], second, t1 == t2)]
    if t1 != t2:
        plans.append((second[second["short"]], first[~first["short"]], False))
    for xs_df, ys_df, same in plans:
        xs, ys = xs_df["word"].tolist(), ys_df["word"].tolist()
        _pairs_of(xs_df["kind"].to_numpy(), half, xs, ys, single_edits(xs, ys), same, found)
    return pd.DataFrame(found, columns=["a", "b"])


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair of near words once: (a, b) with a the shorter, or the smaller of equal length.

    A block of at most one tile's words is small: the small blocks of one length share buckets of
    about a tile's words, compared in one call. A bigger block is cut into hashed tiles, one call
    per tile pair.
    """
    blocks = stored(_blocks(words), "spelling-blocks")
    per_tile = _tile_words(F.col("L"))
    sizes = stored(
        blocks.groupBy("kind", "L", "key")
        .agg(F.count(F.lit(1)).alias("size"))
        .filter("size > 1")
        .withColumn("nt", F.ceil(F.col("size") / per_tile).cast("int")),
        "spelling-sizes",
    )
    small_words = sizes.filter("nt = 1").groupBy("L").agg(F.sum("size").alias("_in_small"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("_in_small") / per_tile)).cast("long")
    tiled = (
        blocks.join(sizes, ["kind", "L", "key"])
        .join(small_words, "L", "left")
        .withColumn("t", F.pmod(F.xxhash64("word"), F.col("nt")).cast("int"))
        .withColumn(
            "u",
            F.explode(F.when(F.col("nt") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("nt") - 1))),
        )
        .select(
            "kind", "L", "key", "short", "word", "t", "nt",
            F.least("t", "u").alias("t1"), F.greatest("t", "u").alias("t2"),
            F.when(
                F.col("nt") == 1, F.concat(F.lit("b"), F.pmod(F.xxhash64("kind", "key"), buckets).cast("string"))
            ).otherwise(F.concat(F.lit("t"), F.col("kind"), F.lit("\x00"), F.col("key"))).alias("_group"),
        )
    )
    return tiled.groupBy("L", "_group", "t1", "t2").applyInPandas(_compare, "a string, b string")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word (see the module docstring)."""
    counted = noised_words(docs)
    words = stored(
        counted.filter((F.length("word") >= MIN_LENGTH) & (F.col("n") >= MIN_COUNT)), "spelling-words"
    )
    pairs = stored(near_pairs(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"))
    )
    other_n = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = (
        both.join(other_n, "other")
        .groupBy("word")
        .agg(
            F.count(F.lit(1)).alias("n_near"),
            F.min(F.struct((-F.col("other_n")).alias("neg"), F.col("other"))).alias("top"),
        )
    )
    table = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("top.neg") >= FACTOR * F.col("n"), F.col("top.other")).alias("form"),
        F.when(-F.col("top.neg") >= FACTOR * F.col("n"), -F.col("top.neg")).cast("long").alias("form_n"),
    )
    table = stored(table, "spelling-forms")
    return _with_roots(table)


def _with_roots(table: DataFrame) -> DataFrame:
    """Adds root: forms followed to the end by pointer doubling, one stored table a round."""
    steps = table.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        hop = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = steps.join(hop, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")
        )
        moved = stored(moved, "spelling-roots")
        if moved.filter("moved").limit(1).count() == 0:
            steps = moved.select("word", "root")
            break
        steps = moved.select("word", "root")
    return table.join(steps, "word").select(
        "word", "form", "root", F.col("n").cast("long").alias("n"), "n_near", "form_n"
    )
