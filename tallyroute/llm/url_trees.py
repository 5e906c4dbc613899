"""URL filter: explicit rules first, gradient-boosted trees on lexical features for the rest.

The labelled URLs are those a rule decides. Features are lengths, depth, digit ratio, entropy,
parameter counts and statistics of the host's suffix (how often it occurs among labelled URLs and
how many of those are blocked). Trees are grown on histograms: labelled rows are binned and
counted once, every level of a tree is one aggregation of gradients by node, feature and bin,
and only those sums reach the driver. The model is a Spark expression.

Suffix statistics cover all labelled URLs; the `SUFFIXES` most frequent ones are kept, the others
share one entry. Trees are fitted on at most about `SAMPLE` labelled URLs, chosen by a hash of the
URL. All of it is DataFrame code.

Null URLs and those without `://` have empty host and path: no rule fits them, and the trees
judge them like any other. If no URL is labelled, or all in one way, the rest follows that way
(allow, if there is none). Repeated rows are judged each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroute.llm.common import fraction_for, in_sample, let, stored

# Rules as (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
SAMPLE = 200_000
SUFFIXES = 1_000
TREES, DEPTH, BINS, RATE, PENALTY, SMOOTH = 8, 3, 16, 0.3, 1.0, 20.0
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, UPPER, UPPER.lower()), F.regexp_extract(after, "^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        both = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, both).otherwise(found)
    return found


def _count(text: Column, mark: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)


def _entropy(text: Column) -> Column:
    """Bits a character in the text's own distribution; 0 for an empty text."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.transform(F.array_distinct(F.split(text, "")), lambda c: share(c) * F.log2(share(c)))
    seen = F.filter(bits, lambda b: b.isNotNull() & ~F.isnan(b))
    return F.when(n > 0, -F.aggregate(seen, F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)


FEATURES = (
    "length", "host_length", "path_length", "query_length", "depth", "labels", "digits",
    "host_digits", "hyphens", "entropy", "parameters", "longest", "suffix_share", "suffix_blocked",
)


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    """The features but the suffix statistics, as doubles."""
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    digits = lambda c: F.regexp_count(c, F.lit("[0-9]"))
    size = lambda c: F.greatest(F.length(c), F.lit(1))
    columns = [
        F.length(text),
        F.length(host),
        F.length(path),
        F.length(query),
        _count(path, "/"),
        _count(host, "."),
        digits(text) / size(text),
        digits(host) / size(host),
        _count(host, "-"),
        let(text, _entropy),
        F.when(F.length(query) > 0, _count(query, "&") + 1).otherwise(0),
        F.array_max(F.transform(F.split(host, r"\."), lambda part: F.length(part))),
    ]
    return [F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for c, n in zip(columns, FEATURES)]


def with_features(urls: DataFrame) -> DataFrame:
    """page_id, url, host, path, rule, verdict, suffix and the lexical features."""
    host, path = parts(F.col("url"))
    split = urls.select("page_id", "url", host.alias("host"), path.alias("path"))
    return split.select(
        "*",
        rule_of(F.col("host"), F.col("path")).alias("found"),
        F.substring_index("host", ".", -1).alias("suffix"),
        *lexical(F.col("url"), F.col("host"), F.col("path")),
    ).select("*", "found.rule", "found.verdict").drop("found")


def suffix_statistics(
    featured: DataFrame, keep: int = SUFFIXES
) -> tuple[DataFrame, float]:
    """(suffix, suffix_share, suffix_blocked) of the most frequent suffixes of labelled URLs,
    and the share of blocked ones among all labelled URLs."""
    labelled = featured.filter(F.col("verdict").isNotNull())
    counts = labelled.groupBy("suffix").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked")
    )
    total = counts.agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).first()
    n, blocked = total.n or 0, total.blocked or 0
    prior = blocked / n if n else 0.5
    rate = (F.col("blocked") + SMOOTH * prior) / (F.col("n") + SMOOTH)
    return (
        counts.orderBy(F.desc("n"), "suffix")
        .limit(keep)
        .select(
            "suffix",
            (F.col("n") / max(n, 1)).alias("suffix_share"),
            rate.alias("suffix_blocked"),
        )
    ), prior


def joined(featured: DataFrame, suffixes: DataFrame, prior: float) -> DataFrame:
    """`featured` with suffix statistics; `suffixes` has at most `SUFFIXES` rows."""
    return featured.join(F.broadcast(suffixes), "suffix", "left").fillna(
        {"suffix_share": 0.0, "suffix_blocked": prior}
    )


@dataclass
class Node:
    """A split (feature, threshold, low and high side) or a leaf (value)."""

    value: float = 0.0
    feature: str = ""
    threshold: float = 0.0
    sides: list[Node] = field(default_factory=list)

    def expression(self) -> Column:
        if not self.sides:
            return F.lit(self.value)
        low, high = (side.expression() for side in self.sides)
        return F.when(F.col(self.feature) <= self.threshold, low).otherwise(high)


def thresholds_of(rows: DataFrame, bins: int = BINS) -> dict[str, list[float]]:
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = rows.agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in FEATURES]).first()
    return {f: sorted(set(row[f] or [])) for f in FEATURES}


def _bin(feature: str, cuts: list[float]) -> Column:
    """Number of thresholds below the value."""
    number = F.lit(0)
    for cut in cuts:
        number = number + (F.col(feature) > cut).cast("int")
    return number


def boosted(rows: DataFrame, trees: int = TREES, depth: int = DEPTH) -> tuple[float, list[Node]]:
    """Starting margin and trees for the log-odds of `block`; `rows` has features and verdict."""
    cuts = thresholds_of(rows)
    used = [f for f in FEATURES if cuts[f]]
    bins = [_bin(f, cuts[f]).alias(f) for f in used]
    cells = stored(
        rows.select(*bins, (F.col("verdict") == "block").cast("long").alias("y"))
        .groupBy(*used)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("blocked")),
        "url-cells",
    )
    total = cells.agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).first()
    n, blocked = total.n or 0, total.blocked or 0
    start = math.log((blocked + 0.5) / (n - blocked + 0.5)) if n else -1.0
    if not used or blocked in (0, n):
        return start, []
    cells = cells.withColumn("margin", F.lit(start))
    grown: list[Node] = []
    for number in range(trees):
        tree = _grow(cells, used, cuts, depth)
        grown.append(tree)
        cells = cells.withColumn("margin", F.col("margin") + _on_bins(tree, cuts))
        if number % 3 == 2:
            cells = stored(cells, "url-margins")
    return start, grown


def _on_bins(node: Node, cuts: dict[str, list[float]]) -> Column:
    if not node.sides:
        return F.lit(node.value)
    low, high = (_on_bins(side, cuts) for side in node.sides)
    return F.when(F.col(node.feature) <= cuts[node.feature].index(node.threshold), low).otherwise(high)


def _grow(cells: DataFrame, used: list[str], cuts: dict, depth: int) -> Node:
    root = Node()
    leaves = {0: (root, F.lit(True))}
    p = 1 / (1 + F.exp(-F.col("margin")))
    pairs = ", ".join(f"'{f}', {f}" for f in used)
    for _ in range(depth):
        where = F.lit(None).cast("int")
        for number, (_, inside) in leaves.items():
            where = F.when(inside, number).otherwise(where)
        sums = (
            cells.select(
                *used,
                where.alias("node"),
                (F.col("n") * p - F.col("blocked")).alias("g"),
                (F.col("n") * p * (1 - p)).alias("h"),
            )
            .filter(F.col("node").isNotNull())
            .select("node", "g", "h", F.expr(f"stack({len(used)}, {pairs}) AS (feature, bin)"))
            .groupBy("node", "feature", "bin")
            .agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            .collect()
        )
        table: dict[tuple[int, str], list] = {}
        for r in sorted(sums, key=lambda r: (r.node, r.feature, r.bin)):
            table.setdefault((r.node, r.feature), []).append((r.bin, r.g, r.h))
        below: dict[int, tuple[Node, Column]] = {}
        for number, (node, inside) in leaves.items():
            rows = table.get((number, used[0]), [])
            g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
            node.value = _leaf(g, h)
            best = _best_split(number, used, cuts, table, g, h)
            if best:
                node.feature, at, low_g, low_h = best
                node.threshold = cuts[node.feature][at]
                node.sides = [Node(_leaf(low_g, low_h)), Node(_leaf(g - low_g, h - low_h))]
                low = F.col(node.feature) <= at
                below[2 * number + 1] = (node.sides[0], inside & low)
                below[2 * number + 2] = (node.sides[1], inside & ~low)
        leaves = below
        if not leaves:
            break
    return root


def _leaf(g: float, h: float) -> float:
    return -RATE * g / (h + PENALTY)


def _best_split(number, used, cuts, table, g, h) -> tuple[str, int, float, float] | None:
    best, gain = None, 1e-6
    for f in used:
        left_g = left_h = 0.0
        for at, bin_g, bin_h in table.get((number, f), []):
            left_g, left_h = left_g + bin_g, left_h + bin_h
            if at >= len(cuts[f]) or h - left_h < 1e-9:
                continue
            right_g, right_h = g - left_g, h - left_h
            now = (
                left_g**2 / (left_h + PENALTY) + right_g**2 / (right_h + PENALTY) - g**2 / (h + PENALTY)
            )
            if now > gain:
                best, gain = (f, at, left_g, left_h), now
    return best


def judged(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' score of every page."""
    featured = with_features(pages)
    suffixes, prior = suffix_statistics(featured)
    whole = joined(featured, stored(suffixes, "suffixes"), prior)
    labelled = whole.filter(F.col("verdict").isNotNull())
    share = fraction_for(labelled.select("suffix"), SAMPLE)
    start, trees = boosted(labelled.filter(in_sample("url", share, 11)))
    margin = F.lit(start)
    for tree in trees:
        margin = margin + tree.expression()
    score = 1 / (1 + F.exp(-margin))
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return whole.select("page_id", "host", "path", "rule", "verdict", score.alias("score")).select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "score"
    )
