"""Filters, aggregates, limits and pages over traffic tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyroute.constants import (
    COUNT_CODES,
    DESCRIPTIVE_COLUMNS,
    GRAINS,
    SAMPLE_DEFAULT,
    SAMPLE_MAX,
    SAMPLE_MIN,
    SITE_LEVEL,
    Grain,
)
from tallyroute.operators.routing import (
    concat_grains,
    join_keys,
    may_broadcast,
    segment_keys,
)
from tallyroute.plans.sizing import MAX_BROADCAST_ROWS
from tallyroute.sources.marts import PARTITION, public_columns
from tallyroute.sources.shared import written


def site_filter(table: DataFrame, site: str) -> DataFrame:
    return table.filter(F.col("co_regate") == site)


def multi_range_filter(
    table: DataFrame, grain: Grain, site: str, ranges: Sequence[tuple[str, str]]
) -> DataFrame:
    """Rows of one site under any of the inclusive key ranges.

    Keys begin with their year, so a stored table opens the years of the ranges only.
    """
    if not ranges:
        return table.limit(0)
    inside = reduce(or_, [F.col(grain.key).between(a, b) for a, b in ranges])
    years = [(a[:4], b[:4]) for a, b in ranges]
    if PARTITION in table.columns and all(y.isdecimal() and len(y) == 4 for ys in years for y in ys):
        year = F.col(PARTITION)
        table = table.filter(reduce(or_, [year.between(int(a), int(b)) for a, b in years]))
    return site_filter(table, site).filter(inside)


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """Each (request_id, co_regate)'s inclusive key ranges merged where they overlap.

    A null cle_debut or cle_fin is an open end. Ranges that touch without overlapping stay apart;
    a reversed range (start after end) holds no key and is dropped. Gaps and islands: a range
    opens a new island when it starts after every end seen before it in start order.
    """
    low, high = F.lit(""), F.lit("\uffff")
    start = F.coalesce("cle_debut", low)
    end = F.coalesce("cle_fin", high)
    valid = ranges.select("request_id", "co_regate", start.alias("a"), end.alias("b")).filter("a <= b")
    group = Window.partitionBy("request_id", "co_regate")
    ordered = group.orderBy("a", "b")
    seen = ordered.rowsBetween(Window.unboundedPreceding, -1)
    islands = (
        valid.withColumn("_reach", F.max("b").over(seen))
        .withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("a") > F.col("_reach")), 1).otherwise(0))
        .withColumn("_island", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    )
    return islands.groupBy("request_id", "co_regate", "_island").agg(
        F.min("a").alias("cle_debut"), F.max("b").alias("cle_fin")
    ).drop("_island")


def ranges_filter(table: DataFrame, grain: Grain, ranges: DataFrame) -> DataFrame:
    """Rows of the table under any range of each request, once per request: request_id first.

    `ranges` holds (request_id, co_regate, cle_debut, cle_fin), inclusive, null for an open end,
    many sites and requests at once. An interval join: the ranges of a request and site are merged,
    cut at the years their keys begin with (open ends at the years the table holds) and joined on
    (site, year) with the range as residual condition, so no nested loop is planned and the join
    on the storage year prunes partitions. The cut ranges are broadcast under the size bound,
    else both sides are shuffled on (site, year).
    """
    merged = merged_ranges(ranges)
    years = table.agg(F.min(PARTITION).alias("lo"), F.max(PARTITION).alias("hi")).first()
    if years["lo"] is None:
        return table.limit(0).select(F.lit(None).cast("long").alias("request_id"), *public_columns(table).columns)
    first = F.when(F.col("cle_debut") == "", F.lit(years["lo"])).otherwise(
        F.substring("cle_debut", 1, 4).cast("int")
    )
    last = F.when(F.col("cle_fin") == "\uffff", F.lit(years["hi"])).otherwise(
        F.substring("cle_fin", 1, 4).cast("int")
    )
    bins = merged.select(
        "request_id",
        F.col("co_regate").alias("_site"),
        F.col("cle_debut").alias("_a"),
        F.col("cle_fin").alias("_b"),
        F.explode(
            F.sequence(F.greatest(first, F.lit(years["lo"])), F.least(last, F.lit(years["hi"])))
        ).alias("_year"),
    ).filter(F.col("_year").isNotNull())
    n_bins = bins.count()
    side = F.broadcast(bins) if n_bins <= MAX_BROADCAST_ROWS else bins
    on = (
        (F.col("co_regate") == F.col("_site"))
        & (F.col(PARTITION) == F.col("_year"))
        & F.col(grain.key).between(F.col("_a"), F.col("_b"))
    )
    joined = table.join(side, on)
    return joined.select("request_id", *public_columns(table).columns)


def level_filter(table: DataFrame, level: str = SITE_LEVEL) -> DataFrame:
    return table.filter(F.col("co_niveau_regroupement_operationnel") == level)


def product_filter(table: DataFrame, codes: Sequence[str] = COUNT_CODES) -> DataFrame:
    return table.filter(F.col("co_comptage").isin(list(codes)))


def harmonise_grain(table: DataFrame, grain: Grain) -> DataFrame:
    """A grain in the column set common to all three."""
    kept = [c for c in (PARTITION,) if c in table.columns]
    return table.select(
        F.lit(grain.name).alias("periode"),
        *DESCRIPTIVE_COLUMNS,
        F.col(grain.key).alias("cle_comptage"),
        F.col(grain.measure).alias("nb_objet_trafic_reel"),
        *kept,
    )


def table_preview(
    table: DataFrame,
    grain: Grain,
    limit: int = SAMPLE_DEFAULT,
    site: str | None = None,
    key: str | None = None,
) -> DataFrame:
    """First rows of a table, for one site and date key if given, in key order."""
    if site is not None:
        table = site_filter(table, site)
    if key is not None:
        table = table.filter(F.col(grain.key) == key)
        if PARTITION in table.columns and key[:4].isdecimal() and len(key) >= 4:
            table = table.filter(F.col(PARTITION) == int(key[:4]))
    return public_columns(table).orderBy(grain.key, *DESCRIPTIVE_COLUMNS).limit(limit)


def _kept(table: DataFrame) -> DataFrame:
    return product_filter(level_filter(table))


def _per_key(
    segments: DataFrame,
    marts: dict[str, DataFrame],
    grains: dict[str, Grain],
    groups: list[str],
    measure,
    filtered: bool,
    broadcast: bool | None,
) -> DataFrame:
    """Grain aggregates joined to the requests that cover their key.

    A key belongs to a request whole or not at all, so the traffic is
    aggregated once, before the join, not once per request. The traffic no
    request touches is dropped first. Without a broadcast the remaining rows are
    shuffled once, on the join key: the aggregate and the join both keep it.
    """
    if broadcast is None:
        broadcast = may_broadcast(segments)
    parts = {}
    for name, grain in grains.items():
        table = _kept(marts[name]) if filtered else marts[name]
        keys = segment_keys(segments, grain)
        on = ["co_regate", grain.key] + [c for c in (PARTITION,) if c in table.columns]
        touched = keys.select(*on).distinct()
        touched = F.broadcast(touched) if broadcast else touched.hint("merge")
        table = table.join(touched, on, "left_semi")
        by = [*on, *[c for c in groups if c not in on]]
        sums = table.groupBy(*by).agg(measure(grain))
        joined = join_keys(sums, keys, grain, broadcast)
        parts[name] = joined.withColumnRenamed(grain.key, "cle_comptage")
    return concat_grains(parts)


def traffic_group_sum(
    segments: DataFrame,
    marts: dict[str, DataFrame],
    grains: dict[str, Grain] = GRAINS,
    broadcast: bool | None = None,
) -> DataFrame:
    """Site-level traffic of the known codes, summed by key and description."""
    sums = _per_key(
        segments,
        marts,
        grains,
        DESCRIPTIVE_COLUMNS,
        lambda g: F.sum(g.measure).alias("nb_objet_trafic_reel"),
        True,
        broadcast,
    )
    return sums.select(
        "request_id", "periode", "cle_comptage", *DESCRIPTIVE_COLUMNS, "nb_objet_trafic_reel"
    )


def _row_counts(
    segments, marts, grains, filtered, broadcast, limit=None
) -> DataFrame:
    counts = _per_key(
        segments,
        marts,
        grains,
        [],
        lambda g: F.count(F.lit(1)).alias("lignes"),
        filtered,
        broadcast,
    )
    total = F.sum("lignes").alias("lignes")
    if limit is not None:
        counts = counts.groupBy("request_id", "periode").agg(
            F.least(F.sum("lignes"), F.lit(limit)).alias("lignes")
        )
    return counts.groupBy("request_id").agg(total)


def _complete(requests: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    found = F.coalesce("lignes", F.lit(0)).cast("bigint").alias(name)
    return requests.join(counts, "request_id", "left").select(*requests.columns, found)


def traffic_count_only(
    requests: DataFrame,
    segments: DataFrame,
    marts: dict[str, DataFrame],
    grains: dict[str, Grain] = GRAINS,
    broadcast: bool | None = None,
) -> DataFrame:
    """Source rows of the filtered query, per request; 0 when nothing matches."""
    counts = _row_counts(segments, marts, grains, True, broadcast)
    return _complete(requests, counts, "total")


def result_count(
    requests: DataFrame,
    segments: DataFrame,
    marts: dict[str, DataFrame],
    grains: dict[str, Grain] = GRAINS,
    broadcast: bool | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Rows `route_traffic` returns for each request; 0 when there are none.

    With `limit`, the rows left when each grain returns at most that many.
    """
    counts = _row_counts(segments, marts, grains, False, broadcast, limit)
    return _complete(requests, counts, "count")


def _result_order(routed: DataFrame) -> list[str]:
    """Keys, then all other columns: rows that tie are alike, whatever the table carries."""
    keys = ["da_comptage", "co_semaine_comptage", "co_mois_comptage", "cle_comptage"]
    first = [c for c in [*keys, *DESCRIPTIVE_COLUMNS] if c in routed.columns]
    return first + [c for c in routed.columns if c not in first and c != "request_id"]


def limit_per_grain(routed: DataFrame, limit: int) -> DataFrame:
    """At most `limit` rows of each grain for each request; 0 keeps none."""
    if limit < 0:
        raise ValueError("limit starts at 0")
    if limit == 0:
        return routed.limit(0)
    order = _result_order(routed)
    keys = [c for c in order if c in _KEY_COLUMNS]
    rows = Window.partitionBy("request_id", "periode").orderBy(*order)
    ranked = _of_first_keys(routed, keys, limit).withColumn("rang", F.row_number().over(rows))
    return ranked.filter(F.col("rang") <= limit).drop("rang")


def _of_first_keys(routed: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Rows under the first keys of each (request, grain) that together hold `limit` rows or all.

    Rows are counted per key, so that only those of a few keys are sorted whole. The keys found are
    stored: their number tells whether they may be broadcast. Else they are hashed, not sorted.
    """
    if not keys:
        return routed
    by = ["request_id", "periode", *keys]
    counts = routed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = (
        Window.partitionBy("request_id", "periode")
        .orderBy(*keys)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    first = counts.withColumn("_avant", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(
        F.col("_avant") < limit
    )
    first = written(first.select(*[F.col(c).alias(f"_cle_{c}") for c in by]), "first-keys")
    few = first.count() <= MAX_BROADCAST_ROWS
    first = F.broadcast(first) if few else first.hint("shuffle_hash")
    same = [routed[c].eqNullSafe(first[f"_cle_{c}"]) for c in by]
    return routed.join(first, reduce(lambda a, b: a & b, same), "left_semi")


def paginate_result(routed: DataFrame, page: int, page_size: int) -> DataFrame:
    """Page `page`, from 1, of each request's whole result.

    A page locator: rows are counted per (request, grain, key), and the running counts in result
    order tell which keys hold the page's rows; only the rows of those keys are ranked, from the
    count before their key on. A deep page sorts a page's keys, not the request's whole result.
    A request lists at most some 56 keys, so the counts are few.
    """
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    order = _result_order(routed)
    keys = ["periode", *[c for c in order if c in _KEY_COLUMNS]]
    rest = [c for c in order if c not in keys]
    last = page * page_size
    counts = routed.groupBy("request_id", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("request_id").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    located = (
        counts.withColumn("_avant", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .filter((F.col("_avant") < last) & (F.col("_avant") + F.col("_n") > last - page_size))
        .select(*[F.col(c).alias(f"_loc_{c}") for c in ["request_id", *keys]], "_avant")
    )
    same = [routed[c].eqNullSafe(located[f"_loc_{c}"]) for c in ["request_id", *keys]]
    picked = routed.join(located, reduce(lambda a, b: a & b, same)).drop(
        *[f"_loc_{c}" for c in ["request_id", *keys]]
    )
    inside = Window.partitionBy("request_id", *keys).orderBy(*rest)
    ranked = picked.withColumn("rang", (F.col("_avant") + F.row_number().over(inside)).cast("int")).drop("_avant")
    return ranked.filter(F.col("rang") <= last).filter(F.col("rang") > last - page_size)


_KEY_COLUMNS = ("da_comptage", "co_semaine_comptage", "co_mois_comptage", "cle_comptage")


def table_sample(
    spark: SparkSession,
    table: str,
    limit: int = SAMPLE_DEFAULT,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """First rows of a named table in the given order, or any rows without one."""
    if not SAMPLE_MIN <= limit <= SAMPLE_MAX:
        raise ValueError(f"limit must lie between {SAMPLE_MIN} and {SAMPLE_MAX}")
    if not spark.catalog.tableExists(table):
        raise LookupError(f"no table named {table!r}")
    rows = spark.table(table)
    return (rows.orderBy(*order) if order else rows).limit(limit)
