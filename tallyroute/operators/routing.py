"""Interval routing: which part of a request is read from which grain.

A request is a row `request_id, co_regate, dt_debut, dt_fin`. It is cut into
segments (`periode, seg_debut, seg_fin`): whole months in the middle, whole ISO
weeks around them, single days for the rest. Each segment then becomes the list
of keys to read, and every grain is read once with a plain equality join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroute.constants import (
    AUTO_MODE,
    DEFAULT_CATALOG,
    DEFAULT_SCHEMA,
    DESCRIPTIVE_COLUMNS,
    GRAINS,
    Grain,
)
from tallyroute.functions.dates import (
    key_year,
    month_first,
    period_key,
    period_starts,
)
from tallyroute.plans.sizing import MAX_BROADCAST_ROWS
from tallyroute.sources.marts import PARTITION

ROUTED_COLUMNS = [
    "request_id",
    "periode",
    *DESCRIPTIVE_COLUMNS,
    "da_comptage",
    "co_annee_comptage",
    "co_semaine_comptage",
    "da_lundi_semaine_comptage",
    "co_mois_comptage",
    "trafic_reel",
    "nb_objet_retenu",
]


def _segment(periode: str, first: Column, last: Column) -> Column:
    return F.struct(
        F.lit(periode).alias("periode"), first.alias("seg_debut"), last.alias("seg_fin")
    )


def _whole_weeks(first: str, last: str, prefix: str) -> dict[str, Column]:
    """Columns with the first Monday and the last Sunday of [first, last]."""
    a, b = F.col(first), F.col(last)
    return {
        f"{prefix}_lundi": F.date_add(a, F.pmod(7 - F.weekday(a), F.lit(7))),
        f"{prefix}_dimanche": F.date_sub(b, F.pmod(F.weekday(b) + 1, F.lit(7))),
    }


def _week_day_segments(first: str, last: str, prefix: str) -> list[Column]:
    """Head days, whole weeks and tail days of [first, last], possibly empty."""
    a, b = F.col(first), F.col(last)
    monday, sunday = F.col(f"{prefix}_lundi"), F.col(f"{prefix}_dimanche")
    has_week = monday < sunday
    return [
        _segment("jours", a, F.when(has_week, F.date_sub(monday, 1)).otherwise(b)),
        _segment("semaines", F.when(has_week, monday), sunday),
        _segment("jours", F.when(has_week, F.date_add(sunday, 1)), b),
    ]


def _not_empty(segment: Column) -> Column:
    # A range with a NULL bound is as absent as one that ends before it starts.
    return F.coalesce(segment["seg_debut"] <= segment["seg_fin"], F.lit(False))


def decompose_weeks_days(intervals: DataFrame, first: str, last: str) -> DataFrame:
    """Segments of each interval using whole weeks and days only."""
    keep = [c for c in intervals.columns if c not in (first, last)]
    weeks = intervals.withColumns(_whole_weeks(first, last, "_s"))
    segments = F.array(*_week_day_segments(first, last, "_s"))
    return weeks.select(*keep, F.inline(segments)).filter("seg_debut <= seg_fin")


def _bounded(requests: DataFrame) -> tuple[DataFrame, Column]:
    """Requests with their bounds worked out, and the array of their segments.

    The segments are in date order, some of them empty. The array is for use
    inside a generator: as a column, Spark would filter on its size first.
    """
    first, last = F.col("dt_debut"), F.col("dt_fin")
    month_start = F.when(F.dayofmonth(first) == 1, first).otherwise(
        F.date_add(F.last_day(first), 1)
    )
    month_end = F.when(last == F.last_day(last), last).otherwise(
        F.date_sub(month_first(last), 1)
    )
    # Each step is its own projection, so that no date is worked out twice.
    months = requests.select("request_id", "co_regate", first, last).withColumns(
        {"_mois_debut": month_start, "_mois_fin": month_end}
    )
    start, end = F.col("_mois_debut"), F.col("_mois_fin")
    has_month = start <= end
    sides = months.withColumns(
        {
            "_avant": F.when(has_month, F.date_sub(start, 1)).otherwise(last),
            "_apres": F.when(has_month, F.date_add(end, 1)),
            "_mois_debut": F.when(has_month, start),
        }
    )
    weeks = sides.withColumns(
        {**_whole_weeks("dt_debut", "_avant", "_g"), **_whole_weeks("_apres", "dt_fin", "_d")}
    )
    segments = F.array(
        *_week_day_segments("dt_debut", "_avant", "_g"),
        _segment("mois", start, end),
        *_week_day_segments("_apres", "dt_fin", "_d"),
    )
    return weeks, segments


def decompose_auto(requests: DataFrame) -> DataFrame:
    """Segments of each request using months, weeks and days."""
    bounded, segments = _bounded(requests)
    cut = bounded.select("request_id", "co_regate", F.inline(segments))
    return cut.filter("seg_debut <= seg_fin")


def build_segments(requests: DataFrame) -> DataFrame:
    """Segments of requests that name their mode: a fixed grain or `auto`."""
    automatic = decompose_auto(requests.filter(F.col("mode") == AUTO_MODE))
    fixed = requests.filter(F.col("mode") != AUTO_MODE).select(
        "request_id",
        "co_regate",
        F.col("mode").alias("periode"),
        F.col("dt_debut").alias("seg_debut"),
        F.col("dt_fin").alias("seg_fin"),
    )
    return automatic.unionByName(fixed)


def _keyed(day: Column, grains: dict[str, Grain]) -> Column:
    return F.coalesce(
        *[F.when(F.col("periode") == g.name, period_key(day, g)) for g in grains.values()]
    )


def with_period_keys(segments: DataFrame, grains: dict[str, Grain] = GRAINS) -> DataFrame:
    """Segments with the key texts of their two bounds."""
    return segments.select(
        "*",
        _keyed(F.col("seg_debut"), grains).alias("cle_debut"),
        _keyed(F.col("seg_fin"), grains).alias("cle_fin"),
    )


def segments_by_grain(requests: DataFrame, grains: dict[str, Grain] = GRAINS) -> DataFrame:
    """One row per request and grain it reads: the key ranges, in order.

    The segments of a request never leave its row, so nothing is shuffled.
    """

    bounded, segments = _bounded(requests)

    def ranges(grain: Grain) -> Column:
        mine = F.filter(segments, lambda s: (s["periode"] == grain.name) & _not_empty(s))
        return F.transform(
            mine,
            lambda s: F.struct(
                period_key(s["seg_debut"], grain).alias("cle_debut"),
                period_key(s["seg_fin"], grain).alias("cle_fin"),
            ),
        )

    rows = F.array(
        *[F.struct(F.lit(g.name).alias("periode"), ranges(g).alias("plages")) for g in grains.values()]
    )
    read = bounded.select("request_id", "co_regate", F.inline(rows))
    return read.filter(F.size("plages") > 0)


def routing_preview(
    segments: DataFrame,
    grains: dict[str, Grain] = GRAINS,
    catalog: str = DEFAULT_CATALOG,
    schema: str = DEFAULT_SCHEMA,
) -> DataFrame:
    """The table and key range each segment would read; no traffic is scanned."""
    table = F.coalesce(
        *[
            F.when(F.col("periode") == g.name, F.lit(f"{catalog}.{schema}.{g.table}"))
            for g in grains.values()
        ]
    )
    return with_period_keys(segments, grains).select(
        "request_id", "co_regate", "periode", table.alias("table_lue"), "cle_debut", "cle_fin"
    )


def segment_keys(segments: DataFrame, grain: Grain) -> DataFrame:
    """One row per key of `grain` that a request has to read."""
    day = F.col("jour_cle")
    return (
        segments.filter(F.col("periode") == grain.name)
        .select(
            "request_id",
            "co_regate",
            F.explode(period_starts(F.col("seg_debut"), F.col("seg_fin"), grain)).alias("jour_cle"),
        )
        .select(
            "request_id",
            "co_regate",
            period_key(day, grain).alias(grain.key),
            key_year(day, grain).alias(PARTITION),
        )
    )


def may_broadcast(segments: DataFrame) -> bool:
    """Whether the keys all segments stand for are few enough to broadcast.

    The number is worked out from the dates of each segment and summed: one pass
    over the requests, the only job an operator starts. Weeks may count one too many.
    """
    first, last = F.col("seg_debut"), F.col("seg_fin")
    days = F.datediff(last, first) + 1
    months = (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first) + 1
    keys = (
        F.when(F.col("periode") == "mois", months)
        .when(F.col("periode") == "semaines", F.floor(days / 7) + 2)
        .otherwise(days)
    )
    total = segments.agg(F.sum(F.greatest(keys.cast("bigint"), F.lit(0)))).first()[0]
    return (total or 0) <= MAX_BROADCAST_ROWS


def join_keys(table: DataFrame, keys: DataFrame, grain: Grain, broadcast: bool) -> DataFrame:
    """Rows of a grain under the requested keys, each with its request.

    Every pair the join forms is a result row, whatever the skew of the sites.
    Beyond the broadcast bound both sides are shuffled on (site, key), which
    spreads a dominant site over its keys and lets AQE split what is left.
    """
    on = ["co_regate", grain.key] + [c for c in (PARTITION,) if c in table.columns]
    keys = keys.select("request_id", *on)
    return table.join(F.broadcast(keys) if broadcast else keys.hint("merge"), on)


def concat_grains(parts: dict[str, DataFrame]) -> DataFrame:
    """One table of the three grains; a column a grain lacks is NULL there."""
    tagged = [df.withColumn("periode", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).drop(PARTITION)


def route_traffic(
    segments: DataFrame,
    marts: dict[str, DataFrame],
    grains: dict[str, Grain] = GRAINS,
    broadcast: bool | None = None,
) -> DataFrame:
    """Traffic rows of every request, each grain read once.

    `broadcast=None` counts the keys of the segments to choose the join.
    """
    if broadcast is None:
        broadcast = may_broadcast(segments)
    parts = {
        name: join_keys(marts[name], segment_keys(segments, grain), grain, broadcast)
        for name, grain in grains.items()
    }
    routed = concat_grains(parts)
    known = [c for c in ROUTED_COLUMNS if c in routed.columns]
    return routed.select(*known, *[c for c in routed.columns if c not in known])
