import calendar
import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyroute.constants import GRAINS, MOIS, Grain
from tallyroute.operators import routing, traffic
from tallyroute.plans import inputs

DAY = timedelta(days=1)


def requests_frame(spark, intervals, site="1"):
    rows = [(i, site, a, b) for i, (a, b) in enumerate(intervals)]
    return spark.createDataFrame(
        rows, "request_id long, co_regate string, dt_debut date, dt_fin date"
    )


def segments_of(df):
    found = defaultdict(list)
    for r in df.collect():
        found[r.request_id].append((r.periode, r.seg_debut, r.seg_fin))
    return {k: sorted(v, key=lambda s: s[1]) for k, v in found.items()}


def month_end(d):
    return d.replace(day=calendar.monthrange(d.year, d.month)[1])


def label_days(a, b):
    """Grain of each day of [a, b], day by day."""

    def whole_month(d):
        return d.replace(day=1) >= a and month_end(d) <= b

    labels = {}
    for n in range((b - a).days + 1):
        d = a + n * DAY
        monday = d - d.weekday() * DAY
        week = [monday + i * DAY for i in range(7)]
        if whole_month(d):
            labels[d] = "mois"
        elif all(a <= w <= b and not whole_month(w) for w in week):
            labels[d] = "semaines"
        else:
            labels[d] = "jours"
    return labels


GOLDEN = {
    ("2025-01-01", "2025-12-31"): [("mois", "2025-01-01", "2025-12-31")],
    ("2025-01-15", "2025-04-20"): [
        ("jours", "2025-01-15", "2025-01-19"),
        ("semaines", "2025-01-20", "2025-01-26"),
        ("jours", "2025-01-27", "2025-01-31"),
        ("mois", "2025-02-01", "2025-03-31"),
        ("jours", "2025-04-01", "2025-04-06"),
        ("semaines", "2025-04-07", "2025-04-20"),
    ],
    ("2025-01-20", "2025-01-26"): [("semaines", "2025-01-20", "2025-01-26")],
    ("2024-12-25", "2025-01-12"): [
        ("jours", "2024-12-25", "2024-12-29"),
        ("semaines", "2024-12-30", "2025-01-12"),
    ],
    ("2025-01-01", "2025-01-15"): [
        ("jours", "2025-01-01", "2025-01-05"),
        ("semaines", "2025-01-06", "2025-01-12"),
        ("jours", "2025-01-13", "2025-01-15"),
    ],
    ("2025-01-31", "2025-01-31"): [("jours", "2025-01-31", "2025-01-31")],
    ("2025-02-03", "2025-03-02"): [("semaines", "2025-02-03", "2025-03-02")],
    ("2024-02-01", "2024-02-29"): [("mois", "2024-02-01", "2024-02-29")],
}


def test_golden_decompositions(spark):
    intervals = [tuple(map(date.fromisoformat, k)) for k in GOLDEN]
    found = segments_of(routing.decompose_auto(requests_frame(spark, intervals)))
    for i, expected in enumerate(GOLDEN.values()):
        assert [(p, str(a), str(b)) for p, a, b in found[i]] == expected


def test_segments_tile_every_interval(spark):
    rng = random.Random(7)
    intervals = []
    for _ in range(600):
        a = date(2018, 12, 20) + rng.randrange(2500) * DAY
        intervals.append((a, a + rng.choice([0, 1, 5, 6, 13, 30, 31, 60, rng.randrange(731)]) * DAY))
    found = segments_of(routing.decompose_auto(requests_frame(spark, intervals)))
    for i, (a, b) in enumerate(intervals):
        segments = found[i]
        assert len(segments) <= 7
        assert segments[0][1] == a and segments[-1][2] == b
        for (_, _, end), (_, start, _) in zip(segments, segments[1:]):
            assert start == end + DAY
        days = {}
        for periode, first, last in segments:
            for n in range((last - first).days + 1):
                days[first + n * DAY] = periode
        assert days == label_days(a, b)


def test_keys_of_segments_match_the_range_on_text(spark):
    """The listed keys are those a text BETWEEN over the bounds would accept."""
    intervals = [(date(2024, 11, 20), date(2026, 2, 10)), (date(2020, 12, 1), date(2021, 1, 31))]
    segments = routing.decompose_auto(requests_frame(spark, intervals))
    bounds = routing.with_period_keys(segments)
    for grain in GRAINS.values():
        keys = routing.segment_keys(segments, grain).select("request_id", F.col(grain.key).alias("k"))
        ranges = bounds.filter(F.col("periode") == grain.name)
        outside = keys.join(
            ranges.withColumnRenamed("request_id", "r"),
            (F.col("r") == F.col("request_id")) & F.col("k").between(F.col("cle_debut"), F.col("cle_fin")),
            "left_anti",
        )
        assert outside.count() == 0
        assert keys.count() == keys.distinct().count()


def test_routed_sums_equal_day_sums(spark, sf_dir):
    marts = inputs.marts(spark, sf_dir)
    asked = inputs.requests(spark, sf_dir)
    routed = routing.route_traffic(routing.decompose_auto(asked), marts)
    got = routed.groupBy("request_id").agg(
        F.sum(F.coalesce("trafic_reel", "nb_objet_retenu")).alias("total")
    )
    days = marts["jours"].withColumn("jour", F.col("da_comptage").cast("date"))
    expected = (
        asked.join(days, "co_regate")
        .filter(F.col("jour").between(F.col("dt_debut"), F.col("dt_fin")))
        .groupBy("request_id")
        .agg(F.sum("trafic_reel").alias("total"))
    )
    assert sorted(got.collect()) == sorted(expected.collect())


@pytest.mark.parametrize("broadcast", [True, False])
def test_both_joins_agree(spark, sf_dir, broadcast):
    marts = inputs.marts(spark, sf_dir)
    asked = inputs.requests(spark, sf_dir)
    segments = routing.decompose_auto(asked)
    assert routing.route_traffic(segments, marts, broadcast=broadcast).count() == 418
    counted = traffic.result_count(asked, segments, marts, broadcast=broadcast)
    assert counted.agg(F.sum("count")).first()[0] == 418
    summed = traffic.traffic_group_sum(segments, marts, broadcast=broadcast)
    filtered = traffic.traffic_count_only(asked, segments, marts, broadcast=broadcast)
    assert filtered.agg(F.sum("total")).first()[0] == summed.count()


def test_large_request_tables_are_not_broadcast(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(routing, "MAX_BROADCAST_ROWS", 24)
    segments = routing.decompose_auto(inputs.requests(spark, sf_dir))
    assert not routing.may_broadcast(segments)
    routed = routing.route_traffic(segments, inputs.marts(spark, sf_dir))
    plan = routed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert routed.count() == 418


def test_long_fixed_segments_are_counted_by_their_keys(spark, sf_dir):
    row = "date'1996-01-01' + cast(id % 9 as int) AS seg_debut"
    segments = spark.range(20_000).selectExpr(
        "id AS request_id", "cast(id % 25 as string) AS co_regate", "'jours' AS periode", row
    ).withColumn("seg_fin", F.date_add("seg_debut", 730))
    assert not routing.may_broadcast(segments)
    assert routing.may_broadcast(segments.limit(1_000))
    assert routing.may_broadcast(segments.limit(0))
    marts = inputs.marts(spark, sf_dir)
    asked = segments.select("request_id", "co_regate")
    for df in (
        routing.route_traffic(segments, marts),
        traffic.traffic_group_sum(segments, marts),
        traffic.traffic_count_only(asked, segments, marts),
        traffic.result_count(asked, segments, marts),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [co_regate" not in plan
        assert "SortMergeJoin [co_regate" in plan


def test_site_without_traffic_counts_zero(spark, sf_dir):
    asked = requests_frame(spark, [(date(1998, 1, 1), date(1998, 12, 31))], site="nowhere")
    segments = routing.decompose_auto(asked)
    marts = inputs.marts(spark, sf_dir)
    assert routing.route_traffic(segments, marts).count() == 0
    assert [r["count"] for r in traffic.result_count(asked, segments, marts).collect()] == [0]
    assert [r.total for r in traffic.traffic_count_only(asked, segments, marts).collect()] == [0]


def test_fixed_mode_reads_every_touched_period(spark):
    rows = [(0, "1", "mois", date(2025, 1, 20), date(2025, 3, 2))]
    asked = spark.createDataFrame(
        rows, "request_id long, co_regate string, mode string, dt_debut date, dt_fin date"
    )
    keys = routing.segment_keys(routing.build_segments(asked), MOIS)
    assert sorted(r.co_mois_comptage for r in keys.collect()) == ["2025-01", "2025-02", "2025-03"]


def test_month_keys_of_the_older_format(spark):
    compact = {**GRAINS, "mois": Grain("mois", MOIS.table, MOIS.key, MOIS.measure, "yyyyMM")}
    asked = requests_frame(spark, [(date(2025, 1, 1), date(2025, 2, 28))])
    preview = routing.routing_preview(routing.decompose_auto(asked), compact).first()
    assert (preview.cle_debut, preview.cle_fin) == ("202501", "202502")
    assert preview.table_lue == "gold.default.g_mdp_trafics_mois_actualise"


def test_rows_of_a_dominant_site_are_whole(spark):
    """One site with most requests and traffic gives the rows a nested loop would."""
    rng = random.Random(3)
    start = date(2024, 1, 1)
    intervals = [(start + rng.randrange(100) * DAY, start + (100 + rng.randrange(100)) * DAY) for _ in range(60)]
    asked = requests_frame(spark, intervals, site="hot")
    days = [(f"{start + n * DAY}", c, n) for n in range(220) for c in ("A", "B")]
    mart = spark.createDataFrame(days, "da_comptage string, co_comptage string, trafic_reel long")
    mart = mart.withColumn("co_regate", F.lit("hot"))
    fixed = asked.withColumn("mode", F.lit("jours"))
    segments = routing.build_segments(fixed)
    expected = sum(2 * ((b - a).days + 1) for a, b in intervals)
    jours = {"jours": GRAINS["jours"]}
    for broadcast in (True, False):
        keys = routing.segment_keys(segments, jours["jours"])
        joined = routing.join_keys(mart, keys, jours["jours"], broadcast)
        assert joined.count() == expected
