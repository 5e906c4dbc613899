import pytest

from tallyroute.constants import JOURS
from tallyroute.operators import profile, routing, traffic
from tallyroute.plans import inputs
from tallyroute.plans.queries import QUERIES
from tallyroute.sources import shared
from tallyroute.sources.marts import traffic_scan


@pytest.fixture(scope="module")
def marts(spark, sf_dir):
    return inputs.marts(spark, sf_dir)


@pytest.fixture(scope="module")
def routed(spark, sf_dir, marts):
    return routing.route_traffic(routing.decompose_auto(inputs.requests(spark, sf_dir)), marts)


def test_limits(routed):
    assert traffic.limit_per_grain(routed, 0).count() == 0
    assert traffic.limit_per_grain(routed, 10**6).count() == routed.count()
    counts = traffic.limit_per_grain(routed, 3).groupBy("request_id", "periode").count().collect()
    assert max(r["count"] for r in counts) == 3


def test_pages_tile_the_result(routed):
    pages = [traffic.paginate_result(routed, p, 30).drop("rang") for p in range(1, 6)]
    whole = pages[0]
    for page in pages[1:]:
        whole = whole.unionAll(page)
    assert sorted(map(str, whole.collect())) == sorted(map(str, routed.collect()))
    with pytest.raises(ValueError):
        traffic.paginate_result(routed, 0, 30)


def test_sample_checks_its_arguments(spark, sf_dir):
    inputs.table(spark, sf_dir, "nation").createOrReplaceTempView("echantillon")
    assert traffic.table_sample(spark, "echantillon").count() == 10
    for limit in (0, 101):
        with pytest.raises(ValueError):
            traffic.table_sample(spark, "echantillon", limit)
    with pytest.raises(LookupError):
        traffic.table_sample(spark, "no_such_table")


def test_preview_filters(marts):
    key = marts["jours"].filter("co_regate = '3'").first().da_comptage
    rows = traffic.table_preview(marts["jours"], JOURS, 100, site="3", key=key).collect()
    assert rows and all(r.co_regate == "3" and r.da_comptage == key for r in rows)
    assert "annee" not in traffic.table_preview(marts["jours"], JOURS).columns


def test_no_range_reads_nothing(marts):
    assert traffic.multi_range_filter(marts["jours"], JOURS, "3", []).count() == 0


def test_tables_by_qualified_name(spark, marts):
    spark.sql("CREATE DATABASE IF NOT EXISTS depot")
    path = marts["jours"].inputFiles()[0].rsplit("/annee=", 1)[0]
    spark.sql(f"CREATE TABLE IF NOT EXISTS depot.{JOURS.table} USING parquet LOCATION '{path}'")
    spark.catalog.recoverPartitions(f"depot.{JOURS.table}")
    named = traffic_scan(spark, JOURS, "spark_catalog", "depot")
    assert named.count() == marts["jours"].count()
    spark.sql("DROP DATABASE depot CASCADE")


def test_weeks_and_months_sum_to_the_days(marts):
    totals = {n: marts[n].agg({g.measure: "sum"}).first()[0] for n, g in routing.GRAINS.items()}
    assert len(set(totals.values())) == 1


def test_mixed_tables_profile(spark):
    table = spark.createDataFrame([(1, None), (2, "x")], "a int, `b c` string")
    odd = spark.createDataFrame([(1,)], "`it's ``odd`` \\\\ too` int")
    assert profile.column_profile({"o'o": odd}).first().column_name == odd.columns[0]
    rows = profile.column_profile({"t": table}).collect()
    assert [(r.ordinal_position, r.column_name, r.column_type, r.null_count, r.is_nullable) for r in rows] == [
        (1, "a", "int", 0, "NO"), (2, "b c", "string", 1, "YES"),
    ]
    assert profile.nested_schema_report({"t": table}).first().columns[1].column_name == "b c"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, sf_dir):
    plan = plan_of(QUERIES["multi_range_filter"](spark, sf_dir))
    pushed = plan.split("PushedFilters:")[1].split("ReadSchema")[0]
    assert "EqualTo(co_regate,12)" in pushed and "GreaterThanOrEqual(da_comptage" in pushed


def test_routing_prunes_years_and_reads_each_grain_once(spark, sf_dir):
    plan = plan_of(QUERIES["route_traffic"](spark, sf_dir))
    assert plan.count("dynamicpruningexpression") == 3
    assert plan.count("BroadcastHashJoin") == 3


def test_shared_folder_comes_from_the_session(spark, monkeypatch):
    class Conf(dict):
        pass

    class Session:
        def __init__(self, conf, master):
            self.conf = Conf(conf)
            self.sparkContext = type("C", (), {"master": master, "applicationId": "app-1"})

    named = Session({"spark.checkpoint.dir": "hdfs:///shared/"}, "yarn")
    assert shared.shared_folder(named) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        shared.shared_folder(Session({}, "yarn"))
    local = Session({}, "local[2]")
    assert shared.shared_folder(local) == shared.shared_folder(local)


def _brute_ranges(days, ranges):
    out = set()
    for r in ranges:
        for d in days:
            if d["co_regate"] != r["co_regate"]:
                continue
            if (r["cle_debut"] is None or d["da_comptage"] >= r["cle_debut"]) and (
                r["cle_fin"] is None or d["da_comptage"] <= r["cle_fin"]
            ):
                out.add((r["request_id"], d["co_regate"], d["co_comptage"], d["da_comptage"], d["trafic_reel"]))
    return out


def test_ranges_filter_once_per_request(spark, marts):
    rows = [
        (1, "3", "1996-01-01", "1996-06-30"),
        (1, "3", "1996-03-01", "1997-02-01"),  # overlaps the first
        (1, "3", "1996-04-01", "1996-04-02"),  # inside the first
        (1, "3", "1997-02-02", "1997-02-10"),  # touches without overlap
        (2, "3", None, "1995-12-31"),  # open start
        (2, "4", "1998-06-01", None),  # open end
        (3, "7", "1998-01-05", "1997-01-05"),  # reversed: nothing
        (4, "absent", "1996-01-01", "1999-01-01"),
        (5, "7", None, None),
    ]
    ranges = spark.createDataFrame(rows, "request_id long, co_regate string, cle_debut string, cle_fin string")
    got = traffic.ranges_filter(marts["jours"], JOURS, ranges)
    plan = plan_of(got)
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    cols = ["request_id", "co_regate", "co_comptage", "da_comptage", "trafic_reel"]
    got_rows = [tuple(r[c] for c in cols) for r in got.collect()]
    assert len(got_rows) == len(set(got_rows))
    days = marts["jours"].filter("co_regate IN ('3', '4', '7')").collect()
    assert set(got_rows) == _brute_ranges(days, [dict(zip(cols[:2] + ["cle_debut", "cle_fin"], r)) for r in rows])


def test_ranges_filter_prunes_years(spark, sf_dir):
    plan = plan_of(QUERIES["multi_range_filter_batched"](spark, sf_dir))
    assert "dynamicpruningexpression" in plan and "BroadcastHashJoin" in plan


def test_merged_ranges(spark):
    rows = [(1, "a", "1", "3"), (1, "a", "2", "5"), (1, "a", "6", "7"), (1, "a", None, "0"), (1, "b", "4", None)]
    ranges = spark.createDataFrame(rows, "request_id long, co_regate string, cle_debut string, cle_fin string")
    got = sorted(tuple(r) for r in traffic.merged_ranges(ranges).collect())
    assert got == [(1, "a", "", "0"), (1, "a", "1", "5"), (1, "a", "6", "7"), (1, "b", "4", "￿")]


@pytest.mark.parametrize("page,size", [(1, 7), (2, 20), (9, 13), (500, 3)])
def test_page_locator_gives_the_rows_of_a_whole_sort(spark, sf_dir, marts, page, size):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    segments = routing.decompose_auto(inputs.requests(spark, sf_dir))
    routed = routing.route_traffic(segments, marts).cache()
    got = traffic.paginate_result(routed, page, size)
    order = traffic._result_order(routed)
    whole = routed.withColumn("rang", F.row_number().over(Window.partitionBy("request_id").orderBy("periode", *order)))
    want = whole.filter((F.col("rang") > (page - 1) * size) & (F.col("rang") <= page * size))
    cols = sorted(want.columns)

    def rows(df):
        return sorted((tuple(r) for r in df.select(cols).collect()), key=lambda t: [(v is None, str(v)) for v in t])

    assert rows(got) == rows(want)
    assert got.schema["rang"].dataType.simpleString() == "int"


def test_limit_sorts_rows_of_the_first_keys_only(spark):
    rows = [(r, p, k, f"d{i % 7}") for r in (1, None) for p in ("jours", "mois") for k in (None, "a", "b", "c") for i in range(30)]
    routed = spark.createDataFrame(rows, "request_id int, periode string, cle_comptage string, lb_objet string")
    first = traffic._of_first_keys(routed, ["cle_comptage"], 35)
    assert first.count() == 2 * 2 * 60  # a null key and `a` hold the first 35 rows
    got = traffic.limit_per_grain(routed, 35)
    assert "leftsemi" in got._jdf.queryExecution().optimizedPlan().toString().lower()
    by_group = {}
    for r, p, k, d in sorted(rows, key=lambda x: (x[2] is not None, x[2] or "", x[3])):
        by_group.setdefault((r, p), []).append((r, p, k, d))
    want = [x for group in by_group.values() for x in group[:35]]
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want))
