"""Times the headline queries and prints one JSON line.

`marts` is the build of the three stored tables. The `day_only` and `range_join`
entries are the plans routing is measured against.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroute.constants import GRAINS
from tallyroute.operators import routing
from tallyroute.operators.calendar import open_days_by_week
from tallyroute.plans import inputs
from tallyroute.plans.queries import QUERIES
from tallyroute.plans.session import local_session
from tallyroute.sources.marts import write_marts
from tallyroute.sources.shared import shared_folder

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 2

HEADLINE = [
    "route_traffic",
    "route_fixed_grain",
    "traffic_group_sum",
    "traffic_count_only",
    "result_count",
    "limit_per_grain",
    "paginate_result",
    "concat_grains",
    "multi_range_filter",
    "multi_range_filter_batched",
    "validate_requests",
    "decompose_auto",
    "open_days_by_week",
    "open_days_total",
    "available_types",
    "append_with_next_id",
    "update_values",
    "apply_count_edits",
    "detect_changes",
    "param_payload",
    "apply_period_edits",
    "period_duration",
    "drop_neutralised_days",
    "apply_variation",
    "column_profile",
]


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action: Callable[[], None], runs: int = RUNS) -> float:
    """Best of `runs`: the first also pays for compiling the plan's code."""
    best = float("inf")
    for _ in range(runs):
        began = time.perf_counter()
        action()
        best = min(best, time.perf_counter() - began)
    return round(best, 3)


def day_only(spark) -> DataFrame:
    """The same requests answered from the day table alone."""
    segments = inputs.requests(spark, SF_DIR).select(
        "request_id",
        "co_regate",
        F.lit("jours").alias("periode"),
        F.col("dt_debut").alias("seg_debut"),
        F.col("dt_fin").alias("seg_fin"),
    )
    grain = GRAINS["jours"]
    keys = routing.segment_keys(segments, grain)
    return routing.join_keys(inputs.marts(spark, SF_DIR)["jours"], keys, grain, True)


def range_join(spark) -> DataFrame:
    """The same segments joined on the site, with the key range as a condition."""
    marts = inputs.marts(spark, SF_DIR)
    segments = routing.decompose_auto(inputs.requests(spark, SF_DIR))
    bounds = routing.with_period_keys(segments)
    parts = {}
    for name, grain in GRAINS.items():
        mine = bounds.filter(F.col("periode") == name).drop("periode")
        mine = mine.withColumnRenamed("co_regate", "site")
        inside = F.col(grain.key).between(F.col("cle_debut"), F.col("cle_fin"))
        parts[name] = marts[name].join(
            F.broadcast(mine), (F.col("site") == F.col("co_regate")) & inside
        )
    return routing.concat_grains(parts)


def order_calendar(spark) -> DataFrame:
    """Open days by week of one interval of up to 730 days per order."""
    first = F.col("o_orderdate").cast("date")
    asked = inputs.table(spark, SF_DIR, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        first.alias("dt_debut"),
        F.date_add(first, F.pmod("o_orderkey", F.lit(731)).cast("int")).alias("dt_fin"),
    )
    return open_days_by_week(asked)


def main() -> None:
    spark = local_session(CPUS)
    lineitem = inputs.table(spark, SF_DIR, "lineitem")
    supplier = inputs.table(spark, SF_DIR, "supplier")
    built = f"{shared_folder(spark)}/bench-{spark.sparkContext.applicationId}"
    times = {"marts": timed(lambda: write_marts(lineitem, supplier, built))}
    inputs.marts(spark, SF_DIR)
    inputs.edited_counts(spark, SF_DIR)
    for name in HEADLINE:
        times[name] = timed(lambda: consume(QUERIES[name](spark, SF_DIR)))
    times["open_days_of_orders"] = timed(lambda: consume(order_calendar(spark)))
    calendars = inputs.table(spark, SF_DIR, "orders").count()
    times["route_traffic_day_only"] = timed(lambda: consume(day_only(spark)))
    times["route_traffic_range_join"] = timed(lambda: consume(range_join(spark)))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds over the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
                "calendar_ms_per_request": round(
                    1000 * times["open_days_of_orders"] / calendars, 5
                ),
            }
        )
    )


if __name__ == "__main__":
    main()
