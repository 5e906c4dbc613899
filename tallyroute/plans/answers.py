"""Whole answers to tables of typed requests: rows, headers and refusals."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroute.constants import GRAINS, Grain
from tallyroute.operators import calendar, requests, routing, traffic


class Answer(NamedTuple):
    """Result rows, one header per valid request, and the refused requests."""

    rows: DataFrame
    headers: DataFrame
    refused: DataFrame


def _refused(judged: DataFrame) -> DataFrame:
    return requests.rejected(judged).select("request_id", "motif", "manquants", "ecart_jours")


def traffic_answer(
    asked: DataFrame,
    marts: dict[str, DataFrame],
    limit: int | None = None,
    grains: dict[str, Grain] = GRAINS,
) -> Answer:
    """Traffic of typed requests; `limit` holds for each grain of each request.

    Headers repeat the dates of the request, whatever segments they became.
    """
    judged = requests.validate_requests(asked)
    accepted = requests.valid(judged).select("request_id", "co_regate", "dt_debut", "dt_fin")
    segments = routing.decompose_auto(accepted)
    few = routing.may_broadcast(segments)
    rows = routing.route_traffic(segments, marts, grains, broadcast=few)
    if limit is not None:
        rows = traffic.limit_per_grain(rows, limit)
    counted = traffic.result_count(
        accepted, segments, marts, grains, broadcast=few, limit=limit
    )
    headers = counted.select(
        "request_id",
        "co_regate",
        F.col("dt_debut").cast("string").alias("date_debut"),
        F.col("dt_fin").cast("string").alias("date_fin"),
        "count",
    )
    return Answer(rows, headers, _refused(judged))


def calendar_answer(asked: DataFrame) -> Answer:
    """Open days of typed requests, by week and in total; dates as they were typed."""
    judged = requests.validate_calendar_requests(asked)
    accepted = requests.valid(judged)
    totals = calendar.open_days_total(
        accepted.select("request_id", "dt_debut", "dt_fin", "date_debut", "date_fin"),
        keep=["date_debut", "date_fin"],
    )
    return Answer(calendar.open_days_by_week(accepted), totals, _refused(judged))
