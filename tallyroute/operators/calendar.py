"""Open-day calendars: every day but Sunday is open, holidays included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroute.constants import SEMAINES
from tallyroute.functions.dates import period_starts, week_label

COMPACT = "yyyyMMdd"


def open_days_by_week(requests: DataFrame) -> DataFrame:
    """One row per request and ISO week: its days inside the interval, Sundays off.

    A week's first and last day follow from its Monday and the bounds, so the
    days are never listed and nothing is shuffled.
    """
    first, last, monday = F.col("dt_debut"), F.col("dt_fin"), F.col("lundi")
    sunday = F.date_add(monday, 6)
    weeks = requests.select(
        "request_id", first, last, F.explode(period_starts(first, last, SEMAINES)).alias("lundi")
    ).withColumns({"debut": F.greatest(first, monday), "fin": F.least(last, sunday)})
    days = F.datediff("fin", "debut") + 1
    return weeks.select(
        "request_id",
        week_label(monday).alias("semaine"),
        F.date_format("debut", COMPACT).alias("date_debut_semaine"),
        F.date_format("fin", COMPACT).alias("date_fin_semaine"),
        (days - (F.col("fin") == sunday).cast("int")).alias("nbr_jours_ouverts"),
    )


def open_days_total(requests: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Open days and ISO weeks of each interval, in closed form."""
    first, last = F.col("dt_debut"), F.col("dt_fin")
    first_monday, last_monday = F.trunc(first, "week"), F.trunc(last, "week")
    week_span = F.floor(F.datediff(last_monday, first_monday) / 7).cast("int")
    # Sundays met: one per Monday boundary crossed, plus the last day itself.
    sundays = week_span + (F.weekday(last) == 6).cast("int")
    return requests.select(
        "request_id",
        *keep,
        (F.datediff(last, first) + 1 - sundays).alias("total_jours_ouverts"),
        (week_span + 1).alias("nbr_semaines"),
    )
