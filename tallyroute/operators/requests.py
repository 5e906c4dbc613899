"""Validation of traffic and calendar requests: every row gets a verdict.

`motif` is NULL for a valid request, else the first rule it breaks:
`manquant`, `mode`, `format_date_debut`, `format_date_fin`, `ordre`, `ecart`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroute.constants import AUTO_MODE, FIXED_MODES, MAX_SPAN_DAYS
from tallyroute.functions.dates import parse_compact, parse_date


def _absent(name: str) -> Column:
    return F.coalesce(F.col(name) == "", F.lit(True))


def _missing_names(required: list[str]) -> Column:
    names = F.array(*[F.when(_absent(c), F.lit(c)) for c in required])
    return F.array_join(F.array_compact(names), ", ")


def _first_broken(rules: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules])


def _judge(df: DataFrame, required: list[str], extra: list[tuple[str, Column]]) -> DataFrame:
    first, last = F.col("dt_debut"), F.col("dt_fin")
    rules = [
        ("manquant", F.col("manquants") != ""),
        *extra,
        ("format_date_debut", first.isNull()),
        ("format_date_fin", last.isNull()),
        ("ordre", first > last),
        ("ecart", F.col("ecart_jours") > MAX_SPAN_DAYS),
    ]
    return (
        df.withColumn("manquants", _missing_names(required))
        .withColumn("ecart_jours", F.datediff(last, first))
        .withColumn("motif", _first_broken(rules))
    )


def parse_dates(requests: DataFrame) -> DataFrame:
    """Requests with their two bounds as dates, NULL where the text is not one."""
    return requests.select(
        "*",
        parse_date(F.col("date_debut")).alias("dt_debut"),
        parse_date(F.col("date_fin")).alias("dt_fin"),
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """Verdict on traffic requests: site, dates in either format, order, span."""
    return _judge(parse_dates(requests), ["co_regate", "date_debut", "date_fin"], [])


def validate_mode_requests(requests: DataFrame) -> DataFrame:
    """As `validate_requests` for requests that name a mode, `auto` by default."""
    mode = F.when(_absent("periode"), AUTO_MODE).otherwise(F.lower("periode"))
    parsed = parse_dates(requests).withColumn("mode", mode)
    unknown = ~F.col("mode").isin([*FIXED_MODES, AUTO_MODE])
    return _judge(parsed, ["co_regate", "date_debut", "date_fin"], [("mode", unknown)])


def validate_calendar_requests(requests: DataFrame) -> DataFrame:
    """Verdict on calendar requests: no site, compact dates only."""
    parsed = requests.select(
        "*",
        parse_compact(F.col("date_debut")).alias("dt_debut"),
        parse_compact(F.col("date_fin")).alias("dt_fin"),
    )
    return _judge(parsed, ["date_debut", "date_fin"], [])


def valid(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("motif").isNull())


def rejected(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("motif").isNotNull())
