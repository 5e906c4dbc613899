"""Calendar rules of scenario periods: bounds, longest span, edits, duration.

`as_of` stands for today wherever a rule depends on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroute.constants import MAX_PERIOD_YEARS, PERIOD_MAX, PERIOD_MIN
from tallyroute.functions.dates import clamp, parse_iso, shift_years
from tallyroute.sources.shared import written


def _bounds(low: str, high: str) -> tuple[Column, Column]:
    return F.lit(low).cast("date"), F.lit(high).cast("date")


def _capped_start(start: Column, end: Column, low: Column, high: Column) -> Column:
    earliest = shift_years(end, -MAX_PERIOD_YEARS)
    return F.when(start < earliest, clamp(earliest, low, high)).otherwise(start)


def _capped_end(start: Column, end: Column, low: Column, high: Column) -> Column:
    latest = shift_years(start, MAX_PERIOD_YEARS)
    return F.when(end > latest, clamp(latest, low, high)).otherwise(end)


def normalise_periods(
    periods: DataFrame, low: str = PERIOD_MIN, high: str = PERIOD_MAX
) -> DataFrame:
    """Both ends held within the bounds, then the start moved up to the longest span."""
    lo, hi = _bounds(low, high)
    held = periods.withColumns(
        {
            "dateDebut": clamp(F.col("dateDebut"), lo, hi),
            "dateFin": clamp(F.col("dateFin"), lo, hi),
        }
    )
    return held.withColumn(
        "dateDebut", _capped_start(F.col("dateDebut"), F.col("dateFin"), lo, hi)
    )


def default_periods(
    periods: DataFrame, as_of: Column, low: str = PERIOD_MIN, high: str = PERIOD_MAX
) -> DataFrame:
    """Scenarios without a period get the longest one from `as_of`; all are normalised."""
    absent = F.col("dateDebut").isNull() & F.col("dateFin").isNull()
    filled = periods.withColumns(
        {
            "dateDebut": F.when(absent, as_of).otherwise(F.col("dateDebut")),
            "dateFin": F.when(absent, shift_years(as_of, MAX_PERIOD_YEARS)).otherwise(
                F.col("dateFin")
            ),
        }
    )
    return normalise_periods(filled, low, high)


#: Edits of one scenario folded in one round; a longer log takes more rounds.
PERIOD_BLOCK = 10_000


def apply_period_edits(
    periods: DataFrame,
    edits: DataFrame,
    low: str = PERIOD_MIN,
    high: str = PERIOD_MAX,
    block: int | None = PERIOD_BLOCK,
) -> DataFrame:
    """Periods after a log of edits (`cote` = debut or fin, `valeur` a text date).

    Edits of a scenario act in the order of `seq`, each on what the last one
    left. The edited end is held between the bound and the other end, which then
    gives way if the span is too long; `ajuste` tells whether any edited date was
    moved. A text that is no date changes nothing. Without `seq`, or where it
    ties, edits of the start come before edits of the end, earlier dates first.

    The fold runs in rounds: each takes the next `block` edits of every scenario (None: all in
    one round), folds them into the stored state (start, end, adjusted) of each period row with
    the built-in `aggregate`, and writes that state for the next round. A row holds at most
    `block` edits, so a scenario with a third of a log of millions takes more rounds, not a row
    of unbounded size. Results do not depend on `block`.
    """
    lo, hi = _bounds(low, high)
    seq = F.col("seq") if "seq" in edits.columns else F.lit(0)
    log = edits.select(
        "scenario_id", seq.cast("long").alias("seq"), "cote", parse_iso(F.col("valeur")).alias("jour")
    ).filter(F.col("jour").isNotNull() & F.col("cote").isin("debut", "fin") & F.col("scenario_id").isNotNull())

    def edited(state: Column, edit: Column) -> Column:
        start, end, day = state["debut"], state["fin"], edit["jour"]
        on_start = edit["cote"] == "debut"
        new_start = F.least(F.greatest(day, lo), end)
        new_end = F.greatest(F.least(day, hi), start)
        moved = F.when(on_start, day != new_start).otherwise(day != new_end)
        return F.struct(
            F.when(on_start, new_start)
            .otherwise(_capped_start(start, new_end, lo, hi))
            .alias("debut"),
            F.when(on_start, _capped_end(new_start, end, lo, hi)).otherwise(new_end).alias("fin"),
            (state["ajuste"] | moved).alias("ajuste"),
        )

    begun = F.struct(
        F.col("dateDebut").alias("debut"), F.col("dateFin").alias("fin"), F.lit(False).alias("ajuste")
    )

    def fold(state: DataFrame, chunk: DataFrame) -> DataFrame:
        logs = chunk.groupBy("scenario_id").agg(
            F.sort_array(F.collect_list(F.struct("seq", "cote", "jour", "_pos"))).alias("_journal")
        )
        return state.join(logs, "scenario_id", "left").withColumn(
            "_etat", F.coalesce(F.aggregate("_journal", F.col("_etat"), edited), F.col("_etat"))
        ).drop("_journal")

    if block is None:
        state = fold(periods.withColumn("_etat", begun), log.withColumn("_pos", F.lit(0)))
    else:
        rows = written(periods.withColumn("_ligne", F.monotonically_increasing_id()), "periods")
        state = rows.select("_ligne", "scenario_id", begun.alias("_etat"))
        pending = written(log.withColumn("_pos", F.monotonically_increasing_id()), "period-log")
        order = Window.partitionBy("scenario_id").orderBy("seq", "cote", "jour", "_pos")
        while pending.limit(1).count():
            chunk = written(
                pending.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= block).drop("_k"),
                "period-chunk",
            )
            state = written(fold(state, chunk), "period-state")
            pending = written(
                pending.join(chunk.select("scenario_id", "_pos"), ["scenario_id", "_pos"], "left_anti"),
                "period-log",
            )
        state = rows.join(state.drop("scenario_id"), "_ligne")
    return state.withColumns(
        {"dateDebut": F.col("_etat.debut"), "dateFin": F.col("_etat.fin")}
    ).select(*periods.columns, F.col("_etat.ajuste").alias("ajuste"))


def _counted(n: Column, one: str, many: str) -> Column:
    text = F.concat(n.cast("string"), F.lit(" "), F.when(n > 1, many).otherwise(one))
    return F.when(n > 0, text)


def period_duration(periods: DataFrame) -> DataFrame:
    """Days, end excluded, and years, months and days with their label.

    Days missing in the last month are borrowed from the month before the end,
    once: a start on the 31st may leave a negative rest, which is not shown.
    """
    start, end = F.col("dateDebut"), F.col("dateFin")
    day_gap = F.dayofmonth(end) - F.dayofmonth(start)
    borrowed = F.dayofmonth(F.date_sub(F.trunc(end, "month"), 1))
    month_gap = F.month(end) - F.month(start) - (day_gap < 0).cast("int")
    year_gap = F.year(end) - F.year(start) - (month_gap < 0).cast("int")
    parts = periods.withColumns(
        {
            "jours_total": F.datediff(end, start),
            "ans": year_gap,
            "mois": month_gap + F.when(month_gap < 0, 12).otherwise(0),
            "jours": day_gap + F.when(day_gap < 0, borrowed).otherwise(0),
        }
    )
    label = F.concat_ws(
        " ",
        _counted(F.col("ans"), "an", "ans"),
        _counted(F.col("mois"), "mois", "mois"),
        _counted(F.col("jours"), "jour", "jours"),
    )
    return parts.withColumn("duree", F.when(label != "", label).otherwise("0 jour"))


def period_position(periods: DataFrame, as_of: Column) -> DataFrame:
    """Whether `as_of` lies `avant`, `pendant` or `apres` the period."""
    place = (
        F.when(as_of < F.col("dateDebut"), "avant")
        .when(as_of > F.col("dateFin"), "apres")
        .otherwise("pendant")
    )
    return periods.withColumn("position", place)
