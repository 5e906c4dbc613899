import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyroute.operators import periods

LOW, HIGH = date(2015, 1, 1), date(2031, 12, 31)
SCHEMA = "scenario_id long, dateDebut date, dateFin date"


def roll(d, years):
    return date(d.year + years, d.month, 1) + timedelta(days=d.day - 1)


def hold(d):
    return max(LOW, min(HIGH, d))


def cap_start(a, b):
    return hold(roll(b, -2)) if a < roll(b, -2) else a


def cap_end(a, b):
    return hold(roll(a, 2)) if b > roll(a, 2) else b


def random_days(rng, n):
    days = [LOW + timedelta(days=rng.randrange(-400, 6600)) for _ in range(n)]
    return days + [date(2024, 2, 29), date(2020, 2, 29), date(2031, 12, 31), date(2015, 1, 1)]


def test_normalised_periods(spark):
    rng = random.Random(1)
    pairs = list(zip(random_days(rng, 300), random_days(rng, 300)))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], SCHEMA)
    for r in periods.normalise_periods(df).collect():
        a, b = pairs[r.scenario_id]
        assert (r.dateDebut, r.dateFin) == (cap_start(hold(a), hold(b)), hold(b))


@pytest.mark.parametrize("today", ["2026-05-01", "2024-02-29", "2010-01-01", "2040-01-01"])
def test_default_periods(spark, today):
    df = spark.createDataFrame([(1, None, None)], SCHEMA)
    got = periods.default_periods(df, F.lit(today).cast("date")).first()
    now = date.fromisoformat(today)
    end = hold(roll(now, 2))
    assert (got.dateDebut, got.dateFin) == (cap_start(hold(now), end), end)


def test_no_period_stays_none(spark):
    df = spark.createDataFrame([(1, None, None)], SCHEMA)
    assert tuple(periods.normalise_periods(df).first()) == (1, None, None)


def edited(period, side, text):
    a, b = period
    try:
        day = date.fromisoformat(text)
    except ValueError:
        return a, b, False
    if side == "debut":
        new = min(max(day, LOW), b)
        return new, cap_end(new, b), new != day
    new = max(min(day, HIGH), a)
    return cap_start(a, new), new, new != day


def test_period_edits(spark):
    rng = random.Random(9)
    current, log = [], []
    for i, day in enumerate(random_days(rng, 400)):
        a = hold(day)
        current.append((i, a, min(HIGH, a + timedelta(days=rng.randrange(731)))))
        text = str(hold(a + timedelta(days=rng.randrange(-1500, 1500))) + timedelta(days=rng.choice([0, 0, 500])))
        log.append((i, rng.choice(["debut", "fin"]), rng.choice([text, text, text, "", "bientôt"])))
    df = spark.createDataFrame(current, SCHEMA)
    got = periods.apply_period_edits(df, spark.createDataFrame(log, "scenario_id long, cote string, valeur string"))
    for r in got.collect():
        _, a, b = current[r.scenario_id]
        _, side, text = log[r.scenario_id]
        assert (r.dateDebut, r.dateFin, r.ajuste) == edited((a, b), side, text)


@pytest.mark.parametrize("block", [1, 7, None])
def test_each_edit_acts_on_what_the_last_one_left(spark, block):
    rng = random.Random(4)
    current, log, expected = [], [], {}
    for i, day in enumerate(random_days(rng, 200)):
        a = hold(day)
        state, moved = (a, min(HIGH, a + timedelta(days=rng.randrange(731)))), False
        current.append((i, *state))
        # Scenario 0 holds a third of the log.
        for seq in range(40 if i == 0 else rng.randrange(6)):
            side = rng.choice(["debut", "fin"])
            text = rng.choice([str(hold(a + timedelta(days=rng.randrange(-1500, 1500)))), "", "bientôt"])
            log.append((i, seq, side, text))
            *state, adjusted = edited(state, side, text)
            moved = moved or adjusted
        expected[i] = (*state, moved)
    rng.shuffle(log)
    schema = "scenario_id long, seq int, cote string, valeur string"
    got = periods.apply_period_edits(
        spark.createDataFrame(current, SCHEMA), spark.createDataFrame(log + [(None, 0, "fin", "2020-01-01")], schema),
        block=block,
    )
    assert {r.scenario_id: (r.dateDebut, r.dateFin, r.ajuste) for r in got.collect()} == expected


@pytest.mark.parametrize(
    "start,end,days,parts,label",
    [
        ("2025-01-31", "2025-03-01", 29, (0, 1, -2), "1 mois"),
        ("2025-01-01", "2025-01-01", 0, (0, 0, 0), "0 jour"),
        ("2025-01-01", "2025-01-02", 1, (0, 0, 1), "1 jour"),
        ("2024-01-15", "2026-04-20", 826, (2, 3, 5), "2 ans 3 mois 5 jours"),
        ("2024-12-31", "2025-12-30", 364, (0, 11, 29), "11 mois 29 jours"),
        ("2025-01-01", "2026-01-01", 365, (1, 0, 0), "1 an"),
    ],
)
def test_durations(spark, start, end, days, parts, label):
    df = spark.createDataFrame([(1, date.fromisoformat(start), date.fromisoformat(end))], SCHEMA)
    r = periods.period_duration(df).first()
    assert (r.jours_total, (r.ans, r.mois, r.jours), r.duree) == (days, parts, label)


def test_positions(spark):
    df = spark.createDataFrame([(1, date(2025, 1, 1), date(2025, 2, 1))], SCHEMA)
    for today, place in [("2024-12-31", "avant"), ("2025-01-01", "pendant"), ("2025-02-01", "pendant"), ("2025-02-02", "apres")]:
        assert periods.period_position(df, F.lit(today).cast("date")).first().position == place
