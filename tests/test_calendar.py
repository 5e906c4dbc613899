import random
from datetime import date, timedelta

from tallyroute.operators.calendar import open_days_by_week, open_days_total

DAY = timedelta(days=1)


def frame(spark, intervals):
    return spark.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(intervals)],
        "request_id long, dt_debut date, dt_fin date",
    )


def expected_weeks(a, b):
    weeks = {}
    for n in range((b - a).days + 1):
        d = a + n * DAY
        year, week, weekday = d.isocalendar()
        entry = weeks.setdefault(f"{year}-S{week:02d}", [d, d, 0])
        entry[1] = d
        entry[2] += weekday != 7
    return {(k, f"{v[0]:%Y%m%d}", f"{v[1]:%Y%m%d}", v[2]) for k, v in weeks.items()}


def test_year_end_example(spark):
    df = frame(spark, [(date(2024, 12, 25), date(2025, 1, 12))])
    rows = sorted(tuple(r)[1:] for r in open_days_by_week(df).collect())
    assert rows == [
        ("2024-S52", "20241225", "20241229", 4),
        ("2025-S01", "20241230", "20250105", 6),
        ("2025-S02", "20250106", "20250112", 6),
    ]
    assert tuple(open_days_total(df).first()) == (0, 16, 3)


def test_closed_form_equals_listing_the_days(spark):
    rng = random.Random(5)
    intervals = [(date(2023, 1, 1), date(2023, 1, 1)), (date(2021, 1, 3), date(2021, 1, 3))]
    for _ in range(400):
        a = date(2019, 1, 1) + rng.randrange(2600) * DAY
        intervals.append((a, a + rng.randrange(731) * DAY))
    df = frame(spark, intervals)
    weeks, totals = {}, {}
    for r in open_days_by_week(df).collect():
        weeks.setdefault(r.request_id, set()).add(tuple(r)[1:])
    for r in open_days_total(df).collect():
        totals[r.request_id] = (r.total_jours_ouverts, r.nbr_semaines)
    for i, (a, b) in enumerate(intervals):
        expected = expected_weeks(a, b)
        assert weeks[i] == expected
        assert totals[i] == (sum(w[3] for w in expected), len(expected))
