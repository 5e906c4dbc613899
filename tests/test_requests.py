import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tallyroute.functions.dates import parse_compact, parse_date
from tallyroute.operators import requests


def python_date(text, *formats):
    for pattern in formats:
        try:
            return datetime.strptime(text, pattern).date()
        except ValueError:
            continue
    return None


def random_texts():
    rng = random.Random(11)
    texts = [
        "202511", "2025111", "20251111", "2025113", "2025-1-5", "2025-01- 5", "202501 5", "20250230",
        "2025-02-29", "2024-02-29", "20240229", "", " ", "00000101", "0000-01-01", "0001-01-01",
        "2025-13-01", "2025-1-311", "2025-01-05T00:00", "20250105\n", "2025-01-05\n", "x2025-01-05",
        "2025-0105", "202501-05", "2025/01/05", "99991231", "2025-00-10", "2025-10-00", "2025-010-5",
    ]
    for _ in range(3000):
        y, m, d = rng.randrange(1900, 2100), rng.randrange(0, 14), rng.randrange(0, 33)
        dash = rng.choice(["", "-"])
        text = f"{y}{dash}{rng.choice([str(m), f'{m:02d}'])}{dash}{rng.choice([str(d), f'{d:02d}', f'{d:2d}'])}"
        if rng.random() < 0.1:
            text += rng.choice("0123 -")
        texts.append(text)
    for _ in range(1000):
        texts.append("".join(rng.choice("0123-9 ") for _ in range(rng.randrange(4, 11))))
    return texts


def test_dates_parse_as_strptime_does(spark):
    texts = random_texts()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", parse_date(F.col("t")).alias("any"), parse_compact(F.col("t")).alias("compact"))
    for r in rows.collect():
        assert r["any"] == python_date(r.t, "%Y%m%d", "%Y-%m-%d"), repr(r.t)
        assert r["compact"] == python_date(r.t, "%Y%m%d"), repr(r.t)


def verdicts(spark, rows, judge=requests.validate_requests):
    df = spark.createDataFrame(rows, "co_regate string, date_debut string, date_fin string, periode string")
    return [(r.motif, r.manquants) for r in judge(df.coalesce(1)).collect()]


def test_first_broken_rule_wins(spark):
    a = date(2023, 1, 1)
    rows = [
        ("1", "20230101", "2023-01-01", None),
        (None, "", None, None),
        ("", "bad", "bad", None),
        ("1", "bad", "worse", None),
        ("1", "20230101", "worse", None),
        ("1", "20230102", "20230101", None),
        ("1", str(a), str(a + timedelta(days=730)), None),
        ("1", str(a), str(a + timedelta(days=731)), None),
    ]
    assert verdicts(spark, rows) == [
        (None, ""),
        ("manquant", "co_regate, date_debut, date_fin"),
        ("manquant", "co_regate"),
        ("format_date_debut", ""),
        ("format_date_fin", ""),
        ("ordre", ""),
        (None, ""),
        ("ecart", ""),
    ]


def test_mode_defaults_and_is_checked_before_dates(spark):
    rows = [
        ("1", "20230101", "20230102", None),
        ("1", "20230101", "20230102", ""),
        ("1", "20230101", "20230102", "JOURS"),
        ("1", "bad", "20230102", "annee"),
        (None, "bad", "20230102", "annee"),
    ]
    judged = verdicts(spark, rows, requests.validate_mode_requests)
    assert [m for m, _ in judged] == [None, None, None, "mode", "manquant"]


def test_calendar_takes_compact_dates_only(spark):
    rows = [
        (None, "20230101", "20230108", None),
        (None, "2023-01-01", "20230108", None),
        (None, "20230101", "", None),
    ]
    judged = verdicts(spark, rows, requests.validate_calendar_requests)
    assert judged == [(None, ""), ("format_date_debut", ""), ("manquant", "date_fin")]


def test_valid_and_rejected_partition_the_requests(spark, sf_dir):
    from tallyroute.plans import inputs

    judged = requests.validate_requests(inputs.raw_requests(spark, sf_dir))
    total = judged.count()
    assert requests.valid(judged).count() + requests.rejected(judged).count() == total == 10
