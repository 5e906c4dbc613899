from datetime import date

import pytest

from tallyroute.operators import params

PERIODS = "site_id string, ordre long, id long, dateDebut date, dateFin date, motif string"


def payload_inputs(spark, n):
    day = date(2025, 1, 1)
    rows = [("a", i, i, day, day, None) for i in range(n, 0, -1)]
    lists = {
        "periodesNeutralisees": spark.createDataFrame(rows, PERIODS),
        "neutralisationsPeak": spark.createDataFrame([("a", 1, 1, day, day, "x")], PERIODS),
        "neutralisationsSecondaires": spark.createDataFrame([], PERIODS),
        "variationsTrafic": spark.createDataFrame(
            [], "site_id string, ordre long, categorie string, min int, max int, valeur int"
        ),
        "produitsExclus": spark.createDataFrame(
            [], "site_id string, ordre long, id int, code string, libelle string, exclu boolean"
        ),
    }
    sites = spark.createDataFrame([("a", "A"), ("b", "B")], "site_id string, libelle string")
    return sites, lists


def test_payload_of_sites_with_and_without_parameters(spark):
    rows = {r.site_id: r for r in params.param_payload(*payload_inputs(spark, 5), entries=10).collect()}
    assert [e.id for e in rows["a"].periodesNeutralisees] == [1, 2, 3, 4, 5]
    assert rows["a"].neutralisationsPeak[0].motif == "x" and rows["a"].variationsTrafic == []
    assert rows["b"].site.libelle == "B" and rows["b"].partie == 0
    assert all(rows["b"][name] == [] for name in params.PAYLOAD_LISTS)


def test_a_long_list_goes_on_in_further_records(spark):
    records = params.param_payload(*payload_inputs(spark, 25), entries=10).filter("site_id = 'a'")
    rows = sorted(records.collect(), key=lambda r: r.partie)
    assert [len(r.periodesNeutralisees) for r in rows] == [10, 10, 5]
    assert [e.id for r in rows for e in r.periodesNeutralisees] == list(range(1, 26))
    assert [len(r.neutralisationsPeak) for r in rows] == [1, 0, 0]


def test_entries_of_unknown_sites_and_of_none_stay(spark):
    sites, lists = payload_inputs(spark, 3)
    day = date(2025, 1, 1)
    more = [("x", 9, 9, day, day, None), (None, 7, 7, day, day, None), (None, 5, 5, day, day, None)]
    lists["periodesNeutralisees"] = lists["periodesNeutralisees"].union(
        spark.createDataFrame(more, PERIODS)
    )
    rows = {r.site_id: r for r in params.param_payload(sites, lists, entries=10).collect()}
    assert set(rows) == {"a", "b", "x", None}
    assert rows["x"].site is None and rows[None].site is None and rows["a"].site.libelle == "A"
    assert [e.id for e in rows[None].periodesNeutralisees] == [5, 7]
    long = params.param_entries(lists).filter("site_id IS NULL").collect()
    assert sorted((r.liste, r.rang, r.periodesNeutralisees.id) for r in long) == [
        ("periodesNeutralisees", 1, 5), ("periodesNeutralisees", 2, 7)
    ]


def test_endless_periods_are_not_listed_by_day(spark):
    schema = "site_id string, dateDebut date, dateFin date"
    endless = spark.createDataFrame([("a", date(1900, 1, 1), date(9999, 12, 31))], schema)
    assert params.neutralised_spans(endless).count() == 8100
    days = spark.createDataFrame(
        [("a", "2025-01-01"), ("b", "2025-01-01")], "co_regate string, da_comptage string"
    )
    assert [r.co_regate for r in params.drop_neutralised_days(days, endless).collect()] == ["b"]


def test_weekly_mean(spark):
    df = spark.createDataFrame([(12500,), (8900,), (22000,), (5400,)], "volumeBrut long")
    assert [r.traficMoyenHebdo for r in params.weekly_mean(df).collect()] == [1785, 1271, 3142, 771]
    assert params.weekly_mean(df, 6).first().traficMoyenHebdo == 2083
    with pytest.raises(ValueError):
        params.weekly_mean(df, 5)


def test_neutralised_days_of_overlapping_and_reversed_periods(spark):
    days = spark.createDataFrame(
        [(s, f"2025-01-{d:02d}", d) for s in ("a", "b") for d in range(1, 11)],
        "co_regate string, da_comptage string, trafic_reel long",
    )
    schema = "site_id string, dateDebut date, dateFin date"
    first = spark.createDataFrame([("a", date(2025, 1, 2), date(2025, 1, 5))], schema)
    second = spark.createDataFrame(
        [("a", date(2025, 1, 4), date(2025, 1, 7)), ("b", date(2025, 1, 9), date(2025, 1, 3))], schema
    )
    left = params.drop_neutralised_days(days, first, second).collect()
    assert sorted(r.trafic_reel for r in left if r.co_regate == "a") == [1, 8, 9, 10]
    assert sum(r.co_regate == "b" for r in left) == 10


def test_variation_is_held_in_its_bounds(spark):
    table = spark.createDataFrame(
        [("a", "T0", 200), ("a", "T1", 200), ("b", "T0", 200)],
        "co_regate string, co_type_objet string, nb_objet_retenu long",
    )
    rates = spark.createDataFrame(
        [("a", "T0", -50, 50, 80), ("a", "T1", -50, 50, -10)],
        "site_id string, categorie string, min int, max int, valeur int",
    )
    varied = params.apply_variation(table, rates, "nb_objet_retenu")
    assert sorted(r.trafic_varie for r in varied.collect()) == [180.0, 200.0, 300.0]


def test_integer_mean_and_single_parameters(spark):
    from tallyroute.operators import params

    big = spark.createDataFrame([(63050394783186951,)], "volumeBrut bigint")
    assert params.weekly_mean(big).first().traficMoyenHebdo == 9007199254740993
    row = spark.createDataFrame([("1", "T0", 100)], "co_regate string, co_type_objet string, n int")
    twice = spark.createDataFrame(
        [("1", "T0", 0, 50, 20), ("1", "T0", 0, 50, 10)],
        "site_id string, categorie string, min int, max int, valeur int",
    )
    assert [r.trafic_varie for r in params.apply_variation(row, twice, "n").collect()] == [120.0]
    sites = spark.createDataFrame([("1", "b"), ("1", "a")], "codeRegate string, codeRoc string")
    assert [r.codeRoc for r in params.site_bridge(row, sites).collect()] == ["a"]
