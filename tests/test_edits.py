import random
from collections import defaultdict
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyroute.operators import edits

COUNTS = "scenario_id long, id int, type_id int, valeur long"
LOG = "seq long, scenario_id long, op string, id int, type_id int, valeur long"


def apply_one_by_one(rows, log):
    """The edits made on the page, one after the other."""
    tables, counters = defaultdict(dict), defaultdict(int)
    for s, i, t, v in rows:
        tables[s][i] = (t, v)
        counters[s] = max(counters[s], i)
    for _, s, op, i, t, v in sorted(log):
        if op == "ajout":
            if t in range(1, 7) and v is not None and v >= 0:
                counters[s] += 1
                tables[s][counters[s]] = (t, v)
        elif op == "suppression":
            tables[s].pop(i, None)
        elif i in tables[s]:
            tables[s][i] = (tables[s][i][0], v)
    return {(s, i, t, v) for s, table in tables.items() for i, (t, v) in table.items()}


def test_batch_equals_one_edit_at_a_time(spark):
    rng = random.Random(4)
    rows = [(s, i, rng.randrange(1, 7), rng.randrange(100)) for s in range(8) for i in range(1, rng.randrange(2, 6))]
    log = []
    for seq in range(600):
        op = rng.choice(["ajout", "ajout", "modification", "suppression"])
        kind = rng.choice([None, 1, 2, 3, 4, 5, 6, 9])
        value = rng.choice([None, -1, rng.randrange(100), rng.randrange(100)])
        scenario = rng.choice([0, 0, 0, rng.randrange(10)])
        log.append((seq, scenario, op, rng.randrange(1, 25), kind, value))
    shuffled = log[:]
    rng.shuffle(shuffled)
    got = edits.apply_count_edits(
        spark.createDataFrame(rows, COUNTS),
        spark.createDataFrame(shuffled, LOG),
        edits.type_table(spark),
    )
    assert {tuple(r) for r in got.collect()} == apply_one_by_one(rows, log)


def test_update_keeps_the_last_value_even_if_null(spark):
    counts = spark.createDataFrame([(1, 1, 1, 5), (1, 2, 2, 6), (2, 1, 1, 7)], COUNTS)
    log = spark.createDataFrame(
        [(1, 1, 1, 50), (2, 1, 1, 51), (3, 1, 2, 60), (4, 1, 2, None)],
        "seq long, scenario_id long, id int, valeur long",
    )
    got = edits.update_values(counts, log, "scenario_id", "valeur")
    assert {(r.scenario_id, r.id): r.valeur for r in got.collect()} == {(1, 1): 51, (1, 2): None, (2, 1): 7}


def test_update_by_another_key(spark):
    table = spark.createDataFrame([("s", "OO", 0), ("s", "OS", 5)], "site_id string, categorie string, valeur int")
    log = spark.createDataFrame([(1, "s", "OS", 9)], "seq long, site_id string, categorie string, valeur int")
    got = edits.update_values(table, log, "site_id", "valeur", key="categorie")
    assert {r.categorie: r.valeur for r in got.collect()} == {"OO": 0, "OS": 9}


def test_scenario_numbers_are_given_again_but_count_numbers_are_not(spark):
    current = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3), ("t", 9)], "site_id string, id long")
    gone = spark.createDataFrame([("s", 3), ("s", 3)], "site_id string, id long")
    fresh = spark.createDataFrame([("s", 5), ("s", 4), ("new", 6)], "site_id string, seq long")
    kept = edits.delete_by_id(current, gone, "site_id")
    reused = edits.append_with_next_id(kept, fresh, "site_id")
    assert sorted(map(tuple, reused.collect())) == [("new", 1), ("s", 1), ("s", 2), ("s", 3), ("s", 4), ("t", 9)]
    counted = edits.append_with_next_id(kept, fresh, "site_id", counter=current)
    assert sorted(map(tuple, counted.collect())) == [("new", 1), ("s", 1), ("s", 2), ("s", 4), ("s", 5), ("t", 9)]


def test_order_matters_for_changes_and_ids_do_not(spark):
    before = spark.createDataFrame(
        [(1, 1, 1, 10), (1, 2, 2, 20), (2, 1, 1, 10), (2, 2, 2, 20), (3, 1, 1, 5), (4, 1, 1, None), (6, 1, 1, 1)],
        COUNTS,
    )
    after = spark.createDataFrame(
        [(1, 4, 1, 10), (1, 7, 2, 20), (2, 1, 2, 20), (2, 2, 1, 10), (3, 1, 1, 5), (3, 2, 2, 6), (4, 1, 1, None), (5, 1, 1, 1)],
        COUNTS,
    )
    got = {r.scenario_id: r.modifie for r in edits.detect_changes(before, after).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: True, 6: True}


def test_changes_go_by_the_place_in_the_file(spark):
    """A file lists id 5 before id 1; id 1 is removed and its like added again."""
    counts = spark.createDataFrame(
        [(1, 5, 1, 10, 1), (1, 1, 2, 20, 2)],
        "scenario_id long, id int, type_id int, valeur long, position int",
    )
    log = spark.createDataFrame(
        [(1, 1, "suppression", 1, None, None), (2, 1, "ajout", None, 2, 20)],
        "seq long, scenario_id long, op string, id int, type_id int, valeur long",
    )
    after = edits.apply_count_edits(counts, log, edits.type_table(spark))
    assert edits.detect_changes(counts, after, order="position").first().modifie is False


def test_names_are_trimmed_and_blank_ones_refused(spark):
    rows = [(1, "s", "\t Plan A  "), (2, "s", "  \n"), (3, "s", None), (4, "s", "a b")]
    typed = spark.createDataFrame(rows, "seq long, site_id string, nom string")
    fresh = edits.new_scenario_defaults(edits.accepted(edits.validate_names(typed)), F.lit("2025-01-02").cast("date"))
    got = sorted((r.seq, r.nom, r.dateCreation, r.statut, r.periode) for r in fresh.collect())
    assert got == [(1, "Plan A", date(2025, 1, 2), "Brouillon", None), (4, "a b", date(2025, 1, 2), "Brouillon", None)]


def test_new_periods_need_both_dates_and_drop_an_empty_reason(spark):
    rows = [("2025-01-02", "2025-01-01", ""), ("", "2025-01-01", "x"), ("2025-01-01", None, "x"), ("2025-01-01", "2025-01-02", " ")]
    typed = spark.createDataFrame(rows, "dateDebut string, dateFin string, motif string")
    got = edits.new_neutralised_periods(edits.accepted(edits.validate_periods(typed)))
    assert sorted((r.dateDebut, r.motif or "none") for r in got.collect()) == [("2025-01-01", " "), ("2025-01-02", "none")]


def test_no_site_and_no_scenario_give_nothing(spark):
    scenarios = spark.createDataFrame([("s", 1), (None, 2)], "site_id string, id long")
    counts = spark.createDataFrame([(1, 1, 1, 5)], COUNTS)
    assert edits.scenarios_of_site(scenarios, None).count() == 0
    assert edits.counts_of_scenario(counts, None).count() == 0
    assert edits.counts_of_scenario(counts, 1).count() == 1


def test_free_types_and_default_products(spark):
    scenarios = spark.createDataFrame([(1,), (2,)], "scenario_id long")
    counts = spark.createDataFrame([(1, 1, 1, 5), (1, 2, 4, 5), (1, 3, 9, 5)], COUNTS)
    free = defaultdict(set)
    for r in edits.available_types(scenarios, counts).collect():
        free[r.scenario_id].add(r.code)
    assert free == {1: {"PL", "2RM", "VELO", "PIET"}, 2: {"VL", "PL", "2RM", "TC", "VELO", "PIET"}}
    sites = spark.createDataFrame([("a",), ("b",), (None,)], "site_id string")
    own = spark.createDataFrame([("a", 7, "X", "x", True)], "site_id string, id int, code string, libelle string, exclu boolean")
    lists = defaultdict(set)
    for r in edits.default_fallback(sites, own).collect():
        lists[r.site_id].add((r.code, r.exclu))
    default = {(f"P0{i}", False) for i in range(1, 6)}
    assert lists == {"a": {("X", True)}, "b": default, None: default}


@pytest.mark.parametrize("kind,value,motif", [(None, 1, "type"), (1, None, "valeur"), (1, -1, "negatif"), (1, 0, None)])
def test_count_rules(spark, kind, value, motif):
    df = spark.createDataFrame([(kind, value)], "type_id int, valeur long")
    assert edits.validate_counts(df).first().motif_rejet == motif


def _brute_fold(current, log):
    alive = {}
    for g, i in current:
        alive.setdefault(g, set()).add(i)
    given = []
    for g, seq, op, i in sorted(log, key=lambda r: (r[0], r[1], r[2], -1 if r[3] is None else r[3])):
        ids = alive.setdefault(g, set())
        if op == "ajout":
            n = max(ids, default=0) + 1
            ids.add(n)
            given.append((g, seq, n))
        elif i is not None:
            ids.discard(i)
    return sorted(given), sorted((g, i) for g, s in alive.items() for i in s)


@pytest.mark.parametrize("block", [1, 7, 1_000_000])
def test_fold_log_any_block(spark, block):
    import random

    rng = random.Random(block)
    current = [("a", 1), ("a", 2), ("a", 3), ("b", 10)]
    log = [
        ("a", 1, "ajout", None), ("a", 2, "suppression", 4), ("a", 3, "ajout", None),  # 4, freed, 4 again
        ("a", 4, "suppression", 2), ("a", 5, "ajout", None), ("c", 1, "ajout", None),
        ("c", 2, "suppression", 1), ("c", 3, "ajout", None), ("b", 5, "suppression", None),
    ]
    # A third of the log in one site.
    log += [("h", rng.randint(0, 300), rng.choice(["ajout", "suppression"]), rng.randint(0, 9)) for _ in range(40)]
    log += [(rng.choice("bdx"), rng.randint(0, 300), rng.choice(["ajout", "suppression"]), rng.randint(0, 12)) for _ in range(40)]
    cur = spark.createDataFrame(current, "site string, id long")
    lg = spark.createDataFrame(log, "site string, seq long, op string, id long")
    given, alive = edits.fold_log(cur, lg, "site", block)
    want_given, want_alive = _brute_fold(current, log)
    assert sorted(tuple(r) for r in given.collect()) == want_given
    assert sorted(tuple(r) for r in alive.collect()) == want_alive
    assert [r for r in want_given if r[0] == "a"] == [("a", 1, 4), ("a", 3, 4), ("a", 5, 5)]


def test_fold_log_empty(spark):
    cur = spark.createDataFrame([("a", 1)], "site string, id long")
    lg = spark.createDataFrame([], "site string, seq long, op string, id long")
    given, alive = edits.fold_log(cur, lg, "site")
    assert given.count() == 0 and [tuple(r) for r in alive.collect()] == [("a", 1)]
