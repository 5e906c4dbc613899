import json
from datetime import date

import pytest

from tallyroute.sources import json_assets


@pytest.fixture
def folder(tmp_path):
    def write(name, records):
        (tmp_path / name).write_text(json.dumps(records, indent=1), encoding="utf-8")

    write("points-site-A1.json", [
        {"id": 1, "nom": "Été", "statut": "Validé", "dateCreation": "2025-01-15", "dateMo": None,
         "periode": {"dateDebut": "2025-05-01", "dateFin": "2025-05-01"}},
        {"id": 2, "nom": "Bis", "statut": "Brouillon", "dateCreation": "2025-03-10", "periode": None},
    ])
    write("points-site-B2.json", [{"id": 3, "nom": "Ter", "dateCreation": "2024-12-20"}])
    write("points-site-A12.json", [{"id": 4, "nom": "Quater"}])
    write("comptages-scenario-7.json", [{"id": 1, "trafic": {"id": 2, "code": "PL", "libelle": "Lourds"}, "valeur": 9}])
    return str(tmp_path)


def scan(spark, folder, value=None, prefix="points-site"):
    return json_assets.keyed_file_scan(spark, folder, prefix, json_assets.SCENARIO, "site_id", value)


def test_key_comes_from_the_file_name(spark, folder):
    rows = {r.id: r.site_id for r in scan(spark, folder).collect()}
    assert rows == {1: "A1", 2: "A1", 3: "B2", 4: "A12"}


def test_one_key_reads_its_own_file(spark, folder):
    only = scan(spark, folder, "A1")
    assert sorted(r.id for r in only.collect()) == [1, 2]
    assert len(only.inputFiles()) == 1


def test_missing_file_is_an_empty_table(spark, folder):
    for empty in (scan(spark, folder, "C3"), scan(spark, folder, prefix="nothing")):
        assert empty.count() == 0
        assert empty.columns == scan(spark, folder).columns


def test_null_struct_gives_null_fields(spark, folder):
    flat = json_assets.nested_flatten(scan(spark, folder, "A1"), "periode", "periode_")
    rows = {r.id: (r.periode_dateDebut, r.periode_dateFin) for r in flat.collect()}
    assert rows == {1: (date(2025, 5, 1), date(2025, 5, 1)), 2: (None, None)}


def test_nested_type_of_a_count(spark, folder):
    records = json_assets.json_reference_scan(spark, f"{folder}/comptages-scenario-7.json", json_assets.COUNT)
    row = json_assets.nested_flatten(records, "trafic", "trafic_").first()
    assert (row.id, row.trafic_id, row.trafic_code, row.valeur) == (1, 2, "PL", 9)


def test_keys_may_hold_any_character(spark, tmp_path):
    names = ["A.1", "A.2", "Été 3", "a+b", "x{y}*", "50%"]
    for i, name in enumerate(names):
        (tmp_path / f"liste-{name}.json").write_text(f'{{"id": {i}}}\n')
    read = lambda value=None: json_assets.keyed_file_scan(
        spark, str(tmp_path), "liste", "id int", "cle", value, multi_line=False
    )
    assert {r.cle: r.id for r in read().collect()} == {n: i for i, n in enumerate(names)}
    for i, name in enumerate(names):
        assert [(r.id, r.cle) for r in read(name).collect()] == [(i, name)]
    assert read("").count() == 0
