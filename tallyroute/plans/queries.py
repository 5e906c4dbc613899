"""The registered queries: each operator run over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroute.constants import GRAINS, JOURS, MOIS, SEMAINES
from tallyroute.functions.dates import period_key
from tallyroute.operators import calendar, edits, params, periods, profile, requests, routing
from tallyroute.operators import traffic
from tallyroute.plans import inputs
from tallyroute.plans.answers import calendar_answer, traffic_answer
from tallyroute.sources import json_assets
from tallyroute.sources.marts import public_columns

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _as_of() -> Column:
    return F.lit("1998-06-15").cast("date")


def _text(records: str, *fields: str) -> Column:
    """An array of structs as text, one form for both engines."""
    return F.array_join(
        F.transform(records, lambda r: F.concat_ws(":", *[r[f].cast("string") for f in fields])),
        ";",
    )


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return routing.decompose_auto(inputs.requests(spark, sf))


# --- scans ----------------------------------------------------------------------


@query
def traffic_scan(spark, sf):
    return public_columns(inputs.marts(spark, sf)["jours"])


@query
def json_reference_scan(spark, sf):
    path = inputs.sites_json(spark, sf)
    return json_assets.json_reference_scan(spark, path, json_assets.SITE, multi_line=False)


def _scenario_files(spark, sf, value=None):
    return json_assets.keyed_file_scan(
        spark,
        inputs.scenarios_json(spark, sf),
        "scenarios-site",
        json_assets.SCENARIO,
        "site_id",
        value,
        multi_line=False,
    )


@query
def keyed_file_scan(spark, sf):
    return json_assets.nested_flatten(_scenario_files(spark, sf), "periode", "periode_")


@query
def keyed_file_scan_absent(spark, sf):
    """A key without a file next to one that has some."""
    absent = _scenario_files(spark, sf, "absent")
    found = absent.unionByName(_scenario_files(spark, sf, "7"))
    return found.groupBy("site_id").agg(F.count(F.lit(1)).alias("scenarios"))


@query
def nested_flatten(spark, sf):
    path = inputs.counts_json(spark, sf)
    schema = f"scenario_id bigint, {json_assets.COUNT}"
    records = json_assets.json_reference_scan(spark, path, schema, multi_line=False)
    return json_assets.nested_flatten(records, "trafic", "trafic_")


# --- projections and filters ------------------------------------------------------


@query
def site_filter(spark, sf):
    return public_columns(traffic.site_filter(inputs.marts(spark, sf)["jours"], "7"))


@query
def multi_range_filter(spark, sf):
    ranges = [
        ("1996-02-26", "1996-03-03"),
        ("1997-12-29", "1998-01-11"),
        ("1999-06-01", "1999-06-01"),
        ("2000-01-01", "2000-12-31"),
    ]
    days = inputs.marts(spark, sf)["jours"]
    return public_columns(traffic.multi_range_filter(days, JOURS, "12", ranges))


@query
def multi_range_filter_batched(spark, sf):
    days = inputs.marts(spark, sf)["jours"]
    return traffic.ranges_filter(days, JOURS, inputs.range_requests(spark, sf))


@query
def project_all(spark, sf):
    return public_columns(inputs.marts(spark, sf)["semaines"])


@query
def level_filter(spark, sf):
    return public_columns(traffic.level_filter(inputs.marts(spark, sf)["jours"]))


@query
def product_in_filter(spark, sf):
    return public_columns(traffic.product_filter(inputs.marts(spark, sf)["jours"]))


@query
def harmonise_grain(spark, sf):
    marts = inputs.marts(spark, sf)
    parts = [traffic.harmonise_grain(marts[n], g) for n, g in GRAINS.items()]
    return public_columns(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query
def table_preview(spark, sf):
    return traffic.table_preview(inputs.marts(spark, sf)["semaines"], SEMAINES, 10, site="3")


@query
def scenarios_of_site(spark, sf):
    found = edits.scenarios_of_site(inputs.scenarios(spark, sf), "42")
    return json_assets.nested_flatten(found, "periode", "periode_")


@query
def counts_of_scenario(spark, sf):
    return edits.counts_of_scenario(inputs.counts(spark, sf), 17)


# --- routing ----------------------------------------------------------------------


@query
def decompose_weeks_days(spark, sf):
    return routing.decompose_weeks_days(inputs.requests(spark, sf), "dt_debut", "dt_fin")


@query
def decompose_auto(spark, sf):
    return _segments(spark, sf)


@query
def segments_by_grain(spark, sf):
    grouped = routing.segments_by_grain(inputs.requests(spark, sf))
    return grouped.withColumn("plages", _text("plages", "cle_debut", "cle_fin"))


@query
def period_keys(spark, sf):
    days = inputs.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("jour")
    )
    jour = F.col("jour")
    return days.select(
        "o_orderkey",
        period_key(jour, JOURS).alias("cle_jour"),
        period_key(jour, SEMAINES).alias("cle_semaine"),
        period_key(jour, MOIS).alias("cle_mois"),
    )


@query
def concat_grains(spark, sf):
    return routing.concat_grains(inputs.marts(spark, sf))


@query
def route_traffic(spark, sf):
    return routing.route_traffic(_segments(spark, sf), inputs.marts(spark, sf))


@query
def route_fixed_grain(spark, sf):
    judged = requests.validate_mode_requests(inputs.raw_requests(spark, sf))
    segments = routing.build_segments(requests.valid(judged))
    return routing.route_traffic(segments, inputs.marts(spark, sf))


@query
def routing_preview(spark, sf):
    return routing.routing_preview(_segments(spark, sf))


# --- validation ---------------------------------------------------------------------


@query
def parse_dates(spark, sf):
    return requests.parse_dates(inputs.raw_requests(spark, sf)).select(
        "request_id", "dt_debut", "dt_fin"
    )


@query
def validate_requests(spark, sf):
    return requests.validate_requests(inputs.raw_requests(spark, sf)).select(
        "request_id", "dt_debut", "dt_fin", "manquants", "ecart_jours", "motif"
    )


@query
def validate_mode_requests(spark, sf):
    return requests.validate_mode_requests(inputs.raw_requests(spark, sf)).select(
        "request_id", "mode", "motif"
    )


@query
def validate_calendar_requests(spark, sf):
    return requests.validate_calendar_requests(inputs.raw_requests(spark, sf)).select(
        "request_id", "dt_debut", "dt_fin", "manquants", "ecart_jours", "motif"
    )


@query
def validate_counts(spark, sf):
    added = inputs.count_edits(spark, sf).filter(F.col("op") == "ajout")
    return edits.validate_counts(added).select("seq", "type_id", "valeur", "motif_rejet")


@query
def validate_names(spark, sf):
    return edits.validate_names(inputs.new_scenarios(spark, sf))


@query
def validate_periods(spark, sf):
    typed = inputs.scenario_periods(spark, sf).select(
        "scenario_id",
        F.coalesce(F.col("dateDebut").cast("string"), F.lit("")).alias("dateDebut"),
        F.coalesce(F.col("dateFin").cast("string"), F.lit("")).alias("dateFin"),
    )
    return edits.validate_periods(typed)


# --- aggregates and calendar ----------------------------------------------------------


@query
def traffic_group_sum(spark, sf):
    return traffic.traffic_group_sum(_segments(spark, sf), inputs.marts(spark, sf))


@query
def traffic_count_only(spark, sf):
    asked = inputs.requests(spark, sf)
    return traffic.traffic_count_only(asked, _segments(spark, sf), inputs.marts(spark, sf))


@query
def result_count(spark, sf):
    asked = inputs.requests(spark, sf)
    return traffic.result_count(asked, _segments(spark, sf), inputs.marts(spark, sf))


@query
def open_days_by_week(spark, sf):
    return calendar.open_days_by_week(inputs.requests(spark, sf))


@query
def open_days_total(spark, sf):
    return calendar.open_days_total(inputs.requests(spark, sf))


@query
def traffic_headers(spark, sf):
    """Headers of the answers to typed requests."""
    return traffic_answer(inputs.raw_requests(spark, sf), inputs.marts(spark, sf)).headers


@query
def traffic_headers_limited(spark, sf):
    """Headers of the answers to typed requests, five rows per grain at most."""
    return traffic_answer(inputs.raw_requests(spark, sf), inputs.marts(spark, sf), 5).headers


@query
def calendar_headers(spark, sf):
    return calendar_answer(inputs.raw_requests(spark, sf)).headers


def _tables(spark, sf):
    return {name: inputs.table(spark, sf, name) for name in TABLES}


@query
def dataset_row_counts(spark, sf):
    return profile.dataset_row_counts(_tables(spark, sf))


@query
def dataset_row_counts_footers(spark, sf):
    return profile.footer_row_counts(spark, {t: f"{sf}/{t}.parquet" for t in TABLES})


@query
def column_profile(spark, sf):
    return profile.column_profile(_tables(spark, sf))


@query
def order_by_name(spark, sf):
    """Tables and columns in the order of their names."""
    ordered = profile.column_profile(_tables(spark, sf)).orderBy("table_name", "column_name")
    return ordered.select("table_name", "column_name", "ordinal_position")


@query
def nested_schema_report(spark, sf):
    report = profile.nested_schema_report(_tables(spark, sf))
    fields = ["ordinal_position", "column_name", "column_type", "is_nullable", "null_count"]
    return report.select(
        "table_name", F.size("columns").alias("column_count"), _text("columns", *fields).alias("columns")
    )


# --- limits and pages -------------------------------------------------------------------


@query
def limit_per_grain(spark, sf):
    routed = routing.route_traffic(_segments(spark, sf), inputs.marts(spark, sf))
    return traffic.limit_per_grain(routed, 5)


@query
def table_sample(spark, sf):
    inputs.table(spark, sf, "orders").createOrReplaceTempView("sampled_orders")
    return traffic.table_sample(spark, "sampled_orders", 25, order=["o_orderkey"])


@query
def paginate_result(spark, sf):
    routed = routing.route_traffic(_segments(spark, sf), inputs.marts(spark, sf))
    return traffic.paginate_result(routed, 2, 20)


# --- edits ------------------------------------------------------------------------------


@query
def available_types(spark, sf):
    every = inputs.scenarios(spark, sf).select(F.col("id").alias("scenario_id"))
    return edits.available_types(every, inputs.counts(spark, sf))


@query
def lookup_type(spark, sf):
    added = inputs.count_edits(spark, sf).filter(F.col("op") == "ajout")
    found = edits.lookup_type(added, edits.type_table(spark))
    return found.select("seq", "scenario_id", "type_id", "code", "libelle", "valeur")


@query
def default_fallback(spark, sf):
    return edits.default_fallback(
        inputs.customer_sites(spark, sf), inputs.site_products(spark, sf)
    )


@query
def new_scenario_defaults(spark, sf):
    named = edits.accepted(edits.validate_names(inputs.new_scenarios(spark, sf)))
    fresh = edits.new_scenario_defaults(named, _as_of())
    return json_assets.nested_flatten(fresh, "periode", "periode_")


@query
def append_with_next_id(spark, sf):
    """Scenarios after deletions and additions: freed numbers are given again."""
    stored = inputs.scenarios(spark, sf)
    urgent = inputs.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    deleted = urgent.select(
        F.pmod("o_custkey", F.lit(100)).cast("string").alias("site_id"),
        F.col("o_orderkey").alias("id"),
    )
    kept = edits.delete_by_id(stored, deleted, "site_id")
    named = edits.accepted(edits.validate_names(inputs.new_scenarios(spark, sf)))
    fresh = edits.new_scenario_defaults(named, _as_of())
    added = edits.append_with_next_id(kept, fresh, "site_id")
    return json_assets.nested_flatten(added, "periode", "periode_")


@query
def append_interleaved(spark, sf):
    """Scenarios after one log of additions and deletions applied in order, per site."""
    stored = inputs.scenarios(spark, sf).select("site_id", "id", "nom")
    log = inputs.scenario_log(spark, sf)
    given, alive = edits.fold_log(stored, log, "site_id")
    latest = (
        given.join(log.filter("op = 'ajout'").select("site_id", "seq", "nom"), ["site_id", "seq"])
        .groupBy("site_id", "id")
        .agg(F.max_by("nom", "seq").alias("_nom"), F.max("seq").alias("seq"))
    )
    return (
        alive.join(latest, ["site_id", "id"], "left")
        .join(stored, ["site_id", "id"], "left")
        .select("site_id", "id", F.coalesce("_nom", "nom").alias("nom"), "seq")
    )


@query
def delete_by_id(spark, sf):
    removed = inputs.count_edits(spark, sf).filter(F.col("op") == "suppression")
    return edits.delete_by_id(inputs.counts(spark, sf), removed, "scenario_id")


@query
def update_values(spark, sf):
    changed = inputs.count_edits(spark, sf).filter(F.col("op") == "modification")
    return edits.update_values(inputs.counts(spark, sf), changed, "scenario_id", "valeur")


@query
def apply_count_edits(spark, sf):
    return edits.apply_count_edits(
        inputs.counts(spark, sf), inputs.count_edits(spark, sf), edits.type_table(spark)
    )


@query
def detect_changes(spark, sf):
    return edits.detect_changes(inputs.counts(spark, sf), inputs.edited_counts(spark, sf))


@query
def detect_changes_by_position(spark, sf):
    """Changes of lists that are not in the order of their ids."""
    before = inputs.positioned_counts(spark, sf)
    after = inputs.edited_positioned_counts(spark, sf)
    return edits.detect_changes(before, after, order="position")


def _payload_lists(spark, sf):
    lists = inputs.payload_lists(spark, sf)
    for name in ("periodesNeutralisees", "neutralisationsPeak", "neutralisationsSecondaires"):
        lists[name] = edits.new_neutralised_periods(lists[name])
    return lists


@query
def param_entries(spark, sf):
    """All parameter entries in long form, some of an unknown site and some of none."""
    site = (
        F.when(F.col("ordre") % 50 == 0, "inconnu")
        .when(F.col("ordre") % 50 == 1, F.lit(None))
        .otherwise(F.col("site_id"))
    )
    lists = {n: df.withColumn("site_id", site) for n, df in _payload_lists(spark, sf).items()}
    named = params.with_site(params.param_entries(lists), inputs.customer_sites(spark, sf))
    texts = [
        F.when(F.col("liste") == name, F.concat_ws(":", *[F.col(name)[f].cast("string") for f in fields]))
        for name, fields in params.PAYLOAD_LISTS.items()
    ]
    return named.select(
        "site_id", "liste", "rang", F.col("site.libelle").alias("libelle"), F.coalesce(*texts).alias("texte")
    )


@query
def param_payload(spark, sf):
    lists = _payload_lists(spark, sf)
    payload = params.param_payload(inputs.customer_sites(spark, sf), lists, entries=10_000)
    return payload.select(
        "site_id",
        "partie",
        "site.*",
        *[_text(name, *fields).alias(name) for name, fields in params.PAYLOAD_LISTS.items()],
    )


# --- periods ----------------------------------------------------------------------------


# Bounds that fit the dates of the given tables.
BOUNDS = ("1996-01-01", "2001-06-30")


def _periods(spark, sf):
    return periods.default_periods(inputs.scenario_periods(spark, sf), _as_of(), *BOUNDS)


@query
def normalise_periods(spark, sf):
    return periods.normalise_periods(inputs.scenario_periods(spark, sf), *BOUNDS)


@query
def default_periods(spark, sf):
    return _periods(spark, sf)


@query
def apply_period_edits(spark, sf):
    return periods.apply_period_edits(_periods(spark, sf), inputs.period_edits(spark, sf), *BOUNDS)


@query
def apply_period_edit_log(spark, sf):
    """Several edits per scenario, each on what the last one left."""
    log = inputs.period_edit_log(spark, sf)
    return periods.apply_period_edits(_periods(spark, sf), log, *BOUNDS)


@query
def period_duration(spark, sf):
    return periods.period_duration(_periods(spark, sf))


@query
def period_position(spark, sf):
    return periods.period_position(_periods(spark, sf), _as_of())


# --- parameters -------------------------------------------------------------------------


@query
def weekly_mean(spark, sf):
    return params.weekly_mean(inputs.computed_traffic(spark, sf), 7)


@query
def drop_neutralised_days(spark, sf):
    lists = [
        inputs.neutralised_periods(spark, sf, p, "c_nationkey")
        for p in ("1-URGENT", "2-HIGH", "3-MEDIUM")
    ]
    return params.drop_neutralised_days(public_columns(inputs.marts(spark, sf)["jours"]), *lists)


@query
def drop_excluded_products(spark, sf):
    days = public_columns(inputs.marts(spark, sf)["jours"])
    return params.drop_excluded_products(days, inputs.excluded_products(spark, sf))


@query
def apply_variation(spark, sf):
    days = public_columns(inputs.marts(spark, sf)["jours"])
    return params.apply_variation(days, inputs.traffic_variations(spark, sf), JOURS.measure)


@query
def site_bridge(spark, sf):
    days = public_columns(inputs.marts(spark, sf)["jours"])
    return params.site_bridge(days, inputs.traffic_sites(spark, sf))
