"""Inputs of the registered queries, derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyroute.constants import COUNT_CODES, GRAINS
from tallyroute.operators.edits import apply_count_edits, lookup_type, type_table
from tallyroute.sources.marts import traffic_scan, write_marts
from tallyroute.sources.shared import derived_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def marts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three traffic tables, stored once as they are in production."""
    root = derived_table(
        spark,
        sf_dir,
        "marts",
        lambda path: write_marts(
            table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier"), path
        ),
    )
    return {name: traffic_scan(spark, grain, root=root) for name, grain in GRAINS.items()}


def _bounds() -> tuple:
    key = F.col("s_suppkey")
    first = F.date_add(F.lit("1996-01-01").cast("date"), F.pmod(key * 37, F.lit(1500)).cast("int"))
    last = F.date_add(first, F.pmod(key * 53, F.lit(731)).cast("int"))
    return first, last


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One valid request per supplier, its bounds already dates."""
    first, last = _bounds()
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("request_id"),
        F.col("s_nationkey").cast("string").alias("co_regate"),
        first.alias("dt_debut"),
        last.alias("dt_fin"),
    )


def range_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many ranges of day keys per request over many sites: overlapping, open and reversed ones.

    Each supplier gives one range of request s_suppkey % 97 at its nation's site; every 13th has
    no start, every 17th no end, every 19th is reversed.
    """
    key = F.col("s_suppkey")
    first = F.date_add(F.lit("1996-01-01").cast("date"), F.pmod(key * 37, F.lit(1500)).cast("int"))
    last = F.date_add(first, F.pmod(key * 53, F.lit(200)).cast("int"))
    start, end = F.date_format(first, "yyyy-MM-dd"), F.date_format(last, "yyyy-MM-dd")
    reversed_ = F.pmod(key, F.lit(19)) == 0
    return table(spark, sf_dir, "supplier").select(
        F.pmod(key, F.lit(97)).cast("long").alias("request_id"),
        F.col("s_nationkey").cast("string").alias("co_regate"),
        F.when(F.pmod(key, F.lit(13)) == 0, None).when(reversed_, end).otherwise(start).alias("cle_debut"),
        F.when(F.pmod(key, F.lit(17)) == 0, None).when(reversed_, start).otherwise(end).alias("cle_fin"),
    )


def _typed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per supplier as text, in the shapes users type, right and wrong.

    The shape follows the supplier's key: dashed, compact, no site, no end, an
    impossible day, reversed, too long, short parts, compact without zeros, an
    unknown mode and a spaced day.
    """
    first, last = _bounds()
    kind = F.pmod("s_suppkey", F.lit(11))

    def text(day, pattern):
        return F.date_format(day, pattern)

    debut = (
        F.when(kind.isin(0, 2, 3, 6, 9), text(first, "yyyy-MM-dd"))
        .when(kind == 1, text(first, "yyyyMMdd"))
        .when(kind == 4, F.lit("20250230"))
        .when(kind == 5, text(F.date_add(last, 1), "yyyy-MM-dd"))
        .when(kind == 7, text(first, "yyyy-M-d"))
        .when(kind == 8, text(first, "yyyyMMd"))
        .when(kind == 10, F.concat(text(first, "yyyy-MM-"), F.lpad(text(first, "d"), 2, " ")))
    )
    fin = (
        F.when(kind == 3, F.lit(""))
        .when(kind.isin(1, 8), text(last, "yyyyMMdd"))
        .when(kind == 6, text(F.date_add(first, 731), "yyyy-MM-dd"))
        .when(kind == 7, text(last, "yyyy-M-d"))
        .otherwise(text(last, "yyyy-MM-dd"))
    )
    mode = (
        F.when(kind == 0, "AUTO")
        .when(kind == 1, "Jours")
        .when(kind == 7, "semaines")
        .when(kind == 8, "MOIS")
        .when(kind == 9, "annees")
        .when(kind == 10, "")
    )
    site = F.when(kind != 2, F.col("s_nationkey").cast("string"))
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("request_id"),
        mode.alias("periode"),
        site.alias("co_regate"),
        debut.alias("date_debut"),
        fin.alias("date_fin"),
    )


def raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests as typed, stored once."""
    typed = _typed_requests(spark, sf_dir)
    path = derived_table(
        spark, sf_dir, "demandes", lambda target: typed.write.mode("overwrite").parquet(target)
    )
    return spark.read.parquet(path)


# --- scenario tables ----------------------------------------------------------


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scenario per order; a hundred sites share them."""
    day = F.col("o_orderdate").cast("date")
    done = F.col("o_orderstatus") != "O"
    span = F.pmod("o_orderkey", F.lit(1200)).cast("int")
    statut = (
        F.when(F.col("o_orderstatus") == "F", "Validé")
        .when(F.col("o_orderstatus") == "O", "Brouillon")
        .otherwise("En production")
    )
    periode = F.struct(day.alias("dateDebut"), F.date_add(day, span).alias("dateFin"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.pmod("o_custkey", F.lit(100)).cast("string").alias("site_id"),
        F.concat(F.lit("Scénario "), F.col("o_orderkey")).alias("nom"),
        day.alias("dateCreation"),
        statut.alias("statut"),
        F.when(done, F.date_add(day, 15)).alias("dateValidation"),
        F.when(done, F.date_add(day, 30)).alias("dateMo"),
        F.when(F.col("o_orderstatus") == "P", F.date_add(day, 45)).alias("dateProduction"),
        F.when(done, periode).alias("periode"),
    )


def scenario_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios(spark, sf_dir).select(
        F.col("id").alias("scenario_id"), "periode.dateDebut", "periode.dateFin"
    )


def _write_counts(spark: SparkSession, sf_dir: str, path: str) -> None:
    sums = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_orderkey").alias("scenario_id"),
            (F.pmod("l_partkey", F.lit(6)) + 1).cast("int").alias("type_id"),
        )
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("valeur"))
    )
    # At most six rows per scenario are left to number.
    order = Window.partitionBy("scenario_id").orderBy("type_id")
    sums.select(
        "scenario_id", F.row_number().over(order).alias("id"), "type_id", "valeur"
    ).write.mode("overwrite").parquet(path)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each scenario, one per type, stored once."""
    path = derived_table(
        spark, sf_dir, "comptages", lambda target: _write_counts(spark, sf_dir, target)
    )
    return spark.read.parquet(path)


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def count_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit log of the counts: one edit per event, in the order of the events."""
    op = (
        F.when(F.col("event_type").isin("signup", "view"), "ajout")
        .when(F.col("event_type").isin("purchase", "click"), "modification")
        .otherwise("suppression")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("scenario_id"),
        op.alias("op"),
        (_k() % 7 + 1).alias("id"),
        F.when(_k() > 4, _k() % 8 + 1).alias("type_id"),
        F.when(_k() < 95, F.floor("value").cast("bigint") - 10).alias("valeur"),
    )


def edited_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after the edit log, stored once as the result of its own job."""

    def write(path: str) -> None:
        before, log = counts(spark, sf_dir), count_edits(spark, sf_dir)
        after = apply_count_edits(before, log, type_table(spark))
        after.write.mode("overwrite").parquet(path)

    return spark.read.parquet(derived_table(spark, sf_dir, "comptages_modifies", write))


def positioned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts as lists that are not in the order of their ids."""
    return counts(spark, sf_dir).withColumn("position", 7 - F.col("id"))


def edited_positioned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those lists after the edit log, stored once."""

    def write(path: str) -> None:
        before, log = positioned_counts(spark, sf_dir), count_edits(spark, sf_dir)
        apply_count_edits(before, log, type_table(spark)).write.mode("overwrite").parquet(path)

    return spark.read.parquet(derived_table(spark, sf_dir, "comptages_positions", write))


def new_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario names typed for the sites, some of them blank."""
    nom = F.when(_k() % 5 == 0, "   ").otherwise(
        F.concat(F.lit("  Plan "), F.col("event_id"), F.lit(" "))
    )
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type") == "signup")
        .select(
            F.col("event_id").alias("seq"),
            F.pmod("user_id", F.lit(100)).cast("string").alias("site_id"),
            nom.alias("nom"),
        )
    )


def scenario_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additions and deletions of scenarios interleaved in one log per site, in `seq` order.

    Additions are the typed names that pass validation (seq: the event); each error event deletes
    the site's largest stored id, or one or two above it, so deletions also hit ids that earlier
    additions of the log gave and numbers freed at the top are given again.
    """
    from tallyroute.operators.edits import accepted, validate_names

    adds = accepted(validate_names(new_scenarios(spark, sf_dir))).select(
        "site_id", "seq", F.lit("ajout").alias("op"), F.lit(None).cast("long").alias("id"), F.trim("nom").alias("nom")
    )
    top = scenarios(spark, sf_dir).groupBy("site_id").agg(F.max("id").alias("_haut"))
    errors = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    deletes = errors.select(
        F.pmod("user_id", F.lit(100)).cast("string").alias("site_id"), F.col("event_id").alias("seq")
    ).join(top, "site_id", "left").select(
        "site_id",
        "seq",
        F.lit("suppression").alias("op"),
        (F.coalesce("_haut", F.lit(0)) + F.pmod("seq", F.lit(3))).cast("long").alias("id"),
        F.lit(None).cast("string").alias("nom"),
    )
    return adds.unionByName(deletes)


def period_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One period edit per scenario; every seventh text is no date."""
    moved = F.date_add(
        F.col("o_orderdate").cast("date"),
        (F.pmod(F.col("o_orderkey") * 131, F.lit(9000)) - 3000).cast("int"),
    )
    text = F.when(F.col("o_orderkey") % 7 == 0, "bientôt").otherwise(moved.cast("string"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("scenario_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "debut").otherwise("fin").alias("cote"),
        text.alias("valeur"),
    )


def period_edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to four period edits per scenario; every seventh text is no date."""
    key, seq = F.col("o_orderkey"), F.col("seq")
    numbers = F.sequence(F.lit(1), (F.pmod(key, F.lit(4)) + 1).cast("int"))
    offset = F.pmod(key * 131 + seq * 977, F.lit(9000)) - 3000
    moved = F.date_add(F.col("o_orderdate").cast("date"), offset.cast("int"))
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_orderdate", F.explode(numbers).alias("seq"))
        .select(
            key.alias("scenario_id"),
            "seq",
            F.when((F.floor(key / 2) + seq) % 2 == 0, "debut").otherwise("fin").alias("cote"),
            F.when((key + seq) % 7 == 0, "bientôt").otherwise(moved.cast("string")).alias("valeur"),
        )
    )


# --- parameter tables -----------------------------------------------------------


def _orders_with(spark: SparkSession, sf_dir: str, priority: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == priority)


def neutralised_periods(
    spark: SparkSession, sf_dir: str, priority: str, site: str = "o_custkey"
) -> DataFrame:
    """Periods of the site `site`, from the orders of one priority."""
    day = F.col("o_orderdate").cast("date")
    length = F.pmod("o_orderkey", F.lit(5)).cast("int")
    orders = _orders_with(spark, sf_dir, priority)
    if site == "c_nationkey":
        customers = table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("o_custkey"), "c_nationkey"
        )
        orders = orders.join(customers, "o_custkey")
    return orders.select(
        F.col(site).cast("string").alias("site_id"),
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").alias("ordre"),
        day.alias("dateDebut"),
        F.date_add(day, length - 1).alias("dateFin"),
        F.when(length == 0, "").otherwise(F.concat(F.lit("Motif "), length)).alias("motif"),
    )


def customer_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("site_id"),
        F.concat(F.lit("ROC"), F.col("c_custkey")).alias("codeRoc"),
        F.col("c_nationkey").cast("string").alias("codeRegate"),
        F.col("c_name").alias("libelle"),
        F.col("c_mktsegment").alias("libelleCourt"),
        F.concat(F.col("c_name"), F.lit(" "), F.col("c_mktsegment")).alias("denomination"),
    )


def site_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product entries of some customer sites, from their unprioritised orders."""
    k = F.pmod("o_orderkey", F.lit(12))
    return _orders_with(spark, sf_dir, "4-NOT SPECIFIED").select(
        F.col("o_custkey").cast("string").alias("site_id"),
        F.col("o_orderkey").alias("ordre"),
        F.col("o_orderkey").cast("int").alias("id"),
        F.concat(F.lit("P"), k).alias("code"),
        F.concat(F.lit("Produit "), k).alias("libelle"),
        (F.col("o_orderstatus") == "F").alias("exclu"),
    )


def site_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variation entries of some customer sites, from their low-priority orders."""
    return _orders_with(spark, sf_dir, "5-LOW").select(
        F.col("o_custkey").cast("string").alias("site_id"),
        F.col("o_orderkey").alias("ordre"),
        F.concat(F.lit("C"), F.col("o_orderkey")).alias("categorie"),
        F.lit(-50).alias("min"),
        F.lit(50).alias("max"),
        (F.pmod("o_orderkey", F.lit(101)) - 50).cast("int").alias("valeur"),
    )


def payload_lists(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "periodesNeutralisees": neutralised_periods(spark, sf_dir, "1-URGENT"),
        "variationsTrafic": site_variations(spark, sf_dir),
        "neutralisationsPeak": neutralised_periods(spark, sf_dir, "2-HIGH"),
        "neutralisationsSecondaires": neutralised_periods(spark, sf_dir, "3-MEDIUM"),
        "produitsExclus": site_products(spark, sf_dir),
    }


def traffic_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of the sites the traffic tables are about."""
    key = F.col("n_nationkey").cast("string")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("ROC"), F.lpad(key, 3, "0")).alias("codeRoc"),
        key.alias("codeRegate"),
        F.col("n_name").alias("libelle"),
    )


def excluded_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product list of the traffic sites, from their customers."""
    codes = F.array(*[F.lit(c) for c in [*COUNT_CODES, "X01", "X02", "X03"]])
    return (
        table(spark, sf_dir, "customer")
        .groupBy(
            F.col("c_nationkey").cast("string").alias("site_id"),
            F.get(codes, F.pmod("c_custkey", F.lit(12)).cast("int")).alias("code"),
        )
        .agg((F.sum("c_custkey") % 2 == 0).alias("exclu"))
    )


def traffic_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variation of each traffic site and object type, some beyond their bounds."""
    return (
        table(spark, sf_dir, "customer")
        .groupBy(
            F.col("c_nationkey").cast("string").alias("site_id"),
            F.concat(F.lit("T"), F.pmod("c_custkey", F.lit(3))).alias("categorie"),
        )
        .agg((F.sum("c_custkey") % 121 - 60).cast("int").alias("valeur"))
        .withColumns({"min": F.lit(-50), "max": F.lit(50)})
    )


def computed_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross volume of each product brand."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return (
        table(spark, sf_dir, "lineitem")
        .join(parts, "l_partkey")
        .groupBy(F.col("p_brand").alias("produit"))
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("volumeBrut"))
    )


# --- JSON files -----------------------------------------------------------------


def _json_lines(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    return derived_table(spark, sf_dir, f"json/{name}", write)


def sites_json(spark: SparkSession, sf_dir: str) -> str:
    sites = customer_sites(spark, sf_dir).drop("site_id")
    return _json_lines(
        spark, sf_dir, "sites", lambda path: sites.write.mode("overwrite").json(path)
    )


def counts_json(spark: SparkSession, sf_dir: str) -> str:
    typed = lookup_type(counts(spark, sf_dir), type_table(spark))
    nested = typed.select(
        "scenario_id",
        "id",
        F.struct(F.col("type_id").alias("id"), "code", "libelle").alias("trafic"),
        "valeur",
    )
    return _json_lines(
        spark, sf_dir, "comptages", lambda path: nested.write.mode("overwrite").json(path)
    )


def scenarios_json(spark: SparkSession, sf_dir: str) -> str:
    """Folder with one sub-folder of scenarios per site."""
    keyed = scenarios(spark, sf_dir).withColumnRenamed("site_id", "scenarios-site")
    # Ranges over (site, id) keep the files few and cut a dominant site.
    return _json_lines(
        spark,
        sf_dir,
        "scenarios",
        lambda path: keyed.repartitionByRange("scenarios-site", "id")
        .write.mode("overwrite")
        .partitionBy("scenarios-site")
        .json(path),
    )
