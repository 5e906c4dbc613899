"""The three traffic tables: reading them, and building them from shipments.

A stored table carries one more column, `annee`: the year of its period key.
It is the partition column of the files, so a join that includes it prunes
whole years, and files are range-clustered by site and key within a year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroute.constants import (
    COUNT_CODES,
    DEFAULT_CATALOG,
    DEFAULT_SCHEMA,
    DESCRIPTIVE_COLUMNS,
    GRAINS,
    JOURS,
    SITE_LEVEL,
    Grain,
)
from tallyroute.functions.dates import key_year, period_key, period_start

PARTITION = "annee"


def traffic_scan(
    spark: SparkSession,
    grain: Grain,
    catalog: str = DEFAULT_CATALOG,
    schema: str = DEFAULT_SCHEMA,
    root: str | None = None,
) -> DataFrame:
    """Table of a grain, by qualified name or below the folder `root`."""
    if root is None:
        return spark.table(f"{catalog}.{schema}.{grain.table}")
    return spark.read.parquet(f"{root}/{grain.table}")


def public_columns(table: DataFrame) -> DataFrame:
    """The table as its readers know it, without the storage column."""
    return table.drop(PARTITION)


def day_mart(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """Daily traffic per site and count code, from shipped quantities.

    The twelve codes stand for parts, the supplier's nation for the site.
    """
    codes = F.array(*[F.lit(c) for c in [*COUNT_CODES, "X01", "X02", "X03"]])
    code = F.pmod(F.col("l_partkey"), F.lit(12)).cast("int")
    sums = (
        lineitem.select(
            "l_suppkey",
            code.alias("code"),
            F.col("l_shipdate").cast("date").alias("jour"),
            F.col("l_quantity").cast("bigint").alias("quantite"),
        )
        .join(
            supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey"
        )
        .groupBy("s_nationkey", "code", "jour")
        .agg(F.sum("quantite").alias(JOURS.measure))
    )
    site = F.col("s_nationkey").cast("string")
    co_objet = F.concat(F.lit("O"), (F.col("code") % 4).cast("string"))
    co_type = F.concat(F.lit("T"), (F.col("code") % 2).cast("string"))
    co_comptage = F.get(codes, F.col("code"))
    level = F.when(F.col("s_nationkey") % 5 == 0, "ZONE").otherwise(SITE_LEVEL)
    return sums.select(
        level.alias("co_niveau_regroupement_operationnel"),
        site.alias("co_regate"),
        F.concat(F.lit("Site "), site).alias("lb_entite"),
        co_comptage.alias("co_comptage"),
        F.concat(F.lit("Comptage "), co_comptage).alias("lb_comptage"),
        co_objet.alias("co_objet"),
        F.concat(F.lit("Objet "), co_objet).alias("lb_objet"),
        co_type.alias("co_type_objet"),
        F.concat(F.lit("Type "), co_type).alias("lb_type_objet"),
        period_key(F.col("jour"), JOURS).alias(JOURS.key),
        JOURS.measure,
        F.year("jour").alias(PARTITION),
    )


def roll_up(days: DataFrame, grain: Grain) -> DataFrame:
    """Weekly or monthly table from the daily one."""
    day = F.col(JOURS.key).cast("date")
    start = F.col("debut")
    keyed = days.withColumn("debut", period_start(day, grain))
    sums = keyed.groupBy(*DESCRIPTIVE_COLUMNS, "debut").agg(
        F.sum(JOURS.measure).alias(grain.measure)
    )
    dates = [
        key_year(start, grain).alias("co_annee_comptage"),
        period_key(start, grain).alias(grain.key),
    ]
    if grain.name == "semaines":
        dates.append(start.alias("da_lundi_semaine_comptage"))
    return sums.select(
        *DESCRIPTIVE_COLUMNS, *dates, grain.measure, key_year(start, grain).alias(PARTITION)
    )


def write_mart(mart: DataFrame, grain: Grain, root: str) -> None:
    # Ranges over (year, site, key) cut a dominant site into several files.
    order = [PARTITION, "co_regate", grain.key]
    (
        mart.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .partitionBy(PARTITION)
        .parquet(f"{root}/{grain.table}")
    )


def write_marts(lineitem: DataFrame, supplier: DataFrame, root: str) -> None:
    """Write the three tables; weeks and months are summed from the stored days."""
    spark = lineitem.sparkSession
    write_mart(day_mart(lineitem, supplier), JOURS, root)
    days = traffic_scan(spark, JOURS, root=root)
    for grain in GRAINS.values():
        if grain is not JOURS:
            write_mart(roll_up(days, grain), grain, root)
