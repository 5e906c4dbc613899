"""Site parameters: one record per site, and applying the parameters to traffic.

How parameters act on traffic is this library's own reading of the data model;
only `param_payload` mirrors an existing job. Whether a parameter table is broadcast
is left to the optimizer and adaptive execution, which go by its size in bytes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroute.operators.ranking import numbered

PERIOD_FIELDS = ["id", "dateDebut", "dateFin", "motif"]

# Lists of a payload, with the fields of their entries.
PAYLOAD_LISTS = {
    "periodesNeutralisees": PERIOD_FIELDS,
    "variationsTrafic": ["categorie", "min", "max", "valeur"],
    "neutralisationsPeak": PERIOD_FIELDS,
    "neutralisationsSecondaires": PERIOD_FIELDS,
    "produitsExclus": ["id", "code", "libelle", "exclu"],
}


def param_entries(lists: dict[str, DataFrame]) -> DataFrame:
    """All entries of the five lists, numbered in each site's list as `rang`.

    Entries carry `site_id`, which may be NULL, and `ordre`, an integer unique in
    their list. The entry stands in the column named after its list.
    """
    tagged = [
        lists[name].select(
            "site_id", F.lit(name).alias("liste"), "ordre", F.struct(*fields).alias(name)
        )
        for name, fields in PAYLOAD_LISTS.items()
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return numbered(rows, ["site_id", "liste"], "ordre", "rang").drop("ordre")


def with_site(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows with the attributes of their site as `site`, NULL for unknown sites and for none."""
    attributes = F.struct(*[c for c in sites.columns if c != "site_id"]).alias("site")
    return rows.join(sites.select("site_id", attributes), "site_id", "left")


def param_payload(sites: DataFrame, lists: dict[str, DataFrame], entries: int) -> DataFrame:
    """One record per site with its five parameter lists, empty where it has none.

    The nested form of `param_entries`, for lists a record can hold: the caller
    states how many `entries` of each list that is, and a site with a longer list
    gets further records (`partie` 1, 2, …). Entries of unknown sites, and those of
    no site, make records whose `site` is NULL.
    """
    ranked = param_entries(lists)

    def collected(name: str) -> Column:
        mine = F.when(F.col("liste") == name, F.struct("rang", name))
        return F.transform(F.sort_array(F.collect_list(mine)), lambda e: e[name]).alias(name)

    part = F.floor((F.col("rang") - 1) / entries).alias("partie")
    records = ranked.groupBy("site_id", part).agg(*[collected(n) for n in PAYLOAD_LISTS])
    some = reduce(lambda a, b: a.union(b), [df.select("site_id") for df in lists.values()])
    without = sites.select("site_id").join(some.distinct(), "site_id", "left_anti")
    every = records.unionByName(without, allowMissingColumns=True)
    return with_site(every, sites).select(
        "site_id",
        F.coalesce("partie", F.lit(0)).alias("partie"),
        "site",
        *[F.coalesce(n, F.array()).alias(n) for n in PAYLOAD_LISTS],
    )


def weekly_mean(computed: DataFrame, days_per_week: int = 7) -> DataFrame:
    """Mean traffic from the gross volume, for weeks of 6 or 7 days."""
    if days_per_week not in (6, 7):
        raise ValueError("a week has 6 or 7 days")
    # Integer division: a quotient in floating point is wrong beyond 2**53.
    mean = F.expr(f"volumeBrut div {days_per_week}")
    return computed.withColumn("traficMoyenHebdo", mean)


def neutralised_spans(periods: DataFrame) -> DataFrame:
    """Each site's neutralised spans of each year, at most one per day it may start on.

    A reversed period has none. Periods are cut at the turn of the year, not into
    days, so a period without a real end stays some thousand rows.
    """
    yearly = periods.filter(F.col("dateDebut") <= F.col("dateFin")).select(
        F.col("site_id").alias("co_regate"),
        "dateDebut",
        "dateFin",
        F.explode(F.sequence(F.year("dateDebut"), F.year("dateFin"))).alias("_an"),
    )
    start = F.greatest(F.col("dateDebut"), F.make_date("_an", F.lit(1), F.lit(1)))
    end = F.least(F.col("dateFin"), F.make_date("_an", F.lit(12), F.lit(31)))
    longest = yearly.groupBy(
        "co_regate", F.lpad(F.col("_an").cast("string"), 4, "0").alias("_an"), start.cast("string").alias("debut")
    ).agg(F.max(end.cast("string")).alias("fin"))
    return longest.groupBy("co_regate", "_an").agg(
        F.collect_list(F.struct("debut", "fin")).alias("_plages")
    )


def drop_neutralised_days(days: DataFrame, *period_lists: DataFrame) -> DataFrame:
    """Daily traffic outside the periods of all given lists."""
    periods = reduce(
        lambda a, b: a.unionByName(b),
        [p.select("site_id", "dateDebut", "dateFin") for p in period_lists],
    )
    day = F.col("da_comptage")
    off = F.exists("_plages", lambda p: day.between(p["debut"], p["fin"]))
    return (
        days.withColumn("_an", F.substring(day, 1, 4))
        .join(neutralised_spans(periods), ["co_regate", "_an"], "left")
        .filter(~F.coalesce(off, F.lit(False)))
        .select(*days.columns)
    )


def drop_excluded_products(table: DataFrame, products: DataFrame) -> DataFrame:
    """Traffic without the products their site excludes."""
    excluded = (
        products.filter(F.col("exclu"))
        .select(F.col("site_id").alias("co_regate"), F.col("code").alias("co_comptage"))
        .distinct()
    )
    return table.join(excluded, ["co_regate", "co_comptage"], "left_anti")


def apply_variation(table: DataFrame, variations: DataFrame, measure: str) -> DataFrame:
    """Traffic varied by the percentage of its site and category, held in its bounds.

    Of several variations of one site and category the highest counts.
    """
    held = F.greatest(F.col("min"), F.least(F.col("max"), F.col("valeur")))
    percent = variations.groupBy(
        F.col("site_id").alias("co_regate"), F.col("categorie").alias("co_type_objet")
    ).agg(F.max(held).alias("variation"))
    rate = F.coalesce(F.col("variation"), F.lit(0))
    return table.join(percent, ["co_regate", "co_type_objet"], "left").select(
        *table.columns, (F.col(measure) * (rate + 100) / 100).alias("trafic_varie")
    )


def site_bridge(table: DataFrame, sites: DataFrame) -> DataFrame:
    """Traffic with the attributes of its site.

    Of several sites with one code the first in the order of their columns counts.
    """
    others = [c for c in sites.columns if c != "codeRegate"]
    first = sites.groupBy(F.col("codeRegate").alias("co_regate")).agg(
        F.min(F.struct(*others)).alias("_site")
    )
    named = first.select("co_regate", *[F.col(f"_site.{c}").alias(c) for c in others])
    return table.join(named, "co_regate")
