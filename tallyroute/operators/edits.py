"""Keyed edits, lookups and change detection on scenario tables.

Edits made one at a time on a page are applied here as a batch: a log of rows
carrying `seq`, their order, against a table keyed by site or scenario.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroute.constants import DEFAULT_PRODUCTS, DEFAULT_TYPES, DRAFT_STATUS
from tallyroute.operators.ranking import numbered

TYPE_SCHEMA = "type_id int, code string, libelle string"
PRODUCT_FIELDS = ["id", "code", "libelle", "exclu"]

# --- fixed values -----------------------------------------------------------
# White space removed around a scenario name.
_SPACES = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACES}|{_SPACES}$", "")


def _records(rows: Sequence[tuple], names: Sequence[str]) -> Column:
    """A short fixed list as an array of structs."""
    return F.array(
        *[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows]
    )


def type_table(spark: SparkSession, types: Sequence[tuple] = DEFAULT_TYPES) -> DataFrame:
    return spark.range(1).select(F.inline(_records(types, ["type_id", "code", "libelle"])))


# --- filters ----------------------------------------------------------------


def scenarios_of_site(scenarios: DataFrame, site: str | None) -> DataFrame:
    return scenarios.filter(F.col("site_id") == F.lit(site))


def counts_of_scenario(counts: DataFrame, scenario: int | None) -> DataFrame:
    return counts.filter(F.col("scenario_id") == F.lit(scenario))


# --- validation -------------------------------------------------------------


def validate_counts(edits: DataFrame) -> DataFrame:
    """Verdict on new counts: a type, and a value that is not negative."""
    motif = (
        F.when(F.col("type_id").isNull(), "type")
        .when(F.col("valeur").isNull(), "valeur")
        .when(F.col("valeur") < 0, "negatif")
    )
    return edits.withColumn("motif_rejet", motif)


def validate_periods(edits: DataFrame) -> DataFrame:
    """Verdict on new periods: both dates given; their order is not checked."""
    given = (F.col("dateDebut") != "") & (F.col("dateFin") != "")
    return edits.withColumn("motif_rejet", F.when(~F.coalesce(given, F.lit(False)), "dates"))


def validate_names(edits: DataFrame) -> DataFrame:
    """Verdict on new scenario names: something besides white space."""
    blank = F.coalesce(trimmed(F.col("nom")) == "", F.lit(True))
    return edits.withColumn("motif_rejet", F.when(blank, "nom"))


def accepted(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("motif_rejet").isNull()).drop("motif_rejet")


# --- lookups ----------------------------------------------------------------


def available_types(
    scenarios: DataFrame, counts: DataFrame, types: Sequence[tuple] = DEFAULT_TYPES
) -> DataFrame:
    """Types of the fixed list a scenario has no count of yet.

    The types in use are reduced to one short set per scenario before anything
    is joined, so the join carries one row per scenario.
    """
    known = [t[0] for t in types]
    used = (
        counts.filter(F.col("type_id").isin(known))
        .groupBy("scenario_id")
        .agg(F.collect_set("type_id").alias("utilises"))
    )
    free = F.coalesce(~F.array_contains("utilises", F.col("type_id")), F.lit(True))
    return (
        scenarios.select("scenario_id")
        .join(used, "scenario_id", "left")
        .select(
            "scenario_id",
            "utilises",
            F.inline(_records(types, ["type_id", "code", "libelle"])),
        )
        .filter(free)
        .drop("utilises")
    )


def lookup_type(edits: DataFrame, types: DataFrame) -> DataFrame:
    """Edits with the code and label of their type; unknown types are dropped."""
    return edits.join(types, "type_id")


def default_fallback(
    sites: DataFrame, own: DataFrame, defaults: Sequence[tuple] = DEFAULT_PRODUCTS
) -> DataFrame:
    """Product list of each site: its own if it has any row, else the default."""
    listed = own.select("site_id").distinct()
    without = sites.select("site_id").join(listed, "site_id", "left_anti")
    filled = without.select("site_id", F.inline(_records(defaults, PRODUCT_FIELDS)))
    mine = own.join(sites.select("site_id"), "site_id", "left_semi")
    return mine.select("site_id", *PRODUCT_FIELDS).unionByName(filled)


# --- edits ------------------------------------------------------------------


def next_ids(counter: DataFrame, inserts: DataFrame, group: str, seq: str = "seq") -> DataFrame:
    """Inserts numbered in order from the highest id of their group, or from 1.

    `counter` is the table whose ids count: the one left after deletions where
    a freed number is given again, the one loaded before them where it is not.
    """
    highest = counter.groupBy(group).agg(F.greatest(F.max("id"), F.lit(0)).alias("debut"))
    return numbered(inserts, [group], seq, "id", highest)


def append_with_next_id(
    current: DataFrame,
    inserts: DataFrame,
    group: str,
    seq: str = "seq",
    counter: DataFrame | None = None,
) -> DataFrame:
    """The table with the inserts added under their new ids."""
    fresh = next_ids(current if counter is None else counter, inserts, group, seq)
    return current.unionByName(fresh.select(*current.columns))


#: Log entries of one group folded in one round; a round holds at most this many of each group.
LOG_BLOCK = 50_000


def _fold_block(pdf):
    """One round of one group: the block's entries in order over the largest ids alive before it.

    Rows with `_etat` are the group's largest alive ids (one more than the block's entries, so
    deletions inside the block never uncover an id that is not here); the others are the block.
    Gives ('ajout', seq, id) for every addition, ('parti', id) for every deleted id and
    ('nouveau', id) for every id added and alive at the end.
    """
    import heapq

    import pandas as pd

    group = pdf["_groupe"].iat[0]
    known = pdf[pdf["_etat"]]
    alive = set(int(i) for i in known["id"])
    heap = [-i for i in alive]
    heapq.heapify(heap)
    gone, added, out = set(), set(), []
    for op, seq, target in pdf[~pdf["_etat"]].sort_values(["seq", "op", "id"])[["op", "seq", "id"]].itertuples(index=False):
        if op == "ajout":
            while heap and -heap[0] not in alive:
                heapq.heappop(heap)
            given = (-heap[0] if heap else 0) + 1
            alive.add(given)
            heapq.heappush(heap, -given)
            added.add(given)
            out.append(("ajout", int(seq), given))
        elif pd.notna(target):
            target = int(target)
            alive.discard(target)
            added.discard(target)
            gone.add(target)
    out += [("parti", None, i) for i in sorted(gone)] + [("nouveau", None, i) for i in sorted(added)]
    return pd.DataFrame(
        [(group, kind, seq, i) for kind, seq, i in out], columns=["_groupe", "kind", "seq", "id"]
    ).astype({"seq": "Int64", "id": "int64"})


def fold_log(
    current: DataFrame, log: DataFrame, group: str, block: int = LOG_BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Additions and deletions applied one by one in `seq` order within each group.

    An addition ('ajout') takes 1 + the largest id alive just before it (1 in an empty group), so
    a freed largest id is given again; a deletion ('suppression') frees its id, if alive. Equal
    seq values apply in (op, id) order; a deletion without id does nothing.

    Returns (given: group, seq, id of every addition; alive: group, id at the end). The fold runs
    in rounds: each takes the next `block` entries of every group and the `block` + 1 largest
    alive ids, folds them per group in one task, and stores the alive table for the next round,
    so a task holds at most 2 * block + 1 rows whatever the size of a group; a group holding a
    third of the log takes more rounds, not more memory.
    """
    from pyspark.sql import Window

    from tallyroute.sources.shared import shared_folder

    spark = current.sparkSession
    folder = f"{shared_folder(spark)}/fold-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    kinds = F.when(F.col("op") == "ajout", "ajout").otherwise("suppression")
    pending = log.select(
        F.col(group).alias("_groupe"), F.col("seq").cast("long").alias("seq"), kinds.alias("op"),
        F.col("id").cast("long").alias("id"),
    ).filter(F.col("_groupe").isNotNull() & F.col("seq").isNotNull())
    pending = pending.withColumn("_pos", F.monotonically_increasing_id())
    alive = current.select(F.col(group).alias("_groupe"), F.col("id").cast("long").alias("id")).filter(
        F.col("_groupe").isNotNull() & F.col("id").isNotNull()
    ).distinct()
    step = 0

    def store(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}-{step}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    pending, alive = store(pending, "log"), store(alive, "alive")
    given = []
    by_group = Window.partitionBy("_groupe")
    while pending.limit(1).count():
        step += 1
        order = F.row_number().over(by_group.orderBy("seq", "op", "id", "_pos"))
        chunk = store(pending.withColumn("_k", order).filter(F.col("_k") <= block).drop("_k"), "chunk")
        top = F.row_number().over(by_group.orderBy(F.desc("id")))
        largest = (
            alive.join(chunk.select("_groupe").distinct(), "_groupe", "left_semi")
            .withColumn("_k", top)
            .filter(F.col("_k") <= block + 1)
            .drop("_k")
        )
        rows = chunk.drop("_pos").withColumn("_etat", F.lit(False)).unionByName(
            largest.select("_groupe", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("op"), "id", F.lit(True).alias("_etat"))
        )
        folded = store(
            rows.groupBy("_groupe").applyInPandas(
                _fold_block, "_groupe string, kind string, seq long, id long"
            ),
            "folded",
        )
        given.append(folded.filter("kind = 'ajout'").select("_groupe", "seq", "id"))
        gone = folded.filter("kind = 'parti'").select("_groupe", "id")
        new = folded.filter("kind = 'nouveau'").select("_groupe", "id")
        alive = store(alive.join(gone, ["_groupe", "id"], "left_anti").unionByName(new), "alive")
        pending = store(pending.join(chunk.select("_groupe", "_pos"), ["_groupe", "_pos"], "left_anti"), "log")
    schema = "_groupe string, seq long, id long"
    result = reduce(DataFrame.unionByName, given, spark.createDataFrame([], schema))
    rename = lambda df: df.withColumnRenamed("_groupe", group)
    return rename(result), rename(alive)


def delete_by_id(current: DataFrame, deletes: DataFrame, group: str) -> DataFrame:
    gone = deletes.select(group, "id").distinct()
    return current.join(gone, [group, "id"], "left_anti")


def update_values(
    current: DataFrame, edits: DataFrame, group: str, field: str, key: str = "id"
) -> DataFrame:
    """The table with `field` overwritten by the last edit of each row, if any."""
    last = edits.groupBy(group, key).agg(
        F.max_by(field, "seq").alias("_nouveau"), F.max("seq").alias("_edit")
    )
    new = F.when(F.col("_edit").isNotNull(), F.col("_nouveau")).otherwise(F.col(field))
    return (
        current.join(last, [group, key], "left")
        .withColumn(field, new)
        .select(*current.columns)
    )


def apply_count_edits(counts: DataFrame, edits: DataFrame, types: DataFrame) -> DataFrame:
    """Counts after a mixed log (`op` = ajout, modification, suppression) in `seq` order.

    An id is never given twice, so a row survives if no deletion follows its
    creation, and its value is the last update that does. Where `counts` tell the
    place of a row in its list (`position`), new rows come after those loaded.
    """
    adds = lookup_type(
        accepted(validate_counts(edits.filter(F.col("op") == "ajout").drop("id"))), types
    )
    fresh = next_ids(counts, adds.select("scenario_id", "seq", "type_id", "valeur"), "scenario_id")
    if "position" in counts.columns:
        # New ids rise in the order of the log, beyond every loaded one.
        ends = counts.groupBy("scenario_id").agg(F.max("position").alias("_dernier"))
        after = F.coalesce(F.col("_dernier"), F.lit(0)) + F.col("id")
        fresh = fresh.join(ends, "scenario_id", "left").withColumn("position", after)
    rows = counts.withColumn("_cree", F.lit(-1).cast("bigint")).unionByName(
        fresh.select(*counts.columns, F.col("seq").alias("_cree"))
    )
    updated = F.when(F.col("op") == "modification", F.col("seq"))
    removed = F.when(F.col("op") == "suppression", F.col("seq"))
    last = (
        edits.filter(F.col("op").isin("modification", "suppression"))
        .groupBy("scenario_id", "id")
        .agg(
            F.max_by("valeur", updated).alias("_nouveau"),
            F.max(updated).alias("_maj"),
            F.max(removed).alias("_sup"),
        )
    )
    deleted = F.coalesce(F.col("_sup") > F.col("_cree"), F.lit(False))
    changed = F.coalesce(F.col("_maj") > F.col("_cree"), F.lit(False))
    return (
        rows.join(last, ["scenario_id", "id"], "left")
        .filter(~deleted)
        .withColumn("valeur", F.when(changed, F.col("_nouveau")).otherwise(F.col("valeur")))
        .select(*counts.columns)
    )


def new_scenario_defaults(inserts: DataFrame, as_of: Column) -> DataFrame:
    """New scenarios: trimmed name, draft of the day, no dates, no period."""
    none = F.lit(None).cast("date")
    return inserts.select(
        "site_id",
        "seq",
        trimmed(F.col("nom")).alias("nom"),
        as_of.alias("dateCreation"),
        F.lit(DRAFT_STATUS).alias("statut"),
        none.alias("dateValidation"),
        none.alias("dateMo"),
        none.alias("dateProduction"),
        F.lit(None).cast("struct<dateDebut:date,dateFin:date>").alias("periode"),
    )


def new_neutralised_periods(inserts: DataFrame) -> DataFrame:
    """New neutralised periods; an empty reason is no reason."""
    return inserts.withColumn("motif", F.nullif(F.col("motif"), F.lit("")))


# --- change detection -------------------------------------------------------


def detect_changes(
    snapshot: DataFrame,
    current: DataFrame,
    group: str = "scenario_id",
    fields: Sequence[str] = ("type_id", "valeur"),
    order: str = "id",
) -> DataFrame:
    """Whether each group's ordered list of values differs from the snapshot.

    Rows are compared place by place; `order`, an integer unique in its group,
    only gives the order: the position in a file's list, or the id where the list
    is in id order. A table that is costly to work out is best stored first.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = numbered(df.select(group, order, *fields), [group], order, "rang")
        return rows.select(group, "rang", F.struct(*fields).alias(name))

    pairs = side(snapshot, "avant").join(side(current, "apres"), [group, "rang"], "full")
    differs = ~F.col("avant").eqNullSafe(F.col("apres"))
    return pairs.groupBy(group).agg(F.bool_or(differs).alias("modifie"))
