"""JSON record files: reference lists, and files named after the key they hold."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SITE = "codeRoc string, codeRegate string, libelle string, libelleCourt string, denomination string"
TRAFFIC_TYPE = "id int, code string, libelle string"
COUNT = f"id int, trafic struct<{TRAFFIC_TYPE}>, valeur bigint"
PERIOD = "dateDebut date, dateFin date"
SCENARIO = (
    "id bigint, nom string, dateCreation date, statut string, dateValidation date, "
    f"dateMo date, dateProduction date, periode struct<{PERIOD}>"
)
NEUTRALISED_PERIOD = "id int, dateDebut date, dateFin date, motif string"
PRODUCT = "id int, code string, libelle string, exclu boolean"
VARIATION = "categorie string, min int, max int, valeur int"
COMPUTED_TRAFFIC = (
    "id int, produit string, volumeBrut bigint, constateBrut bigint, "
    "previsionnelBrut bigint, traficMoyenHebdo bigint"
)


def json_reference_scan(
    spark: SparkSession, path: str, schema: str, multi_line: bool = True
) -> DataFrame:
    """Records of a JSON file; `multi_line=False` for one record per line."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def keyed_file_scan(
    spark: SparkSession,
    folder: str,
    prefix: str,
    schema: str,
    key: str,
    value: str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Records of all files `prefix-<key>.json`, the key read from the name.

    Folders `prefix=<key>` or `prefix-<key>`, as Spark writes them, count too. A key may hold any
    character a name can: only the last `.json` is cut off. With a plain `value` only the
    files of that key are listed; with any other all are, and their keys compared. No file at all is
    an empty table.
    """
    plain = value is not None and re.fullmatch("[A-Za-z0-9_]+", value)
    pattern = f"{folder}/{prefix}[-=]" + (f"{value}{{,.json}}" if plain else "*")
    # Paths are URL-encoded; a plus sign stands for itself there.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    start = re.escape(prefix)
    file = F.regexp_extract(path, rf"/{start}-([^/]*)\.json$", 1)
    inside = F.regexp_extract(path, rf"/{start}[-=]([^/]*)/[^/]*$", 1)
    # Spark escapes some characters of a folder's name itself.
    inside = F.url_decode(F.replace(inside, F.lit("+"), F.lit("%2B")))
    name = F.when(file != "", file).otherwise(inside)
    reader = spark.read.schema(schema).option("multiLine", multi_line)
    try:
        records = reader.option("recursiveFileLookup", True).json(pattern)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        empty = StructType.fromDDL(f"{schema}, {key} string")
        return spark.createDataFrame([], empty)
    keyed = records.select("*", name.alias(key))
    return keyed if value is None else keyed.filter(F.col(key) == value)


def nested_flatten(records: DataFrame, column: str, prefix: str) -> DataFrame:
    """A struct column replaced by its fields; a NULL struct gives NULL fields."""
    fields = records.schema[column].dataType.fieldNames()
    flat = [F.col(f"{column}.{f}").alias(f"{prefix}{f}") for f in fields]
    kept = [c for c in records.columns if c != column]
    return records.select(*kept, *flat)
