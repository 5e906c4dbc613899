"""Row counts and observed schemas of a set of tables, each read once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def dataset_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Exact row count of every table, by name."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("table_rows")).select(
            F.lit(name).alias("table_name"), "table_rows"
        )
        for name, df in tables.items()
    ]
    return _union(counts).orderBy("table_name")


def footer_row_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Exact row count of every Parquet table, by name, from the row counts in its file footers.

    The tables are read through Spark's DataSource V2 Parquet reader with aggregate push-down, so
    COUNT(*) is answered from the footers and no column is read. Both settings hold only while the
    plan is made; the returned DataFrame keeps that plan. A reader that cannot push the count down
    (other formats, or a plan made again later) scans instead, with the same result.
    """
    v1 = spark.conf.get("spark.sql.sources.useV1SourceList")
    settings = {
        "spark.sql.sources.useV1SourceList": ",".join(
            f for f in v1.split(",") if f.strip().lower() != "parquet"
        ),
        "spark.sql.parquet.aggregatePushdown": "true",
    }
    saved = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        counts = [
            spark.read.parquet(path)
            .agg(F.count(F.lit(1)).alias("table_rows"))
            .select(F.lit(name).alias("table_name"), "table_rows")
            for name, path in paths.items()
        ]
        result = _union(counts).orderBy("table_name")
        result._jdf.queryExecution().executedPlan()
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    return result


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _profile(name: str, df: DataFrame) -> DataFrame:
    """Null counts of all columns in one pass, then one row per column."""
    fields = list(enumerate(df.schema.fields, 1))
    nulls = df.selectExpr(
        *[f"count_if(`{f.name.replace('`', '``')}` IS NULL) AS `{i}`" for i, f in fields]
    )
    rows = [
        f"named_struct('ordinal_position', {i}, 'column_name', {_quoted(f.name)}, "
        f"'column_type', {_quoted(f.dataType.simpleString())}, 'null_count', `{i}`)"
        for i, f in fields
    ]
    return nulls.selectExpr(f"{_quoted(name)} AS table_name", f"inline(array({', '.join(rows)}))")


def column_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Columns of every table: position, type, nulls seen."""
    profiled = _union([_profile(name, df) for name, df in tables.items()])
    return profiled.withColumn(
        "is_nullable", F.when(F.col("null_count") > 0, "YES").otherwise("NO")
    ).orderBy("table_name", "ordinal_position")


def nested_schema_report(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its columns as an array of structs."""
    column = F.struct(
        "ordinal_position", "column_name", "column_type", "is_nullable", "null_count"
    )
    return (
        column_profile(tables)
        .groupBy("table_name")
        .agg(F.sort_array(F.collect_list(column)).alias("columns"))
        .orderBy("table_name")
    )
