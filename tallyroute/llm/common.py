"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroute.sources.shared import shared_folder

#: White space that separates words: the blank and 09 to 0D. `bytes.split()` uses the same set.
SPACES = (" ", "\t", "\n", "\x0b", "\f", "\r")
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again.

    Cuts the lineage where a result is read many times; the files survive any executor.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/llm-{app}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name close to `name` that `df` has not got, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with a column that names each row alike whenever the plan runs.

    Read straight from files, a row is its file and its place there, so nothing is copied; any
    other table is numbered and stored first.
    """
    if "_metadata" not in {c.lower() for c in docs.columns}:
        file = F.xxhash64("_metadata.file_path").alias("file")
        try:
            return docs.withColumn(name, F.struct(file, F.col("_metadata.row_index").alias("at")))
        except AnalysisException:
            pass  # not a file scan
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def crc_class(doc_id: str | Column, modulus: int) -> Column:
    """Remainder of crc32 of the id as text; null for a null id."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(key.cast("string").cast("binary")) % modulus


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, even if `body` reads it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, characters: Iterable[str]) -> Column:
    """`text` with every occurrence of the characters taken out."""
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def words(text: Column) -> Column:
    """Words of a text as an array; empty for null."""
    blank = F.lit("".join(SPACES))
    return let(
        F.coalesce(F.btrim(text, blank), F.lit("")),
        lambda t: F.when(F.length(t) > 0, F.split(t, r"[\x20\x09-\x0D]+")).otherwise(
            F.array().cast("array<string>")
        ),
    )


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """One row (doc_id, label) per labelled document; contradicting rows drop out."""
    label = F.col(column).cast("int")
    return (
        labels.filter(F.col("doc_id").isNotNull() & label.isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("_most"))
        .filter("label = _most")
        .select("doc_id", "label")
    )


def fraction_for(df: DataFrame, bound: int) -> float:
    """Share of the rows of `df` that makes about `bound` rows; 1 if there are fewer."""
    n = df.count()
    return 1.0 if n <= bound else bound / n


def in_sample(key: str | Column, fraction: float, seed: int) -> Column:
    """Whether a hash of the key falls into the first `fraction` of its range."""
    if fraction >= 1:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int(fraction * (1 << 30))
