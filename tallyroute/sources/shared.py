"""Derived tables written once per application in the cluster's shared folder."""

from __future__ import annotations

import hashlib
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}
_written: dict[tuple[str, str, str], str] = {}
# Writing one table may first write another it is derived from.
_lock = threading.RLock()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a local run may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="run-")
    return _local_folders[app]


def derived_table(
    spark: SparkSession, source: str, name: str, write: Callable[[str], None]
) -> str:
    """Path of the table `name` derived from `source`, written on first use."""
    app = spark.sparkContext.applicationId
    key = (app, source, name)
    with _lock:
        if key not in _written:
            digest = hashlib.sha1(source.encode()).hexdigest()[:12]
            path = f"{shared_folder(spark)}/tallyroute-{app}/{digest}/{name}"
            write(path)
            _written[key] = path
        return _written[key]


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: the lineage ends there."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/tallyroute-{app}/rounds/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
