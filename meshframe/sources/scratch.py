"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCOPES: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset a new local one in a single JVM
    (tests), and an error on a cluster, whose machines do not share local folders."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/meshframe/{what}-{uuid.uuid4().hex}"
    for scope in _SCOPES[-1:]:
        scope.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there, without a list of its files on the driver."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts the lineage, and outlives any executor."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path  # for discard()
    return table


def discard(table: DataFrame) -> None:
    """Delete a table that stored() returned and no later step reads."""
    delete(table.sparkSession, table.scratch_path)


def stored_in_buckets(df: DataFrame, keys: list[str], n: int | None = None, sort: list[str] | None = None, what: str = "buckets") -> DataFrame:
    """df as a table of n buckets by the keys (as many as shuffle partitions by default), sorted within them: joins
    and sums by these keys read it where it lies, with no exchange, as often as they run."""
    spark = df.sparkSession
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, what)
    name = f"meshframe_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*(sort or keys)).option("path", path).saveAsTable(name)
    table = spark.table(name)
    table.scratch_path, table.table_name = path, name
    return table


def discard_buckets(table: DataFrame) -> None:
    table.sparkSession.sql(f"drop table if exists {table.table_name}")
    discard(table)


@contextmanager
def scratch_scope():
    """Every scratch table made inside is deleted at the end; results that read them must be written or collected by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for spark, path in _SCOPES.pop():
            delete(spark, path)
