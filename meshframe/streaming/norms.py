"""Field norms of snapshots as their files arrive."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FIELDS
from ..sources.scratch import delete

COMPACT_EVERY = 16


def step_norms(snapshots: DataFrame) -> DataFrame:
    """Norms of u, p, phi and temp for each step; the same for a batch and a stream."""
    sq = lambda f: F.col(f) * F.col(f)
    u = F.sqrt(F.sum(sq("ux") + sq("uy") + sq("uz")))
    return snapshots.groupBy("step").agg(u.alias("norm_u"), *[F.sqrt(F.sum(sq(f))).alias(f"norm_{f}") for f in FIELDS[3:]], F.count(F.lit(1)).alias("n_nodes"))


def folders(spark: SparkSession, out: str) -> tuple[dict[int, str], dict[int, str]]:
    """The finished batches and bases below out, by their batch numbers."""
    top = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, dict[int, str]] = {"batch": {}, "base": {}}
    for entry in fs.listStatus(top) if fs.exists(top) else []:
        path = entry.getPath().toString()
        name = re.fullmatch(r"(batch|base)=(\d+)", path.rsplit("/", 1)[-1])
        if name and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
            found[name[1]][int(name[2])] = path
    return found["batch"], found["base"]


def latest_norms(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame:
    """Each step's norms of the last batch that changed them: the newest base, and the batches after it (up to a number)."""
    batches, bases = folders(spark, out)
    base = max((n for n in bases if upto is None or n <= upto), default=-1)
    later = [p for n, p in batches.items() if n > base and (upto is None or n <= upto)]
    read = lambda paths, name: spark.read.option("basePath", out).parquet(*paths).withColumnRenamed(name, "batch")
    parts = ([read([bases[base]], "base")] if base >= 0 else []) + ([read(later, "batch")] if later else [])
    if not parts:
        raise ValueError(f"no norms below {out}")
    rows = reduce(DataFrame.unionByName, parts)
    names = [x for x in rows.columns if x not in ("step", "batch")]
    return rows.groupBy("step").agg(F.max_by(F.struct(*names), "batch").alias("last")).select("step", "last.*")


def compact(spark: SparkSession, out: str, number: int) -> None:
    """All batches up to number as one base, once; older folders go when it is complete."""
    if number not in folders(spark, out)[1]:
        latest_norms(spark, out, number).coalesce(1).write.mode("overwrite").parquet(f"{out}/base={number}")  # one row for each step
    batches, bases = folders(spark, out)
    for n, path in [*batches.items(), *((n, p) for n, p in bases.items() if n < number)]:
        if n <= number:
            delete(spark, path)


def stream_norms(spark: SparkSession, path: str, schema, checkpoint: str, out: str, every: int = COMPACT_EVERY, **options):
    """Incremental norms of all snapshot files below path: state is one row for each step (there is no event time,
    hence no watermark), and each micro-batch writes the steps it changed below out, in a folder named by its
    number, so a repeated batch replaces its own. Each so many batches the folders are merged into a base, so there are never more
    than every + 2 of them; a batch that is repeated after that is older than the base and not read. Returns the query, run until no file is
    left. options are those of the file source."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number % every == every - 1:
            compact(batch.sparkSession, out, number)

    source = spark.readStream.schema(schema).options(**options).parquet(path)
    query = step_norms(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
