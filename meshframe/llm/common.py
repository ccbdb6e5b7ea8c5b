"""Helpers shared by the training-data operators: scratch tables in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, scratch_path
from ..sources.scratch import stored as materialize  # the operators cut their lineage by tables in the shared folder

__all__ = ["discard", "least_frequent", "materialize", "scratch_path"]


def least_frequent(counts: DataFrame, n: str, limit: int) -> int:
    """A count that at most limit rows exceed, and nearly so many: from the number of rows by steps of the
    count's logarithm (at most 1,100 rows)."""
    step = lambda c: F.when(c < 64, c).otherwise(F.floor(F.log2(c.cast("double")) * 16) - 32).cast("int")
    sizes = sorted(counts.groupBy(step(F.col(n)).alias("step")).agg(F.count(F.lit(1)).alias("k"), F.max(n).alias("top")).collect(), key=lambda r: -r["step"])
    least, total = 0, 0
    for r in sizes:
        total += r["k"]
        if total > limit:
            least = r["top"]
            break
    return least
