"""Vector tables (idx, val): arithmetic, products, indexed reads and writes, predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scale(v: DataFrame, alpha: float) -> DataFrame:
    """alpha * v; zero is a scale by 0, so NaN stays NaN."""
    return v.withColumn("val", F.lit(alpha) * F.col("val"))


def fill(v: DataFrame, value: float) -> DataFrame:
    return v.withColumn("val", F.lit(value))


def axpby(x: DataFrame, y: DataFrame, alpha: float, beta: float = 1.0) -> DataFrame:
    """alpha * x + beta * y on the indices of y."""
    own = x.select("idx", F.col("val").alias("__x"))
    return y.join(own, "idx").select("idx", (F.lit(alpha) * F.col("__x") + F.lit(beta) * F.col("val")).alias("val"))


def quotient(a: Column, b: Column, ieee: bool = False) -> Column:
    """a / b; where b is 0 null, or by IEEE rules a signed infinity (NaN for 0 / 0)."""
    if not ieee:
        return F.try_divide(a, b)
    return F.when(b == 0, F.when(a == 0, F.lit(float("nan"))).otherwise(F.signum(a) * F.lit(float("inf")))).otherwise(F.try_divide(a, b))


def pointwise(x: DataFrame, y: DataFrame, ieee: bool = False) -> DataFrame:
    """(idx, product, quotient, inverse) of equal indices; inverse is that of y."""
    a, b = F.col("val"), F.col("__y")
    return x.join(y.select("idx", F.col("val").alias("__y")), "idx").select("idx", (a * b).alias("product"), quotient(a, b, ieee).alias("quotient"), quotient(F.lit(1.0), b, ieee).alias("inverse"))


def whole_part(x: Column) -> Column:
    """The largest whole number not above x, as a double: from 2^53 on doubles are whole (and may be beyond a long)."""
    return F.when((F.abs(x) >= F.lit(2.0**53)) | F.isnan(x), x).otherwise(F.floor(x).cast("double"))


def floor_mod(v: DataFrame, b: float) -> DataFrame:
    return v.withColumn("val", F.col("val") - F.lit(b) * whole_part(F.col("val") / F.lit(b)))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("idx", F.col("val").alias("__b")), "idx").agg(F.sum(F.col("val") * F.col("__b")).alias("dot"))


def norm2(a: DataFrame) -> DataFrame:
    return a.agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm"))


def array_at(a: DataFrame, index: DataFrame) -> DataFrame:
    """val[i] = a[idx[i]] for index (i, idx); indices outside a give null."""
    return index.join(a, "idx", "left").select("i", "idx", "val")


def array_set_at(a: DataFrame, writes: DataFrame) -> DataFrame:
    """a with a[idx] = val for writes (i, idx, val); of several writes the largest i wins."""
    last = writes.groupBy("idx").agg(F.max_by("val", "i").alias("__new"))
    return a.join(last, "idx", "left").select("idx", F.coalesce("__new", "val").alias("val"))


def count_value(data: DataFrame, column: str, value) -> DataFrame:
    return data.agg(F.count_if(F.col(column) == F.lit(value)).alias("n"))


def find_value(data: DataFrame, index: str, column: str, value) -> DataFrame:
    """The ascending indices at which column equals value."""
    return data.where(F.col(column) == F.lit(value)).select(index).orderBy(index)


def mask_at(index: DataFrame, data: DataFrame, key: str, column: str, target: Column) -> DataFrame:
    """index with mask = 1 where the value looked up by key equals target, else 0, also where there is no value."""
    return index.join(data.select(key, column), key, "left").withColumn("mask", F.coalesce((F.col(column) == target).cast("int"), F.lit(0)))
