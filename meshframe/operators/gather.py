"""Nodal values at element corners, and back: the joins and sums that every mesh computation uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored_in_buckets


def elements_of(incidence: DataFrame) -> DataFrame:
    """(elem_id, nodes) from incidence (elem_id, local, node_id)."""
    return incidence.groupBy("elem_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("local", "node_id"))), lambda x: x["node_id"]).alias("nodes"))


def incidence_of(elements: DataFrame) -> DataFrame:
    """(elem_id, local, node_id) from elements with an array of nodes."""
    return elements.select("elem_id", F.posexplode("nodes").alias("local", "node_id"))


def gather_storage(incidence: DataFrame, n: int | None = None) -> DataFrame:
    """incidence stored in buckets by node, for gathers that are repeated: only the nodal values are moved to it."""
    return stored_in_buckets(incidence, ["node_id"], n, what="incidence")


def gather(incidence: DataFrame, nodal: DataFrame, columns: list[str], corners: int = 4) -> DataFrame:
    """One row for each element: elem_id, n0.., and for each column c its corner values c0, c1, ...

    One join carries all columns; the corners are packed by a partial aggregation."""
    at = incidence.join(nodal.select("node_id", *columns), "node_id")
    pick = lambda c, a, name: F.max(F.when(F.col("local") == a, F.col(c))).alias(name)
    return at.groupBy("elem_id").agg(*[pick("node_id", a, f"n{a}") for a in range(corners)], *[pick(c, a, f"{c}{a}") for c in columns for a in range(corners)])


def corner_rows(packed: DataFrame, names: dict[str, list[str]], corners: int = 4) -> DataFrame:
    """One row for each element corner: elem_id, node_id, and the given corner columns by name."""
    rows = F.array(*[F.struct(F.col(f"n{a}").alias("node_id"), *[F.col(c[a]).alias(n) for n, c in names.items()]) for a in range(corners)])
    return packed.select("elem_id", F.explode(rows).alias("__corner")).select("elem_id", "__corner.*")


def scatter_add(corners: DataFrame, columns: list[str], mask: Column | None = None) -> DataFrame:
    """Sum of the corner contributions at each node; mask selects elements."""
    chosen = corners if mask is None else corners.where(mask)
    return chosen.groupBy("node_id").agg(*[F.sum(c).alias(c) for c in columns])


def element_sum(incidence: DataFrame, nodal: DataFrame, column: str, alpha: float, name: str = "total") -> DataFrame:
    """alpha times the sum of a nodal value over each element's corners."""
    return incidence.join(nodal.select("node_id", column), "node_id").groupBy("elem_id").agg((F.lit(alpha) * F.sum(column)).alias(name))
