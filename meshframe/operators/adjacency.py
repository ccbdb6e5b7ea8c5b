"""Adjacency of nodes and elements, sparsity patterns, and offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored


def node_degree(incidence: DataFrame) -> DataFrame:
    return incidence.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def v2e(incidence: DataFrame) -> DataFrame:
    """The sorted elements of each node."""
    return incidence.groupBy("node_id").agg(F.array_sort(F.collect_set("elem_id")).alias("elems"))


def v2e_segments(incidence: DataFrame, size: int = 10_000) -> DataFrame:
    """(node_id, segment, elems): each node's elements in ascending order, in lists of at most size; lists of a node follow each
    other by segment, from 0 on. Places come from a scan in two levels over (node, element), so that the list of a hub is
    made by many tasks and no row holds all of it."""
    placed = prefix_sums(incidence.select("node_id", "elem_id").distinct(), ["node_id", "elem_id"], name="place").withColumn("block", F.floor(F.col("place") / size))
    lists = placed.groupBy("node_id", "block").agg(F.array_sort(F.collect_list("elem_id")).alias("elems"))
    first = lists.groupBy("node_id").agg(F.min("block").alias("first"))
    return lists.join(first, "node_id").select("node_id", (F.col("block") - F.col("first")).alias("segment"), "elems")


def nodal_graph(elements: DataFrame) -> DataFrame:
    """Distinct (row, col) of nodes that share an element, each node with itself included.

    Pairs are made inside the element's row (any element type), so nothing is joined; rows have no cap."""
    pairs = F.explode(F.flatten(F.transform("nodes", lambda i: F.transform("nodes", lambda j: F.struct(i.alias("row"), j.alias("col"))))))
    return elements.select(pairs.alias("__pair")).select("__pair.row", "__pair.col").distinct()


def row_lengths(pattern: DataFrame) -> DataFrame:
    return pattern.groupBy("row").agg(F.count(F.lit(1)).alias("length"))


def csr_slots(pattern: DataFrame) -> DataFrame:
    """Slot of each column within its row, ascending from 0."""
    return pattern.withColumn("slot", (F.row_number().over(W.partitionBy("row").orderBy("col")) - 1).cast("long"))


def prefix_sums(df: DataFrame, order: list[str], value=None, name: str = "start", parts: int | None = None) -> DataFrame:
    """df with the sum of value (1 by default) over all rows before it in the given order, which must tell rows apart.

    A scan in two levels: rows are dealt to ranges of the order by a sample, so that no range is much larger than
    another whatever the keys' spread, and stored with the range's number; the ranges' totals (at most parts rows) are
    summed over a tiny window and broadcast, and only then each range is summed on its own; no task sees all rows."""
    parts = parts or 2 * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    value = F.lit(1) if value is None else F.col(value)
    dealt = stored(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("__part").agg(F.sum(value).alias("__sum"))
    base = totals.select("__part", F.coalesce(F.sum("__sum").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("__inside", inside).join(F.broadcast(base), "__part").withColumn(name, (F.col("__base") + F.col("__inside")).cast("long")).drop("__part", "__inside", "__base")


def previous_value(df: DataFrame, order: list, value, name: str, parts: int | None = None) -> DataFrame:
    """df with the value (never null) of the row before in the order over all rows, null at the first.

    In two levels as in prefix_sums: each range of the order looks back on its own, and its first row gets the last value of the
    range before. So no key, however many rows it has, is one task's."""
    parts = parts or 2 * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    inside = W.partitionBy("__part").orderBy(*order)
    looked = dealt.withColumns({"__before": F.lag(value).over(inside), "__own": value, "__turn": F.row_number().over(inside)})
    last = looked.groupBy("__part").agg(F.max_by("__own", "__turn").alias("__last"))
    carried = last.select("__part", F.lag("__last").over(W.orderBy("__part")).alias("__carried"))  # at most parts rows
    return looked.join(F.broadcast(carried), "__part").withColumn(name, F.coalesce("__before", "__carried")).drop("__part", "__before", "__own", "__turn", "__carried")


def prefix_offsets(counts: DataFrame, key: str, count: str, name: str = "start", parts: int | None = None) -> DataFrame:
    """counts with the sum of all counts at smaller keys; keys are distinct."""
    return prefix_sums(counts, [key], count, name, parts)


def row_ptr(pattern: DataFrame, all_rows: DataFrame) -> DataFrame:
    """(row, length, start) for every row of all_rows, those without entries included."""
    lengths = all_rows.join(row_lengths(pattern), "row", "left").select("row", F.coalesce("length", F.lit(0)).alias("length"))
    return prefix_offsets(lengths, "row", "length")


def csr_expand(slots: DataFrame, starts: DataFrame, br: int, bc: int) -> DataFrame:
    """Each entry (row, col, slot) as br x bc entries of the expanded matrix with their positions:
    block row j of a row starts at start*br*bc + j*bc*length."""
    at = slots.join(starts.select("row", "length", "start"), "row")
    block = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(br - 1)), lambda j: F.transform(F.sequence(F.lit(0), F.lit(bc - 1)), lambda k: F.struct(j.alias("j"), k.alias("k"))))))
    pos = F.col("start") * (br * bc) + F.col("b.j") * bc * F.col("length") + F.col("slot") * bc + F.col("b.k")
    return at.withColumn("b", block).select((F.col("row") * br + F.col("b.j")).alias("row"), (F.col("col") * bc + F.col("b.k")).alias("col"), pos.cast("long").alias("pos"))
