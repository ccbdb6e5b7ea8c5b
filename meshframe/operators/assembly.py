"""Assembly of element contributions into matrices, and norms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FIELDS
from .graph import morton_code

ENTRIES = [*((i, j) for i in range(4) for j in range(4)), (4, 4), (5, 5)]  # entries of a node pair that are not zero everywhere
BLOCKS = {"u": (0, 1, 2), "p": (3,), "phi": (4,), "temp": (5,)}


def assemble_coo(values: DataFrame) -> DataFrame:
    """Sum of element values (row, col, val) at each position."""
    return values.groupBy("row", "col").agg(F.sum("val").alias("val"))


def localized(packed: DataFrame, box: tuple, n: int | None = None, bits: int = 10) -> DataFrame:
    """packed elements (with corner coordinates x0..z3) dealt to n tasks by ranges along the space-filling curve of their centres.

    Elements that share nodes then mostly lie in one task, so that the partial sums of an assembly merge there what would be
    shuffled otherwise: one shuffle of a row an element spares most of the 16 rows an element. Pays on meshes whose neighbours are near
    in space; where elements join nodes from everywhere leave it out."""
    low, high = box
    step = tuple(max((h - lo) / (1 << bits), 1e-300) for lo, h in zip(low, high))
    center = [reduce(lambda a, b: a + b, [F.col(f"{x}{a}") for a in range(4)]) / 4 for x in "xyz"]
    n = n or int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.withColumn("__code", morton_code(*center, low, step, bits)).repartitionByRange(n, "__code", "elem_id").drop("__code")


def element_pairs(packed: DataFrame, value) -> DataFrame:
    """(row, col, val) for all pairs of corners; value(a, b) is a column of the packed row."""
    pairs = [F.struct(F.col(f"n{a}").alias("row"), F.col(f"n{b}").alias("col"), value(a, b).alias("val")) for a in range(4) for b in range(4)]
    return packed.select(F.explode(F.array(*pairs)).alias("__entry")).select("__entry.*")


def assemble_blocks(wide: DataFrame, blocks: list[tuple[str, str]] | None = None) -> DataFrame:
    """(bi, bj, row, col, val) from rows of side-by-side entries v{i}{j} keyed by (row, col).

    Summed as wide rows, 16 for each element; entries are exploded only afterwards. Within a block of
    several unknowns rows and columns are node * size + component. Absent blocks have no rows."""
    names = [(i, j) for i, j in ENTRIES if f"v{i}{j}" in wide.columns]
    summed = wide.groupBy("row", "col").agg(*[F.sum(f"v{i}{j}").alias(f"v{i}{j}") for i, j in names])
    where = {k: (n, o.index(k), len(o)) for n, o in BLOCKS.items() for k in o}
    chosen = [(i, j) for i, j in names if blocks is None or (where[i][0], where[j][0]) in blocks]
    entry = lambda i, j: F.struct(
        F.lit(where[i][0]).alias("bi"), F.lit(where[j][0]).alias("bj"), (F.col("row") * where[i][2] + where[i][1]).alias("row"), (F.col("col") * where[j][2] + where[j][1]).alias("col"), F.col(f"v{i}{j}").alias("val")
    )
    return summed.select(F.explode(F.array(*[entry(i, j) for i, j in chosen])).alias("__entry")).select("__entry.*")


def field_norms(nodal: DataFrame) -> DataFrame:
    """One row: the norms of u (all components), p, phi and temp."""
    square = lambda f: F.col(f) * F.col(f)
    return nodal.agg(*[F.sqrt(F.sum(reduce(lambda a, b: a + b, [square(FIELDS[k]) for k in o]))).alias(f"norm_{n}") for n, o in BLOCKS.items()])


def converged(norms: DataFrame, initial: DataFrame, tol: float = 0.5e-3) -> DataFrame:
    """norms and whether every block is below tol times its initial norm (plus 1e-16)."""
    first = initial.select(*[F.col(f"norm_{n}").alias(f"__{n}") for n in BLOCKS])
    test = reduce(lambda a, b: a & b, [F.col(f"norm_{n}") < F.lit(tol) * (F.col(f"__{n}") + F.lit(1e-16)) for n in BLOCKS])
    return norms.join(F.broadcast(first)).withColumn("converged", test).drop(*[f"__{n}" for n in BLOCKS])  # one row each
