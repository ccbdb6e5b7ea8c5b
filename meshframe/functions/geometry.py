"""Element geometry of tetrahedra as column expressions on gathered corners x0..z3.

Each function adds its columns to a row that holds the corners; everything stays in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COORDS = ["x", "y", "z"]
c = F.col


def total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def jacobian(df: DataFrame) -> DataFrame:
    """j00..j22: column k of the Jacobian is corner k+1 less corner 0."""
    return df.withColumns({f"j{i}{k}": c(f"{x}{k + 1}") - c(f"{x}0") for i, x in enumerate(COORDS) for k in range(3)})


def minor(i: int, k: int) -> Column:
    """Cofactor of entry (i, k) of the Jacobian."""
    a, b = [r for r in range(3) if r != i]
    p, q = [r for r in range(3) if r != k]
    m = c(f"j{a}{p}") * c(f"j{b}{q}") - c(f"j{a}{q}") * c(f"j{b}{p}")
    return m if (i + k) % 2 == 0 else -m


def determinant(df: DataFrame) -> DataFrame:
    """det (signed), detj (absolute), volume."""
    signed = total([c(f"j0{k}") * minor(0, k) for k in range(3)])
    return df.withColumn("det", signed).withColumn("detj", F.abs("det")).withColumn("volume", c("detj") / 6)


def inverse(df: DataFrame) -> DataFrame:
    """v00..v22: the inverse Jacobian by cofactors and the signed determinant; null where it is 0."""
    return df.withColumns({f"v{k}{i}": F.try_divide(minor(i, k), c("det")) for k in range(3) for i in range(3)})


def shape_gradients(df: DataFrame) -> DataFrame:
    """g00..g32: gradient of each corner's shape function."""
    df = df.withColumns({f"g{k + 1}{i}": c(f"v{k}{i}") for k in range(3) for i in range(3)})
    return df.withColumns({f"g0{i}": -(c(f"g1{i}") + c(f"g2{i}") + c(f"g3{i}")) for i in range(3)})


def metric(df: DataFrame) -> DataFrame:
    """m00..m22: products of the gradients of corners 1 to 3."""
    return df.withColumns({f"m{i}{j}": total([c(f"g{i + 1}{k}") * c(f"g{j + 1}{k}") for k in range(3)]) for i in range(3) for j in range(3)})


def geometry(df: DataFrame) -> DataFrame:
    """All of the above for elements that are not flat."""
    return metric(shape_gradients(inverse(determinant(jacobian(df)).where("detj > 0"))))


def by_corner(prefix: str, at: Column, i: int) -> Column:
    """Column prefix{a}{i} for a = at."""
    return reduce(lambda rest, a: F.when(at == a, c(f"{prefix}{a}{i}")).otherwise(rest), range(4), F.lit(None).cast("double"))


def facet_normals(df: DataFrame) -> DataFrame:
    """nx, ny, nz: outward normal of the facet opposite corner orient, of length twice its area."""
    return df.withColumns({n: -c("detj") * by_corner("g", c("orient"), i) for i, n in enumerate(("nx", "ny", "nz"))})


def facet_scale(df: DataFrame, mu: float) -> DataFrame:
    """hinv: length of the inverse Jacobian times the normal; taub = 4 mu hinv."""
    parts = [total([c(f"v{k}{i}") * c(n) for i, n in enumerate(("nx", "ny", "nz"))]) for k in range(3)]
    return df.withColumn("hinv", F.sqrt(total([p * p for p in parts]))).withColumn("taub", F.lit(4.0 * mu) * c("hinv"))
