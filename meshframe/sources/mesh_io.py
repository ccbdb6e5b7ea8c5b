"""Reading and writing meshes, snapshots, vectors and particles as Parquet tables."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.adjacency import prefix_sums
from ..schema import CORNERS, PARTICLES, STATE, TABLES, VECTOR

CELL_NAMES = {"tetra": "tet", "wedge": "prism", "hexahedron": "hex", "triangle": "tri"}  # fixed values: names of cell types


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or an empty one of the schema if there is none."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def table_size(spark: SparkSession, path: str) -> int:
    """Rows of a table; 0 if there is none."""
    return spark.read.parquet(path).count() if exists(spark, path) else 0


def read_mesh(spark: SparkSession, path: str, check: bool = True) -> dict[str, DataFrame]:
    """nodes, elements, facets and bound_nodes below path; missing ones are empty."""
    mesh = {name: read_or_empty(spark, f"{path}/{name}", schema) for name, schema in TABLES.items()}
    if check:
        check_mesh(mesh["nodes"], mesh["elements"])
    return mesh


def write_mesh(mesh: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet, sorted within its files by its key."""
    for name, df in mesh.items():
        df.sortWithinPartitions(df.columns[0]).write.mode("overwrite").parquet(f"{path}/{name}")


def check_mesh(nodes: DataFrame, elements: DataFrame) -> None:
    """At least four nodes and one element, and each element with the corners of its type; ValueError if not."""
    wrong = F.lit(False)
    for name, k in CORNERS.items():
        wrong = wrong | ((F.col("etype") == name) & (F.size("nodes") != k))
    n = nodes.count()
    e = elements.agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong | F.col("nodes").isNull()).alias("wrong")).first()
    if n < 4 or e["n"] < 1 or e["wrong"]:
        raise ValueError(f"{n} nodes, {e['n']} elements, {e['wrong']} of them with a wrong number of corners")


def check_flat(flat: DataFrame, k: int) -> None:
    n = flat.count()
    if n % k:
        raise ValueError(f"{n} values are no rows of {k}")


def unflatten(flat: DataFrame, k: int, pos: str = "pos", val: str = "val") -> DataFrame:
    """(row_id, vals): rows of k values of a flat table (pos, val)."""
    return flat.groupBy(F.floor(F.col(pos) / k).cast("long").alias("row_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct((F.col(pos) % k).alias("at"), F.col(val).alias("v")))), lambda x: x["v"]).alias("vals"))


def flatten(rows: DataFrame, key: str, values: str, k: int) -> DataFrame:
    """(pos, val): pos = key * k + place."""
    return rows.select(F.col(key), F.posexplode(values).alias("at", "val")).select((F.col(key) * k + F.col("at")).cast("long").alias("pos"), "val")


def cells_by_type(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells of known types under their short names, counts of the unknown ones, which are dropped)."""
    named = cells.withColumn("etype", F.create_map(*[F.lit(x) for kv in CELL_NAMES.items() for x in kv])[F.col("ctype")])
    unknown = named.where(F.col("etype").isNull()).groupBy("ctype").count()
    return named.where(F.col("etype").isNotNull()).drop("ctype"), unknown


def warn_unknown(unknown: DataFrame) -> None:
    for r in unknown.limit(100).collect():
        warnings.warn(f"{r['count']} cells of unknown type {r['ctype']} are dropped", stacklevel=2)


def union_elements(parts: dict[str, DataFrame]) -> DataFrame:
    """Elements of all types in one table, with new ids: distinct, without gaps, and in the order tet, prism, hex and of the given ids
    within a type, which may be sparse and may be the same in two types. One scan in two levels over all types numbers them."""
    out = None
    for kind, name in enumerate(CORNERS):
        if name in parts:
            df = parts[name].select(F.lit(kind).alias("kind"), F.col("elem_id").alias("old"), F.lit(name).alias("etype"), "nodes")
            out = df if out is None else out.unionByName(df)
    return prefix_sums(out, ["kind", "old"], name="elem_id").select("elem_id", "etype", "nodes")


def mesh_counts(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """(what, n): nodes, and elements of each type."""
    return nodes.agg(F.lit("nodes").alias("what"), F.count(F.lit(1)).alias("n")).unionByName(elements.groupBy(F.col("etype").alias("what")).agg(F.count(F.lit(1)).alias("n")))


def step_range(snapshots: DataFrame, start: int, end: int | None = None, stride: int = 1) -> DataFrame:
    """Snapshots of the steps from start to end (included) by stride; start alone is one step. On a table
    partitioned by step only those partitions are read."""
    if end is None:
        return snapshots.where(F.col("step") == start)
    if stride < 1:
        raise ValueError("the stride must be 1 or more")
    return snapshots.where(F.col("step").between(start, end) & ((F.col("step") - start) % stride == 0))


def write_snapshot(state: DataFrame, step: int, path: str, every: int = 10) -> bool:
    """Write the state as snapshot of step 0 and every so many steps; tells whether it did. A step that is there already is
    replaced, and no other one, so a write may be repeated."""
    if step % every:
        return False
    state.withColumn("step", F.lit(step)).write.partitionBy("step").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return True


def read_snapshot(spark: SparkSession, path: str, step: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("step") == step)


def export_points(nodes: DataFrame, snapshots: DataFrame, vectors: dict[str, list[str]], scalars: list[str]) -> DataFrame:
    """(step, node_id, x, y, z, scalars, vectors as arrays): nodes joined with their snapshots."""
    return snapshots.join(nodes, "node_id").select("step", "node_id", "x", "y", "z", *scalars, *[F.array(*c).alias(n) for n, c in vectors.items()])


def write_points(points: DataFrame, path: str, kind: str = "parquet") -> None:
    """One folder for each step; as CSV arrays are written as text."""
    if kind == "csv":
        points = points.select(*[F.concat_ws(" ", c).alias(c) if t.startswith("array") else F.col(c) for c, t in points.dtypes])
    points.write.partitionBy("step").mode("overwrite").format(kind).save(path)


def save_vector(v: DataFrame, path: str) -> None:
    v.write.mode("overwrite").parquet(path)


def load_vector(spark: SparkSession, path: str, length: int, kind: str = "double") -> DataFrame:
    """The vector as the given type; ValueError if its length is another."""
    v = read_or_empty(spark, path, VECTOR)
    if (n := v.count()) != length:
        raise ValueError(f"{n} values, not {length}")
    return v.withColumn("val", F.col("val").cast(kind))


def save_particles(particles: DataFrame, path: str) -> None:
    particles.write.mode("overwrite").parquet(path)


def load_particles(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, PARTICLES)


def compatible_particles(a: DataFrame, b: DataFrame) -> bool:
    """Same number, mass and radius."""
    of = lambda d: tuple(d.agg(F.count(F.lit(1)), F.min("mass"), F.max("mass"), F.min("radius"), F.max("radius")).first())
    return of(a) == of(b)


STATE_SCHEMA = STATE
