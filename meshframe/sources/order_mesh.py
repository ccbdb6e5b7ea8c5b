"""A deterministic mesh made of the orders of a TPC-H-like dataset.

Each order with at least four distinct parts is a tetrahedron of its four smallest part keys; parts
are nodes, and faces that only one element has are its boundary. Coordinates are integer-valued, so determinants and their sums are exact. The views are
plain SQL for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "incidence": (
        ["lineitem"],
        """select elem_id, local, node_id from (
  select elem_id, node_id, row_number() over (partition by elem_id order by node_id) - 1 as local, count(*) over (partition by elem_id) as k
  from (select distinct l_orderkey as elem_id, l_partkey as node_id from lineitem) d) ranked where k >= 4 and local < 4""",
    ),
    "nodes": (
        ["part"],
        "select p_partkey as node_id, cast(p_partkey % 101 as double) as x, cast(p_size as double) as y, cast((p_partkey * 7919) % 1009 as double) as z from part",
    ),
    "fields": (
        ["nodes"],
        """select node_id, cast(y as double) as ux, cast(node_id % 7 - 3 as double) as uy, cast(node_id % 5 - 2 as double) as uz, cast(node_id % 11 as double) as p, x as phi, -x as temp,
  cast(node_id % 3 - 1 as double) as dux, cast(0 as double) as duy, cast(node_id % 2 as double) as duz, cast(node_id % 4 as double) as dp, cast(1 as double) as dphi, cast(-1 as double) as dtemp from nodes""",
    ),
    "faces": (
        ["incidence"],
        """select o.elem_id, o.local as off, min(i.node_id) as lo, max(i.node_id) as hi, sum(i.node_id) as total
  from incidence o join incidence i on i.elem_id = o.elem_id and i.local <> o.local group by o.elem_id, o.local""",
    ),
    "boundary": (["faces"], "select elem_id, off from (select *, count(*) over (partition by lo, hi, total) as k from faces) counted where k = 1"),
    "facet_nodes": (
        ["boundary", "incidence"],
        """select b.elem_id * 4 + b.off as facet_id, cast(10 + 5 * (b.elem_id % 3) as bigint) as tag, i.node_id
  from boundary b join incidence i on i.elem_id = b.elem_id and i.local <> b.off""",
    ),
    "steps": (["part"], "select distinct cast(p_size % 6 as int) * 10 as step from part"),
    "snapshots": (
        ["fields", "steps"],
        """select s.step, node_id, ux + s.step * dux as ux, uy + s.step * duy as uy, uz + s.step * duz as uz, p, phi + s.step * dphi as phi, temp + s.step * dtemp as temp
  from fields cross join steps s""",
    ),
    "pattern": (["incidence"], "select distinct a.node_id as row, b.node_id as col from incidence a join incidence b on a.elem_id = b.elem_id"),
    "coo": (["pattern"], "select row, col, cast((row * 31 + col * 17) % 23 - 11 + case when row = col then 50 else 0 end as double) as val from pattern"),
    "vec": (["nodes"], "select node_id as idx, cast(node_id % 13 - 6 as double) as val from nodes"),
    "bc": (
        [],
        """select cast(bound as bigint) as bound, comp, bctype from (values (0, 0, 'STRONG'), (0, 1, 'STRONG'), (0, 2, 'STRONG'), (1, 1, 'STRONG'), (1, 0, 'NONE'), (2, 2, 'STRONG'), (2, 0, 'WEAK')) as t(bound, comp, bctype)""",
    ),
    "priority": (["incidence"], "select distinct elem_id, cast((elem_id * 7919 + 104729) % 1000003 as bigint) as prio from incidence"),
}


class OrderMesh:
    """The views as DataFrames over the Parquet tables of a folder; each is built once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.built = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("pattern", "coo"):
            return self.built.setdefault(name, self._matrix(name))
        if name in ("facets", "facet_nodes"):
            return self.built.setdefault(name, self._facets(name))
        if name not in self.built:
            if name in VIEWS:
                needs, text = VIEWS[name]
                for n in needs:
                    text = _replace(text, n)
                tables = {n: getattr(self, n) for n in needs}
                if name == "incidence":  # dealt by order at once, which the distinct pairs and the places within the order both need
                    tables = {"lineitem": self.lineitem.select("l_orderkey", "l_partkey").repartition("l_orderkey")}
                self.built[name] = self.spark.sql(text, **tables)
            else:
                self.built[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.built[name]

    def store(self, *names: str) -> None:
        """Writes views that are read more than once; they, and what is built on them, are read back from there."""
        from .scratch import stored

        for name in names:
            self.built[name] = stored(getattr(self, name), name)

    def _matrix(self, name: str) -> DataFrame:
        """The pattern from pairs within an element's row instead of a self-join."""
        from ..operators.adjacency import nodal_graph

        pattern = nodal_graph(self.elements)
        return pattern if name == "pattern" else self.spark.sql(_replace(VIEWS["coo"][1], "pattern"), pattern=pattern)

    def _facets(self, name: str) -> DataFrame:
        """Faces that only one element has, from the faces within its row instead of a self-join: as rows (facet_id, tag, fnodes) or by node."""
        from ..operators.boundary import face_keys

        if name == "facet_nodes":
            return self.facets.select("facet_id", "tag", F.explode("fnodes").alias("node_id"))
        faces = face_keys(self.elements).groupBy("f0", "f1", "f2").agg(F.count(F.lit(1)).alias("k"), F.min("elem_id").alias("elem_id"), F.min("off").alias("off")).where("k = 1")
        return faces.select((F.col("elem_id") * 4 + F.col("off")).alias("facet_id"), (10 + 5 * (F.col("elem_id") % 3)).cast("long").alias("tag"), F.array("f0", "f1", "f2").alias("fnodes"))

    @property
    def elements(self) -> DataFrame:
        from ..operators.gather import elements_of

        if "elements" not in self.built:
            self.built["elements"] = elements_of(self.incidence)
        return self.built["elements"]


def _replace(text: str, name: str) -> str:
    """name as a parameter of spark.sql, where it stands as a table."""
    import re

    return re.sub(rf"(from|join) {name}\b", rf"\1 {{{name}}}", text)


def ctes(*names: str) -> str:
    """WITH clause for DuckDB that defines the named views and what they need."""
    order: list[str] = []

    def need(n: str) -> None:
        if n in VIEWS and n not in order:
            for m in VIEWS[n][0]:
                need(m)
            order.append(n)

    for n in names:
        need(n)
    return ", ".join(f"{n} as ({VIEWS[n][1]})" for n in order)
