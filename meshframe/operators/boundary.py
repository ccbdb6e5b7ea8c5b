"""Boundary tables: facets, their elements and orientation, node sets, offsets, conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .adjacency import prefix_sums
from .gather import elements_of, incidence_of


def face_keys(elements: DataFrame) -> DataFrame:
    """(f0, f1, f2, elem_id, off): every three corners of each element in ascending order, with the place of the first
    corner that is not among them. A tetrahedron has four."""
    key = lambda three, off: F.struct(three[0].alias("f0"), three[1].alias("f1"), three[2].alias("f2"), off.alias("off"))
    corner = lambda k: F.col("nodes")[k]
    four = F.array(*[key(F.array_sort(F.array(*[corner(k) for k in range(4) if k != off])), F.lit(off)) for off in range(4)])
    n = F.size("nodes")
    least_off = lambda i, j, k: F.when(i > 0, 0).when(j > 1, 1).when(k > 2, 2).otherwise(3)
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    third = lambda i, j: F.transform(upto(j + 1, n - 1), lambda k: key(F.array_sort(F.array(corner(i), corner(j), corner(k))), least_off(i, j, k)))
    many = F.flatten(F.transform(upto(F.lit(0), n - 3), lambda i: F.flatten(F.transform(upto(i + 1, n - 2), lambda j: third(i, j)))))
    return elements.select("elem_id", F.explode(F.when(n == 4, four).otherwise(many)).alias("k")).select("k.f0", "k.f1", "k.f2", "elem_id", "k.off")


def owners_by_face(facets: DataFrame, elements: DataFrame) -> DataFrame:
    """(facet_id, own): for each triangle that is a face of an element the least (elem_id, off). One equi-join: where triangles are
    few they are broadcast and faces stay where they are, else both are dealt by the three nodes."""
    three = facets.where(F.size("fnodes") == 3).select("facet_id", *[F.col("fnodes")[k].alias(f"f{k}") for k in range(3)])
    return face_keys(elements).join(three, ["f0", "f1", "f2"]).groupBy("facet_id").agg(F.min(F.struct("elem_id", "off")).alias("own"))


def facet_owner(facets: DataFrame, elements: DataFrame) -> DataFrame:
    """facets (with an array fnodes of nodes in ascending order) with elem_id, votes and orient: the element that holds most of
    a facet's nodes, the lowest id of equals, how many it holds, and the place of its first node off the facet.

    Triangles are looked up by their three nodes among the elements' faces; only those that are a
    face of no element, and facets of other sizes, are put to the vote by single nodes. The lookup is stored, so that the vote is no part
    of the plan where nothing is left for it."""
    looked = facets.join(owners_by_face(facets, elements), "facet_id", "left")
    three = F.when(F.col("own").isNotNull(), F.lit(3)).cast("long")
    looked = stored(looked.select(*facets.columns, F.col("own.elem_id").alias("elem_id"), three.alias("votes"), F.col("own.off").cast("long").alias("orient")), "owners")
    left = looked.where("elem_id is null").drop("elem_id", "votes", "orient")
    if left.isEmpty():
        return looked
    voted = left.join(votes(left.select("facet_id", F.explode("fnodes").alias("node_id")), incidence_of(elements)), "facet_id")
    off = F.array_position("nodes", F.get(F.array_except("nodes", "fnodes"), F.lit(0))) - 1
    return looked.where("elem_id is not null").unionByName(voted.join(elements.select("elem_id", "nodes"), "elem_id").withColumn("orient", off).select(looked.columns))


def votes(facet_nodes: DataFrame, incidence: DataFrame) -> DataFrame:
    """(facet_id, elem_id, votes): the element that holds most of the facet's nodes, the lowest id of equals.

    Votes are counted by (facet, element) and the best one kept by a partial aggregation, without a sort."""
    each = facet_nodes.select("facet_id", "node_id").join(incidence.select("elem_id", "node_id"), "node_id").groupBy("facet_id", "elem_id").agg(F.count(F.lit(1)).alias("votes"))
    best = F.max(F.struct("votes", (-F.col("elem_id")).alias("neg")))
    return each.groupBy("facet_id").agg(best.alias("b")).select("facet_id", (-F.col("b.neg")).alias("elem_id"), F.col("b.votes").alias("votes"))


def facet_to_elem(facet_nodes: DataFrame, mesh: DataFrame) -> DataFrame:
    """(facet_id, elem_id, votes) of facets (facet_id, node_id); mesh is the elements (with nodes), or their incidence."""
    facets = facet_nodes.groupBy("facet_id").agg(F.array_sort(F.collect_list("node_id")).alias("fnodes"))
    return facet_owner(facets, mesh if "nodes" in mesh.columns else elements_of(mesh)).select("facet_id", "elem_id", "votes")


def facets_of(facet_nodes: DataFrame) -> DataFrame:
    """(facet_id, tag, fnodes)."""
    return facet_nodes.groupBy("facet_id", "tag").agg(F.array_sort(F.collect_list("node_id")).alias("fnodes"))


def facet_orient(facets: DataFrame, owner: DataFrame, elements: DataFrame) -> DataFrame:
    """facets with elem_id and orient, the place in the element of its node off the facet, for given owners."""
    off = F.element_at(F.array_except("nodes", "fnodes"), 1)
    return facets.join(owner.select("facet_id", "elem_id"), "facet_id").join(elements.select("elem_id", "nodes"), "elem_id").withColumn("orient", F.array_position("nodes", off) - 1).drop("nodes")


def boundary_tables(facet_nodes: DataFrame, elements: DataFrame) -> dict[str, DataFrame]:
    """The facets and bound_nodes of a mesh, as write_mesh() stores them."""
    owned = facet_owner(facets_of(facet_nodes), elements)
    facets = owned.join(F.broadcast(bound_ordinals(owned)), "tag").select("facet_id", "tag", "bound", F.col("fnodes").alias("nodes"), "elem_id", "orient")
    return {"facets": facets, "bound_nodes": bound_nodes(facet_nodes)}


def bound_ordinals(facets: DataFrame) -> DataFrame:
    """(tag, bound): boundaries are the ranks of the distinct tags."""
    return facets.select("tag").distinct().withColumn("bound", (F.dense_rank().over(W.orderBy("tag")) - 1).cast("long"))


def facet_offsets(facets: DataFrame) -> DataFrame:
    """(tag, bound, n_facets, start) with facets sorted by tag."""
    counts = facets.groupBy("tag").agg(F.count(F.lit(1)).alias("n_facets"))
    w = W.orderBy("tag")  # one row for each tag
    return counts.select("tag", (F.row_number().over(w) - 1).cast("long").alias("bound"), "n_facets", F.coalesce(F.sum("n_facets").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("start"))


def facet_sorted(facets: DataFrame) -> DataFrame:
    """facets in the stable order of their tags, with their places (a scan in two levels: boundaries are few and large)."""
    return prefix_sums(facets, ["tag", "facet_id"], name="pos").orderBy("tag", "facet_id")


def bound_nodes(facet_nodes: DataFrame) -> DataFrame:
    """Distinct (bound, node_id); a node may be on several boundaries."""
    return facet_nodes.join(F.broadcast(bound_ordinals(facet_nodes)), "tag").select("bound", "node_id").distinct()


def bound_expand(offsets: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """(bound, pos) from offsets (bound, start), the last row being the end. Positions are made in chunks that are
    dealt to all tasks."""
    nxt = offsets.withColumn("stop", F.lead("start").over(W.orderBy("bound"))).where(F.col("stop") > F.col("start"))  # one row for each boundary
    chunks = nxt.select("bound", "stop", F.explode(F.sequence("start", F.col("stop") - 1, F.lit(chunk).cast("long"))).alias("low")).repartition("bound", "low")
    return chunks.select("bound", F.explode(F.sequence("low", F.least(F.col("low") + chunk, F.col("stop")) - 1)).alias("pos"))


def bound_slice(table: DataFrame, bound: int) -> DataFrame:
    return table.where(F.col("bound") == bound)


def bc_dofs(nodes_of_bound: DataFrame, bc: DataFrame, shape: int = 3) -> DataFrame:
    """Distinct (node_id, comp, dof) constrained by a STRONG condition; bc has a few rows for each boundary."""
    strong = F.broadcast(bc.where("bctype = 'STRONG'").select("bound", "comp"))
    return nodes_of_bound.join(strong, "bound").select("node_id", F.col("comp").cast("long").alias("comp"), (F.col("node_id") * shape + F.col("comp")).alias("dof")).distinct()


def free_dofs(dofs: DataFrame, constrained: DataFrame) -> DataFrame:
    return dofs.join(constrained.select("dof"), "dof", "left_anti")


def dirichlet_vec(vec: DataFrame, constrained: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """vec (dof, val) with 0, or the value given for the dof, at constrained dofs; the others unchanged."""
    fixed = constrained.select("dof").withColumn("bc_val", F.lit(0.0)) if values is None else constrained.select("dof").join(values.select("dof", "bc_val"), "dof", "left").fillna(0.0, ["bc_val"])
    return vec.join(fixed, "dof", "left").select("dof", F.coalesce("bc_val", "val").alias("val"))


def row_nodes(rows: DataFrame, shape: int = 3) -> DataFrame:
    """rows (row) with the node_id and component comp that each row of a matrix with shape unknowns a node belongs to."""
    return rows.withColumns({"node_id": F.floor(F.col("row") / F.lit(shape)).cast("long"), "comp": F.pmod("row", F.lit(shape)).cast("long")})
