import meshes
import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.functions import fields as FV
from meshframe.functions import geometry as G
from meshframe.operators import boundary as BD
from meshframe.operators.gather import gather, incidence_of


def packed(spark, points, tets, extra=None):
    nodes, elements = meshes.tables(spark, points, tets)
    for name, col in (extra or {}).items():
        nodes = nodes.withColumn(name, col)
    return gather(incidence_of(elements), nodes, ["x", "y", "z", *(extra or {})]), nodes, elements


def test_unit_tet(spark):
    p, _, _ = packed(spark, *meshes.unit_tet())
    r = G.geometry(p).first()
    assert r["detj"] == 1 and r["volume"] == pytest.approx(1 / 6)
    assert [[r[f"g{a}{i}"] for i in range(3)] for a in range(4)] == [[-1, -1, -1], [1, 0, 0], [0, 1, 0], [0, 0, 1]]
    normals = [tuple(G.facet_normals(G.geometry(p).withColumn("orient", F.lit(o))).select("nx", "ny", "nz").first()) for o in range(4)]
    assert normals == [(1, 1, 1), (-1, 0, 0), (0, -1, 0), (0, 0, -1)]


def test_box_volume_and_gradients(spark):
    p, _, _ = packed(spark, *meshes.box(2), {"f": 2 * F.col("x") - 3 * F.col("y") + F.col("z")})
    g = FV.gradient(G.geometry(p), ["f"])
    assert g.agg(F.sum("volume")).first()[0] == pytest.approx(8)
    assert g.count() == 48
    for r in g.collect():
        assert [r["f_d0"], r["f_d1"], r["f_d2"]] == pytest.approx([2, -3, 1])
        assert np.allclose([sum(r[f"g{a}{i}"] for a in range(4)) for i in range(3)], 0)


def test_integral_of_a_linear_field(spark):
    p, _, _ = packed(spark, *meshes.box(2), {"f": F.col("x")})
    q = FV.quad_values(G.determinant(G.jacobian(p)), ["f"])
    assert q.agg(F.sum(FV.integral(q, "f"))).first()[0] == pytest.approx(8)


def test_flat_element_has_no_inverse(spark):
    p, _, _ = packed(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)], [(0, 1, 2, 3)])
    r = G.inverse(G.determinant(G.jacobian(p))).first()
    assert r["det"] == 0 and r["v00"] is None
    assert G.geometry(p).count() == 0


def test_box_facets_have_their_elements_and_normals(spark):
    n = 2
    p, _, elements = packed(spark, *meshes.box(n))
    fn = spark.createDataFrame(meshes.box_facets(n), "facet_id long, tag long, node_id long")
    assert fn.select("facet_id").distinct().count() == 12 * n * n
    owner = BD.facet_to_elem(fn, incidence_of(elements))
    assert owner.agg(F.min("votes")).first()[0] == 3
    o = BD.facet_orient(BD.facets_of(fn), owner, elements)
    normals = G.facet_normals(o.join(G.geometry(p), "elem_id")).groupBy("tag").agg(F.sum("nx"), F.sum("ny"), F.sum("nz")).orderBy("tag").collect()
    want = [(-8, 0, 0), (8, 0, 0), (0, -8, 0), (0, 8, 0), (0, 0, -8), (0, 0, 8)]
    assert [tuple(r)[1:] for r in normals] == want


def test_facet_tie_takes_lowest_element(spark):
    elements = spark.createDataFrame([(7, [0, 1, 2, 3]), (3, [0, 1, 2, 4])], "elem_id long, nodes array<long>")
    fn = spark.createDataFrame([(0, 1, v) for v in (0, 1, 2)], "facet_id long, tag long, node_id long")
    assert BD.facet_to_elem(fn, incidence_of(elements)).first()["elem_id"] == 3
