import warnings

import meshes
import pytest
from pyspark.sql import functions as F

from meshframe.operators import adjacency as AD
from meshframe.operators import assembly as AS
from meshframe.operators import boundary as BD
from meshframe.operators import graph as GR
from meshframe.operators import sparse as SP
from meshframe.operators import vectors as V
from meshframe.operators.gather import gather, incidence_of
from meshframe.sources import mesh_io as IO
from meshframe.streaming.norms import latest_norms, step_norms, stream_norms


def vec(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "idx long, val double")


def coo(spark, rows):
    return spark.createDataFrame([(i, j, float(v)) for i, j, v in rows], "row long, col long, val double")


def dense(df):
    return {(r["row"], r["col"]): r["val"] for r in df.collect()}


def as_dict(df):
    return dict(df.select("idx", "val").collect())


def test_mesh_round_trip_and_missing_tables(spark, tmp_path):
    nodes, elements = meshes.tables(spark, *meshes.box(1))
    IO.write_mesh({"nodes": nodes, "elements": elements}, f"{tmp_path}/m")
    mesh = IO.read_mesh(spark, f"{tmp_path}/m")
    assert mesh["nodes"].count() == 8 and mesh["elements"].count() == 6
    assert mesh["facets"].count() == 0 and mesh["bound_nodes"].columns == ["bound", "node_id"]
    assert IO.table_size(spark, f"{tmp_path}/none") == 0


def test_shape_checks(spark):
    nodes, elements = meshes.tables(spark, *meshes.unit_tet())
    IO.check_mesh(nodes, elements)
    with pytest.raises(ValueError):
        IO.check_mesh(nodes.limit(3), elements)
    with pytest.raises(ValueError):
        IO.check_mesh(nodes, elements.withColumn("nodes", F.slice("nodes", 1, 3)))
    with pytest.raises(ValueError):
        IO.check_flat(spark.range(7), 3)


def test_flatten_inverts_unflatten(spark):
    flat = spark.createDataFrame([(i, float(i * i)) for i in range(12)], "pos long, val double")
    back = IO.flatten(IO.unflatten(flat, 3), "row_id", "vals", 3)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, flat.collect()))


def test_mixed_cells(spark):
    cells = spark.createDataFrame([(0, "tetra"), (1, "wedge"), (2, "vertex"), (3, "tetra")], "cell_id long, ctype string")
    known, unknown = IO.cells_by_type(cells)
    assert sorted(r["etype"] for r in known.collect()) == ["prism", "tet", "tet"]
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        IO.warn_unknown(unknown)
    assert sum("vertex" in str(x.message) for x in w) == 1
    of = lambda k, n: spark.createDataFrame([(i, list(range(k))) for i in range(n)], "elem_id long, nodes array<long>")
    both = IO.union_elements({"hex": of(8, 1), "tet": of(4, 2), "prism": of(6, 1)})
    assert sorted((r["elem_id"], r["etype"]) for r in both.collect()) == [(0, "tet"), (1, "tet"), (2, "prism"), (3, "hex")]
    graph = AD.nodal_graph(both)
    assert graph.count() == 64 and graph.where("row = col").count() == 8


def test_snapshots(spark, tmp_path):
    state = spark.createDataFrame([(i, float(i), 0.0) for i in range(3)], "node_id long, ux double, p double")
    assert [IO.write_snapshot(state, s, f"{tmp_path}/s") for s in (0, 5, 10, 20)] == [True, False, True, True]
    own = spark.read.parquet(f"{tmp_path}/s")
    steps = lambda df: sorted({r["step"] for r in df.collect()})
    assert steps(IO.step_range(own, 0, 20, 20)) == [0, 20] and steps(IO.step_range(own, 10)) == [10]
    assert IO.read_snapshot(spark, f"{tmp_path}/s", 20).count() == 3
    with pytest.raises(ValueError):
        IO.step_range(own, 0, 10, 0)
    plan = IO.step_range(own, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(step" in plan


def test_points_vectors_particles(spark, tmp_path):
    nodes, _ = meshes.tables(spark, *meshes.unit_tet())
    snap = nodes.select(F.lit(10).alias("step"), "node_id", F.col("x").alias("ux"), F.col("y").alias("uy"), F.col("z").alias("uz"), F.lit(1.0).alias("p"))
    points = IO.export_points(nodes, snap, {"u": ["ux", "uy", "uz"]}, ["p"])
    IO.write_points(points, f"{tmp_path}/p")
    IO.write_points(points, f"{tmp_path}/c", "csv")
    assert spark.read.parquet(f"{tmp_path}/p").where("step = 10").count() == 4
    assert spark.read.csv(f"{tmp_path}/c").count() == 4
    IO.save_vector(vec(spark, [1, 2, 3]), f"{tmp_path}/v")
    assert dict(IO.load_vector(spark, f"{tmp_path}/v", 3, "int").dtypes)["val"] == "int"
    with pytest.raises(ValueError):
        IO.load_vector(spark, f"{tmp_path}/v", 4)
    part = spark.range(100).select(F.lit(0).alias("step"), F.col("id").alias("pid"), *[F.array(*[F.lit(0.0)] * 3).alias(c) for c in ("coord", "vel", "acc")], F.lit(1.0).alias("mass"), F.lit(0.1).alias("radius"))
    IO.save_particles(part, f"{tmp_path}/q")
    assert IO.compatible_particles(part, IO.load_particles(spark, f"{tmp_path}/q"))
    assert not IO.compatible_particles(part, part.withColumn("mass", F.lit(2.0)))


def test_vectors(spark):
    x, y = vec(spark, [1, -2, 0]), vec(spark, [2, 0, 0])
    assert as_dict(V.axpby(x, y, 2.0)) == {0: 4, 1: -4, 2: 0}
    p = {r["idx"]: r for r in V.pointwise(x, y, ieee=True).collect()}
    assert p[0]["quotient"] == 0.5 and p[1]["quotient"] == float("-inf") and p[2]["quotient"] != p[2]["quotient"]
    assert V.pointwise(x, y).where("idx = 1").first()["quotient"] is None
    assert as_dict(V.floor_mod(vec(spark, [5, -5]), 3.0)) == {0: 2, 1: 1}
    writes = spark.createDataFrame([(0, 1, 5.0), (2, 1, 7.0), (1, 1, 6.0)], "i long, idx long, val double")
    assert as_dict(V.array_set_at(x, writes)) == {0: 1, 1: 7, 2: 0}
    assert V.array_at(x, spark.createDataFrame([(0, 9)], "i long, idx long")).first()["val"] is None
    assert as_dict(V.fill(x, 4.0)) == {0: 4, 1: 4, 2: 4}
    nan = spark.createDataFrame([(0, float("nan"))], "idx long, val double")
    assert as_dict(V.scale(nan, 0.0))[0] != as_dict(V.scale(nan, 0.0))[0]


def test_offsets_include_empty_rows(spark):
    pattern = spark.createDataFrame([(0, 0), (0, 2), (2, 1)], "row long, col long")
    rows = spark.range(4).withColumnRenamed("id", "row")
    for parts in (1, 3, 50):
        got = AD.prefix_offsets(AD.row_ptr(pattern, rows).select("row", "length"), "row", "length", parts=parts)
        assert [tuple(r) for r in got.select("row", "length", "start").orderBy("row").collect()] == [(0, 2, 0), (1, 0, 2), (2, 1, 2), (3, 0, 3)]


def test_adjacency_of_a_box(spark):
    _, elements = meshes.tables(spark, *meshes.box(2))
    g = AD.nodal_graph(elements)
    flipped = g.select(F.col("col").alias("row"), F.col("row").alias("col"))
    assert g.exceptAll(flipped).isEmpty() and g.where("row = col").count() == 27
    ptr = AD.row_ptr(g, spark.range(27).withColumnRenamed("id", "row"))
    assert ptr.agg(F.max(F.col("start") + F.col("length"))).first()[0] == g.count()
    big = AD.csr_expand(AD.csr_slots(g), ptr, 2, 3)
    assert big.agg(F.countDistinct("pos"), F.max("pos")).first() == (6 * g.count(), 6 * g.count() - 1)


def test_sparse(spark):
    a = coo(spark, [(0, 0, 4), (0, 1, 1), (1, 1, 2), (2, 0, 3)])
    x = vec(spark, [1, 2, 3])
    assert as_dict(SP.spmv(a, x, 2.0, vec(spark, [1, 1, 1, 1]), -1.0)) == {0: 11, 1: 7, 2: 5, 3: -1}
    zeroed = SP.zero_rows(a, spark.createDataFrame([(0,), (99,)], "row long"), 1.0)
    assert dense(zeroed) == {(0, 0): 1, (0, 1): 0, (1, 1): 2, (2, 0): 3}
    assert dense(SP.zero_rows(zeroed, spark.createDataFrame([(0,)], "row long"), 1.0)) == dense(zeroed)
    twice = coo(spark, [(0, 0, 1), (0, 0, 2), (5, 5, 9)])
    assert dense(SP.set_values_coo(a, twice, 2.0, 10.0))[0, 0] == 38 and (5, 5) not in dense(SP.set_values_coo(a, twice, 2.0, 10.0))
    assert dense(SP.add_values(a, twice))[0, 0] == 7
    assert as_dict(SP.get_diag(a, spark.range(4).withColumnRenamed("id", "row"))) == {0: 4, 1: 2, 2: 0, 3: 0}
    assert as_dict(SP.jacobi_apply(a, x)) == {0: 0.25, 1: 1, 2: None}
    b = coo(spark, [(0, 0, 2), (0, 1, 1), (1, 1, 4), (2, 2, 5), (3, 3, 3), (4, 4, 1), (5, 5, 2)])
    y = vec(spark, [1, 2, 3, 4, 5, 6])
    for bs in (2, 3, 6):
        got = as_dict(SP.block_jacobi_apply(b, y, bs))
        assert [got[k] for k in range(6)] == pytest.approx([0.25, 0.5, 0.6, 4 / 3, 5, 3])
    assert SP.nz_index(AD.csr_slots(a.select("row", "col")), spark.createDataFrame([(1, 0)], "row long, col long")).first()["slot"] is None


def test_boundary_conditions(spark):
    bn = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "bound long, node_id long")
    bc = spark.createDataFrame([(0, 0, "STRONG"), (1, 1, "STRONG"), (1, 2, "WEAK"), (0, 2, "NONE")], "bound long, comp int, bctype string")
    dofs = BD.bc_dofs(bn, bc)
    assert sorted(r["dof"] for r in dofs.collect()) == [3, 6, 7]
    v = spark.range(9).select(F.col("id").alias("dof"), F.lit(1.0).alias("val"))
    assert {r["dof"] for r in BD.dirichlet_vec(v, dofs).where("val = 0").collect()} == {3, 6, 7}
    given = spark.createDataFrame([(3, 5.0)], "dof long, bc_val double")
    assert BD.dirichlet_vec(v, dofs, given).where("dof = 3").first()["val"] == 5
    assert BD.free_dofs(v, dofs).count() == 6
    o = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (3, 5)], "bound long, start long")
    assert sorted(map(tuple, BD.bound_expand(o).collect())) == [(0, 0), (0, 1), (2, 2), (2, 3), (2, 4)]


def test_assembly_of_a_box(spark):
    nodes, elements = meshes.tables(spark, *meshes.box(2))
    state = nodes.withColumns({c: F.lit(1.0 if c in ("ux", "phi") else 0.0) for c in meshes.STATE})
    p = gather(incidence_of(elements), state, ["x", "y", "z", *meshes.STATE])
    pairs = AS.element_pairs(p, lambda a, b: F.lit(1.0))
    wide = pairs.select("row", "col", F.col("val").alias("v00"), (F.col("val") * 2).alias("v03"), (F.col("val") * 3).alias("v44"))
    a = AS.assemble_blocks(wide)
    assert {(r["bi"], r["bj"]) for r in a.select("bi", "bj").distinct().collect()} == {("u", "u"), ("u", "p"), ("phi", "phi")}
    assert a.groupBy("bi", "bj").agg(F.sum("val").alias("s")).where("bi = 'u' and bj = 'p'").first()["s"] == 48 * 16 * 2  # 48 elements, 16 pairs each
    n = AS.converged(AS.field_norms(state.withColumn("ux", F.lit(1e-9))), AS.field_norms(state)).first()
    assert not n["converged"]


def test_coloring_is_proper(spark):
    _, elements = meshes.tables(spark, *meshes.box(1))
    inc = incidence_of(elements)
    prio = elements.select("elem_id", F.lit(5).cast("long").alias("prio"))  # all equal: ties by id
    colors = GR.color_elements(inc, prio)
    assert inc.join(colors, "elem_id").groupBy("node_id", "color").count().where("count > 1").isEmpty()
    assert GR.color_stats(colors).first() == (6, False)
    few = GR.color_elements(inc, prio, max_colors=2)
    assert few.where("color is null").count() == 4 and GR.color_stats(few).first()["uncolored"]
    b = GR.color_batches(colors)
    assert [r["pos"] for r in b.orderBy("color", "elem_id").collect()] == list(range(6))


def test_partition_is_balanced(spark):
    _, elements = meshes.tables(spark, *meshes.box(2))
    centers = elements.select("elem_id", (F.col("elem_id") % 2).cast("double").alias("x"), (F.col("elem_id") % 3).cast("double").alias("y"), F.lit(0.0).alias("z"))
    parts = GR.partition_elements(centers, 5, ((0, 0, 0), (2, 3, 1)))
    sizes = [r["count"] for r in parts.groupBy("part").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    q = GR.partition_quality(parts, incidence_of(elements))
    assert q.agg(F.sum("n_elems")).first()[0] == 48


def test_prefix_sums_of_few_keys(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id"), F.lit(2).alias("v"))
    got = AD.prefix_sums(df, ["k", "id"], "v", "at", parts=7).orderBy("k", "id").collect()
    assert [r["at"] for r in got] == list(range(0, 2000, 2))
    plan = AD.prefix_sums(df, ["k", "id"], parts=7)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]  # only the ranges' totals meet in one task


def test_bound_expand_in_chunks(spark):
    o = spark.createDataFrame([(0, 0), (1, 5), (2, 5), (3, 12)], "bound long, start long")
    got = sorted(map(tuple, BD.bound_expand(o, chunk=3).collect()))
    assert got == [(0, k) for k in range(5)] + [(2, k) for k in range(5, 12)]


def test_elements_without_colour_keep_null_places(spark):
    c = spark.createDataFrame([(1, 0), (2, None), (3, 0), (4, 1)], "elem_id long, color int")
    assert sorted(map(tuple, GR.color_batches(c).collect()), key=str) == sorted([(0, 0, 0, 1), (0, 0, 1, 3), (1, 2, 2, 4), (None, None, None, 2)], key=str)


def test_a_singular_block_gives_nulls(spark):
    a = spark.createDataFrame([(0, 0, 2.0), (1, 1, 4.0), (2, 2, 1.0)], "row long, col long, val double")
    x = spark.createDataFrame([(k, 8.0) for k in range(4)], "idx long, val double")
    for bs, want in ((2, [4.0, 2.0, None, None]), (3, [4.0, 2.0, 8.0])):
        assert [r["val"] for r in SP.block_jacobi_apply(a, x, bs).where("idx < 4").orderBy("idx").collect()][: len(want)] == want


def test_stream_equals_batch(spark, tmp_path):
    state = spark.createDataFrame([(s, i, float(i), 1.0, 0.0, 2.0, 3.0, float(s)) for s in (0, 10) for i in range(4)], "step int, node_id long, ux double, uy double, uz double, p double, phi double, temp double")
    out = f"{tmp_path}/out"
    for s in (0, 10):
        state.where(F.col("step") == s).write.parquet(f"{tmp_path}/in/{s}")
        stream_norms(spark, f"{tmp_path}/in/*", state.schema, f"{tmp_path}/check", out)  # goes on where it ended
    assert sorted(map(tuple, latest_norms(spark, out).collect())) == sorted(map(tuple, step_norms(state).collect()))


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from meshframe.sources.scratch import shared_dir

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None, set=lambda k, v: None), sparkContext=SimpleNamespace(master=master))
    for master in ("yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))
    assert shared_dir(session("local[4]")).startswith("file:///tmp/spark-")
