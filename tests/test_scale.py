"""How operators do their work: what is joined, moved, stored and repeated."""

import random

import meshes
import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.operators import adjacency as AD
from meshframe.operators import assembly as AS
from meshframe.operators import boundary as BD
from meshframe.operators import graph as GR
from meshframe.operators import sparse as SP
from meshframe.operators import vectors as V
from meshframe.operators.gather import gather, gather_storage, incidence_of
from meshframe.plans import mesh_queries as MQ
from meshframe.sources import mesh_io as IO
from meshframe.sources import scratch as SC
from meshframe.sources.order_mesh import OrderMesh
from meshframe.streaming import norms as NO


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Joins as between large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# facets and their elements


def elements_of(spark, rows):
    return spark.createDataFrame(rows, "elem_id long, nodes array<long>")


def test_faces_are_looked_up_without_a_vote(spark, monkeypatch):
    _, elements = meshes.tables(spark, *meshes.box(2))
    fn = spark.createDataFrame(meshes.box_facets(2), "facet_id long, tag long, node_id long")
    want = sorted(map(tuple, BD.votes(fn, incidence_of(elements)).collect()))
    oriented = sorted(map(tuple, BD.facet_orient(BD.facets_of(fn), BD.votes(fn, incidence_of(elements)), elements).select("facet_id", "elem_id", "orient").collect()))
    monkeypatch.setattr(BD, "votes", None)  # not called where every facet is a face
    owned = BD.facet_owner(BD.facets_of(fn), elements)
    assert sorted(map(tuple, owned.select("facet_id", "elem_id", "votes").collect())) == want
    assert sorted(map(tuple, owned.select("facet_id", "elem_id", "orient").collect())) == oriented
    assert "Join" not in plan(owned)
    few = spark.range(1).select(F.col("id").alias("facet_id"), F.array(*[F.col("id") + v for v in (0, 1, 2)]).alias("fnodes"))
    assert "hashpartitioning(f0" not in plan(BD.owners_by_face(few, elements)) and "BroadcastHashJoin" in plan(BD.owners_by_face(few, elements))


def test_random_facets_have_the_owners_of_the_vote(spark):
    rng = random.Random(1)
    elements = elements_of(spark, [(7 * i + 3, rng.sample(range(30), rng.choice([4, 4, 6, 8]))) for i in range(60)])
    fn = spark.createDataFrame([(f, 1, v) for f in range(300) for v in rng.sample(range(30), rng.choice([3, 3, 3, 2, 4]))], "facet_id long, tag long, node_id long")
    voted = sorted(map(tuple, BD.votes(fn, incidence_of(elements)).collect()))
    assert sorted(map(tuple, BD.facet_to_elem(fn, elements).collect())) == voted
    assert sorted(map(tuple, BD.facet_to_elem(fn, incidence_of(elements)).collect())) == voted
    by_id = {r["facet_id"]: r for r in BD.facet_owner(BD.facets_of(fn), elements).collect()}
    nodes = {r["elem_id"]: r["nodes"] for r in elements.collect()}
    for f, e, _ in voted:
        off = [k for k, v in enumerate(nodes[e]) if v not in by_id[f]["fnodes"]]
        assert by_id[f]["elem_id"] == e and by_id[f]["orient"] == off[0]


def test_boundary_of_a_stored_mesh(spark, tmp_path):
    nodes, elements = meshes.tables(spark, *meshes.box(1))
    fn = spark.createDataFrame(meshes.box_facets(1), "facet_id long, tag long, node_id long")
    made = BD.boundary_tables(fn, elements)
    IO.write_mesh({"nodes": nodes, "elements": elements} | made, f"{tmp_path}/m")
    mesh = IO.read_mesh(spark, f"{tmp_path}/m")
    assert {n: mesh[n].count() for n in ("facets", "bound_nodes")} == {"facets": 12, "bound_nodes": 24}
    for name, df in made.items():
        assert sorted(map(tuple, mesh[name].collect())) == sorted(map(tuple, df.select(mesh[name].columns).collect()))


def test_rows_of_a_matrix_name_node_and_component(spark):
    rows = spark.createDataFrame([(0,), (4,), (11,)], "row long")
    assert [tuple(r) for r in BD.row_nodes(rows, 3).orderBy("row").collect()] == [(0, 0, 0), (4, 1, 1), (11, 3, 2)]


# colouring and partitions


def brute_colors(elements, prio):
    colors = {}
    for e in sorted(elements, key=lambda e: (-prio[e], -e)):
        near = [colors[x] for x in colors if set(elements[x]) & set(elements[e])]
        colors[e] = max(near, default=-1) + 1
    return colors


def morton(n, size):
    box = ((0.0,) * 3, (float(size),) * 3)
    return lambda centers: lambda k: GR.partition_elements(centers, k or n, box)


def box_mesh(spark, n):
    points, tets = meshes.box(n)
    _, elements = meshes.tables(spark, points, tets)
    centers = spark.createDataFrame([(i, *[sum(points[v][k] for v in t) / 4 for k in range(3)]) for i, t in enumerate(tets)], "elem_id long, x double, y double, z double")
    return points, tets, elements, centers


def test_colors_do_not_depend_on_the_parts(spark):
    _, tets, elements, centers = box_mesh(spark, 3)
    inc = incidence_of(elements)
    prio = elements.select("elem_id", ((F.col("elem_id") * 7919) % 101).alias("prio"))
    want = brute_colors(dict(enumerate(tets)), {r["elem_id"]: r["prio"] for r in prio.collect()})
    for size, parts in ((1 << 19, None), (40, None), (40, morton(0, 3)(centers))):
        assert dict(GR.color_elements(inc, prio, parts=parts, part_elements=size).collect()) == want


def test_the_elements_of_a_hub_are_ranked_by_many_tasks(spark):
    n = 3000
    inc = spark.range(n).select(F.col("id").alias("elem_id"), F.explode(F.array(F.lit(-1).cast("long"), F.col("id"))).alias("node_id"))
    prio = spark.range(n).select(F.col("id").alias("elem_id"), (F.col("id") % 7).alias("prio"))
    ranked = sorted(range(n), key=lambda e: (-(e % 7), -e))
    assert dict(GR.color_elements(inc, prio, max_colors=n).collect()) == {e: k for k, e in enumerate(ranked)}
    got = AD.previous_value(spark.range(n).select(F.lit(1).alias("k"), "id"), [F.col("k"), F.desc("id")], F.col("id"), "before", parts=9)
    assert {r["id"]: r["before"] for r in got.collect()} == {i: i + 1 if i < n - 1 else None for i in range(n)}
    text = plan(AD.previous_value(spark.range(n), [F.col("id")], F.col("id"), "before", parts=9))
    assert "SinglePartition" not in text.split("BroadcastExchange")[0]  # only the ranges' last rows meet in one task


def test_few_rounds_of_exchange_along_a_curve(spark):
    """Rounds of exchange against the rounds that colours take one by one."""
    _, _, elements, centers = box_mesh(spark, 8)
    prio = elements.select("elem_id", F.pmod(F.xxhash64("elem_id"), F.lit(1 << 40)).alias("prio"))
    colors, rounds = GR.color_rounds(incidence_of(elements), prio, morton(0, 8)(centers), part_elements=1000)
    depth = colors.agg(F.max("color") + 1).first()[0]
    assert depth > 40 and 2 <= rounds <= depth / 5


def scattered(spark, n, nodes, seed):
    """Elements of four nodes from everywhere, some node twice in one; (elements, incidence, priorities with ties)."""
    rng = np.random.default_rng(seed)
    tets = {e: rng.integers(0, nodes, 4).tolist() for e in range(n)}
    inc = spark.createDataFrame([(e, a, v) for e, t in tets.items() for a, v in enumerate(t)], "elem_id long, local int, node_id long")
    return tets, inc, spark.createDataFrame([(e, int(rng.integers(0, n // 3))) for e in tets], "elem_id long, prio long")


def test_elements_without_locality_are_solved_once_by_bands(spark):
    tets, inc, prio = scattered(spark, 900, 200, 6)
    want = brute_colors(tets, {r["elem_id"]: r["prio"] for r in prio.collect()})
    more = prio.unionByName(spark.range(10_000, 10_300).select(F.col("id").alias("elem_id"), F.lit(1 << 40).alias("prio")))  # a band without incidence
    lone = inc.unionByName(spark.createDataFrame([(20_000, 0, 3)], "elem_id long, local int, node_id long"))  # no priority
    colors, bands = GR.color_rounds(lone, more, part_elements=200)
    assert bands == 6 and max(want.values()) > 20  # not a round for each step of a chain from part to part
    assert dict(colors.collect()) == want


def test_refined_parts_share_fewer_nodes(spark):
    _, _, elements, centers = box_mesh(spark, 6)
    inc = incidence_of(elements)
    parts = GR.partition_elements(centers, 5, ((0.0,) * 3, (6.0,) * 3))
    shared = lambda p: GR.partition_quality(p, inc).agg(F.sum("shared_nodes"), F.max("n_elems"), F.min("n_elems")).first()
    before, one, more = shared(parts), shared(GR.refine_partition(parts, inc, 1)), shared(GR.refine_partition(parts, inc, 5))
    assert more[0] < one[0] < before[0]
    mean = 6**4 / 5
    assert more[1] <= mean * 1.03 and more[2] >= mean * 0.97
    moves = GR.part_moves(parts, inc)
    assert moves.join(inc, "elem_id").groupBy("node_id").count().where("count > 1").isEmpty()
    free = shared(parts.join(moves.select("elem_id", "to"), "elem_id", "left").select("elem_id", F.coalesce("to", "part").alias("part")))
    assert before[0] - free[0] == moves.agg(F.sum("gain")).first()[0]  # gains add up
    assert sorted(map(tuple, GR.refine_partition(parts, inc, 2).collect())) == sorted(map(tuple, GR.refine_partition(parts, inc, 2).collect()))


def test_moves_are_those_of_every_element_and_part_tried(spark):
    """On scattered elements, and with none of the sums left to interpreted lambdas."""
    tets, inc, _ = scattered(spark, 900, 500, 7)
    part = {e: e * 13 % 6 for e in tets}
    parts = spark.createDataFrame(list(part.items()), "elem_id long, part int")
    count = {}
    for e, t in tets.items():
        for v in set(t):
            held = count.setdefault(v, {})
            held[part[e]] = held.get(part[e], 0) + 1
    shared = lambda held: len(held) if len(held) > 1 else 0
    wants = {}
    for e, t in tets.items():
        tried = []
        for b in {b for v in t for b in count[v]} - {part[e]}:
            after = [{p: n for p, n in count[v].items() if p != part[e] or n > 1} | {b: 1} for v in set(t)]
            tried.append((sum(shared(count[v]) for v in set(t)) - sum(map(shared, after)), -b))
        if tried and max(tried)[0] > 0:
            wants[e] = max(tried)
    best = {v: max((wants[e][0], -e) for e in wants if v in tets[e]) for v in {v for e in wants for v in tets[e]}}
    want = {(e, part[e], -b, g) for e, (g, b) in wants.items() if all(best[v] == (g, -e) for v in tets[e])}
    moves = GR.part_moves(parts, inc)
    assert len(want) > 10 and set(map(tuple, moves.collect())) == want and moves.schema["to"].dataType == parts.schema["part"].dataType
    assert "lambda" not in plan(moves)


def test_incidence_is_made_once_for_colours_and_refinement(spark):
    for f in (MQ.colored, MQ.refined):
        m = OrderMesh(spark, "/root/testdata/sf0.001")
        f(m)
        assert "lineitem" not in plan(m.incidence) and "lineitem" not in plan(m.priority)
    moved = plan(GR.partition_quality(m.incidence.select("elem_id", (F.col("elem_id") % 3).cast("int").alias("part")).distinct(), m.incidence))
    assert moved.split("Initial Plan")[0].count("Join") == 2  # nodes are not joined with themselves


# ids, lists


def test_ids_of_a_union_are_distinct_and_dense(spark):
    of = lambda k, ids: spark.createDataFrame([(i, list(range(k))) for i in ids], "elem_id long, nodes array<long>")
    got = IO.union_elements({"hex": of(8, [3, 100]), "tet": of(4, [50, 7, 9000]), "prism": of(6, [7, 100])})
    assert sorted((r["elem_id"], r["etype"], len(r["nodes"])) for r in got.collect()) == [(0, "tet", 4), (1, "tet", 4), (2, "tet", 4), (3, "prism", 6), (4, "prism", 6), (5, "hex", 8), (6, "hex", 8)]
    degree = dict(AD.node_degree(incidence_of(got)).collect())
    assert degree[0] == 7 and degree[5] == 4 and degree[7] == 2


def test_the_list_of_a_hub_is_in_segments(spark):
    hub = spark.range(1_000_000).select(F.col("id").alias("elem_id"), F.lit(0).alias("local"), F.lit(5).cast("long").alias("node_id"))
    inc = hub.unionByName(spark.createDataFrame([(3, 1, 4), (9, 1, 4), (9, 2, 6), (9, 2, 6)], "elem_id long, local int, node_id long"))
    segments = SC.stored(AD.v2e_segments(inc, 10_000), "segments")
    assert segments.agg(F.max(F.size("elems"))).first()[0] == 10_000
    joined = segments.groupBy("node_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("segment", "elems"))), lambda x: x["elems"])).alias("elems"))
    assert joined.exceptAll(AD.v2e(inc)).isEmpty() and joined.count() == 3
    assert segments.where("node_id = 5").agg(F.min("segment"), F.countDistinct("segment"), F.max("segment") + 1).first()[0] == 0


# stored buckets


def test_a_stored_matrix_is_not_moved_by_products(spark, no_broadcast):
    a = SC.stored(spark.range(2000).select((F.col("id") % 40).alias("row"), (F.col("id") * 7 % 50).alias("col"), F.col("id").cast("double").alias("val")), "a")
    x = spark.range(50).select(F.col("id").alias("idx"), F.col("id").cast("double").alias("val"))
    kept = SP.product_storage(a, 4)
    for _ in range(2):  # as often as it is used
        y = SP.spmv(kept, x)
        assert sorted(map(tuple, y.collect())) == sorted(map(tuple, SP.spmv(a, x).collect()))
        assert "hashpartitioning(col#" not in matrix_side(y) and "Bucketed: true" in plan(y)
    blocks = a.select(F.lit("u").alias("bi"), F.lit("p").alias("bj"), "row", "col", "val")
    fields = x.select(F.explode(F.array(F.lit("u"), F.lit("p"))).alias("field"), "idx", "val")
    y = SP.spmv_blocks(SP.product_storage(blocks, 4), fields, fields, 1.0, 0.0)
    assert "hashpartitioning" not in matrix_side(y)
    assert sorted(map(tuple, y.collect())) == sorted(map(tuple, SP.spmv_blocks(blocks, fields, fields, 1.0, 0.0).collect()))
    SC.discard_buckets(kept)
    assert not IO.exists(spark, kept.scratch_path)


def matrix_side(df):
    """The plan from the join down to the scan of the bucketed table."""
    text = plan(df).split("Initial Plan")[-1].split("\n")
    scan = next(i for i, line in enumerate(text) if "Bucketed: true" in line)
    join = max(i for i in range(scan) if "Join" in text[i])
    return "\n".join(text[join + 1 : scan])


def test_stored_incidence_is_not_moved_by_gathers(spark, no_broadcast):
    nodes, elements = meshes.tables(spark, *meshes.box(2))
    inc = incidence_of(elements)
    g = gather(gather_storage(inc, 4), nodes, ["x", "y"])
    assert "hashpartitioning" not in matrix_side(g)
    assert sorted(map(tuple, g.collect())) == sorted(map(tuple, gather(inc, nodes, ["x", "y"]).collect()))


def test_scratch_tables_go_with_their_scope(spark):
    with SC.scratch_scope():
        t = SC.stored(spark.range(3), "t")
        assert t.count() == 3
    assert not IO.exists(spark, t.scratch_path)


# assembly


def test_locality_halves_what_an_assembly_moves(spark):
    nodes, elements = meshes.tables(spark, *meshes.box(10))
    packed = gather(incidence_of(elements), nodes, ["x", "y", "z"])
    local = AS.localized(packed, ((0.0,) * 3, (10.0,) * 3), 8)

    def moved(p):
        """Rows after the sums within each task, which are those that are shuffled."""
        pairs = AS.element_pairs(p, lambda a, b: F.lit(1.0))
        return pairs.groupBy(F.spark_partition_id().alias("task"), "row", "col").count().count()

    assert moved(local) < 0.5 * moved(packed.repartition(8, "elem_id")) and moved(local) < 0.5 * 16 * 6000
    key = lambda df: sorted(map(tuple, df.select("row", "col", F.round("val", 6)).collect()))
    assert key(AS.assemble_coo(AS.element_pairs(local, lambda a, b: F.col("x0")))) == key(AS.assemble_coo(AS.element_pairs(packed, lambda a, b: F.col("x0"))))


def test_blocks_of_any_size_are_solved_in_the_jvm(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    for bs in (1, 2, 4, 5, 7):
        m = rng.standard_normal((3 * bs, 3 * bs)).round(3)
        m[bs : 2 * bs, bs : 2 * bs] = 0  # the second block is singular
        if bs > 1:
            m[0, 0] = 0  # and the first needs another pivot
        a = spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m) if v], "row long, col long, val double").unionByName(spark.createDataFrame([(bs, bs, 0.0)], "row long, col long, val double"))
        x = spark.createDataFrame([(i, float(i + 1)) for i in range(3 * bs)], "idx long, val double")
        df = SP.block_jacobi_apply(a, x, bs)
        got = dict(df.collect())
        for k in (0, 2):
            rows = slice(k * bs, (k + 1) * bs)
            assert [got[i] for i in range(*rows.indices(3 * bs))] == pytest.approx(np.linalg.solve(m[rows, rows], np.arange(1.0, 3 * bs + 1)[rows]).tolist())
        assert [got[i] for i in range(bs, 2 * bs)] == [None] * bs
        assert "Python" not in plan(df) and "Pandas" not in plan(df)


# repeated writes


def test_a_step_that_is_written_again_replaces_itself(spark, tmp_path):
    state = spark.createDataFrame([(i, float(i)) for i in range(3)], "node_id long, ux double")
    for step, factor in ((0, 1.0), (10, 1.0), (10, 2.0)):
        IO.write_snapshot(state.withColumn("ux", F.col("ux") * factor), step, f"{tmp_path}/s")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/s").select("step", "node_id", "ux").collect())) == [(0, 0, 0.0), (0, 1, 1.0), (0, 2, 2.0), (10, 0, 0.0), (10, 1, 2.0), (10, 2, 4.0)]


STATE = "step int, node_id long, ux double, uy double, uz double, p double, phi double, temp double"


def snapshots(spark, steps, weight=1.0):
    return spark.createDataFrame([(s, i, float(i) * weight, 1.0, 0.0, 2.0, 3.0, float(s)) for s in steps for i in range(3)], STATE)


def test_a_stream_keeps_a_bounded_number_of_folders(spark, tmp_path):
    src, out, check = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    for s in range(22):
        snapshots(spark, [s]).coalesce(1).write.mode("append").parquet(src)
    run = lambda: NO.stream_norms(spark, src, snapshots(spark, [0]).schema, check, out, every=5, maxFilesPerTrigger=1)
    run()
    batches, bases = NO.folders(spark, out)
    assert set(bases) == {19} and set(batches) == {20, 21}
    assert sorted(map(tuple, NO.latest_norms(spark, out).collect())) == sorted(map(tuple, NO.step_norms(spark.read.parquet(src)).collect()))
    snapshots(spark, [3, 50], 2.0).coalesce(1).write.mode("append").parquet(src)  # more rows of an old step, after a restart
    run()
    assert sorted(map(tuple, NO.latest_norms(spark, out).collect())) == sorted(map(tuple, NO.step_norms(spark.read.parquet(src)).collect()))


def test_a_repeated_batch_or_compaction_changes_nothing(spark, tmp_path):
    out = f"{tmp_path}/out"
    for n in range(4):
        NO.step_norms(snapshots(spark, [n])).write.mode("overwrite").parquet(f"{out}/batch={n}")
    want = sorted(map(tuple, NO.latest_norms(spark, out).collect()))
    NO.compact(spark, out, 3)
    NO.step_norms(snapshots(spark, [3])).write.mode("overwrite").parquet(f"{out}/batch=3")  # the last batch comes again
    NO.compact(spark, out, 3)
    assert sorted(map(tuple, NO.latest_norms(spark, out).collect())) == want
    assert [list(x) for x in NO.folders(spark, out)] == [[], [3]]


# vectors


def test_floor_mod_of_large_values(spark):
    v = spark.createDataFrame([(0, 1e20), (1, -7.5), (2, float(2**60 + 4096)), (3, float("nan"))], "idx long, val double")
    got = dict(V.floor_mod(v, 4.0).collect())
    assert (got[0], got[1], got[2]) == (0.0, 0.5, 0.0) and got[3] != got[3]


def test_mask_of_an_index_outside_is_zero(spark):
    index = spark.createDataFrame([(1, 10), (2, 11), (3, 99)], "facet_id long, elem_id long")
    data = spark.createDataFrame([(10, 1), (11, 2)], "elem_id long, color int")
    assert dict(V.mask_at(index, data, "elem_id", "color", F.lit(1)).select("facet_id", "mask").collect()) == {1: 1, 2: 0, 3: 0}
