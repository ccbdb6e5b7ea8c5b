"""Queries on the order mesh, one for each operator; each reads the Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fields as FV
from ..functions import geometry as G
from ..functions import stages as ST
from ..operators import adjacency as AD
from ..operators import assembly as AS
from ..operators import boundary as BD
from ..operators import graph as GR
from ..operators import sparse as SP
from ..operators import vectors as V
from ..operators.gather import corner_rows, element_sum, gather, gather_storage, incidence_of, scatter_add
from ..schema import F1, F2, FIELDS, MU, RATES
from ..sources import mesh_io as IO
from ..sources.order_mesh import OrderMesh
from ..sources.scratch import scratch_path
from ..streaming.norms import latest_norms
from ..streaming.norms import stream_norms as stream

c = F.col
XYZ = ["x", "y", "z"]
BOX = ((0.0, 0.0, 0.0), (101.0, 51.0, 1009.0))  # of the order mesh
QUERIES: dict = {}


def query(f):
    """Register f(mesh) under its name (less a final underscore) as query(spark, folder)."""
    QUERIES[f.__name__.rstrip("_")] = lambda spark, folder: f(OrderMesh(spark, folder))
    return f


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[(F.round(x, places) + 0.0).alias(x) if t == "double" else c(x) for x, t in df.dtypes])


def decimal_sum(column):
    """Sum whose result does not depend on the order of the rows."""
    return F.sum(column.cast("decimal(28,6)")).cast("double")


def packed(m: OrderMesh, columns=(), incidence=None) -> DataFrame:
    """Elements with corner coordinates and fields (fields and coordinates in one join)."""
    nodal = m.nodes if not columns else m.nodes.join(m.fields.select("node_id", *columns), "node_id")
    return gather(m.incidence if incidence is None else incidence, nodal, [*XYZ, *columns])


def geo(m: OrderMesh, columns=()) -> DataFrame:
    return G.geometry(packed(m, columns))


def oriented(m: OrderMesh) -> DataFrame:
    return BD.facet_owner(m.facets, m.elements)


def facet_geo(m: OrderMesh, columns=()) -> DataFrame:
    """Facets with the geometry of their elements; owners are looked up once and stored."""
    return oriented(m).select("facet_id", "tag", "orient", "elem_id").join(geo(m, columns), "elem_id")


# sources and sinks


def mixed_elements(m):
    """Tetrahedra of the order mesh, and prisms and hexahedra of consecutive parts."""
    run = lambda k: m.part.where(c("p_partkey") % k == 0).select(c("p_partkey").alias("elem_id"), F.sequence(c("p_partkey"), c("p_partkey") + k - 1).alias("nodes"))
    return IO.union_elements({"tet": m.elements, "prism": run(6), "hex": run(8)})


def stored_mesh(m, boundary: bool = False):
    """The mixed mesh, written and read again, on request with the boundary of its tetrahedra."""
    path = scratch_path(m.spark, "mesh")
    elements = mixed_elements(m)
    more = BD.boundary_tables(m.facet_nodes, elements.where("etype = 'tet'")) if boundary else {}
    IO.write_mesh({"nodes": m.nodes, "elements": elements} | more, path)
    return IO.read_mesh(m.spark, path), path


@query
def mesh_round_trip(m):
    return stored_mesh(m)[0]["elements"]


@query
def facets_round_trip(m):
    return stored_mesh(m, boundary=True)[0]["facets"]


@query
def bound_round_trip(m):
    return stored_mesh(m, boundary=True)[0]["bound_nodes"]


@query
def mesh_counts(m):
    mesh = stored_mesh(m)[0]
    return IO.mesh_counts(mesh["nodes"], mesh["elements"])


@query
def table_sizes(m):
    path = scratch_path(m.spark, "mesh")
    IO.write_mesh({"nodes": m.nodes, "elements": m.elements}, path)
    return m.spark.createDataFrame([(n, IO.exists(m.spark, f"{path}/{n}"), IO.table_size(m.spark, f"{path}/{n}")) for n in ("nodes", "elements", "facets")], "name string, found boolean, n long")


@query
def shape_checks(m):
    """What passes the checks: the mesh, a mesh without nodes, one with a missing corner; flat tables of the embeddings."""

    def passes(check, *args):
        try:
            check(*args)
        except ValueError:
            return False
        return True

    elements, flat = mixed_elements(m), m.embeddings.select(F.explode("embedding").alias("val"))
    short = elements.withColumn("nodes", F.when(c("etype") == "hex", F.slice("nodes", 1, 7)).otherwise(c("nodes")))
    rows = [("mesh", IO.check_mesh, m.nodes, elements), ("no nodes", IO.check_mesh, m.nodes.where("node_id is null"), elements), ("wrong corners", IO.check_mesh, m.nodes, short)]
    rows += [("flat by 8", IO.check_flat, flat, 8), ("flat by 7", IO.check_flat, flat, 7), ("flat short by one", IO.check_flat, flat.offset(1), 8)]
    return m.spark.createDataFrame([(name, passes(*check)) for name, *check in rows], "what string, ok boolean")


def stored_snapshots(m):
    path = scratch_path(m.spark, "snapshots")
    m.snapshots.write.partitionBy("step").parquet(path)
    return path


@query
def snapshot_round_trip(m):
    """States written by steps, one of them twice; steps off the cadence are not written."""
    path = scratch_path(m.spark, "snapshots")
    for step in (10, 20, 15, 20):
        IO.write_snapshot(m.snapshots.where(c("step") == step).drop("step"), step, path)
    return IO.read_snapshot(m.spark, path, 20)


@query
def stored_range(m):
    """A range of steps on a table partitioned by step: only those partitions are read."""
    return IO.step_range(m.spark.read.parquet(stored_snapshots(m)), 0, 50, 20).groupBy("step").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("p").alias("sum_p"))


@query
def points_round_trip(m):
    path = scratch_path(m.spark, "points")
    IO.write_points(IO.export_points(m.nodes, IO.step_range(m.snapshots, 0, 30, 30), {"u": ["ux", "uy", "uz"]}, ["p", "phi", "temp"]), path)
    e = m.spark.read.parquet(path)
    return e.select("step", "node_id", "x", "y", "z", "p", "phi", "temp", c("u")[0].alias("u0"), c("u")[1].alias("u1"), c("u")[2].alias("u2"))


@query
def vector_round_trip(m):
    path = scratch_path(m.spark, "vector")
    IO.save_vector(m.vec, path)
    return IO.load_vector(m.spark, path, m.vec.count()).select("idx", "val")


@query
def particle_round_trip(m):
    """Particles at the nodes, written and read, and whether they fit themselves and heavier ones."""
    path = scratch_path(m.spark, "particles")
    three = lambda *x: F.array(*x)
    made = m.nodes.select(F.lit(0).alias("step"), c("node_id").alias("pid"), three("x", "y", "z").alias("coord"), three(c("x") * 2, c("y") * 2, c("z") * 2).alias("vel"), three(*[F.lit(0.0)] * 3).alias("acc"), F.lit(1.0).alias("mass"), F.lit(0.1).alias("radius"))
    IO.save_particles(made, path)
    got = IO.load_particles(m.spark, path)
    same, heavy = IO.compatible_particles(made, got), IO.compatible_particles(made.withColumn("mass", c("mass") * 2), got)
    return got.select("pid", (c("coord")[0] + c("coord")[1] + c("coord")[2]).alias("sum_coord"), c("vel")[0].alias("vel0"), "mass", F.lit(same).alias("compatible"), F.lit(heavy).alias("compatible_heavy"))


@query
def stream_norms(m):
    """Norms of the snapshot files as a stream reads them."""
    path, out = stored_snapshots(m), scratch_path(m.spark, "norms")
    stream(m.spark, path, m.spark.read.parquet(path).schema, scratch_path(m.spark, "norms-checkpoint"), out)
    return rounded(latest_norms(m.spark, out), 4)


@query
def nodal_graph_mixed(m):
    return AD.nodal_graph(mixed_elements(m))


@query
def unflatten(m):
    flat = m.embeddings.select((c("vec_id") * 64).alias("base"), F.posexplode("embedding").alias("at", "val")).select((c("base") + c("at")).alias("pos"), c("val").cast("double").alias("val"))
    return IO.unflatten(flat, 8)


@query
def flatten(m):
    return IO.flatten(m.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")), "vec_id", "e", 64)


@query
def bound_expand(m):
    o = BD.facet_offsets(m.facets)
    end = o.agg(F.count(F.lit(1)).alias("bound"), F.sum("n_facets").alias("start"))
    return BD.bound_expand(o.select("bound", "start").unionByName(end))


@query
def snapshot_range(m):
    return IO.step_range(m.snapshots, 10, 50, 20).groupBy("step").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("ux").alias("sum_ux"))


@query
def export_points(m):
    e = IO.export_points(m.nodes, IO.step_range(m.snapshots, 0, 50, 10), {"u": ["ux", "uy", "uz"]}, ["p", "phi", "temp"])
    return e.select("step", "node_id", "x", "y", "z", "p", "phi", "temp", c("u")[0].alias("u0"), c("u")[1].alias("u1"), c("u")[2].alias("u2"))


@query
def cells_by_type(m):
    kind = F.when(c("p_partkey") % 5 == 0, "tetra").when(c("p_partkey") % 5 == 1, "wedge").when(c("p_partkey") % 5 == 2, "hexahedron").when(c("p_partkey") % 5 == 3, "triangle").otherwise("line")
    known, unknown = IO.cells_by_type(m.part.select("p_partkey", kind.alias("ctype")))
    return known.groupBy(c("etype").alias("ctype")).agg(F.count(F.lit(1)).alias("n")).unionByName(unknown.select(F.concat(F.lit("unknown "), "ctype").alias("ctype"), c("count").alias("n")))


# predicates, vectors


@query
def count_value(m):
    return V.count_value(m.vec, "val", 3.0)


@query
def find_value(m):
    return V.find_value(m.vec, "idx", "val", 3.0)


@query
def facet_color_mask(m):
    own = oriented(m)
    color = m.elements.select("elem_id", (c("elem_id") % 4).alias("color"))
    return V.mask_at(own.select("facet_id", "elem_id"), color, "elem_id", "color", F.lit(1)).select("facet_id", "mask")


@query
def bound_slice(m):
    return BD.bound_slice(BD.bound_nodes(m.facet_nodes), 1)


@query
def init_field(m):
    return FV.init_field(m.nodes, FV.UNIFORM_FLOW).select("node_id", *FIELDS)


@query
def smooth_step(m):
    return rounded(m.nodes.select("node_id", FV.smooth_step(c("z") / 1e6 - 3e-4, 0.75e-4, 2e-4).alias("h")))


@query
def vec_scale(m):
    return V.scale(m.vec, -2.5)


@query
def vec_fill(m):
    return V.fill(m.vec, 2.5)


@query
def vec_axpby(m):
    return V.axpby(m.vec, m.nodes.select(c("node_id").alias("idx"), c("y").alias("val")), 2.0, -3.0)


@query
def vec_pointwise(m):
    return rounded(V.pointwise(m.nodes.select(c("node_id").alias("idx"), c("z").alias("val")), m.vec))


@query
def vec_pointwise_ieee(m):
    """Quotients and inverses by IEEE rules, infinities and NaN named."""
    p = V.pointwise(m.nodes.select(c("node_id").alias("idx"), (c("z") % 3).alias("val")), m.vec, ieee=True)
    kind = lambda x: F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(F.format_string("%.3f", x))
    return p.select("idx", kind(c("quotient")).alias("quotient"), kind(c("inverse")).alias("inverse"))


@query
def vec_mod(m):
    return V.floor_mod(m.vec, 4.0)


@query
def vec_dot(m):
    return V.dot(m.vec, m.nodes.select(c("node_id").alias("idx"), c("z").alias("val")))


@query
def vec_norm2(m):
    return rounded(V.norm2(m.vec))


@query
def array_at(m):
    return V.array_at(m.vec, m.incidence.where("local = 0").select(c("elem_id").alias("i"), c("node_id").alias("idx")))


@query
def array_set_at(m):
    return V.array_set_at(m.vec, m.incidence.where("local = 1").select(c("elem_id").alias("i"), c("node_id").alias("idx"), c("elem_id").cast("double").alias("val")))


# joins on connectivity, boundaries


@query
def gather_(m):
    return packed(m)


@query
def gather_stored(m):
    """The same from incidence that is stored in buckets by node."""
    return packed(m, incidence=gather_storage(m.incidence))


@query
def lumped_mass(m):
    g = G.determinant(G.jacobian(packed(m))).withColumn("share", c("detj") / 24)
    return scatter_add(corner_rows(g, {"detj": ["detj"] * 4}), ["detj"]).select("node_id", (c("detj") / 24).alias("mass"))


@query
def facet_to_elem(m):
    return oriented(m).select("facet_id", "elem_id", "votes")


@query
def facet_orient(m):
    return oriented(m).select("facet_id", "tag", "elem_id", c("orient").cast("long").alias("orient"))


@query
def facet_offsets(m):
    return BD.facet_offsets(m.facets)


@query
def facet_sorted(m):
    return BD.facet_sorted(m.facets).select("tag", "facet_id", "pos")


@query
def bound_nodes(m):
    return BD.bound_nodes(m.facet_nodes)


@query
def bc_dofs(m):
    return BD.bc_dofs(BD.bound_nodes(m.facet_nodes), m.bc)


def dof_vector(m):
    return m.nodes.select(F.posexplode(F.array("x", "y", "z")).alias("comp", "val"), "node_id").select((c("node_id") * 3 + c("comp")).alias("dof"), "val")


@query
def free_dofs(m):
    return BD.free_dofs(dof_vector(m), BD.bc_dofs(BD.bound_nodes(m.facet_nodes), m.bc)).select("dof")


@query
def dirichlet_vec(m):
    return BD.dirichlet_vec(dof_vector(m), BD.bc_dofs(BD.bound_nodes(m.facet_nodes), m.bc))


@query
def dirichlet_values(m):
    """Values given at the even nodes, 0 at the other constrained ones."""
    given = m.nodes.where("node_id % 2 = 0").select(F.explode(F.array(*[c("node_id") * 3 + k for k in range(3)])).alias("dof")).withColumn("bc_val", c("dof") * 0.5)
    return BD.dirichlet_vec(dof_vector(m), BD.bc_dofs(BD.bound_nodes(m.facet_nodes), m.bc), given)


@query
def row_nodes(m):
    return BD.row_nodes(dof_vector(m).select(c("dof").alias("row")))


@query
def dirichlet_mat(m):
    rows = BD.bc_dofs(BD.bound_nodes(m.facet_nodes), m.bc).select(c("dof").alias("row"))
    blocks = m.coo.select((c("row") * 3).alias("row"), (c("col") * 3).alias("col"), "val").unionByName(m.coo.select((c("row") * 3 + 1).alias("row"), (c("col") * 3 + 1).alias("col"), "val"))
    return SP.zero_rows(blocks, rows, 1.0)


# sums, adjacency, sparse matrices


@query
def scatter_add_(m):
    g = packed(m, ["ux", "p"])
    return scatter_add(corner_rows(g, {"ux": [f"ux{a}" for a in range(4)], "p": [f"p{a}" for a in range(4)]}), ["ux", "p"], c("elem_id") % 2 == 0)


@query
def elem_sum(m):
    return element_sum(m.incidence, m.nodes, "z", 0.5)


@query
def node_degree(m):
    return AD.node_degree(m.incidence)


@query
def v2e(m):
    return AD.v2e(m.incidence)


@query
def v2e_segments(m):
    return AD.v2e_segments(m.incidence, 16)


@query
def node_degree_mixed(m):
    return AD.node_degree(incidence_of(mixed_elements(m)))


@query
def v2e_mixed(m):
    return AD.v2e(incidence_of(mixed_elements(m)))


@query
def nodal_graph(m):
    return AD.nodal_graph(m.elements)


@query
def row_lengths(m):
    return AD.row_lengths(m.pattern)


@query
def row_ptr(m):
    return AD.row_ptr(m.pattern, m.nodes.select(c("node_id").alias("row")))


@query
def csr_slots(m):
    return AD.csr_slots(m.pattern)


@query
def csr_expand(m):
    return AD.csr_expand(AD.csr_slots(m.pattern), AD.row_ptr(m.pattern, m.nodes.select(c("node_id").alias("row"))), 2, 3)


@query
def nz_index(m):
    pairs = m.nodes.select(c("node_id").alias("row"), F.explode(F.array(c("node_id"), c("node_id") + 1, c("node_id") + 7)).alias("col"))
    return SP.nz_index(AD.csr_slots(m.pattern), pairs)


def entries(m):
    """Positions inside and outside the pattern, some twice."""
    return m.nodes.select(c("node_id").alias("row"), F.explode(F.array(c("node_id"), c("node_id"), c("node_id") + 1, c("node_id") + 2)).alias("col")).withColumn("val", (c("row") % 7 + c("col") % 3).cast("double"))


@query
def set_values_coo(m):
    return SP.set_values_coo(m.coo, entries(m), 2.0, 3.0)


@query
def add_values(m):
    return SP.add_values(m.coo, entries(m))


@query
def zero_rows(m):
    return SP.zero_rows(m.coo, m.nodes.where("node_id % 3 = 0").select(c("node_id").alias("row")), 5.0, shift=1)


@query
def zero_values(m):
    return SP.zero_values(m.coo)


@query
def assemble_coo(m):
    return AS.assemble_coo(AS.element_pairs(G.determinant(G.jacobian(packed(m))), lambda a, b: c("detj") * (2.0 if a == b else 1.0)))


def wide_blocks(m, local: bool = False):
    p = AS.localized(packed(m), BOX) if local else packed(m)
    g = G.determinant(G.jacobian(p))
    pairs = AS.element_pairs(g, lambda a, b: c("detj") + a - 2 * b)
    return pairs.select("row", "col", *[(c("val") * k).alias(n) for n, k in (("v00", 1), ("v01", 2), ("v11", 3), ("v03", 4), ("v33", 5), ("v44", 6))])


@query
def assemble_blocks(m):
    return AS.assemble_blocks(wide_blocks(m), [("u", "u"), ("u", "p"), ("p", "p")])


@query
def assemble_blocks_local(m):
    """The same with elements dealt along the space-filling curve before they are summed."""
    return AS.assemble_blocks(wide_blocks(m, local=True), [("u", "u"), ("u", "p"), ("p", "p")])


@query
def spmv_repeated(m):
    """A (A x) with the matrix stored for products."""
    a = SP.product_storage(m.coo)
    return SP.spmv(a, SP.spmv(a, m.vec))


@query
def spmv(m):
    y = m.nodes.select(c("node_id").alias("idx"), c("y").alias("val"))
    return SP.spmv(m.coo, m.vec, 2.0, y, -1.0)


@query
def spmv_masked(m):
    y = m.nodes.select(c("node_id").alias("idx"), c("y").alias("val"))
    left, right = (m.nodes.select(c("node_id").alias("idx"), (c("node_id") % k != 0).cast("double").alias("val")) for k in (3, 4))
    return SP.spmv_masked(m.coo, m.vec, y, left, right, 2.0, -1.0)


@query
def spmv_blocks(m):
    kinds = [("u", "u", 1.0), ("u", "p", 2.0), ("p", "u", -1.0)]
    a = m.coo.select(F.explode(F.array(*[F.struct(F.lit(i).alias("bi"), F.lit(j).alias("bj"), "row", "col", (c("val") * k).alias("val")) for i, j, k in kinds])).alias("e")).select("e.*")
    x = m.vec.select(F.explode(F.array(F.lit("u"), F.lit("p"))).alias("field"), "idx", "val")
    return SP.spmv_blocks(a, x, x, 1.0, 0.5)


@query
def get_diag(m):
    return SP.get_diag(m.coo, m.nodes.select(c("node_id").alias("row")))


@query
def get_diag_blocks(m):
    return SP.get_diag_blocks(m.coo, 3)


@query
def jacobi_apply(m):
    return rounded(SP.jacobi_apply(m.coo, m.vec))


@query
def block_jacobi_apply(m):
    return rounded(SP.block_jacobi_apply(m.coo, m.vec, 3))


@query
def block_jacobi_general(m):
    return rounded(SP.block_jacobi_apply(m.coo, m.vec, 4))


@query
def pc_apply(m):
    x = m.vec.select(F.explode(F.array(*map(F.lit, ("u", "p", "phi", "temp")))).alias("field"), "idx", "val")
    return rounded(SP.pc_apply(m.coo, m.coo, x))


# geometry


@query
def elem_jacobian(m):
    return G.jacobian(packed(m)).select("elem_id", *[f"j{i}{k}" for i in range(3) for k in range(3)])


@query
def elem_det(m):
    return G.determinant(G.jacobian(packed(m))).select("elem_id", "det", "detj", F.round("volume", 6).alias("volume"))


@query
def elem_inverse(m):
    return rounded(G.inverse(G.determinant(G.jacobian(packed(m)))).select("elem_id", *[f"v{k}{i}" for k in range(3) for i in range(3)]))


@query
def shape_grad(m):
    return rounded(geo(m).select("elem_id", *[f"g{a}{i}" for a in range(4) for i in range(3)]))


@query
def elem_metric(m):
    return rounded(geo(m).select("elem_id", *[f"m{i}{j}" for i in range(3) for j in range(3)]))


@query
def facet_normals(m):
    return rounded(G.facet_normals(facet_geo(m)).select("facet_id", "nx", "ny", "nz"), 4)


@query
def facet_scale(m):
    return rounded(G.facet_scale(G.facet_normals(facet_geo(m)), MU).select("facet_id", "hinv", "taub"), 4)


# fields


@query
def field_gradient(m):
    return rounded(FV.gradient(geo(m, FIELDS), list(FIELDS)).select("elem_id", *[f"{f}_d{j}" for f in FIELDS for j in range(3)]))


@query
def quad_values(m):
    return rounded(FV.quad_values(packed(m, ["ux", "p"]), ["ux", "p"]).select("elem_id", *[f"{f}_q{q}" for f in ("ux", "p") for q in range(4)]))


@query
def facet_quad_values(m):
    return rounded(FV.facet_quad_values(facet_geo(m, ["ux", "p"]), ["ux", "p"]).select("facet_id", *[f"{f}_f{q}" for f in ("ux", "p") for q in range(3)]))


def flow(m, columns=(*FIELDS, *RATES[:3])):
    """Gradients and point values of the flow, with divergence."""
    g = FV.gradient(geo(m, list(columns)), list(FIELDS))
    return FV.divergence(FV.quad_values(g, [*FV.U, *FV.DU]))


def every_point(f, m, columns):
    """The columns of f(flow, q) at the four points, named by column and point."""
    g = flow(m)
    for q in range(4):
        g = f(g, q).withColumnsRenamed({x: f"{x}_q{q}" for x in columns})
    return g.select("elem_id", *[f"{x}_q{q}" for x in columns for q in range(4)])


@query
def divergence(m):
    return rounded(flow(m).select("elem_id", "div_u"))


@query
def conv_shape(m):
    return rounded(every_point(FV.conv_shape, m, ["conv0", "conv1", "conv2", "conv3"]))


@query
def strong_residual(m):
    return rounded(every_point(FV.strong_residual, m, ["rl0", "rl1", "rl2"]), 3)


@query
def stab_tau(m):
    return rounded(every_point(FV.stab_tau, m, ["tau_m", "tau_c", "tau_phi", "tau_t"]))


@query
def field_integral(m):
    g = FV.quad_values(G.determinant(G.jacobian(packed(m, ["p"]))), ["p"])
    return g.agg(decimal_sum(FV.integral(g, "p")).alias("integral"), F.count(F.lit(1)).alias("n_elems"))


# assembly of the heat equation, norms


def heat(m):
    g = FV.gradient(geo(m, ["temp", "dtemp"]), ["temp"])
    return FV.quad_values(g, ["dtemp"])


@query
def heat_residual(m):
    rows = corner_rows(FV.heat_residual(heat(m)), {"f": [f"fh{a}" for a in range(4)]})
    return rows.groupBy("node_id").agg(decimal_sum(c("f")).alias("f"))


@query
def heat_matrix(m):
    h = FV.heat_matrix(heat(m), F1, F2)
    return AS.element_pairs(h, lambda a, b: c(f"jh{a}{b}")).groupBy("row", "col").agg(decimal_sum(c("val")).alias("val"))


@query
def field_norms(m):
    return rounded(AS.converged(AS.field_norms(m.fields), AS.field_norms(m.fields.withColumns({f: c(f) * 4000 for f in ("ux", "uy", "uz", "p")}))), 4)


# stages


def staged(m):
    """The state with old values that differ from the new ones."""
    return m.fields.withColumns({f"{f}_old": c(f) + 1 for f in FIELDS} | {f"{r}_old": c(r) - 2 for r in RATES})


@query
def alpha_stage(m):
    return rounded(ST.alpha_stage(staged(m)).select("node_id", *[f"{f}_a" for f in FIELDS], *[f"{r}_a" for r in RATES]))


@query
def predictor(m):
    return rounded(ST.predictor(m.fields).select("node_id", *RATES))


@query
def corrector(m):
    return rounded(ST.corrector(staged(m)).select("node_id", *FIELDS, *[f"{r}_old" for r in RATES]))


@query
def rate_update(m):
    return ST.rate_update(m.fields, m.nodes.select("node_id", *[(c("y") * (k + 1)).alias(r) for k, r in enumerate(RATES)]), list(RATES))


# graph


def colored(m, max_colors: int = 256):
    """Nodes of an order come from everywhere, so no parts of this mesh are compact."""
    m.store("incidence", "priority")
    return GR.color_elements(m.incidence, m.priority, max_colors)


@query
def color_elements(m):
    return colored(m)


@query
def color_stats(m):
    return GR.color_stats(colored(m))


@query
def color_batches(m):
    return GR.color_batches(colored(m))


def centroids(m):
    p = packed(m)
    return p.select("elem_id", *[(G.total([c(f"{x}{a}") for a in range(4)]) / 4).alias(x) for x in XYZ])


@query
def partition_elements(m):
    return GR.partition_elements(centroids(m), 8, BOX)


@query
def partition_quality(m):
    return GR.partition_quality(GR.partition_elements(centroids(m), 8, BOX), m.incidence)


def refined(m):
    m.store("incidence")
    return GR.refine_partition(GR.partition_elements(centroids(m), 8, BOX), m.incidence, rounds=2)


@query
def partition_refined(m):
    return refined(m)


@query
def refined_quality(m):
    return GR.partition_quality(refined(m), m.incidence)


def flagship(spark, folder: str) -> DataFrame:
    """Field-split block matrix of the order mesh: gathered geometry, element pairs, summed blocks."""
    return QUERIES["assemble_blocks"](spark, folder)
