"""DuckDB SQL with the same results as the mesh queries."""

from __future__ import annotations

from ..functions.fields import GW, QA, QB, SIXTH, TWO_THIRDS
from ..schema import ALPHA_F, ALPHA_M, CP, DT, F1, F2, FIELDS, GAMMA, KAPPA, MU, RATES, RHO
from ..sources.order_mesh import ctes

XYZ = ("x", "y", "z")
U, DU = ("ux", "uy", "uz"), ("dux", "duy", "duz")
ORACLE: dict[str, str] = {}


def sql(name: str, body: str, *views: str, more: str = "") -> None:
    """Register body under name with the views it needs and further CTEs."""
    head = ", ".join(x for x in (ctes(*views), more) if x)
    ORACLE[name] = f"with {head} {body}" if head else body


def plus(terms) -> str:
    return "(" + " + ".join(terms) + ")"


def corners(*columns: str, source: str = "nodes") -> str:
    """CTE packed: corner values of the columns for each element."""
    picks = ", ".join(f"max(case when local = {a} then {c} end) as {c}{a}" for c in ("node_id", *columns) for a in range(4)).replace("as node_id", "as n")
    return f"packed as (select elem_id, {picks} from incidence join {source} using (node_id) group by elem_id)"


STATE = "state as (select * from nodes join fields using (node_id))"
J = "jac as (select *, " + ", ".join(f"{x}{k + 1} - {x}0 as j{i}{k}" for i, x in enumerate(XYZ) for k in range(3)) + " from packed)"


def minor(i: int, k: int) -> str:
    a, b = [r for r in range(3) if r != i]
    p, q = [r for r in range(3) if r != k]
    return f"{'-' if (i + k) % 2 else ''}(j{a}{p} * j{b}{q} - j{a}{q} * j{b}{p})"


DET = f"dets as (select *, {plus(f'j0{k} * ({minor(0, k)})' for k in range(3))} as det from jac)"
INV = "invs as (select *, abs(det) as detj, " + ", ".join(f"({minor(i, k)}) / nullif(det, 0) as v{k}{i}" for k in range(3) for i in range(3)) + " from dets)"
GRAD0 = "grads0 as (select *, " + ", ".join(f"v{k}{i} as g{k + 1}{i}" for k in range(3) for i in range(3)) + " from invs where detj > 0)"
GRAD = "grads as (select *, " + ", ".join(f"-(g1{i} + g2{i} + g3{i}) as g0{i}" for i in range(3)) + " from grads0)"
GEO = "geo as (select *, " + ", ".join(f"{plus(f'g{i + 1}{k} * g{j + 1}{k}' for k in range(3))} as m{i}{j}" for i in range(3) for j in range(3)) + " from grads)"


def geo(*columns: str) -> str:
    """CTEs up to geo, with corner values of further nodal columns."""
    own = corners(*XYZ, *columns, source="state" if columns else "nodes")
    return ", ".join([*([STATE] if columns else []), own, J, DET, INV, GRAD0, GRAD, GEO])


def r(expr: str, name: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0 as {name}"


VOTES = """votes as (select facet_id, elem_id, count(*) as votes from facet_nodes f join incidence i using (node_id) group by 1, 2),
owner as (select facet_id, elem_id, votes from (select *, row_number() over (partition by facet_id order by votes desc, elem_id) as turn from votes) where turn = 1)"""
ORIENT = VOTES + """, oriented as (select f.facet_id, f.tag, o.elem_id, min(i.local) as orient from (select distinct facet_id, tag from facet_nodes) f join owner o using (facet_id) join incidence i using (elem_id)
  where not exists (select 1 from facet_nodes n where n.facet_id = f.facet_id and n.node_id = i.node_id) group by 1, 2, 3)"""
OFFSETS = "counts as (select tag, count(distinct facet_id) as n_facets from facet_nodes group by tag), offsets as (select tag, row_number() over (order by tag) - 1 as bound, n_facets, cast(coalesce(sum(n_facets) over (order by tag rows between unbounded preceding and 1 preceding), 0) as bigint) as start from counts)"
BOUND = "bound as (select distinct o.bound, f.node_id from facet_nodes f join offsets o using (tag))"
DOFS = "strong as (select distinct node_id, cast(comp as bigint) as comp, node_id * 3 + comp as dof from bound join bc using (bound) where bctype = 'STRONG')"
ALL_DOFS = "dofs as (select node_id * 3 + k as dof, case k when 0 then x when 1 then y else z end as val from nodes cross join (select unnest([0, 1, 2]) as k))"

# sources and sinks
# tetrahedra of the order mesh, prisms and hexahedra of consecutive parts
MIXED_SQL = """select row_number() over (order by kind, old) - 1 as elem_id, etype, nodes from (
  select 0 as kind, elem_id as old, 'tet' as etype, list(node_id order by local) as nodes from incidence group by elem_id
  union all select 1, p_partkey, 'prism', range(p_partkey, p_partkey + 6) from part where p_partkey % 6 = 0
  union all select 2, p_partkey, 'hex', range(p_partkey, p_partkey + 8) from part where p_partkey % 8 = 0)"""
sql("flatten", "select vec_id * 64 + k - 1 as pos, cast(embedding[k] as double) as val from (select *, unnest(range(1, 65)) as k from embeddings)")
sql("unflatten", "select vec_id * 8 + k as row_id, [cast(x as double) for x in embedding[k * 8 + 1 : k * 8 + 8]] as vals from (select *, unnest(range(0, 8)) as k from embeddings)")
sql("bound_expand", "select bound, start + k as pos from (select *, unnest(range(0, n_facets)) as k from offsets)", "facet_nodes", more=OFFSETS)
sql("snapshot_range", "select step, count(*) as n_nodes, sum(ux) as sum_ux from snapshots where step in (10, 30, 50) group by step", "snapshots")
sql("export_points", "select step, node_id, x, y, z, p, phi, temp, ux as u0, uy as u1, uz as u2 from snapshots join nodes using (node_id) where step between 0 and 50", "snapshots", "nodes")
sql("mesh_round_trip", MIXED_SQL, "incidence")
sql(
    "facets_round_trip",
    "select o.facet_id, o.tag, f.bound, (select list(n.node_id order by n.node_id) from facet_nodes n where n.facet_id = o.facet_id) as nodes, t.place as elem_id, o.orient from oriented o join offsets f using (tag) join (select elem_id, row_number() over (order by elem_id) - 1 as place from (select distinct elem_id from incidence)) t using (elem_id)",
    "facet_nodes", more=f"{ORIENT}, {OFFSETS}",
)
sql("bound_round_trip", "select * from bound", "facet_nodes", more=f"{OFFSETS}, {BOUND}")
MIXED_AT = f"mixed_at as (select elem_id, unnest(nodes) as node_id from ({MIXED_SQL}))"
sql("node_degree_mixed", "select node_id, count(*) as degree from mixed_at group by 1", "incidence", more=MIXED_AT)
sql("v2e_mixed", "select node_id, list_sort(list(distinct elem_id)) as elems from mixed_at group by 1", "incidence", more=MIXED_AT)
sql("mesh_counts", f"select 'nodes' as what, count(*) as n from part union all select etype, count(*) from ({MIXED_SQL}) group by 1", "incidence")
sql("table_sizes", "select 'nodes' as name, true as found, count(*) as n from part union all select 'elements', true, count(distinct elem_id) from incidence union all select 'facets', false, 0", "incidence")
sql("shape_checks", "select unnest(['mesh', 'no nodes', 'wrong corners', 'flat by 8', 'flat by 7', 'flat short by one']) as what, unnest([true, false, false, true, n % 7 = 0, (n - 1) % 8 = 0]) as ok from (select count(*) * 64 as n from embeddings)")
sql("snapshot_round_trip", "select * from snapshots where step = 20", "snapshots")
sql("stored_range", "select step, count(*) as n_nodes, sum(p) as sum_p from snapshots where step in (0, 20, 40) group by step", "snapshots")
sql("points_round_trip", "select step, node_id, x, y, z, p, phi, temp, ux as u0, uy as u1, uz as u2 from snapshots join nodes using (node_id) where step in (0, 30)", "snapshots", "nodes")
sql("vector_round_trip", "select idx, val from vec", "vec")
sql("particle_round_trip", "select node_id as pid, x + y + z as sum_coord, 2 * x as vel0, cast(1.0 as double) as mass, true as compatible, false as compatible_heavy from nodes", "nodes")
NORM_OF = ", ".join(f"round(sqrt(sum({e})), 4) as norm_{n}" for n, e in (("u", "ux * ux + uy * uy + uz * uz"), ("p", "p * p"), ("phi", "phi * phi"), ("temp", "temp * temp")))
sql("stream_norms", f"select step, {NORM_OF}, count(*) as n_nodes from snapshots group by step", "snapshots")
sql("nodal_graph_mixed", f"select distinct r as row, c as col from (select r, unnest(nodes) as c from (select nodes, unnest(nodes) as r from ({MIXED_SQL})))", "incidence")
sql("cells_by_type", "select case p_partkey % 5 when 0 then 'tet' when 1 then 'prism' when 2 then 'hex' when 3 then 'tri' else 'unknown line' end as ctype, count(*) as n from part group by 1")

# predicates, vectors
sql("count_value", "select count(*) filter (where val = 3) as n from vec", "vec")
sql("find_value", "select idx from vec where val = 3 order by idx", "vec")
sql("facet_color_mask", "select facet_id, cast(elem_id % 4 = 1 as int) as mask from owner", "facet_nodes", more=VOTES)
sql("bound_slice", "select * from bound where bound = 1", "facet_nodes", more=f"{OFFSETS}, {BOUND}")
sql("init_field", "select node_id, cast(1 as double) as ux, cast(0 as double) as uy, cast(0 as double) as uz, cast(0 as double) as p, x as phi, -x as temp from nodes", "nodes")
sql(
    "smooth_step",
    "select node_id, " + r("case when d > 0.75e-4 then 1.0e0 when d < -0.75e-4 then 0.0e0 else 0.5e0 * (1.0e0 + d / 0.75e-4 + sin(pi() * d / 0.75e-4) / pi()) end", "h") + " from (select node_id, 2e-4 - (z / 1e6 - 3e-4) as d from nodes)",
    "nodes",
)
sql("vec_scale", "select idx, -2.5e0 * val as val from vec", "vec")
sql("vec_fill", "select idx, 2.5e0 as val from vec", "vec")
sql("vec_axpby", "select idx, 2.0e0 * val + -3.0e0 * y as val from vec join nodes on idx = node_id", "vec", "nodes")
sql("vec_pointwise", f"select idx, {r('z * val', 'product')}, {r('z / nullif(val, 0)', 'quotient')}, {r('1 / nullif(val, 0)', 'inverse')} from vec join nodes on idx = node_id", "vec", "nodes")
IEEE = lambda a: f"case when val = 0 then (case when {a} = 0 then 'nan' when {a} > 0 then 'inf' else '-inf' end) else printf('%.3f', {a} / nullif(val, 0)) end"
sql("vec_pointwise_ieee", f"select idx, {IEEE('(z % 3)')} as quotient, {IEEE('1.0e0')} as inverse from vec join nodes on idx = node_id", "vec", "nodes")
sql("vec_mod", "select idx, val - 4.0e0 * floor(val / 4.0e0) as val from vec", "vec")
sql("vec_dot", "select sum(val * z) as dot from vec join nodes on idx = node_id", "vec", "nodes")
sql("vec_norm2", f"select {r('sqrt(sum(val * val))', 'norm')} from vec", "vec")
sql("array_at", "select elem_id as i, node_id as idx, val from incidence left join vec on idx = node_id where local = 0", "incidence", "vec")
sql("array_set_at", "select idx, cast(coalesce(w, val) as double) as val from vec left join (select node_id, max(elem_id) as w from incidence where local = 1 group by 1) on node_id = idx", "incidence", "vec")

# connectivity and boundaries
for name in ("gather", "gather_stored"):
    sql(name, "select * from packed", "incidence", "nodes", more=corners(*XYZ))
sql("lumped_mass", "select node_id, sum(abs(det)) / 24 as mass from dets join incidence using (elem_id) group by node_id", "incidence", "nodes", more=f"{corners(*XYZ)}, {J}, {DET}")
sql("facet_to_elem", "select * from owner", "facet_nodes", more=VOTES)
sql("facet_orient", "select * from oriented", "facet_nodes", more=ORIENT)
sql("facet_offsets", "select * from offsets", "facet_nodes", more=OFFSETS)
sql("facet_sorted", "select tag, facet_id, row_number() over (order by tag, facet_id) - 1 as pos from (select distinct tag, facet_id from facet_nodes)", "facet_nodes")
sql("bound_nodes", "select * from bound", "facet_nodes", more=f"{OFFSETS}, {BOUND}")
sql("bc_dofs", "select * from strong", "facet_nodes", "bc", more=f"{OFFSETS}, {BOUND}, {DOFS}")
sql("free_dofs", "select dof from dofs where dof not in (select dof from strong)", "facet_nodes", "bc", "nodes", more=f"{OFFSETS}, {BOUND}, {DOFS}, {ALL_DOFS}")
sql("dirichlet_vec", "select dof, case when dof in (select dof from strong) then 0 else val end as val from dofs", "facet_nodes", "bc", "nodes", more=f"{OFFSETS}, {BOUND}, {DOFS}, {ALL_DOFS}")
sql(
    "dirichlet_values", "select dof, case when dof not in (select dof from strong) then val when (dof // 3) % 2 = 0 then dof * 0.5e0 else 0 end as val from dofs",
    "facet_nodes", "bc", "nodes", more=f"{OFFSETS}, {BOUND}, {DOFS}, {ALL_DOFS}",
)
sql("row_nodes", "select dof as row, dof // 3 as node_id, dof % 3 as comp from dofs", "nodes", more=ALL_DOFS)
sql(
    "dirichlet_mat",
    "select row, col, cast(case when row in (select dof from strong) then (case when row = col then 1 else 0 end) else val end as double) as val from (select row * 3 + k as row, col * 3 + k as col, val from coo cross join (select unnest([0, 1]) as k))",
    "facet_nodes", "bc", "coo", more=f"{OFFSETS}, {BOUND}, {DOFS}",
)

# sums, adjacency, sparse matrices
sql("scatter_add", "select node_id, sum(ux) as ux, sum(p) as p from incidence join fields using (node_id) where elem_id % 2 = 0 group by 1", "incidence", "fields")
sql("elem_sum", "select elem_id, 0.5e0 * sum(z) as total from incidence join nodes using (node_id) group by 1", "incidence", "nodes")
sql("node_degree", "select node_id, count(*) as degree from incidence group by 1", "incidence")
sql("v2e", "select node_id, list_sort(list(distinct elem_id)) as elems from incidence group by 1", "incidence")
sql(
    "v2e_segments",
    "select node_id, block - min(block) over (partition by node_id) as segment, elems from (select node_id, (place // 16) as block, list(elem_id order by elem_id) as elems from (select *, row_number() over (order by node_id, elem_id) - 1 as place from (select distinct node_id, elem_id from incidence)) group by 1, 2)",
    "incidence",
)
sql("nodal_graph", "select row, col from pattern", "pattern")
sql("row_lengths", "select row, count(*) as length from pattern group by row", "pattern")
LENGTHS = "lens as (select node_id as row, count(p.col) as length from nodes left join pattern p on p.row = node_id group by node_id), starts as (select row, length, cast(coalesce(sum(length) over (order by row rows between unbounded preceding and 1 preceding), 0) as bigint) as start from lens)"
SLOTS = "slots as (select row, col, row_number() over (partition by row order by col) - 1 as slot from pattern)"
sql("row_ptr", "select * from starts", "nodes", "pattern", more=LENGTHS)
sql("csr_slots", "select * from slots", "pattern", more=SLOTS)
sql(
    "csr_expand",
    "select s.row * 2 + j as row, col * 3 + k as col, start * 6 + j * 3 * length + slot * 3 + k as pos from slots s join starts using (row) cross join (select unnest([0, 1]) as j) cross join (select unnest([0, 1, 2]) as k)",
    "nodes", "pattern", more=f"{LENGTHS}, {SLOTS}",
)
sql("nz_index", "select p.row, p.col, slot from (select node_id as row, node_id + unnest([0, 1, 7]) as col from nodes) p left join slots s on s.row = p.row and s.col = p.col", "nodes", "pattern", more=SLOTS)
ENTRIES = "entries as (select row, col, cast(row % 7 + col % 3 as double) as val from (select node_id as row, node_id + unnest([0, 0, 1, 2]) as col from nodes)), summed as (select row, col, sum(val) as v from entries group by 1, 2)"
sql("set_values_coo", "select row, col, case when v is null then val else 2.0e0 * val + 3.0e0 * v end as val from coo left join summed using (row, col)", "coo", "nodes", more=ENTRIES)
sql("add_values", "select row, col, val + coalesce(v, 0) as val from coo left join summed using (row, col)", "coo", "nodes", more=ENTRIES)
sql("zero_rows", "select row, col, cast(case when row in (select node_id + 1 from nodes where node_id % 3 = 0) then (case when row = col then 5 else 0 end) else val end as double) as val from coo", "coo", "nodes")
sql("zero_values", "select row, col, cast(0 as double) as val from coo", "coo")
PAIR_DETS = f"{corners(*XYZ)}, {J}, {DET}, pairs as (select a.node_id as row, b.node_id as col, a.local as a, b.local as b, abs(det) as detj from incidence a join incidence b using (elem_id) join dets using (elem_id))"
sql("assemble_coo", "select row, col, sum(detj * case when row = col then 2.0e0 else 1.0e0 end) as val from pairs group by 1, 2", "incidence", "nodes", more=PAIR_DETS)
for name in ("assemble_blocks", "assemble_blocks_local"):
    sql(
        name,
        """select bi, bj, row * ri + i as row, col * ci + j as col, sum((detj + a - 2 * b) * k) as val from pairs cross join (values ('u', 'u', 3, 3, 0, 0, 1), ('u', 'u', 3, 3, 0, 1, 2), ('u', 'u', 3, 3, 1, 1, 3), ('u', 'p', 3, 1, 0, 0, 4), ('p', 'p', 1, 1, 0, 0, 5))
  as t(bi, bj, ri, ci, i, j, k) group by 1, 2, 3, 4""",
        "incidence", "nodes", more=PAIR_DETS,
    )
AX = "ax as (select row as idx, sum(coo.val * vec.val) as ax from coo join vec on vec.idx = col group by 1)"
sql("spmv", "select node_id as idx, 2.0e0 * coalesce(ax, 0) + -1.0e0 * y as val from nodes left join ax on idx = node_id", "coo", "vec", "nodes", more=AX)
sql("spmv_repeated", "select row as idx, sum(coo.val * ax) as val from coo join ax on ax.idx = col group by 1", "coo", "vec", more=AX)
sql(
    "spmv_masked",
    "select node_id as idx, (2.0e0 * coalesce(ax, 0) + -1.0e0 * y) * cast(node_id % 3 <> 0 as int) as val from nodes left join ax on idx = node_id", "coo", "vec", "nodes",
    more="ax as (select row as idx, sum(coo.val * vec.val) as ax from coo join vec on vec.idx = col and col % 4 <> 0 group by 1)",
)
sql(
    "spmv_blocks",
    "select f as field, vec.idx, coalesce(ax, 0) * case f when 'u' then 3.0e0 else -1.0e0 end + 0.5e0 * vec.val as val from vec cross join (select unnest(['u', 'p']) as f) left join ax using (idx)", "coo", "vec", more=AX,
)
sql("get_diag", "select node_id as idx, cast(coalesce(val, 0) as double) as val from nodes left join coo on row = node_id and col = node_id", "coo", "nodes")
DIAG3 = "diag3 as (select row // 3 as block, " + ", ".join(f"coalesce(sum(val) filter (where row % 3 = {i} and col % 3 = {j}), 0) as e{i}{j}" for i in range(3) for j in range(3)) + " from coo where row // 3 = col // 3 group by 1)"
sql("get_diag_blocks", "select block, [" + ", ".join(f"e{i}{j}" for i in range(3) for j in range(3)) + "] as m from diag3", "coo", more=DIAG3)
JACOBI = "select idx, " + r("vec.val / nullif(coo.val, 0)", "val") + " from vec left join coo on row = idx and col = idx"
sql("jacobi_apply", JACOBI, "coo", "vec")


def cof3(i: int, j: int) -> str:
    e = lambda a, b: f"e{a % 3}{b % 3}"
    return f"({e(j + 1, i + 1)} * {e(j + 2, i + 2)} - {e(j + 1, i + 2)} * {e(j + 2, i + 1)})"


DET3 = plus(f"e0{k} * {cof3(k, 0)}" for k in range(3))
PARTS = "parts as (select idx // 3 as block, " + ", ".join(f"coalesce(sum(val) filter (where idx % 3 = {k}), 0) as w{k}" for k in range(3)) + " from vec group by 1)"
SOLVED = f"solved as (select block, unnest([0, 1, 2]) as k, unnest([{', '.join(plus(f'{cof3(i, j)} / nullif({DET3}, 0) * w{j}' for j in range(3)) for i in range(3))}]) as val from diag3 join parts using (block))"
BLOCK3 = "select block * 3 + k as idx, " + r("val", "val") + " from solved"
sql("block_jacobi_apply", BLOCK3, "coo", "vec", more=f"{DIAG3}, {PARTS}, {SOLVED}")


def cofactor(rows: tuple, cols: tuple) -> str:
    """Determinant of a minor of the 4 x 4 block, along its first row."""
    if len(rows) == 1:
        return f"e{rows[0]}{cols[0]}"
    return plus(f"{'-' if k % 2 else ''}e{rows[0]}{c} * {cofactor(rows[1:], cols[:k] + cols[k + 1 :])}" for k, c in enumerate(cols))


FOUR = (0, 1, 2, 3)
DIAG4 = "diag4 as (select row // 4 as block, " + ", ".join(f"coalesce(sum(val) filter (where row % 4 = {i} and col % 4 = {j}), 0) as e{i}{j}" for i in FOUR for j in FOUR) + " from coo where row // 4 = col // 4 group by 1)"
PARTS4 = "parts4 as (select idx // 4 as block, " + ", ".join(f"coalesce(sum(val) filter (where idx % 4 = {k}), 0) as w{k}" for k in FOUR) + " from vec group by 1)"
OFF = lambda k: tuple(x for x in FOUR if x != k)
SOLVED4 = f"""solved4 as (select block, unnest([0, 1, 2, 3]) as k, unnest([{', '.join(plus(f"{'-' if (i + j) % 2 else ''}{cofactor(OFF(j), OFF(i))} / nullif({cofactor(FOUR, FOUR)}, 0) * w{j}" for j in FOUR) for i in FOUR)}]) as val from diag4 join parts4 using (block))"""
sql("block_jacobi_general", f"select block * 4 + k as idx, {r('val', 'val')} from solved4", "coo", "vec", more=f"{DIAG4}, {PARTS4}, {SOLVED4}")
sql("pc_apply", f"select 'u' as field, * from ({BLOCK3}) union all select 'p', * from ({JACOBI}) union all select f, idx, val from vec cross join (select unnest(['phi', 'temp']) as f)", "coo", "vec", more=f"{DIAG3}, {PARTS}, {SOLVED}")

# geometry
MESH = ("incidence", "nodes")
FLOW = ("incidence", "nodes", "fields")
sql("elem_jacobian", "select elem_id, " + ", ".join(f"j{i}{k}" for i in range(3) for k in range(3)) + " from jac", *MESH, more=f"{corners(*XYZ)}, {J}")
sql("elem_det", "select elem_id, det, abs(det) as detj, round(abs(det) / 6, 6) as volume from dets", *MESH, more=f"{corners(*XYZ)}, {J}, {DET}")
sql("elem_inverse", "select elem_id, " + ", ".join(r(f"v{k}{i}", f"v{k}{i}") for k in range(3) for i in range(3)) + " from invs", *MESH, more=f"{corners(*XYZ)}, {J}, {DET}, {INV}")
sql("shape_grad", "select elem_id, " + ", ".join(r(f"g{a}{i}", f"g{a}{i}") for a in range(4) for i in range(3)) + " from geo", *MESH, more=geo())
sql("elem_metric", "select elem_id, " + ", ".join(r(f"m{i}{j}", f"m{i}{j}") for i in range(3) for j in range(3)) + " from geo", *MESH, more=geo())


def on_orient(prefix: str, i: int) -> str:
    return "(case orient " + " ".join(f"when {a} then {prefix}{a}{i}" for a in range(4)) + " end)"


NORMALS = "normals as (select *, " + ", ".join(f"-detj * {on_orient('g', i)} as {n}" for i, n in enumerate(("nx", "ny", "nz"))) + " from oriented join geo using (elem_id))"
sql("facet_normals", "select facet_id, " + ", ".join(r(n, n, 4) for n in ("nx", "ny", "nz")) + " from normals", *MESH, "facet_nodes", more=f"{ORIENT}, {geo()}, {NORMALS}")
HINV = "sqrt" + plus("{0} * {0}".format(plus(f"v{k}{i} * {n}" for i, n in enumerate(("nx", "ny", "nz")))) for k in range(3))
sql("facet_scale", f"select facet_id, {r(HINV, 'hinv', 4)}, {r(f'{4 * MU!r} * {HINV}', 'taub', 4)} from normals", *MESH, "facet_nodes", more=f"{ORIENT}, {geo()}, {NORMALS}")


# fields
def grad(f: str, j: int) -> str:
    return plus(f"g{a}{j} * {f}{a}" for a in range(4))


def at(f: str, q: int) -> str:
    return plus(f"{QA if a == q else QB!r} * {f}{a}" for a in range(4))


def facet_weight(a: int, q: int) -> str:
    heavy = {o: sorted({0, 1, 2, 3} - {o})[q] for o in range(4)}
    return "(case orient " + " ".join(f"when {o} then {0.0 if a == o else TWO_THIRDS if a == heavy[o] else SIXTH!r}" for o in range(4)) + " end)::double"


sql("field_gradient", "select elem_id, " + ", ".join(r(grad(f, j), f"{f}_d{j}") for f in FIELDS for j in range(3)) + " from geo", *FLOW, more=geo(*FIELDS))
sql("quad_values", "select elem_id, " + ", ".join(r(at(f, q), f"{f}_q{q}") for f in ("ux", "p") for q in range(4)) + " from packed", *FLOW, more=f"{STATE}, {corners('ux', 'p', source='state')}")
sql(
    "facet_quad_values", "select facet_id, " + ", ".join(r(plus(f"{facet_weight(a, q)} * {f}{a}" for a in range(4)), f"{f}_f{q}") for f in ("ux", "p") for q in range(3)) + " from oriented join geo using (elem_id)",
    *FLOW, "facet_nodes", more=f"{ORIENT}, {geo('ux', 'p')}",
)
FLOW_COLUMNS = (*FIELDS, *DU)
sql("divergence", "select elem_id, " + r(plus(grad(u, i) for i, u in enumerate(U)), "div_u") + " from geo", *FLOW, more=geo(*FLOW_COLUMNS))
sql(
    "conv_shape", "select elem_id, " + ", ".join(r(plus(f"{at(u, q)} * g{a}{i}" for i, u in enumerate(U)), f"conv{a}_q{q}") for a in range(4) for q in range(4)) + " from geo", *FLOW, more=geo(*FLOW_COLUMNS)
)
sql(
    "strong_residual",
    "select elem_id, " + ", ".join(r(f"{RHO!r} * ({at(DU[i], q)} + {plus(f'{at(u, q)} * {grad(U[i], j)}' for j, u in enumerate(U))}) + {grad('p', i)}", f"rl{i}_q{q}", 3) for i in range(3) for q in range(4)) + " from geo",
    *FLOW, more=geo(*FLOW_COLUMNS),
)
S, GG = [plus(f"m{i}{j} * {at(U[i], q)} * {at(U[j], q)}" for i in range(3) for j in range(3)) for q in range(4)], plus(f"m{i}{j} * m{i}{j}" for i in range(3) for j in range(3))
T, NU, AL = repr(4 / (DT * DT)), MU / RHO, KAPPA / (RHO * CP)
TAUS = [
    f"{r(f'1 / (sqrt({T} + s{q} + {3 * NU * NU!r} * g) * {RHO!r})', f'tau_m_q{q}')}, {r(f'sqrt(s{q} + {3 * NU * NU!r} * g) / (m00 + m11 + m22)', f'tau_c_q{q}')}, {r(f'1 / sqrt({T} + s{q})', f'tau_phi_q{q}')}, {r(f'1 / (sqrt({T} + s{q} + {3 * AL * AL!r} * g) * {RHO * CP!r})', f'tau_t_q{q}')}"
    for q in range(4)
]
sql("stab_tau", f"select elem_id, {', '.join(TAUS)} from (select *, {', '.join(f'{x} as s{q}' for q, x in enumerate(S))}, {GG} as g from geo)", *FLOW, more=geo(*FLOW_COLUMNS))
sql(
    "field_integral", f"select cast(sum(cast({plus(f'{GW!r} * abs(det) * {at('p', q)}' for q in range(4))} as decimal(28, 6))) as double) as integral, count(*) as n_elems from dets",
    *FLOW, more=f"{STATE}, {corners(*XYZ, 'p', source='state')}, {J}, {DET}",
)


def heat_f(a: int) -> str:
    return plus(f"{GW!r} * detj * {at('dtemp', q)} * {QA if a == q else QB!r}" for q in range(4)) + f" + {1 / 6!r} * detj * {plus(f'{grad('temp', i)} * g{a}{i}' for i in range(3))}"


def heat_j(a: int, b: int) -> str:
    sh = lambda k, q: QA if k == q else QB
    return plus(f"{F1!r} * detj * {GW * sh(a, q) * sh(b, q)!r}" for q in range(4)) + f" + {F2 * (1 / 6)!r} * detj * {plus(f'g{a}{i} * g{b}{i}' for i in range(3))}"


DEC = "cast(sum(cast(v as decimal(28, 6))) as double)"
sql("heat_residual", f"select node_id, {DEC} as f from (select unnest([n0, n1, n2, n3]) as node_id, unnest([{', '.join(heat_f(a) for a in range(4))}]) as v from geo) group by 1", *FLOW, more=geo("temp", "dtemp"))
sql(
    "heat_matrix",
    f"select row, col, {DEC} as val from (select unnest([{', '.join(f'n{a}' for a in range(4) for _ in range(4))}]) as row, unnest([{', '.join(f'n{b}' for _ in range(4) for b in range(4))}]) as col, unnest([{', '.join(heat_j(a, b) for a in range(4) for b in range(4))}]) as v from geo) group by 1, 2",
    *FLOW, more=geo("temp", "dtemp"),
)
NORM = lambda cols, k="": "sqrt(sum(" + plus(f"({c}{k}) * ({c}{k})" for c in cols) + "))"
sql(
    "field_norms",
    f"select {r('u', 'norm_u', 4)}, {r('p', 'norm_p', 4)}, {r('phi', 'norm_phi', 4)}, {r('temp', 'norm_temp', 4)}, u < 0.5e-3 * (4000 * u + 1e-16) and p < 0.5e-3 * (4000 * p + 1e-16) and phi < 0.5e-3 * (phi + 1e-16) and temp < 0.5e-3 * (temp + 1e-16) as converged from (select {NORM(U)} as u, {NORM(['p'])} as p, {NORM(['phi'])} as phi, {NORM(['temp'])} as temp from fields)",
    "fields",
)

# stages
OLD = "staged as (select *, " + ", ".join([*(f"{f} + 1 as {f}_old" for f in FIELDS), *(f"{x} - 2 as {x}_old" for x in RATES)]) + " from fields)"
sql(
    "alpha_stage",
    "select node_id, "
    + ", ".join(r("cast(0 as double)" if f == "p" else f"{f}_old + {DT * ALPHA_F * (1 - GAMMA)!r} * d{f}_old + {DT * ALPHA_F * GAMMA!r} * d{f}", f"{f}_a") for f in FIELDS)
    + ", "
    + ", ".join(r("dp" if f == "p" else f"{1 - ALPHA_M!r} * d{f}_old + {ALPHA_M!r} * d{f}", f"d{f}_a") for f in FIELDS)
    + " from staged",
    "fields", more=OLD,
)
sql("predictor", "select node_id, " + ", ".join(r("dp" if f == "p" else f"{(GAMMA - 1) / GAMMA!r} * d{f}", f"d{f}") for f in FIELDS) + " from fields", "fields")
sql(
    "corrector",
    "select node_id, " + ", ".join(r("p" if f == "p" else f"{f} + {DT * (1 - GAMMA)!r} * d{f}_old + {DT * GAMMA!r} * d{f}", f) for f in FIELDS) + ", " + ", ".join(r(x, f"{x}_old") for x in RATES) + " from staged",
    "fields", more=OLD,
)
sql("rate_update", "select node_id, " + ", ".join(f"{x} - y * {k + 1} as {x}" for k, x in enumerate(RATES)) + " from fields join nodes using (node_id)", "fields", "nodes")

# graph
COLORS = """ranked as (select i.elem_id, i.node_id, prio * 100000000 + i.elem_id as rk from incidence i join priority using (elem_id)),
edges as (select distinct a.elem_id as lo, b.elem_id as hi from ranked a join ranked b using (node_id) where a.rk < b.rk),
depth as (select elem_id, 0 as d from priority where elem_id not in (select lo from edges) union select e.lo, d + 1 from depth join edges e on e.hi = depth.elem_id),
colors as (select elem_id, max(d) as color from depth group by 1)"""
ORACLE["color_elements"] = f"with recursive {ctes('incidence', 'priority')}, {COLORS} select elem_id, cast(color as int) as color from colors"
COLORED = f"with recursive {ctes('incidence', 'priority')}, {COLORS}"
ORACLE["color_stats"] = f"{COLORED} select cast(max(color) + 1 as int) as n_colors, max(color) >= 256 as uncolored from colors"
ORACLE["color_batches"] = f"{COLORED} select cast(color as int) as color, min(pos) over (partition by color) as start, pos, elem_id from (select elem_id, color, row_number() over (order by color, elem_id) - 1 as pos from colors)"
CELL = lambda x, hi: f"cast(least(greatest(floor(({plus(f'{x}{a}' for a in range(4))} / 4 - 0.0e0) / {hi / 64!r}), 0), 63) as bigint)"
CODES = "coded as (select elem_id, " + plus(f"(((c{k} >> {b}) & 1) << {3 * b + k})" for b in range(6) for k in range(3)) + f" as code from (select elem_id, {CELL('x', 101.0)} as c0, {CELL('y', 51.0)} as c1, {CELL('z', 1009.0)} as c2 from packed))"
PARTS_OF = "parted as (select elem_id, cast((row_number() over (order by code, elem_id) - 1) * 8 // count(*) over () as int) as part from coded)"
sql("partition_elements", "select * from parted", *MESH, more=f"{corners(*XYZ)}, {CODES}, {PARTS_OF}")
sql(
    "partition_quality",
    "select part, n_elems, count(*) as n_nodes, count(*) filter (where k > 1) as shared_nodes from (select part, node_id, count(*) over (partition by node_id) as k from (select distinct part, node_id from incidence join parted using (elem_id))) join (select part, count(*) as n_elems from parted group by 1) using (part) group by 1, 2",
    *MESH, more=f"{corners(*XYZ)}, {CODES}, {PARTS_OF}",
)


def refining(rounds: int) -> str:
    """CTEs parts0 .. parts{rounds}: rounds of moves along the rims of the parts."""
    out = ["parts0 as (select * from parted)"]
    shared = lambda k: f"(case when {k} > 1 then {k} else 0 end)"
    for r in range(rounds):
        after = f"k{r}.k - (case when own.n = 1 then 1 else 0 end) + (case when d.n is null then 1 else 0 end)"
        out.append(f"""at{r} as (select distinct elem_id, node_id, part from incidence join parts{r} using (elem_id)),
cnt{r} as (select node_id, part, count(*) as n from at{r} group by 1, 2), k{r} as (select node_id, count(*) as k from cnt{r} group by 1),
want{r} as (select distinct a.elem_id, a.part, c.part as dest from at{r} a join cnt{r} c using (node_id) where c.part <> a.part),
gain{r} as (select w.elem_id, w.part, w.dest, sum({shared(f'k{r}.k')} - {shared(f'({after})')}) as gain from want{r} w join at{r} a using (elem_id) join k{r} on k{r}.node_id = a.node_id
  join cnt{r} own on own.node_id = a.node_id and own.part = w.part left join cnt{r} d on d.node_id = a.node_id and d.part = w.dest group by 1, 2, 3),
best{r} as (select elem_id, part, dest, gain from (select *, row_number() over (partition by elem_id order by gain desc, dest) as turn from gain{r}) where turn = 1 and gain > 0),
won{r} as (select elem_id from (select elem_id, row_number() over (partition by a.node_id order by gain desc, elem_id) as turn from best{r} join at{r} a using (elem_id)) group by 1 having max(turn) = 1),
size{r} as (select part, count(*) as n, sum(count(*)) over () / count(*) over () as mean from parts{r} group by 1),
room{r} as (select part, greatest(floor(mean * {1 + 0.03!r}) - n, 0) as takes, greatest(n - ceil(mean * {1 - 0.03!r}), 0) as gives from size{r}),
into{r} as (select m.* from (select *, row_number() over (partition by dest order by gain desc, elem_id) as turn from best{r} join won{r} using (elem_id)) m join room{r} on room{r}.part = dest where turn <= takes),
outof{r} as (select m.elem_id, m.dest from (select elem_id, part, dest, row_number() over (partition by part order by gain desc, elem_id) as turn from into{r}) m join room{r} using (part) where turn <= gives),
parts{r + 1} as (select elem_id, coalesce(dest, part) as part from parts{r} left join outof{r} using (elem_id))""")
    return ", ".join(out)


REFINED = f"{corners(*XYZ)}, {CODES}, {PARTS_OF}, {refining(2)}"
sql("partition_refined", "select * from parts2", *MESH, more=REFINED)
sql(
    "refined_quality",
    "select part, n_elems, count(*) as n_nodes, count(*) filter (where k > 1) as shared_nodes from (select part, node_id, count(*) over (partition by node_id) as k from (select distinct part, node_id from incidence join parts2 using (elem_id))) join (select part, count(*) as n_elems from parts2 group by 1) using (part) group by 1, 2",
    *MESH, more=REFINED,
)
