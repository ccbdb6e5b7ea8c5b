"""Sparse matrices as tables (row, col, val), or (bi, bj, row, col, val) for field-split ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored_in_buckets


def nz_index(pattern_slots: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (row, col) with the slot of that entry, null where there is none."""
    return pairs.join(pattern_slots.select("row", "col", "slot"), ["row", "col"], "left")


def set_values_coo(a: DataFrame, entries: DataFrame, alpha: float, beta: float) -> DataFrame:
    """alpha * a + beta * v at the listed positions; duplicates are summed first, positions outside a ignored."""
    v = entries.groupBy("row", "col").agg(F.sum("val").alias("__v"))
    return a.join(v, ["row", "col"], "left").select("row", "col", F.when(F.col("__v").isNotNull(), F.lit(alpha) * F.col("val") + F.lit(beta) * F.col("__v")).otherwise(F.col("val")).alias("val"))


def add_values(a: DataFrame, entries: DataFrame) -> DataFrame:
    """a plus the entries inside its pattern."""
    both = a.unionByName(entries.join(a.select("row", "col"), ["row", "col"], "left_semi"))
    return both.groupBy("row", "col").agg(F.sum("val").alias("val"))


def zero_rows(a: DataFrame, rows: DataFrame, diag: float, shift: int = 0) -> DataFrame:
    """a with the listed rows (moved by shift) zero but for diag on the diagonal; rows outside a are ignored.

    In a field-split matrix a row is zeroed in every block that holds it, the diagonal only in bi = bj."""
    hit = rows.select((F.col("row") + shift).alias("row")).distinct().withColumn("__hit", F.lit(True))
    on = F.col("row") == F.col("col")
    if "bi" in a.columns:
        on = on & (F.col("bi") == F.col("bj"))
    return a.join(hit, "row", "left").withColumn("val", F.when(F.col("__hit"), F.when(on, F.lit(float(diag))).otherwise(F.lit(0.0))).otherwise(F.col("val"))).select(a.columns)


def zero_values(a: DataFrame) -> DataFrame:
    return a.withColumn("val", F.lit(0.0))


def product_storage(a: DataFrame, n: int | None = None) -> DataFrame:
    """a stored in buckets by what products join on: col, or (bj, col) of a field-split matrix. Products with it, one or many, move
    only vectors and sums, never the matrix."""
    return stored_in_buckets(a, ["bj", "col"] if "bj" in a.columns else ["col"], n, what="matrix")


def spmv(a: DataFrame, x: DataFrame, alpha: float = 1.0, y: DataFrame | None = None, beta: float = 0.0) -> DataFrame:
    """alpha * a x + beta * y as (idx, val); on y's indices if y is given, else on the rows of a."""
    ax = a.join(x.select(F.col("idx").alias("col"), F.col("val").alias("__x")), "col").groupBy(F.col("row").alias("idx")).agg(F.sum(F.col("val") * F.col("__x")).alias("__ax"))
    if y is None:
        return ax.select("idx", (F.lit(alpha) * F.col("__ax")).alias("val"))
    return y.join(ax, "idx", "left").select("idx", (F.lit(alpha) * F.coalesce("__ax", F.lit(0.0)) + F.lit(beta) * F.col("val")).alias("val"))


def spmv_masked(a: DataFrame, x: DataFrame, y: DataFrame, left: DataFrame, right: DataFrame, alpha: float, beta: float) -> DataFrame:
    """left * (alpha * a (right * x) + beta * y); the masks are vectors, applied once."""
    masked = lambda v, m: v.join(m.select("idx", F.col("val").alias("__m")), "idx").select("idx", (F.col("val") * F.col("__m")).alias("val"))
    return masked(spmv(a, masked(x, right), alpha, y, beta), left)


def spmv_blocks(a: DataFrame, x: DataFrame, y: DataFrame, alpha: float, beta: float) -> DataFrame:
    """Field-split product: x and y are (field, idx, val); one join and one sum over all blocks."""
    ax = (
        a.join(x.select(F.col("field").alias("bj"), F.col("idx").alias("col"), F.col("val").alias("__x")), ["bj", "col"])
        .groupBy(F.col("bi").alias("field"), F.col("row").alias("idx"))
        .agg(F.sum(F.col("val") * F.col("__x")).alias("__ax"))
    )
    return y.join(ax, ["field", "idx"], "left").select("field", "idx", (F.lit(alpha) * F.coalesce("__ax", F.lit(0.0)) + F.lit(beta) * F.col("val")).alias("val"))


def get_diag(a: DataFrame, rows: DataFrame) -> DataFrame:
    """(idx, val) of the diagonal for every row of rows (row); missing entries are 0."""
    own = a.where(F.col("row") == F.col("col")).select("row", "val")
    return rows.join(own, "row", "left").select(F.col("row").alias("idx"), F.coalesce("val", F.lit(0.0)).alias("val"))


def get_diag_blocks(a: DataFrame, bs: int) -> DataFrame:
    """(block, m): the bs x bs blocks on the diagonal, row by row; missing entries are 0."""
    block, place = F.floor(F.col("row") / bs), (F.col("row") % bs) * bs + F.col("col") % bs
    own = a.where(block == F.floor(F.col("col") / bs)).select(block.cast("long").alias("block"), place.alias("k"), "val")
    return own.groupBy("block").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("val"))), F.lit(0.0)) for k in range(bs * bs)]).alias("m"))


def jacobi_apply(a: DataFrame, x: DataFrame) -> DataFrame:
    """x / diag(a); null where the diagonal is 0."""
    d = a.where(F.col("row") == F.col("col")).select(F.col("row").alias("idx"), F.col("val").alias("__d"))
    return x.join(d, "idx", "left").select("idx", F.try_divide("val", "__d").alias("val"))


def inverse3(m) -> tuple[list, object]:
    """Cofactor inverse of a 3 x 3 array column, row by row, and its determinant; det = 0 gives nulls."""
    e = [[m[3 * i + j] for j in range(3)] for i in range(3)]
    cof = lambda i, j: e[(j + 1) % 3][(i + 1) % 3] * e[(j + 2) % 3][(i + 2) % 3] - e[(j + 1) % 3][(i + 2) % 3] * e[(j + 2) % 3][(i + 1) % 3]
    det = e[0][0] * cof(0, 0) + e[0][1] * cof(1, 0) + e[0][2] * cof(2, 0)
    return [F.try_divide(cof(i, j), det) for i in range(3) for j in range(3)], det


def _let(value, use):
    """use(value), with value computed once a row."""
    return F.transform(F.array(value), use)[0]


def solve_block(m, v, bs: int):
    """y with m y = v for an array column m of bs * bs values, row by row: elimination with the largest pivot, by higher-order functions
    over the rows [m | v]. A singular block gives nulls."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(bs - 1)), lambda i: F.concat(F.slice(m, i * bs + 1, F.lit(bs)), F.array(F.get(v, i))))

    def eliminate(state, k):
        at = lambda r: F.get(r, k)
        best = F.array_max(F.transform(state, lambda r, i: F.when(i >= k, F.struct(F.abs(at(r)).alias("size"), (-i).alias("neg")))))["neg"]

        def step(p):
            return _let(F.struct(p.alias("p"), F.transform(F.get(state, p), lambda x: F.try_divide(x, at(F.get(state, p)))).alias("row")), spread)

        def spread(pivot):
            moved = lambda r, i: F.when(i == pivot["p"], F.get(state, k)).otherwise(r)  # the row that stood at k goes where the pivot was
            less = lambda r: F.transform(r, lambda x, j: x - at(r) * F.get(pivot["row"], j))
            return F.transform(state, lambda r, i: F.when(i == k, pivot["row"]).otherwise(_let(moved(r, i), less)))

        return _let(-best, step)

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(bs - 1)), rows, eliminate), lambda r: F.get(r, F.lit(bs)))


def block_jacobi_apply(a: DataFrame, x: DataFrame, bs: int = 3) -> DataFrame:
    """Inverse of each diagonal block times its part of x; a singular block gives nulls. 3 x 3 blocks by cofactors, others by
    elimination, all in column expressions."""
    block, place = F.floor(F.col("idx") / bs).cast("long"), F.col("idx") % bs
    parts = x.groupBy(block.alias("block")).agg(F.array(*[F.coalesce(F.sum(F.when(place == k, F.col("val"))), F.lit(0.0)) for k in range(bs)]).alias("v"))
    both = get_diag_blocks(a, bs).join(parts, "block")
    if bs == 3:
        inv, _ = inverse3(F.col("m"))
        y = F.array(*[reduce(lambda p, q: p + q, [inv[3 * i + j] * F.col("v")[j] for j in range(3)]) for i in range(3)])
    else:
        y = solve_block(F.col("m"), F.col("v"), bs)
    return both.select("block", F.posexplode(y).alias("k", "val")).select((F.col("block") * bs + F.col("k")).alias("idx"), "val")


def pc_apply(velocity: DataFrame, pressure: DataFrame, x: DataFrame) -> DataFrame:
    """Preconditioner by field section on x (field, idx, val): u by 3 x 3 block-Jacobi of velocity, p by
    Jacobi of pressure, phi and temp copied."""
    of = lambda f: x.where(F.col("field") == f).select("idx", "val")
    return (
        block_jacobi_apply(velocity, of("u")).select(F.lit("u").alias("field"), "idx", "val")
        .unionByName(jacobi_apply(pressure, of("p")).select(F.lit("p").alias("field"), "idx", "val"))
        .unionByName(x.where(F.col("field").isin("phi", "temp")).select("field", "idx", "val"))
    )
