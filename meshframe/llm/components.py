"""Connected components of a table of links, by hooking and pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): for each node of edges (a, b) the smallest node it can reach.

    Each round every node hooks onto its smallest neighbour, chains are shortened by pointer
    jumping, and links are contracted to the roots, so the rest shrinks by a factor each round.
    Minima are taken with map-side combine, so a hub costs no more than its links."""
    links = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    for _ in range(max_rounds):
        if links.isEmpty():
            break
        both = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("x")).select("x.*")
        up = materialize(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")), "hooks")
        for _ in range(max_rounds):
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next")).where("root <> next")
            jumped = materialize(up.join(over, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "jumps")
            discard(up)
            up = jumped.select("node", "root")
            up.scratch_path = jumped.scratch_path
            if jumped.where("moved").isEmpty():
                break
        of = lambda c: up.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        fewer = materialize(links.join(of("a"), "a").join(of("b"), "b").where("a_root <> b_root").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "links")
        if roots is None:
            roots = up
        else:
            then = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            longer = materialize(roots.join(then, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
            discard(roots)
            discard(up)
            roots = longer
        discard(links)
        links = fewer
    else:
        raise RuntimeError(f"links are left after {max_rounds} rounds")
    return roots if roots is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
