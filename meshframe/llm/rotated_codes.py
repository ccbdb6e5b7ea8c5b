"""Nearest neighbours by inner product from randomly rotated one-bit codes.

Index. Vectors are dealt to blocks by a hash. In a block they are taken less the block's mean, rotated by a random orthogonal matrix (the same for
all, from a seed), and only the signs of their components are kept, packed eight to a byte, with two scalars: the length of the
residual and the cosine between it and its code. From them the inner product with a query is estimated without bias: the
code's product with the rotated query, divided by that cosine. Its error for a residual and query of length 1 is, with the confidence that epsilon
deviations give, below epsilon * sqrt((1 - cos^2) / cos^2 / (d - 1)).

Search. Every block of queries meets every block of vectors. The vectors with the largest estimates are scored exactly; the k-th best of them is a
threshold that the k nearest of the block surely reach; every vector whose estimate plus error bound reaches it is reranked, that is scored
by the original vectors in double precision. There is no cap on how many are. The k best of each block are merged.

Equal vectors are one entry of the index with its smallest k + 1 ids: no answer can hold more of them, as ties go to smaller ids. So a group
of copies of any size costs one entry; ranks within the group are cut before the shuffle where Spark can.

A task holds one block of vectors and one block of queries at a time. The work is queries times vectors, dealt to tasks by pairs of a block of
vectors and a group of query blocks: a block of vectors is copied once for every GROUP query blocks, a block of queries once for every block of vectors.
Blocks grow with the table from LEAST_ROWS to MOST_ROWS vectors, which keeps these copies down.

Defined cases: vectors that are null, zero, hold null or non-finite components, or are not of the commonest length (the smaller of two) take no part, and
neither do rows with a null id; rows that repeat an id are one item, whose score is its best and which is never its own neighbour; a
query with fewer than k candidates gets all of them; ties go to the smaller id; an empty table, or no query, gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

LEAST_ROWS, MOST_ROWS, BLOCKS = 16_384, 131_072, 256  # vectors in a block: between these, a table's share in so many blocks
QUERIES_AT_ONCE, GROUP = 1_024, 64  # queries in a block, query blocks in a group
EPSILON, SEED = 1.9, 20
CHUNK = 128  # queries whose estimates are in memory at once
FIRST = 12  # times k entries are scored first, for a threshold


@lru_cache(2)
def rotation(d: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, uniformly distributed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the rows that take part."""
    single = rows.schema[vector_col].dataType.elementType.simpleString() == "float"
    vec = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    df = rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    df = df.where(F.forall("vec", number) & F.exists("vec", lambda x: x != 0))
    common = df.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return df.where(F.size("vec") == (common["d"] if common else 0))


def entries(df: DataFrame, k: int) -> DataFrame:
    """(h, vec, ids): each distinct vector once, with the k + 1 smallest ids that have it."""
    ranked = df.withColumn("h", F.xxhash64("vec")).withColumn("turn", F.dense_rank().over(W.partitionBy("h", "vec").orderBy("id"))).where(F.col("turn") <= k + 1)
    return ranked.groupBy("h", "vec").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def packed(x: np.ndarray) -> bytes:
    """Vectors in single precision if that holds them exactly, else in double."""
    single = x.astype(np.float32)
    return (single if (single == x).all() else x).tobytes()


def unpacked(raw: bytes, n: int, d: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * n * d else np.float64).astype(np.float64).reshape(n, d)


def encode(seed: int):
    """A block of vectors as one row of packed columns."""

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        x = np.array(b["vec"].tolist(), np.float64)
        mean = x.mean(axis=0)
        y = (x - mean) @ rotation(x.shape[1], seed)
        signs, length = y > 0, np.sqrt((y * y).sum(axis=1))
        with np.errstate(invalid="ignore", divide="ignore"):
            cosine = np.where(length > 0, np.abs(y).sum(axis=1) / (length * np.sqrt(y.shape[1])), 1.0)
        ids = b["ids"].tolist()
        return pd.DataFrame({
            "block": b["block"].iloc[:1], "d": x.shape[1], "mean": [mean.tobytes()], "codes": [np.packbits(signs, axis=1).tobytes()], "length": [length.tobytes()], "cosine": [cosine.tobytes()],
            "vectors": [packed(x)], "n_ids": [np.array([len(i) for i in ids], np.int32).tobytes()], "ids": [np.concatenate(ids).astype(np.int64).tobytes()],
        })

    return pack


INDEX = "block long, d int, mean binary, codes binary, length binary, cosine binary, vectors binary, n_ids binary, ids binary"


def build_index(rows: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int | None = None, seed: int = SEED) -> DataFrame:
    """The index of all rows, one row for each block, written to the shared folder."""
    df = entries(usable(rows, id_col, vector_col), k)
    n = rows.count()
    n_blocks = max(1, -(-n // (block_rows or min(MOST_ROWS, max(LEAST_ROWS, n // BLOCKS)))))
    dealt = df.select(F.pmod("h", F.lit(n_blocks)).alias("block"), "vec", "ids")
    return materialize(dealt.groupBy("block").applyInPandas(encode(seed), INDEX), "code-index")


def pack_queries(b: pd.DataFrame) -> pd.DataFrame:
    x = np.array(b["vec"].tolist(), np.float64)
    return pd.DataFrame({"part": b["part"].iloc[:1], "queries": [packed(x)], "query_ids": [b["id"].to_numpy(np.int64).tobytes()]})


def search_block(x: np.ndarray, parts: dict, q: np.ndarray, k: int, epsilon: float, seed: int) -> tuple:
    """(query, entry, score, number reranked) of the k best entries of a block for each query, and all that tie with the last."""
    n, d = x.shape
    signs = np.unpackbits(parts["codes"], axis=1, count=d).astype(np.float32) * 2 - 1
    scale = (parts["length"] / (parts["cosine"] * np.sqrt(d))).astype(np.float32)
    error = epsilon * parts["length"] * np.sqrt(np.maximum(0.0, 1 - parts["cosine"] ** 2) / max(1, d - 1)) / parts["cosine"]
    error = (error + 1e-5 * (parts["length"] + np.abs(parts["mean"]).sum())).astype(np.float32)  # and what single precision loses
    rotated, size, base = (q @ rotation(d, seed)).astype(np.float32), np.sqrt((q * q).sum(axis=1)), (q @ parts["mean"]).astype(np.float32)
    out, reranked, few = [], 0, min(n, FIRST * k)
    for at in range(0, len(q), CHUNK):
        estimates = (rotated[at : at + CHUNK] @ signs.T) * scale
        for r, estimate in enumerate(estimates, at):
            estimate += base[r]
            chosen = np.ones(n, bool)
            if n > few:
                first = np.argpartition(estimate, n - few)[n - few :]
                surely = np.partition(x[first] @ q[r], few - k)[few - k]  # k entries have this score or a larger one
                chosen = estimate + np.float32(size[r]) * error >= surely
                chosen[first] = True
            j = np.flatnonzero(chosen)
            score = x[j] @ q[r]
            if len(j) > k:
                near = score >= np.partition(score, len(j) - k)[len(j) - k] - 1e-9 * size[r] * np.abs(x[j]).max()
                reranked, j = reranked + len(j), j[near]
            else:
                reranked += len(j)
            score = (x[j] * q[r]).sum(axis=1)  # the same sum for equal vectors wherever they stand
            order = np.argsort(-score, kind="stable")
            order = order[score[order] >= score[order[min(k, len(order)) - 1]]]
            out.append((np.full(len(order), r), j[order], score[order]))
    return (*(np.concatenate(c) for c in zip(*out)), reranked)


def searcher(k: int, epsilon: float, seed: int):
    """Pairs of a block of vectors and a block of queries as rows (query_id, ids, score, reranked, pairs)."""

    def run(batches):
        for b in batches:
            for r in b.itertuples():
                counts_of = np.frombuffer(r.n_ids, np.int32)
                x = unpacked(r.vectors, len(counts_of), r.d)
                parts = {"codes": np.frombuffer(r.codes, np.uint8).reshape(len(x), -1), **{c: np.frombuffer(getattr(r, c)) for c in ("length", "cosine", "mean")}}
                query_ids = np.frombuffer(r.query_ids, np.int64)
                q = unpacked(r.queries, len(query_ids), r.d)
                i, j, score, reranked = search_block(x, parts, q, k + 1, epsilon, seed)
                ids = np.split(np.frombuffer(r.ids, np.int64), np.cumsum(counts_of)[:-1])
                counts = np.zeros(len(i), np.int64)
                counts[:1] = reranked
                yield pd.DataFrame({"query_id": query_ids[i], "ids": [ids[e] for e in j.tolist()], "score": score, "reranked": counts})

    return run


FOUND = "query_id long, ids array<long>, score double, reranked long"


def found_entries(index: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, epsilon: float, seed: int, at_once: int) -> DataFrame:
    """What the pairs of blocks give: the best entries of every block for every query."""
    shape = index.agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("n")).first()
    asked = usable(queries, id_col, vector_col).where(F.size("vec") == (shape["d"] or 0)).distinct()
    n_parts = max(1, -(-queries.count() // at_once))
    packed = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n_parts))).groupBy("part").applyInPandas(pack_queries, "part long, queries binary, query_ids binary")
    # a place for every pair of a block and a query block: the block's number and the group of the query block
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, n) - 1).cast("long")))
    left = index.withColumn("group", every(-(-n_parts // GROUP)))
    right = materialize(packed, "query-blocks").withColumn("group", F.floor(F.col("part") / GROUP)).withColumn("block", every(shape["n"])).drop("part")
    # merged: either side is far larger than its files, from which Spark would choose to send it through the driver
    return left.hint("merge").join(right, ["block", "group"]).mapInPandas(searcher(k, epsilon, seed), FOUND)


def nearest(index: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", epsilon: float = EPSILON, seed: int = SEED, at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query, from an index built for this k."""
    found = found_entries(index, queries, k, id_col, vector_col, epsilon, seed, at_once)
    pairs = found.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_nearest(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(build_index(rows, 20), rows.where("vec_id % 20 = 0"), 20)
