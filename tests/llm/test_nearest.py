import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.llm import rotated_codes as RC
from meshframe.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


def brute(vectors, queries, k):
    """{query: [(id, score)]}: the k largest inner products, ties to the smaller id."""
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], float)
    out = {}
    for q in queries:
        s = (x * np.array(vectors[q], float)).sum(axis=1)
        out[q] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
    return out


def as_dict(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert len(out.setdefault(r["query_id"], [])) + 1 == r["rank"]
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_query_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in rows.collect()}
    queries = [i for i in vectors if i % 20 == 0]
    got, want = as_dict(QUERIES["op13_nearest"](spark, "/root/testdata/sf0.1")), brute(vectors, queries, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) > 0.99
    for q in got:  # scores are those of the original vectors
        assert all(s == pytest.approx(float(np.dot(np.array(vectors[q], float), np.array(vectors[i], float))), rel=1e-12) for i, s in got[q])


def test_blocks_groups_and_few_bits(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 24)) + rng.standard_normal(24) * 2
    vectors = dict(enumerate(x.tolist()))
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    index = RC.build_index(df, 10, block_rows=400)
    assert index.count() == 8
    got = as_dict(RC.nearest(index, df.where("vec_id % 7 = 0"), 10, at_once=20))  # some 22 query blocks, in two groups
    assert recall(got, brute(vectors, [i for i in vectors if i % 7 == 0], 10)) > 0.99


def test_the_bound_spares_most_exact_products(spark):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((40, 64)) * 2
    x = centers[rng.integers(0, 40, 6000)] + rng.standard_normal((6000, 64)) * 0.5
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = RC.found_entries(RC.build_index(df, 20, block_rows=6000), df.where("vec_id % 20 = 0"), 20, "vec_id", "embedding", RC.EPSILON, RC.SEED, 1024)
    assert found.agg(F.sum("reranked")).first()[0] < 0.2 * 300 * 6000


def test_copies_ties_and_odd_rows(spark):
    one, two = [1.0, 2.0, 3.0], [3.0, 2.0, 1.0]
    rows = [(i, one) for i in range(60)] + [(100 + i, two) for i in range(3)]
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 0.0]), (203, [NAN, 1.0, 1.0]), (204, [INF, 1.0, 1.0]), (205, [1.0, 2.0]), (None, one), (7, one), (300, [0.5, 0.0, -0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id int, h int")
    got = as_dict(RC.nearest(RC.build_index(df, 20), df.where("vec_id % 20 = 0"), 20))
    assert set(got) == {0, 20, 40, 100, 300}
    for q in (0, 20, 40):
        assert got[q] == [(i, 14.0) for i in [i for i in range(60) if i != q][:20]]
    assert got[100][:2] == [(101, 14.0), (102, 14.0)] and got[100][2:] == [(i, 10.0) for i in range(18)]
    assert got[300][:3] == [(100, 1.5), (101, 1.5), (102, 1.5)]


def test_few_candidates_repeated_ids_and_nothing(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = make([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [0.0, 5.0]), (2, [0.0, 1.0]), (0, [0.0, 1.0])])
    got = as_dict(RC.nearest(RC.build_index(df, 20), df.where("vec_id = 0"), 20))
    assert got == {0: [(1, 5.0), (2, 1.0)]}
    none = make([])
    assert RC.nearest(RC.build_index(none, 20), none, 20).isEmpty() and RC.nearest(RC.build_index(df, 20), none, 20).isEmpty()


def test_blocks_are_never_sent_through_the_driver(spark):
    """The files of the query blocks are small at any number of blocks, what is joined is not."""
    x = np.random.default_rng(5).standard_normal((600, 8))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    found = RC.found_entries(RC.build_index(df, 5, block_rows=100), df.where("vec_id % 20 = 0"), 5, "vec_id", "embedding", RC.EPSILON, RC.SEED, 10)
    found.write.format("noop").mode("overwrite").save()
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_rotation_is_orthogonal():
    r = RC.rotation(48, 1)
    assert np.allclose(r @ r.T, np.eye(48)) and not np.allclose(r, RC.rotation(48, 2))
