import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.llm import periodic_runs as PR
from meshframe.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if w[q:] == w[: len(w) - q])


def brute_runs(w, least=6, times=4):
    """(start, length, period) of all runs, by comparing words q apart for every q."""
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q) and smallest_period(w[i : j + q]) == q:
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def query_rows(spark, folder):
    got = QUERIES["op12_periodic_runs"](spark, str(folder)).select(COLUMNS)
    return sorted(map(tuple, got.collect()), key=str)


def test_query_against_brute_force(spark, sample):
    got = query_rows(spark, "/root/testdata/sf0.001")
    assert got == sorted((brute_row(r["doc_id"], r["text"]) for r in sample.collect()), key=str)
    assert sum(r[1] > 0 for r in got) > 5


def test_runs_of_random_words(spark):
    rng, texts = random.Random(5), []
    for k in range(400):
        n = rng.randint(0, 120)
        w = [rng.choice("ab" if k % 2 else "abcd") for _ in range(n)]
        for _ in range(rng.randint(0, 3)):  # powers of short and of long blocks at any place
            block = [rng.choice("abcd") for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 40]))]
            at, times = rng.randint(0, len(w)), rng.randint(3, 9)
            w[at:at] = (block * times)[: len(block) * times - rng.randint(0, len(block) - 1)]
        texts.append(" ".join(w))
    texts += ["a " * 1000, "a b " * 700 + "c " + "a b " * 300, ("x " * 50 + "y ") * 40]
    got = PR.periodic_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        w = texts[r["id"]].split()
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == brute_runs(w), w
    twelve = PR.periodic_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), min_length=12, times=5).collect()
    assert all([(x["start"], x["length"], x["period"]) for x in r["runs"]] == brute_runs(texts[r["id"]].split(), 12, 5) for r in twelve)
    with pytest.raises(ValueError):
        PR.periodic_runs(spark.createDataFrame([(1, "a")], "doc_id long, text string"), times=3)


def test_runs_of_odd_rows(spark, odd, nothing, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert query_rows(spark, tmp_path) == sorted((brute_row(r["doc_id"], r["text"]) for r in odd.collect()), key=str)
    assert PR.periodic_runs(nothing).isEmpty()


def test_a_tile_is_made_only_where_a_block_recurs():
    codes = PR.mixed(np.array([*range(100), *(list(range(100, 116)) * 6), *range(300, 400)], np.int32))
    assert [PR.chains(codes, b) for b in (1, 2, 4, 8)] == [[]] * 4
    assert PR.chains(codes, 16) == [(112, 160)]
    assert PR.chains(np.zeros(100, np.uint64), 2) == [(0, 30), (32, 62), (64, 94), (96, 96)]
    assert PR.z_function(list("aabaab")) == [6, 1, 0, 3, 1, 0]


def test_long_periods_cost_tiles_in_proportion(spark):
    w = [f"w{i % 5000}" for i in range(30_000)]
    df = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    r = PR.periodic_runs(df).first()
    assert [tuple(x) for x in r["runs"]] == [(0, 5000, 30_000)]
    rows = df.select(F.lit(1).cast("long").alias("k1"), F.lit(2).cast("long").alias("k2"), F.col("doc_id").alias("id"), "text").mapInArrow(PR.words_and_tiles(6, 4), PR.ROW_DDL)
    assert rows.select(F.sum(F.size("codes"))).first()[0] < 2 * len(w)
