import collections
import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshframe.llm import exact_dedup as X
from meshframe.llm.components import connected_components
from meshframe.llm.line_dedup import line_dedup
from meshframe.llm.near_dedup import near_dedup
from meshframe.llm.simhash import _links, near_links, simhash_dedup

WHITE = b" \t\n\x0b\x0c\r"


def words_shingled(text, w):
    t = (text or "").encode().lower().split()
    return [b" ".join(t[i : i + w]) for i in range(max(1, len(t) - w + 1))] if t else []


def slow_fingerprint(text, w=3):
    from xxhash import xxh64_intdigest

    s = words_shingled(text, w)
    h = [xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def grouped(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 50_000])
def test_binary_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
    f = X.build_filter(keys)
    assert X.may_contain(keys, *f).all()
    others = rng.integers(1 << 63, 1 << 64, 100_000, np.uint64, endpoint=False)
    assert X.may_contain(others, *f).mean() < 0.001
    assert n < 1000 or len(f[3]) < 1.35 * n


def test_exact_dedup(spark, sample):
    docs = [(r["doc_id"], r["text"]) for r in sample.collect()]
    groups = collections.defaultdict(list)
    for d, t in docs:
        groups[t.encode().translate(None, WHITE)].append((-len(t), d))
    want = {d: (min(g)[1], len(g), hashlib.sha256(k).hexdigest()) for k, g in groups.items() for _, d in g}
    for incoming in (None, F.lit(True), F.lit(False), F.col("doc_id") > 50):
        got = X.exact_dedup(sample, incoming=incoming).collect()
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == want
        assert sum(r["kept"] for r in got) == len(groups)


def test_exact_dedup_of_odd_rows(odd, nothing):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in X.exact_dedup(odd).collect()}
    assert {(1, 8, 3, False), (2, 8, 3, False), (8, 8, 3, True)} <= got  # the longest original stays
    assert {(3, 5, 3, False), (4, 5, 3, False), (5, 5, 3, True), (None, None, 1, True), (9, 9, 2, True)} <= got
    assert X.exact_dedup(nothing).count() == 0


def test_exact_dedup_joins_null_ids_across_batches(spark):
    docs = spark.createDataFrame([(None, "same  text", True), (1, "same text", False), (2, "other", True)], "doc_id long, text string, fresh boolean")
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["screened"]) for r in X.exact_dedup(docs, incoming=F.col("fresh")).collect()}
    assert got == {(None, None, 2, True), (1, None, 2, True), (2, 2, 1, False)}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    want = grouped(461, links)
    assert all(got.get(k, k) == want[k] for k in range(461))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_near_links_equal_all_pairs(spark, bits):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for b in base for _ in range(12)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = connected_components(near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits)).collect()
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= bits]
    of = {f: k for k, f in enumerate(signed)}
    mine = grouped(len(fps), [(of[r["node"]], of[r["root"]]) for r in got])
    assert mine == grouped(len(fps), links)


def test_large_lists_are_marked_and_small_ones_paired():
    from meshframe.llm.simhash import FEW, small_pairs

    rng, rows = random.Random(4), []
    for key, n in enumerate([1, 3, FEW, FEW + 1, 2, 40, FEW - 1, 100, 1]):
        rows += [(key % 3, key, 1000 * key + i) for i in range(n)]
    rows.sort()
    want_pairs = {(x[2], y[2]) for x in rows for y in rows if x[:2] == y[:2] and x[2] < y[2] and sum(r[:2] == x[:2] for r in rows) <= FEW}
    want_marked = {x[2] for x in rows if sum(r[:2] == x[:2] for r in rows) > FEW}
    for cuts in ([], [5], [10, 11, 12, 60], sorted(rng.sample(range(len(rows)), 30))):  # wherever batches end
        edges = [0, *cuts, len(rows)]
        batches = [pd.DataFrame(rows[a:b], columns=["list", "bytes", "fp"]).astype("int64") for a, b in zip(edges, edges[1:])]
        got = pd.concat(list(small_pairs(iter(batches))))
        pairs = got[got["b"].notna()]
        assert sorted(zip(pairs["a"], pairs["b"])) == sorted(want_pairs) and set(got[got["b"].isna()]["a"]) == want_marked


def test_clusters_of_any_size_keep_all_links(spark):
    from meshframe.llm.simhash import fine_links

    rng = random.Random(6)
    fps = set()
    for size in (3, 9, 30, 400):  # members up to three bits around a centre, and chains of one or two bits
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(size)}
        for _ in range(size):
            centre ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 2)))
            fps.add(centre)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    of = {f: k for k, f in enumerate(signed)}
    for found in (near_links(df, 2), fine_links(df, 2)):
        got = connected_components(found).collect()
        assert grouped(len(fps), [(of[r["node"]], of[r["root"]]) for r in got]) == grouped(len(fps), links)


def test_large_lists_equal_pairs():
    rng = np.random.default_rng(3)
    free = np.arange(16)
    fp = np.sort(np.unique(rng.integers(0, 1 << 16, 400, np.uint64)))
    i, j = _links(fp, np.zeros(len(fp), int), free, 2)
    want = {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if int(fp[a] ^ fp[b]).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_simhash(spark, sample):
    docs = [(r["doc_id"], r["text"]) for r in sample.collect()]
    fps = [slow_fingerprint(t) for _, t in docs]
    root = grouped(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    first = {}
    for k, (d, _) in enumerate(docs):
        first[root[k]] = min(d, first.get(root[k], d))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_dedup(sample).collect()}
    assert got == {d: (f"{fps[k]:016x}", first[root[k]]) for k, (d, _) in enumerate(docs)}


def test_simhash_of_odd_rows(odd, nothing):
    got = {(r["doc_id"], r["component_id"]): r["fingerprint"] for r in simhash_dedup(odd).collect()}
    assert got[3, 3] == got[4, 3] == got[5, 3] == "0" * 16
    assert (1, 1) in got and (2, 1) in got and (8, 1) in got and (None, None) in got
    assert simhash_dedup(nothing).count() == 0


def slow_lines(docs, min_words=50):
    """Documents in order of id; windows of two lines, and long lines, that occurred before go."""
    seen, out = set(), {}
    for d, text in docs:
        lines = (text or "").split("\n")
        bare = [s.strip(" \t\x0b\x0c\r") for s in lines]
        full = [i for i, s in enumerate(bare) if s]
        runs = [((bare[a], bare[b]), (a, b)) for a, b in zip(full[:-1], full[1:])]
        runs += [((bare[a],), (a, a)) for a in full if len(bare[a].encode().split()) >= min_words]
        gone = set()
        for k, at in sorted(runs, key=lambda r: r[1]):
            if k in seen:
                gone |= set(at)
            seen.add(k)
        out[d] = (None if text is None else "\n".join(s for i, s in enumerate(lines) if i not in gone), len(gone))
    return out


def test_line_dedup(spark, sample):
    docs = sorted((r["doc_id"], r["text"]) for r in sample.collect())
    rng = random.Random(4)
    made = [(1000 + k, "\n".join(rng.choice(["a", "b", " b ", "c", "", "w " * 60, "d e"]) for _ in range(rng.randrange(12)))) for k in range(200)]
    both = docs + made + [(5000, None), (5001, ""), (5002, "\n\n")]
    got = line_dedup(spark.createDataFrame(both, "doc_id long, text string"))
    assert {r["doc_id"]: (r["text"], r["n_deleted"]) for r in got.collect()} == slow_lines(both)


def test_line_dedup_where_the_first_copy_of_a_line_stands_elsewhere(spark):
    rng = np.random.default_rng(3)
    pad = " " * 60
    rows = [(k, "\n".join(rng.choice([f"l{i}" for i in range(12)], rng.integers(0, 9)).tolist())) for k in range(200)]
    rows += [(300, "common\nalone"), (301, "a\ncommon\nb\nc\r"), (302, "a\t\n\n common\nb \nc"), (303, f"two{pad}words"), (304, f"two{pad}words"), (305, "\t".join(["w"] * 50)), (306, "x\n" + "\t".join(["w"] * 50))]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["text"], r["n_deleted"]) for r in got.collect()} == slow_lines(rows)


def test_line_dedup_of_odd_rows(odd, nothing):
    got = [(r["doc_id"], r["text"], r["n_deleted"]) for r in line_dedup(odd).select("doc_id", "text", "n_deleted").collect()]
    assert got.count((9, "a\nb\nc\nd", 3)) == 2 and (12, "x\ny\nz", 3) in got and (3, None, 0) in got and len(got) == 12
    assert line_dedup(odd).columns[:9] == odd.columns
    assert line_dedup(nothing).count() == 0


def test_line_dedup_has_no_python(odd):
    plan = line_dedup(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_near_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    docs, group = [], {}
    for g in range(40):
        base = [word() for _ in range(200)]
        for k in range(1 + 6 * (g % 3 == 0)):
            copy = list(base)
            if k:
                copy[rng.randrange(200)] = word()
            group[len(docs)] = g
            docs.append((len(docs), " ".join(copy)))
    got = [r["doc_id"] for r in near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted(group[d] for d in got) == list(range(40))
    assert all(d == min(k for k in group if group[k] == group[d]) for d in got)


def test_near_dedup_recall_at_the_threshold(spark):
    """Pairs of similarity 0.82 to 0.86: nine in ten at least are found; at 0.6 none."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs = []
    for k in range(150):
        base = [word() for _ in range(300)]
        near, far = base[:276] + [word() for _ in range(24)], base[:225] + [word() for _ in range(75)]
        docs += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(near)), (10 * k + 2, " ".join(far))]
    got = {r["doc_id"] for r in near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(10 * k + 1 not in got for k in range(150)) >= 135
    assert all(10 * k in got and 10 * k + 2 in got for k in range(150))


def test_near_dedup_of_odd_rows(odd, nothing):
    got = sorted((r["doc_id"] for r in near_dedup(odd).collect()), key=str)
    assert got == sorted([1, 3, 7, 9, 9, 10, 12, None], key=str)
    assert near_dedup(nothing).count() == 0


def of_one_template(rng, families, near, own=90, shared=420):
    """Pairs (10 k, 10 k + 1) of documents that all share a template; near: words of its own in the second of a pair."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    template = [word() for _ in range(shared)]
    for k in range(families):
        first = template + [word() for _ in range(own)]
        second = first[: len(first) - near] + [word() for _ in range(near)]
        yield 10 * k, " ".join(first)
        yield 10 * k + 1, " ".join(second)


def test_near_dedup_finds_pairs_among_pages_of_one_template(spark):
    """2,000 documents that resemble each other at 0.7, in pairs of 0.85: a page between must not part a pair."""
    docs = list(of_one_template(random.Random(12), 1000, 41))
    got = {r["doc_id"] for r in near_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert all(10 * k in got for k in range(1000))
    assert sum(10 * k + 1 not in got for k in range(1000)) >= 990


def test_near_dedup_decides_by_shingles(spark):
    """Pairs of similarity 0.81 to 0.82 go, those of 0.77 to 0.78 all stay."""
    docs = list(of_one_template(random.Random(13), 150, 51, 510, 0)) + [(10_000 + d, t) for d, t in of_one_template(random.Random(14), 150, 64, 510, 0)]
    sets = [set(words_shingled(t, 5)) for _, t in docs]
    likeness = [len(x & y) / len(x | y) for x, y in zip(sets[::2], sets[1::2])]
    assert all(0.81 < s < 0.82 for s in likeness[:150]) and all(0.77 < s < 0.78 for s in likeness[150:])
    got = {r["doc_id"] for r in near_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert sum(10 * k + 1 not in got for k in range(150)) >= 143
    assert all(10_000 + 10 * k + 1 in got for k in range(150))


def test_near_dedup_leaves_out_no_link(spark):
    """Pairs at the threshold itself (similarity 0.80 to 0.82) of 9 to 500 shingles: what stays equals the groups of all pairs."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs = []
    for n, other in ((9, 1), (18, 2), (27, 3), (45, 5), (90, 10), (180, 20), (500, 52)):
        for _ in range(60):
            base = [word() for _ in range(n + 4)]
            docs += [" ".join(base), " ".join(base[other:] + [word() for _ in range(other)])]
    sets = [set(words_shingled(t, 5)) for t in docs]
    assert all(0.8 <= len(x & y) / len(x | y) < 0.83 for x, y in zip(sets[::2], sets[1::2]))
    got = {r["doc_id"] for r in near_dedup(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)).collect()}
    assert got == set(range(0, len(docs), 2))


def test_near_dedup_links_what_resembles_one_member_only(spark):
    """Groups of 40 around a centre, and documents that resemble one or two of a group's members but not its first."""
    rng = random.Random(32)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs = []
    for _ in range(12):
        centre = [word() for _ in range(200)]
        chain = [centre]
        for _ in range(39):
            at = rng.randrange(180)
            chain.append(centre[:at] + [word() for _ in range(rng.randint(1, 9))] + centre[at + 9 :])
        for _ in range(10):  # each a step away from a member, then from the step before
            far = rng.choice(chain)
            at = rng.randrange(180)
            chain.append(far[:at] + [word() for _ in range(rng.randint(6, 16))] + far[at + 12 :])
        docs += [" ".join(c) for c in chain]
    rng.shuffle(docs)
    sets = [set(words_shingled(t, 5)) for t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    got = {r["doc_id"] for r in near_dedup(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)).collect()}
    assert got == set(grouped(len(docs), links))
