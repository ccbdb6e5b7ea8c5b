"""SimHash near-dedup: byte-position inverted index with count filtering.

Two 64-bit fingerprints at most k bits apart agree in at least 8 - k of their 8 bytes. The index has a posting list for each set of 6 - k byte
positions and the bytes there, so such a pair meets in at least C(8 - k, 6 - k) lists (15 for k = 2), one of fewer equal bytes in fewer. The pairs of the
lists are tallied; those that reach this number are kept and verified by their differing bits; those of one or two equal bytes less are rejected by the
count alone.

Pairs are made in lists of at most FEW members. Where more meet, in copies of one template for instance, a list may be of any size; its members
are only marked, list by list as they stream past, and the marked fingerprints enter a finer index: a list for each set of 8 - k positions, whose members
differ in the k free bytes only, 65,536 at most for k = 2. There partners are looked up by flipping at most k of the free bits, so the work is linear
in the list, and of each list only a spanning star of every linked set leaves the task. A pair at most k bits apart has all its
lists among the small ones, and is tallied in full, or one among the large ones, and then both are marked: no link is lost. Equal
fingerprints are one member from the start.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; ties and
repeated rows share a fingerprint; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import connected_components

FEW = 8  # members of a list whose pairs are tallied
PAIRWISE = 64  # lists of the finer index up to this size are compared pair by pair
BLOCK = 1 << 16  # hashes whose bits are summed at once


def fingerprint(text: str | None, words: int) -> int:
    """64-bit SimHash of the text's word shingles, each hashed by XXH64 with seed 42."""
    from xxhash import xxh64_intdigest

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only [\x20\x09-\x0D] cut
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    begins = np.concatenate(([0], ends[:-1]))
    w = min(words, len(tokens))
    pairs = zip(begins[: len(tokens) - w + 1].tolist(), (ends[w - 1 :] - 1).tolist())
    h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in pairs], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[k : k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, fp): fp as a signed long with the fingerprint's bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"id": b["id"], "fp": fp.view(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, fp long")


def _flips(free: np.ndarray, k: int) -> np.ndarray:
    """All masks with 1 to k of the free bits."""
    bits = [1 << int(b) for b in free]
    return np.array([sum(c) for r in range(1, k + 1) for c in combinations(bits, r)], np.uint64)


def _links(fp: np.ndarray, group: np.ndarray, free: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of linked members of the same list; fp is sorted within each list."""
    cut = np.flatnonzero(np.diff(group)) + 1
    begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(fp)]))
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.repeat(end - begin <= PAIRWISE, end - begin)
    for d in range(1, PAIRWISE):
        i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:])) if d < len(fp) else []
        if not len(i):
            break
        found_i.append(i)
        found_j.append(i + d)
    for a, b in zip(begin[end - begin > PAIRWISE], end[end - begin > PAIRWISE]):
        own = fp[a:b]
        for flip in _flips(free, k):
            at = np.searchsorted(own, other := own ^ flip)
            hit = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == other) & (other > own)
            found_i.append(a + np.flatnonzero(hit))
            found_j.append(a + at[hit])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    near = np.bitwise_count(fp[i] ^ fp[j]) <= k
    return i[near], j[near]


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member that each of n can reach over the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def postings(distinct: DataFrame, positions: int) -> tuple[DataFrame, np.ndarray]:
    """(list, bytes, fp) for every set of so many byte positions, dealt and sorted by list; and the sets' masks."""
    masks = np.array([sum(0xFF << 8 * p for p in s) for s in combinations(range(8), positions)], np.uint64)
    each = F.array(*[F.struct(F.lit(k).cast("short").alias("list"), F.col("fp").bitwiseAND(F.lit(int(m.view(np.int64)))).alias("bytes")) for k, m in enumerate(masks)])
    return distinct.select("fp", F.explode(each).alias("x")).select("x.*", "fp").repartition("list", "bytes").sortWithinPartitions("list", "bytes"), masks


def small_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b): all pairs of every list with at most FEW members, and (a, null) for each member of a larger one.
    Lists come one after the other; of a list at most one batch is held."""
    rest, large = None, None  # the list that is open at a batch's end: its rows while they are few, else its key
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        kind, key, fp = (b[c].to_numpy() for c in ("list", "bytes", "fp"))
        if not len(b):
            continue
        begin = np.concatenate(([0], np.flatnonzero((kind[1:] != kind[:-1]) | (key[1:] != key[:-1])) + 1))
        size = np.diff(np.concatenate((begin, [len(b)])))
        big = size > FEW
        big[0] |= large == (kind[0], key[0])
        large = (kind[-1], key[-1]) if big[-1] else None
        last = len(b) if big[-1] else begin[-1]
        rest = None if big[-1] else b.iloc[last:]
        yield _marked_and_paired(fp[:last], np.repeat(np.arange(len(size)), size)[:last], np.repeat(big, size)[:last])
    if rest is not None:
        yield _marked_and_paired(rest["fp"].to_numpy(), np.zeros(len(rest), np.int64), np.zeros(len(rest), bool))


def _marked_and_paired(fp: np.ndarray, group: np.ndarray, big: np.ndarray) -> pd.DataFrame:
    marked = np.unique(fp[big])
    a, b = [marked], [np.full(len(marked), -1)]
    for d in range(1, FEW):
        i = np.flatnonzero((group[d:] == group[:-d]) & ~big[d:])
        a.append(np.minimum(fp[i], fp[i + d]))
        b.append(np.maximum(fp[i], fp[i + d]))
    out = pd.DataFrame({"a": np.concatenate(a), "b": pd.array(np.concatenate(b), "Int64")})
    out.loc[: len(marked) - 1, "b"] = pd.NA
    return out


def near_links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints (column fp) at most max_bits apart."""
    shared = 8 - max_bits
    dealt, _ = postings(distinct, shared - 2)
    met = materialize(dealt.mapInPandas(small_pairs, "a long, b long"), "byte-pairs")
    tallied = met.where("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("tally")).where(F.col("tally") >= comb(shared, shared - 2))
    close = tallied.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")
    marked = met.where("b is null").select(F.col("a").alias("fp")).distinct()
    return close.unionByName(fine_links(marked, max_bits)).distinct()


def fine_links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """The same from lists of 8 - max_bits positions alone."""
    dealt, masks = postings(distinct, 8 - max_bits)
    free = [np.array([b for b in range(64) if not int(m) >> b & 1]) for m in masks]

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            last = (b["list"].iat[-1], b["bytes"].iat[-1]) if len(b) else None
            if last is None:
                continue
            open_ = ((b["list"] == last[0]) & (b["bytes"] == last[1])).to_numpy()
            rest = b[open_]
            yield of(b[~open_])
        if rest is not None:
            yield of(rest)

    def of(b: pd.DataFrame) -> pd.DataFrame:
        kind, key, fp = b["list"].to_numpy(), b["bytes"].to_numpy(), b["fp"].to_numpy()
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.unique(kind):
            own = fp[kind == k].view(np.uint64)
            order = np.lexsort((own, key[kind == k]))
            own, keys = own[order], key[kind == k][order]
            group = np.cumsum(np.concatenate(([0], keys[1:] != keys[:-1])))
            i, j = _links(own, group, free[k], max_bits)
            root = _stars(len(own), i, j)
            moved = np.flatnonzero(root != np.arange(len(own)))
            out_a.append(own[moved].view(np.int64))
            out_b.append(own[root[moved]].view(np.int64))
        return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return dealt.mapInPandas(meet, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """One row for each row of docs: id, fingerprint (16 hex digits), component_id (the smallest id
    that links of at most max_bits differing bits reach, its own included), n_copies (rows in the component)."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0 to 2: with more the finer index has no bound for its lists")
    rows = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct-fp")
    roots = connected_components(near_links(distinct.select("fp"), max_bits))
    rooted = materialize(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    of_root = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("n_copies")), "components")
    named = materialize(rooted.join(of_root, "root").select("fp", "component_id", "n_copies"), "named-fp")
    for done in (distinct, rooted, of_root):
        discard(done)
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
