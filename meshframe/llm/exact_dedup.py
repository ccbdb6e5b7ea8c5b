"""Exact dedup against an immutable snapshot, screened by static binary-fuse filters.

Rows are cut into an older snapshot and an incoming batch. The snapshot's distinct digests get
one binary-fuse filter for each shard (a hash range of bounded expected size); incoming digests
look themselves up in their shard's filter, and only positives are joined with the snapshot's
exact buckets, where the normalised bytes of the two representatives are compared. Copies within
a batch are grouped on their own by the whole SHA-256 digest, with map-side combine.

Defined cases: null text is the empty text; empty texts are equal to each other; a null id counts
as larger than any other; rows that repeat an id and text are one group and all rows with the id
that stays are marked kept; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

SHARD_KEYS = 1 << 17  # expected digests in a shard: its filter is built in one task
BROADCAST_IDS = 1 << 20  # at most so many ids (8 MB) are broadcast to fetch texts
WHITE = " \t\n\x0b\x0c\r"


def normalised(text):
    """The text without the characters [\\x20\\x09-\\x0D]; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


# --- binary fuse filter (Graf and Lemire, "Binary Fuse Filters", 2022), 16-bit fingerprints


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def slots(h: np.ndarray, seg_len: int, seg_count: int) -> np.ndarray:
    """The three slots of each key, in consecutive segments; shape (3, n)."""
    first = ((h >> np.uint64(32)) * np.uint64(seg_count * seg_len)) >> np.uint64(32)
    mask = np.uint64(seg_len - 1)
    second = (first + np.uint64(seg_len)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * seg_len)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def fingerprints(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint16)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """(seed, segment length, segment count, fingerprints) of distinct unsigned 64-bit keys."""
    n = len(keys)
    seg_len = 4 if n < 2 else min(1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25)), 1 << 18)
    room = int(n * (1.125 if n < 2 else max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n)))) + 2 * seg_len
    seg_count = max(1, -(-room // seg_len) - 2)
    for seed in range(1, 1000):
        h = mixed(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        at = slots(h, seg_len, seg_count)
        size = (seg_count + 2) * seg_len
        count = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)  # xor of the numbers of the keys that hit a slot
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(n))
        order: list[tuple[np.ndarray, np.ndarray]] = []
        single, left = np.flatnonzero(count == 1), n
        while len(single):
            key, pick = np.unique(owner[single], return_index=True)
            order.append((key, single[pick]))
            left -= len(key)
            hit = at[:, key]
            for row in hit:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, key)
            touched = np.unique(hit)
            single = touched[count[touched] == 1]
        if left == 0:
            table, prints = np.zeros(size, np.uint16), fingerprints(h)
            for key, slot in reversed(order):
                a = at[:, key]
                table[slot] = 0
                table[slot] = prints[key] ^ table[a[0]] ^ table[a[1]] ^ table[a[2]]
            return seed, seg_len, seg_count, table
    raise RuntimeError("no seed gives a filter; are the keys distinct?")


def may_contain(keys: np.ndarray, seed: int, seg_len: int, seg_count: int, table: np.ndarray) -> np.ndarray:
    h = mixed(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    a = slots(h, seg_len, seg_count)
    return fingerprints(h) == table[a[0]] ^ table[a[1]] ^ table[a[2]]


def _filters(snapshot: DataFrame) -> DataFrame:
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(pdf["key"].to_numpy(np.int64).view(np.uint64))
        seed, seg_len, seg_count, table = build_filter(keys)
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "seed": seed, "seg_len": seg_len, "seg_count": seg_count, "prints": [table.tobytes()]})

    return snapshot.select("shard", "key").groupBy("shard").applyInPandas(build, "shard long, seed long, seg_len long, seg_count long, prints binary")


def _screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """The incoming digests that the filter of their shard may contain."""

    def look(own: pd.DataFrame, flt: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(flt):
            return own[["digest"]].iloc[:0]
        f = flt.iloc[0]
        hit = may_contain(own["key"].to_numpy(np.int64).view(np.uint64), int(f["seed"]), int(f["seg_len"]), int(f["seg_count"]), np.frombuffer(f["prints"], np.uint16))
        return own.loc[hit, ["digest"]]

    return incoming.select("shard", "key", "digest").groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(look, "digest binary")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", incoming=None) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256, screened.

    Of equal normalised texts the row with the most code points in the original, then the smallest
    id stays. incoming: a boolean Column that tells the incoming batch from the snapshot (default: a
    hash of the id deals half of the rows to each). screened: the group spans both and passed the
    filter, the exact bucket and the byte check."""
    spark = docs.sparkSession
    text, incoming = F.col(text_col), F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)) == 1 if incoming is None else incoming
    rows = materialize(
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"), F.coalesce(incoming, F.lit(False)).alias("new")),
        "digests",
    )
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id")))
    groups = materialize(rows.groupBy("new", "digest").agg(best.alias("best"), F.count(F.lit(1)).alias("size")), "groups")
    shards = max(1, -(-groups.count() // SHARD_KEYS))
    keyed = groups.withColumn("key", F.xxhash64("digest")).withColumn("shard", F.pmod("key", F.lit(shards)))
    old, new = keyed.where(~F.col("new")), keyed.where("new")
    filters = materialize(_filters(old), "filters")
    positive = _screen(new, filters)
    # exact buckets: one row for each digest on either side
    pairs = materialize(
        positive.join(new.select("digest", F.col("best").alias("b"), F.col("size").alias("m")), "digest").join(old.select("digest", F.col("best").alias("a"), F.col("size").alias("n")), "digest"),
        "bucket-pairs",
    )
    wanted = pairs.select(F.explode(F.array("a.id", "b.id")).alias("want"), "digest").distinct()
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(wanted, F.col("id").eqNullSafe(F.col("want")))
        .select("id", "digest", normalised(F.col("text")).alias("body"))
        .where(F.unhex(F.sha2("body", 256)) == F.col("digest"))
        .dropDuplicates(["id", "digest"])
    )
    a = texts.select(F.col("id").alias("a_id"), F.col("digest").alias("a_digest"), F.col("body").alias("a_body"))
    b = texts.select(F.col("id").alias("b_id"), F.col("digest").alias("b_digest"), F.col("body").alias("b_body"))
    same = (
        pairs.join(a, (F.col("digest") == F.col("a_digest")) & F.col("a.id").eqNullSafe(F.col("a_id")))
        .join(b, (F.col("digest") == F.col("b_digest")) & F.col("b.id").eqNullSafe(F.col("b_id")))
        .where(F.col("a_body") == F.col("b_body"))
        .select("digest", F.least("a", "b").alias("both"), (F.col("m") + F.col("n")).alias("both_size"))
    )
    final = materialize(
        groups.join(same, "digest", "left").select("new", "digest", F.coalesce("both", "best").alias("best"), F.coalesce("both_size", "size").alias("size"), F.col("both").isNotNull().alias("screened")),
        "final-groups",
    )
    for done in (groups, filters, pairs):
        discard(done)
    keep = F.col("best.id")
    return rows.join(final, ["new", "digest"]).select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.col("size").cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "screened"
    )


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("screened")
