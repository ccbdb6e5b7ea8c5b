"""Periodic runs in the words of each text: stretches in which a block of q words is repeated, for every period q.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least max(min_length, times * q)
words long, that no neighbouring word extends keeping the period. min_length is above, and times at least, 4.

Work is tiled by scale. For the octave of periods from B to 2B - 1 (B = 1, 2, 4, ...) a document is cut at every B words; CUTS cuts make a tile,
which overlaps its neighbours by B words to the left and 4B to the right. A tile is solved without its neighbours: from a cut c in it, the
Z-function of the words from c on, and that of the words before it read backwards, say for every period of the octave how far the words repeat to the
right and left of the cut. Words q apart are equal over 3q places or more of a run, hence on the whole of [c, c + B) for a chain of cuts c from the
first to the last that fit. A tile is solved from the first cut of each chain in it: the first tile of the chain reaches back to
the run's start, the last on to its end, and those between meet. So tiles are made only where [c, c + B) recurs at one distance of the octave for as
many cuts in a row as lie in the shortest run of that period (two at least). These are found by a rolling hash of B words, which may let a
tile pass in vain but never misses one; and only periods for which [c, c + B) recurs leave a tile. A period whose block repeats a
shorter one is left to the shorter one's octave.

The tiles' fragments are shuffled by document and period and stitched where they overlap; of equal stretches the smallest period
stays. A task holds one document and the tile it is at; only documents with a tile are kept as texts for the
second pass, which drops the repeats.

Defined cases: null and empty texts have no words and no runs; very long texts are read whole; rows that repeat an id and text get
the same result each, those that repeat an id alone or have a null id are told apart by their texts; of runs of equal length the first, then
that with the smallest period counts as the longest; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize
from .text_arrays import mixed, span_hashes

MIN_LENGTH, TIMES = 6, 4
INNER = "[\\x20\\x09-\\x0D]+"
ROW = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("plain", pa.string()), ("text", pa.string()), ("base", pa.int32()), ("at", pa.int64()), ("codes", pa.list_(pa.int32()))])
ROW_DDL = "k1 long, k2 long, id long, n_words long, plain string, text string, base int, at long, codes array<int>"
BATCH = 4 << 20  # codes of tiles in an output batch
CUTS = 16  # in a tile


def chains(codes: np.ndarray, base: int, min_length: int = MIN_LENGTH, times: int = TIMES) -> list[tuple[int, int]]:
    """(first, last) of the cuts c in a tile for which codes[c : c + base] recurs at c + q, one after the other for the same q of
    the octave, as part of a chain as long as any run of that period must have it."""
    n, last = len(codes), len(codes) - 2 * base  # a block at the smallest distance still fits
    if last < 0:
        return []
    at = np.arange(n - base + 1)
    h = span_hashes(codes, at, at + base) if base > 1 else codes
    cuts = np.arange(0, last + 1, base)
    ahead = np.zeros((len(cuts), base), np.uint64)
    ahead.ravel()[: len(h) - base] = h[base : base + ahead.size]
    period, cut = np.nonzero((ahead == h[cuts, None]).T)
    if not len(cut):
        return []
    begins = np.concatenate(([True], (np.diff(period) != 0) | (np.diff(cut) != 1)))
    chain = np.cumsum(begins) - 1
    q = period[begins] + base
    places = np.maximum(min_length, times * q) - q
    stay = (np.bincount(chain) >= (places - base + 1) // base)[chain]
    chain, cut = chain[stay], cut[stay]
    edge = (np.diff(chain) != 0) | (np.diff(cut // CUTS) != 0)
    first, final = cut[np.concatenate(([True], edge))[: len(cut)]], cut[np.concatenate((edge, [True]))[: len(cut)]]
    reach: dict[int, int] = {}
    for c, e in zip((first * base).tolist(), (final * base).tolist()):
        reach[c] = max(e, reach.get(c, e))
    return list(reach.items())


def z_function(s: list, upto: int | None = None) -> list:
    """For each place (before upto) the length of the longest stretch from it that equals the beginning of s."""
    n, left, right = len(s), 0, 0
    z = [n] * min(n, 1) + [0] * (min(n, upto or n) - 1)
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def tile_fragments(before: list, after: list, base: int) -> list[tuple[int, int, int]]:
    """(period, places to the left, places to the right) of the cut between before and after where words a period
    apart are equal, for the periods of the octave that cover base places to the right."""
    z = z_function(after, 2 * base)
    periods = [q for q in range(base, len(z)) if z[q] >= base]
    root = next((p for p in range(1, base) if p + z[p] >= base), 0)
    whole = lambda q, p: p and q % p == 0 and p < q and z[p] >= q - p
    periods = [q for q in periods if not (whole(q, root) or (q % 2 == 0 and whole(q, q // 2)) or (q % 3 == 0 and whole(q, q // 3)))]
    if not periods:
        return []
    back, ahead = before[::-1], after[: 2 * base][::-1]
    zb, size = z_function([*back, None, *ahead]), len(back) + 1 + len(ahead)
    # the words before c + q, read backwards, start q words before those before c + 2 * base
    return [(q, min(len(back), zb[size - q]), z[q]) for q in periods]


def words_and_tiles(min_length: int, times: int):
    """Documents (k1, k2, id, text) as rows of their own, each before the rows of its tiles."""

    def run(batches):
        rows, held = {n: [] for n in ROW.names}, 0

        def put(**values):
            for n in ROW.names:
                rows[n].append(values.get(n))

        for b in batches:
            for k1, k2, doc, text in zip(*(b.column(x).to_pylist() for x in ("k1", "k2", "id")), b.column("text")):
                words = ((text := text.as_py()) or "").encode("utf-8", "surrogatepass").split()
                plain = hashlib.sha256(b" ".join(words)).hexdigest()
                numbers = np.fromiter(map({}.setdefault, words, count()), np.int32, len(words))
                codes, base, tiled = mixed(numbers), 1, False
                while times * base <= len(words):
                    for c, end in chains(codes, base, min_length, times):
                        tile = numbers[max(0, c - base) : end + 4 * base]
                        put(k1=k1, k2=k2, base=base, at=c, codes=tile)
                        held, tiled = held + len(tile), True
                        if held > BATCH:
                            yield pa.RecordBatch.from_pydict(rows, ROW)
                            rows, held = {n: [] for n in ROW.names}, 0
                    base *= 2
                put(k1=k1, k2=k2, id=doc, n_words=len(words), plain=plain, text=text if tiled else None)
            yield pa.RecordBatch.from_pydict(rows, ROW)
            rows, held = {n: [] for n in ROW.names}, 0

    return run


def solve(batches):
    """Fragments [low, high) of places i whose word equals the one a period later, from each tile."""
    for b in batches:
        out = {"k1": [], "k2": [], "period": [], "low": [], "high": []}
        tiles = b.column("codes")
        flat, offsets = tiles.values.to_numpy(), tiles.offsets.to_numpy()
        for k1, k2, base, c, begin, end in zip(*(b.column(x).to_pylist() for x in ("k1", "k2", "base", "at")), offsets[:-1].tolist(), offsets[1:].tolist()):
            left, codes = min(c, base), flat[begin:end].tolist()
            for q, back, ahead in tile_fragments(codes[:left], codes[left:], base):
                for name, value in zip(out, (k1, k2, q, c - back, c + ahead)):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, pa.schema([(n, pa.int64()) for n in out]))


def collapse(batches):
    """Digests of the runs, and of the words without the repeats, of each text."""
    for b in batches:
        digests, kept = [], []
        for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist()):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            step = np.zeros(len(words) + 1, np.int64)
            for r in runs or []:
                step[r["start"] + r["period"]] += 1
                step[r["start"] + r["length"]] -= 1
            stays = (np.cumsum(step[:-1]) == 0).tolist()
            digests.append(hashlib.sha256("".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs or []).encode()).hexdigest())
            kept.append(hashlib.sha256(b" ".join([w for w, s in zip(words, stays) if s])).hexdigest())
        yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("k1", "k2", "id", "n_words", "runs")), pa.array(digests, pa.string()), pa.array(kept, pa.string())], names=["k1", "k2", "id", "n_words", "runs", "runs_sha256", "collapsed_sha256"])


def stitched(fragments: DataFrame) -> DataFrame:
    """(k1, k2, period, low, high): fragments of a document and period that overlap or touch, as one."""
    order = W.partitionBy("k1", "k2", "period").orderBy("low", "high")
    seen = F.max("high").over(order.rowsBetween(W.unboundedPreceding, -1))
    starts = fragments.distinct().withColumn("new", F.when(F.col("low") <= seen, 0).otherwise(1))
    return starts.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))).groupBy("k1", "k2", "period", "island").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, times: int = TIMES) -> DataFrame:
    """(id, n_words, runs, runs_sha256, collapsed_sha256) of every row; runs is an array of (start, period, length) in this order."""
    if times < 4 or min_length < 4:
        raise ValueError("runs of fewer than four periods or words are not guaranteed to be found")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keyed = rows.select(F.xxhash64("id", "text").alias("k1"), F.xxhash64(F.lit(1), "id", "text").alias("k2"), "id", "text")
    table = materialize(keyed.mapInArrow(words_and_tiles(min_length, times), ROW_DDL), "run-tiles")
    fragments = table.where("base is not null").select("k1", "k2", "base", "at", "codes").mapInArrow(solve, "k1 long, k2 long, period long, low long, high long")
    length = F.col("high") - F.col("low") + F.col("period")
    long_enough = stitched(fragments).select("k1", "k2", "period", F.col("low").alias("start"), length.alias("length")).where(F.col("length") >= F.greatest(F.lit(min_length), times * F.col("period")))
    single = long_enough.groupBy("k1", "k2", "start", "length").agg(F.min("period").alias("period"))
    runs = single.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    whole = table.where("base is null")
    done = materialize(
        whole.where("text is not null").select("k1", "k2", "id", "n_words", "text").join(runs, ["k1", "k2"], "left")
        .mapInArrow(collapse, "k1 long, k2 long, id long, n_words long, runs array<struct<start:long,period:long,length:long>>, runs_sha256 string, collapsed_sha256 string"),
        "runs",
    )
    nothing = F.array().cast("array<struct<start:long,period:long,length:long>>")
    columns = lambda df, runs, digest, kept: df.select("id", "n_words", runs.alias("runs"), digest.alias("runs_sha256"), F.col(kept).alias("collapsed_sha256"))
    none = columns(whole.where("text is null"), nothing, F.sha2(F.lit("").cast("binary"), 256), "plain")
    return none.unionByName(columns(done, F.coalesce("runs", nothing), F.col("runs_sha256"), "collapsed_sha256"))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the words of every text; in a tenth of the texts, chosen by the id, they become periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), INNER), lambda w: w != "")
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    g = F.floor(F.col("h") / 10)
    sized = chosen.withColumns({"a": F.when(F.col("n") > 0, g % F.col("n")).cast("int"), "reps": (3 + g % 8).cast("int")}).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / F.col("reps"))).cast("int"))
    rest = F.col("n") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    return sized.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,period:long,length:long>"), lambda b, r: F.when(b.isNull() | (r["length"] > b["length"]), r).otherwise(b))
    top = found.withColumn("top", best)
    return top.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
