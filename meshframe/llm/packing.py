"""Best-fit packing of token pieces into sequences, improved by a swap-based local search.

Pieces as long as a sequence fill one each. The others are dealt by a hash of their row number to
groups of bounded size; each group starts from best-fit decreasing. Then each underfull bin, from the
emptiest on, gives its pieces away: a piece moves to another bin, or one or two of its pieces are
exchanged for a smaller one there, always so that the other bin, which is at least as full, gets fuller: the
sum of squared fills grows, until the bin is empty or no exchange gains. Passes over all underfull bins are
repeated until one empties none, or as few bins are left as the sum of lengths needs. Bins that stay below
pool_below of the capacity are pooled across groups and packed again, in fewer groups each round, until one group
is left or a round saves less than a hundredth of the pooled bins.

Defined cases: null text is empty (the end id alone); a null id is carried along; repeated rows are
packed as separate rows, and pieces of equal length in the order of their rows; very long texts are cut into pieces
as they are encoded, whole; an empty table gives an empty result; other columns of pieces are carried along, but for
sequence_id and offset, which the result replaces.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .tokens import encoder, slices

CAPACITY = 1024
GROUP_PIECES = 20_000
ROW = "__packing_row"
SLICE_CHARS = 1_500_000  # encoded at once
CACHE = (200_000, 300_000)  # words and their bodies kept by the encoder (about 90 MB), less than alone, as the stage runs beside others


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most capacity ids of each text and its end id: id, piece, start, length, ids
    (binary, little-endian unsigned 32-bit). Only longer documents are cut; their first piece takes the remainder."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer, *CACHE)
        for b in batches:
            texts, keys = b["text"].tolist(), b["id"]
            for x, y in slices(texts, SLICE_CHARS):
                ids, n = enc.flat(texts[x:y], end_id)
                many = -(-n // capacity)
                at = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                first = n - (many - 1) * capacity  # the first piece takes the remainder
                start = np.where(piece > 0, first[at] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[at])
                raw, begin = ids.tobytes(), 4 * ((np.cumsum(n) - n)[at] + start)
                yield pd.DataFrame({"id": keys.iloc[x + at].array, "piece": piece.astype(np.int32), "start": start, "length": length, "ids": [raw[u:v] for u, v in zip(begin.tolist(), (begin + 4 * length).tolist())]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(cut, f"id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # room sizes with a bin, ascending
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        k = bisect_left(rooms, s)
        if k == len(rooms):
            bins.append([i])
            b, room = len(bins) - 1, capacity - s
        else:
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(k)
            bins[b].append(i)
            room -= s
        if room:
            if not by_room[room]:
                rooms.insert(bisect_left(rooms, room), room)
            by_room[room].append(b)
    return bins


class _Underfull:
    """Underfull bins by room and, while they are open, by the lengths of their pieces; entries of changed bins
    are skipped when met."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.fill: dict[int, int] = {}
        self.pieces: dict[int, dict[int, list[int]]] = {}  # of each bin: pieces by length
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by length: (-room, bin); 0: any bin
        self.room = np.full(capacity + 1, -1, np.int64)  # by length: the largest room of a bin with such a piece
        self.by_room: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.tried: set[int] = set()  # bins that could not be emptied in this pass: pieces may still move there

    def put(self, b: int, fill: int, pieces: dict[int, list[int]]) -> None:
        self.fill[b], self.pieces[b] = fill, pieces
        room = self.capacity - fill
        self.by_room[room].add(b)
        for t in (0, *pieces) if b not in self.tried else (0,):
            heappush(self.heaps[t], (-room, b))
            self.room[t] = max(self.room[t], room)

    def take(self, b: int) -> tuple[int, dict[int, list[int]]]:
        fill, pieces = self.fill.pop(b), self.pieces.pop(b)
        self.by_room[self.capacity - fill].discard(b)
        for t in (0, *pieces):
            self._settle(t)
        return fill, pieces

    def _settle(self, t: int) -> None:
        heap = self.heaps[t]
        while heap and not (self.fill.get(b := heap[0][1], -1) == self.capacity + heap[0][0] and (not t or b not in self.tried and t in self.pieces[b])):
            heappop(heap)
        self.room[t] = -heap[0][0] if heap else -1

    def reopen(self) -> None:
        tried, self.tried = self.tried, set()
        for b in tried.intersection(self.fill):
            self.put(b, *self.take(b))

    def emptiest(self) -> int | None:
        """The emptiest bin not tried yet: all open ones are as full at least."""
        return next((b for bins in reversed(self.by_room) for b in sorted(bins) if b not in self.tried), None)

    def tightest(self, s: int) -> int | None:
        """The fullest bin with room for s."""
        return next((min(self.by_room[r]) for r in range(s, self.capacity) if self.by_room[r]), None) if self.room[0] >= s else None

    def partner(self, sums: np.ndarray) -> tuple[int, int] | None:
        """(s, t) with the largest gain s - t: a bin with a piece t has room for s in its place."""
        reach = np.maximum.accumulate(np.where(self.room >= 0, np.arange(self.capacity + 1) + self.room, -1)[1:])
        t = np.searchsorted(reach, sums) + 1  # the smallest t whose bin takes s
        gain = np.where(t < sums, sums - t, 0)
        k = int(gain.argmax())
        return (int(sums[k]), int(t[k])) if gain[k] > 0 else None


def improve(sizes: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empty bins by moves and exchanges that increase the sum of squared fills."""
    sizes = np.asarray(sizes, np.int64)
    length = sizes.tolist()
    least = -(-int(sizes.sum()) // capacity)
    full, pool, n = [], _Underfull(capacity), len(bins)
    for b, own in enumerate(bins):
        fill = sum(length[i] for i in own)
        if fill >= capacity:
            full.append(own)
        else:
            by_length: dict[int, list[int]] = {}
            for i in own:
                by_length.setdefault(length[i], []).append(i)
            pool.put(b, fill, by_length)
    saved = True
    while saved and n > least:
        saved = False
        while n > least and (low := pool.emptiest()) is not None:
            fill, own = pool.take(low)
            while own:
                gain = _gain(pool, own, fill, capacity)
                if gain is None:
                    break
                fill -= gain[0]
                full += gain[1]
            if own:
                pool.tried.add(low)
                pool.put(low, fill, own)
            else:
                saved, n = True, n - 1
        pool.reopen()
    return full + [[i for some in own.values() for i in some] for own in pool.pieces.values()]


def _gain(pool: _Underfull, own: dict[int, list[int]], fill: int, capacity: int) -> tuple[int, list[list[int]]] | None:
    """One move or exchange out of a bin: what it loses, and the bin that got full if so."""
    for s in sorted(own, reverse=True):
        to = pool.tightest(s)
        if to is not None and pool.fill[to] + s > fill:
            return s, _swap(pool, own, to, (s,), 0, capacity)
    lengths = np.array(sorted(own))
    found = pool.partner(lengths)
    pairs = lengths[:, None] + lengths  # two for one; a length with itself needs two such pieces
    allowed = (lengths[:, None] < lengths) | (np.eye(len(lengths), dtype=bool) & np.array([len(own[s]) > 1 for s in lengths.tolist()]))
    sums = np.unique(pairs[allowed & (pairs <= capacity)])
    double = pool.partner(sums) if len(sums) else None
    if double and (not found or double[0] - double[1] > found[0] - found[1]):
        x, y = (int(k) for k in np.argwhere(allowed & (pairs == double[0]))[0])
        give, t = (int(lengths[x]), int(lengths[y])), double[1]
    elif found:
        give, t = (found[0],), found[1]
    else:
        return None
    return sum(give) - t, _swap(pool, own, pool.heaps[t][0][1], give, t, capacity)


def _swap(pool: _Underfull, own: dict[int, list[int]], to: int, give: tuple[int, ...], t: int, capacity: int) -> list[list[int]]:
    fill, theirs = pool.take(to)
    moved = [_out(own, s) for s in give]
    if t:
        own.setdefault(t, []).append(_out(theirs, t))
    for s, i in zip(give, moved):
        theirs.setdefault(s, []).append(i)
    fill += sum(give) - t
    if fill >= capacity:
        return [[i for some in theirs.values() for i in some]]
    pool.put(to, fill, theirs)
    return []


def _out(pieces: dict[int, list[int]], s: int) -> int:
    i = pieces[s].pop()
    if not pieces[s]:
        del pieces[s]
    return i


def pack_sequences(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, pool_below: float = 0.95, least_saving: float = 0.01) -> DataFrame:
    """pieces (with a column length, 1 to capacity, and any others) and sequence_id, offset."""
    stored = materialize(pieces.drop("sequence_id", "offset").withColumn(ROW, F.monotonically_increasing_id()), "pieces")
    short = stored.where(F.col("length") < capacity).select(F.col(ROW).alias("row_no"), F.col("length").cast("int").alias("length"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, sizes = pdf["row_no"].to_numpy(), pdf["length"].to_numpy(np.int64)
        order = np.argsort(rows, kind="stable")
        rows, sizes = rows[order], sizes[order]
        bins = improve(sizes, best_fit(sizes, capacity), capacity)
        flat = np.array([i for b in bins for i in b], np.int64)
        count = np.array([len(b) for b in bins], np.int64)
        ends = np.cumsum(sizes[flat])
        first = np.concatenate(([0], np.cumsum(count)[:-1]))
        base = (ends - sizes[flat])[first]
        return pd.DataFrame(
            {
                "row_no": rows[flat], "length": sizes[flat].astype(np.int32), "sequence_id": (int(pdf["grp"].iat[0]) << 32) + np.repeat(np.arange(len(bins)), count),
                "offset": ends - sizes[flat] - np.repeat(base, count), "fill": np.repeat(np.array([sizes[b].sum() for b in bins]), count),
            }
        )

    schema = "row_no long, length int, sequence_id long, offset long, fill long"
    low = F.col("fill") < pool_below * capacity
    n, done, pool, part, turn, before = short.count(), None, short, 0, 0, None
    while True:
        groups = max(1, -(-n // group_pieces))
        dealt = pool.select("row_no", "length", (F.pmod(F.xxhash64("row_no", F.lit(turn)), F.lit(groups)) + F.lit(part)).alias("grp"))
        packed = materialize(dealt.groupBy("grp").applyInPandas(pack, schema), "packed")
        part, turn = part + groups, turn + 1
        bins, n, again = packed.agg(F.count_if(F.col("offset") == 0), F.count_if(low), F.count_if(low & (F.col("offset") == 0))).first()
        last = groups == 1 or not n or (before is not None and before - bins < least_saving * before)
        settled = packed if last else packed.where(~low)
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        pool, before = packed.where(low), again
    placed = done.select(F.col("row_no").alias(ROW), "sequence_id", "offset")
    full = stored.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.col(ROW), "offset": F.lit(0).cast("long")})
    return stored.where(F.col("length") < capacity).join(placed, ROW).unionByName(full).drop(ROW)


def packed_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Pieces of all texts with a digest of their ids, packed."""
    pieces = token_pieces(docs, tokenizer, id_col, text_col, end_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack_sequences(pieces)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
