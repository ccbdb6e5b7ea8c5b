"""SentencePiece encoding and decoding by a relational lattice.

Texts are cut into words where no piece can reach across: before a blank that follows another
character, and around line feeds. Words are cut further into parts, where two neighbouring characters stand next to each
other in no piece: before marks at their end, and anywhere if they are long. In each distinct part the places are found where pieces may meet: not
between two characters whose score together beats that of every piece which could take one of them away first, as these
are surely merged. All substrings between such places, up to the longest piece, are exploded, joined with the piece table (broadcast: its size is the
vocabulary's; by hash, then by the strings), and the hits, its lattice's edges, are grouped by part; the part's partitioning serves the join and the
grouping, so edges are not shuffled. Edges that no other may precede are dropped, and
a Viterbi fold by the higher-order function aggregate takes the parts' paths.
Parts of more than LONG characters are exploded by segments under a digest, and folded by an inner and an outer aggregate, so that what
they carry, and copy at every step, stays short: a part of a million characters takes seconds. A part is one row, in one task.

The model files at hand hold BPE pieces, for which the path of best total score is not the library's
result (it differs for half of the words). The fold therefore allows a step only between compatible pieces, those
that stay apart when the two are merged alone; exactly one path of such steps ends at each place, and
it is the library's. A mask on each edge tells the lengths of the pieces that may precede it.
Characters without a piece are their UTF-8 bytes, as the model has it.

Ids of the FREQUENT commonest parts are broadcast (a bounded table); those of the others are
written in slices, one for each partition of the scan whose texts hold the part, and the second scan
reads its own slice, so texts are not shuffled. Should the second scan be split otherwise, parts missing in its slice are
merged by the definition, so the result does not rely on equal partitions.

Defined cases: null text has no ids and is decoded to an empty text; a text of blanks only is one word; very long texts and
unbroken ones of any length are encoded whole; repeated rows are encoded each; an empty table gives an empty
result; other columns are ignored. U+2581 in a text is read as a blank, as the library does, so it does not
come back in decoding.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, least_frequent, materialize, scratch_path

SPACE = "▁"
FREQUENT = 200_000  # words whose ids are broadcast (about 10 MB)
LOCAL_WORDS = 100_000  # cut words whose ids a worker keeps between slices
TOLD_WORDS = 1_000_000  # rows of words and counts that a worker holds before it sums them (about 30 MB)
SLICE_CHARS = 1_500_000
WORDS_IN_PARTITION = 20_000  # of the lattice
CUT_FROM = 64  # characters from which a word is cut at every sure place
LONG, SEGMENT = 512, 256  # characters of a long part, and of its segments
CHUNK, LOOK_BACK = 1024, 64  # edges that an inner fold goes over, and entries that it needs of those before
MARKS = ".,;:!?*#$%&|<>\"')]"
PAIRS = 4_000_000  # pairs of pieces that a worker remembers (36 MB)
LETTERS = 1000  # characters whose neighbours are looked up in tables
UNKNOWN = 1 << 23  # marks the code of a character without a piece in the place of an id


class Pieces:
    """The pieces of a BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        plain = [i for i in range(n) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))]
        self.first_byte = next(i for i in range(n) if m.is_byte(i))
        self.score = {m.id_to_piece(i): m.get_score(i) for i in plain}
        self.id = {m.id_to_piece(i): i for i in plain if self.merged(m.id_to_piece(i)) == [m.id_to_piece(i)]}  # pieces that merging reaches
        self.piece = {i: p for p, i in self.id.items()}
        self.longest = max(map(len, self.id))
        self.pairs_inside = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        if any(SPACE in p.lstrip(SPACE) for p in self.id) or any("\n" in p for p in self.id) or self.longest > 60:
            raise ValueError("pieces reach across words")
        known = {*plain}
        spelling = [bytes([i - self.first_byte]) if m.is_byte(i) else m.id_to_piece(i).replace(SPACE, " ").encode() if i in known else b"" for i in range(n)]
        self.bytes = pa.array(spelling, pa.large_binary())
        self.pairs, self.apart = np.zeros(0, np.int64), np.zeros(0, bool)  # pairs of pieces met so far, sorted
        self._bounds()

    def _bounds(self) -> None:
        """Of two neighbouring characters, by their classes: the score of the piece they make, and the best scores of a piece that ends and
        of one that begins with them. Class 0: in no piece of several characters; class 1: letters beyond LETTERS, about which nothing is told."""
        joint = [p for p in self.score if len(p) > 1]
        self.classes = np.zeros(0x110000, np.int16)
        for k, (c, _) in enumerate(Counter(c for p in joint for c in p).most_common()):
            self.classes[ord(c)] = k + 2 if k < LETTERS else 1
        side = int(self.classes.max()) + 1
        self.joined, self.ending, self.beginning = (np.full((side, side), -np.inf) for _ in range(3))
        for p in joint:
            (a, b), (c, d) = self.classes[[ord(p[0]), ord(p[1])]], self.classes[[ord(p[-2]), ord(p[-1])]]
            self.beginning[a, b] = max(self.beginning[a, b], self.score[p])
            self.ending[c, d] = max(self.ending[c, d], self.score[p])
            if len(p) == 2:
                self.joined[a, b] = self.score[p]
        self.joined[1], self.joined[:, 1] = -np.inf, -np.inf
        for bound in (self.ending, self.beginning):
            bound[1], bound[:, 1] = np.inf, np.inf

    def stops(self, words: pa.Array) -> pa.ListArray:
        """Places of each word, its two ends included, where pieces may meet. Two characters are surely merged if their score beats
        that of all pieces in which the first could be merged with what is before it, or the second with what is behind it."""
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        letters = self.classes[np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")]
        inside = np.ones(len(letters) + 1, bool)  # whether the place before a character is in a word; of the last place too
        inside[np.cumsum(sizes) - sizes] = inside[-1] = False
        joined, ending, beginning = (np.full(len(letters) + 2, -np.inf) for _ in range(3))
        for out, table in ((joined, self.joined), (ending, self.ending), (beginning, self.beginning)):
            out[1:-2] = np.where(inside[1:-1], table[letters[:-1], letters[1:]], -np.inf)
        ending = np.roll(ending, 1)
        merged = (joined[:-2] > ending[:-2]) & (joined[:-2] >= beginning[1:-1])
        word = np.repeat(np.arange(len(sizes)), sizes)
        stay = np.ones(len(letters) + len(sizes), bool)
        stay[np.arange(len(letters)) + word] = ~merged
        ends = np.cumsum(sizes + 1)
        places = np.arange(len(stay)) - np.repeat(ends - sizes - 1, sizes + 1)
        offsets = np.concatenate([[0], np.cumsum(stay)[ends - 1]]) if len(ends) else np.zeros(1)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places[stay], pa.int32()))

    def merged(self, text: str) -> list[str]:
        """Pieces by the definition: the best-scored pair, the left one of equals, is merged again and again."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(parts[:-1], parts[1:])]
            best = max(scores)
            if best == -np.inf:
                break
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def parts(self, word: str) -> tuple[str, ...]:
        """The word cut at places that no piece spans."""
        inside = self.pairs_inside
        if len(word) < CUT_FROM:
            body = word.rstrip(MARKS)
            k = len(body)
            return (body, word[k:]) if 0 < k < len(word) and word[k - 1 : k + 1] not in inside else (word,)
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in inside]
        return tuple(word[x:y] for x, y in zip([0, *cuts], [*cuts, len(word)]))

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of ids, each up to its end."""
        spelled = self.bytes.take(pa.array(ids))
        raw = spelled.buffers()[2].to_pybytes() if len(ids) else b""
        edge = np.frombuffer(spelled.buffers()[1], np.int64)[[0, *ends.tolist()]].tolist() if len(ids) else [0] * (len(ends) + 1)
        return [raw[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(edge[:-1], edge[1:])]

    def spelled(self, part: str) -> bytes:
        """Ids of a part by the definition."""
        out = []
        for p in self.merged(part):
            out += [self.id[p]] if p in self.id else [self.first_byte + b for c in p for b in c.encode("utf-8", "surrogatepass")]
        return np.array(out, "<u4").tobytes()

    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """For sorted, distinct codes (left id << 24 | right id) whether both stay apart; a character without a piece always does."""

        def apart(code: int) -> bool:
            a, b = code >> 24, code & 0xFFFFFF
            return not (0 < a < UNKNOWN and 0 < b < UNKNOWN) or self.merged(self.piece[a] + self.piece[b]) == [self.piece[a], self.piece[b]]

        if len(self.pairs) > PAIRS:
            self.pairs, self.apart = self.pairs[:0], self.apart[:0]
        at = np.searchsorted(self.pairs, codes)
        new = np.ones(len(codes), bool)
        inner = at < len(self.pairs)
        new[inner] = self.pairs[at[inner]] != codes[inner]
        if new.any():
            self.apart = np.insert(self.apart, at[new], [apart(c) for c in codes[new].tolist()])
            self.pairs = np.insert(self.pairs, at[new], codes[new])
            at = np.searchsorted(self.pairs, codes)
        return self.apart[at]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def marked(text: str | None) -> str:
    """The text with its words set apart by blanks, and blanks as U+2581; each text begins with one."""
    if not text:
        return ""
    if "  " in text or SPACE in text or text[0] == " ":
        text = re.sub(" +", lambda m: " " + SPACE * len(m.group()), " " + text.replace(SPACE, " "))[1:]
    else:
        text = SPACE + text.replace(" ", " " + SPACE)
    return text.replace("\n", " \n ")


def split(texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(the words of all texts, words in each text); the word "" stands for nothing."""
    lines = [marked(t) for t in texts]
    words = pc.split_pattern(pa.array([" ".join(lines)], pa.large_string()), " ").values.dictionary_encode()
    return words, np.array([t.count(" ") + 1 for t in lines], np.int64)


def words_of(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, the words of all texts by their number, words in each text)."""
    words, n = split(texts)
    return words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy(), n


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive slices with about SLICE_CHARS bytes in the column text: only one slice's texts are Python objects at a time."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        edges = [0, *(np.flatnonzero(np.diff(ends // SLICE_CHARS)) + 1).tolist(), b.num_rows]
        for x, y in zip(edges[:-1], edges[1:]):
            if x < y:
                yield b.slice(x, y - x)


def part_table(docs: DataFrame, model: str) -> DataFrame:
    """(word, n, parts): parts of words, times each occurs, and the scan partitions it occurs in."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, cut = TaskContext.get().partitionId(), pieces(model).parts
        held: list[tuple[pa.Array, np.ndarray]] = []  # distinct words of slices, and how often they occur

        def summed(counts: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
            words = pa.chunked_array([w for w, _ in counts], pa.large_string()).dictionary_encode().combine_chunks()
            return words.dictionary, np.bincount(words.indices.to_numpy(), np.concatenate([n for _, n in counts]), len(words.dictionary)).astype(np.int64)

        def told() -> Iterator[pa.RecordBatch]:
            words, n = summed(held)
            held.clear()
            size = pc.binary_length(words)  # words that end with a mark, or are long, may be cut
            whole = pc.and_(pc.equal(pc.binary_length(pc.utf8_rtrim(words, MARKS)), size), pc.less(size, CUT_FROM)).to_numpy(zero_copy_only=False)
            out: dict[str, int] = {}
            for w, k in zip(words.filter(pa.array(~whole)).to_pylist(), n[~whole].tolist()):
                for p in cut(w):
                    out[p] = out.get(p, 0) + k
            words, n = summed([(words.filter(pa.array(whole)), n[whole]), (pa.array(list(out), pa.large_string()), np.fromiter(out.values(), np.int64, len(out)))])
            table = pa.table({"word": words.cast(pa.string()), "n": n, "part": np.full(len(n), part, np.int32)})
            yield from table.filter(pc.not_equal(table["word"], "")).to_batches(max_chunksize=50_000)

        for b in sliced(batches):
            words, _ = split(b["text"].to_pylist())
            held.append((words.dictionary, np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))))
            if sum(len(n) for _, n in held) > TOLD_WORDS:
                yield from told()
        if held:
            yield from told()
        pa.default_memory_pool().release_unused()

    # a task tells most words once, so they are summed where they are dealt to
    return docs.select("text").mapInArrow(count, "word string, n long, part int").repartition("word").groupBy("word").agg(F.sum("n").alias("n"), F.collect_set("part").alias("parts"))


_end = lambda x: F.shiftright(x, 32).cast("int")
_length = lambda x: F.shiftright(x, 24).bitwiseAND(F.lit(255)).cast("int")


def _edges(rows: DataFrame, key: str, text: str, base, own, table: DataFrame, longest: int, stops=None) -> DataFrame:
    """(key, edges): of rows (key, text) the substrings between stops (all places by default) that begin at the first own of them and are pieces, or
    single characters, as sorted codes of end (base added) and length, both counted in stops, and id."""
    stops = F.sequence(F.lit(0), F.length(text)) if stops is None else stops
    begins = rows.select(key, text, base.alias("base"), own.alias("own"), stops.alias("stops")).select("*", F.posexplode("stops").alias("at", "begin")).where(F.col("at") < F.col("own"))
    spans = begins.select("*", F.posexplode(F.slice("stops", F.col("at") + 2, F.lit(longest))).alias("len", "stop")).withColumn("chars", F.col("stop") - F.col("begin")).where(F.col("chars") <= longest)
    spans = spans.withColumn("span", F.substring(text, F.col("begin") + 1, F.col("chars"))).withColumn("hash", F.xxhash64("span"))
    known = F.broadcast(table.select("piece", "id", F.xxhash64("piece").alias("piece_hash")))
    equal = (F.col("hash") == F.col("piece_hash")) & F.col("span").between(F.col("piece"), F.col("piece"))  # between: else the strings would be the keys, which takes thrice the time
    hits = spans.join(known, equal, "left").where(F.col("id").isNotNull() | (F.col("chars") == 1))
    ident = F.coalesce("id", F.ascii("span") + UNKNOWN).cast("long")
    length = F.col("len") + 1
    code = F.shiftleft((F.col("base") + F.col("at") + length).cast("long"), 32).bitwiseOR(F.shiftleft(length.cast("long"), 24)).bitwiseOR(ident)
    return hits.select(key, code.alias("code")).groupBy(key).agg(F.array_sort(F.collect_list("code")).alias("edges"))


def _masked(edges: DataFrame, model: str) -> DataFrame:
    """edges with mask: for each edge, the lengths of the pieces that may precede it, as bits. Edges that none may precede are left out."""

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for rows in batches:
            batch = rows["edges"]
            sizes = pc.list_value_length(batch).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.flatten().to_numpy(zero_copy_only=False)
            word = np.repeat(np.arange(len(sizes)), sizes)
            end, length, ident = flat >> 32, flat >> 24 & 255, flat & 0xFFFFFF
            stride = int(end.max(initial=0)) + 2
            key, begin = word * stride + end, end - length
            low, high = np.searchsorted(key, word * stride + begin, "left"), np.searchsorted(key, word * stride + begin, "right")
            many = high - low
            e = np.repeat(np.arange(len(flat)), many)
            before = np.arange(len(e)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            pairs, back = np.unique(ident[before] << 24 | ident[e], return_inverse=True)
            mask = (begin == 0).astype(np.int64)
            np.add.at(mask, e, own.compatible(pairs)[back].astype(np.int64) << length[before])
            keep = mask != 0
            offsets = pa.array(np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(sizes)])], pa.int32())
            yield pa.RecordBatch.from_arrays([rows[0], *(pa.ListArray.from_arrays(offsets, pa.array(x[keep])) for x in (flat, mask))], [key_name, "edges", "mask"])

    key_name = edges.columns[0]
    return edges.mapInArrow(masks, f"{key_name} string, edges array<long>, mask array<long>")


def _with_stops(words: DataFrame, model: str) -> DataFrame:
    """words (a column word only) with stops, places where pieces may meet. No UDF, as those run twice behind a filter that Spark
    infers, in workers of their own besides those of mapInArrow."""

    def stops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["word"], own.stops(b["word"])], ["word", "stops"])

    return words.mapInArrow(stops, "word string, stops array<int>")


def _allowed(mask, before):
    return F.call_function("shiftright", mask, _length(before)).bitwiseAND(F.lit(1).cast("long")) == 1


def _path(rows: DataFrame) -> DataFrame:
    """rows (edges, mask) with path: the codes of the pieces, by a fold forwards and one backwards."""

    def step(acc, e):
        x = e["edges"]
        return F.when((F.size(acc) == _end(x)) & _allowed(e["mask"], acc[_end(x) - _length(x)]), F.concat(acc, F.array(x))).otherwise(acc)

    last = rows.withColumn("last", F.aggregate(F.arrays_zip("edges", "mask"), F.array(F.lit(0).cast("long")), step))
    whole = F.size("last") - 1
    start = F.struct(whole.alias("at"), F.array().cast("array<long>").alias("path"))
    back = lambda s, at: F.when(at == s["at"], F.struct((at - _length(F.col("last")[at])).alias("at"), F.concat(F.array(F.col("last")[at]), s["path"]).alias("path"))).otherwise(s)
    return last.withColumn("path", F.aggregate(F.sequence(whole, F.lit(1), F.lit(-1)), start, back, lambda s: s["path"]))


def _long_path(rows: DataFrame) -> DataFrame:
    """As _path, for long parts. A fold copies what it carries at every step, so an inner fold goes over CHUNK edges (or places) with
    the last LOOK_BACK entries, which is as far as a piece reaches, and an outer one appends whole blocks of what the inner folds found."""
    blocks = F.array().cast("array<array<long>>")
    pieces_of = lambda n: F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))

    def forward(acc, k):
        def step(s, e):
            x = e["0"]
            before = F.get(s["tail"], _end(x) - _length(x) - s["size"] + F.size(s["tail"]))
            fits = (s["size"] == _end(x)) & _allowed(e["1"], before)
            return F.when(fits, F.struct((s["size"] + 1).alias("size"), F.concat(s["tail"], F.array(x)).alias("tail"))).otherwise(s)

        def whole(s):
            held = F.size(acc["tail"])
            new = F.slice(s["tail"], held + 1, F.size(s["tail"]) - held)
            kept = F.slice(s["tail"], F.greatest(F.size(s["tail"]) - LOOK_BACK + 1, F.lit(1)), F.lit(LOOK_BACK))
            return F.struct(s["size"].alias("size"), kept.alias("tail"), F.concat(acc["done"], F.array(new)).alias("done"))

        own = [F.slice(c, k * CHUNK + 1, F.lit(CHUNK)) for c in ("edges", "mask")]
        return F.aggregate(F.arrays_zip(*own), F.struct(acc["size"].alias("size"), acc["tail"].alias("tail")), step, whole)

    zero = F.array(F.lit(0).cast("long"))
    first = F.struct(F.lit(1).alias("size"), zero.alias("tail"), F.array(zero).alias("done"))
    last = rows.withColumn("last", F.aggregate(pieces_of(F.size("edges")), first, forward, lambda s: F.flatten(s["done"])))
    n = F.size("last") - 1

    def back(acc, k):
        def step(s, at):
            x = F.col("last")[at]
            return F.when(at == s["at"], F.struct((at - _length(x)).alias("at"), F.concat(F.array(x), s["path"]).alias("path"))).otherwise(s)

        high = n - k * CHUNK
        own = F.sequence(high, F.greatest(high - CHUNK + 1, F.lit(1)), F.lit(-1))
        start = F.struct(acc["at"].alias("at"), F.array().cast("array<long>").alias("path"))
        return F.aggregate(own, start, step, lambda s: F.struct(s["at"].alias("at"), F.concat(F.array(s["path"]), acc["done"]).alias("done")))

    return last.withColumn("path", F.aggregate(pieces_of(n), F.struct(n.alias("at"), blocks.alias("done")), back, lambda s: F.flatten(s["done"])))


def encode_words(words: DataFrame, model: str, partitions: int | None = None) -> DataFrame:
    """words (a column word, distinct, and any others) with ids: explode, equi-join, group, fold. They are dealt to so many
    partitions by word, those of the session by default."""
    p = pieces(model)
    spark = words.sparkSession
    table = F.broadcast(spark.createDataFrame(list(p.id.items()), "piece string, id int"))  # the vocabulary
    dealt = lambda df: df.repartition(partitions, "word") if partitions else df
    few = words.where(F.length("word") <= LONG)
    shown = dealt(_with_stops(few.select("word"), model))  # stops first: behind Python Spark takes rows for dealt anyhow, and would shuffle the edges
    short = _path(_masked(_edges(shown, "word", "word", F.lit(0), F.size("stops") - 1, table, p.longest, F.col("stops")), model)).select("word", "path")

    many = dealt(words.where(F.length("word") > LONG)).withColumn("digest", F.sha2("word", 256))
    bases = F.sequence(F.lit(0), F.floor((F.length("word") - 1) / SEGMENT).cast("int"))
    segments = many.select("digest", F.length("word").alias("n"), F.explode(F.transform(bases, lambda k: F.struct((k * SEGMENT).alias("base"), F.substring("word", k * SEGMENT + 1, F.lit(SEGMENT + p.longest - 1)).alias("text")))).alias("s")).select("digest", "n", "s.*")
    own = F.least(F.lit(SEGMENT), F.col("n") - F.col("base")).cast("int")
    long = _long_path(_masked(_edges(segments, "digest", "text", F.col("base"), own, table, p.longest), model)).select("digest", "path")

    def ids(x):
        ident = x.bitwiseAND(F.lit(0xFFFFFF).cast("long")).cast("int")
        c = ident - UNKNOWN  # the code point: its bytes in UTF-8
        low = lambda v, k: F.shiftright(v, 6 * k).bitwiseAND(F.lit(63)) + 128 + p.first_byte
        lead = lambda v, k, mark: F.shiftright(v, 6 * k) + mark + p.first_byte
        spelled = (
            F.when(c < 0x80, F.array(c + p.first_byte)).when(c < 0x800, F.array(lead(c, 1, 0xC0), low(c, 0))).when(c < 0x10000, F.array(lead(c, 2, 0xE0), low(c, 1), low(c, 0)))
            .otherwise(F.array(lead(c, 3, 0xF0), low(c, 2), low(c, 1), low(c, 0)))
        )
        return F.when(c < 0, F.array(ident)).otherwise(spelled)

    coded = lambda df, *keys: df.select(*keys, F.flatten(F.transform("path", ids)).alias("ids"))
    return dealt(few).join(coded(short, "word").hint("merge"), "word").unionByName(many.join(coded(long, "digest"), "digest").drop("digest"))


@contextmanager
def grouped_in_memory(spark: SparkSession, groups: int) -> Iterator[None]:
    """Lets aggregations into arrays hold so many groups of a task in memory before they sort (Spark's default is 128)."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name, "128")
    spark.conf.set(name, str(groups))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
    """(id, text, ids): ids binary, little-endian unsigned 32-bit, as the library gives them. With decoded_col, ids are
    decoded again in the same task, into a column of that name.

    docs is scanned twice, so it should be a table that is read, not a result with shuffles."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with grouped_in_memory(spark, 400_000):
        words = materialize(part_table(own, model), "sp-words")
    parts = max(1, -(-words.count() // WORDS_IN_PARTITION))
    with grouped_in_memory(spark, 2 * WORDS_IN_PARTITION):
        coded = materialize(encode_words(words, model, parts), "sp-lexicon")
    least = least_frequent(words, "n", FREQUENT)
    discard(words)
    frequent = coded.where(F.col("n") > least).select("word", "ids").toPandas()  # at most FREQUENT rows
    as_bytes = lambda ids: np.asarray(ids, "<u4").tobytes()
    known = spark.sparkContext.broadcast({w: as_bytes(i) for w, i in zip(frequent["word"], frequent["ids"])})
    folder = scratch_path(spark, "sp-slices")
    rare = coded.where(F.col("n") <= least)
    rare.select("word", "ids", F.explode("parts").alias("part")).repartition("part").write.partitionBy("part").parquet(folder)
    discard(coded)

    def slice_of(part: int) -> dict[str, bytes]:
        from pyarrow import fs, parquet

        table: dict[str, bytes] = {}
        store, place = fs.FileSystem.from_uri(folder)
        place = f"{place}/part={part}"
        if store.get_file_info(place).type != fs.FileType.NotFound:
            for f in store.get_file_info(fs.FileSelector(place)):
                if f.path.endswith(".parquet"):
                    t = parquet.ParquetFile(store.open_input_file(f.path)).read(columns=["word", "ids"])
                    at = t["ids"].combine_chunks()
                    flat, edge = at.values.to_numpy().astype("<u4"), (4 * at.offsets.to_numpy()).tolist()
                    raw = flat.tobytes()
                    table.update(zip(t["word"].to_numpy().tolist(), [raw[a:b] for a, b in zip(edge[:-1], edge[1:])]))
        return table

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, rare, common = pieces(model), slice_of(TaskContext.get().partitionId()), known.value
        seen: dict[str, bytes] = {}  # ids of words that are cut

        def word_ids(word: str) -> bytes:
            got = seen[word] = b"".join([part_ids(p) for p in own.parts(word)])
            return got

        def part_ids(part: str) -> bytes:
            got = common.get(part)
            if got is None:
                got = rare.get(part)
            if got is None:
                got = rare[part] = own.spelled(part)
            return got

        for b in sliced(batches):
            words, at, n = words_of(b["text"].to_pylist())
            ids = [common.get(w) or rare.get(w) or seen.get(w) or (word_ids(w) if w else b"") for w in words]
            if len(seen) > LOCAL_WORDS:
                seen.clear()
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            each = size[at]
            begin, ends = np.cumsum(size) - size, np.cumsum(each)
            flat = np.frombuffer(b"".join(ids), "<u4")[np.repeat(begin[at] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
            raw, last = flat.tobytes(), ends[np.cumsum(n) - 1]
            edge = [0, *(4 * last).tolist()]
            out = {"id": b["id"], "text": b["text"], "ids": pa.array([raw[u:v] for u, v in zip(edge[:-1], edge[1:])], pa.binary())}
            yield pa.RecordBatch.from_pydict(out | {"decoded": pa.array(own.texts(flat, last), pa.string())} if decoded_col else out)

    coded = own.mapInArrow(assemble, f"id {kind}, text string, ids binary" + ", decoded string" * bool(decoded_col)).withColumnRenamed("id", id_col)
    return coded.withColumnRenamed("decoded", decoded_col) if decoded_col else coded


def decode(coded: DataFrame, model: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """coded with the text of its ids (binary, little-endian unsigned 32-bit)."""

    @F.arrow_udf("string")
    def text(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = pieces(model)
        for batch in column:
            raw = batch.to_pylist()
            yield pa.array(own.texts(np.frombuffer(b"".join(raw), "<u4"), np.cumsum([len(r) // 4 for r in raw], dtype=np.int64)), pa.string())

    return coded.withColumn(name, text(ids_col))


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model, decoded_col="decoded")
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
