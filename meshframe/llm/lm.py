"""LM scoring by a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Counts of all training words are gathered in Spark (summed in the task, then by word). Every word that makes up
a COMMON_SHARE of the training tokens is a symbol with vectors of its own, so the vocabulary follows the corpus and
has a bound that holds at any size (1 / COMMON_SHARE); the rarer words share one of TAIL symbols by
their last two letters and are told apart within it by their counts, so the model is normalised over all known
words and one unknown for each tail.

The vector predicted for the next symbol is the sum of a matrix for each of the three places before
times the vectors there. Symbols are cut, from the commonest on, into classes of equal sums of root shares; the
vector's product with the classes' vectors and biases gives the class after one softmax, that with the vectors
of the class's symbols gives the symbol after another. Both sets of vectors are trained by noise-contrastive estimation, against
CLASS_NOISE classes and NOISE symbols drawn by their shares and shared in a batch.

Texts become symbols once, in a table. Training rows are dealt by a hash of their content to shards of some
TOKENS_IN_SHARD tokens, and learned in the order of that hash, so the model does not depend on the number or
layout of partitions. Each shard trains a copy; copies are averaged (each vector by how often the
shard met it) in a tree of small groups, in two rounds over disjoint halves of the training rows, so all of
them are learned from.

Only counts of the commonest FREQUENT words are broadcast (a bounded table); the rarer words of
each document are joined with the counts by Spark, where no key is hot.

Defined cases: null and empty text is one end token; very long texts are learned in chunks that overlap by the
context; a null id counts as training; repeated rows count and score as separate rows; words of equal count are
ordered by their letters; without training documents all tokens are unknown and the model is
uniform over its symbols; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, least_frequent, materialize
from .tokens import slices

COMMON_SHARE = 1 / 200_000  # words with this share of the training tokens, or more, are symbols of their own
TAIL = 128  # symbols of all other words
FREQUENT = 200_000  # at most so many words' counts are broadcast (about 5 MB)
LOCAL_WORDS = 300_000  # words a task counts before it hands them on
PLACES, DIM, NOISE, BATCH = 3, 16, 64, 512
CLASS_NOISE = 64  # of some 140 classes for 20,000 symbols
RATE = 0.05
ROWS, ROWS_OF_CLASSES = 65_536, 512  # contexts that are grouped by class, and whose products are made, at once
TOKENS_IN_SHARD = 2_000_000
CHUNK = 1 << 18  # tokens that are shuffled and trained at once
TREE = 16  # models averaged by a task


def tail_of(word: bytes) -> int:
    """The tail symbol of a word, by its last two characters."""
    return zlib.crc32(word.decode("utf-8", "replace")[-2:].encode()) % TAIL


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "replace").lower().split()


def flat_words(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words as of words_of, the words of all texts one after the other by their number, words in each text)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))
    words = split.values.dictionary_encode()
    names, at = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
    full = at != names.index("") if "" in names else np.ones(len(at), bool)  # white space at the ends leaves an empty word
    return names, at[full], np.diff(np.concatenate(([0], np.cumsum(full)))[split.offsets.to_numpy()])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the column text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                own.update(words_of(t))
                if len(own) > LOCAL_WORDS:
                    yield told(own)
                    own = Counter()
        yield told(own)

    def told(own: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": [w.decode() for w in own], "c": list(own.values())}).astype({"word": "object", "c": "int64"})

    return docs.select("text").mapInPandas(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _sum_rows(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, and the sums of their rows, each over its own rows alone."""
    order = np.argsort(at, kind="stable")
    own = at.take(order)
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return own.take(first).astype(np.int64), np.add.reduceat(rows.take(order, 0), first, axis=0)


class LogBilinear:
    """Symbols from the commonest (0) on, in classes of consecutive ones; one more context vector for the begin of a text."""

    def __init__(self, counts: np.ndarray, places: int = PLACES):
        """counts: of the symbols, in descending order."""
        self.counts, self.n, self.n_places = counts, len(counts), places
        self.begin_of_text = self.n
        self.share = (counts + 1) / (counts + 1).sum()
        root = np.cumsum(np.sqrt(self.share))
        bins = np.floor(root / root[-1] * max(1, round(np.sqrt(self.n))) * (1 - 1e-9))
        self.class_of = np.unique(bins, return_inverse=True)[1].astype(np.uint16)
        self.n_classes = int(self.class_of[-1]) + 1
        self.low = np.searchsorted(self.class_of, np.arange(self.n_classes + 1))  # a class's first symbol
        self.class_share = np.add.reduceat(self.share, self.low[:-1])
        rng, f = np.random.default_rng(7), np.float32
        # context vectors; target vectors of the classes and then of the symbols, with a bias each; matrices of the places
        bias = np.log(np.concatenate((self.class_share, self.share)))
        self.parts = [
            rng.normal(0, 0.1, (self.n + 1, DIM)).astype(f), np.column_stack((rng.normal(0, 0.1, (self.n_classes + self.n, DIM)), bias)).astype(f), np.stack([np.eye(DIM, dtype=f) * f(0.5)] * places)
        ]
        self.log_noise = (bias + np.log(np.repeat([CLASS_NOISE, NOISE], [self.n_classes, self.n]))).astype(f)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def load(self, flat: np.ndarray) -> LogBilinear:
        cuts = np.cumsum([p.size for p in self.parts])[:-1]
        self.parts = [x.astype(np.float32).reshape(p.shape) for x, p in zip(np.split(np.asarray(flat), cuts), self.parts)]
        return self

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities of the targets."""
        r, w, m = self.parts
        u, q = w[: self.n_classes], w[self.n_classes :]
        tables, out = [r @ c for c in m], np.empty(len(target), np.float32)
        for k in range(0, len(target), ROWS):
            x, t = context[k : k + ROWS], target[k : k + ROWS]
            h, c = np.ones((len(t), DIM + 1), np.float32), self.class_of.take(t)  # the last column meets the biases
            h[:, :DIM] = sum(tables[p].take(x[:, p], 0) for p in range(self.n_places))
            got = out[k : k + ROWS]
            for y in range(0, len(t), ROWS_OF_CLASSES):
                got[y : y + ROWS_OF_CLASSES] = _log_softmax(h[y : y + ROWS_OF_CLASSES], u, c[y : y + ROWS_OF_CLASSES])
            order = np.argsort(c, kind="stable")
            h, t, edge = h.take(order, 0), t.take(order), np.searchsorted(c.take(order), np.arange(self.n_classes + 1))
            inside = np.zeros(len(t), np.float32)
            for x in np.flatnonzero((edge[1:] > edge[:-1]) & (self.low[1:] - self.low[:-1] > 1)).tolist():
                i, j = self.low[x], self.low[x + 1]
                for y in range(edge[x], edge[x + 1], ROWS_OF_CLASSES):
                    z = min(y + ROWS_OF_CLASSES, edge[x + 1])
                    inside[y:z] = _log_softmax(h[y:z], q[i:j], t[y:z] - i)
            got[order] += inside
        return out

    def train(self, context: np.ndarray, target: np.ndarray, memory: list[np.ndarray], rng: np.random.Generator) -> None:
        """One pass of noise-contrastive estimation in batches, of the classes and of the symbols; memory: sums of
        squared gradients."""
        r, w, m = self.parts
        of_class, of_symbol, places = np.cumsum(self.class_share), np.cumsum(self.share), self.n_places
        code = np.uint16 if self.n + self.n_classes < 1 << 16 else np.uint32
        products = np.empty((BATCH, CLASS_NOISE + NOISE), np.float32)

        def step(k: int, at: np.ndarray, grad: np.ndarray) -> None:
            mem = memory[k].take(at, 0)
            mem += grad * grad
            memory[k][at] = mem
            np.sqrt(mem, out=mem)
            mem += np.float32(1e-3)
            grad *= np.float32(RATE)
            grad /= mem
            self.parts[k][at] += grad

        for k in range(0, len(target), BATCH):
            x, t = context[k : k + BATCH].T.ravel(), target[k : k + BATCH]
            n = len(t)
            wanted = np.concatenate((self.class_of.take(t), t + self.n_classes))
            drawn = np.concatenate((np.searchsorted(of_class[:-1], rng.random(CLASS_NOISE)), np.searchsorted(of_symbol[:-1], rng.random(NOISE)) + self.n_classes))
            vectors = r.take(x, 0).reshape(places, n, DIM)
            h = np.ones((n, DIM + 1), np.float32)  # the last column meets the biases
            h[:, :DIM] = np.matmul(vectors, m).sum(0)
            own, noise = w.take(wanted, 0).reshape(2, n, DIM + 1), w.take(drawn, 0)
            other = np.matmul(h, np.negative(noise).T, out=products[:n])
            other += self.log_noise.take(drawn)
            _one_of(other)  # the gradients at noise, but for the sign
            right = _one_of(np.einsum("knd,nd->kn", own, h).ravel() - self.log_noise.take(wanted))
            right = right.reshape(2, n, 1)
            g_h = (right[0] * own[0] + right[1] * own[1] - other @ noise)[:, :DIM]
            rows = np.concatenate(((right * h).reshape(2 * n, DIM + 1), np.negative(other.T @ h)))
            step(1, *_sum_rows(np.concatenate((wanted, drawn)).astype(code), rows))
            back = np.matmul(g_h, m.transpose(0, 2, 1))
            step(2, np.arange(places), np.matmul(vectors.transpose(0, 2, 1), g_h))
            step(0, *_sum_rows(x.astype(code), back.reshape(places * n, DIM)))


def _one_of(x: np.ndarray) -> np.ndarray:
    """1 / (1 + e^x) in place."""
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _log_softmax(h: np.ndarray, vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probability of one of the vectors for each row of h."""
    s = h @ vectors.T
    own, top = s[np.arange(len(s)), at], max(0.0, float(s.max()) - 60)  # exp of 60 and sums of it stay finite
    if top:
        top = s.max(axis=1)
        s -= top[:, None]
    return own - top - np.log(np.exp(s, out=s).sum(axis=1))


class Stream:
    """Symbols of texts one after the other, each text behind n_places begins and closed by the end; yields contexts
    and targets chunk by chunk, whatever the batches in which texts are added."""

    def __init__(self, model: LogBilinear, end: int, size: int = CHUNK):
        self.places, self.begin, self.end, self.size = model.n_places, model.begin_of_text, end, size
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.parts += [np.full(self.places, self.begin, np.int64), symbols.astype(np.int64), np.array([self.end])]
        self.held += len(symbols) + self.places + 1
        if self.held >= self.size:
            yield from self._cut(False)

    def finish(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield from self._cut(True)

    def _cut(self, all_: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        flat = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)
        begin = 0
        while len(flat) - begin >= self.size or (all_ and len(flat) - begin > self.places):
            yield self.contexts(flat[begin : begin + self.size])
            begin += self.size - self.places  # the last places are context again
        self.parts = [flat[begin:]]
        self.held = len(flat) - begin

    def contexts(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(contexts (n, places), targets) in a stretch that begins with places symbols of context."""
        at = np.flatnonzero(flat[self.places :] != self.begin) + self.places
        return np.stack([flat[at - k - 1] for k in range(self.places)], axis=1), flat[at]


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held=None) -> DataFrame:
    """One row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (held_out(id_col) if held is None else held).alias("held"))
    train = rows.where(~F.col("held"))
    counts = materialize(word_counts(train), "word-counts")
    n_docs = train.select("held").count()
    seen = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_all, n_types = int(seen[0]) + n_docs, int(seen[1]) + (n_docs > 0)
    least = least_frequent(counts, "c", FREQUENT)
    frequent = counts.where(F.col("c") > least).toPandas().sort_values(["c", "word"], ascending=[False, True], ignore_index=True)  # at most FREQUENT rows
    names, amount = [w.encode() for w in frequent["word"]], frequent["c"].to_numpy(np.float64)
    n_common = int((amount >= COMMON_SHARE * n_all).sum())
    # the tails' tokens and types, over all words
    ends = F.pmod(F.crc32(F.substring("word", -2, 2).cast("binary")), F.lit(TAIL)).alias("tail")
    tails = counts.groupBy(ends).agg(F.sum("c"), F.count(F.lit(1))).collect()  # TAIL rows
    mass, types = np.zeros(TAIL), np.zeros(TAIL)
    for t, c, v in tails:
        mass[t], types[t] = c, v
    tail_at = np.array([tail_of(w) for w in names], np.int64)
    np.subtract.at(mass, tail_at[:n_common], amount[:n_common])
    np.subtract.at(types, tail_at[:n_common], 1)
    by_symbol = np.concatenate([amount[:n_common], mass, [n_docs]])
    order = np.argsort(-by_symbol, kind="stable")
    rank = np.empty(len(order), np.int64)  # the symbol of a common word, of a tail, of the end
    rank[order] = np.arange(len(order))
    model = LogBilinear(by_symbol[order])
    log_total = float(np.log10(n_all + (n_types + 1)))
    logs = np.log10(mass + types + 1)  # of the tails
    known = spark.sparkContext.broadcast((names, amount))
    end_base = float(np.log10(n_docs + 1)) - log_total

    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"id {kind}, held boolean, n_tokens long, n_known long, base double, inside double, symbols binary, rare array<string>, tails array<int>"
    coded = materialize(rows.mapInPandas(_coder(known, n_common, rank, log_total, logs, end_base, n_docs > 0), fields).withColumn("row_no", F.monotonically_increasing_id()), "lm-coded")
    shards = max(1, n_all // (2 * TOKENS_IN_SHARD))
    mixed = F.xxhash64("id", "symbols")
    learned = coded.where(~F.col("held")).select("symbols", mixed.alias("key"), F.pmod(F.shiftright(mixed, 1), F.lit(shards)).cast("int").alias("shard"))
    for half in (0, 1):
        dealt = learned.where(F.col("key").bitwiseAND(F.lit(1)) == half).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key")
        copies = materialize(dealt.mapInPandas(_trainer(model.counts, model.flat(), int(rank[-1])), "shard int, weights binary, params binary"), "lm-models")
        mean = _averaged(copies, shards)
        if mean is not None:
            weights, params = mean
            model.load(np.where(weights > 0, params / np.maximum(weights, 1e-9), model.flat()))
        discard(copies)

    scored = coded.drop("rare", "tails").mapInPandas(_scorer(model.counts, model.flat(), int(rank[-1])), f"id {kind}, held boolean, n_tokens long, n_known long, base double, row_no long, score double")
    scored = materialize(scored, "lm-scored")
    rest = counts.where(F.col("c") <= least)
    log_tail = F.element_at(F.array(*[F.lit(float(x)) for x in logs]), F.col("tail") + 1)
    c = F.coalesce("c", F.lit(0))
    rare = (
        coded.select("row_no", F.explode(F.arrays_zip(F.col("rare").alias("word"), F.col("tails").alias("tail"))).alias("__r")).select("row_no", "__r.word", "__r.tail").join(rest, "word", "left")
        .groupBy("row_no").agg(
            F.count_if(c > 0).alias("more_known"), F.sum(F.log10(c + 1.0) - F.lit(log_total)).alias("more_base"), F.sum(F.log10(c + 1.0) - log_tail).alias("more_score"),
        )
    )
    rare = materialize(rare, "lm-rare")
    discard(coded)
    zero = F.lit(0)
    return scored.join(rare, "row_no", "left").select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", zero)).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"), (F.col("score") + F.coalesce("more_score", zero)).alias("score"),
    )


def _coder(known, n_common: int, rank: np.ndarray, log_total: float, logs: np.ndarray, end_base: float, end_known: bool):
    """Texts to symbols, with what the counts of the frequent words give, and the words that are not among them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, counts = known.value
        place = {w.decode(): k for k, w in enumerate(names)}
        log_count = np.append(np.log10(counts + 1), 0.0)  # the last: not among the frequent
        tail = np.array([tail_of(w) for w in names] + [0], np.int64)
        symbol = np.where(np.arange(len(names) + 1) < n_common, rank[np.minimum(np.arange(len(names) + 1), max(n_common - 1, 0))], rank[n_common + tail])
        more = np.where(np.arange(len(names) + 1) < n_common, 0.0, log_count - logs[tail])
        more[-1] = 0.0
        memo: dict[str, int] = {}
        code = np.dtype("<u2" if len(rank) < 1 << 16 else "<u4")
        for b in batches:
            texts = b["text"].tolist()
            for x, y in slices(texts):
                words, number, lengths = flat_words(texts[x:y])
                at = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))[number]
                s, rare = symbol[at], np.flatnonzero(at < 0).tolist()
                text = np.repeat(np.arange(len(lengths)), lengths)
                rare_words: list[list[str]] = [[] for _ in lengths]
                tails: list[list[int]] = [[] for _ in lengths]
                for k, i, d in zip(rare, number[rare].tolist(), text[rare].tolist()):
                    w = words[i]
                    t = memo.get(w)
                    if t is None:
                        t = memo[w] = tail_of(w.encode())
                    s[k] = rank[n_common + t]
                    rare_words[d].append(w)
                    tails[d].append(t)
                if len(memo) > LOCAL_WORDS:
                    memo.clear()
                sums = lambda v, of=text: np.bincount(of, v, len(lengths))  # noqa: E731, B023
                n_frequent = sums(at >= 0)
                raw, edge = s.astype(code).tobytes(), (code.itemsize * np.concatenate(([0], np.cumsum(lengths)))).tolist()
                yield pd.DataFrame(
                    {
                        "id": b["id"].iloc[x:y].array, "held": b["held"].iloc[x:y].to_numpy(), "n_tokens": lengths + 1, "n_known": n_frequent.astype(np.int64) + end_known,
                        "base": end_base + sums(log_count[at]) - log_total * n_frequent, "inside": sums(more[at]), "symbols": [raw[i:j] for i, j in zip(edge[:-1], edge[1:])], "rare": rare_words, "tails": tails,
                    }
                )

    return run


def _symbols(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if n < 1 << 16 else "<u4").astype(np.int64)


def _trainer(counts: np.ndarray, flat: np.ndarray, end: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, learner = None, None
        for b in batches:
            for k, raw in zip(b["shard"].tolist(), b["symbols"]):
                if k != shard:
                    if learner:
                        yield learner.told()
                    shard, learner = k, _Learner(counts, flat, end, k)
                learner.learn(learner.stream.add(_symbols(raw, len(counts))))
        if learner:
            yield learner.told()

    return run


class _Learner:
    """A shard's copy of the model, and how often each of its vectors was met."""

    def __init__(self, counts: np.ndarray, flat: np.ndarray, end: int, shard: int):
        self.shard, self.model, self.rng = shard, LogBilinear(counts).load(flat), np.random.default_rng(shard)
        self.memory, self.stream = [np.zeros_like(p) for p in self.model.parts], Stream(self.model, end)
        self.contexts, self.targets = np.zeros(self.model.n + 1), np.zeros(self.model.n)

    def learn(self, chunks: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        for context, target in chunks:
            order = self.rng.permutation(len(target))
            self.model.train(context[order], target[order], self.memory, self.rng)
            self.contexts += np.bincount(context.ravel(), minlength=self.model.n + 1)
            self.targets += np.bincount(target, minlength=self.model.n)

    def told(self) -> pd.DataFrame:
        """Weights and weighted parameters, so that sums of them are averaged by how much was learned of each."""
        self.learn(self.stream.finish())
        m = self.model
        n = self.targets.sum()
        of_targets = np.concatenate((np.full(m.n_classes, n), self.targets + n * m.share))  # a symbol is moved as target and as noise
        weights = np.concatenate([np.repeat(self.contexts, DIM), np.repeat(of_targets, DIM + 1), np.full(m.parts[2].size, n)])
        return pd.DataFrame({"shard": pd.array([self.shard], "Int32"), "weights": [weights.tobytes()], "params": [(weights * m.flat()).tobytes()]})


def _averaged(copies: DataFrame, shards: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(sums of weights, sums of weighted parameters) over all shards, by a tree of tasks with at most TREE models each."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        total = [sum(np.frombuffer(raw) for raw in pdf[c]).tobytes() for c in ("weights", "params")]
        return pd.DataFrame({"shard": pd.array([pdf["shard"].iat[0] // TREE], "Int32"), "weights": [total[0]], "params": [total[1]]})

    while shards > 1:
        copies, shards = copies.groupBy(F.floor(F.col("shard") / TREE).alias("grp")).applyInPandas(add, "shard int, weights binary, params binary"), -(-shards // TREE)
    last = copies.select("weights", "params").first()
    return last and (np.frombuffer(last["weights"]), np.frombuffer(last["params"]))


def _scorer(counts: np.ndarray, flat: np.ndarray, end: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = LogBilinear(counts).load(flat)
        for b in batches:
            total, seen = np.zeros(len(b)), 0
            stream = Stream(own, end)
            ends = np.cumsum(b["n_tokens"].to_numpy())
            for chunk in chunks(stream, b["symbols"], own.n):
                logs = own.log_probs(*chunk).astype(np.float64)
                total += np.bincount(np.searchsorted(ends, seen + np.arange(len(logs)), "right"), logs, len(b))
                seen += len(logs)
            yield b.drop(columns=["symbols", "inside"]).assign(score=total / np.log(10) + b["inside"].to_numpy())

    def chunks(stream: Stream, raws: pd.Series, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for raw in raws:
            yield from stream.add(_symbols(raw, n))
        yield from stream.finish()

    return run


def op4_lm_scores(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
