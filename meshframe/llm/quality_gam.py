"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into quantile bins. Shallow trees, fitted in turn on one feature at a
time (cyclic boosting with a small step), add to that feature's lookup table of log odds; then the
pairs that still reduce the loss most get two-dimensional tables in the same way. A score is the
logistic of the intercept and the looked-up values, one vectorised addition for each table.

Learning takes at most MAX_TRAIN labelled rows (of a hash order of the ids, so the same at any
size of cluster); scoring reads every row and whole texts.

Defined cases: null text is empty and is scored like any text; rows without a label are only
scored; several labels of a row count as several rows; without any label all scores are 0.5; ties
and repeated rows score alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_arrays import TextArrays, covered, ngram_hashes, repeated

MAX_TRAIN = 20_000  # labelled rows used for fitting; their features (3 MB) reach the driver
FEATURES = [
    "log_words", "mean_word", "sd_word", "upper", "digit", "symbol", "exclaim", "stop_marks", "bars", "non_ascii", "distinct", "same_next", "repeat_2", "repeat_8", "dup_lines", "line_words", "capital_lines",
    "closed_lines", "short_words", "quotes_links",
]
_KIND = np.zeros((8, 256), bool)
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@~^=_{}[]\\", b"!", b".,;:?", b"|", bytes(range(128, 256)), b"\"'()/")):
    _KIND[_k, list(_set)] = True


def features(text: str | None) -> np.ndarray:
    t = TextArrays(text)
    n, chars = max(1, t.n_words), max(1, t.word_chars)
    by_byte = np.bincount(t.bytes, minlength=256)
    upper, digit, symbol, exclaim, marks, bars, high, quotes = (by_byte[k].sum() for k in _KIND)
    words = t.words()
    line_hash, line_chars = t.lines()
    two, eight = (repeated(ngram_hashes(words, k))[0] for k in (2, 8))
    ends = np.flatnonzero(t.bytes == 10)
    closers = t.bytes[np.concatenate((ends[ends > 0] - 1, [len(t.bytes) - 1] if len(t.bytes) else [])).astype(np.int64)] if len(t.bytes) else t.bytes
    openers = t.bytes[np.concatenate(([0], ends[ends < len(t.bytes) - 1] + 1)).astype(np.int64)] if len(t.bytes) else t.bytes
    return np.array(
        [
            np.log1p(t.n_words), t.word_chars / n, t.chars.std() if t.n_words else 0, upper / chars, digit / chars, symbol / n, exclaim / n, marks / n, bars / n, high / max(1, len(t.bytes)),
            len(np.unique(words)) / n, (words[1:] == words[:-1]).sum() / n, two.sum() / n, covered(eight, 8, t.n_words).sum() / n if len(eight) else 0,
            repeated(line_hash)[1].sum() / max(1, len(line_hash)), t.n_words / max(1, len(line_hash)), _KIND[0, openers].mean() if len(openers) else 0, np.isin(closers, list(b".!?\"")).mean() if len(closers) else 0,
            (t.chars <= 3).sum() / n, quotes / n,
        ]
    )


def feature_table(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """The columns keep and x, the text's features."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([features(t) for t in b])

    return docs.select(*keep, F.pandas_udf(run, "array<double>")(F.col(text_col)).alias("x"))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, smooth: float = 5.0) -> np.ndarray:
    """Newton steps of a tree of the given depth over ordered bins with gradients g and curvatures h."""
    out = np.zeros(len(g))

    def grow(a: int, b: int, d: int) -> None:
        total_g, total_h = g[a:b].sum(), h[a:b].sum()
        if d and b - a > 1:
            lg, lh = np.cumsum(g[a : b - 1]), np.cumsum(h[a : b - 1])
            gain = lg**2 / (lh + smooth) + (total_g - lg) ** 2 / (total_h - lh + smooth)
            k = int(gain.argmax())
            if gain[k] > total_g**2 / (total_h + smooth) + 1e-9:
                grow(a, a + k + 1, d - 1)
                grow(a + k + 1, b, d - 1)
                return
        out[a:b] = total_g / (total_h + smooth)

    grow(0, len(g), depth)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, smooth: float = 5.0) -> tuple[float, np.ndarray]:
    """The best pair of cuts of a two-dimensional table: its gain, and the steps of the four parts."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for c in (cg, ch):
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        parts.append(np.stack([a, b, d, c[-1, -1] - a - b - d]))
    gain = (parts[0] ** 2 / (parts[1] + smooth)).sum(0)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    step = parts[0][:, i, j] / (parts[1][:, i, j] + smooth)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = step
    return float(gain[i, j]), out


class PairwiseGAM:
    """Lookup tables for each feature and for the chosen pairs."""

    def __init__(self, n_bins: int = 32, pair_bins: int = 8, rounds: int = 120, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.15):
        self.n_bins, self.pair_bins, self.rounds, self.n_pairs, self.pair_rounds, self.rate = n_bins, pair_bins, rounds, pairs, pair_rounds, rate

    def fit(self, x: np.ndarray, y: np.ndarray) -> PairwiseGAM:
        cut = lambda n: [np.unique(np.quantile(c, np.linspace(0, 1, n + 1)[1:-1])) for c in x.T] if len(x) else [np.zeros(0)] * x.shape[1]
        self.edges, self.pair_edges = cut(self.n_bins), cut(self.pair_bins)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs, self.pair_tables = [], []
        p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        self.intercept = float(np.log(p / (1 - p)))
        if not len(y):
            return self
        bins = [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)]
        score = np.full(len(y), self.intercept)
        for _ in range(self.rounds):
            for f, b in enumerate(bins):
                q = 1 / (1 + np.exp(-score))
                n = len(self.tables[f])
                step = self.rate * _tree(np.bincount(b, y - q, n), np.bincount(b, q * (1 - q), n), 2)
                self.tables[f] += step
                score += step[b]
        few = [np.searchsorted(e, c, "right") for e, c in zip(self.pair_edges, x.T)]

        def table(f: int, g: int) -> tuple[float, np.ndarray, np.ndarray]:
            q = 1 / (1 + np.exp(-score))
            shape = (len(self.pair_edges[f]) + 1, len(self.pair_edges[g]) + 1)
            at = few[f] * shape[1] + few[g]
            grad, curve = (np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (y - q, q * (1 - q)))
            return (*_quarters(grad, curve), at) if min(shape) > 1 else (0.0, np.zeros(shape), at)

        gains = sorted(((table(f, g)[0], f, g) for f, g in combinations(range(x.shape[1]), 2)), reverse=True)
        self.pairs = [(f, g) for gain, f, g in gains[: self.n_pairs] if gain > 0]
        self.pair_tables = [np.zeros((len(self.pair_edges[f]) + 1, len(self.pair_edges[g]) + 1)) for f, g in self.pairs]
        for _ in range(self.pair_rounds):
            for k, (f, g) in enumerate(self.pairs):
                _, step, at = table(f, g)
                self.pair_tables[k] += self.rate * step
                score += self.rate * step.ravel()[at]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for e, t, c in zip(self.edges, self.tables, x.T):
            total += t[np.searchsorted(e, c, "right")]
        for (f, g), t in zip(self.pairs, self.pair_tables):
            total += t[np.searchsorted(self.pair_edges[f], x[:, f], "right"), np.searchsorted(self.pair_edges[g], x[:, g], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learned from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> PairwiseGAM:
    """Fit on at most max_train labelled rows that are not held out."""
    chosen = labels.where(~held_out(id_col) & F.col(label_col).isNotNull()).select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("y")).orderBy(F.xxhash64("label_id"), "label_id", "y").limit(max_train)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = feature_table(own.join(F.broadcast(chosen), F.col("id") == F.col("label_id")), ["id", "y"], "text").orderBy("id").limit(max_train).toPandas()  # chosen: at most max_train rows
    x = np.array(rows["x"].tolist()).reshape(-1, len(FEATURES))
    return PairwiseGAM().fit(x, rows["y"].to_numpy(float))


def score_quality(docs: DataFrame, model: PairwiseGAM, text_col: str = "text") -> DataFrame:
    """docs and a column score, 0 to 1, higher: label 1 is likelier."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(model.score(np.array([features(t) for t in b]).reshape(-1, len(FEATURES))))

    return docs.withColumn("score", F.pandas_udf(run, "double")(F.col(text_col)))


def op7_quality_gam(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
