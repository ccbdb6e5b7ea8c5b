"""Quality rules on repetition: characters inside duplicated n-grams and lines.

Rolling hashes of several n-gram lengths mark, for each text, the n-grams that occur again; the
share of word characters they cover is held against a limit for each length, as is the share of
the commonest 2- to 4-gram and that of duplicated lines (limits as published for web text filters).

Defined cases: null text has no words and fails the base rule (fewer than 20 words); very long texts
are measured whole, in memory for some 100 bytes a word; repeated rows are judged alike; an empty table gives an empty result; other
columns are carried along, but for one named rules, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_arrays import TextArrays, covered, ngram_hashes, repeated



@dataclass(frozen=True)
class Limits:
    """What a text may repeat. The shares are the published limits for web text; the least sizes keep short texts
    from failing by one repeated name or sentence."""

    # fixed values: limits on shares of word characters (or of lines)
    top_ngram: tuple = ((2, 0.20), (3, 0.18), (4, 0.16))
    duplicated_ngrams: tuple = ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10))
    duplicated_lines: float = 0.30
    duplicated_line_chars: float = 0.20
    # least sizes
    top_ngram_times: int = 3  # the commonest n-gram counts if it occurs so often
    duplicated_words: int = 15  # duplicated n-grams count if they cover so many words
    duplicated_lines_of: int = 10  # the share of lines counts in so many lines; that of their characters always


SYMBOLS = b"#*$%&|<>"
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, top_share double, dup_share double, dup_line_share double, dup_line_char_share double, repetitive boolean"


def measure(text: str | None, limits: Limits = Limits()) -> tuple:
    t = TextArrays(text)
    chars, n = max(1, t.word_chars), t.n_words
    words = t.words()
    lines, line_chars = t.lines()
    line_again = repeated(lines)[1]
    grams = {k: ngram_hashes(words, k) for k, _ in (*limits.top_ngram, *limits.duplicated_ngrams)}
    sums = np.concatenate(([0], np.cumsum(t.chars)))
    bad, top_share, dup_share, repeat_words = False, 0.0, 0.0, 0
    for k, limit in limits.top_ngram:
        h = grams[k]
        if len(h):
            _, first, count = np.unique(h, return_index=True, return_counts=True)
            most = count.max()
            if most > 1:
                own = np.zeros(len(h), bool)
                best = max((int(sums[i + k] - sums[i]), int(i)) for i in first[count == most])[1]
                own[h == h[best]] = True
                share = t.chars[covered(own, k, n)].sum() / chars
                top_share, bad = max(top_share, share), bad or share > limit and most >= limits.top_ngram_times
    for k, limit in limits.duplicated_ngrams:
        twice, again = repeated(grams[k], words, k)
        if k == 8:
            repeat_words = int(covered(twice, 8, n).sum()) if len(twice) else 0
        if again.any():
            own = covered(again, k, n)
            share = t.chars[own].sum() / chars
            dup_share, bad = max(dup_share, share), bad or share > limit and own.sum() >= limits.duplicated_words
    line_share = line_again.mean() if len(lines) else 0.0
    line_char_share = line_chars[line_again].sum() / chars
    bad = bad or line_share > limits.duplicated_lines and len(lines) >= limits.duplicated_lines_of or line_char_share > limits.duplicated_line_chars
    n_symbols = len(t.raw) - len(t.raw.translate(None, SYMBOLS))
    return n, t.word_chars, n_symbols, int(line_again.sum()), repeat_words, float(top_share), float(dup_share), float(line_share), float(line_char_share), bool(bad)


def quality_rules(docs: DataFrame, text_col: str = "text", min_words: int = 20, max_repeat_percent: int = 30, limits: Limits = Limits()) -> DataFrame:
    """docs with a struct column rules (in place of a column of that name): the measures, base_failed, kept."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in FIELDS.split(", ")]
        for b in batches:
            yield pd.DataFrame([measure(t, limits) for t in b], columns=names)

    measured = F.pandas_udf(run, FIELDS)(F.col(text_col))
    base = (F.col("rules.n_words") < min_words) | (100 * F.col("rules.n_repeat_words") > max_repeat_percent * F.col("rules.n_words"))
    return docs.withColumn("rules", measured).withColumn("rules", F.struct("rules.*", base.alias("base_failed"), (~base & ~F.col("rules.repetitive")).alias("kept")))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "rules.*")
