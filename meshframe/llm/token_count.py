"""Token counts by a compiled finite-state transducer.

The tokenizer's merges are compiled into a deterministic transducer over bytes, determinised as
its states are met. A state holds the bytes that a token still open may begin in (the longest
suffix that begins some token), and for each place among them the last token of the encoding up to
there and how many tokens it is short of the present count. Reading a byte, the one token that
ends there and stays apart from the last token before its beginning (a compatible pair) is the last
token of the longer prefix; the change of the count is written on the transition. So the count of a
word is the sum of its transitions, without running the merges.

A long text is cut into chunks of CHUNK bytes anywhere, in the middle of words too. The pattern's places, where the
transducer starts afresh, are found first, a block at a time. The map of a chunk sends a state in which it may begin to
the state in which it ends and the tokens emitted. It is made for the state that the bytes shortly before the chunk
lead to; that state is sure if a place of the pattern lies among them, and a guess otherwise. Maps compose
associatively, and all chunks' maps are combined by a prefix scan of doubling distance in numpy; where the scan shows that
a chunk begins in a state its map lacks, the map is extended by it. States are kept by their
contents, so the transducer may forget its numbers between chunks.

Defined cases: null text counts as empty (0 bytes, 0 tokens); very long texts, with or without blanks, take
memory for their bytes and one block's places; ids and repeated rows are carried as they are; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import CUT, LETTERS, MARKS, byte_letters, slices, split_words, whole

CHUNK = 1 << 14  # bytes of a chunk; longer texts are counted by chunks
BLOCK = 1 << 22  # characters whose places are found at once
LOOK_BACK = 256  # bytes before a chunk that tell its first state
KNOWN_WORDS = 500_000
MAX_STATES = 200_000
MAX_PAIRS = 1_000_000
# state of the transducer: open bytes; last token at each place among them; tokens short there. -1: the word's begin
State = tuple[bytes, tuple[int, ...], tuple[int, ...]]
START: State = (b"", (-1,), (0,))
# fixed value: the published pattern of byte-level tokenizers
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class BytePairTransducer:
    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.vocab = vocab
        self.bytes_of = {i: b for b, i in vocab.items()}
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.prefixes = {b[:k] for b in vocab for k in range(len(b) + 1)}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states but the first, and the pairs if they are many."""
        if len(self.pairs) > MAX_PAIRS:
            self.pairs = {}
        self.keys = [START]
        self.number = {self.keys[0]: 0}
        self.arcs: list[dict[int, tuple[int, int]]] = [{}]

    def merged(self, word: bytes) -> list[bytes]:
        """The encoding by its definition: the first pair of least rank is merged, again and again."""
        parts = [word[k : k + 1] for k in range(len(word))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts[:-1], parts[1:])]
            low = min(ranks)
            if low == 1 << 60:
                break
            k = ranks.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """True if tokens a and b stay apart when they are encoded together."""
        got = self.pairs.get((a, b))
        if got is None:
            x, y = self.bytes_of[a], self.bytes_of[b]
            got = self.pairs[a, b] = self.merged(x + y) == [x, y]
        return got

    def arc(self, state: int, byte: int) -> tuple[int, int]:
        """Compile the transition of state on byte: the next state and the tokens emitted."""
        open_, last, short = self.keys[state]
        s = open_ + bytes((byte,))
        for k in range(len(s)):
            token = self.vocab.get(s[k:])
            if token is not None and (last[k] == -1 or self.compatible(last[k], token)):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        emitted = short[k] + 1
        keep = next(j for j in range(len(s) + 1) if s[j:] in self.prefixes)
        key = (s[keep:], last[keep:] + (token,), tuple(c - emitted for c in short[keep:]) + (0,))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.keys)
            self.keys.append(key)
            self.arcs.append({})
        got = self.arcs[state][byte] = (to, emitted)
        return got

    def run(self, begin: State, data: bytes) -> tuple[State, int]:
        """The state after data from the state begin on, and the tokens emitted."""
        n, state = 0, self.numbered(begin)
        for k in range(0, len(data), CHUNK):
            arcs = self.arcs
            for byte in data[k : k + CHUNK]:
                go = arcs[state].get(byte) or self.arc(state, byte)
                state, n = go[0], n + go[1]
            if len(self.keys) > MAX_STATES:
                end = self.keys[state]
                self.reset()
                state = self.numbered(end)
        return self.keys[state], n

    def numbered(self, key: State) -> int:
        got = self.number.get(key)
        if got is None:
            got = self.number[key] = len(self.keys)
            self.keys.append(key)
            self.arcs.append({})
        return got

    def count(self, word: bytes) -> int:
        return self.run(START, word)[1]


class ChunkMaps:
    """Maps of the chunks of some bytes: from a state at the chunk's begin to the state at its end, and the tokens emitted."""

    def __init__(self, data: bytes, places: np.ndarray, machine: BytePairTransducer, known: dict[bytes, int]):
        """places: where the pattern's matches begin, the first at 0."""
        self.data, self.places, self.machine = data, places, machine
        self.n = -(-len(data) // CHUNK)
        self.maps: list[dict[State, tuple[State, int]]] = [{} for _ in range(self.n)]
        edges = np.searchsorted(places, np.arange(self.n + 1) * CHUNK)
        self.first = [int(places[i]) if i < j else -1 for i, j in zip(edges[:-1], edges[1:])]  # first place in the chunk
        self.rest: list[tuple[State, int]] = []  # from there to the chunk's end
        for k, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            n, at = 0, places[i:j].tolist()
            for x, y in zip(at[:-1], at[1:]):
                word = data[x:y]
                got = known.get(word)
                if got is None:
                    got = known[word] = machine.count(word)
                n += got
            state, more = machine.run(START, data[at[-1] : (k + 1) * CHUNK]) if at else (START, 0)
            self.rest.append((state, n + more))
            begin = k * CHUNK
            back = max(int(places[i - 1]) if i else 0, begin - LOOK_BACK)
            self.extend(k, machine.run(START, data[back:begin])[0])

    def extend(self, k: int, state: State) -> State:
        """Define chunk k's map at a state; the state in which it ends then."""
        first = self.first[k]
        to, n = self.machine.run(state, self.data[k * CHUNK : first if first >= 0 else (k + 1) * CHUNK])
        if first >= 0:
            to, n = self.rest[k][0], n + self.rest[k][1]
        self.maps[k][state] = to, n
        return to

    def scanned(self) -> tuple[np.ndarray, np.ndarray]:
        """Prefix scan from the start state: the number of the state (in the order of its chunk's map) in which each next
        chunk begins, -1 if its map lacks it, and the tokens up to there."""
        width, numbers = max(map(len, self.maps)), [{s: i for i, s in enumerate(m)} for m in self.maps] + [None]
        to, n = np.full((self.n, width), -1), np.zeros((self.n, width), np.int64)
        for k, m in enumerate(self.maps):
            for i, (end, emitted) in enumerate(m.values()):
                to[k, i], n[k, i] = 0 if numbers[k + 1] is None else numbers[k + 1].get(end, -1), emitted
        step = 1
        while step < self.n:  # map k becomes that of the chunks k - 2 * step + 1 to k
            before, count = to[:-step], n[:-step]
            n[step:] = count + np.where(before >= 0, np.take_along_axis(n[step:], np.maximum(before, 0), 1), 0)
            to[step:] = np.where(before >= 0, np.take_along_axis(to[step:], np.maximum(before, 0), 1), -1)
            step *= 2
        return to[:, 0], n[:, 0]  # the first state of the first chunk's map is the start

    def total(self) -> int:
        while True:
            to, n = self.scanned()
            lacking = np.flatnonzero(to[:-1] < 0)
            if not len(lacking):
                return int(n[-1])
            k = int(lacking[0])  # its state is known, that after it is not in the next map: go on to one that is
            state = list(self.maps[k])[to[k - 1]] if k else START
            state = self.maps[k][state][0]
            while k + 1 < self.n and state not in self.maps[k + 1]:
                k += 1
                state = self.extend(k, state)


class TokenCounter:
    """Counts of texts, equal to len(Tokenizer.encode(text, add_special_tokens=False).ids)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
            raise ValueError("only byte-level BPE files are compiled")
        of = byte_letters()
        raw = lambda s: bytes(of[c] for c in s)
        special = {t["content"] for t in spec["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.machine = BytePairTransducer({raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}, [(raw(a), raw(b)) for a, b in merges])
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}
        self.marks: dict[str, int] = {}
        self.words: dict[bytes, int] = {}

    def _between(self, text: str) -> int:
        """Tokens of a text that begins and ends at sure cuts."""
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(self.machine.count(m.group().encode("utf-8", "surrogatepass")) for p in parts for m in self.pattern.finditer(p))

    def _words(self, text: str) -> int:
        """Tokens of a text between sure cuts, by its words."""
        known, total = self.known, -1  # without the line feed put before the first word
        parts = split_words(text)
        try:
            return sum([known[p] for p in parts]) + total
        except KeyError:
            pass
        if all(map(whole, set(parts).difference(known))):
            for p in set(parts).difference(known):
                known[p] = self._word(p)
            return sum([known[p] for p in parts]) + total
        return sum(self._between(p) for p in CUT.split(text) if p)

    def _word(self, word: str) -> int:
        """Tokens of a word and its blank; letters and the marks behind them (the pattern cuts between) are remembered apart."""
        body = word.rstrip(MARKS)
        if not body or not LETTERS.issuperset(body):
            return self._between(word if word[0] == "\n" else " " + word)
        n = self.known.get(body)
        if n is None:
            n = self.known[body] = self.machine.count(b" " + body.encode())
        return n + (self._mark(word[len(body) :]) if len(body) < len(word) else 0)

    def _mark(self, marks: str) -> int:
        got = self.marks.get(marks)
        if got is None:
            got = self.marks[marks] = self._between(marks)
        return got

    def _long(self, text: str) -> int:
        """Tokens of a text without special tokens, block by block; a block ends where a match of the pattern begins."""
        total, begin, places = 0, 0, []
        for m in self.pattern.finditer(text):
            at = m.start()
            if at - begin >= BLOCK:
                total += self._block(text[begin:at], places)
                begin, places = at, []
            places.append(at - begin)
        return total + self._block(text[begin:], places)

    def _block(self, text: str, places: list[int]) -> int:
        if not text:
            return 0
        data, at = text.encode("utf-8", "surrogatepass"), np.array(places, np.int64)
        if len(data) > len(text):
            at = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[at]
        n = ChunkMaps(data, at, self.machine, self.words).total()
        if len(self.words) > KNOWN_WORDS:
            self.words = {}
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(text) <= CHUNK:
            n = self._words(text)
        else:
            parts = self.special.split(text) if self.special else [text]
            n = len(parts) - 1 + sum(map(self._long, parts))
        if len(self.known) > KNOWN_WORDS:
            self.known, self.marks = {}, {}
        return n


@lru_cache(maxsize=4)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(tokenizer)
        for b in batches:
            texts = b["text"].tolist()
            for x, y in slices(texts):
                yield pd.DataFrame({"id": b["id"].iloc[x:y].array, "n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in texts[x:y]], "n_tokens": [own.count(t) for t in texts[x:y]]})

    kind = docs.schema[id_col].dataType.simpleString()
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, n_bytes long, n_tokens long")
    return got.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
