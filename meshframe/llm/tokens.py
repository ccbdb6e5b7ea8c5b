"""Byte-level BPE ids of whole texts by the tokenizers library, one word at a time.

The library's pattern never matches across the place between a non-space character and a
following blank or line feed, so a text may be cut there and the ids of the pieces joined.
Words repeat, hence each new word of a batch is given to the library once and its ids kept; the ids
of a batch are then gathered by numpy from those of its distinct words.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CUT = re.compile(r"(?<=\S)(?=[ \n])")
CACHE_WORDS = 300_000  # words whose ids a worker keeps between batches (about 70 MB)
CACHE_BODIES = 500_000  # and words without the marks behind them (about 70 MB)
LEARN_AT_ONCE = 4000
SLICE_CHARS = 4_000_000  # texts are encoded in slices of about this size
UNSIGNED = next(k for k in "IL" if array(k).itemsize == 4)  # array code of 32 bits
MARKS = ".,;:!?*#$%&|<>"
LETTERS = {c for c in map(chr, range(0x250)) if c.isalpha()}


def slices(texts: list[str | None], chars: int = SLICE_CHARS):
    """Consecutive slices (begin, end) of about so many characters."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def whole(part: str) -> bool:
    """True for a word that neither starts (after its line feed) nor ends with white space."""
    body = part[1:] if part[:1] == "\n" else part
    return body != "" and not body[0].isspace() and not body[-1].isspace()


def line_words(text: str | None) -> str:
    """The text with a blank before each line feed, behind a line feed."""
    return "\n" + (text or "").replace("\n", " \n")


def split_words(text: str) -> list[str]:
    """Words of a text; those behind a line feed keep it, the first gets one, the others lose their blank."""
    return line_words(text).split(" ")


def cut_words(text: str) -> list[str]:
    """Slow form of split_words for texts with other white space: pieces from one sure cut to the next."""
    return [p for p in CUT.split(text) if p]


def byte_letters() -> dict[str, int]:
    """The characters in which byte-level vocabularies print the 256 bytes: printable ones as themselves, others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class SegmentEncoder:
    """Little-endian unsigned 32-bit ids of texts, equal to Tokenizer.encode(text, add_special_tokens=False)."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, cache_bodies: int = CACHE_BODIES):
        from tokenizers import Tokenizer

        self.cache_words, self.cache_bodies = cache_words, cache_bodies
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.cuttable = (
            spec.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
        )
        size = self.tokenizer.get_vocab_size()
        self.starts = np.zeros(size, bool)  # tokens that begin with a blank or a line feed
        for token, i in self.tokenizer.get_vocab().items():
            self.starts[i] = token[0] in "ĠĊ"
        self.known: dict[str, bytes] = {}
        self.bodies: dict[str, bytes] = {}
        printed = {b: c for c, b in byte_letters().items()}
        self.printed = {b: printed[b] for b in range(256)}

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _bodies(self, bodies: list[str]) -> None:
        """Ids of a blank and letters only: one match of the pattern, so the library's model alone does."""
        tokenize, known = self.tokenizer.model.tokenize, self.bodies
        for body in bodies:
            printed = body if body.isascii() else body.encode().decode("latin-1").translate(self.printed)
            known[body] = array(UNSIGNED, [t.id for t in tokenize("Ġ" + printed)]).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Ids of new words; those that begin or end with other white space are left out."""
        known, bodies, letters, rest, apart = self.known, self.bodies, LETTERS.issuperset, [], []
        for w in words:  # letters, then perhaps marks: the pattern always cuts behind the last letter
            body = w.rstrip(MARKS)
            if body and letters(body):
                apart.append((w, body))
            elif whole(w):
                rest.append(w)
        self._bodies(list({body for _, body in apart if body not in bodies}))
        for w, body in apart:
            known[w] = bodies[body] if len(w) == len(body) else bodies[body] + self._mark(w[len(body) :])
        self._learn_joined(rest)

    def _mark(self, tail: str) -> bytes:
        got = self.bodies.get(tail)
        if got is None:
            got = self.bodies[tail] = self.ids(tail)
        return got

    def _learn_joined(self, words: list[str]) -> None:
        for k in range(0, len(words), LEARN_AT_ONCE):
            some = words[k : k + LEARN_AT_ONCE]
            whole_ids = np.array(self.tokenizer.encode("".join([w if w[0] == "\n" else " " + w for w in some]), add_special_tokens=False).ids, "<u4")
            at = np.flatnonzero(self.starts[whole_ids])
            if len(at) == len(some):
                blob, ends = whole_ids.tobytes(), [*(4 * at[1:]).tolist(), 4 * len(whole_ids)]
                begin = 0
                for w, end in zip(some, ends):
                    self.known[w] = blob[begin:end]
                    begin = end
            else:
                for w in some:
                    self.known[w] = self.ids(w if w[0] == "\n" else " " + w)

    def _slowly(self, text: str) -> bytes:
        out, known = [], self.known
        for p in cut_words(text):
            word = p[1:] if p[0] == " " and p[1:2] != "\n" else p
            got = known.get(word) if p[0] in " \n" and whole(word) else None
            out.append(self.ids(p) if got is None else got)
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for a, b in slices(texts):
            ids, lengths = self.flat(texts[a:b])
            raw, ends = ids.tobytes(), np.cumsum(4 * lengths).tolist()
            out += [raw[x:y] for x, y in zip([0, *ends[:-1]], ends)]
        return out

    def flat(self, texts: list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, their number in each); end_id, if given, closes each text."""
        if not texts:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if not self.cuttable:
            return self._joined([self.ids(t or "") for t in texts], end_id)
        lines = [line_words(t) for t in texts]
        words = pc.split_pattern(pa.array([" ".join(lines)], pa.large_string()), " ").values.dictionary_encode()
        at, new = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known
        self._learn([w for w in new if w not in known])
        own = [known.get(w) for w in new]
        if len(known) > self.cache_words:
            self.known = {w: i for w, i in zip(new, own) if i is not None} if len(new) <= self.cache_words else {}
        if len(self.bodies) > self.cache_bodies:
            self.bodies = {}
        n_words = np.array([t.count(" ") + 1 for t in lines], np.int64)
        size = np.array([len(i) // 4 if i else 0 for i in own], np.int64)
        begin = np.cumsum(size) - size
        each = size[at]
        ends = np.cumsum(each)
        ids = np.frombuffer(b"".join([i for i in own if i]), "<u4")[np.repeat(begin[at] - (ends - each), each) + np.arange(ends[-1])]
        last = ends[np.cumsum(n_words) - 1]
        first = np.concatenate(([0], last[:-1]))  # the line feed put before each text
        odd = np.array([i is None for i in own])
        if odd.any():  # texts with words that the library must see in their place
            slow = np.logical_or.reduceat(odd[at], np.cumsum(n_words) - n_words)
            return self._joined([self._slowly(t or "") if s else ids[x + 1 : y].tobytes() for t, s, x, y in zip(texts, slow.tolist(), first.tolist(), last.tolist())], end_id)
        if end_id is None:
            return np.delete(ids, first), last - first - 1
        ids[first] = end_id
        return np.append(ids[1:], np.array(end_id, "<u4")), last - first

    def _joined(self, parts: list[bytes], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        parts = [p + end for p in parts]
        return np.frombuffer(b"".join(parts), "<u4"), np.array([len(p) // 4 for p in parts], np.int64)


@lru_cache(maxsize=4)
def encoder(path: str, cache_words: int = CACHE_WORDS, cache_bodies: int = CACHE_BODIES) -> SegmentEncoder:
    """One encoder for each tokenizer file and worker process."""
    return SegmentEncoder(path, cache_words, cache_bodies)
