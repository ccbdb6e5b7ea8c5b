"""Token ids in fixed-width bit-packed files with block offsets.

A file: a head (magic, bits, ids in a block), the blocks, and a foot: the byte offset of each block, the
documents' ids, null marks and ends, and last the numbers of ids, documents and blocks, the foot's
place and the magic again (all little-endian). Every id takes the fewest bits that hold the vocabulary;
a block is packed on its own and written at once, so that a task holds one block, and numpy unpacks
blocks whole; any range of ids is read by seeking to its blocks.

Texts are encoded where they are read, and only their ids, in two bytes each if the vocabulary allows, are dealt to ranges of documents' ids between
approximate percentiles.
Files are written by tasks through pyarrow's file systems below the cluster's shared folder, each
attempt of a task under a name of its own; the manifest, which Spark commits once for each task,
names the file that counts, so repeated and speculative tasks do no harm.

Defined cases: null text is empty and yields the end id alone; a null document id sorts first and
stays null; rows that repeat an id follow each other, in an order by their contents and over as many files as they fill; very long texts are written
block by block; an empty
table makes no file with documents; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, scratch_path
from .tokens import encoder, slices

MAGIC = b"BITPACK1"
HEAD = struct.Struct("<8sII")
FOOT = struct.Struct("<QQQQ8s")
BLOCK = 4096
FIRST = -(1 << 63)  # where null ids stand


def width(vocab_size: int) -> int:
    """The fewest bits that hold ids below vocab_size."""
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (unsigned 32-bit) as a stream of bits-wide fields, lowest bit first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return raw[:, : bits // 8].tobytes()
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if bits % 8 == 0:
        out = np.zeros((count, 4), np.uint8)
        out[:, : bits // 8] = raw[: count * bits // 8].reshape(count, bits // 8)
    else:
        fields = np.zeros((count, 32), np.uint8)
        fields[:, :bits] = np.unpackbits(raw, bitorder="little")[: count * bits].reshape(count, bits)
        out = np.packbits(fields, axis=1, bitorder="little")
    return out.view("<u4").ravel()


class TokenWriter:
    """Appends ids to a new file, block by block; close() writes the foot."""

    def __init__(self, path: str, bits: int, block: int):
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(path)
        store.create_dir(place.rsplit("/", 1)[0])
        self.file, self.bits, self.block = store.open_output_stream(place), bits, block
        self.file.write(HEAD.pack(MAGIC, bits, block))
        self.rest, self.n_ids, self.offsets = np.zeros(0, "<u4"), 0, [0]

    def append(self, ids: np.ndarray) -> None:
        ids = np.concatenate((self.rest, ids)) if len(self.rest) else ids
        full = len(ids) // self.block * self.block
        self._write(pack(ids[:full], self.bits), full)
        self.rest = ids[full:].copy()

    def _write(self, data: bytes, n: int) -> None:
        """n ids; block * bits is a whole number of bytes, so blocks packed together are the blocks packed alone."""
        size = self.block * self.bits // 8
        self.file.write(data)
        last = self.offsets[-1]
        self.offsets += [min(k + size, last + len(data)) for k in range(last, last + len(data), size)]
        self.n_ids += n

    def close(self, doc_ids: list, lengths: np.ndarray) -> None:
        if len(self.rest):
            self._write(pack(self.rest, self.bits), len(self.rest))
        missing = np.array([d is None for d in doc_ids], np.uint8)
        self.file.write(np.array(self.offsets, "<u8").tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + missing.tobytes() + np.cumsum(lengths, dtype=np.int64).astype("<u8").tobytes())
        self.file.write(FOOT.pack(self.n_ids, len(doc_ids), len(self.offsets) - 1, HEAD.size + self.offsets[-1], MAGIC))
        self.file.close()


class TokenFile:
    """Random access to a file: documents, and any range of ids."""

    def __init__(self, path: str):
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(place)
        size = self.file.size()
        magic, self.bits, self.block = HEAD.unpack(self._read(0, HEAD.size)) if size >= HEAD.size + FOOT.size else (b"", 0, 0)
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        self.n_ids, self.n_docs, n_blocks, foot, magic = FOOT.unpack(self._read(size - FOOT.size, FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"{path} has no foot")
        data, at, self.payload = self._read(foot, size - FOOT.size - foot), 0, HEAD.size
        parts = []
        for kind, n in (("<u8", n_blocks + 1), ("<i8", self.n_docs), ("u1", self.n_docs), ("<u8", self.n_docs)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        self.offsets, self.doc_ids, self.missing, self.ends = parts

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, start: int, count: int) -> np.ndarray:
        """count ids from place start on."""
        if count <= 0:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (start + count - 1) // self.block
        a, b = int(self.offsets[first]), int(self.offsets[last + 1])
        data, out = self._read(self.payload + a, b - a), []
        for k in range(first, last + 1):
            n = min(self.block, self.n_ids - k * self.block)
            out.append(unpack(data[int(self.offsets[k]) - a : int(self.offsets[k + 1]) - a], n, self.bits))
        return np.concatenate(out)[start - first * self.block :][:count]


def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block: int = BLOCK, folder: str | None = None) -> DataFrame:
    """Encode all texts, append end_id to each, and write the ids in ascending id order, one file
    for each range of ids. The manifest: shard, path, n_docs, n_ids, base (ids in earlier files)."""
    if block % 8:
        raise ValueError("the ids in a block must be a multiple of 8")
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shards = max(1, own.rdd.getNumPartitions())

    ends = own.agg(F.percentile_approx(F.coalesce("id", F.lit(FIRST)), [k / shards for k in range(1, shards)], max(10_000, 20 * shards))).first()[0] if shards > 1 else None
    edges = np.array(ends or [], np.int64)  # fewer than shards

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        kind = "<u2" if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for b in batches:
            texts, at = b["text"].tolist(), b["id"].astype("Int64").fillna(FIRST).to_numpy(np.int64)
            low, high = np.searchsorted(edges, at, "left"), np.searchsorted(edges, at, "right")
            for x, y in slices(texts):
                ids, n = enc.flat(texts[x:y], end_id)
                ids = ids.astype(kind)
                raw, ends = ids.tobytes(), (np.cumsum(n) * ids.itemsize).tolist()
                own = [raw[u:v] for u, v in zip([0, *ends[:-1]], ends)]
                turn = np.fromiter(map(zlib.crc32, own), np.int64, len(own))
                yield pd.DataFrame({"id": b["id"].iloc[x:y].array, "raw": own, "turn": turn, "size": ids.itemsize, "shard": low[x:y] + turn % (high - low + 1)[x:y]})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        bits = width(max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1))
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.bitpack"
        out, doc_ids, lengths = TokenWriter(path, bits, block), [], [np.zeros(0, np.int64)]
        for b in batches:
            if len(b):
                size = int(b["size"].iat[0])
                doc_ids += [None if pd.isna(i) else int(i) for i in b["id"]]
                lengths.append(np.fromiter(map(len, b["raw"]), np.int64, len(b)) // size)
                out.append(np.frombuffer(b"".join(b["raw"]), f"<u{size}").astype("<u4"))
        out.close(doc_ids, np.concatenate(lengths))
        yield pd.DataFrame({"shard": [shard], "path": path, "n_docs": len(doc_ids), "n_ids": out.n_ids})

    # ids are dealt, not texts, to ranges of about as many rows each; an id that several ranges end at fills them all, by its rows' contents
    encoded = own.mapInPandas(encode, "id long, raw binary, turn long, size int, shard int")
    dealt = encoded.repartitionById(shards, "shard").sortWithinPartitions(F.col("id").asc_nulls_first(), "turn", "raw")
    manifest = materialize(dealt.mapInPandas(write, "shard long, path string, n_docs long, n_ids long"), "token-manifest")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row for each file
    return materialize(manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "token-shards")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row for each document, from the files: doc_id, start (ids of all documents before it),
    n_tokens, ids (binary, little-endian unsigned 32-bit)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, base in zip(b["path"], b["base"]):
                f = TokenFile(path)
                ends = f.ends.astype(np.int64)
                begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                k = 0
                while k < f.n_docs:  # some 2 million ids at once
                    last = max(k + 1, int(np.searchsorted(ends, begins[k] + 2_000_000, "right")))
                    raw, a = f.ids(int(begins[k]), int(ends[last - 1] - begins[k])).tobytes(), int(begins[k])
                    own = slice(k, last)
                    yield pd.DataFrame(
                        {
                            "doc_id": pd.array(np.where(f.missing[own] == 1, None, f.doc_ids[own]), "Int64"),
                            "start": base + begins[own],
                            "n_tokens": ends[own] - begins[own],
                            "ids": [raw[4 * (x - a) : 4 * (y - a)] for x, y in zip(begins[own].tolist(), ends[own].tolist())],
                        }
                    )
                    k = last

    files = manifest.where("n_docs > 0").select("path", "base", "shard")
    return files.repartition(max(1, manifest.count()), "shard").mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
