import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from meshframe.llm import sp_lattice as SPL
from meshframe.llm import token_count as TC
from meshframe.llm.packing import best_fit, improve, pack_sequences, packed_documents
from meshframe.llm.token_store import TokenFile, pack, read_tokens, unpack, width, write_tokens
from meshframe.llm.tokens import encoder

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "\n", "\t", "'s", "'ll", "1", ".", ",", "é", "\x1c", "　", "<|endoftext|>", "  ", "the", "ing", "漢", "😀", "▁", "Word,", "\r\n"]


def made(n, seed, most=25):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(most))) for _ in range(n)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_words_give_the_librarys_ids(library):
    texts = [*made(3000, 1), None, "", "x" * 5000, " lead", "trail ", "a  b\n\n c"]
    assert [np.frombuffer(g, "<u4").tolist() for g in encoder(BPE).encode(texts)] == [library(t) for t in texts]


@pytest.mark.parametrize("chunk, block", [(7, 20), (7, 1 << 22), (50, 64), (1 << 14, 1 << 22)])
def test_transducer_counts(library, chunk, block, monkeypatch):
    monkeypatch.setattr(TC, "CHUNK", chunk)
    monkeypatch.setattr(TC, "BLOCK", block)
    monkeypatch.setattr(TC, "LOOK_BACK", chunk // 2)
    rng = random.Random(3)
    letters = ["".join(chr(rng.choice([rng.randint(97, 122), rng.randint(33, 126), rng.randint(200, 900)])) for _ in range(rng.randrange(80))) for _ in range(500)]
    runs = [c * n for c in ("a", "ab", "=", "aab", "é", "the") for n in (3, 31, 100, 257)]
    own = TC.TokenCounter(BPE)
    for t in [*made(1500, 2), *letters, *runs, None, ""]:
        assert own.count(t) == len(library(t)), t


def test_states_are_forgotten(library, monkeypatch):
    monkeypatch.setattr(TC, "CHUNK", 16)
    monkeypatch.setattr(TC, "MAX_STATES", 10)
    own = TC.TokenCounter(BPE)
    for t in made(200, 5):
        assert own.count(t) == len(library(t)), t


def test_chunk_maps_are_extended_where_the_guess_fails(library, monkeypatch):
    monkeypatch.setattr(TC, "CHUNK", 11)
    monkeypatch.setattr(TC, "LOOK_BACK", 1)
    text, own = "abcdefgh" * 40, TC.TokenCounter(BPE)
    m = TC.ChunkMaps(text.encode(), np.array([0]), own.machine, {})
    before = sum(map(len, m.maps))
    assert m.total() == len(library(text)) and sum(map(len, m.maps)) > before
    to, n = m.scanned()  # the scan gives what a serial fold gives
    state, total = TC.START, 0
    for k, own_map in enumerate(m.maps):
        state, more = own_map[state]
        total += more
        assert n[k] == total and (k + 1 == m.n or list(m.maps[k + 1])[to[k]] == state)


def test_many_characters_without_a_blank():
    import resource

    own = TC.TokenCounter(BPE)
    few = own.count("ab" * 500_000)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    n = own.count("ab" * 25_000_000)
    assert abs(n - 50 * few) <= 50
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # KB: the text, its bytes and a copy


def test_token_counts(sample, odd, nothing, library):
    for docs in (sample, odd):
        want = sorted(((r["doc_id"], len((r["text"] or "").encode()), len(library(r["text"])), len(library(r["text"])) > 1024) for r in docs.collect()), key=str)
        assert sorted(map(tuple, TC.token_counts(docs, BPE).collect()), key=str) == want
    assert TC.token_counts(nothing, BPE).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 15, 16, 17, 24, 31, 32])
def test_packing_of_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, np.uint64).astype("<u4")
    raw = pack(ids, bits)
    assert len(raw) == -(-1001 * bits // 8) and (unpack(raw, 1001, bits) == ids).all()


def test_width():
    assert [width(n) for n in (1, 2, 3, 50_257, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_token_files(sample, odd, nothing, library, tmp_path):
    for k, docs in enumerate((sample, odd)):
        manifest = write_tokens(docs, BPE, folder=f"file://{tmp_path}/{k}", block=64)
        got = [(r["doc_id"], r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in read_tokens(manifest).collect()]
        want = sorted(([r["doc_id"], library(r["text"]) + [0]] for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        start = 0
        got.sort(key=lambda r: r[1])
        assert [(g[0], g[3]) for g in got] == [(d, i) for d, i in want]
        for g in got:
            assert g[1] == start and g[2] == len(g[3])
            start += g[2]
    f = TokenFile(manifest.orderBy(F.desc("n_ids")).first()["path"])
    whole = f.ids(0, f.n_ids)
    for a, n in ((0, 1), (63, 2), (100, 200), (f.n_ids - 3, 3), (5, 0)):
        assert len(f.ids(a, n)) == n and (f.ids(a, n) == whole[a : a + n]).all()
    assert read_tokens(write_tokens(nothing, BPE, folder=f"file://{tmp_path}/none")).count() == 0


def test_rows_that_share_an_id_fill_many_files(spark, library, tmp_path):
    rows = [(None if i % 2 else 7, f"text number {i} " * 20) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    manifest = write_tokens(docs, BPE, folder=f"file://{tmp_path}/same")
    assert manifest.where("n_docs > 100").count() > 3
    got = sorted(read_tokens(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 1000 + [7] * 1000
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in got) == sorted(library(t) + [0] for _, t in rows)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()


def check_pieces(docs, got, library):
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for r in docs.collect():
        ids = library(r["text"]) + [2]
        own = sorted(by[r["doc_id"]], key=lambda p: (p["piece"], p["start"]))
        if len({p["piece"] for p in own}) == len(own):  # ids that repeat hold each piece twice
            assert [p["start"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
            assert all(p["ids_crc32"] == crc(ids[p["start"] : p["start"] + p["length"]]) for p in own) and sum(p["length"] for p in own) == len(ids)
            assert all(p["length"] == 1024 for p in own[1:])
    seq = {}
    for r in got:
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seq.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 1024
    return len(seq)


def test_packed_documents(sample, odd, nothing, library):
    for docs in (sample, odd):
        got = packed_documents(docs, BPE).collect()
        bins = check_pieces(docs, got, library)
        assert bins <= 1.05 * sum(r["length"] for r in got) / 1024 + 1
    assert packed_documents(nothing, BPE).count() == 0


def test_groups_are_pooled(spark):
    rng = random.Random(1)
    sizes = [rng.randint(1, 1024) for _ in range(3000)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, length long")
    got = pack_sequences(df, group_pieces=150).collect()
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert len(got) == 3000 and max(fill.values()) <= 1024 and len(fill) <= 1.05 * sum(sizes) / 1024


def test_local_search_gains():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 700, 400)
    worse = [[i] for i in range(400)]
    better = improve(sizes, worse, 1024)
    assert sorted(i for b in better for i in b) == list(range(400)) and all(sizes[b].sum() <= 1024 for b in better)
    square = lambda bins: sum(int(sizes[b].sum()) ** 2 for b in bins)
    assert len(better) < 400 and square(better) > square(worse)
    first = best_fit(sizes, 1024)
    assert len(improve(sizes, first, 1024)) <= len(first)


def test_exchange_empties_a_bin():
    # 600 + 400 and 500 + 300, and 224 alone: moving 224 to the second bin fills it
    sizes = np.array([600, 400, 500, 300, 224])
    assert len(improve(sizes, [[0, 1], [2, 3], [4]], 1024)) == 2


def test_sentencepiece_is_the_librarys(spark, sample, odd, nothing):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=SP)
    unbroken = ["ab" * 700, "漢字かな" * 400, "é😀" * 300, "qz" * 20 + "x" * 2000, "▁▁" + "y" * 600]
    docs = [(k, t) for k, t in enumerate([*made(400, 5), *unbroken, None, "", " ", "  ", "\n", " \n \n\n", "a  b \n  c", "x" * 300, "(end).\n'quoted',\tx..."])]
    for df in (spark.createDataFrame(docs, "doc_id long, text string"), sample, odd):
        got = SPL.decode(SPL.encode(df, SP, decoded_col="here"), SP)
        for r in got.collect():
            want = m.encode(r["text"] or "")
            assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["decoded"] == r["here"] == m.decode(want)
    assert SPL.encode(nothing, SP).count() == 0


def test_sentencepiece_of_100000_unbroken_characters(spark):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=SP)
    texts = ["ab" * 50_000, "漢字" * 50_000, "x" * 513, "abcab" * 20_001 + "漢" * 999]
    got = SPL.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), SP).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in got} == dict(enumerate(m.encode(texts)))


def test_the_work_on_unbroken_characters_grows_with_their_number(spark):
    import time

    def seconds(n):
        began = time.time()
        assert SPL.encode_words(spark.createDataFrame([("▁" + "ab" * n,)], "word string"), SP).select(F.size("ids")).first()[0] > n / 4
        return time.time() - began

    seconds(1000)
    few, many = min(seconds(25_000) for _ in range(2)), seconds(100_000)
    assert many < 6 * few  # the square would be 16 times


def test_parts_missing_in_a_slice_are_merged_by_the_definition(spark, sample, monkeypatch):
    import sentencepiece

    p, m = SPL.pieces(SP), sentencepiece.SentencePieceProcessor(model_file=SP)
    for w in SPL.words_of([r["text"] for r in sample.limit(20).collect()] + ["😀漢 x"])[0]:
        if w.startswith("▁") and len(w) > 1:
            assert np.frombuffer(b"".join(map(p.spelled, p.parts(w))), "<u4").tolist() == m.encode(w[1:])


def test_rare_words_come_from_their_slices(spark, sample, monkeypatch):
    monkeypatch.setattr(SPL, "FREQUENT", 50)
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=SP)
    for r in SPL.encode(sample, SP).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == m.encode(r["text"])


def test_lattice_edges_are_not_shuffled(spark):
    words = spark.createDataFrame([("▁the",), ("▁cat",)], "word string").repartition(3, "word")
    p = SPL.pieces(SP)
    table = F.broadcast(spark.createDataFrame(list(p.id.items()), "piece string, id int"))
    plan = SPL._edges(words, "word", "word", F.lit(0), F.length("word"), table, p.longest)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan
    assert SPL.encode_words(words, SP).where(F.col("word") == "▁the").first()["ids"] == [272]


def test_lattice_leaves_out_places_within_sure_merges(spark, sample, monkeypatch):
    words = [w for w in SPL.words_of([r["text"] for r in sample.limit(50).collect()] + made(300, 7))[0] if 0 < len(w) <= SPL.LONG]
    p, full = SPL.pieces(SP), {}
    for letters in (SPL.LETTERS, 20, 0):  # of more letters than the tables take nothing is told
        monkeypatch.setattr(SPL, "LETTERS", letters)
        full[letters] = 0
        for w, stops in zip(words, SPL.Pieces(SP).stops(SPL.pa.array(words)).to_pylist()):
            assert stops[0] == 0 and stops[-1] == len(w) and {*np.cumsum([len(x) for x in p.merged(w)]).tolist()} <= {*stops}
            full[letters] += len(stops) - 1
    assert full[0] == sum(map(len, words)) > full[20] > full[1000] and full[1000] < 0.8 * full[0]
    assert SPL.pieces(SP).stops(SPL.pa.array([], SPL.pa.string())).to_pylist() == []
    assert SPL.pieces(SP).stops(SPL.pa.array(["", "a"])).to_pylist() == [[0], [0, 1]]


def test_lattice_has_few_edges_and_joins_by_a_number(spark, sample):
    words = spark.createDataFrame([(w,) for w in SPL.words_of([r["text"] for r in sample.limit(50).collect()])[0] if w], "word string")
    p = SPL.pieces(SP)
    table = F.broadcast(spark.createDataFrame(list(p.id.items()), "piece string, id int"))
    edges = lambda df, own, *stops: SPL._edges(df, "word", "word", F.lit(0), own, table, p.longest, *stops)
    cut = edges(SPL._with_stops(words, SP).repartition(3, "word"), F.size("stops") - 1, F.col("stops"))
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin [hash#" in plan
    count = lambda df: df.agg(F.sum(F.size("edges"))).first()[0]
    assert count(SPL._masked(cut, SP)) < 0.7 * count(cut) < 0.5 * count(edges(words, F.length("word")))


def test_pairs_are_remembered_in_arrays(monkeypatch):
    monkeypatch.setattr(SPL, "PAIRS", 50)
    p, rng = SPL.Pieces(SP), np.random.default_rng(2)
    ids = rng.choice([*p.piece], 40)
    for _ in range(20):  # known and new ones mixed, forgotten in between
        codes = np.unique(rng.choice(ids, 60).astype(np.int64) << 24 | rng.choice([*ids, SPL.UNKNOWN + 7], 60))
        want = [c & 0xFFFFFF > SPL.UNKNOWN or p.merged(p.piece[c >> 24] + p.piece[c & 0xFFFFFF]) == [p.piece[c >> 24], p.piece[c & 0xFFFFFF]] for c in codes.tolist()]
        assert p.compatible(codes).tolist() == want and len(p.pairs) <= 50 + 60 and (np.diff(p.pairs) > 0).all()


def test_each_part_is_counted_once_a_partition(spark, sample):
    from collections import Counter

    texts = [r["text"] for r in sample.collect()] + [None, "", "end. end.", "end", " ", "a" * 70 + "."]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = Counter(p for t in texts for w in SPL.words_of([t])[0] for p in SPL.pieces(SP).parts(w) for _ in range((" " + SPL.marked(t) + " ").replace(" ", "  ").count(f" {w} ")) if w)
    got = {r["word"]: (r["n"], sorted(r["parts"])) for r in SPL.part_table(docs, SP).collect()}
    assert {w: n for w, (n, _) in got.items()} == want and got["▁the"][1] == [0, 1, 2]


def test_packing_keeps_clashing_columns(spark):
    rows = [(k, 100 + k, 7, 8, 9, "x") for k in range(40)]
    got = pack_sequences(spark.createDataFrame(rows, "row_no long, length long, sequence_id long, offset int, fill int, grp string"))
    assert sorted(got.columns) == sorted(["row_no", "length", "sequence_id", "offset", "fill", "grp"])
    kept = got.collect()
    assert {r["row_no"] for r in kept} == set(range(40)) and {(r["fill"], r["grp"]) for r in kept} == {(9, "x")}
    assert len({r["sequence_id"] for r in kept}) < 8 and {r["offset"] for r in kept} != {8}


def test_search_empties_bins():
    rng = np.random.default_rng(1)
    for low, high, small in ((200, 400, False), (20, 60, True), (1, 1024, True)):
        sizes = rng.integers(low, high, 2000)
        first = best_fit(sizes, 1024)
        bins = improve(sizes, first, 1024)
        assert sorted(i for b in bins for i in b) == list(range(2000)) and max(sizes[b].sum() for b in bins) <= 1024
        assert len(bins) <= len(first) if small else len(bins) < 0.97 * len(first)


def test_a_shard_may_be_written_twice(spark, sample, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    first = write_tokens(sample, BPE, folder=folder)
    again = write_tokens(sample, BPE, folder=folder)  # as a repeated attempt would: beside the files there
    of = lambda m: sorted((r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in read_tokens(m).collect())
    assert of(first) == of(again)
