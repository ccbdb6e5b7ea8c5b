import collections
import math
import zlib

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from meshframe.llm import lm
from meshframe.llm import quality_gam as Q
from meshframe.llm.quality_rules import Limits, measure, quality_rules
from meshframe.llm.text_arrays import TextArrays, ngram_hashes, repeated

SF = "/root/testdata/sf0.001"


def slow_rules(text):
    words = [w.decode() for w in (text or "").encode().split()]
    grams = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [s for s in (text or "").encode().split(b"\n") if s.strip()]
    n, k = len(words), len(inside)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), k, n < 20 or 100 * k > 30 * n


def test_rules(sample, odd, nothing):
    for docs in (sample, odd):
        for r in quality_rules(docs).select("text", "rules").collect():
            x = r["rules"]
            assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == slow_rules(r["text"])
            assert x["kept"] == (not x["base_failed"] and not x["repetitive"])
    assert quality_rules(odd).columns == [*odd.columns, "rules"] and quality_rules(nothing).count() == 0


def test_rules_keep_prose_and_drop_repetition(spark):
    prose = " ".join(f"w{i}" for i in range(200))
    rows = [(1, prose), (2, prose + " " + prose), (3, " ".join(["again and again"] * 60)), (4, "\n".join(["one line of some words here"] * 3 + [prose]))]
    got = {r["doc_id"]: r["rules"]["kept"] for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}


def test_rules_compare_bytes(spark):
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = thue.translate(str.maketrans("ab", "ba"))  # polynomial hashes modulo 2^64 of the two are equal
    for a, b in ((thue[:1024], other[:1024]), (thue, other)):
        assert measure(f"{a}\n{b}")[3] == 0 and measure(f"{a}\n{b}\n{a}")[3] == 1
        text = " ".join(a + f" x{k}" for k in range(8)) + " " + " ".join(b + f" x{k}" for k in range(8))
        assert measure(text)[4] == slow_rules(text)[4] == 0
    words = np.array([1, 2, 3, 1, 2, 4], np.uint64)
    assert repeated(np.zeros(5, np.uint64), words, 2)[0].tolist() == [True, False, False, True, False]  # equal hashes of unlike pairs


def test_rules_of_short_texts():
    short = "the name Ada said " + " ".join(f"w{i}" for i in range(12)) + " the name Ada said"
    assert not measure(short)[-1] and measure(short, Limits(top_ngram_times=2))[-1]
    twice = " ".join(f"word{i}" for i in range(12)) + " " + " ".join(f"x{i}" for i in range(20)) + " " + " ".join(f"word{i}" for i in range(12))
    assert not measure(twice)[-1] and measure(twice, Limits(duplicated_words=5))[-1]
    lines = "\n".join(["a b"] * 2 + [" ".join(f"{k}w{i}" for i in range(9)) for k in range(3)])
    assert not measure(lines)[-1] and measure(lines, Limits(duplicated_lines_of=5, duplicated_lines=0.1))[-1]


def test_text_arrays():
    t = TextArrays("ab cd　e ab\ncd ab")
    assert t.n_words == 5 and t.word_chars == 12
    w = t.words()
    assert w[0] == w[2] == w[4] and w[0] != w[1]
    twice, again = repeated(ngram_hashes(w, 1))
    assert twice.tolist() == [True, False, True, False, True] and again.tolist() == [False, False, True, False, True]


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no feature tells anything alone
    m = Q.PairwiseGAM().fit(x[:3000], y[:3000])
    assert (0, 1) in m.pairs and ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_quality_held_out(spark):
    """Held-out accuracy on the given labels."""
    sf = "/root/testdata/sf0.01"
    labels = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect())
    got = __spark_entry__.queries()["op7_quality_gam"](spark, sf).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_quality_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, None), (None, 1)], "doc_id long, quality int")
    model = Q.fit_quality(odd, labels)
    got = Q.score_quality(odd, model)
    assert got.count() == 12 and got.where("score between 0 and 1").count() == 12
    none = Q.fit_quality(odd, labels.limit(0))
    assert {r["score"] for r in Q.score_quality(odd, none).collect()} == {0.5}
    assert Q.score_quality(nothing, model).count() == 0
    assert len({r["score"] for r in got.where("doc_id = 9").collect()}) == 1


def base_scores(docs, held):
    c = collections.Counter()
    for d, t in docs:
        if not held(d):
            c.update((t or "").encode().lower().split())
            c[0] += 1
    n, v = sum(c.values()), len(c)
    for d, t in docs:
        own = [*(t or "").encode().lower().split(), 0]
        yield d, len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)


@pytest.mark.parametrize("frequent", [300, 200_000])
def test_lm_scores(sample, frequent, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    got = {r["doc_id"]: r for r in lm.lm_scores(sample).collect()}
    docs = [(r["doc_id"], r["text"]) for r in sample.collect()]
    for d, n, k, total, base in base_scores(docs, held):
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(d), n, k, total) and r["base_score"] == pytest.approx(base)
    own = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)  # better than the counts on unseen texts


def slow_log_prob(m, context, target):
    """Natural log-probability of a symbol behind its context, by a plain loop over the formula."""
    r, w, c = m.parts
    h = [sum(float(r[context[p]][i]) * float(c[p][i][j]) for p in range(m.n_places) for i in range(lm.DIM)) for j in range(lm.DIM)]
    score = lambda row: sum(float(x) * y for x, y in zip(row, [*h, 1.0]))
    own = int(m.class_of[target])
    classes = [math.exp(score(w[k])) for k in range(m.n_classes)]
    inside = {k: math.exp(score(w[m.n_classes + k])) for k in range(m.n) if m.class_of[k] == own}
    return math.log(classes[own] / sum(classes) * inside[target] / sum(inside.values()))


def trained(counts, texts):
    m = lm.LogBilinear(np.array(counts, float))
    learner = lm._Learner(m.counts, m.flat(), len(counts) - 1, 0)
    for t in texts:
        learner.learn(learner.stream.add(np.array(t)))
    learner.told()
    return learner.model


def test_lm_words_are_numbered_as_they_are_split():
    """Distinct words once each (before, every word was an object), numbers and lengths equal to splitting each text."""
    texts = [None, "", " \t x\x0bY Z\n", "\u00c9A\x1cb\x85c \u00a0 y", "a a B a\r\nb", "   "]
    names, at, lengths = lm.flat_words(texts)
    split = [lm.words_of(t) for t in texts]
    assert [names[k].encode() for k in at] == [w for s in split for w in s]
    assert lengths.tolist() == [len(s) for s in split] and len(set(names)) == len(names)
    names, at, lengths = lm.flat_words([])
    assert len(at) == len(lengths) == 0


def test_lm_is_normalised_after_training():
    rng = np.random.default_rng(2)
    m = trained(range(60, 0, -1), [rng.integers(0, 59, 50).tolist() for _ in range(100)])
    assert m.n_classes > 3 and np.abs(m.parts[1] - lm.LogBilinear(m.counts).parts[1]).max() > 0.1
    context, target = next(iter(lm.Stream(m, 59, 8).add(np.array([3, 5, 7, 9, 11]))))
    assert target.tolist() == [3, 5, 7, 9, 11] and context[1].tolist() == [3, m.begin_of_text, m.begin_of_text] and context[4].tolist() == [9, 7, 5]
    for row, t in zip(context, target):
        got = m.log_probs(np.tile(row, (m.n, 1)), np.arange(m.n))
        assert np.exp(got).sum() == pytest.approx(1, abs=1e-4) and got[t] == pytest.approx(slow_log_prob(m, row, t), abs=1e-4)


def test_lm_stream_is_the_same_in_any_chunks():
    rng = np.random.default_rng(4)
    m, texts = lm.LogBilinear(np.ones(20)), [rng.integers(0, 19, k) for k in (0, 1, 5, 40, 0, 3)]
    seen = []
    for size in (7, 11, 1000):
        s = lm.Stream(m, 19, size)
        got = [c for t in texts for c in s.add(t)] + list(s.finish())
        seen.append((np.concatenate([x for x, _ in got]).tolist(), np.concatenate([t for _, t in got]).tolist()))
    assert seen[0] == seen[1] == seen[2] and len(seen[0][1]) == sum(len(t) + 1 for t in texts)


def test_lm_scores_by_hand(spark, monkeypatch):
    """The trained parameters, and the score of each text by plain loops: its symbols, and its words within their tails."""
    from pyspark.sql import functions as F

    kept, make = {}, lm._scorer
    monkeypatch.setattr(lm, "COMMON_SHARE", 0.02)
    monkeypatch.setattr(lm, "_scorer", lambda counts, flat, end: kept.update(counts=counts, flat=flat, end=end) or make(counts, flat, end))
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(30)]
    rows = [(k, " ".join(rng.choice(words, 8, p=np.arange(30, 0, -1) / 465)), k % 9 == 0) for k in range(600)] + [(1000, "w0 unknown w29 W3", True), (1001, "", True), (1002, None, True)]
    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string, unseen boolean"), held=F.col("unseen")).collect()}
    c = collections.Counter(w for _, t, u in rows if not u for w in t.split())
    n_docs = sum(not u for _, _, u in rows)
    common = [w for w in sorted(c, key=lambda w: (-c[w], w)) if c[w] >= 0.02 * (sum(c.values()) + n_docs)]
    mass, types = collections.Counter(), collections.Counter()
    for w in set(c) - set(common):
        mass[lm.tail_of(w.encode())] += c[w]
        types[lm.tail_of(w.encode())] += 1
    symbols = [*((c[w], w) for w in common), *((mass[t], t) for t in range(lm.TAIL)), (n_docs, "")]
    ranked = sorted(symbols, key=lambda s: -s[0])
    place = {name: k for k, (_, name) in enumerate(ranked)}
    assert [k for k, _ in ranked] == kept["counts"].tolist() and place[""] == kept["end"]
    m = lm.LogBilinear(kept["counts"]).load(kept["flat"])
    for d, t, _ in [*rows[::60], *rows[-3:]]:
        own, before, total = [w.lower() for w in (t or "").split()], [m.begin_of_text] * 3, 0.0
        for w in [*own, ""]:
            s = place[w] if w in place else place[lm.tail_of(w.encode())]
            total += slow_log_prob(m, before, s) / math.log(10)
            if w not in place:
                k = lm.tail_of(w.encode())
                total += math.log10((c[w] + 1) / (mass[k] + types[k] + 1))
            before = [s, *before[:2]]
        assert got[d] == pytest.approx(total, abs=1e-3)


def test_lm_scores_do_not_depend_on_partitions(sample):
    of = lambda n: {r["doc_id"]: r["score"] for r in lm.lm_scores(sample.repartition(n)).collect()}
    one, eight = of(1), of(8)
    assert all(one[d] == pytest.approx(eight[d], abs=1e-6 * (1 + abs(one[d]))) for d in one)


def test_lm_scores_depend_on_the_third_word_back(spark):
    from pyspark.sql import functions as F

    rows = [(k, "a x y a" if k % 2 else "b x y b", False) for k in range(30_000)] + [(30_000, "a x y a", True), (30_001, "a x y b", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, unseen boolean").coalesce(1)
    got = {r["doc_id"]: r["score"] for r in lm.lm_scores(docs, held=F.col("unseen")).where("held_out").collect()}
    assert got[30_000] > got[30_001] + 0.3


def test_lm_of_odd_rows(odd, nothing):
    got = lm.lm_scores(odd).collect()
    assert len(got) == 12 and all(r["score"] < 0 and r["base_score"] < 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}
    assert lm.lm_scores(nothing).count() == 0
    from pyspark.sql import functions as F

    untrained = lm.lm_scores(odd, held=F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in untrained)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        assert 0 < docs.count() <= n
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_every_query_of_the_ten_is_registered():
    names = __spark_entry__.queries()
    assert all(any(q.startswith(f"op{k}_") for q in names) for k in range(1, 11)) and "pipeline" in names


def test_pipeline_of_odd_rows(spark, odd, nothing):
    from pyspark.sql import functions as F

    prose = " ".join(f"word{i} and" for i in range(40))
    shape = lambda df: df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    more = spark.createDataFrame([(50, prose), (51, prose), (None, prose), (52, prose + " " + prose), (53, None), (54, "")], "doc_id long, text string")
    stages = dict(corpus_pipeline.STAGES)
    docs = shape(odd).unionByName(shape(more))
    kept = stages["quality_rules"](spark, docs, SF)
    assert kept.columns == corpus_pipeline.COLUMNS and {r["doc_id"] for r in kept.collect()} & {50, 51, 52, 53, 54, 3, 4, 5} == {50, 51}
    cut = stages["line_dedup"](spark, docs, SF)
    assert cut.count() == docs.count() and cut.columns == corpus_pipeline.COLUMNS
    near = {r["doc_id"] for r in stages["near_dedup"](spark, docs.where("doc_id between 50 and 51 or doc_id is null"), SF).collect()}
    assert 50 in near and 51 not in near
    packed = stages["packing"](spark, docs, SF).collect()
    assert len({(r["doc_id"], r["piece"], r["start"]) for r in packed}) >= 14
    for name in ("quality_rules", "quality_classifier", "line_dedup", "near_dedup", "packing"):
        assert stages[name](spark, shape(nothing), SF).count() == 0
