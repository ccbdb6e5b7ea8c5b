import re
from itertools import permutations

import pytest

from meshframe.llm import filter_audit as FA
from meshframe.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(rows):
    """Rows (id, text, part) with the set of filters that each fails, by the definition."""
    out = []
    for doc, text, part in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows),
        }
        out.append((doc, part or "", {f for f, bad in fails.items() if bad}))
    return out


def brute(rows, labels):
    """Every order applied to the documents themselves."""
    good, toxic = ({d for d, *m in labels if m[k] == 1 and d is not None} for k in (0, 1))
    judged, out = failures(rows), []
    for part in {p for _, p, _ in judged}:
        docs = [(d, f) for d, p, f in judged if p == part]
        table = []
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [(d, x) for d, x in left if f in x]
                stay = [(d, x) for d, x in left if f not in x]
                redundant = sum(f in x for _, x in docs) - len(gone)
                table.append([part, "".join(order), step, len(stay), len(gone), redundant, sum(x == {f} for _, x in docs), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)])
                left = stay
        share = {f: sum(t[4] for t in table if t[1][t[2] - 1] == f) for f in "ABCDE"}
        out += [(*t, share[t[1][t[2] - 1]]) for t in table]
    return sorted(out)


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, p, 1, "x") for d, t, p in rows], "doc_id long, text string, lang string, h int, bits string")
    return sorted(map(tuple, FA.audit(FA.combinations(docs, spark.createDataFrame(labels, LABELS))).select(COLUMNS).collect()))


ROWS = [
    (1, "one two three", "en"), (2, "one two three", "en"), (3, "one two three", None), (4, None, "en"), (5, "", "de"), (None, "one two three", "en"), (None, None, ""), (7, " ".join(f"w{i}" for i in range(250)), "en"),
    (8, " ".join(f"w{i}" for i in range(250)), "de"), (9, "a b " * 150, "de"), (10, "SHOUT " * 250 + "#", "en"), (11, " ".join(f"w{i}" for i in range(199)), "en"), (12, "x" * 40_000 + " " + "y " * 300, "fr"),
    (2, "one two three", "en"), (13, "Ä" * 30 + "A", "fr"), (14, "naïve\x0b漢字 100%", "fr"), (6, "One two three", "en"), (15, "x y " * 99 + "x y", "fr"),
]
MARKS = [(1, 1, 0), (2, 0, 1), (2, 1, 1), (3, None, 1), (None, 1, 1), (5, 1, 0), (8, 1, 1), (10, 0, 0), (99, 1, 1)]


@pytest.mark.parametrize("hot", [0, 4, 1000])
def test_every_order_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(FA, "HOT", hot)  # no text is hot, the commonest is, all that repeat are
    assert audited(spark, ROWS, MARKS) == brute(ROWS, MARKS)


def test_a_text_that_most_rows_have(spark):
    rows = [(i, "same text" if i % 4 else f"text {i // 8}", "en") for i in range(4000)]
    got = audited(spark, rows, [(8, 1, 0)])
    e_first = next(r for r in got if r[1] == "EABCD" and r[2] == 1)
    assert e_first[4] == 2999 + 500


def test_query_on_the_smallest_table(spark, sample):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in sample.collect()]
    got = sorted(map(tuple, QUERIES["op11_filter_audit"](spark, "/root/testdata/sf0.001").select(COLUMNS).collect()))
    assert got == brute(rows, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_clashing_columns_and_nothing(spark, odd, nothing):
    labels = spark.createDataFrame([], LABELS)
    got = FA.combinations(odd, labels, part_col="id").groupBy().sum("n").first()[0]
    assert got == odd.count()
    assert FA.audit(FA.combinations(nothing, labels, part_col="id")).isEmpty()
    assert dict(FA.audit(FA.combinations(odd, labels, part_col="id")).dtypes) == {"part": "string", "filter_order": "string", **{c: "int" if c == "step" else "bigint" for c in COLUMNS[2:]}}
