"""Filter interaction audit: what each of five filters removes in every order in which they can be applied.

Filters (a document fails them): A fewer than min_words words, B fewer than half of its words distinct, C more than 3 % of its
code points in A-Z, D one of the characters #$%&*|, E its text is that of a smaller id, table-wide.

E is an existential self-join: a left-semi join of the documents with the smallest id of each text that occurs more
than once, on the text's hash, the exact text and "smaller id". Texts are aggregated before the join (one row a
text, with map-side combine), and only texts whose hash occurs twice are shuffled for it. Texts that more than one in HOT rows
have are joined by broadcast and never shuffled: there are fewer than HOT of them, and their lengths sum up to less than HOT times the mean
length of all texts, as each of their rows holds a whole copy.

The ids that fail E are united with the bits of the other filters, the bits of each document are combined, and documents are counted by
part and combination, at most 32 for a part. Every order and step is read off these counts: an order is never applied to documents.

Defined cases: a null text is empty, fails A and takes part in E; an empty text fails A, and B, C and D cannot fail; a null part is the
empty string; a row with a null id never fails E, makes no other row fail, and has no label; rows that repeat an id and text fail alike, and
E only if a smaller id has the text; of several labels of an id each mark counts if one of them has it; very long texts are
read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
HOT = 1000
MARKS = "[#$%&*|]"
WORDS = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def own_failures(text: Column, min_words: int) -> Column:
    """Bits of A, B, C and D; the words are split once."""
    words = F.filter(F.split(text, WORDS), lambda w: w != "")
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("d")))[0]
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    bit = lambda fails, f: F.when(fails, BIT[f]).otherwise(0)
    of_words = F.transform(F.array(counts), lambda c: bit(c["n"] < min_words, "A") + bit(100 * c["d"] < 50 * c["n"], "B"))[0]
    return of_words + bit(100 * upper.cast("long") > 3 * F.length(text).cast("long"), "C") + bit(text.rlike(MARKS), "D")


def repeats_of_smaller(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of those rows of docs (id, h, text, ...) whose text a smaller id has too; h is a hash of the text."""
    counts = materialize(docs.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "audit-hashes")
    total = counts.agg(F.sum("n")).first()[0] or 0
    several = counts.where("n > 1").select("h")
    hot_hashes = counts.where(F.col("n") * HOT > total).where("n > 1").select("h")  # fewer than HOT rows
    texts = lambda df: df.groupBy(F.col("h").alias("of_h"), F.col("text").alias("of_text")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    same, smaller = (F.col("h") == F.col("of_h")) & (F.col("text") == F.col("of_text")), F.col("first") < F.col("id")
    hot = materialize(texts(docs.join(F.broadcast(hot_hashes), "h", "left_semi")).where(F.col("n") * HOT > total).drop("n"), "audit-hot")
    # the other texts whose hash is not alone; rows of hot texts stay where they are
    cold = materialize(docs.join(F.broadcast(hot), same, "left_anti").join(several.hint("merge"), "h", "left_semi"), "audit-candidates")
    first = texts(cold).where("n > 1").drop("n")
    found = docs.join(F.broadcast(hot), same & smaller, "left_semi").unionByName(cold.join(first.hint("merge"), same & smaller, "left_semi"))
    discard(counts)
    return found.select(columns)


def combinations(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", min_words: int = 200) -> DataFrame:
    """(part, bits, n, good, toxic): documents of each part by the combination of filters that they fail."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    by = ["id", "part", "h"]
    one = lambda df, bits, n: df.select(*by, bits.cast("int").alias("bits"), F.lit(n).cast("long").alias("n"))
    failures = one(rows, own_failures(F.col("text"), min_words), 1).unionByName(one(repeats_of_smaller(rows, by), F.lit(BIT["E"]), 0))
    each = failures.groupBy(*by).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = lambda c: F.coalesce(F.sum(F.col(c) * F.col("n")), F.lit(0)).cast("long").alias(c)
    return each.join(marks, "id", "left").groupBy("part", "bits").agg(F.sum("n").alias("n"), marked("good"), marked("toxic"))


def audit(combos: DataFrame) -> DataFrame:
    """Every order of the filters and every step of it for each part, from the counts of combinations."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    parts = combos.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("c"))  # 32 entries at most
    bit = F.create_map(*[F.lit(x) for kv in BIT.items() for x in kv])
    before = F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.lit(0), lambda m, i: m + F.when(i < F.col("step"), bit[F.substring("filter_order", i, 1)]).otherwise(0))
    steps = (
        parts.select("part", "c", F.explode(orders).alias("filter_order")).select("part", "c", "filter_order", F.explode(F.array(*map(F.lit, range(1, 6)))).alias("step"))
        .withColumn("own", bit[F.substring("filter_order", F.col("step"), F.lit(1))]).withColumn("before", before)
    )
    fails = lambda x: x["bits"].bitwiseAND(F.col("own")) != 0
    stood = lambda x: x["bits"].bitwiseAND(F.col("before")) == 0
    total = lambda test, value: F.aggregate(F.filter("c", test), F.lit(0).cast("long"), lambda s, x: s + value(x))
    n = lambda x: x["n"]
    return steps.select(
        "part", "filter_order", "step",
        total(lambda x: stood(x) & ~fails(x), n).alias("kept"),
        total(lambda x: stood(x) & fails(x), n).alias("removed"),
        total(lambda x: ~stood(x) & fails(x), n).alias("redundant"),
        total(lambda x: x["bits"] == F.col("own"), n).alias("unique_fails"),
        total(lambda x: stood(x) & fails(x), lambda x: x["good"]).alias("good_lost"),
        total(lambda x: stood(x) & fails(x), lambda x: x["toxic"]).alias("toxic_lost"),
        # a document is removed by each filter it fails in an equal share of the 120 orders
        total(fails, lambda x: x["n"] * F.floor(F.lit(120) / F.bit_count(x["bits"]))).alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(combinations(docs, labels))


def audit_sql() -> str:
    """The same result in DuckDB SQL, each order applied to the counts by masks."""
    bits = " + ".join(f"(case when {t} then {BIT[f]} else 0 end)" for f, t in zip(FILTERS, ("n < 200", "100 * d < 50 * n", "100 * upper > 3 * chars", "marked", "first < doc_id")))
    orders = ", ".join(f"'{''.join(p)}'" for p in permutations(FILTERS))
    bit = lambda letter: f"(case {letter} " + " ".join(f"when '{f}' then {b}" for f, b in BIT.items()) + " end)"
    before = " + ".join(f"(case when step > {i} then {bit(f'filter_order[{i}]')} else 0 end)" for i in range(1, 5))
    s = lambda test, value="n": f"cast(coalesce(sum({value}) filter (where {test}), 0) as bigint)"
    return f"""
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, min(doc_id) over (partition by coalesce(text, '')) as first from documents),
w as (select doc_id, part, first, len(ws) as n, len(list_distinct(ws)) as d, length(regexp_replace(text, '[^A-Z]', '', 'g')) as upper, length(text) as chars, regexp_matches(text, '{MARKS}') as marked
  from (select *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as ws from t)),
m as (select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic from labels group by 1),
c as (select part, bits, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from (select doc_id, part, {bits} as bits from w) left join m using (doc_id) group by 1, 2),
o as (select filter_order, step, {bit('filter_order[step]')} as own, {before} as before from (select unnest([{orders}]) as filter_order), (select unnest([1, 2, 3, 4, 5]) as step))
select part, filter_order, cast(step as int) as step, {s('bits & (before + own) = 0')} as kept, {s('bits & before = 0 and bits & own <> 0')} as removed, {s('bits & before <> 0 and bits & own <> 0')} as redundant,
  {s('bits = own')} as unique_fails, {s('bits & before = 0 and bits & own <> 0', 'good')} as good_lost, {s('bits & before = 0 and bits & own <> 0', 'toxic')} as toxic_lost,
  {s('bits & own <> 0', 'n * (120 // nullif(bit_count(bits), 0))')} as shapley
from c, o group by part, filter_order, step"""
