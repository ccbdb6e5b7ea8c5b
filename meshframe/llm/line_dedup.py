"""Line dedup by winnowing over line hashes, in DataFrame operations only.

Every window of two consecutive lines selects its smaller line hash (the right one of equals), and only
selected lines are emitted as fingerprints, with their position and the neighbours whose windows
selected them: every repeated run of at least two lines is guaranteed to share a fingerprint with its earlier
copy. A line of at least min_words words is a run by itself and always emitted.

Positions with the same fingerprint are joined with the first of them (a star, never all pairs) and
the match is extended to the left and to the right, to the neighbouring lines that are the same there; further lines
have fingerprints of their own. Where a neighbour differs from the first position's, an
earlier copy may still stand elsewhere: those positions are joined once more, by fingerprint and
neighbour, with the first that has both. Lines of a run that is found at an earlier position, in the order of
(id, line), are deleted.

So exactly these lines go: those in a pair of consecutive lines, or long lines, that occurred
before, in the same or another document. Lines are compared without outer white space ([\\x20\\x09-\\x0D]); blank lines never
match and stay.

Defined cases: null text stays null; empty text stays empty; very long texts are one array of line hashes and
cut whole; a null id comes first; rows that repeat an id and text are one document (both keep their first lines);
ties cannot occur, as (id, line) is the order; an empty table gives an empty result; other columns are carried along, but for
n_lines and n_deleted, which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

MIN_WORDS = 50
WHITE = " \t\x0b\x0c\r"  # outer white space of a line
INNER = "[\\x20\\x09-\\x0D]+"


def stripped(line):
    return F.btrim(line, F.lit(WHITE))


def _lines(text, min_words: int):
    """Array of a text's lines that are not blank: line number, two hashes, whether it is long."""
    line = F.transform(F.split(text, "\n", -1), lambda s, i: F.struct(i.alias("at"), stripped(s).alias("t")))
    long = lambda t: (F.length(t) >= 2 * min_words - 1) & (F.size(F.split(t, INNER)) >= min_words)
    return F.transform(F.filter(line, lambda x: x["t"] != ""), lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["t"]).alias("h"), F.xxhash64(F.lit(1), x["t"]).alias("g"), long(x["t"]).alias("long")))


def _minima(lines):
    """The fingerprints: lines that a window of two selects, or that are long; with the other line of
    each window that selected them (its number and hash)."""

    def side(x, other, selected):
        return F.when(selected, F.struct(other["at"].alias("at"), other["h"].alias("h")))

    def one(x, i):
        before, after = F.get(lines, i - 1), F.get(lines, i + 1)
        return F.struct(
            x["h"].alias("h"), x["g"].alias("g"), x["at"].alias("at"), x["long"].alias("long"), side(x, before, x["h"] <= before["h"]).alias("left"), side(x, after, x["h"] < after["h"]).alias("right")
        )

    return F.filter(F.transform(lines, one), lambda x: x["left"].isNotNull() | x["right"].isNotNull() | x["long"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text cut, and the columns n_lines (lines that are not blank) and n_deleted."""
    docs = docs.drop(*{"n_lines", "n_deleted"}.difference({id_col, text_col}))
    key = F.xxhash64(F.col(text_col))
    lines = docs.select(F.col(id_col).alias("id"), key.alias("key"), _lines(F.col(text_col), min_words).alias("l"))
    found = materialize(lines.select("id", "key", F.explode(_minima(F.col("l"))).alias("x")).select("id", "key", "x.*"), "line-minima")

    place = F.struct("id", "at", "key")
    repeats = found.groupBy("h", "g").agg(F.min(F.struct("id", "at", "key", F.col("left.h").alias("left"), F.col("right.h").alias("right"))).alias("first"), F.count(F.lit(1)).alias("n"))
    first = materialize(repeats.where("n > 1").select("h", "g", "first"), "line-anchors")
    later = lambda df: df.where(~place.eqNullSafe(F.struct("first.id", "first.at", "first.key")))
    same = lambda side: F.coalesce(F.col(f"{side}.h") == F.col(f"first.{side}"), F.lit(False))
    matched = materialize(later(found.join(first, ["h", "g"])).withColumns({"same_left": same("left"), "same_right": same("right")}).drop("first"), "line-matches")

    # extended: the lines of each match, and the sides that do not go on as at the first position
    line = lambda test, at: F.when(test, F.array(at)).otherwise(F.array().cast("array<int>"))
    runs = F.concat(line(F.col("same_left") | F.col("same_right") | F.col("long"), F.col("at")), line(F.col("same_left"), F.col("left.at")), line(F.col("same_right"), F.col("right.at")))
    open_ = lambda k, side: F.when(F.col(side).isNotNull() & ~F.col(f"same_{side}"), F.struct(F.lit(k).alias("side"), F.col(f"{side}.h").alias("other"), F.col(f"{side}.at").alias("other_at")))
    sides = matched.select("id", "key", "h", "g", "at", F.explode(F.filter(F.array(open_(0, "left"), open_(1, "right")), lambda x: x.isNotNull())).alias("s")).select("id", "key", "h", "g", "at", "s.*")
    again = sides.groupBy("h", "g", "side", "other").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rest = later(sides.join(again, ["h", "g", "side", "other"])).select("id", "key", F.array("at", "other_at").alias("run"))

    deleted = matched.select("id", "key", runs.alias("run")).where(F.size("run") > 0).unionByName(rest)
    gone = materialize(deleted.groupBy(F.col("id").alias("__gone_id"), F.col("key").alias("__gone_key")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("run")))).alias("__gone")), "line-deletes")
    for done in (found, first, matched):
        discard(done)
    text = F.col(text_col)
    # lines and deleted line numbers in one order: a line goes if its number stands right before it
    both = F.array_sort(
        F.concat(
            F.transform(F.split(text, "\n", -1), lambda s, i: F.struct(i.alias("at"), F.lit(True).alias("line"), s.alias("s"))), F.transform("__gone", lambda i: F.struct(i.alias("at"), F.lit(False).alias("line"), F.lit("").alias("s")))
        )
    )
    joined = docs.join(gone.hint("merge"), F.col(id_col).eqNullSafe(F.col("__gone_id")) & (key == F.col("__gone_key")), "left")
    kept = F.transform(F.filter(F.col("__both"), lambda x, i: x["line"] & ((i == 0) | F.col("__both")[F.greatest(i - 1, F.lit(0))]["line"])), lambda x: x["s"])
    n_lines = F.size(F.filter(F.split(text, "\n", -1), lambda s: stripped(s) != ""))
    return (
        joined.withColumns({"n_lines": F.when(text.isNotNull(), n_lines).otherwise(0).cast("long"), "n_deleted": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"), "__both": F.when(F.col("__gone").isNotNull(), both)})
        .withColumn(text_col, F.when(F.col("__gone").isNull(), text).otherwise(F.array_join(kept, "\n")))
        .drop("__gone_id", "__gone_key", "__gone", "__both")
    )


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_deleted", "text")


def dedup_sql(docs: str = "documents", columns: str = "doc_id, n_lines, n_deleted, text") -> str:
    """The same result in DuckDB SQL."""
    white = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
    return f"""
with l as (select doc_id, text, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ln from {docs}),
full_lines as (select doc_id, ln, trim(s, {white}) as t from l where trim(s, {white}) <> ''),
nxt as (select *, lead(ln) over w as ln2, lead(t) over w as t2 from full_lines window w as (partition by doc_id order by ln)),
runs as (
  select doc_id, ln as a, ln2 as b, t || chr(10) || t2 as k from nxt where t2 is not null
  union all
  select doc_id, ln, ln, t from nxt where len(string_split_regex(t, '[\\x20\\x09-\\x0D]+')) >= {MIN_WORDS}),
placed as (select *, row_number() over (partition by k order by doc_id, a) as turn from runs),
gone as (select doc_id, a as ln from placed where turn > 1 union select doc_id, b from placed where turn > 1),
cut as (select l.doc_id, string_agg(s, chr(10) order by l.ln) filter (where gone.ln is null) as text, count(gone.ln) as n_deleted,
  count(*) filter (where trim(s, {white}) <> '') as n_lines from l left join gone using (doc_id, ln) group by l.doc_id),
result as (select d.* replace (case when d.text is null then null else coalesce(cut.text, '') end as text), coalesce(n_lines, 0) as n_lines, coalesce(n_deleted, 0) as n_deleted
  from {docs} d left join cut using (doc_id))
select {columns} from result"""
