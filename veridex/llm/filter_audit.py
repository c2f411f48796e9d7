"""Operator 11: how five document filters act on each other, in every order.

Words are exploded and aggregated by (document, word), then by document, for totals and distincts; the flags that don't need
words are outer-joined to that, with labels; then 32 conditional counts, one for each set of filters that a document fails,
are all that is left of a part. Every order of the filters, and every step, follows from these 32 numbers.

Failure conditions (words are maximal runs of characters other than space, tab, newline, vertical tab, form feed, return):
A under 50 words; B distinct words under 65 percent of the words; C ``[A-Z]`` over 5 percent of the code points; D holds any
of ``#$%&*|``; E identical to the text of any smaller doc_id.

Each row is a document, under a number of its own, so the aggregation by document is even whatever ids repeat. Texts are
dealt out once by that number, and the words of a text are exploded where it landed: exploded rows are never shuffled.

Edge cases: a null text is an empty one (fails A; B, C and D need words or characters); identical texts of one doc_id are
no copies of each other; a null doc_id has no smaller one, is no smaller one of others, and has no labels; a null source is
the part ``''``; of labels that repeat a doc_id any 1 counts, and null labels are 0; extra columns are ignored, whatever
their names; without documents there are no parts; texts of any length are taken whole.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

FILTERS = "ABCDE"
MASKS = range(1 << len(FILTERS))
ORDERS = ["".join(p) for p in permutations(FILTERS)]
WORDS, MIN_WORDS, MIN_DISTINCT, MAX_UPPER, SYMBOLS = r"[^\x20\x09-\x0D]+", 50, 65, 5, "[#$%&*|]"
#: Sets of documents that are counted: all, those of good quality, toxic ones.
KINDS = ("all", "good", "toxic")


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc_id, part, text), staged so that a row's number holds for all that reads it."""
    return stage(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")), "audited")


def word_totals(rows: DataFrame) -> DataFrame:
    """(row, n_words, n_distinct) of the rows that have words."""
    words = rows.select("row", "text").repartition("row").select("row", F.explode(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).alias("word"))
    per_word = words.groupBy("row", "word").agg(F.count("*").alias("n"))
    return per_word.groupBy("row").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def other_flags(rows: DataFrame) -> DataFrame:
    """(row, doc_id, part, c_fails, d_fails, e_fails): what doesn't need words."""
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    own = rows.select("row", "doc_id", "part", (100 * upper > MAX_UPPER * F.length("text")).alias("c_fails"), F.col("text").rlike(SYMBOLS).alias("d_fails"), F.unhex(F.sha2("text", 256)).alias("digest"))
    # one row a text that several documents have: a hot one is a hot key of the left side only, which adaptive execution splits
    copied = own.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1 and least is not null").drop("n")
    return own.join(copied, "digest", "left").select("row", "doc_id", "part", "c_fails", "d_fails", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("e_fails"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, mask, good, toxic) of each document; bit i of ``mask`` says that it fails filter i."""
    rows = numbered(docs)
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    found = other_flags(rows).join(word_totals(rows), "row", "left").join(marks, "doc_id", "left")
    n, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    fails = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n, F.col("c_fails"), F.col("d_fails"), F.col("e_fails")]
    mask = sum(((f.cast("int") * (1 << i)) for i, f in enumerate(fails)), F.lit(0))
    return found.select("doc_id", "part", mask.alias("mask"), *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")])


def counts(found: DataFrame) -> DataFrame:
    """(part, all, good, toxic): arrays of 32 document counts, one for each set of failed filters."""
    by_label = found.groupBy("part", "good", "toxic").agg(*[F.count_if(F.col("mask") == m).alias(f"m{m}") for m in MASKS])
    kind = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    return by_label.groupBy("part").agg(*[F.array(*[F.sum(F.when(kind[k], F.col(f"m{m}")).otherwise(0)) for m in MASKS]).alias(k) for k in KINDS])


def _passing(kind: str) -> Column:
    """Of an array of counts, how many documents pass all filters of each set of filters."""
    return F.transform(F.sequence(F.lit(0), F.lit(len(MASKS) - 1)), lambda p: F.aggregate(F.sequence(F.lit(0), F.lit(len(MASKS) - 1)), F.lit(0).cast("bigint"), lambda total, m: total + F.when(m.bitwiseAND(p) == 0, F.get(kind, m)).otherwise(0))).alias(kind)


def audit(found: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from ``failures``."""
    n = counts(found)
    bits = [1 << i for i in range(len(FILTERS))]
    # in all orders a filter is the first of the failed ones equally often
    share = [sum((F.get("all", F.lit(m)) * (len(ORDERS) // m.bit_count()) for m in MASKS if m & b), F.lit(0).cast("bigint")) for b in bits]
    passing = n.select("part", *[_passing(k) for k in KINDS], F.array(*[F.get("all", F.lit(b)) for b in bits]).alias("alone"), F.array(*share).alias("shares"))
    steps = passing.withColumn("filter_order", F.explode(F.lit(ORDERS))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    before = sum((F.when(F.instr("filter_order", f) < F.col("step"), b).otherwise(0) for f, b in zip(FILTERS, bits)), F.lit(0))
    steps = steps.withColumn("place", place).withColumn("before", before).withColumn("bit", F.get(F.array(*map(F.lit, bits)), F.col("place")))
    after = F.col("before") + F.col("bit")
    removed = {k: F.get(k, F.col("before")) - F.get(k, after) for k in KINDS}
    return steps.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        F.get("all", after).alias("kept"),
        removed["all"].alias("removed"),
        (F.get("all", F.lit(0)) - F.get("all", F.col("bit")) - removed["all"]).alias("redundant"),
        F.get("alone", F.col("place")).alias("unique_fails"),
        removed["good"].alias("good_lost"),
        removed["toxic"].alias("toxic_lost"),
        F.get("shares", F.col("place")).alias("shapley"),
    )


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return audit(failures(docs, labels))
