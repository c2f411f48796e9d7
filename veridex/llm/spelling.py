r"""Operator 12: spelling variants by forward and reversed sorted dictionaries.

Runs of letters are lower-cased (A-Z only), some lose a code point by a rule of the contract (``corrupted``), and those of 7
code points and 2 occurrences are the dictionary. Two words are near if one inserted, deleted or replaced code point is
between them. Such an edit leaves a half intact:

1. Each word stands in a class by the length of the longer word of a pair (its own, and one more), once in a dictionary
   sorted forwards and once in one sorted backwards. Words of a class that share the first half are neighbours in the
   one, those that share the second half in the other: a block is a range of equal halves.
2. A block of more than LIMIT words is subdivided: what lies between the shared ends is halved again, forwards and
   backwards. The last subdivision leaves one code point between the ends, so a block is bounded by the alphabet.
3. Ranges are scanned in their order, and the pairs of a block verified by their common ends. A pair is taken in one
   block only: forwards wherever its first half is intact.

A word's form is its near word of most occurrences, if these are ten times its own; roots follow forms to the last one by
pointer doubling (a form has ten times the occurrences, so chains are short).

Edge cases: null and empty texts have no runs; a null doc_id is written as an empty text in the rule; a repeated row counts
again; of forms that occur equally often the smallest in code-point order is taken; a table without rows gives none; runs
of any length are taken whole; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, release, stage, to_batch

LETTERS = "[A-Za-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT, RATIO, EVERY = 7, 2, 10, 31
#: Words of a block beyond which it is subdivided.
LIMIT = 64
#: Rows of blocks that are verified together, and characters of words or pairs that are held for it.
ROWS, CELLS = 8192, 1 << 22
BLOCK = ["longer", "path", "ends"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """(word) for each run of letters that can come to ``least`` code points."""
    # a run under ``least`` doesn't get longer: it need not be cut out
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("run"))
    low = runs.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    return hashed.select(F.when(F.col("h") % EVERY == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run")).alias("word"))


def dictionary(docs: DataFrame, least: int = MIN_LENGTH, least_count: int = MIN_COUNT) -> DataFrame:
    """(word, n), staged."""
    return stage(words(docs, least).filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count), "dictionary")


def halved(rows: DataFrame) -> DataFrame:
    """Each row forwards and backwards, with half of what lay between its ends added to one of them."""
    between = F.col("longer") - F.col("head") - F.col("tail")
    ways = F.explode(F.array(
        F.struct(F.lit("F").alias("way"), F.floor(between / 2).cast("int").alias("more_head"), F.lit(0).alias("more_tail")),
        F.struct(F.lit("B").alias("way"), F.lit(0).alias("more_head"), F.ceil(between / 2).cast("int").alias("more_tail")),
    )).alias("w")
    wide = rows.select("longer", "path", "head", "tail", "word", "n", ways)
    wide = wide.select("longer", F.concat("path", "w.way").alias("path"), (F.col("head") + F.col("w.more_head")).alias("head"), (F.col("tail") + F.col("w.more_tail")).alias("tail"), "word", "n")
    ends = F.concat(F.substring("word", F.lit(1), F.col("head")), F.reverse(F.substring("word", F.length("word") - F.col("tail") + 1, F.col("tail"))))
    return wide.withColumn("ends", ends)


def blocks(known: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(longer, path, ends, word, n): words of a block share ``ends``, what their path says of the first and last code points."""
    rows = known.select(F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("longer"), F.lit("").alias("path"), F.lit(0).alias("head"), F.lit(0).alias("tail"), "word", "n")
    rows, done = halved(rows), []
    while True:
        large = stage(rows.filter("longer - head - tail > 1").groupBy(*BLOCK).agg(F.count("*").alias("size")).filter(F.col("size") > limit).drop("size").withColumn("large", F.lit(True)), "large-blocks")
        if large.isEmpty():
            done.append(rows)
            return reduce(DataFrame.unionByName, [d.select(*BLOCK, "word", "n") for d in done])
        told = stage(rows.join(large, BLOCK, "left"), "told-blocks")
        done.append(told.filter("large is null"))
        rows = halved(told.filter("large"))


def _common(a: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many first columns rows i and j of ``a`` share."""
    differ = a[i] != a[j]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def verified(longer: np.ndarray, path: np.ndarray, block: np.ndarray, held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) that are near and belong to this block. ``held`` has a byte for each code point, ``block`` is ascending."""
    size = np.fromiter(map(len, held), np.int64, len(held))
    width = int(size.max())
    ahead = np.zeros((len(held), width), np.uint8)
    on = np.arange(width) < size[:, None]
    ahead[on] = np.frombuffer(b"".join(held), np.uint8)
    back = np.zeros_like(ahead)
    back[on] = np.frombuffer(b"".join(h[::-1] for h in held), np.uint8)
    most = int(np.bincount(block).max())
    found = []
    for d in range(1, most):
        i = np.flatnonzero(block[d:] == block[:-d])
        i = i[np.maximum(size[i], size[i + d]) == longer[i]]  # two of the shorter length belong to the class before
        for k in range(0, len(i), max(1, CELLS // width)):
            a = i[k : k + max(1, CELLS // width)]
            first, last = _common(ahead, a, a + d), _common(back, a, a + d)
            near = np.flatnonzero(first + last >= longer[a] - 1)
            if len(near):
                found.append((a[near], a[near] + d, first[near]))
    if not found:
        return (np.zeros(0, np.int64),) * 2
    i, j, first = (np.concatenate(x) for x in zip(*found))
    own = np.ones(len(i), bool)
    for name in np.unique(path[i]):
        mine = np.flatnonzero(path[i] == name)
        head, between = np.zeros(len(mine), np.int64), longer[i[mine]].astype(np.int64)
        for way in name:
            half = between // 2
            intact = first[mine] >= head + half
            own[mine] &= intact == (way == "F")
            head, between = (head + half, between - half) if way == "F" else (head, half)
    return i[own], j[own]


def near_words(found: DataFrame) -> DataFrame:
    """(word, other, other_n) for each near pair, both ways, from blocks."""
    schema = pa.schema([("word", pa.string()), ("other", pa.string()), ("other_n", pa.int64())])

    def solve(table: pa.Table) -> pa.RecordBatch:
        longer = table.column("longer").to_numpy()
        path, ends = (table.column(c).to_numpy() for c in ("path", "ends"))
        new = (longer[1:] != longer[:-1]) | (path[1:] != path[:-1]) | (ends[1:] != ends[:-1])
        held = [w.encode("latin-1") for w in table.column("word").to_pylist()]
        i, j = verified(longer, path.astype(str), np.concatenate([[0], np.cumsum(new)]), held)
        one, two = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
        whole = table.combine_chunks()
        return pa.RecordBatch.from_arrays([whole.column("word").take(one).combine_chunks(), whole.column("word").take(two).combine_chunks(), whole.column("n").take(two).combine_chunks()], schema=schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole blocks, about ROWS rows or CELLS characters of them at once; a block has LIMIT rows, or the alphabet's."""
        held: list[dict] = []
        cells, last, width = 0, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["longer"], row["path"], row["ends"])
                if key != last and held and (len(held) >= ROWS or cells > CELLS):
                    yield solve(pa.Table.from_pylist(held, batch.schema))
                    held, width = [], 0
                last = key
                held.append(row)
                width = max(width, len(row["word"]))
                cells = width * len(held)
        if held:
            yield solve(pa.Table.from_pylist(held, batch.schema))

    ranged = found.repartitionByRange(*BLOCK).sortWithinPartitions(*BLOCK, "word")
    return map_arrow(ranged, scan, "word string, other string, other_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, from (word, root) with the form as root."""
    while True:
        forms = stage(forms, "roots")
        further = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = forms.join(further, "root", "left")
        if met.filter("next is not null").isEmpty():
            return forms
        forms = met.select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, limit: int = LIMIT, ratio: int = RATIO, least: int = MIN_LENGTH, least_count: int = MIN_COUNT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the dictionary."""
    known = dictionary(docs, least, least_count)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = near_words(blocks(known, limit)).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    has = -F.col("best.less") >= ratio * F.col("n")
    told = stage(known.join(near, "word", "left").select("word", F.when(has, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(has, -F.col("best.less")).alias("form_n")), "forms")
    last = roots(told.filter("form is not null").select("word", F.col("form").alias("root")))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
