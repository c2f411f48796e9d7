"""Operator 7: near-duplicates by SuperMinHash signatures, banding, verification on whole sets, and components.

SuperMinHash gives each set element a random permutation of the signature's slots; the j-th slot of an element gets
j + a random fraction, and a slot keeps its least value. Ranks of one element are correlated, which lowers the variance,
and since values of step j are under those of step j + 1, a document stops at the step that fills its last slot.

1. Documents with equal shingle sets become one row each, the least doc_id.
2. Rows that share a band fall into a bucket. Each bucket compares its members with one pivot, the member that shares
   most buckets with others; links are confirmed on whole sets, and components are built.
3. The members of buckets that still hold several components are compared across components, by prefixes: in one order
   of all shingles, rare ones first, two sets over the threshold share a shingle among the first n - ceil(t n) + 1 of each. So
   only members with a common shingle in their prefixes meet, and only at shingles that stand in prefixes of several components;
   the sets' sizes and the shingle's places must leave room for the threshold. Such pairs are confirmed on whole
   sets, so no link of a bucket is lost, and a large group that is one component already makes no pair.

The number of rows in a band is the largest that misses a pair at the threshold with a probability under MISS.

Edge cases: null and empty texts have no shingles and link with nothing; a text of fewer words than a shingle is one
shingle; repeated rows are copies; a null doc_id belongs to the group of its equals, or has a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from .common import Shared, fresh, map_arrow, release, slices, stage, to_batch
from .sketches import cells_for, count_min, estimate, key_count
from .textkit import encode, gram_hashes, hash_words, mix

SHINGLE, PERCENT = 3, 85
SLOTS = 252
MISS = 1e-5
#: Cells of the sketch that tells which shingles are rare, at most; a fuller one lets more pairs meet and loses none.
COUNTERS = 1 << 23
_DENSE_FROM = 6


def bands_for(percent: int, slots: int = SLOTS, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows of a band)."""
    s = percent / 100
    rows = max([r for r in range(1, 25) if (1 - s**r) ** (slots // r) <= miss], default=1)
    return slots // rows, rows


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, ASCII-lower-cased."""
    words = hash_words([t.lower() for t in encode(texts)])
    grams = gram_hashes(words.hashes, n)
    out = []
    for a, b in zip(words.offsets, words.offsets[1:]):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:  # the whole sequence, told apart from longer ones by its length
            out.append(mix(gram_hashes(words.hashes[a:b], int(b - a)) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures of all sets at once, step by step; empty sets keep infinity."""
    sizes = np.array([len(s) for s in sets])
    out = np.full((len(sets), slots), np.inf)
    doc = np.repeat(np.arange(len(sets)), sizes)
    element = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    swaps: list[np.ndarray] = []
    dense: np.ndarray | None = None
    flat = out.reshape(-1)
    for j in range(slots):
        if not len(element):
            break
        x = mix(element + np.uint64(((j + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        k = j + ((x >> np.uint64(40)) % np.uint64(slots - j)).astype(np.int64)
        value = j + (x & np.uint64((1 << 40) - 1)).astype(np.float64) / float(1 << 40)
        if dense is None and j >= _DENSE_FROM:  # few short texts are left: write their permutations out
            dense = np.tile(np.arange(slots, dtype=np.int16), (len(element), 1))
            rows = np.arange(len(element))
            for i, other in enumerate(swaps):
                dense[rows, i], dense[rows, other] = dense[rows, other], dense[rows, i].copy()
            swaps = []
        if dense is None:
            slot = k.copy()
            for i in range(j - 1, -1, -1):  # follow the swaps back to what stood at place k
                other = swaps[i]
                slot = np.where(slot == i, other, np.where(slot == other, i, slot))
            swaps.append(k)
        else:
            rows = np.arange(len(element))
            slot = dense[rows, k].astype(np.int64)
            dense[rows, k] = dense[rows, j]
            dense[rows, j] = slot
        at = doc * slots + slot
        free = flat[at] >= j  # a slot that an earlier step filled keeps its value
        np.minimum.at(flat, at[free], value[free])
        going = ~np.isfinite(out).all(axis=1)
        stay = going[doc]
        if not stay.all():
            doc, element = doc[stay], element[stay]
            swaps = [s[stay] for s in swaps]
            dense = dense[stay] if dense is not None else None
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = np.ascontiguousarray(signature[:, : bands * rows]).view(np.uint64).reshape(len(signature), bands, rows)
    key = np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0xA24BAED4963EE407) + np.uint64(1)
    for r in range(rows):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + bits[:, :, r])
    return key


def sizes_and_prints(sets: list[np.ndarray]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Size and two fingerprints of each set."""
    f1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    f2 = np.array([mix(s ^ np.uint64(0x94D049BB133111EB)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    return [len(s) for s in sets], f1, f2


def measure(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, n, f1, f2, bands): set size, set fingerprint, band keys."""
    bands, rows = bands_for(percent)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text").to_pylist(), shingle)
                keys = band_keys(signatures(sets), bands, rows).view(np.int64)
                n, f1, f2 = sizes_and_prints(sets)
                yield to_batch({"doc_id": part.column("doc_id"), "n": n, "f1": f1, "f2": f2, "bands": [k if len(s) else [] for k, s in zip(keys, sets)]}, schema)

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v), those with 100 * intersection >= percent * union on whole sets."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    left = sets.select(F.col("rep").alias("u"), F.col("grams").alias("gu"))
    right = sets.select(F.col("rep").alias("v"), F.col("grams").alias("gv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    on.append(False)
                    continue
                both = np.concatenate([a, b])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                on.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["u", "v"]).filter(pa.array(on, pa.bool_())).cast(schema)

    return map_arrow(pairs.join(left, "u").join(right, "v").select("u", "v", "gu", "gv"), run, "u bigint, v bigint")


def links(docs: DataFrame, measured: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(group, component): group has f1, f2, n and the least doc_id of equal sets; component has node and component."""
    group = measured.filter("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"))
    reps = measured.join(group.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), F.explode("bands").alias("band"))
    shared = reps.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1")
    buckets = stage(reps.join(shared.hint("merge"), "band"), "buckets")

    popular = buckets.groupBy("rep").agg(F.sum("c").alias("p"))
    weighed = buckets.join(popular, "rep")
    pivot = weighed.groupBy("band").agg(F.max_by("rep", F.struct("p", -F.col("rep"))).alias("pivot"))
    pivoted = stage(buckets.join(pivot, "band").select("band", "rep", "pivot"), "pivots")
    pairs = pivoted.filter("rep <> pivot").select(F.least("rep", "pivot").alias("u"), F.greatest("rep", "pivot").alias("v")).distinct()

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text").to_pylist(), shingle)
                yield to_batch({"rep": part.column("rep"), "n": [len(s) for s in sets], "grams": [s.tobytes() for s in sets]}, pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("grams", pa.binary())]))

    wanted = popular.select("rep")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text").join(wanted.hint("merge"), "rep", "left_semi")  # one plan for all sizes
    sets = stage(map_arrow(texts, grams, "rep bigint, n bigint, grams binary"), "sets")
    first = stage(confirm(pairs, sets, percent), "links")
    found = components(first)

    placed = pivoted.join(found, pivoted["rep"] == found["node"], "left").select("band", "rep", F.coalesce("component", "rep").alias("own"))
    mixed = placed.groupBy("band").agg(F.min("own").alias("a"), F.max("own").alias("b")).filter("a <> b").select("band")
    open_ = stage(placed.join(mixed, "band", "left_semi").select("rep", "own").distinct(), "open")
    members = stage(sets.join(open_, "rep"), "members")
    shingles = members.select("grams")
    counters = Shared(docs.sparkSession, count_min(shingles, min(COUNTERS, cells_for(key_count(shingles)))))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The prefix of each member; a shingle that no other has makes no pair, but takes its place."""
        schema = pa.schema([("gram", pa.int64()), ("rep", pa.int64()), ("own", pa.int64()), ("n", pa.int64()), ("place", pa.int64())])
        for batch in batches:
            if not batch.num_rows:
                continue
            kept, places, sizes = [], [], []
            for held in batch.column(batch.schema.get_field_index("grams")).to_pylist():
                grams = np.frombuffer(held, np.uint64)
                often = estimate(counters.value, grams)
                first = np.lexsort((grams, often))[: len(grams) - -(-percent * len(grams) // 100) + 1]
                places.append(np.flatnonzero(often[first] > 1))
                kept.append(grams[first[places[-1]]].view(np.int64))
                sizes.append(len(grams))
            row = np.repeat(np.arange(len(sizes)), [len(k) for k in kept])
            rep, own = (batch.column(batch.schema.get_field_index(c)).to_numpy()[row] for c in ("rep", "own"))
            yield to_batch({"gram": np.concatenate(kept), "rep": rep, "own": own, "n": np.array(sizes)[row], "place": np.concatenate(places)}, schema)

    prefixed = stage(map_arrow(members, prefixes, "gram bigint, rep bigint, own bigint, n bigint, place bigint"), "prefixes")
    # staged, so that both joins have plain exchanges, and a frequent shingle can be split
    release(members)
    contested = stage(prefixed.groupBy("gram").agg(F.min("own").alias("a"), F.max("own").alias("b")).filter("a <> b").select("gram"), "contested")
    sides = stage(prefixed.join(contested, "gram"), "sides")
    release(prefixed, contested)
    x = sides.select("gram", *[F.col(c).alias(f"{c}_x") for c in ("rep", "own", "n", "place")])
    y = sides.select("gram", *[F.col(c).alias(f"{c}_y") for c in ("rep", "own", "n", "place")])
    # at the first common shingle, the rest of the shorter side bounds the intersection; union = sizes - intersection
    most, sizes = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y")), F.col("n_x") + F.col("n_y")
    across = x.join(y, "gram").filter((F.col("own_x") != F.col("own_y")) & (F.col("rep_x") < F.col("rep_y")) & ((100 + percent) * most >= percent * sizes))
    rest = across.select(F.col("rep_x").alias("u"), F.col("rep_y").alias("v")).distinct()
    second = stage(confirm(rest, sets, percent), "links")
    release(buckets, pivoted, open_, sides, sets)
    if second.isEmpty():
        return group, found
    return group, components(first.unionByName(second))


def placed_rows(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Per row of docs: doc_id, n, f1, f2, component_id, kept."""
    measured = stage(measure(docs, shingle, percent), "shingles")
    group, found = links(docs, measured, shingle, percent)
    placed = group.join(found, F.col("rep") == F.col("node"), "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component"))
    out = measured.select("doc_id", "n", "f1", "f2").join(placed.hint("merge"), ["f1", "f2", "n"], "left")
    return out.select("doc_id", "n", "f1", "f2", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    return placed_rows(docs, shingle, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def fingerprinted(docs: DataFrame, shingle: int, names: list[str]) -> DataFrame:
    """docs with size and fingerprint of the shingle set in three columns of these names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values = sizes_and_prints(shingle_sets(part.column("text").to_pylist(), shingle))
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(v, pa.int64()) for v in values]], names=[*part.schema.names, *names])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in names]]))


def keep(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without near-duplicates: of each group the row of least doc_id stays, and one row of it if it is repeated.

    doc_id names a document: of rows that repeat one, with whatever texts, one stays, and none if a text of them copies a
    lesser document. A row without an id goes if it copies one with an id, or another one without; blank ones copy nothing.
    """
    rows = stage(placed_rows(docs, shingle, percent), "placed")
    again_, kept_, key_, stay_, blank_, place_, *prints = fresh(docs, "again", "whole", "key", "stay", "blank", "place", "size", "print1", "print2")
    # staged, as its size is then known to the planner, and a small side costs no exchange of the texts
    marks = stage(rows.filter("doc_id is not null").groupBy(F.col("doc_id").alias(key_)).agg((F.count("*") > 1).alias(again_), F.bool_and("kept").alias(kept_)), "marks")
    key = F.col("doc_id").cast("bigint") == F.col(key_)
    usual = docs.filter("doc_id is not null").join(marks.filter(F.col(again_) | ~F.col(kept_)).select(key_), key, "left_anti")

    again = stage(marks.filter(again_).select(key_), "again")
    odd = docs.filter("doc_id is not null").join(again, key, "left_semi").unionByName(docs.filter("doc_id is null"))
    stay = rows.join(again, F.col("doc_id") == F.col(key_), "left").filter(F.col("kept") & (F.col("doc_id").isNull() | F.col(key_).isNotNull()))
    stay = stay.select(F.col("doc_id").alias(stay_), *[F.col(c).alias(name) for c, name in zip(("n", "f1", "f2"), prints)]).distinct()
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(stay_))
    found = fingerprinted(odd, shingle, prints)
    for c in prints:
        same = same & (found[c] == stay[c])
    left = found.join(stay, same, "left_semi")
    # a number of its own for each blank row without an id
    blank = F.when(F.col("doc_id").isNull() & (F.col(prints[0]) == 0), F.monotonically_increasing_id())
    one = [F.col("doc_id"), *[F.when(F.col("doc_id").isNull(), F.col(c)) for c in prints], F.col(blank_)]
    numbered = left.withColumn(blank_, blank).withColumn(place_, F.row_number().over(Window.partitionBy(*one).orderBy("text", *prints)))
    return usual.unionByName(numbered.filter(F.col(place_) == 1).select(docs.columns))
