"""Operator 4: quality by a factorisation machine over hashed words, structure statistics and text length.

score = logistic(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): the sum-of-squares identity takes
all pairwise interactions in time linear in the features. Inputs are the damped, normalised counts of hashed words, and
standardised statistics of the text's structure. It is fitted by mini-batch Adam to a class-balanced sample, bounded in rows
and in words, of labelled rows whose crc32(doc_id) mod 3 is not 1.

Edge cases: null and empty texts have no words and zero statistics, and get a score like any other; without labelled
rows, or with one class, the score is the smoothed share of label 1; an id with both labels counts as label 1; of rows
that repeat a labelled id the one of least text is learned from, and each gets its score; equal texts have equal scores; a
text of any length takes time in proportion to its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, map_arrow, release, slices, stage, to_batch
from .textkit import encode, gram_hashes, hash_words, inside
from .toxicity import remainder, sample

#: Labelled rows of each class that the model is fitted to, at most; bins of the word hash; factors.
SAMPLE = 4_000
#: Word bins of a class's sample at most: what the driver holds of it, whatever the length of its texts.
ENTRIES = 4_000_000
BINS = 1 << 15
FACTORS = 8
EPOCHS = 8
_UPPER, _DIGIT, _SIGN, _BAR, _PUNCT = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SIGN[[ord(c) for c in "#*$%&<>@^~=+\\/{}[]_"]] = True
_BAR[ord("|")] = True
_PUNCT[[ord(c) for c in ".,;:!?'\"()-"]] = True
STATS = 14


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse word features (row, bin, value) and a dense row of statistics for each text."""
    raw = encode(texts)
    words = hash_words(raw)
    n = len(texts)
    docs = words.docs()
    per = np.maximum(np.diff(words.offsets), 0).astype(np.float64)
    low = hash_words([t.lower() for t in raw])
    pair, count = np.unique(docs.astype(np.int64) * BINS + (low.hashes % np.uint64(BINS)).astype(np.int64), return_counts=True)
    row, bins = pair // BINS, pair % BINS
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(row, value * value, n))
    value = value / np.maximum(norm[row], 1e-9)

    size = np.array([len(t) for t in raw], np.float64)
    place = np.repeat(np.arange(n), (size + 1).astype(np.int64))
    share = lambda table: np.bincount(place[table[words.data]], minlength=n) / np.maximum(size, 1)
    words_safe = np.maximum(per, 1)
    distinct = np.bincount(np.unique(np.column_stack([docs, words.hashes.view(np.int64)]), axis=0)[:, 0], minlength=n) if len(docs) else np.zeros(n)
    start = inside(words, 5)
    repeated = np.zeros(n)
    if len(start):
        grams = gram_hashes(words.hashes, 5)[start]
        own = docs[start]
        order = np.lexsort((grams, own))
        g, d = grams[order], own[order]
        same = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
        repeated = np.bincount(d[1:][same], minlength=n) / np.maximum(np.bincount(own, minlength=n), 1)
    lines = np.array([t.count(b"\n") + 1 if t else 0 for t in raw], np.float64)
    fresh = np.array([len(set(t.split(b"\n"))) if t else 0 for t in raw], np.float64)
    length = (words.ends - words.starts).astype(np.float64)
    mean = np.bincount(docs, length, n) / words_safe
    deviation = np.sqrt(np.maximum(np.bincount(docs, length * length, n) / words_safe - mean * mean, 0))
    signed = _SIGN[words.data[words.ends - 1]] if len(docs) else np.zeros(0, bool)
    stats = np.column_stack([
        np.log1p(size), np.log1p(per), mean / 8, deviation / 8, share(_UPPER) * 4, share(_DIGIT) * 10, share(_SIGN) * 10, share(_BAR) * 20,
        share(_PUNCT) * 10, distinct / words_safe, repeated * 3, 1 - fresh / np.maximum(lines, 1), np.bincount(docs, signed, n) / words_safe, np.log1p(lines),
    ])
    return row, bins, value, stats


class Machine:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.mean, self.scale, self.w0, self.w, self.v = mean, scale, w0, w, v

    @staticmethod
    def rows(row, bins, value, stats, mean, scale):
        """All features of the texts as (row, column, value), rows ascending; statistics are the columns after the bins."""
        n = len(stats)
        dense = np.clip((stats - mean) / scale, -4, 4) / math.sqrt(STATS)
        row = np.concatenate([row, np.repeat(np.arange(n), STATS)])
        column = np.concatenate([bins, np.tile(np.arange(BINS, BINS + STATS), n)])
        value = np.concatenate([value, dense.ravel()])
        order = np.argsort(row, kind="stable")
        return row[order], column[order], value[order]

    def logits(self, row, column, value, n: int) -> np.ndarray:
        first = np.searchsorted(row, np.arange(n))
        linear = np.add.reduceat(self.w[column] * value, first)
        vx = self.v[column] * value[:, None]
        s = np.add.reduceat(vx, first, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), first)
        return self.w0 + linear + 0.5 * ((s * s).sum(axis=1) - squares)

    def score(self, texts: list[str | None]) -> np.ndarray:
        row, bins, value, stats = features(texts)
        z = self.logits(*self.rows(row, bins, value, stats, self.mean, self.scale), len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(row, bins, value, stats, y: np.ndarray, base: float, seed: int = 5) -> Machine:
    """Mini-batch Adam on log loss with weight decay; the prior moves from the balanced sample to ``base``."""
    rng = np.random.default_rng(seed)
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-3
    row, column, value = Machine.rows(row, bins, value, stats, mean, scale)
    n, size = len(y), BINS + STATS
    first = np.append(np.searchsorted(row, np.arange(n)), len(row))
    m = Machine(mean, scale, 0.0, np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)))
    m1, m2 = np.zeros((size, FACTORS + 1)), np.zeros((size, FACTORS + 1))
    b1 = b2 = 0.0
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        rate = 0.02 / (1 + epoch)
        for k in range(0, n, 128):
            part = order[k : k + 128]
            at = np.concatenate([np.arange(first[i], first[i + 1]) for i in part])
            r = np.repeat(np.arange(len(part)), first[part + 1] - first[part])
            c, x = column[at], value[at]
            vx = m.v[c] * x[:, None]
            s = np.stack([np.bincount(r, vx[:, f], len(part)) for f in range(FACTORS)], axis=1)
            z = m.w0 + np.bincount(r, m.w[c] * x, len(part)) + 0.5 * ((s * s).sum(axis=1) - np.bincount(r, (vx * vx).sum(axis=1), len(part)))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            used, place = np.unique(c, return_inverse=True)
            each = np.column_stack([g[r] * x, (g[r] * x)[:, None] * (s[r] - vx)])
            grad = np.stack([np.bincount(place, each[:, f], len(used)) for f in range(FACTORS + 1)], axis=1)
            grad[:, 0] += 1e-5 * m.w[used]
            grad[:, 1:] += 1e-4 * m.v[used]
            step += 1
            m1[used] = 0.9 * m1[used] + 0.1 * grad
            m2[used] = 0.99 * m2[used] + 0.01 * grad * grad
            move = rate * (m1[used] / (1 - 0.9**step)) / (np.sqrt(m2[used] / (1 - 0.99**step)) + 1e-8)
            m.w[used] -= move[:, 0]
            m.v[used] -= move[:, 1:]
            b1, b2 = 0.9 * b1 + 0.1 * g.sum(), 0.99 * b2 + 0.01 * g.sum() ** 2
            m.w0 -= rate * (b1 / (1 - 0.9**step)) / (math.sqrt(b2 / (1 - 0.99**step)) + 1e-8)
    share = (y.sum() + 0.5) / (n + 1)
    m.w0 += math.log(base / (1 - base)) - math.log(share / (1 - share))
    return m


def learn(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, entries: int = ENTRIES) -> Machine:
    held = remainder(F.col("doc_id"), 3) == 1
    rows = sample(docs, labels, "quality", per_class, held)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("bins", pa.binary()), ("value", pa.binary()), ("stats", pa.binary())])
        for batch in batches:
            for part in slices(batch):
                row, bins, value, stats = features(part.column("text").to_pylist())
                at = np.searchsorted(row, np.arange(part.num_rows + 1))
                cut = lambda x: [x[a:b].tobytes() for a, b in zip(at, at[1:])]  # noqa: E731, B023
                yield to_batch({"doc_id": part.column("doc_id"), "label": part.column("label"), "bins": cut(bins.astype("<u2")), "value": cut(value.astype("<f4")), "stats": [s.tobytes() for s in stats]}, schema)

    measured = stage(map_arrow(rows, measure, "doc_id bigint, label int, bins binary, value binary, stats binary"), "quality-sample")
    # in the order that the sample was chosen in, as many rows as have ``entries`` word bins in all, one at least
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sizes = measured.select("doc_id", "label", (F.length("bins") / 2).alias("n"))  # 2 * per_class narrow rows at most
    fits = sizes.withColumn("so_far", F.sum("n").over(order)).filter((F.col("so_far") <= entries) | (F.col("so_far") == F.col("n")))
    got = measured.join(fits.select("doc_id", "label"), ["doc_id", "label"], "left_semi").collect()  # 12 * entries bytes, about, at most
    release(measured)
    got.sort(key=lambda r: r.doc_id)
    y = np.array([r.label for r in got], float)
    base = labels.filter(F.col("quality").isNotNull() & ~held).agg(F.avg("quality").alias("r"), F.count("*").alias("n")).first()
    share = ((base.r or 0.0) * base.n + 0.5) / (base.n + 1)
    if not len(y) or y.min() == y.max():
        return Machine(np.zeros(STATS), np.ones(STATS), math.log(share / (1 - share)), np.zeros(BINS + STATS), np.zeros((BINS + STATS, FACTORS)))
    bins = [np.frombuffer(r.bins, "<u2").astype(np.int64) for r in got]
    row = np.repeat(np.arange(len(got)), [len(b) for b in bins])
    return fit(row, np.concatenate(bins), np.concatenate([np.frombuffer(r.value, "<f4") for r in got]).astype(float), np.stack([np.frombuffer(r.stats) for r in got]), y, share)


def report(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score >= 0.5)."""
    machine = learn(docs, labels, per_class)
    machine.v = machine.v.astype(np.float32)
    shared = Shared(docs.sparkSession, machine)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = shared.value.score(part.column("text").to_pylist())
                yield to_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": score, "predicted": (score >= 0.5).astype(np.int32)}, schema)

    doc = F.col("doc_id").cast("bigint")
    source = docs.select(doc.alias("doc_id"), "text", F.coalesce(remainder(doc, 3) == 1, F.lit(False)).alias("held_out"))
    return map_arrow(source, run, "doc_id bigint, held_out boolean, score double, predicted int")
