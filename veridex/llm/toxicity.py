"""Operator 5: toxicity by a weighted lexicon, matched with Aho-Corasick after folding disguises.

Folding lower-cases, maps homoglyphs to Latin letters, and reads digits and signs inside a word as the letters they stand
for. Lexicon entries are whole words or word beginnings; their weights are smoothed log odds of toxic against other
documents, counted over a bounded sample of labelled rows. Of several entries that match one word the heaviest counts.
A hit inside an exception phrase doesn't count. The sum is normalised by length and mapped to 0..1 by a logistic curve
that is fitted to the same sample.

The lexicon has no cap: an entry needs a share of the toxic rows, so there are at most as many entries as a row offers on
average, divided by that share.

Edge cases: null and empty texts score as texts without a hit; a sample without toxic rows gives an empty lexicon and
scores near the base rate; labels that are null, or rows without text, are not learned from; an id with both labels
counts as toxic; of rows that repeat a labelled id the one of least text is learned from, and each gets its score; equal
texts have equal scores; a text of any length, unbroken ones too, takes time in proportion to its length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, map_arrow, parts, stage, to_batch

#: Labelled rows of each class that the lexicon is learned from, at most.
SAMPLE = 15_000
#: Toxic documents that an entry needs, as a number and as a share; its least weight.
SUPPORT, SUPPORT_SHARE, LEAST = 3, 0.004, 3.0
PREFIXES = (4, 5, 6)

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans("аеорсухіјѕһԁԛԝвкмнтαβεικνορτυχ", "aeopcyxijshdqwbkmhtabeiknoptux")
# Digits and signs that stand for letters.
_LEET = str.maketrans("0134579@$!|", "oieastgasii")
# Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "class clown", "circus clown", "pond scum", "sore loser", "lossless", "pathetic fallacy", "stupid question")

_SPECIAL = re.compile("[^\x00-ɏ]").search
_TOKEN = re.compile(r"[a-z0-9@$!|]+")
# a letter, signs, a letter; or signs before a letter that stand at a word's start or go on after an @ or $. Possessive
# repeats and starts at a run's first sign only keep both linear.
_DISGUISED = re.compile(r"[a-z][0134579@$!|]++[a-z]|(?<![0134579@$])(?=[0134579@$]++[a-z])(?:(?<![a-z0-9])|[0134579]*+[@$][0134579@$])").search
_MAYBE = re.compile(r"[0-9@$!|]").search
_GAP = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Words in plain letters, with one space before, between and after them."""
    if not text:
        return "  "
    text = text.lower()
    if _SPECIAL(text):
        text = unicodedata.normalize("NFKC", text).lower().translate(_LOOKALIKES)
    if _MAYBE(text):
        text = _TOKEN.sub(lambda m: m[0].rstrip("@$!|").translate(_LEET) if _MAYBE(m[0]) and _DISGUISED(m[0]) else m[0], text)
    return f" {_GAP.sub(' ', text).strip()} "


def entries(folded: str) -> set[str]:
    """What a document offers to the lexicon: " word " and " beginning" of several lengths."""
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) > n}


@dataclass
class Lexicon:
    weights: dict[str, float]
    slope: float
    offset: float
    exceptions: tuple[str, ...] = EXCEPTIONS

    def __post_init__(self):
        self.matcher = None

    def __getstate__(self):
        return {**self.__dict__, "matcher": None}

    def _build(self):
        self.matcher = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            self.matcher.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            self.matcher.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.matcher.make_automaton()

    def total(self, folded: str) -> tuple[float, int]:
        """Sum of the weights of words hit, and their number."""
        if self.matcher is None:
            self._build()
        best: dict[int, float] = {}
        safe: list[tuple[int, int]] = []  # spans of phrases, by their ends
        for end, (size, weight) in self.matcher.iter(folded):
            start = end - size + 1
            if weight is None:
                safe.append((start, end))
            elif best.get(start, -math.inf) < weight:
                best[start] = weight
        if safe:
            # both ascend, so one pass does: of the phrases that end after a hit starts, the one that starts first decides
            ends = [b for _, b in safe]
            reach = np.minimum.accumulate([a for a, _ in reversed(safe)])[::-1]
            starts = np.array(sorted(best), np.int64)
            first = np.searchsorted(ends, starts, side="right")
            inside = (first < len(ends)) & (np.append(reach, 0)[first] <= starts)
            best = {s: best[s] for s in starts[~inside].tolist()}
        return sum(best.values()), len(best)

    def raw(self, text: str | None) -> tuple[float, int]:
        """Weight of the hits, normalised by length: a hit in a long text weighs less, but never nothing."""
        folded = fold(text)
        total, hits = self.total(folded)
        return total / math.sqrt(1 + math.log1p(len(folded) / 64)), hits

    def score(self, text: str | None) -> tuple[float, int]:
        raw, hits = self.raw(text)
        z = max(-60.0, min(60.0, self.slope * raw + self.offset))
        return 1 / (1 + math.exp(-z)), hits


def sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, held_out: F.Column) -> DataFrame:
    """(doc_id, label, text) of at most ``per_class`` documents of each class, chosen by a hash of doc_id.

    An id counts once: with the greater of its labels, and the least of its texts.
    """
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & ~held_out)
    named = rows.filter("label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    pick = lambda c: named.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(per_class)
    chosen = pick(0).unionByName(pick(1))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # at most 2 * per_class ids are broadcast; least texts are found before the shuffle, so a repeated id is one row of it
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def remainder(doc_id: F.Column, divisor: int) -> F.Column:
    return F.crc32(doc_id.cast("bigint").cast("string").cast("binary")) % divisor


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a small ridge."""
    if len(x) == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
        return 0.0, math.log(max(rate, 1e-4) / max(1 - rate, 1e-4))
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 1e-2 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-2])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def learn(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Lexicon:
    """The lexicon of a bounded sample of labelled rows whose crc32(doc_id) mod 4 is not 2."""
    chosen = sample(docs, labels, "toxic", per_class, remainder(F.col("doc_id"), 4) == 2)
    rows = stage(chosen.filter("text is not null").select("text", "label"), "toxicity-sample")  # read three times

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("entry", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])
        count: dict[str, list[int]] = {}
        for batch in parts(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for e in entries(fold(text)):
                    count.setdefault(e, [0, 0])[1 - label] += 1
            if len(count) > 300_000:
                yield to_batch({"entry": list(count), "pos": [v[0] for v in count.values()], "neg": [v[1] for v in count.values()]}, schema)
                count = {}
        yield to_batch({"entry": list(count), "pos": [v[0] for v in count.values()], "neg": [v[1] for v in count.values()]}, schema)

    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    support = max(SUPPORT, math.ceil(SUPPORT_SHARE * pos))
    counted = map_arrow(rows, offer, "entry string, pos bigint, neg bigint").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    found = counted.filter(F.col("pos") >= support).withColumn("weight", odds).filter(F.col("weight") >= LEAST).collect()
    lexicon = Lexicon({r.entry: float(r.weight) for r in sorted(found, key=lambda r: r.entry)}, 1.0, 0.0)
    shared = Shared(docs.sparkSession, lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("x", pa.float64()), ("y", pa.int32())])
        for batch in parts(batches):
            yield to_batch({"x": [shared.value.raw(t)[0] for t in batch.column(0).to_pylist()], "y": batch.column(1)}, schema)

    got = map_arrow(rows, measure, "x double, y int").collect()  # two numbers for each row of the bounded sample
    x, y = np.array([r.x for r in got]), np.array([r.y for r in got], float)
    order = np.lexsort((y, x))
    slope, offset = fit_curve(x[order], y[order])
    if pos and neg:  # the sample is balanced by class; the curve is for the share of toxic rows among the labelled
        total = labels.filter(F.col("toxic").isNotNull() & (remainder(F.col("doc_id"), 4) != 2)).agg(F.avg("toxic").alias("r")).first().r
        if total and 0 < total < 1:
            offset += math.log(total / (1 - total)) - math.log(pos / neg)
    return Lexicon(lexicon.weights, slope, offset)


def report(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score >= 0.3), hits."""
    shared = Shared(docs.sparkSession, learn(docs, labels, per_class))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("hits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            got = [shared.value.score(t) for t in batch.column(1).to_pylist()]
            yield to_batch({"doc_id": batch.column(0), "held_out": batch.column(2), "score": [s for s, _ in got], "predicted": [int(s >= 0.3) for s, _ in got], "hits": [h for _, h in got]}, schema)

    doc = F.col("doc_id").cast("bigint")
    source = docs.select(doc.alias("doc_id"), "text", F.coalesce(remainder(doc, 4) == 2, F.lit(False)).alias("held_out"))
    return map_arrow(source, run, "doc_id bigint, held_out boolean, score double, predicted int, hits bigint")
