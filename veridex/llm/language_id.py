"""Operator 2: language identification by the nearest of several centroids per language.

A text is a vector of hashed byte n-grams (one to three bytes of its letters, lower-cased), weighted by TF-IDF and
normalised. A bounded sample of each language is clustered into a few centroids by spherical k-means; a document gets
the language of the centroid of highest cosine. A document whose cosine is under the reach of that centroid (a low
quantile of its own members) is marked ``rejected``: far from everything that was learned.

Every language of the training rows is learned, up to LANGUAGES of them, those of most ids. The model, which the driver and
each worker hold, takes 64 KB a language: 256 MB at that bound.

Edge cases: null texts and texts without a letter are "und" with score 0; with no training rows every document is "und";
a language with fewer rows than centroids gets one centroid per distinct row; of centroids that are equally near, the
first by language name counts; rows that repeat an id and language count once, by the one of least text, in samples and
sizes alike, so a language has a row in the sample however its rows repeat; a text of any length takes time in
proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, map_arrow, slices, stage, to_batch
from .toxicity import remainder

#: Rows of a language that its centroids are fitted to, about; centroids of a language; bins of the n-gram hash.
SAMPLE = 1_000
#: Languages that are learned at most.
LANGUAGES = 4_000
CENTROIDS = 4
BINS = 4096
REACH = 0.005

_LETTER = re.compile(r"[^\W\d_]")
_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[[b for b in range(128) if not chr(b).isalpha()]] = 32


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def counts(texts: list[str | None]) -> np.ndarray:
    """A row of n-gram counts for each text."""
    encoded = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(e) + 2 for e in encoded])
    data = _KEEP[np.frombuffer(b"".join(b" " + e + b" " for e in encoded), np.uint8)]
    row = np.repeat(np.arange(len(texts)), sizes)
    if len(data) > 1:  # runs of blanks count as one
        fresh = np.concatenate([[True], (data[1:] != 32) | (data[:-1] != 32) | (row[1:] != row[:-1])])
        data, row = data[fresh], row[fresh]
    out = np.zeros(len(texts) * BINS, np.int64)
    value = np.zeros(len(data), np.uint32)
    for n in (1, 2, 3):
        if len(data) < n:
            break
        value = value[: len(data) - n + 1] * np.uint32(256) + data[n - 1 :]
        bins = (value * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(20)
        same = row[: len(value)] == row[n - 1 :]
        out += np.bincount(row[: len(value)][same] * BINS + bins[same], minlength=len(out))
    return out.reshape(len(texts), BINS)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows, with damped counts."""
    x = np.log1p(tf).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds: centroids, and the reach of each."""
    seeds = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)) and near.min() < 1 - 1e-6:
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        new = np.stack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
    cos = x @ c.T
    own = np.argmax(cos, axis=1)
    reach = np.array([np.quantile(cos[own == i, i], REACH) if (own == i).any() else 1.0 for i in range(len(c))])
    return c.astype(np.float32), reach


def learn(docs: DataFrame, per_language: int = SAMPLE, k: int = CENTROIDS, languages: int = LANGUAGES) -> dict:
    """idf, centroids, their languages and reaches, from rows with a language whose crc32(doc_id) mod 4 is not 2."""
    doc = F.col("doc_id").cast("bigint")
    rows = docs.select(doc.alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(doc, 4) != 2))
    # by the hash of an id: a row of least hash stands for its language whatever the share
    chance = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 20)) / float(1 << 20)
    sizes = rows.select("doc_id", "lang").distinct().groupBy("lang").agg(F.count("*").alias("n"), F.min(chance).alias("least")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not sizes:
        return {"idf": np.zeros(BINS, np.float32), "centroids": np.zeros((0, BINS), np.float32), "langs": [], "reach": np.zeros(0)}
    share = docs.sparkSession.createDataFrame([(r.lang, max(min(1.0, per_language / r.n), r.least + 2.0**-21)) for r in sizes], "lang string, share double")
    chosen = rows.join(F.broadcast(share), "lang").filter(chance < F.col("share")).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("bins", pa.binary()), ("tf", pa.binary())])
        for batch in batches:
            for part in slices(batch):
                tf = counts(part.column("text").to_pylist())
                used = [np.flatnonzero(t) for t in tf]
                yield to_batch({"doc_id": part.column("doc_id"), "lang": part.column("lang"), "bins": [u.astype("<u2").tobytes() for u in used], "tf": [t[u].astype("<u4").tobytes() for t, u in zip(tf, used)]}, schema)

    sample = stage(map_arrow(chosen, measure, "doc_id bigint, lang string, bins binary, tf binary"), "language-sample")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BINS, np.int64), 0
        for batch in batches:
            for bins in batch.column(0).to_pylist():
                total[np.frombuffer(bins, "<u2")] += 1
                n += 1
        used = np.flatnonzero(total)
        yield to_batch({"bin": [*used, -1], "n": [*total[used], n]}, pa.schema([("bin", pa.int32()), ("n", pa.int64())]))

    df, n = np.zeros(BINS), 0
    for row in map_arrow(sample.select("bins"), spread, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        if row.bin < 0:
            n = row.n
        else:
            df[row.bin] = row.n
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.05)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "bins", "tf"]).head(2 * per_language)
        tf = np.zeros((len(group), BINS), np.float32)
        for i, (bins, t) in enumerate(zip(group.bins, group.tf)):
            tf[i, np.frombuffer(bins, "<u2")] = np.frombuffer(t, "<u4")
        c, reach = cluster(vectors(tf, idf), k)
        return pd.DataFrame({"lang": group.lang.iloc[0], "k": range(len(c)), "reach": reach, "centroid": [v.tobytes() for v in c]})

    # a group is the bounded sample of one language
    got = sample.groupBy("lang").applyInPandas(fit, "lang string, k int, reach double, centroid binary").orderBy("lang", "k").collect()
    return {"idf": idf, "centroids": np.stack([np.frombuffer(r.centroid, np.float32) for r in got]), "langs": [r.lang for r in got], "reach": np.array([r.reach for r in got])}


def predict(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it is rejected as too far, of each text."""
    letters = np.array([has_letter(t) for t in texts], bool)
    langs = np.array(model["langs"], object)
    if not len(langs):
        return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    cos = vectors(counts(texts), model["idf"]) @ model["centroids"].T
    best = np.argmax(cos, axis=1)
    top = cos[np.arange(len(texts)), best]
    other = np.where(langs[None, :] == langs[best][:, None], -1.0, cos).max(axis=1)
    score = np.where(letters, np.clip(top * 1 / (1 + np.exp(-20.0 * (top - other))), 0, 1), 0.0)
    return [lang if ok else "und" for lang, ok in zip(langs[best], letters)], score.astype(float), ~letters | (top < model["reach"][best])


def report(docs: DataFrame, per_language: int = SAMPLE, k: int = CENTROIDS) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected."""
    shared = Shared(docs.sparkSession, learn(docs, per_language, k))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lang, score, far = predict(shared.value, part.column("text").to_pylist())
                yield to_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "lang_pred": lang, "score": score, "rejected": far}, schema)

    doc = F.col("doc_id").cast("bigint")
    source = docs.select(doc.alias("doc_id"), "text", F.coalesce(remainder(doc, 4) == 2, F.lit(False)).alias("held_out"))
    return map_arrow(source, run, "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")
