"""What both repeat removers share: runs of windows, exact grouping of candidate windows, and cutting words out of texts.

Candidates are runs of consecutive windows that one minimiser n-gram stands for: (doc_key, doc_id, start, gram, salts, windows).
Equal windows have the same gram, so grouping by gram brings all occurrences of a window together. Grams of moderate
count (salts = 0) are grouped where they land. Of hot ones, which may stand in a third of all rows, equal runs are first
reduced to one with partial aggregation; windows are counted over these, and the verdicts are joined back. ``salts`` says
into how many chunks the rows of a hot gram are dealt, about SALTED rows of equal runs to a chunk.

Edge cases: texts without a window (null, empty and short ones) give no candidates; a repeated row is another occurrence; a
null doc_id is counted with the others and nothing of it is cut; rows of one doc_id and text share their spans, which are
held once however many the rows are, and another text under that doc_id has its own; a table without rows gives no spans;
texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_arrow, parts, release, stage, to_batch
from .textkit import Words, gram_hashes, inside, minimisers

#: Equal runs of a hot gram in one chunk, about.
SALTED = 250
CANDIDATES = "doc_key bigint, doc_id bigint, start int, gram bigint, salts int, windows binary"
CANDIDATE_SCHEMA = pa.schema([("doc_key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("gram", pa.int64()), ("salts", pa.int32()), ("windows", pa.binary())])
SPANS = "doc_key bigint, a int, b int"
SPAN_SCHEMA = pa.schema([("doc_key", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def key_of(doc_id: Column, text: Column) -> Column:
    """What rows of one doc_id and text, and rows of one text without a doc_id, have in common."""
    return F.xxhash64(doc_id, text)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, doc_key) of docs; marks and spans go by doc_key. Marks name their gram as well, so even texts whose keys
    collide take only marks that they would have made themselves."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return own.withColumn("doc_key", key_of(F.col("doc_id"), F.col("text")))


def marked(marks: DataFrame) -> DataFrame:
    """(doc_key, places) of (doc_key, place, gram, salts): each place of a text once, however many rows repeat it, so at most as
    many as the text has words."""
    once = marks.groupBy("doc_key", "place", "gram").agg(F.max("salts").alias("salts"))
    return once.groupBy("doc_key").agg(F.collect_list(F.struct("place", "gram", "salts")).alias("places"))


def placed_salts(words: Words, at: np.ndarray, marked: list[list[dict]], gram: int) -> np.ndarray:
    """For each minimiser place ``at`` its salts, or -1 if it isn't among the marked places of its text.

    A mark holds for its own gram only: texts that share a key may have a hot gram and another one at the same place.
    """
    state = np.full(len(words.hashes), -1, np.int64)
    keys = gram_hashes(words.hashes, gram).view(np.int64)
    for i, places in enumerate(marked):
        begin, end = words.offsets[i], min(words.offsets[i + 1], len(keys))
        for p in places:
            k = begin + p["place"]
            if k < end and keys[k] == p["gram"]:
                state[k] = max(state[k], p["salts"])
    return state[at]


def runs(words: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser: index of the first window's word, number of windows, place of the minimiser."""
    start = inside(words, width)
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    at = minimisers(words.hashes, width, gram)[start]
    # a minimiser belongs to one text, so a new text is a new place
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return start[new], np.diff(np.append(new, len(at))), at[new]


def gram_keys(words: Words, places: np.ndarray, gram: int) -> np.ndarray:
    return gram_hashes(words.hashes, gram)[places]


def window_keys(words: Words, width: int) -> np.ndarray:
    """A 64-bit key of the window that starts at each word."""
    return gram_hashes(words.hashes, width, base=0xC2B2AE3D27D4EB4F)


def candidate_rows(words: Words, keys_of: pa.Array, doc_ids: pa.Array, width: int, first: np.ndarray, count: np.ndarray, keys: np.ndarray, salts: np.ndarray) -> dict:
    """Columns of CANDIDATES for chosen runs."""
    value = window_keys(words, width)
    doc = np.searchsorted(words.offsets, first, side="right") - 1
    return {
        "doc_key": keys_of.take(pa.array(doc)),
        "doc_id": doc_ids.take(pa.array(doc)),
        "start": first - words.offsets[doc],
        "gram": keys.view(np.int64),
        "salts": salts,
        "windows": [value[a : a + n].tobytes() for a, n in zip(first, count)],
    }


def salts_for(count: np.ndarray, hot: int) -> np.ndarray:
    """0 for grams that occur less than ``hot`` times, else the parts that their rows are dealt into."""
    return np.where(count >= hot, -(-count.astype(np.int64) // SALTED), 0)


def whole_grams(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Sorted rows in tables that hold all rows of each of their grams, of ``rows`` rows at least but the last."""
    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if held > rows:  # the last gram may go on in this batch: hold its rows back
            table = pa.Table.from_batches(waiting).combine_chunks()
            own = table.column("gram").to_numpy()
            cut = table.num_rows if own[-1] != batch.column("gram")[0].as_py() else int(np.searchsorted(own, own[-1]))
            if cut:
                yield table.slice(0, cut)
            rest = table.slice(cut)
            waiting, held = rest.to_batches(), rest.num_rows
        waiting.append(batch)
        held += batch.num_rows
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def cut_keys(doc_keys: pa.Array, doc_ids: pa.Array) -> pa.Array:
    """Keys of the rows that are cut: those without a doc_id have none."""
    return pa.compute.if_else(pa.compute.is_valid(doc_ids), doc_keys, pa.scalar(None, pa.int64()))


def span_rows(doc_keys: pa.Array, row: np.ndarray, at: np.ndarray, width: int) -> pa.RecordBatch:
    """Runs of neighbouring windows as spans: ``at`` are starts of windows of rows ``row``, sorted by row and start."""
    if not len(row):
        return to_batch({"doc_key": [], "a": [], "b": []}, SPAN_SCHEMA)
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]))
    last = np.append(new[1:], len(row)) - 1
    keys = doc_keys.take(pa.array(row[new]))
    return to_batch({"doc_key": keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys, "a": at[new], "b": at[last] + width}, SPAN_SCHEMA)


def repeated_spans(candidates: DataFrame, width: int, keep_first: bool = False) -> DataFrame:
    """(doc_key, a, b): words a..b of a text lie in windows that start more than once in all candidates.

    With ``keep_first`` the occurrence of least (doc_id, start) of each window is left out, in all rows that repeat it.
    """

    def solve(table: pa.Table) -> pa.RecordBatch:
        """Rows with complete grams: sort windows, and compare neighbours."""
        held = table.column("windows").to_pylist()
        count = np.fromiter((len(h) >> 3 for h in held), np.int64, len(held))
        value = np.frombuffer(b"".join(held), np.uint64)
        row = np.repeat(np.arange(len(held)), count)
        at = np.arange(len(value)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(table.column("start").to_numpy(), count)
        gram = table.column("gram").to_numpy()[row]
        doc = table.column("doc_id").fill_null(-(2**63)).to_numpy()[row]
        order = np.lexsort((at, doc, value, gram))
        g, v = gram[order], value[order]
        same = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        if keep_first:
            start = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0))
            least = order[start]  # a row that repeats doc_id and start is the first occurrence too
            twice &= (doc[order] != doc[least]) | (at[order] != at[least])
        hit = np.sort(order[twice])
        return span_rows(cut_keys(table.column("doc_key"), table.column("doc_id")), row[hit], at[hit], width)

    def usual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_grams(batches, 4096):
            yield solve(table)

    candidates = stage(candidates, "candidates")  # read twice
    spans = map_arrow(candidates.filter("salts = 0").repartition("gram").sortWithinPartitions("gram"), usual, SPANS)
    return spans.unionByName(frequent_spans(candidates.filter("salts > 0"), width, keep_first))


def frequent_spans(frequent: DataFrame, width: int, keep_first: bool = False) -> DataFrame:
    """The same for candidates of hot grams, by partial aggregation.

    Rows that repeat a text and start are counted into one. Equal runs of windows meet in chunks of about SALTED of these first,
    so a run that stands in a third of all documents is one row for each SALTED of them wherever it is a join's key;
    nothing is copied to meet it.
    """
    once = frequent.groupBy("gram", "windows", "doc_key", "doc_id", "start").agg(F.max("salts").alias("salts"), F.count("*").alias("times"))
    salt = F.pmod(F.xxhash64("doc_key", "start"), F.col("salts")).cast("int").alias("salt")
    chunks = stage(once.groupBy("gram", "windows", salt).agg(F.sum("times").alias("times"), F.collect_list(F.struct("doc_id", "start", "doc_key")).alias("rows")), "chunks")
    weights = [F.sum("times").alias("c")] + ([F.min(F.array_min("rows")).alias("first")] if keep_first else [])
    kinds = stage(chunks.groupBy("gram", "windows").agg(*weights), "kinds")  # equal runs of windows, once each
    numbered = kinds.withColumn("w", F.expr("explode(transform(sequence(0, cast(length(windows) div 8 as int) - 1), i -> struct(i as i, substring(windows, 8 * i + 1, 8) as value)))"))
    numbered = numbered.select("gram", "windows", "w.i", "w.value", "c", *([F.struct(F.col("first.doc_id").alias("doc_id"), (F.col("first.start") + F.col("w.i")).alias("at")).alias("first")] if keep_first else []))
    measures = [F.sum("c").alias("n")] + ([F.min("first").alias("least")] if keep_first else [])
    # staged tables, so that both sides of a join are plain exchanges, and a key of many rows can be split
    known = stage(numbered.groupBy("gram", "value").agg(*measures).filter("n > 1").drop("n"), "known")
    verdict = numbered.select("gram", "windows", "i", "value").join(known, ["gram", "value"])
    mark = F.struct("i", *(["least"] if keep_first else []))
    marks = stage(verdict.groupBy("gram", "windows").agg(F.array_sort(F.collect_list(mark)).alias("marks")), "marks")  # a run has as many as windows
    release(kinds, known)
    found = chunks.join(marks, ["gram", "windows"]).select("rows", "marks")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows, ats = [], [], []
            for members, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for r in members:
                    on = [r["start"] + m["i"] for m in marks if not keep_first or m["least"] != {"doc_id": r["doc_id"], "at": r["start"] + m["i"]}]
                    rows += [len(docs)] * len(on)
                    ats += on
                    docs.append(None if r["doc_id"] is None else r["doc_key"])
            yield span_rows(pa.array(docs, pa.int64()), np.array(rows, np.int64), np.array(ats, np.int64), width)

    return map_arrow(found, merge, SPANS)


def collected(spans: DataFrame) -> DataFrame:
    """(doc_key, spans): a text's spans in one row, each once; at most as many as it has words."""
    once = spans.filter("doc_key is not null").distinct()
    return once.groupBy("doc_key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """docs with a column ``name`` (null where nothing repeats); every row stays."""
    key, own = fresh(docs.withColumn(name, F.lit(None)), "found_key", "own_key")
    found = collected(spans).select(F.col("doc_key").alias(key), F.col("spans").alias(name))
    cut_key = F.when(F.col("doc_id").isNotNull(), key_of(F.col("doc_id").cast("bigint"), F.col("text")))
    return docs.withColumn(own, cut_key).join(found, F.col(own) == F.col(key), "left").drop(key, own)


def cut(text: str | None, spans: list[dict] | None) -> tuple[list[bytes], int]:
    """The words that stay, and how many go."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if not spans:
        return words, 0
    gone = np.zeros(len(words) + 1, np.int32)
    for s in spans:
        if s["a"] < len(words):
            gone[s["a"]] += 1
            gone[min(s["b"], len(words))] -= 1
    stay = np.cumsum(gone[:-1]) == 0
    return [words[i] for i in np.flatnonzero(stay)], int(len(words) - stay.sum())


def digests(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by a space."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = [cut(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield to_batch({"doc_id": batch.column(0), "n_words": [len(w) + n for w, n in rows], "n_removed": [n for _, n in rows], "kept_sha256": [hashlib.sha256(b" ".join(w)).hexdigest() for w, _ in rows]}, schema)

    source = with_spans(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), spans, "spans")
    return map_arrow(source, run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def removed(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the repeated words cut out of ``text`` and ``n_chars`` renewed; texts without repeats stay as they are."""

    (name,) = fresh(docs, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            at = batch.schema.get_field_index("text")
            found = batch.column(name).to_pylist()
            texts = [t if not s else b" ".join(cut(t, s)[0]).decode("utf-8", "surrogatepass") for t, s in zip(batch.column("text").to_pylist(), found)]
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).drop_columns([name])

    out = map_arrow(with_spans(docs, spans, name), run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
