"""Operator 13: exact top-k by inner product, with block-at-a-time pruning.

A vector is the integers floor(256 * x). Terms are the signed components: for a query's positive component a block's term
maximum is the largest value of that component in the block, for a negative one the smallest. The sum over a query's terms
bounds every score in the block from above.

1. Index: vectors are ordered by cell (nearest of CELLS centroids) and id, by range partitions over the cluster, and cut into
   blocks of BLOCK consecutive vectors, CHUNK / BLOCK blocks to a row. A row holds the forward index (all integers of its
   vectors); block maxima and minima follow from it. Cells only order the vectors, so that a block's bounds are tight; every
   vector is indexed, and results don't depend on them.
2. Queries (every vec_id that 50 divides) travel in groups of GROUP. Each is first scored in its own block: the kth score
   there is a threshold before anything is sent.
3. Groups meet chunks, LANE groups at a time with one copy of the chunk. There the blocks of each query are ordered by bound, and
   scored through the forward index in rounds of 1, 2, 4, ... blocks, each block for all queries that want it at once; a
   query stops when the bound of its next block is under its kth score. Blocks whose bound equals it are scored: a tie may
   have the smaller id.
4. What each chunk found, k rows a query at most, is ranked by (score, vec_id).

Integers up to 2^24 are exact in 32-bit floats, up to 2^53 in 64-bit ones; sums that may exceed these run on Python's integers.

Edge cases: vectors that are null, or hold a null or non-finite component, and rows without vec_id take no part; vectors may
differ in length, and what a shorter one lacks counts as 0; an empty vector scores 0 with all; a row is its own query's only
non-candidate, so a copy of it, under its id or another, is a candidate, and a repeated query row gives its rows again; scores
beyond a long stay at its ends, and are equal there; fewer candidates than k give fewer rows; without vectors, or queries, there are none;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, map_arrow, stage, to_batch

#: Every so many ids is a query; results of a query.
EVERY, TOP = 50, 5
#: Vectors in a block, and in a row of the index.
BLOCK, CHUNK = 64, 8192
#: Queries that travel together, and groups that meet one copy of a chunk.
GROUP, LANE = 256, 32
#: Components that a chunk holds at most, unless a block has more; components of the sample that centroids are fitted on.
COMPONENTS = 1 << 20
#: Centroids that order the vectors, fitted on at most SAMPLE rows (the least hashes) in ROUNDS steps.
CELLS, SAMPLE, ROUNDS = 256, 16_384, 6

INDEX = pa.schema([("part", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary()), ("width", pa.int32()), ("wide", pa.bool_()), ("vectors", pa.binary())])
INDEX_TYPE = "part int, nth bigint, ids binary, width int, wide boolean, vectors binary"
QUERIES = pa.schema([("grp", pa.int64()), ("ids", pa.binary()), ("chunks", pa.binary()), ("places", pa.binary()), ("floors", pa.binary()), ("width", pa.int32()), ("wide", pa.bool_()), ("vectors", pa.binary())])
QUERIES_TYPE = "grp bigint, ids binary, chunks binary, places binary, floors binary, width int, wide boolean, vectors binary"
FOUND = pa.schema([("query_id", pa.int64()), ("home", pa.int64()), ("place", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_TYPE = "query_id bigint, home bigint, place bigint, vec_id bigint, score bigint"
LONG = (-(2**63), 2**63 - 1)
LEAST = -(10**700)  #: under any inner product of finite components


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(finite)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists as rows, shorter ones filled up with 0."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max()) if len(sizes) else 0
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def pack(values: np.ndarray) -> tuple[bool, bytes]:
    """Integers as 16-bit ones where they fit, else as the floats that they are."""
    wide = bool(len(values)) and bool(values.size) and float(np.abs(values).max()) > 32_767
    return wide, np.ascontiguousarray(values, "<f8" if wide else "<i2").tobytes()


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x), as floats."""
    most = np.finfo("f8").max
    with np.errstate(over="ignore"):
        return np.floor(np.clip(256 * values, -most, most))


def held_long(scores: np.ndarray) -> np.ndarray:
    """Python's integers stay in the range of a long; floats are far from its ends."""
    return np.minimum(np.maximum(scores, LONG[0]), LONG[1]) if scores.dtype == object else scores


def as_long(x) -> int:
    return min(max(int(x), LONG[0]), LONG[1])


def unpack(held: bytes, rows: int, width: int, wide: bool) -> np.ndarray:
    return np.frombuffer(held, "<f8" if wide else "<i2").reshape(rows, width)


def exact_type(a: np.ndarray, b: np.ndarray):
    """A type in which inner products of the rows of a and b are exact."""
    if not a.size or not b.size:
        return np.float32
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * min(a.shape[1], b.shape[1])
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def as_type(values: np.ndarray, kind) -> np.ndarray:
    if kind is object and values.dtype != object:
        return np.array([[int(x) for x in row] for row in values], object).reshape(values.shape)
    return values.astype(kind)


def fit_width(values: np.ndarray, width: int) -> np.ndarray:
    """Rows with exactly ``width`` components; a component that the other side lacks adds nothing."""
    if values.shape[1] >= width:
        return values[:, :width]
    return np.concatenate([values, np.zeros((len(values), width - values.shape[1]), values.dtype)], axis=1)


def centroids(vectors: DataFrame, width: int) -> np.ndarray:
    """Centres of a bounded sample: they decide the order of vectors, and nothing of the result."""
    many = max(1, min(SAMPLE, COMPONENTS // max(width, 1)))
    cells = max(1, min(CELLS, many // 8))
    rows = vectors.orderBy(F.xxhash64("vec_id", "embedding")).limit(many).select("embedding").toArrow()
    if not rows.num_rows:
        return np.zeros((1, 0))
    points = np.clip(matrix(rows.column("embedding").combine_chunks()), -1e9, 1e9)
    centres = points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int)]
    for _ in range(ROUNDS):
        near = nearest(points, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    # neighbouring numbers for neighbouring centres: along the direction in which they differ most
    spread = centres - centres.mean(axis=0)
    along = spread @ np.linalg.svd(spread, full_matrices=False)[2][0] if spread.size else np.zeros(len(centres))
    return centres[np.argsort(along, kind="stable")]


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(points @ centres.T - (centres * centres).sum(axis=1) / 2, axis=1)


def index(vectors: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Staged rows of INDEX, up to ``chunk`` vectors each in their order; ``part`` and ``nth`` say which partition made it."""
    used = usable(vectors)
    width = used.agg(F.max(F.size("embedding")).alias("w")).first().w or 1
    chunk = max(block, min(chunk, COMPONENTS // max(width, 1)))
    centres = Shared(vectors.sparkSession, centroids(used, width))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = np.clip(fit_width(matrix(batch.column("embedding")), centres.value.shape[1]), -1e9, 1e9)
                yield pa.RecordBatch.from_arrays([pa.array(nearest(points, centres.value), pa.int32()), *batch.columns], ["cell", "vec_id", "embedding"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        many = made = 0

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, many, made
            table = pa.Table.from_batches(held).combine_chunks()
            start = 0
            while many - start >= chunk or (last and start < many):
                part = table.slice(start, chunk)
                values = integers(matrix(part.column("embedding").combine_chunks()))
                wide, body = pack(values)
                yield to_batch({"part": [TaskContext.get().partitionId()], "nth": [made], "ids": [part.column("vec_id").to_numpy().astype("<i8").tobytes()], "width": [values.shape[1]], "wide": [wide], "vectors": [body]}, INDEX)
                made += 1
                start += part.num_rows
            held, many = table.slice(start).to_batches(), many - start

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                many += batch.num_rows
            if many >= chunk:
                yield from rows(False)
        if many:
            yield from rows(True)

    # rows of one id and cell are told apart by a number, so none of them makes a large partition
    placed = map_arrow(used, place, "cell int, vec_id bigint, embedding array<double>").withColumn("number", F.monotonically_increasing_id())
    ordered = stage(placed, "placed").repartitionByRange("cell", "vec_id", "number").sortWithinPartitions("cell", "vec_id", "number")
    return stage(map_arrow(ordered, cut, INDEX_TYPE), "vector-index")


def with_numbers(indexed: DataFrame) -> DataFrame:
    """The index with chunks numbered from 0: a partition's first number follows from the sizes of those before it."""
    sizes = indexed.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition of the index
    first = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    return indexed.join(F.broadcast(first), "part").select((F.col("first") + F.col("nth")).alias("chunk"), "ids", "width", "wide", "vectors")


def best(scores: np.ndarray, ids: np.ndarray, owner: np.ndarray, top: int) -> np.ndarray:
    """Rows of the ``top`` best (score, then id) of each owner."""
    order = np.lexsort((ids, -scores, owner))
    own = owner[order]
    start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
    return order[rank < top]


def kth(scores: np.ndarray, top: int):
    """The kth best of each row, or None if there are fewer."""
    return np.partition(scores, scores.shape[1] - top, axis=1)[:, scores.shape[1] - top] if scores.shape[1] >= top else None


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Summed term maxima: (queries, blocks)."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def block_extremes(values: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.arange(0, len(values), block)
    return np.maximum.reduceat(values, starts, axis=0), np.minimum.reduceat(values, starts, axis=0)


def queries_of(numbered: DataFrame, every: int = EVERY, top: int = TOP, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """Rows of QUERIES: query rows in groups, each query with its chunk and place, and the kth score in its own block."""

    def asked(row: dict) -> Iterator[dict]:
        ids = np.frombuffer(row["ids"], "<i8")
        asks = np.flatnonzero(ids % every == 0)
        if not len(asks):
            return
        values = unpack(row["vectors"], len(ids), row["width"], row["wide"])
        floors = np.full(len(asks), LONG[0], "<i8")
        for b in np.unique(asks // block):
            mine = np.flatnonzero(asks // block == b)
            near = values[b * block : (b + 1) * block]
            kind = exact_type(near, near)
            scores = as_type(values[asks[mine]], kind) @ as_type(near, kind).T
            if scores.shape[1] > top:  # without the query itself there are ``top`` others
                other = np.arange(scores.shape[1]) != (asks[mine] - b * block)[:, None]
                floors[mine] = [as_long(x) for x in kth(scores[other].reshape(len(mine), -1), top)]
        for a in range(0, len(asks), group):
            on = asks[a : a + group]
            wide, body = pack(values[on].astype("f8"))
            yield {"ids": ids[on].tobytes(), "chunks": np.full(len(on), row["chunk"], "<i8").tobytes(), "places": on.astype("<i8").tobytes(), "floors": floors[a : a + group].tobytes(), "width": row["width"], "wide": wide, "vectors": body}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[dict]] = {}
        made = 0

        def flush(key: tuple) -> pa.RecordBatch:
            nonlocal made
            rows, made = held.pop(key), made + 1
            return to_batch({"grp": [made], "width": [key[0]], "wide": [key[1]], **{c: [b"".join(r[c] for r in rows)] for c in ("ids", "chunks", "places", "floors", "vectors")}}, QUERIES)

        for batch in batches:
            for row in batch.to_pylist():
                for ask in asked(row):
                    key = (ask["width"], ask["wide"])
                    held.setdefault(key, []).append(ask)
                    if sum(len(r["ids"]) for r in held[key]) >= 8 * group:
                        yield flush(key)
        for key in list(held):
            yield flush(key)

    return map_arrow(numbered, run, QUERIES_TYPE)


def search_chunk(ids: np.ndarray, values: np.ndarray, ask: dict, chunk: int, top: int, block: int, seen: list | None = None) -> pa.RecordBatch:
    """The best of a chunk for each query of a group, those under its threshold left out. ``seen`` gets the scored pairs."""
    own_ids, own_chunk, places, floors = (np.frombuffer(ask[c], "<i8") for c in ("ids", "chunks", "places", "floors"))
    width = min(ask["width"], values.shape[1])
    queries = fit_width(unpack(ask["vectors"], len(own_ids), ask["width"], ask["wide"]), width)
    docs = values[:, :width]
    kind = exact_type(queries, docs)
    queries, docs = as_type(queries, kind), as_type(docs, kind)
    high, low = block_extremes(docs, block)
    over = held_long(bounds(queries, high, low))
    order = np.argsort(-over, axis=1, kind="stable")
    ranked = np.take_along_axis(over, order, axis=1)
    floor = np.array([int(f) if f > LONG[0] else LEAST for f in floors], object) if kind is object else np.where(floors > LONG[0], floors.astype(np.float64), -np.inf)
    home = np.where(own_chunk == chunk, places, -1)
    kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, docs.dtype))  # query, place, score
    at, step = 0, 1
    while at < over.shape[1]:
        wanted = ranked[:, at : at + step] >= floor[:, None]
        if not wanted.any():
            break
        q, r = np.nonzero(wanted)
        b = order[q, at + r]
        by_block = np.argsort(b, kind="stable")
        q, b = q[by_block], b[by_block]
        cut = np.append(np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])), len(b))
        found = [kept]
        for s, e in zip(cut, cut[1:]):
            first = b[s] * block
            own = q[s:e]
            scores = held_long(queries[own] @ docs[first : first + block].T)
            least = kth(scores, top + 1)  # one of them may be the query itself
            bar = floor[own] if least is None else np.maximum(floor[own], least)
            i, j = np.nonzero(scores >= bar[:, None])
            other = home[own[i]] != first + j
            i, j = i[other], j[other]
            found.append((own[i], first + j, scores[i, j]))
            if seen is not None:
                seen.append((e - s) * scores.shape[1])
        query, place, score = (np.concatenate(c) for c in zip(*found))
        on = best(score, ids[place], query, top)
        kept = query[on], place[on], score[on]
        many = np.bincount(kept[0], minlength=len(queries))
        last = np.cumsum(many) - 1
        full = many >= top
        if full.any():
            floor[full] = np.maximum(floor[full], kept[2][last[full]])
        at, step = at + step, step * 2
    query, place, score = kept
    on = score >= floor[query]
    query, place, score = query[on], place[on], score[on]
    return to_batch({"query_id": own_ids[query], "home": own_chunk[query], "place": places[query], "vec_id": ids[place], "score": [as_long(x) for x in score]}, FOUND)


def top_k(vectors: DataFrame, every: int = EVERY, top: int = TOP, block: int = BLOCK, chunk: int = CHUNK, group: int = GROUP, lane: int = LANE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` best rows for each row whose vec_id ``every`` divides, itself left out."""
    numbered = with_numbers(index(vectors, block, chunk))
    asks = stage(queries_of(numbered, every, top, block, group), "queries")
    lanes = max(1, -(-asks.count() // lane))
    chunks = numbered.agg(F.count("*").alias("n")).first().n
    kept = ["grp", "ids", "chunks", "places", "floors", "width", "wide", "vectors"]
    # a chunk comes before the groups of its lane, so a task holds one chunk and one group
    shelves = numbered.select("chunk", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(None).cast("bigint").alias("grp"), "ids", *[F.lit(None).cast("binary").alias(c) for c in ("chunks", "places", "floors")], "width", "wide", "vectors")
    sent = asks.select(F.explode(F.sequence(F.lit(0), F.lit(max(chunks, 1) - 1)).cast("array<bigint>")).alias("chunk"), F.pmod(F.xxhash64("ids", "grp"), F.lit(lanes)).cast("int").alias("lane"), *kept)
    met = shelves.unionByName(sent).repartition("chunk", "lane").sortWithinPartitions("chunk", "lane", F.asc_nulls_first("grp"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = values = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["grp"] is None:
                    ids = np.frombuffer(row["ids"], "<i8")
                    values = unpack(row["vectors"], len(ids), row["width"], row["wide"])
                else:
                    yield search_chunk(ids, values, row, row["chunk"], top, block)

    found = map_arrow(met, score, FOUND_TYPE)
    rank = F.row_number().over(Window.partitionBy("query_id", "home", "place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
