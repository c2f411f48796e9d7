"""Principal components of tables of any length: products on executors, blocks of a few columns on the driver.

The covariance of up to TILED features is summed in tiles, by partition and then in two rounds of partial sums, and stays a
table. Leading eigenpairs come from block subspace iteration: a basis of the current vectors, their residuals and the last steps
is multiplied by the covariance in one job, and the small problem inside the basis is solved on the driver, which holds
width x 3k numbers. Wider tables are not summed up at all: each multiplication is a pass over the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage

#: Features of a tile's side; features up to which the covariance is summed, and then kept as a table.
TILE, TILED = 256, 4_096
#: Vectors beside the wanted ones; steps at most; residual, as a share of the largest eigenvalue, at which a pair is done.
EXTRA, STEPS, TOLERANCE = 6, 300, 1e-13
#: First merges of one tile's sums.
LANES = 32
# Negative eigenvalues up to this share of the largest are rounding; closer neighbours are not told apart.
CLAMP, DEGENERATE = 2.0**-40, 2.0**-26

_SUMS = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("lane", pa.int32()), ("body", pa.binary())])
_SUMS_TYPE = "a int, b int, lane int, body binary"


@dataclass
class Components:
    values: np.ndarray  #: eigenvalues, falling
    vectors: np.ndarray  #: width x k, columns
    residuals: np.ndarray  #: |A v - l v| of each
    trace: float  #: sum of all eigenvalues
    identifiability: list[str]  #: unique or degenerate
    means: np.ndarray
    rows: int


def complete(df: DataFrame, vector: str, width: int) -> DataFrame:
    """Rows whose vector has ``width`` known finite elements; all others are left out of a fit."""
    v = F.col(vector).cast("array<double>")
    return df.select(v.alias("x")).filter((F.size("x") == width) & F.forall("x", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False))))


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def merged(sums: DataFrame) -> DataFrame:
    """Sums of equal (a, b), in two rounds, so that no task reads the partial sums of all partitions at once."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (a, b, lane); one sum is held."""
        key, total = None, None
        for batch in batches:
            for a, b, lane, body in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b, lane) != key:
                    if key is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((*key, total.tobytes()), _SUMS)], schema=_SUMS)
                    key, total = (a, b, lane), np.frombuffer(body).copy()
                else:
                    total += np.frombuffer(body)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((*key, total.tobytes()), _SUMS)], schema=_SUMS)

    first = sums.repartition("a", "b", "lane").sortWithinPartitions("a", "b", "lane").mapInArrow(add, _SUMS_TYPE)
    return first.withColumn("lane", F.lit(0)).repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(add, _SUMS_TYPE)


def _emit(blocks: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    lane = TaskContext.get().partitionId() % LANES
    for (a, b), body in blocks.items():
        yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((a, b, lane, np.ascontiguousarray(body).tobytes()), _SUMS)], schema=_SUMS)


def means(rows: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """Means of all features, and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + 1)
        for batch in batches:
            x = _rows(batch, width)
            total += np.append(x.sum(axis=0), len(x))
        yield from _emit({(0, 0): total})

    found = merged(rows.mapInArrow(run, _SUMS_TYPE)).collect()  # one row
    total = np.frombuffer(found[0].body) if found else np.zeros(width + 1)
    return total[:-1] / max(total[-1], 1), int(total[-1])


def covariance_tiles(rows: DataFrame, width: int, centre: np.ndarray, n: int, tile: int = TILE) -> DataFrame:
    """(a, b, body): tiles of the upper triangle of the covariance, staged; tile a has the features from a * tile on."""
    shift = rows.sparkSession.sparkContext.broadcast(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _rows(batch, width) - shift.value
            total += x.T @ x
        starts = range(0, width, tile)
        yield from _emit({(a, b): total[i : i + tile, j : j + tile] / (n - 1) for a, i in enumerate(starts) for b, j in enumerate(starts) if a <= b})

    return stage(merged(rows.mapInArrow(run, _SUMS_TYPE)), "covariance")


def _product(sums: DataFrame, width: int, columns: int, tile: int) -> np.ndarray:
    """Merged blocks of a width x columns product on the driver."""
    out = np.zeros((width, columns))
    for r in merged(sums).collect():
        out[r.a * tile : (r.a + 1) * tile] = np.frombuffer(r.body).reshape(-1, columns)
    return out


def by_tiles(tiles: DataFrame, width: int, tile: int = TILE) -> Callable[[np.ndarray], np.ndarray]:
    """A function that multiplies the covariance by a block of columns."""

    def multiply(block: np.ndarray) -> np.ndarray:
        held = tiles.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, found = held.value, {}
            for batch in batches:
                for r in batch.to_pylist():
                    a, b = r["a"], r["b"]
                    left, right = q[a * tile : (a + 1) * tile], q[b * tile : (b + 1) * tile]
                    body = np.frombuffer(r["body"]).reshape(len(left), len(right))
                    found[a, 0] = found.get((a, 0), 0) + body @ right
                    if a != b:
                        found[b, 0] = found.get((b, 0), 0) + body.T @ left
            yield from _emit(found)

        out = _product(tiles.select("a", "b", "body").mapInArrow(run, _SUMS_TYPE), width, block.shape[1], tile)
        held.destroy()
        return out

    return multiply


def by_rows(rows: DataFrame, width: int, centre: np.ndarray, n: int, tile: int = TILE) -> Callable[[np.ndarray], np.ndarray]:
    """The same without the covariance: X'(X q), one pass over the rows."""

    def multiply(block: np.ndarray) -> np.ndarray:
        held = rows.sparkSession.sparkContext.broadcast((block, centre))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, shift = held.value
            total = np.zeros(q.shape)
            for batch in batches:
                x = _rows(batch, width) - shift
                total += x.T @ (x @ q)
            yield from _emit({(a, 0): total[i : i + tile] / (n - 1) for a, i in enumerate(range(0, width, tile))})

        out = _product(rows.mapInArrow(run, _SUMS_TYPE), width, block.shape[1], tile)
        held.destroy()
        return out

    return multiply


def leading(multiply: Callable[[np.ndarray], np.ndarray], width: int, k: int, extra: int = EXTRA, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, residuals) of the k largest eigenvalues of a symmetric matrix that is known by its products."""
    held = min(width, k + extra)
    if 3 * held >= width:  # the whole space is no larger than the basis
        values, vectors = np.linalg.eigh(multiply(np.eye(width)))
        x = vectors[:, ::-1][:, :k]
        product, found = multiply(x), values[::-1][:k]
        return found, x, np.linalg.norm(product - x * found, axis=0)
    x = np.linalg.qr(np.random.default_rng(20240607).normal(size=(width, held)))[0]
    basis, best, since = x, np.inf, 0
    for _ in range(steps):
        basis = np.linalg.qr(basis)[0]
        product = multiply(basis)
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        turn, values = turn[:, ::-1][:, :held], values[::-1][:held]
        new, image = basis @ turn, product @ turn
        rest = image - new * values
        residuals = np.linalg.norm(rest[:, :k], axis=0)
        worst = residuals.max() / max(abs(values[0]), 1e-300)
        since = 0 if worst < best / 2 else since + 1
        best = min(best, worst)
        if worst <= tolerance or (since > 8 and worst < 1e-11):  # no closer: the rounding of the products
            return values[:k], new[:, :k], residuals
        basis, x = np.concatenate([new, rest, new - x @ (x.T @ new)], axis=1), new
        norms = np.linalg.norm(basis, axis=0)
        basis = basis[:, norms > 0] / norms[norms > 0]
    raise ArithmeticError(f"{k} components did not converge in {steps} steps: the last residual is {worst:.3g} of the largest eigenvalue")


def canonical_signs(vectors: np.ndarray, labels: Sequence[str]) -> np.ndarray:
    """Columns whose largest element is positive; of equally large ones the first by label, in any case, then by place."""
    order = sorted(range(len(labels)), key=lambda i: (labels[i].casefold(), i))
    pivot = np.array(order)[np.argmax(np.abs(vectors[order]), axis=0)]
    at = vectors[pivot, np.arange(vectors.shape[1])]
    if (at == 0).any():
        raise ValueError("a vector of zeros has no sign: ask for fewer components")
    return vectors * np.where(at < 0, -1.0, 1.0)


def identifiability(values: np.ndarray, following: float | None) -> list[str]:
    """unique, or degenerate where a neighbour is so close that the two vectors can be turned into each other."""
    near = np.abs(np.diff(values)) <= DEGENERATE * max(abs(values[0]), 1e-300) if len(values) else np.zeros(0, bool)
    close = np.append(near, following is not None and abs(values[-1] - following) <= DEGENERATE * max(abs(values[0]), 1e-300)) | np.insert(near, 0, False)
    return ["degenerate" if c else "unique" for c in close]


def principal_components(df: DataFrame, vector: str, k: int, width: int | None = None, labels: Sequence[str] | None = None, tiled: int = TILED) -> Components:
    """The k leading components of the covariance of array rows. Rows that aren't complete are left out; ``width`` is that of
    the longest vector if it isn't given."""
    if width is None:
        width = df.agg(F.max(F.size(vector)).alias("w")).first().w or 0
    if not 0 < k <= width:
        raise ValueError(f"{k} components of {width} features")
    rows = complete(df, vector, width)
    centre, n = means(rows, width)
    if n < 2:
        raise ValueError(f"a covariance needs two complete rows, there are {n}")
    if width <= tiled:
        tiles = covariance_tiles(rows, width, centre, n)
        multiply = by_tiles(tiles, width)
    else:
        multiply = by_rows(rows, width, centre, n)
    asked = min(width, k + 1)  # one more, to tell whether the last is degenerate
    values, vectors, residuals = leading(multiply, width, asked)
    values = np.where((values < 0) & (values >= -CLAMP * max(abs(values[0]), 1e-300)), 0.0, values)
    total = sum(r.v for r in rows.select(F.aggregate(F.zip_with("x", F.lit([float(c) for c in centre]), lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda s, v: s + v).alias("v")).agg(F.sum("v").alias("v")).collect())
    signed = canonical_signs(vectors[:, :k], list(labels) if labels else [f"{i:09d}" for i in range(width)])
    return Components(values[:k], signed, residuals[:k], total / (n - 1), identifiability(values[:k], float(values[k]) if asked > k else None), centre, n)


def component_rows(spark, found: Components) -> DataFrame:
    """(component, eigenvalue, share, residual, orthonormality, identifiability, feature, loading): k x width rows."""
    gram = np.abs(found.vectors.T @ found.vectors - np.eye(len(found.values))).max(axis=1)
    heads = [(c + 1, float(found.values[c]), float(found.values[c] / found.trace) if found.trace else 0.0, float(found.residuals[c]), float(gram[c]), found.identifiability[c], [float(x) for x in found.vectors[:, c]]) for c in range(len(found.values))]
    table = spark.createDataFrame(heads, "component int, eigenvalue double, share double, residual double, orthonormality double, identifiability string, loadings array<double>")
    return table.select("component", "eigenvalue", "share", "residual", "orthonormality", "identifiability", F.posexplode("loadings").alias("feature", "loading"))


def scores(df: DataFrame, keys: list[str], vector: str, found: Components) -> DataFrame:
    """The keys with pc1, pc2, ...: dot products in the scan; NULL for rows that aren't complete."""
    v = F.col(vector).cast("array<double>")
    whole = (F.size(v) == len(found.means)) & F.forall(v, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    dot = lambda w: F.aggregate(F.zip_with(v, F.lit([float(x) for x in w]), lambda a, b: a * b), F.lit(-float(found.means @ w)), lambda s, x: s + x)
    return df.select(*keys, *[F.when(whole, dot(found.vectors[:, c])).alias(f"pc{c + 1}") for c in range(len(found.values))])
