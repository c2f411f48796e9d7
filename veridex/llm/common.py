"""What the operators share: input columns, staged tables, Arrow map passes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .. import staging
from ..staging import discard, release, shared_dir  # noqa: F401

#: Rows of one Arrow batch; with SLICE_BYTES it bounds what a Python worker holds at once.
BATCH_ROWS = 512
SLICE_BYTES = 512 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Long texts must fit, so batches have fewer rows than the defaults, which are made for narrow rows.
SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.parquet.columnarReaderBatchSize": BATCH_ROWS}


@contextmanager
def small_batches(spark: SparkSession):
    """Small Arrow and Parquet batches for what runs inside; the session's own settings come back after it."""
    before = {key: spark.conf.get(key) for key in SMALL}
    for key, rows in SMALL.items():
        spark.conf.set(key, min(rows, int(before[key])))
    try:
        yield
    finally:
        for key, rows in before.items():
            spark.conf.set(key, rows)


def isolated(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` with its settings and small batches, for plans that run after their function returns."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.get(key, None) != value:
            try:
                own.conf.set(key, value)
            except PySparkException:  # a static setting: the same for all sessions
                continue
    for key, rows in SMALL.items():
        own.conf.set(key, min(rows, int(spark.conf.get(key))))
    return own


def stage(df: DataFrame, name: str) -> DataFrame:
    """A staged table, written in small batches."""
    with small_batches(df.sparkSession):
        return staging.stage(df, name)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over Arrow batches. A batch has 64 MB at most, Spark's own bound; functions take larger ones apart by slices()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()  # workers live on; what they held must not

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``limit`` bytes, one row at least."""
    sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + (size or 0) > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size or 0
    if start < len(sizes):
        yield batch.slice(start)


def parts(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, column)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of the operator's own that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


class Shared:
    """A read-only value for map functions: a Spark broadcast on executors, or the value itself in tests."""

    def __init__(self, spark: SparkSession | None, value):
        self._held = spark.sparkContext.broadcast(value) if spark is not None else None
        self._own = None if spark is not None else value

    @property
    def value(self):
        return self._own if self._held is None else self._held.value
