"""A cursor-paged service as a Spark data source, read from recorded responses.

A sweep is one chain of pages: each answer names the cursor of the next. Sweeps are the partitions of the read, so many
chains are followed at once, and a chain's answers are held one page at a time. A page that fails is asked again up to
``attempts`` times; if it keeps failing the sweep ends there. That makes it truncated, or unavailable if nothing came before,
and never complete: a shortfall is not a decision on the rows that are missing.

Recorded responses lie in a folder, a file for each attempt: ``<sweep>/<cursor>.<attempt>.json``. ``record_pages`` writes such a folder from
a table. The same reader serves a live service with another ``fetch``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIRST = "*"
ATTEMPTS, PAGE_ROWS, SWEEP_ROWS = 3, 200, 20_000
SCHEMA = (
    "sweep string, page int, cursor string, attempts int, position int, record string, "
    "outcome struct<status:string,hit_count:bigint,pages:int,attempts:int,retrieved:bigint,pagination_complete:boolean,detail:string>"
)
_OUTCOME = pa.struct([("status", pa.string()), ("hit_count", pa.int64()), ("pages", pa.int32()), ("attempts", pa.int32()), ("retrieved", pa.int64()), ("pagination_complete", pa.bool_()), ("detail", pa.string())])
_ARROW = pa.schema([("sweep", pa.string()), ("page", pa.int32()), ("cursor", pa.string()), ("attempts", pa.int32()), ("position", pa.int32()), ("record", pa.string()), ("outcome", _OUTCOME)])


class FetchError(RuntimeError):
    """A page that did not come; its text is the reason."""


def recorded(folder: str) -> Callable[[str, str, int], dict]:
    """fetch(sweep, cursor, attempt) of a folder of recorded responses, on any file system that Arrow knows."""
    store, root = fs.FileSystem.from_uri(folder)

    def fetch(sweep: str, cursor: str, attempt: int) -> dict:
        path = f"{root}/{quote(sweep, safe='')}/{quote(cursor, safe='')}.{attempt}.json"
        try:
            with store.open_input_stream(path) as f:
                answer = json.loads(f.read())
        except FileNotFoundError as e:
            raise FetchError(f"no answer is recorded for cursor {cursor}, attempt {attempt}") from e
        except ValueError as e:
            raise FetchError("the answer is no JSON") from e
        if not isinstance(answer, dict) or answer.get("status") != 200:
            raise FetchError(f"HTTP {answer.get('status') if isinstance(answer, dict) else None}")
        return answer

    return fetch


def follow(sweep: str, fetch: Callable[[str, str, int], dict], attempts: int = ATTEMPTS, limit: int | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA: records page by page, then one row with the outcome.

    Complete means that the cursor was exhausted, or that as many records came as the service reports hits. A cursor that
    repeats, or a page without records, ends a sweep as exhausted. ``limit`` stops it after the page that reaches it.
    """
    cursor, page, asked, got = FIRST, 0, 0, 0
    hits: int | None = None
    failure, exhausted = "", False
    while limit is None or got < limit:
        answer = None
        for attempt in range(1, attempts + 1):
            asked += 1
            try:
                answer = fetch(sweep, cursor, attempt)
                break
            except FetchError as e:
                failure = str(e)
        if answer is None:
            break
        failure = ""
        if hits is None:
            hits = int(answer.get("hitCount") or 0)
        found = [r for r in ((answer.get("resultList") or {}).get("result") or []) if isinstance(r, dict)]
        yield from ((sweep, page, cursor, attempt, k, json.dumps(r, ensure_ascii=False), None) for k, r in enumerate(found))
        page, got = page + 1, got + len(found)
        following = str(answer.get("nextCursorMark") or "").strip()
        if not found or not following or following == cursor:
            exhausted = True
            break
        cursor = following
    complete = not failure and (exhausted or (hits is not None and got >= hits))
    if not failure and exhausted and hits is not None and got < hits:
        failure = f"{hits} hits were reported and {got} came on all pages"
    status = "ok" if got else "unavailable" if hits is None else "no_hits"
    yield sweep, None, None, None, None, None, {"status": status, "hit_count": hits, "pages": page, "attempts": asked, "retrieved": got, "pagination_complete": complete, "detail": failure}


class _Sweep(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.attempts = int(options.get("attempts", ATTEMPTS))
        self.limit = int(options["limit"]) if "limit" in options else None
        self.batch = int(options.get("batch", 1_000))

    def partitions(self) -> list[_Sweep]:
        store, root = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [_Sweep(unquote(i.base_name)) for i in sorted(found, key=lambda i: i.base_name) if i.type == fs.FileType.Directory]

    def read(self, partition: _Sweep | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without sweeps
            return
        held: list[tuple] = []
        for row in follow(partition.name, recorded(self.folder), self.attempts, self.limit):
            held.append(row)
            if len(held) >= self.batch or row[-1]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)
                held = []


class PagedSource(DataSource):
    """``spark.read.format("veridex_paged")`` with options path, attempts and limit (records of a sweep)."""

    @classmethod
    def name(cls) -> str:
        return "veridex_paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_sweeps(spark: SparkSession, folder: str, attempts: int = ATTEMPTS, limit: int | None = None) -> DataFrame:
    """Records and outcomes of all sweeps of a folder, as rows of SCHEMA."""
    spark.dataSource.register(PagedSource)
    reader = spark.read.format("veridex_paged").option("attempts", attempts)
    return (reader if limit is None else reader.option("limit", limit)).load(folder)


def outcomes(rows: DataFrame) -> DataFrame:
    """A row for each sweep: status, hit_count, pages, attempts, retrieved, pagination_complete, detail."""
    return rows.filter("outcome is not null").select("sweep", "outcome.*")


def records(rows: DataFrame, schema: str) -> DataFrame:
    """Record columns with sweep, page, cursor, attempts, position and pagination_complete of their sweep."""
    told = outcomes(rows).select("sweep", "pagination_complete")
    own = rows.filter("record is not null").select("sweep", "page", "cursor", "attempts", "position", F.from_json("record", schema).alias("r"))
    return own.join(told, "sweep").select("sweep", "page", "cursor", "attempts", "position", "pagination_complete", "r.*")


def source_outcomes(sweeps: DataFrame, source: Column) -> DataFrame:
    """Sweeps of one source as one outcome: complete if all of them are, unavailable if all are."""
    by = sweeps.groupBy(source.alias("source_system")).agg(
        F.count("*").alias("sweeps"), F.sum("hit_count").alias("hit_count"), F.sum("pages").alias("pages"), F.sum("attempts").alias("attempts"), F.sum("retrieved").alias("retrieved"),
        F.every("pagination_complete").alias("pagination_complete"), F.every(F.col("status") == "unavailable").alias("_none"),
    )
    status = F.when(F.col("_none"), "unavailable").when(F.col("retrieved") == 0, "no_hits").otherwise("ok")
    return by.withColumn("status", status).drop("_none")


def sliced(df: DataFrame, source: str, key: str, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """``df`` with ``sweep``: a source's rows are dealt to chains of about ``sweep_rows`` by their integer key, so that a large
    source isn't one chain."""
    sizes = df.groupBy(source).agg(F.ceil(F.count("*") / sweep_rows).alias("_chains"))
    joined = df.join(sizes, df[source].eqNullSafe(sizes[source]), "left").drop(sizes[source])
    return joined.withColumn("sweep", F.concat_ws("/", F.coalesce(source, F.lit("")), F.pmod(key, "_chains").cast("string"))).drop("_chains")


def record_pages(df: DataFrame, folder: str, order: str, fields: list[str], failing: Column, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Write the pages of each ``sweep`` of ``df`` to ``folder``; per page (sweep, page, first, failed).

    ``failing`` tells from ``first``, the least ``order`` value of a page, how many attempts fail before one succeeds. Files are
    written under another name and moved, so an attempt that is run twice leaves whole ones.
    """
    place = F.row_number().over(Window.partitionBy("sweep").orderBy(order)) - 1  # a sweep has a bounded number of rows
    numbered = df.withColumn("_n", place).withColumn("page", F.floor(F.col("_n") / page_rows).cast("int"))
    hits = F.count("*").over(Window.partitionBy("sweep"))
    pages = numbered.withColumn("_hits", hits).groupBy("sweep", "page", "_hits").agg(F.min(order).alias("first"), F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.struct(*fields).alias("r")))), lambda x: x["r"])).alias("body"))
    cursor = lambda page: F.when(page == 0, FIRST).otherwise(F.substring(F.md5(F.concat_ws("/", "sweep", page)), 1, 16))
    more = (F.col("page") + 1) * page_rows < F.col("_hits")
    told = pages.select("sweep", "page", "first", failing.cast("int").alias("failed"), cursor(F.col("page")).alias("cursor"), F.when(more, cursor(F.col("page") + 1)).otherwise("").alias("next"), "_hits", "body")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)

        def put(path: str, text: str) -> None:
            with store.open_output_stream(path + ".part") as f:
                f.write(text.encode())
            store.move(path + ".part", path)

        for batch in batches:
            for r in batch.to_pylist():
                home = f"{root}/{quote(r['sweep'], safe='')}"
                store.create_dir(home, recursive=True)
                for k in range(1, r["failed"] + 1):
                    put(f"{home}/{quote(r['cursor'], safe='')}.{k}.json", '{"status": 503}')
                put(f"{home}/{quote(r['cursor'], safe='')}.{r['failed'] + 1}.json", f'{{"status": 200, "hitCount": {r["_hits"]}, "nextCursorMark": "{r["next"]}", "resultList": {{"result": {r["body"]}}}}}')
            yield batch.select(["sweep", "page", "first", "failed"])

    return told.mapInArrow(write, "sweep string, page int, first bigint, failed int")
