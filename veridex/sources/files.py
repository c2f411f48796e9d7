"""File scans and sinks: lenient and strict CSV, differential tables, JSON, manifests, atomic publication."""

from __future__ import annotations

import csv
import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.collections import csv_cell, parse_float
from ..operators.constraints import ConstraintError, duplicates, enforce


def scan_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """All cells as text, as they stand; empty cells are ''."""
    rows = spark.read.options(header=True, sep=separator, inferSchema=False, multiLine=True, escape='"').csv(path)
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns])


def scan_csv_strict(spark: SparkSession, path: str, required: tuple[str, ...], exact: bool = False) -> DataFrame:
    """A CSV that has a unique, non-blank header with the required columns, rows of its width, and at least one row.

    The header is one line, read on the driver, where names may be quoted and have commas; row widths are checked by the parser against an explicit schema.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ConstraintError(f"{path}: no header")
    names = [n.strip().lstrip("\ufeff") for n in next(csv.reader([first[0].value.lstrip("\ufeff")]), [])]
    if any(not n for n in names):
        raise ConstraintError(f"{path}: a column has no name")
    if len(set(names)) != len(names):
        raise ConstraintError(f"{path}: repeated columns {sorted({n for n in names if names.count(n) > 1})}")
    missing = [c for c in required if c not in names]
    if missing or (exact and len(names) != len(required)):
        raise ConstraintError(f"{path}: columns {names}, required {list(required)}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(schema).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", multiLine=True, escape='"', enforceSchema=True).csv(path).withColumn("_row", F.monotonically_increasing_id() + 2)
    enforce(rows.filter("_bad is not null").select("_row", "_bad", names[0]), f"{path}: rows that are longer or shorter than the header")
    if rows.limit(1).count() == 0:
        raise ConstraintError(f"{path}: no rows")
    return rows.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])


def scan_da_table(spark: SparkSession, path: str, contrast_like: str = "%pre%", floor: float = 1e-300) -> DataFrame:
    """A tab-separated differential table: rows without key, finite statistics or the wanted contrast go, p is floored."""
    raw = scan_csv(spark, path, "\t")
    number = {c: parse_float(F.col(c)) for c in ("logFC", "p_value", "adj_p_value") if c in raw.columns}
    rows = raw.withColumns(number).filter((F.trim("feature_id") != "") & F.col("logFC").isNotNull() & F.col("p_value").isNotNull() & F.lower("contrast").like(contrast_like))
    return rows.withColumns({c: F.greatest(F.col(c), F.lit(floor)) for c in ("p_value", "adj_p_value") if c in raw.columns})


def scan_folder(spark: SparkSession, path: str, grammar: str, fields: tuple[str, ...]) -> DataFrame:
    """All ``*.txt`` tables of a folder, with fields taken from their names by a pattern."""
    rows = spark.read.options(header=True, sep="\t", pathGlobFilter="*.txt").csv(path)
    name = F.col("_metadata.file_name")
    return rows.select("*", name.alias("file_name"), *[F.nullif(F.regexp_extract(name, grammar, i + 1), F.lit("")).alias(f) for i, f in enumerate(fields)])


def scan_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """A JSON document or list with an explicit schema: no inference pass over the data."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def parse_json_strict(text: str):
    """JSON without repeated keys, NaN or infinities. For manifests: one small document."""

    def unique(pairs):
        found = dict(pairs)
        if len(found) != len(pairs):
            raise ConstraintError(f"repeated keys among {[k for k, _ in pairs]}")
        return found

    def refuse(token):
        raise ConstraintError(f"{token} is no JSON number")

    return json.loads(text, object_pairs_hook=unique, parse_constant=refuse)


def _whole(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first().content)


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def digest(value) -> str:
    """SHA-256 of a value's canonical JSON; lists of objects with an id count as sets."""

    def order(v):
        if isinstance(v, dict):
            return {k: order(x) for k, x in v.items()}
        if isinstance(v, list):
            items = [order(x) for x in v]
            keyed = items and all(isinstance(x, dict) and any(k == "id" or k.endswith("_id") for k in x) for x in items)
            return sorted(items, key=canonical_json) if keyed else items
        return v

    return hashlib.sha256(canonical_json(order(value)).encode()).hexdigest()


def load_bundle(spark: SparkSession, folder: str, keys: dict[str, list[str]], universe: str | None = "study_id") -> dict[str, DataFrame]:
    """The tables of a bundle's manifest, checked before any is used: paths stay inside, SHA-256 and row counts agree, keys
    are unique, and all tables with the universe column have equal sets of it."""
    manifest = parse_json_strict(_whole(spark, f"{folder}/manifest.json").decode())
    tables = {}
    for name, entry in manifest["files"].items():
        path = entry["path"]
        if path.startswith(("/", "\\")) or ".." in path.replace("\\", "/").split("/") or ":" in path:
            raise ConstraintError(f"{name}: path {path!r} leaves the bundle")
        if hashlib.sha256(_whole(spark, f"{folder}/{path}")).hexdigest() != entry["sha256"]:
            raise ConstraintError(f"{name}: SHA-256 differs from the manifest")
        rows = scan_csv_strict(spark, f"{folder}/{path}", tuple(keys.get(name, ())))
        if (n := rows.count()) != entry["row_count"]:
            raise ConstraintError(f"{name}: {n} rows, the manifest says {entry['row_count']}")
        if keys.get(name):
            enforce(duplicates(rows, *keys[name]), f"{name}: repeated keys")
        tables[name] = rows
    if universe:
        held = [t.select(universe).distinct() for t in tables.values() if universe in t.columns]
        for a, b in zip(held, held[1:]):
            enforce(a.exceptAll(b).unionByName(b.exceptAll(a)), f"tables differ in {universe}")
    return tables


def stable_columns(df: DataFrame, priority: tuple[str, ...]) -> list[str]:
    """Known columns first, then the rest by name."""
    return [c for c in priority if c in df.columns] + sorted(c for c in df.columns if c not in priority)


def write_csv(df: DataFrame, path: str, priority: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> None:
    """A CSV of text cells, sorted by ``order`` across its part files."""
    names = stable_columns(df, priority)
    kinds = dict(df.dtypes)
    rows = df.orderBy(*order) if order else df
    rows.select(*[csv_cell(F.col(c), kinds[c]).alias(c) for c in names]).write.mode("errorifexists").options(header=True, quoteAll=False, emptyValue="").csv(path)


def write_json(spark: SparkSession, path: str, value) -> None:
    """One small document: sorted keys, two blanks, a newline at the end."""
    text = json.dumps(value, sort_keys=True, indent=2, allow_nan=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def table_digest(df: DataFrame) -> dict:
    """row_count, columns and an order-free SHA-256 of a table: a sum of row hashes, so it is one distributed pass."""
    kinds = dict(df.dtypes)
    row = F.sha2(F.to_json(F.struct(*[csv_cell(F.col(c), kinds[c]).alias(c) for c in sorted(df.columns)])), 256)
    half = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)"))
    found = df.agg(F.count("*").alias("n"), half(1).alias("a"), half(16).alias("b")).first()
    return {"row_count": found.n, "columns": df.columns, "sha256": hashlib.sha256(f"{found.n}|{found.a or 0}|{found.b or 0}".encode()).hexdigest()}


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> dict:
    """Write tables and a manifest beside the target, then rename: readers see all or nothing, and an existing target is
    refused."""
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, staging = Path(folder), Path(folder + ".staging")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise ConstraintError(f"{folder} exists")
    fs.delete(staging, True)
    manifest = {}
    for name, df in sorted(tables.items()):
        df.write.parquet(f"{folder}.staging/{name}")
        manifest[name] = table_digest(spark.read.parquet(f"{folder}.staging/{name}"))
    write_json(spark, f"{folder}.staging/manifest", manifest)
    if not fs.rename(staging, target):
        raise ConstraintError(f"{folder} could not be published")
    return manifest


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A report's table for people, bars in cells replaced: the first ``limit`` rows, and a line that says how many more there are."""
    cell = lambda v: ("" if v is None else str(v)).replace("|", "/")
    rows = df.limit(limit + 1).collect()
    more = f"\n_{df.count() - limit} more rows._\n" if len(rows) > limit else ""
    rows = rows[:limit]
    if not rows:
        return "_None._\n"
    return "\n".join(["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |", *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)]) + "\n" + more


def agreeing(df: DataFrame, *aliases: str) -> tuple[Column, DataFrame]:
    """(value, violations) of columns that are aliases of one another: the first filled one; they must not differ."""
    filled = [F.nullif(F.trim(F.col(a)), F.lit("")) for a in aliases if a in df.columns]
    if not filled:
        raise ConstraintError(f"none of {aliases} is there")
    differ = reduce(lambda x, y: x | y, [F.coalesce(a != b, F.lit(False)) for i, a in enumerate(filled) for b in filled[i + 1 :]], F.lit(False))
    return F.coalesce(*filled), df.filter(differ)
