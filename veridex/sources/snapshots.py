"""Versioned snapshots of several tables: order-free digests, a two-phase commit, checks as rows, differences of versions.

A table's digest is a sum over its rows, so it doesn't depend on their order, counts repeated rows, and merges: digests of
partitions, groups or files add up to that of the whole. A version is written in two phases: tables and manifest first, then
one small marker that seals the manifest. A reader takes no version without a marker that fits, so a half-written one is never
read; a version that was left half-written is written anew.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.constraints import ConstraintError
from .files import canonical_json, parse_json_strict

MARKER, MANIFEST = "commit.sha256", "manifest.json"  # no leading underscore: scans leave such files out
_PIECES = 4  # of a row's SHA-256, 60 bits each
CHECKS = "bundle string, table string, check string, ok boolean, detail string"


def row_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as text that no other row has: columns by name, each value with its length, and a sign for NULL."""
    part = lambda c: F.concat(F.lit(f"{c}:"), F.coalesce(F.concat(F.length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-")), F.lit(";"))
    return F.concat(*[part(c) for c in sorted(columns or df.columns)])


def multiset_digest(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n, d0..d3) of the rows of each group, of all rows without ``by``: partial sums that merged() adds up."""
    by = by or []
    row = F.sha2(row_text(df), 256)
    piece = lambda i: F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.coalesce(piece(i), F.lit(0).cast("decimal(38,0)")).alias(f"d{i}") for i in range(_PIECES)])


def merged(digests: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Digests of a coarser grouping."""
    add = lambda c, kind: F.coalesce(F.sum(c), F.lit(0)).cast(kind).alias(c)
    return digests.groupBy(*(by or [])).agg(add("n", "bigint"), *[add(f"d{i}", "decimal(38,0)") for i in range(_PIECES)])


def sealed() -> Column:
    """The digest as text."""
    return F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[F.col(f"d{i}").cast("string") for i in range(_PIECES)]), 256)


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _put(spark: SparkSession, path: str, text: str) -> None:
    store, where = _files(spark, path)
    out = store.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _get(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None."""
    store, where = _files(spark, path)
    if not store.exists(where):
        return None
    return bytes(spark.read.format("binaryFile").load(path).select("content").first().content).decode()


def commit(spark: SparkSession, root: str, version: str, tables: dict[str, DataFrame], keys: dict[str, list[str]], universe: str | None = None) -> dict:
    """Publish ``tables`` as one version and return its manifest. A committed version is never replaced."""
    home = f"{root}/{version}"
    if _get(spark, f"{home}/{MARKER}") is not None:
        raise ConstraintError(f"{home} is committed")
    store, where = _files(spark, home)
    store.delete(where, True)
    entries = {}
    for name, df in sorted(tables.items()):
        df.write.parquet(f"{home}/{name}")
        back = spark.read.parquet(f"{home}/{name}")  # what readers will see
        found = multiset_digest(back).select("n", sealed().alias("sha256")).first()
        entries[name] = {"path": name, "row_count": found.n, "columns": back.columns, "sha256": found.sha256, "keys": keys.get(name, [])}
    manifest = {"version": version, "universe": universe, "files": entries}
    text = canonical_json(manifest)
    _put(spark, f"{home}/{MANIFEST}", text)
    _put(spark, f"{home}/{MARKER}", hashlib.sha256(text.encode()).hexdigest())
    return manifest


def _manifest(spark: SparkSession, home: str) -> tuple[dict | None, str]:
    """The manifest of a committed version, or the reason why there is none."""
    marker, text = _get(spark, f"{home}/{MARKER}"), _get(spark, f"{home}/{MANIFEST}")
    if marker is None:
        return None, "not committed"
    if text is None:
        return None, "no manifest"
    if hashlib.sha256(text.encode()).hexdigest() != marker:
        return None, "the manifest is not the one that was committed"
    try:
        return parse_json_strict(text), ""
    except (ConstraintError, json.JSONDecodeError) as e:
        return None, str(e)


def _leaves(path: str) -> bool:
    return not path or path.startswith(("/", "\\")) or ".." in path.replace("\\", "/").split("/") or ":" in path


def check(spark: SparkSession, root: str, version: str) -> DataFrame:
    """Every check of a version as a row: commit; per table path, columns, row_count, digest, blank_key, repeated_key; and
    whether all tables have the same universe. What can't be read isn't checked further."""
    home = f"{root}/{version}"
    told = lambda rows: spark.createDataFrame([(version, *r) for r in rows], CHECKS)
    manifest, reason = _manifest(spark, home)
    if manifest is None:
        return told([(None, "commit", False, reason)])
    rows: list[tuple] = [(None, "commit", True, "")]
    found: list[DataFrame] = []
    tables: dict[str, DataFrame] = {}
    row = lambda df, name, what, ok, detail: df.select(F.lit(version).alias("bundle"), F.lit(name).alias("table"), F.lit(what).alias("check"), ok.alias("ok"), detail.cast("string").alias("detail"))
    for name, entry in sorted(manifest["files"].items()):
        store, where = _files(spark, f"{home}/{name}")
        inside = not _leaves(entry["path"])
        there = inside and store.exists(_files(spark, f"{home}/{entry['path']}")[1])
        rows.append((name, "path", there, "" if there else "no such table" if inside else f"{entry['path']} leaves the bundle"))
        if not there:
            continue
        df = spark.read.parquet(f"{home}/{entry['path']}")
        rows.append((name, "columns", df.columns == entry["columns"], ""))
        digest = multiset_digest(df)
        found.append(row(digest, name, "row_count", F.col("n") == entry["row_count"], F.col("n")))
        found.append(row(digest, name, "digest", sealed() == entry["sha256"], F.lit("")))
        keys = entry["keys"]
        if keys and set(keys) <= set(df.columns):
            blank = F.lit(False)
            for k in keys:
                blank = blank | F.coalesce(F.trim(F.col(k).cast("string")) == "", F.lit(True))
            n = df.agg(F.count_if(blank).alias("n"))
            found.append(row(n, name, "blank_key", F.col("n") == 0, F.col("n")))
            again = df.filter(~blank).groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
            found.append(row(again, name, "repeated_key", F.col("n") == 0, F.col("n")))
        tables[name] = df
    out = told(rows)
    column = manifest.get("universe")
    members = {n: t.select(F.col(column).alias("u"), F.lit(n).alias("t")).distinct() for n, t in tables.items() if column in t.columns}
    if len(members) > 1:
        held = None
        for m in members.values():
            held = m if held is None else held.unionByName(m)
        lonely = held.groupBy("u").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") < len(members)).alias("n"))
        found.append(row(lonely, None, "universe", F.col("n") == 0, F.col("n")).withColumn("table", F.lit(None).cast("string")))
    for f in found:
        out = out.unionByName(f)
    return out


def read_version(spark: SparkSession, root: str, version: str) -> dict[str, DataFrame]:
    """The tables of a version that passes all checks; any other is refused, with the checks that failed."""
    failed = check(spark, root, version).filter("not ok").collect()
    if failed:
        raise ConstraintError(f"{root}/{version}: " + "; ".join(f"{r.table or 'bundle'} {r.check} {r.detail}".strip() for r in failed))
    manifest, _ = _manifest(spark, f"{root}/{version}")
    return {name: spark.read.parquet(f"{root}/{version}/{entry['path']}") for name, entry in manifest["files"].items()}


def difference(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., state): rows that were added, are gone, or changed under their key. Keys are unique, as a commit's check says;
    columns that only one version has make every row of it changed."""
    side = lambda df, name: df.select(*keys, F.sha2(row_text(df), 256).alias(name))
    met = side(old, "before").join(side(new, "after"), keys, "full_outer")
    state = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "gone").when(F.col("before") != F.col("after"), "changed")
    return met.select(*keys, state.alias("state")).filter("state is not null")
