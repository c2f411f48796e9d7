"""Runs a query and its oracle side by side, as the driver does: sorted columns, order-free rows, equal values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def canonical(names: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if v is None:
            return "\0NULL"  # no value of a string, so NULL and '' are told apart
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float) and not math.isnan(v):
            return f"{v + 0.0:.10g}"
        return str(v)

    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, fn, sql: str) -> tuple[int, str]:
    """Rows, and the first difference or ''."""
    df = fn(spark, sf_dir)
    ours = canonical(df.columns, [tuple(r) for r in df.collect()])
    theirs = canonical(*oracle_rows(sf_dir, sql))
    if ours[0] != theirs[0]:
        return len(ours[1]), f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return len(ours[1]), f"rows {len(ours[1])} != {len(theirs[1])}"
    bad = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    return len(ours[1]), f"{len(bad)} rows differ, such as {bad[0]}" if bad else ""
