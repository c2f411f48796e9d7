"""Array, map, JSON, date and parsing functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact(*parts: Column) -> Column:
    """An array of the parts that aren't NULL, in order."""
    return F.array_compact(F.array(*parts))


def when_flag(condition: Column, name: str) -> Column:
    return F.when(condition, F.lit(name))


def ordered_unique(x: Column) -> Column:
    """Distinct values in order of first occurrence."""
    return F.array_distinct(x)


def modalities_from_flags(flags: dict[str, Column]) -> Column:
    """Names of the true flags; ["unknown"] where none is."""
    found = compact(*[F.when(c, F.lit(n)) for n, c in flags.items()])
    return F.when(F.size(found) == 0, F.array(F.lit("unknown"))).otherwise(found)


def split_list(x: Column, separator: str = ";") -> Column:
    """Trimmed parts of a separated cell, without blanks; an empty array for NULL."""
    parts = F.split(F.coalesce(x, F.lit("")), separator if separator.strip() else r"\s+")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def joined_set(x: Column, joiner: str = "; ") -> Column:
    """An aggregate: sorted distinct values in one string."""
    return F.array_join(F.array_sort(F.collect_set(x)), joiner)


def factor_map(x: Column) -> Column:
    """``k:v | k:v`` as a map with lower-case keys; the last of equal keys wins."""
    parts = F.filter(F.split(F.coalesce(x, F.lit("")), r"\s*\|\s*"), lambda p: F.contains(p, F.lit(":")))
    pairs = F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("k"), F.trim(F.regexp_replace(p, "^[^:]*:", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: F.size(F.filter(pairs, lambda q, j: (q["k"] == p["k"]) & (j > i))) == 0)
    return F.map_from_entries(last)


def parse_bool(x: Column) -> Column:
    """Lenient: 1, true, yes and y are true, all else is false."""
    return F.coalesce(F.lower(F.trim(x)).isin("1", "true", "yes", "y"), F.lit(False))


def parse_bool_strict(x: Column) -> Column:
    """Only true and false; anything else is NULL for a constraint to report."""
    low = F.lower(F.trim(x))
    return F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))


def parse_int(x: Column) -> Column:
    """A whole number, also from text like "12.0"; sentinels and junk are NULL."""
    return parse_float(x).cast("int")


def parse_float(x: Column) -> Column:
    """A finite number or NULL."""
    d = x.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.lit(None).cast("double")).otherwise(d)


def year_of(x: Column) -> Column:
    """The year of a date string, or its first four digits."""
    return F.coalesce(F.year(F.try_to_date(x)), F.nullif(F.regexp_extract(F.trim(x), r"^(\d{4})", 1), F.lit("")).try_cast("int"))


def csv_cell(x: Column, kind: str) -> Column:
    """A value as a CSV cell: '' for NULL, lower-case booleans, ';'-joined arrays, JSON for structs and maps."""
    if kind.startswith("array"):
        out = F.array_join(x.cast("array<string>"), ";")
    elif kind.startswith(("struct", "map")):
        out = F.to_json(x)
    else:
        out = x.cast("string")
    return F.coalesce(out, F.lit(""))
