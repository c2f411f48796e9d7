"""Declared constraints over many tables, evaluated in one join.

A declaration names a target table, key columns with their values, fields with what they must be, and phrases that a text
field must have. Rows meet declarations by the text of their key, so thousands of declarations cost one pass over each
target and shape of key, however many they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constraints import ConstraintError

DECLARATION = "declaration_id string, target string, key map<string,string>, expected map<string,string>, phrase_field string, phrases array<string>"
#: Different sets of key columns that declarations may name, over all targets: each is a pass over its target.
SHAPES = 64


def key_text(names: list[str], value) -> Column:
    """Key values with their lengths, in the order of the names; NULL if one of them is NULL."""
    return F.concat(*[F.concat(F.lit(f"{n}="), F.length(value(n)).cast("string"), F.lit(":"), value(n), F.lit(";")) for n in names])


def normal_text(c: Column) -> Column:
    """Lower case, with single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def shapes(declarations: DataFrame) -> list[tuple[str, list[str]]]:
    """(target, key columns) that are declared; a set of columns counts once, and too many sets are refused."""
    found = declarations.select("target", F.array_sort(F.map_keys("key")).alias("names")).distinct().limit(SHAPES + 1).collect()
    if len(found) > SHAPES:
        raise ConstraintError(f"declarations name over {SHAPES} sets of key columns")
    return sorted((r.target, list(r.names)) for r in found if r.target is not None and r.names)


def cross_check(declarations: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Per declaration: declaration_id, target, rows, passed and its reasons, sorted and joined by ``;``.

    unknown_target, unknown_key_column, no_key, no_row and several_rows say that no single row was met; of one row
    field_missing:f, field_differs:f (NULL is declared by NULL) and phrase_missing:p (in any case, single blanks) say what is
    wrong with it. Repeated declarations count each time they are given under another id.
    """
    told = declarations.withColumn("_names", F.array_sort(F.map_keys("key")))
    parts = F.transform("_names", lambda n: F.concat(n, F.lit("="), F.length(F.element_at("key", n)).cast("string"), F.lit(":"), F.element_at("key", n), F.lit(";")))
    # array_join leaves NULLs out: a key value that is NULL selects no row
    whole = ~F.exists(F.map_values("key"), lambda v: v.isNull())
    told = told.withColumn("_key", F.when(whole & (F.size("_names") > 0), F.array_join(parts, "")))
    known = F.lit(False)
    rows = None
    for target, names in shapes(declarations):
        df = targets.get(target)
        if df is None or not set(names) <= set(df.columns):
            continue
        shape = F.array(*[F.lit(n) for n in names])
        known = known | ((F.col("target") == target) & (F.col("_names") == shape))
        text = key_text(names, lambda n, df=df: df[f"`{n}`"].cast("string"))
        values = F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[df[f"`{c}`"].cast("string") for c in df.columns]))
        wanted = told.filter((F.col("target") == target) & (F.col("_names") == shape)).select(F.col("_key").alias("_k")).distinct()
        part = df.select(F.lit(target).alias("_t"), text.alias("_k"), values.alias("_v")).join(wanted, "_k", "left_semi")  # rows that nothing is declared of go no further
        # a key of many rows is counted, and one of its rows kept, before the shuffle
        part = part.groupBy("_t", "_k").agg(F.count("*").alias("_n"), F.first("_v").alias("_v"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        met = told.withColumns({"_n": F.lit(None).cast("bigint"), "_v": F.lit(None).cast("map<string,string>")})
    else:
        met = told.join(rows, (F.col("target") == F.col("_t")) & (F.col("_key") == F.col("_k")), "left")
    n = F.coalesce("_n", F.lit(0))
    fields = F.transform(F.map_keys("expected"), lambda f: F.when(~F.map_contains_key("_v", f), F.concat(F.lit("field_missing:"), f)).when(~F.element_at("_v", f).eqNullSafe(F.element_at("expected", f)), F.concat(F.lit("field_differs:"), f)))
    body = F.coalesce(normal_text(F.element_at("_v", F.col("phrase_field"))), F.lit(""))
    phrases = F.transform("phrases", lambda p: F.when(~F.contains(body, normal_text(p)), F.concat(F.lit("phrase_missing:"), p)))
    none = F.array().cast("array<string>")
    of_row = F.concat(F.coalesce(fields, none), F.coalesce(phrases, none))
    no_row = F.when(~F.col("target").isin(*targets) if targets else F.lit(True), F.array(F.lit("unknown_target"))).when(F.size("_names") <= 0, F.array(F.lit("no_key"))).when(~known, F.array(F.lit("unknown_key_column"))).when(n == 0, F.array(F.lit("no_row"))).when(n > 1, F.array(F.lit("several_rows")))
    reasons = F.array_sort(F.array_compact(F.coalesce(no_row, of_row)))
    return met.select("declaration_id", "target", n.alias("rows"), (F.size(reasons) == 0).alias("passed"), F.array_join(reasons, ";").alias("reasons"))
