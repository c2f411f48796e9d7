"""Projections of VARIANT values: declared paths and types, with the shape taken from each value.

Nothing is inferred over the data, so one odd row changes no other. A path that isn't there, a JSON null and a value of
another type are told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OBJECT, _LIST = "map<string,variant>", "array<variant>"


def scan_json_variant(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """(v) of JSON documents, a line or a file each; what is no JSON is NULL."""
    raw = spark.read.text(path, wholetext=whole_files)
    return raw.select(F.try_parse_json("value").alias("v"))


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def kind_of(v: Column) -> Column:
    """object, array, null, scalar, or NULL for no value at all."""
    return F.when(v.isNull(), None).when(F.is_variant_null(v), "null").when(_as(v, _LIST).isNotNull(), "array").when(_as(v, _OBJECT).isNotNull(), "object").otherwise("scalar")


def rows_of(v: Column, numbered: str = r"^(Row)?\d+$") -> Column:
    """The objects of a response, whichever way it wraps them: a list, lists in a list, numbered fields, or one object. What is no
    object is no row; an empty object has none."""
    is_object = lambda x: _as(x, _OBJECT).isNotNull()
    listed = F.flatten(F.transform(_as(v, _LIST), lambda x: F.coalesce(_as(x, _LIST), F.array(x))))
    fields = _as(v, _OBJECT)
    wrapped = F.forall(F.map_keys(fields), lambda k: F.regexp_like(k, F.lit(numbered))) & F.forall(F.map_values(fields), is_object)
    none = F.array().cast(_LIST)
    found = F.when(_as(v, _LIST).isNotNull(), listed).when(F.size(fields) == 0, none).when(wrapped, F.map_values(fields)).when(fields.isNotNull(), F.array(v)).otherwise(none)
    return F.filter(found, is_object)


def projected(v: Column, paths: dict[str, tuple[str, str]]) -> dict[str, Column]:
    """Columns by name for (path, type), each with ``<name>_status``: ok, absent, null, or bad_type where a value is there that
    the type can't hold."""
    out = {}
    for name, (path, kind) in paths.items():
        at, value = F.try_variant_get(v, path, "variant"), F.try_variant_get(v, path, kind)
        out[name] = value
        out[f"{name}_status"] = F.when(at.isNull(), "absent").when(F.is_variant_null(at), "null").when(value.isNull(), "bad_type").otherwise("ok")
    return out
