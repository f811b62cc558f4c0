"""Values of loosely typed cells: falsy values, lists, numbers, booleans, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def truthy_number(value: Column, default) -> Column:
    """Zero counts as missing, as in configuration cells."""
    return F.coalesce(F.nullif(value, F.lit(0)), F.lit(default))


def text_list(raw: Column) -> Column:
    """Lower-cased items between commas, semicolons, their full-width forms and line ends."""
    items = F.transform(F.split(F.coalesce(raw, F.lit("")), r"[,，、;；\n\r]+"), lambda x: F.lower(F.trim(x)))
    return F.filter(items, lambda x: x != "")


def number(raw: Column) -> Column:
    return F.nullif(F.trim(raw), F.lit("")).try_cast("double")


def boolean(raw: Column) -> Column:
    return F.lower(F.trim(F.coalesce(raw, F.lit("")))).isin("true", "1", "yes", "是", "on")


def json_struct(raw: Column, schema: T.StructType | str) -> Column:
    """The struct of a JSON text; null where it is no JSON object."""
    return F.when(F.trim(raw).startswith("{"), F.from_json(raw, schema, {"mode": "PERMISSIVE"}))


def json_flag(raw: Column, name: str) -> Column:
    return F.coalesce(F.lower(F.get_json_object(raw, f"$.{name}")) == "true", F.lit(False))
