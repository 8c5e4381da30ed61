"""Fields of CSV files as typed values, and numbers written for people.

A handler makes a column of a column of strings. Text that isn't of the type fails the query; an empty field is null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Types, what they are in a schema's text, and in Spark. Unsigned ones are kept in the next wider signed type.
TYPES = {
    "string": ("binary", "STRING", "string"), "byte_array": ("binary", None, "binary"), "boolean": ("boolean", None, "boolean"),
    "int8": ("int32", "INT(8, true)", "tinyint"), "int16": ("int32", "INT(16, true)", "smallint"), "int32": ("int32", "INT(32, true)", "int"), "int64": ("int64", "INT(64, true)", "bigint"), "int": ("int64", "INT(64, true)", "bigint"),
    "uint8": ("int32", "INT(8, false)", "smallint"), "uint16": ("int32", "INT(16, false)", "int"), "uint32": ("int32", "INT(32, false)", "bigint"), "uint64": ("int64", "INT(64, false)", "decimal(20,0)"), "uint": ("int64", "INT(64, false)", "decimal(20,0)"),
    "float": ("float", None, "float"), "double": ("double", None, "double"), "json": ("binary", "JSON", "string"),
}
TRUE, FALSE = ("1", "t", "T", "TRUE", "true", "True"), ("0", "f", "F", "FALSE", "false", "False")


def parse_boolean(s: Column) -> Column:
    """Null for all but the twelve spellings."""
    return F.when(s.isin(*TRUE), True).when(s.isin(*FALSE), False)


def parse_integer(s: Column, bits: int = 64, signed: bool = True) -> Column:
    """Base 10, a sign before it where signed; null for other text and for numbers that don't fit."""
    whole = F.when(s.rlike(r"^[+-]?[0-9]+$" if signed else r"^[0-9]+$"), s)
    x = F.when(F.length(F.regexp_replace(whole, "^[+-]?0*", "")) <= 20, whole).try_cast("decimal(21,0)")
    lo, hi = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    kind = TYPES[f"{'' if signed else 'u'}int{bits}"][2]
    return F.when((x >= F.lit(lo).cast("decimal(21,0)")) & (x <= F.lit(str(hi)).cast("decimal(21,0)")), x).cast(kind)


def parse_float(s: Column, kind: str = "double") -> Column:
    """Null for other text, and for numbers that only infinity could stand for."""
    number = F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), s).try_cast(kind)
    named = F.when(F.lower(s).rlike(r"^([+-]?(inf|infinity)|nan)$"), F.lower(s)).try_cast(kind)
    finite = F.when(~number.isin(float("inf"), float("-inf")), number)
    return F.coalesce(finite, named)


@F.pandas_udf(BooleanType())
def is_json(s: pd.Series) -> pd.Series:
    """Strictly: one value, nothing after it, and no NaN or Infinity. Null for null."""

    def ok(x: str | None) -> bool | None:
        if x is None:
            return None
        try:
            json.loads(x, parse_constant=_no_constant)
        except (ValueError, RecursionError):
            return False
        return True

    return s.map(ok)


def _no_constant(x: str) -> None:
    raise ValueError(x)


def _parser(kind: str) -> Callable[[Column], Column]:
    m = re.fullmatch(r"(u?)int(\d*)", kind)
    if m:
        return lambda s: parse_integer(s, int(m[2] or 64), not m[1])
    return {
        "string": lambda s: s, "byte_array": lambda s: s.cast("binary"), "boolean": parse_boolean, "float": lambda s: parse_float(s, "float"), "double": parse_float, "json": lambda s: F.when(is_json(s), s),
    }[kind]


def handle(s: Column, kind: str, name: str = "field") -> Column:
    """The typed value: null for an empty field, a failure for text that isn't of the type."""
    if kind not in TYPES:
        raise ValueError(f"{kind} isn't one of {', '.join(TYPES)}")
    text = F.nullif(s, F.lit(""))
    value = _parser(kind)(text)
    if kind in ("string", "byte_array"):
        return value
    bad = F.raise_error(F.concat(F.lit(f"{name}: "), text, F.lit(f" isn't of type {kind}"))).cast(TYPES[kind][2])
    return F.when(text.isNull(), F.lit(None).cast(TYPES[kind][2])).otherwise(F.coalesce(value, bad))


def parse_hints(text: str) -> dict[str, str]:
    """Types by column from "a=int32, b=string"."""
    out = {}
    for pair in filter(None, (p.strip() for p in text.split(","))):
        parts = [p.strip() for p in pair.split("=")]
        if len(parts) != 2 or not parts[0]:
            raise ValueError(f"{pair!r} isn't of the form column=type")
        if parts[1] not in TYPES:
            raise ValueError(f"{parts[1]!r} isn't one of {', '.join(TYPES)}")
        out[parts[0]] = parts[1]
    return out


# sizes

#: Here, as in the tools that these sizes come from, KB is 1024 and KiB 1000.
UNITS = {"": 1, **{f"{p}B": 1024 ** (k + 1) for k, p in enumerate("KMGTP")}, **{f"{p}iB": 1000 ** (k + 1) for k, p in enumerate("KMGTP")}}
_SIZE = re.compile(r"(\d+)([KMGTP]i?B)?")


def bytes_of(text: str) -> int:
    """The bytes of "100MB" and the like."""
    m = _SIZE.fullmatch(text)
    if not m:
        raise ValueError(f"{text!r} isn't a size")
    return int(m[1]) * UNITS[m[2] or ""]


def size_to_bytes(s: Column) -> Column:
    """The same of a column; null where the text isn't a size."""
    factor = F.lit(None).cast("long")
    unit = F.regexp_extract(s, r"^\d+(.*)$", 1)
    for u, n in UNITS.items():
        factor = F.when(unit == u, F.lit(n).cast("long")).otherwise(factor)
    return F.when(s.rlike(r"^\d+([KMGTP]i?B)?$"), F.regexp_extract(s, r"^(\d+)", 1).try_cast("long") * factor)
