"""Typed objects as rows and back, and rows as text."""

from __future__ import annotations

import dataclasses
import functools
import types
import typing
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import get_args, get_origin, get_type_hints

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.schema.infer import field_name, infer
from lamella.schema.sparktypes import to_struct_type
from lamella.sources.sinks import SinkOptions, conform, write


class FieldNotPresent(LookupError):
    """A field that was asked for isn't in the row."""


def to_row(obj: object) -> dict[str, object]:
    """An object as a dict by the names in files: what its to_row() returns, a mapping as it is, or a dataclass's fields."""
    if hasattr(obj, "to_row"):
        return obj.to_row()
    if isinstance(obj, Mapping):
        return {str(k): _out(v) for k, v in obj.items()}
    if not dataclasses.is_dataclass(obj):
        raise TypeError(f"{type(obj).__name__} has no fields")
    return {name: v if type(v) in _PLAIN else _out(v) for f, name in _names(type(obj)) for v in (getattr(obj, f.name),)}


#: What is in rows as it is in objects.
_PLAIN = {str, int, float, bool, bytes, type(None)}


@functools.lru_cache(maxsize=256)
def _names(cls: type) -> list[tuple[dataclasses.Field, str]]:
    """The fields of a class that rows have, with their names in files: found once, not for each row."""
    return [(f, field_name(f)) for f in dataclasses.fields(cls) if f.metadata.get("parquet") != "-"]


@functools.lru_cache(maxsize=256)
def _fields(cls: type) -> list[tuple[dataclasses.Field, str, object]]:
    """These, and their types."""
    hints = get_type_hints(cls, include_extras=True)
    return [(f, name, hints[f.name]) for f, name in _names(cls)]


def _out(v: object) -> object:
    import uuid

    if dataclasses.is_dataclass(v) and not isinstance(v, type) or hasattr(v, "to_row"):
        return to_row(v)
    if isinstance(v, uuid.UUID):
        return v.bytes
    if isinstance(v, (list, tuple, set, frozenset)):
        return [_out(x) for x in v]
    return {k: _out(x) for k, x in v.items()} if isinstance(v, Mapping) else v


def from_row(row: Row | Mapping, cls: type) -> object:
    """An object of a class from a row: by its from_row(row), or a dataclass from the fields that it names.

    A field that the row lacks takes its default, or None where its type allows that; else FieldNotPresent.
    """
    if hasattr(cls, "from_row"):
        return cls.from_row(row)
    given = row.asDict() if isinstance(row, Row) else dict(row)
    out = {}
    for f, name, hint in _fields(cls):
        if name in given:
            v = given[name]
            out[f.name] = v if type(v) is hint else _in(v, hint)
        elif f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
            if type(None) not in get_args(hint):
                raise FieldNotPresent(name)
            out[f.name] = None
    return cls(**out)


def _in(v: object, hint: object) -> object:
    import uuid

    if v is None:
        return None
    if get_origin(hint) is typing.Annotated:
        hint = get_args(hint)[0]
    if get_origin(hint) in (typing.Union, types.UnionType):
        return _in(v, next(a for a in get_args(hint) if a is not type(None)))
    origin, args = get_origin(hint), get_args(hint)
    if hint is uuid.UUID:
        return uuid.UUID(bytes=bytes(v))
    if origin in (list, tuple, set, frozenset):
        return origin(_in(x, args[0]) for x in v)
    if origin is dict:
        return {k: _in(x, args[1]) for k, x in v.items()}
    if isinstance(hint, type) and (dataclasses.is_dataclass(hint) or hasattr(hint, "from_row")):
        return from_row(v, hint)
    return bytes(v) if hint is bytes else float(v) if hint is float else v


def read_objects(df: DataFrame, cls: type) -> Iterator[object]:
    """The rows as objects, a partition at a time in the driver; only the columns that the class names are read."""
    names = [field_name(f) for f in dataclasses.fields(cls)] if dataclasses.is_dataclass(cls) else df.columns
    for row in df.select(*[F.col(f"`{n}`") for n in names if n in df.columns]).toLocalIterator():
        yield from_row(row, cls)


def objects_to_df(spark: SparkSession, objects: Iterable[object], cls: type | None = None, struct: T.StructType | None = None) -> DataFrame:
    """By the class's inferred schema, or a given one; values that it doesn't name are left out."""
    rows = [to_row(o) for o in objects]
    kind = struct or to_struct_type(infer(cls))
    return spark.createDataFrame([{f.name: r.get(f.name) for f in kind.fields} for r in rows], kind)


def write_objects(spark: SparkSession, objects: Iterable[object], cls: type, path: str, options: SinkOptions = SinkOptions()) -> None:
    schema = infer(cls)
    write(conform(objects_to_df(spark, objects, cls), schema), path, options)


def map_rows(df: DataFrame, function: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """Rows through a function of dicts, in Arrow batches; None leaves a row out."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for r in map(function, batch.to_pylist()) if r is not None]
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return df.mapInArrow(run, schema)


# text


def flat_text(df: DataFrame) -> DataFrame:
    """line, one for each row: a line "name = value" for each field that isn't null, names in order, those of nested
    fields behind a dot for each level, and an empty line at the end."""

    def lines(name: str, c, kind: T.DataType, depth: int) -> F.Column:  # noqa: ANN001
        dots = "." * depth
        if isinstance(kind, T.StructType):
            inner = F.concat(*[lines(f.name, c.getField(f.name), f.dataType, depth + 1) for f in sorted(kind.fields, key=lambda f: f.name)])
            return F.when(c.isNotNull(), F.concat(F.array(F.lit(f"{dots}{name}:")), inner)).otherwise(F.array().cast("array<string>"))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            each = F.flatten(F.transform(c, lambda x: lines(name, x, kind.elementType, depth)))
            return F.coalesce(each, F.array().cast("array<string>"))
        text = F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType)) else F.decode(c, "UTF-8") if isinstance(kind, T.BinaryType) else c.cast("string")
        return F.when(c.isNotNull(), F.array(F.concat(F.lit(f"{dots}{name} = "), text))).otherwise(F.array().cast("array<string>"))

    parts = [lines(f.name, F.col(f"`{f.name}`"), f.dataType, 0) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return df.select(F.concat(F.array_join(F.concat(*parts), "\n"), F.lit("\n")).alias("line"))


def json_text(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("line"))
