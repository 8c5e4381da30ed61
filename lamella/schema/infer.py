"""Schemas of Python classes, from their type hints."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import types
import typing
import uuid
from typing import Annotated, get_args, get_origin, get_type_hints

from lamella.schema.dsl import Annotation, Node, Schema, SchemaError
from lamella.schema.validate import check

ROOT = "autogen_schema"


class Int(int):
    """Marks of widths: Annotated[int, Int.width(16)], Annotated[int, Int.width(32, False)]."""

    @staticmethod
    def width(bits: int, signed: bool = True) -> Annotation:
        return Annotation("INT", (str(bits), "true" if signed else "false"))


@dataclasses.dataclass(frozen=True)
class Fixed:
    """Annotated[bytes, Fixed(16)]: a byte array of fixed length."""

    length: int


_SCALARS: dict[type, tuple[str, str | None]] = {
    bool: ("boolean", None), int: ("int64", "INT(64, true)"), float: ("double", None), str: ("binary", "STRING"), bytes: ("binary", None), bytearray: ("binary", None),
    datetime.datetime: ("int64", "TIMESTAMP(MICROS, true)"), datetime.date: ("int32", "DATE"), datetime.time: ("int64", "TIME(MICROS, true)"),
}


def field_name(f: dataclasses.Field) -> str:
    """The name of a field in a file: what its metadata has under "parquet" up to a comma, or its own in lower case."""
    return str(f.metadata.get("parquet", "")).partition(",")[0] or f.name.lower()


def _optional(hint: object) -> tuple[object, bool]:
    if get_origin(hint) in (typing.Union, types.UnionType):
        rest = [a for a in get_args(hint) if a is not type(None)]
        if len(rest) != 1 or len(rest) == len(get_args(hint)):
            raise SchemaError(f"{hint} is neither one type nor one type or None")
        return rest[0], True
    return hint, False


def _node(name: str, hint: object, seen: tuple[type, ...], classic: bool) -> Node:
    hint, nullable = _optional(hint)
    repetition = "optional" if nullable else "required"
    marks: tuple = ()
    if get_origin(hint) is Annotated:
        hint, *rest = get_args(hint)
        marks = tuple(rest)
        hint, inner = _optional(hint)
        repetition = "optional" if inner else repetition
    note = next((m for m in marks if isinstance(m, Annotation)), None)
    fixed = next((m for m in marks if isinstance(m, Fixed)), None)
    origin, args = get_origin(hint), get_args(hint)
    if fixed:
        return Node(name, repetition, "fixed_len_byte_array", fixed.length, note)
    if hint is uuid.UUID:
        return Node(name, repetition, "fixed_len_byte_array", 16, Annotation("UUID"))
    if hint is decimal.Decimal:
        if note is None or note.name != "DECIMAL":
            raise SchemaError(f"{name}: a decimal needs an annotation with its digits")
        p = int(note.args[0])
        return Node(name, repetition, "int32" if p <= 9 else "int64" if p <= 18 else "binary", None, note)
    if isinstance(hint, type) and hint in _SCALARS:
        physical, text = ("int64", "TIMESTAMP(NANOS, true)") if classic and hint is datetime.datetime else _SCALARS[hint]
        if note is None and text:
            head, _, tail = text.partition("(")
            note = Annotation(head, tuple(a.strip() for a in tail.rstrip(")").split(",")) if tail else ())
        if note and note.name == "INT":
            physical = "int64" if note.args[0] == "64" else "int32"
        return Node(name, repetition, physical, None, note)
    if origin in (list, tuple, set, frozenset) or hint in (list, tuple, set):
        if not args or origin is tuple and not (len(args) == 2 and args[1] is Ellipsis):
            raise SchemaError(f"{name}: the type of its elements isn't known")
        element = _node("element", args[0], seen, classic)
        if classic:  # the list takes the element's repetition
            repetition, element.repetition = max(repetition, element.repetition, key=("required", "optional").index), "required"
        return Node(name, repetition, annotation=Annotation("LIST"), children=[Node("list", "repeated", children=[element])])
    if origin is dict:
        key, value = _node("key", args[0], seen, classic), _node("value", args[1], seen, classic)
        if key.repetition != "required":
            raise SchemaError(f"{name}: a key can't be None")
        repetition = "optional" if classic else repetition
        return Node(name, repetition, annotation=Annotation("MAP"), children=[Node("key_value", "repeated", children=[key, value])])
    if isinstance(hint, type) and dataclasses.is_dataclass(hint):
        return Node(name, repetition, children=_fields(hint, seen, classic))
    raise SchemaError(f"{name}: {hint} has no form in a file")


def _fields(cls: type, seen: tuple[type, ...], classic: bool) -> list[Node]:
    if cls in seen:
        raise SchemaError(f"{cls.__name__} contains itself")
    hints = get_type_hints(cls, include_extras=True)
    return [_node(field_name(f), hints[f.name], (*seen, cls), classic) for f in dataclasses.fields(cls) if f.metadata.get("parquet") != "-"]


def infer(obj: object, name: str = ROOT, classic: bool = False) -> Schema:
    """The schema of a dataclass or of one of its instances. T | None is optional, all else required; lists and maps take
    today's form. classic: maps are optional, a list of T | None is an optional list of T, and datetimes are in nanoseconds. Fields whose metadata has "-" under "parquet" are left out."""
    cls = obj if isinstance(obj, type) else type(obj)
    if not dataclasses.is_dataclass(cls):
        raise SchemaError(f"{cls.__name__} isn't a dataclass")
    schema = Schema(Node(name, children=_fields(cls, (), classic)))
    check(schema)
    return schema
