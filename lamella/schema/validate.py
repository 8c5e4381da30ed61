"""The rules that a schema must keep. Strictly, only today's forms of lists and maps are allowed."""

from __future__ import annotations

import math

from lamella.schema.dsl import Node, Schema, SchemaError

#: What a leaf with an annotation may be: physical types, and the length of a fixed one.
_LEAF = {
    **dict.fromkeys(("STRING", "UTF8", "ENUM", "JSON", "BSON"), (("binary",), None)),
    **dict.fromkeys(("DATE", "TIME_MILLIS", "UINT_8", "UINT_16", "UINT_32", "INT_8", "INT_16", "INT_32"), (("int32",), None)),
    **dict.fromkeys(("TIME_MICROS", "TIMESTAMP_MILLIS", "TIMESTAMP_MICROS", "UINT_64", "INT_64"), (("int64",), None)),
    "TIMESTAMP": (("int64", "int96"), None),
    "UUID": (("fixed_len_byte_array",), 16),
    "INTERVAL": (("fixed_len_byte_array",), 12),
}


def max_digits(length: int) -> int:
    """How many decimal digits any number of so many bytes, one bit of them the sign, can have."""
    return len(str(2 ** (8 * length - 1) - 1)) - 1 if length else 0


def _leaf(node: Node) -> None:
    note = node.annotation
    if note is None:
        return
    allowed, length = _LEAF.get(note.name, (None, None))
    if note.name == "TIME":
        allowed = ("int32",) if note.args[0] == "MILLIS" else ("int64",)
    elif note.name == "INT":
        allowed = ("int64",) if note.args[0] == "64" else ("int32",)
    elif note.name == "DECIMAL" and note.args:
        limits = {"int32": 9, "int64": 18, "binary": math.inf, "fixed_len_byte_array": max_digits(node.length or 0)}
        if node.physical not in limits:
            raise SchemaError(f"{node.name}: a {node.physical} can't be a decimal")
        if not 1 <= int(note.args[0]) <= limits[node.physical]:
            raise SchemaError(f"{node.name}: {note} has more or fewer digits than its type can hold")
    if allowed and (node.physical not in allowed or length not in (None, node.length)):
        raise SchemaError(f"{node.name}: {note} is for {' or '.join(allowed)}{f'({length})' if length else ''}")


def _list(node: Node, strict: bool) -> None:
    if not node.is_group or node.repetition == "repeated" or len(node.children) != 1:
        raise SchemaError(f"{node.name}: a list is a group, not repeated, of one child")
    middle = node.children[0]
    if middle.name == "list":
        inner = middle.children[0] if len(middle.children) == 1 else None
        if not middle.is_group or middle.repetition != "repeated" or inner is None or inner.name != "element" or inner.repetition == "repeated":
            raise SchemaError(f"{node.name}: a list's repeated group has one child, element, that isn't repeated")
    elif strict:
        raise SchemaError(f"{node.name}: the child of a list is called list")
    elif middle.is_group and not middle.children:
        raise SchemaError(f"{node.name}: the elements of this list have no type")


def _map(node: Node, strict: bool) -> None:
    if strict and node.annotated("MAP_KEY_VALUE"):
        raise SchemaError(f"{node.name}: MAP_KEY_VALUE isn't the annotation of a map")
    if not node.is_group or len(node.children) != 1 or not node.children[0].is_group or node.children[0].repetition != "repeated":
        raise SchemaError(f"{node.name}: a map is a group of one repeated group")
    middle = node.children[0]
    if not strict:
        if len(middle.children) != 2:
            raise SchemaError(f"{node.name}: a map's entries have two fields")
        return
    key = middle.child("key")
    if middle.name != "key_value" or {c.name for c in middle.children} != {"key", "value"} or len(middle.children) != 2 or key.repetition != "required":
        raise SchemaError(f"{node.name}: a map is made of key_value groups with a required key and a value")


def _visit(node: Node, is_root: bool, strict: bool) -> None:
    if not node.name:
        raise SchemaError("a column has no name")
    if not is_root and node.is_group and not node.children:
        raise SchemaError(f"{node.name} has neither a type nor children")
    if not node.is_group and node.children:
        raise SchemaError(f"{node.name} has both a type and children")
    if node.annotated("LIST"):
        _list(node, strict)
        inside = node.children[0].children
    elif node.annotated("MAP", "MAP_KEY_VALUE"):
        _map(node, strict)
        inside = node.children[0].children
    else:
        if node.is_group and node.annotation is not None and node.annotation.name in _LEAF:
            raise SchemaError(f"{node.name}: {node.annotation} isn't for groups")
        if not node.is_group:
            _leaf(node)
        inside = node.children
    for c in inside:
        _visit(c, False, strict)


def check(schema: Schema | None, strict: bool = False) -> None:
    """Raises a SchemaError if a rule is broken."""
    if schema is None or schema.root is None:
        raise SchemaError("there is no schema")
    _visit(schema.root, True, strict)


def check_strict(schema: Schema | None) -> None:
    check(schema, strict=True)
