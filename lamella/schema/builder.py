"""Schemas made step by step."""

from __future__ import annotations

from collections.abc import Iterable

from lamella.schema.columns import split_path
from lamella.schema.dsl import Annotation, Node, Schema, SchemaError
from lamella.schema.validate import check


def data_column(physical: str, repetition: str = "required", annotation: str | None = None, length: int | None = None, field_id: int | None = None) -> Node:
    """A leaf without a name; annotation as in the text form, such as "DECIMAL(9, 2)"."""
    note = None
    if annotation:
        name, _, args = annotation.rstrip(")").partition("(")
        note = Annotation(name.strip().upper(), tuple(a.strip() for a in args.split(",")) if args else ())
    return Node("", repetition, physical, length, note, field_id)


def list_column(element: Node, repetition: str = "optional") -> Node:
    """A list of element, in the form list.element."""
    if element.repetition == "repeated":
        raise SchemaError("an element of a list isn't repeated")
    element.name = "element"
    return Node("", repetition, annotation=Annotation("LIST"), children=[Node("list", "repeated", children=[element])])


def map_column(key: Node, value: Node, repetition: str = "optional") -> Node:
    """A map, in the form key_value.key and key_value.value; keys are required."""
    if key.repetition != "required":
        raise SchemaError("the key of a map is required")
    key.name, value.name = "key", "value"
    return Node("", repetition, annotation=Annotation("MAP"), children=[Node("key_value", "repeated", children=[key, value])])


class SchemaBuilder:
    """Adds columns and groups by path; parents come first, and nothing is added under lists and maps."""

    def __init__(self, name: str = "msg") -> None:
        self.root = Node(name)

    def _parent(self, path: str | Iterable[str]) -> tuple[Node, str]:
        parts = split_path(path) if isinstance(path, str) else tuple(path)
        if not parts or not all(parts):
            raise SchemaError("a path has no empty parts")
        at = self.root
        for p in parts[:-1]:
            at = at.child(p)
            if at is None or not at.is_group:
                raise SchemaError(f"{p} isn't a group here")
            if at.annotated("LIST", "MAP", "MAP_KEY_VALUE"):
                raise SchemaError(f"nothing can be added under {p}, a {at.annotation.name}")
        if at.child(parts[-1]):
            raise SchemaError(f"there is a {parts[-1]} already")
        return at, parts[-1]

    def column(self, path: str | Iterable[str], node: Node) -> SchemaBuilder:
        parent, node.name = self._parent(path)
        parent.children.append(node)
        return self

    def group(self, path: str | Iterable[str], repetition: str = "optional") -> SchemaBuilder:
        parent, name = self._parent(path)
        parent.children.append(Node(name, repetition))
        return self

    def build(self) -> Schema:
        schema = Schema(self.root).clone()
        check(schema)
        return schema
