"""The tree of a schema's columns, with levels and paths."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from lamella.schema.dsl import Annotation, Node, Schema


def split_path(text: str) -> tuple[str, ...]:
    """The parts of a dotted path; back-ticks quote parts that have dots."""
    out, part, quoted = [], "", False
    for ch in text:
        if ch == "`":
            quoted = not quoted
        elif ch == "." and not quoted:
            out.append(part)
            part = ""
        else:
            part += ch
    return (*out, part)


def join_path(path: Iterable[str]) -> str:
    return ".".join(f"`{p}`" if "." in p or "`" in p else p for p in path)


def has_prefix(path: tuple[str, ...], prefix: tuple[str, ...]) -> bool:
    return path[: len(prefix)] == prefix


@dataclass
class Column:
    """A column: a leaf with an index among the leaves, or a group (index and physical are None)."""

    path: tuple[str, ...]
    node: Node
    max_definition: int
    max_repetition: int
    index: int | None = None
    children: list[Column] = field(default_factory=list)

    @property
    def name(self) -> str:
        return self.path[-1]

    @property
    def flat_name(self) -> str:
        return join_path(self.path)

    @property
    def is_leaf(self) -> bool:
        return not self.node.is_group

    @property
    def physical(self) -> str | None:
        return self.node.physical

    @property
    def repetition(self) -> str:
        return self.node.repetition

    @property
    def annotation(self) -> Annotation | None:
        return self.node.annotation

    @property
    def n_children(self) -> int:
        """-1 for a leaf."""
        return -1 if self.is_leaf else len(self.children)


class ColumnTree:
    """All columns of a schema. Definition levels count the ancestors that aren't required, the column itself
    included; repetition levels those that are repeated."""

    def __init__(self, schema: Schema) -> None:
        self.schema, self.leaves = schema, []
        self.top = [self._grow(c, (), 0, 0) for c in schema.root.children]

    def _grow(self, node: Node, above: tuple[str, ...], d: int, r: int) -> Column:
        d, r = d + (node.repetition != "required"), r + (node.repetition == "repeated")
        column = Column((*above, node.name), node, d, r)
        if column.is_leaf:
            column.index = len(self.leaves)
            self.leaves.append(column)
        column.children = [self._grow(c, column.path, d, r) for c in node.children]
        return column

    def __iter__(self) -> Iterator[Column]:
        def walk(columns: list[Column]) -> Iterator[Column]:
            for c in columns:
                yield c
                yield from walk(c.children)

        return walk(self.top)

    def find(self, path: str | Iterable[str]) -> Column | None:
        """A leaf or group by its path."""
        want = split_path(path) if isinstance(path, str) else tuple(path)
        return next((c for c in self if c.path == want), None)

    def selected(self, paths: Iterable[str | tuple[str, ...]]) -> list[Column]:
        """The leaves that are, or lie under, one of the paths; all of them if there is no path."""
        want = [split_path(p) if isinstance(p, str) else tuple(p) for p in paths]
        return [c for c in self.leaves if not want or any(has_prefix(c.path, w) for w in want)]

    def rows(self) -> list[dict[str, object]]:
        """A record for each leaf."""
        return [
            {
                "index": c.index, "path": c.flat_name, "repetition": c.repetition, "physical": c.physical, "length": c.node.length, "annotation": str(c.annotation) if c.annotation else None,
                "field_id": c.node.field_id, "max_definition": c.max_definition, "max_repetition": c.max_repetition,
            }
            for c in self.leaves
        ]
