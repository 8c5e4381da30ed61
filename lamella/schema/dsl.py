"""The text form of a schema.

    message NAME { FIELD* }
    FIELD  = (required | optional | repeated) TYPE NAME [( ANNOTATION )] [= ID] ;
           | (required | optional | repeated) group NAME [( ANNOTATION )] { FIELD* }

A Node is a field, a group or, at the top, the message. Its annotation is kept as it was written, in upper case and
split into a name and arguments, from which logical and converted types follow (ANNOTATIONS).
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

REPETITIONS = ("required", "optional", "repeated")
PHYSICAL = ("boolean", "int32", "int64", "int96", "float", "double", "binary", "fixed_len_byte_array")

#: Converted types, which alone may stand at a group, and what logical type each is the older form of.
CONVERTED = {
    **{x: None for x in ("LIST", "MAP", "MAP_KEY_VALUE", "INTERVAL")},
    "UTF8": ("STRING", ()), "ENUM": ("ENUM", ()), "JSON": ("JSON", ()), "BSON": ("BSON", ()), "DATE": ("DATE", ()), "DECIMAL": None,
    **{f"{kind}_{unit}": (kind, (unit, "true")) for kind in ("TIME", "TIMESTAMP") for unit in ("MILLIS", "MICROS")},
    **{f"{sign}INT_{bits}": ("INT", (str(bits), "false" if sign else "true")) for sign in ("", "U") for bits in (8, 16, 32, 64)},
}
#: Logical types and the patterns of their arguments.
LOGICAL = {
    "STRING": (), "DATE": (), "UUID": (), "ENUM": (), "JSON": (), "BSON": (),
    "TIME": ("MILLIS|MICROS|NANOS", "true|false"), "TIMESTAMP": ("MILLIS|MICROS|NANOS", "true|false"), "INT": ("8|16|32|64", "true|false"), "DECIMAL": (r"\d+", r"\d+"),
}


class SchemaError(ValueError):
    """A text that isn't a schema, or a schema that breaks a rule."""


@dataclass(frozen=True)
class Annotation:
    name: str
    args: tuple[str, ...] = ()

    def __str__(self) -> str:
        return f"{self.name}({', '.join(self.args)})" if self.args else self.name

    @property
    def is_logical(self) -> bool:
        """Written as a logical type; UTF8, TIME_MILLIS and the like, and a bare DECIMAL, are converted types."""
        return self.name in LOGICAL and (self.name != "DECIMAL" or bool(self.args))

    @property
    def logical(self) -> Annotation | None:
        """The logical type: this one, or the one that a converted type stands for."""
        if self.is_logical:
            return self
        known = CONVERTED.get(self.name)
        return Annotation(*known) if known else None

    @property
    def converted(self) -> str | None:
        """The converted type: this one, or the one that is written beside a logical type for older readers."""
        if not self.is_logical:
            return self.name
        if self.name == "DECIMAL":
            return "DECIMAL"
        return next((k for k, v in CONVERTED.items() if v and v[0] == self.name and (self.name in ("TIME", "TIMESTAMP") and v[1][0] == self.args[0] or v[1] == self.args)), None)


@dataclass
class Node:
    """A field (physical is set) or a group."""

    name: str
    repetition: str = "required"
    physical: str | None = None
    length: int | None = None
    annotation: Annotation | None = None
    field_id: int | None = None
    children: list[Node] = field(default_factory=list)

    @property
    def is_group(self) -> bool:
        return self.physical is None

    def child(self, name: str) -> Node | None:
        return next((c for c in self.children if c.name == name), None)

    def annotated(self, *names: str) -> bool:
        return self.annotation is not None and self.annotation.name in names


@dataclass
class Schema:
    """A message. sub(name) makes a direct child the message of a schema of its own."""

    root: Node | None

    def __str__(self) -> str:
        return render(self)

    def clone(self) -> Schema:
        return copy.deepcopy(self)

    def sub(self, name: str) -> Schema | None:
        found = self.root.child(name) if self.root else None
        return Schema(found) if found else None

    @property
    def element(self) -> Node | None:
        return self.root


_TOKEN = re.compile(r"[ \t\r\n]+|(?P<mark>[(){}=;,])|(?P<number>\d+)(?=[^\w]|$)|(?P<word>[^ ;{}()=,\n\t\r]+)")


def _tokens(text: str) -> Iterator[tuple[str, str, int]]:
    at, line = 0, 1
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SchemaError(f"line {line}: {text[at]!r} can't be read")
        if m.lastgroup:
            yield m.lastgroup, m[0], line
        line += m[0].count("\n")
        at = m.end()
    yield "end", "the end", line


class _Reader:
    def __init__(self, text: str) -> None:
        self.tokens = list(_tokens(text))
        self.at = 0

    def fail(self, what: str) -> SchemaError:
        kind, value, line = self.tokens[self.at]
        return SchemaError(f"line {line}: {what}, not {value if kind == 'end' else repr(value)}")

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.tokens[self.at][0] != "end" else ""

    def take(self, *kinds: str, value: str | None = None, what: str = "") -> str:
        kind, text, _ = self.tokens[self.at]
        if kind not in kinds or value not in (None, text):
            raise self.fail(f"there should be {what or repr(value)}")
        self.at += 1
        return text

    def mark(self, value: str) -> None:
        self.take("mark", value=value)

    def skip(self, value: str) -> bool:
        if self.tokens[self.at][0] == "mark" and self.peek() == value:
            self.at += 1
            return True
        return False

    def message(self) -> Schema:
        self.take("word", value="message")
        root = Node(self.take("word", "number", what="a name"))
        root.children = self.body()
        self.take("end", what="nothing more")
        return Schema(root)

    def body(self) -> list[Node]:
        self.mark("{")
        out = []
        while not self.skip("}"):
            out.append(self.field())
        return out

    def field(self) -> Node:
        if self.peek() not in REPETITIONS:
            raise self.fail("there should be required, optional or repeated")
        repetition = self.take("word")
        kind = self.take("word", what="a type")
        if kind == "group":
            node = Node(self.take("word", what="a name"), repetition)
            if self.peek() == "(":
                node.annotation = self.annotation(group=True)
            node.children = self.body()
            return node
        if kind not in PHYSICAL:
            self.at -= 1
            raise self.fail("there should be a type")
        length = None
        if kind == "fixed_len_byte_array":
            self.mark("(")
            length = int(self.take("number", what="a length"))
            self.mark(")")
        node = Node(self.take("word", what="a name"), repetition, kind, length)
        if self.peek() == "(":
            node.annotation = self.annotation(group=False)
        if self.skip("="):
            node.field_id = int(self.take("number", what="a number"))
        self.mark(";")
        return node

    def annotation(self, group: bool) -> Annotation:
        self.mark("(")
        name = self.take("word", what="an annotation").upper()
        args: list[str] = []
        patterns = () if group else LOGICAL.get(name, ())
        if name not in CONVERTED and (group or name not in LOGICAL):
            self.at -= 1
            raise self.fail("there should be an annotation")
        if patterns and not (name == "DECIMAL" and self.peek() == ")"):
            for k, pattern in enumerate(patterns):
                self.mark("," if k else "(")
                if not re.fullmatch(pattern, self.peek()):
                    raise self.fail(f"{name} takes {pattern.replace('|', ', ')} here")
                args.append(self.take("word", "number"))
            self.mark(")")
        self.mark(")")
        return Annotation(name, tuple(args))


def parse(text: str) -> Schema:
    """The schema of a text, checked (not strictly). Errors say in which line they were found."""
    from lamella.schema.validate import check

    schema = _Reader(text).message()
    try:
        check(schema)
    except SchemaError as e:
        raise SchemaError(f"line {text.count(chr(10)) + 1}: {e}") from None
    return schema


def render(schema: Schema | None) -> str:
    """The text of a schema, two spaces for each level; parsing it gives the same schema again."""
    lines: list[str] = []

    def put(node: Node, depth: int) -> None:
        note = f" ({node.annotation})" if node.annotation else ""
        head = f"{'  ' * depth}{node.repetition} "
        if node.is_group:
            lines.append(f"{head}group {node.name}{note} {{")
            for c in node.children:
                put(c, depth + 1)
            lines.append("  " * depth + "}")
        else:
            size = f"({node.length})" if node.length is not None else ""
            number = f" = {node.field_id}" if node.field_id is not None else ""
            lines.append(f"{head}{node.physical}{size} {node.name}{note}{number};")

    root = schema.root if schema else None
    lines.append(f"message {root.name if root else 'empty'} {{")
    for c in root.children if root else ():
        put(c, 1)
    return "\n".join([*lines, "}", ""])
