"""Schemas as Spark types, and back. What Spark's types can't say is kept in the fields' metadata."""

from __future__ import annotations

from pyspark.sql import types as T

from lamella.schema.dsl import Annotation, Node, Schema, SchemaError
from lamella.schema.validate import check

PHYSICAL, LOGICAL, LENGTH, REPETITION, FIELD_ID = "pq.physical", "pq.logical", "pq.length", "pq.repetition", "parquet.field.id"

_PLAIN = {"boolean": T.BooleanType(), "int32": T.IntegerType(), "int64": T.LongType(), "int96": T.TimestampType(), "float": T.FloatType(), "double": T.DoubleType(), "binary": T.BinaryType(), "fixed_len_byte_array": T.BinaryType()}
_SIGNED = {"8": T.ByteType(), "16": T.ShortType(), "32": T.IntegerType(), "64": T.LongType()}
_UNSIGNED = {"8": T.ShortType(), "16": T.IntegerType(), "32": T.LongType(), "64": T.DecimalType(20, 0)}


def _leaf_type(node: Node) -> T.DataType:
    """As Spark reads it. What it can't read as more (UUID, times of day, nanoseconds) comes as the physical value."""
    note = node.annotation.logical if node.annotation else None
    if node.annotated("DECIMAL") and node.annotation.args:
        p, s = map(int, node.annotation.args)
        return T.DecimalType(p, s) if p <= 38 else T.BinaryType()
    if note is None:
        return _PLAIN[node.physical]
    if note.name in ("STRING", "ENUM", "JSON"):
        return T.StringType()
    if note.name == "DATE":
        return T.DateType()
    if note.name == "TIMESTAMP" and note.args[0] != "NANOS" and node.physical == "int64":
        return T.TimestampType() if note.args[1] == "true" else T.TimestampNTZType()
    if note.name == "INT":
        return (_SIGNED if note.args[1] == "true" else _UNSIGNED)[note.args[0]]
    return _PLAIN[node.physical]


def _element(node: Node) -> Node | None:
    """The element of a list, by today's form and the older ones; None if the repeated field itself is the element."""
    middle = node.children[0]
    if not middle.is_group or len(middle.children) > 1:
        return None
    if middle.name in ("array", f"{node.name}_tuple"):
        return None
    return middle.children[0]


def _type(node: Node) -> T.DataType:
    if node.annotated("LIST"):
        element = _element(node)
        if element is None:
            return T.ArrayType(_struct(node.children[0]) if node.children[0].is_group else _leaf_type(node.children[0]), False)
        return T.ArrayType(_value(element), element.repetition != "required")
    if node.annotated("MAP", "MAP_KEY_VALUE"):
        key, value = node.children[0].children
        return T.MapType(_value(key), _value(value), value.repetition != "required")
    return _struct(node) if node.is_group else _leaf_type(node)


def _value(node: Node) -> T.DataType:
    return T.ArrayType(_type(node), False) if node.repetition == "repeated" else _type(node)


def _metadata(node: Node) -> dict[str, object]:
    out: dict[str, object] = {REPETITION: node.repetition}
    if node.physical:
        out[PHYSICAL] = node.physical
    if node.annotation:
        out[LOGICAL] = str(node.annotation)
    if node.length is not None:
        out[LENGTH] = node.length
    if node.field_id is not None:
        out[FIELD_ID] = node.field_id
    return out


def _struct(node: Node) -> T.StructType:
    return T.StructType([T.StructField(c.name, _value(c), c.repetition == "optional", _metadata(c)) for c in node.children])


def to_struct_type(schema: Schema) -> T.StructType:
    """Fields that are required or repeated aren't nullable."""
    return _struct(schema.root)


def read_schema(schema: Schema) -> T.StructType:
    """What to hand to spark.read.schema: all fields nullable, and no metadata but field ids."""

    def loosen(t: T.DataType) -> T.DataType:
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(f.name, loosen(f.dataType), True, {k: v for k, v in f.metadata.items() if k == FIELD_ID}) for f in t.fields])
        if isinstance(t, T.ArrayType):
            return T.ArrayType(loosen(t.elementType), True)
        return T.MapType(loosen(t.keyType), loosen(t.valueType), True) if isinstance(t, T.MapType) else t

    return loosen(to_struct_type(schema))


_FROM = {
    T.BooleanType: ("boolean", None), T.ByteType: ("int32", "INT(8, true)"), T.ShortType: ("int32", "INT(16, true)"), T.IntegerType: ("int32", None), T.LongType: ("int64", None), T.FloatType: ("float", None), T.DoubleType: ("double", None),
    T.StringType: ("binary", "STRING"), T.BinaryType: ("binary", None), T.DateType: ("int32", "DATE"), T.TimestampType: ("int64", "TIMESTAMP(MICROS, true)"), T.TimestampNTZType: ("int64", "TIMESTAMP(MICROS, false)"),
}


def annotation(text: str) -> Annotation:
    name, _, args = text.partition("(")
    return Annotation(name.strip(), tuple(a.strip() for a in args.rstrip(")").split(",")) if args else ())


def _node(name: str, t: T.DataType, nullable: bool, metadata: dict) -> Node:
    repetition = metadata.get(REPETITION) or ("optional" if nullable else "required")
    if metadata.get(PHYSICAL):
        note = annotation(metadata[LOGICAL]) if metadata.get(LOGICAL) else None
        return Node(name, repetition, metadata[PHYSICAL], metadata.get(LENGTH), note, metadata.get(FIELD_ID))
    if isinstance(t, T.ArrayType):
        if repetition == "repeated":
            inner = _node(name, t.elementType, False, {k: v for k, v in metadata.items() if k != REPETITION})
            inner.repetition = "repeated"
            return inner
        element = _node("element", t.elementType, t.containsNull, {})
        return Node(name, repetition, annotation=Annotation("LIST"), children=[Node("list", "repeated", children=[element])])
    if isinstance(t, T.MapType):
        pair = [_node("key", t.keyType, False, {}), _node("value", t.valueType, t.valueContainsNull, {})]
        return Node(name, repetition, annotation=Annotation("MAP"), children=[Node("key_value", "repeated", children=pair)])
    if isinstance(t, T.StructType):
        return Node(name, repetition, children=[_node(f.name, f.dataType, f.nullable, f.metadata or {}) for f in t.fields])
    if isinstance(t, T.DecimalType):
        physical = "int32" if t.precision <= 9 else "int64" if t.precision <= 18 else "fixed_len_byte_array"
        length = next(n for n in range(1, 17) if len(str(2 ** (8 * n - 1) - 1)) - 1 >= t.precision) if physical == "fixed_len_byte_array" else None
        return Node(name, repetition, physical, length, Annotation("DECIMAL", (str(t.precision), str(t.scale))), metadata.get(FIELD_ID))
    if type(t).__name__ == "TimeType":
        return Node(name, repetition, "int64", None, Annotation("TIME", ("MICROS", "false")), metadata.get(FIELD_ID))
    if type(t) not in _FROM:
        raise SchemaError(f"{name}: {t.simpleString()} has no form in a file")
    physical, note = _FROM[type(t)]
    return Node(name, repetition, physical, None, annotation(note) if note else None, metadata.get(FIELD_ID))


def from_struct_type(struct: T.StructType, name: str = "spark_schema") -> Schema:
    schema = Schema(Node(name, children=[_node(f.name, f.dataType, f.nullable, f.metadata or {}) for f in struct.fields]))
    check(schema)
    return schema
