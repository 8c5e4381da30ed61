"""The text form, its rules, and conversions."""

import dataclasses
import datetime
import decimal
import uuid
from typing import Annotated

import pytest
from pyspark.sql import types as T

from lamella.schema import ColumnTree, SchemaBuilder, SchemaError, check_strict, data_column, from_struct_type, infer, list_column, map_column, parse, read_schema, render, to_struct_type
from lamella.schema.columns import join_path, split_path
from lamella.schema.dsl import Annotation, Schema
from lamella.schema.infer import Fixed, Int
from lamella.schema.validate import max_digits

SHOP = """message shop.v1 {
  required int64 order_no = 7;
  optional binary buyer (STRING);
  required fixed_len_byte_array(16) token (UUID);
  optional group lines (LIST) {
    repeated group list {
      optional group element {
        required int32 qty (INT(16, false));
        optional int64 price (DECIMAL(12, 2));
      }
    }
  }
  optional group tags (MAP) {
    repeated group key_value {
      required binary key (UTF8);
      optional int96 seen;
    }
  }
  repeated double METADATA$X;
  required int64 t (TIMESTAMP(NANOS, true));
  required int32 u (TIME_MILLIS);
  required int32 d (DECIMAL);
}
"""


def test_printing_is_stable():
    once = render(parse(SHOP))
    assert once == SHOP == render(parse(once))
    assert render(parse("message  $ {required boolean a;optional group g{repeated float b=3;}}")) == "message $ {\n  required boolean a;\n  optional group g {\n    repeated float b = 3;\n  }\n}\n"
    assert render(None) == render(Schema(None)) == "message empty {\n}\n"
    assert str(parse("\n\nmessage x { }").clone()) == "message x {\n}\n"


def field(text, group=""):
    return f"message m {{ optional group g {group} {{ {text} }} }}" if group else f"message m {{ {text} }}"


@pytest.mark.parametrize(
    "text",
    [
        "required int32 a (DATE);", "required int64 a (TIMESTAMP(MICROS, false));", "required int96 a (TIMESTAMP(NANOS, true));", "required int32 a (TIME(MILLIS, true));", "required int64 a (TIME(NANOS, false));", "optional int32 a (INT(8, true));",
        "optional int64 a (INT(64, false));", "required int32 a (DECIMAL(9, 3));", "required int64 a (DECIMAL(18, 0));", "required fixed_len_byte_array(10) a (DECIMAL(23, 4));", "required binary a (DECIMAL(200, 5));", "required int64 a (decimal);",
        "required fixed_len_byte_array(12) a (INTERVAL);", "required binary a (BSON);", "required binary group (STRING);", "required int32 a (UINT_16);", "required int64 a (TIMESTAMP_MILLIS);", "required int64 a (TIME_MICROS);", "required int64 a = 12;", "required binary a (Json) = 1;",
    ],
)
def test_accepted(text):
    check_strict(parse(field(text)))


@pytest.mark.parametrize(
    "text",
    [
        "optional int64 a", "perhaps int64 a;", "optional int128 a;", "optional int64 a (NOPE);", "required int64 a (DATE);", "required int32 a (TIMESTAMP(NANOS, false));", "required int64 a (TIME(MILLIS, true));", "required int32 a (TIME(NANOS, true));", "required int32 a (INT(64, true));",
        "required int32 a (INT(28, true));", "required int64 a (INT(32, false));", "required int32 a (DECIMAL(12, 3));", "required int64 a (DECIMAL(19, 3));", "required fixed_len_byte_array(10) a (DECIMAL(24, 4));", "required binary a (DECIMAL(0, 0));", "required double a (DECIMAL(3, 1));",
        "required fixed_len_byte_array(32) a (UUID);", "required binary a (UUID);", "required int64 a (ENUM);", "required int64 a (JSON);", "required double a (INTERVAL);", "required int32 a (UTF8);", "required int64 a (STRING);", "required int64 a (UINT_8);", "required int32 a (UINT_64);",
        "required int64 a (TIMESTAMP(HOURS, true));", "required int64 a (TIMESTAMP(MILLIS, maybe));", "required fixed_len_byte_array a;", "required fixed_len_byte_array(x) a;", "required group g { }", "required int64 a (DECIMAL(5));", "required int64 a = b;", "required int64 a; }",
    ],
)
def test_rejected(text):
    with pytest.raises(SchemaError, match=r"^line \d+: "):
        parse(field(text))


def test_errors_name_the_line():
    with pytest.raises(SchemaError, match="^line 3: "):
        parse("message m {\n required int32 a;\n required nothing b;\n}")


LISTS = [  # text of the inside, allowed, allowed strictly
    ("repeated group list { optional int32 element; }", True, True),
    ("repeated int32 item;", True, False),
    ("repeated group item { required int32 a; required int32 b; }", True, False),
    ("repeated group array { required int32 a; }", True, False),
    ("repeated group bag { required binary array_element (STRING); }", True, False),
    ("repeated group item { }", False, False),
    ("repeated group list { optional int32 a; }", False, False),
    ("repeated group list { repeated int32 element; }", False, False),
    ("repeated group list { required int32 element; required int32 more; }", False, False),
    ("optional group list { required int32 element; }", False, False),
    ("repeated int32 list;", False, False),
    ("repeated group list { optional int64 element (DATE); }", False, False),
    ("repeated int32 a; repeated int32 b;", False, False),
]
MAPS = [
    ("repeated group key_value { required binary key; optional int32 value; }", True, True),
    ("repeated group key_value (MAP_KEY_VALUE) { required binary key; required int32 value; }", True, None),
    ("repeated group map { required binary a; optional int32 b; }", True, False),
    ("repeated group key_value { optional binary key; optional int32 value; }", True, False),
    ("repeated group key_value { required binary key; optional int32 other; }", True, False),
    ("repeated group key_value { required binary key; }", False, False),
    ("optional group key_value { required binary key; optional int32 value; }", False, False),
    ("repeated int32 key_value;", False, False),
]


@pytest.mark.parametrize(("kind", "text", "loose", "strict"), [("LIST", *x) for x in LISTS] + [("MAP", *x) for x in MAPS])
def test_lists_and_maps(kind, text, loose, strict):
    whole = field(text, f"({kind})")
    if not loose:
        with pytest.raises(SchemaError):
            parse(whole)
        return
    schema = parse(whole)
    if strict is False:
        with pytest.raises(SchemaError):
            check_strict(schema)
    elif strict:
        check_strict(schema)


def test_repeated_list_and_key_value_annotation():
    with pytest.raises(SchemaError):
        parse("message m { repeated group a (LIST) { repeated group list { required int32 element; } } }")
    odd = parse(field("repeated group key_value { required binary key; optional int32 value; }", "(MAP_KEY_VALUE)"))
    with pytest.raises(SchemaError):
        check_strict(odd)
    with pytest.raises(SchemaError):
        check_strict(None)


def test_annotations():
    assert Annotation("UTF8").logical == Annotation("STRING") and Annotation("STRING").converted == "UTF8"
    assert Annotation("INT", ("16", "false")).converted == "UINT_16" and Annotation("UINT_16").logical == Annotation("INT", ("16", "false"))
    assert Annotation("TIMESTAMP", ("NANOS", "true")).converted is None and Annotation("TIMESTAMP", ("MILLIS", "false")).converted == "TIMESTAMP_MILLIS"
    assert [max_digits(n) for n in (1, 2, 4, 8, 10, 16)] == [2, 4, 9, 18, 23, 38]


def test_tree():
    tree = ColumnTree(parse(SHOP))
    levels = {c.flat_name: (c.index, c.max_definition, c.max_repetition) for c in tree.leaves}
    assert levels["order_no"] == (0, 0, 0) and levels["lines.list.element.price"] == (4, 4, 1) and levels["tags.key_value.seen"] == (6, 3, 1) and levels["METADATA$X"] == (7, 1, 1)
    assert [c.flat_name for c in tree.selected(["lines.list", "nothing", "d"])] == ["lines.list.element.qty", "lines.list.element.price", "d"]
    assert len(tree.selected([])) == len(tree.leaves) == 11
    group = tree.find("lines.list")
    assert group.n_children == 1 and not group.is_leaf and tree.find("t").n_children == -1 and tree.find("x") is None
    assert tree.rows()[1] == {"index": 1, "path": "buyer", "repetition": "optional", "physical": "binary", "length": None, "annotation": "STRING", "field_id": None, "max_definition": 1, "max_repetition": 0}
    assert split_path("a.`b.c`.d") == ("a", "b.c", "d") and join_path(("a", "b.c")) == "a.`b.c`"
    assert parse(SHOP).sub("lines").element.annotation.name == "LIST" and parse(SHOP).sub("nope") is None


def test_builder():
    b = SchemaBuilder("m").column("id", data_column("int64")).group("g").column("g.x", data_column("int32", "optional", "DECIMAL(5, 2)")).column("l", list_column(data_column("binary", annotation="STRING")))
    b.column(("m.n",), map_column(data_column("binary"), data_column("double", "optional")))
    schema = b.build()
    check_strict(schema)
    assert parse(render(schema)) == schema
    for path in ("id", "id.x", "l.x", "none.x", "a..b"):
        with pytest.raises(SchemaError):
            b.column(path, data_column("int32"))
    with pytest.raises(SchemaError):
        map_column(data_column("binary", "optional"), data_column("int32"))
    with pytest.raises(SchemaError):
        list_column(data_column("int32", "repeated"))


def test_spark_types():
    struct = to_struct_type(parse(SHOP))
    assert struct.simpleString() == "struct<order_no:bigint,buyer:string,token:binary,lines:array<struct<qty:int,price:decimal(12,2)>>,tags:map<string,timestamp>,METADATA$X:array<double>,t:bigint,u:int,d:int>"
    assert not struct["order_no"].nullable and struct["buyer"].nullable
    back = from_struct_type(struct, "shop.v1")
    assert [c.flat_name for c in ColumnTree(back).leaves][:5] == [c.flat_name for c in ColumnTree(parse(SHOP)).leaves][:5]
    assert all(f.nullable for f in read_schema(parse(SHOP)).fields)
    all_types = T.StructType([T.StructField(f"c{k}", t) for k, t in enumerate([T.BooleanType(), T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(), T.StringType(), T.BinaryType(), T.DateType(), T.TimestampType(), T.TimestampNTZType(), T.DecimalType(5, 2), T.DecimalType(15, 2), T.DecimalType(30, 2), T.ArrayType(T.LongType()), T.MapType(T.StringType(), T.DateType()), T.StructType([T.StructField("x", T.IntegerType(), False)])])])
    again = to_struct_type(from_struct_type(all_types))
    assert [f.dataType.simpleString() for f in again.fields] == [f.dataType.simpleString() for f in all_types.fields]


@dataclasses.dataclass
class Part:
    weight: Annotated[float | None, None]
    code: Annotated[bytes, Fixed(5)]


@dataclasses.dataclass
class Thing:
    Name: str
    count: int
    small: Annotated[int, Int.width(16, False)]
    price: Annotated[decimal.Decimal, Annotation("DECIMAL", ("7", "2"))]
    when: datetime.datetime
    day: datetime.date
    parts: list[Part]
    tags: dict[str, int | None]
    uid: uuid.UUID
    maybe: list[int] | None = None
    renamed: bool = dataclasses.field(default=False, metadata={"parquet": "other,x"})
    hidden: int = dataclasses.field(default=0, metadata={"parquet": "-"})


def test_infer():
    schema = infer(Thing)
    check_strict(schema)
    leaves = {c.flat_name: (c.physical, str(c.annotation), c.max_definition, c.max_repetition) for c in ColumnTree(schema).leaves}
    assert leaves["name"] == ("binary", "STRING", 0, 0) and leaves["small"] == ("int32", "INT(16, false)", 0, 0) and leaves["price"] == ("int32", "DECIMAL(7, 2)", 0, 0)
    assert leaves["parts.list.element.weight"] == ("double", "None", 2, 1) and leaves["tags.key_value.value"] == ("int64", "INT(64, true)", 2, 1) and leaves["maybe.list.element"][2] == 2
    assert leaves["uid"] == ("fixed_len_byte_array", "UUID", 0, 0) and "other" in leaves and "hidden" not in leaves and schema.root.name == "autogen_schema"
    classic = {c.flat_name: c.max_definition for c in ColumnTree(infer(Thing, classic=True)).leaves}
    assert classic["tags.key_value.value"] == 3 and "when" in classic


@pytest.mark.parametrize("hint", [complex, object, list, int | str, tuple[int, str], dict[int | None, str], decimal.Decimal, type(lambda: 0)])
def test_infer_rejects(hint):
    with pytest.raises(SchemaError):
        infer(dataclasses.make_dataclass("X", [("a", hint)]))
    with pytest.raises(SchemaError):
        infer(3)
