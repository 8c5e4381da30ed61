"""Statistics, dictionaries, encodings, levels, typed rows and functions; and the catalogue against SQL."""

import dataclasses
import datetime
import math
import random
import uuid
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamella import catalogue
from lamella.functions import collections as lists
from lamella.functions import handlers, hashes, temporal
from lamella.operators import bitpack, dictionary, encodings, levels, rows, stats
from lamella.plans.numbering import numbered, running, with_previous
from lamella.schema import ColumnTree, parse, to_struct_type
from verify import plain

SF = "/root/testdata/sf0.001"


def one(spark, **columns):
    """The values of expressions over one row."""
    return tuple(spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first())


# numbering


def test_numbering(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 5).alias("v"))
    assert {r["k"]: r["position"] for r in numbered(df, ["k"], partitions=7).collect()} == {k: k for k in range(1000)}
    sums, total = {}, 0
    for r in sorted(df.collect()):
        total += r["v"]
        sums[r["k"]] = total
    assert {r["k"]: r["s"] for r in running(df, ["k"], {"s": F.col("v")}, 5).collect()} == sums
    lagged = with_previous(numbered(df, ["k"]), "k", rows=10).collect()
    assert all(r["previous"] == (r["k"] - 1 if r["k"] else None) for r in lagged) and len(lagged) == 1000
    assert numbered(spark.range(0), ["id"]).collect() == []


# statistics


def test_column_stats(spark):
    df = spark.createDataFrame([(1.0, 3, "b", True, [1]), (math.nan, None, "é", None, None), (None, 3, "", False, [])], "f double, n int, s string, b boolean, l array<int>")
    got = {r["column"]: tuple(r)[1:] for r in stats.column_stats(df.drop("l")).collect()}
    assert got["f"][:2] == (3, 1) and got["f"][3:5] == (1.0, 1.0) and got["f"][7] == 16
    assert got["n"] == (3, 1, 1, 3.0, 3.0, None, None, 8) and got["s"] == (3, 0, 3, None, None, "", "é", 3) and got["b"] == (3, 1, 2, None, None, None, None, 0)
    nulls = stats.column_stats(df.select(F.lit(None).cast("long").alias("z"), F.lit(math.nan).alias("y"))).collect()
    assert [tuple(r)[3:6] for r in nulls] == [(0, None, None), (1, None, None)] or [tuple(r)[4:6] for r in nulls] == [(None, None), (None, None)]
    assert stats.column_stats(df.select("n").limit(0)).first()["num_values"] == 0
    assert stats.column_stats(df.select("n"), distinct="approx").first()["distinct_count"] == 1
    assert stats.column_stats(df.select("l"), distinct="none").first()["null_count"] == 1


def test_time_statistics(spark):
    df = spark.createDataFrame([(datetime.datetime(2019, 3, 4, 5, 6, 7, 89), datetime.date(2019, 3, 4)), (datetime.datetime(1960, 1, 1), datetime.date(1960, 1, 1))], "t timestamp_ntz, d date")
    got = {r["column"]: (r["min_num"], r["max_num"]) for r in stats.column_stats(df).collect()}
    assert got["d"] == (-3653.0, 17959.0) and got["t"] == (-315619200e6, 1551675967000089.0)


def test_extremes_of_bytes_and_long_integers(spark):
    big = (1 << 53) + 1
    df = spark.createDataFrame([(0, bytearray(b"\xff"), big, "b", True), (1, bytearray(b"\x00\x01"), -big, "a", None), (2, None, 5, None, False)], "k int, y binary, n long, s string, b boolean")
    got = {r["column"]: r for r in stats.column_stats(df, longs=True).collect()}
    assert (got["y"]["min_text"], got["y"]["max_text"]) == ("0001", "FF")
    assert (got["n"]["min_long"], got["n"]["max_long"]) == (-big, big) and got["s"]["min_long"] is None
    rows = {(r["row_group"], r["column"]): tuple(r)[2:] for r in stats.row_group_stats(df, ["y", "n", "s", "b"], ["k"], 2, longs=True).collect()}
    assert rows[0, "y"] == (2, 0, None, None, "0001", "FF", None, None) and rows[0, "s"] == (2, 0, None, None, "a", "b", None, None)
    assert rows[0, "n"] == (2, 0, -float(big), float(big), None, None, -big, big) and rows[1, "y"] == (1, 1, *[None] * 6) and rows[0, "b"] == (2, 1, *[None] * 6)


# dictionaries and encodings


def test_dictionary(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(["x", "y", None, "x", "z", "y", None])], "k long, v string")
    assert [tuple(r) for r in dictionary.dictionary(df, "v", ["k"]).orderBy("index").collect()] == [("x", 0, 0), ("y", 1, 1), ("z", 4, 2)]
    assert [r["index"] for r in dictionary.dictionary_encode(df, "v", ["k"]).orderBy("position").collect()] == [0, 1, None, 0, 2, 1, None]
    r = dictionary.dictionary_report(df, ["v"]).first()
    assert tuple(r) == ("v", 3, True, 2, 3 + 4 * 5, 5)
    four = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 1, 2, 3, 4, None)], "v int")
    assert tuple(dictionary.dictionary_report(four, ["v"]).first())[1:] == (4, True, 3, 16 + 32, 32)
    assert dictionary.dictionary_report(df.select((F.col("v") == "x").alias("b")), ["b"]).first()["eligible"] is False
    assert one(spark, a=dictionary.bit_width(F.lit(0)), b=dictionary.bit_width(F.lit(255)), c=dictionary.bit_width(F.lit(256))) == (0, 8, 9)


def test_encodings(spark):
    values = ["hello", "hallo", "hello", "hellotoyou", "hello", "é", "è", "", None, "x"]
    df = spark.createDataFrame(list(enumerate(values)), "k long, v string")
    front = encodings.front_encode(df, "v", ["k"]).orderBy("position").collect()
    assert [r["prefix"] for r in front] == [0, 1, 1, 5, 5, 0, 1, 0, 0, 0]
    assert [r["value"] for r in encodings.front_decode(encodings.front_encode(df.filter("k < 8"), "v", ["k"], 4), 4).orderBy("position").collect()] == [v.encode() for v in values[:8]]
    assert [tuple(r)[1:] for r in encodings.delta_lengths(df, "v", ["k"]).orderBy("position").collect()][:5] == [(5, None), (5, 0), (5, 0), (10, 5), (5, -5)]
    got = [tuple(r) for r in encodings.runs(spark.createDataFrame(list(enumerate([1, 1, None, None, 2, 1, 1, 1])), "k long, v int"), "v", ["k"]).orderBy("run").collect()]
    assert got == [(0, 1, 0, 2), (1, None, 2, 2), (2, 2, 4, 1), (3, 1, 5, 3)]
    pairs = [("hello", "goodbye", 0), ("hello", "hallo", 1), ("hello", "hello", 5), ("hellotoyou", "hello", 5), ("hello", "hellotoyou", 5), ("", "a", 0)]
    assert [one(spark, p=encodings.common_prefix(F.lit(a), F.lit(b)))[0] for a, b, _ in pairs] == [n for *_, n in pairs]
    assert [bitpack.prefix_length(a.encode(), b.encode()) for a, b, _ in pairs] == [n for *_, n in pairs]


@pytest.mark.parametrize("width", range(65))
def test_pack(width):
    g = random.Random(width)
    values = np.array([g.getrandbits(width) if width else 0 for _ in range(37)], np.uint64)
    data = bitpack.pack(values, width)
    assert len(data) == 5 * width and (bitpack.unpack(data, width, 37) == values).all()
    number = int.from_bytes(data, "little")
    assert all(number >> (k * width) & ((1 << width) - 1) == int(v) for k, v in enumerate(values))


def test_pack_golden():
    assert bitpack.pack(np.arange(8), 3).hex() == "88c6fa"  # the example of the format's description
    assert bitpack.hybrid_decode(bytes([0x03, 0x88, 0xC6, 0xFA]), 3, 8).tolist() == list(range(8))
    assert bitpack.hybrid_decode(bytes([0x14, 0x04]), 3, 10).tolist() == [4] * 10
    assert bitpack.varint(300) == b"\xac\x02" and [bitpack.unzigzag(bitpack.zigzag(n)) for n in (0, -1, 1, -(2**63), 2**63 - 1)] == [0, -1, 1, -(2**63), 2**63 - 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 7), st.just(5)), max_size=200), st.integers(0, 40))
def test_hybrid(values, run):
    v = np.array([*values, *[3] * run, *values[:5]], np.uint64)
    assert bitpack.hybrid_decode(bitpack.hybrid_encode(v, 3), 3, len(v)).tolist() == v.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=400), st.lists(st.integers(-(2**31), 2**31 - 1), max_size=300), st.lists(st.binary(max_size=20), max_size=150))
def test_delta_and_bytes(longs, ints, texts):
    for v, bits in ((longs, 64), (ints, 32)):
        data = bitpack.delta_encode(np.array(v, np.int64), bits)
        got, end = bitpack.delta_decode(data + b"rest", bits)
        assert got.tolist() == v and end == len(data)
    assert bitpack.lengths_decode(bitpack.lengths_encode(texts)) == texts
    assert bitpack.front_decode(bitpack.front_encode(sorted(texts))) == sorted(texts)
    assert bitpack.plain_decode(bitpack.plain_encode(texts, "binary"), "binary", len(texts)) == texts
    assert bitpack.plain_decode(bitpack.plain_encode(longs, "int64"), "int64", len(longs)) == longs


def test_levels_as_bytes():
    v = np.array([0, 1, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 0, 1], np.uint64)
    for sized in (True, False):
        data = bitpack.levels_encode(v, 2, sized)
        assert bitpack.levels_decode(data, 2, len(v), sized).tolist() == v.tolist() and (int.from_bytes(data[:4], "little") == len(data) - 4) == sized
    assert bitpack.levels_encode(v * 0, 0) == b"" and bitpack.levels_decode(b"", 0, 3).tolist() == [0, 0, 0]


def test_plain():
    assert bitpack.plain_encode([1, -1], "int32").hex() == "01000000ffffffff" and bitpack.plain_encode([True, False, True], "boolean") == b"\x05"
    assert bitpack.plain_decode(b"\x05", "boolean", 3) == [True, False, True] and bitpack.plain_decode(bitpack.plain_encode([1.5], "double"), "double", 1) == [1.5]
    assert bitpack.plain_decode(b"x" * 24, "int96", 2) == [b"x" * 12] * 2


def test_encoded_pages(spark):
    df = spark.range(100).select("id", (F.col("id") * 3).alias("v"), F.concat(F.lit("name"), F.col("id")).alias("s"))
    pages = bitpack.encode_pages(df, "v", ["id"], "DELTA_BINARY_PACKED", 40).orderBy("page").collect()
    assert [r["num_values"] for r in pages] == [40, 40, 20] and [x for r in pages for x in bitpack.delta_decode(bytes(r["data"]))[0].tolist()] == [3 * k for k in range(100)]
    pages = bitpack.encode_pages(df, "s", ["id"], "DELTA_BYTE_ARRAY", 60).orderBy("page").collect()
    assert [x for r in pages for x in bitpack.front_decode(bytes(r["data"]))] == [f"name{k}".encode() for k in range(100)]


# levels

PAPER = """message Document {
  required int64 docid;
  optional group links { repeated int64 backward; repeated int64 forward; }
  repeated group name { repeated group language { required int64 code; optional int64 country; } optional int64 url; }
}"""
RECORDS = [
    (10, ([], [20, 40, 60]), [([(1, 100), (2, None)], 10), ([], 11), ([(3, 101)], None)]),
    (20, ([10, 30], [80]), [([], 12)]),
]


def test_levels_of_the_paper(spark):
    schema = parse(PAPER)
    tree, df = ColumnTree(schema), spark.createDataFrame(RECORDS, to_struct_type(schema))
    got = {c.flat_name: [(r["value"], r["d"], r["r"]) for r in levels.shred(df, tree, c.flat_name, "docid").orderBy("key", "seq").collect()] for c in tree.leaves}
    assert got["docid"] == [(10, 0, 0), (20, 0, 0)]
    assert got["links.backward"] == [(None, 1, 0), (10, 2, 0), (30, 2, 1)]
    assert got["links.forward"] == [(20, 2, 0), (40, 2, 1), (60, 2, 1), (80, 2, 0)]
    assert got["name.url"] == [(10, 2, 0), (11, 2, 1), (None, 1, 1), (12, 2, 0)]
    assert got["name.language.country"] == [(100, 3, 0), (None, 2, 2), (None, 1, 1), (101, 3, 1), (None, 1, 0)]
    assert [x[1:] for x in got["name.language.code"]] == [(2, 0), (2, 2), (1, 1), (2, 1), (1, 0)]
    back = levels.assemble({c.flat_name: levels.shred(df, tree, c.flat_name, "docid") for c in tree.leaves}, tree)
    assert [tuple(r)[1:] for r in back.orderBy("key").collect()] == [tuple(r) for r in df.orderBy("docid").collect()]


def test_levels_in_levels(spark):
    schema = parse("message m { required int64 k; repeated group level1 { repeated int64 level2; } }")
    df = spark.createDataFrame([(1, [([1, 2, 3],), ([4, 5, 6, 7],)]), (2, [([8],), ([9, 10],)])], to_struct_type(schema))
    got = levels.shred(df, ColumnTree(schema), "level1.level2", "k").orderBy("key", "seq").collect()
    assert [r["r"] for r in got] == [0, 2, 2, 1, 2, 2, 2, 0, 1, 2] and {r["d"] for r in got} == {2} and [r["value"] for r in got] == list(range(1, 11))


def test_levels_of_absent_things(spark):
    schema = parse("""message m { required int64 k; optional group l (LIST) { repeated group list { optional int64 element; } } optional group s { optional int64 a; } optional group after { required int64 b; }
      optional group m (MAP) { repeated group key_value { required binary key (STRING); optional int64 value; } } }""")
    data = [(1, None, None, None, None), (2, [], (None,), (5,), {}), (3, [None, 7], (1,), None, {"x": None})]
    tree, df = ColumnTree(schema), spark.createDataFrame(data, to_struct_type(schema))
    got = {c.flat_name: [(r["value"], r["d"], r["r"]) for r in levels.shred(df, tree, c.flat_name, "k").orderBy("key", "seq").collect()] for c in tree.leaves}
    assert got["l.list.element"] == [(None, 0, 0), (None, 1, 0), (None, 2, 0), (7, 3, 1)]
    assert got["s.a"] == [(None, 0, 0), (None, 1, 0), (1, 2, 0)] and got["after.b"] == [(None, 0, 0), (5, 1, 0), (None, 0, 0)]
    assert got["m.key_value.value"] == [(None, 0, 0), (None, 1, 0), (None, 2, 0)]
    back = levels.assemble({c.flat_name: levels.shred(df, tree, c.flat_name, "k") for c in tree.leaves}, tree).orderBy("key").collect()
    assert [tuple(r)[1:] for r in back] == [tuple(r) for r in df.orderBy("k").collect()]
    lists_back = levels.assemble_list(levels.shred(df, tree, "l.list.element", "k"), 3).orderBy("key").collect()
    assert [r["value"] for r in lists_back] == [None, [], [None, 7]]
    with pytest.raises(ValueError, match="leaf"):
        levels.shred(df, tree, "l.list", "k")


# time


def test_int96(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    day, nanos = temporal.int96_parts(ts("2000-01-01 12:34:56"))
    assert one(spark, d=day, n=nanos) == (2451545, 45296000000000)
    for text in ("2000-01-01 12:34:56.000007", "1970-01-01 00:00:00", "1969-12-31 23:59:59.999999", "1583-01-01 00:00:01"):
        (b, same) = one(spark, b=temporal.timestamp_to_int96(ts(text)), same=temporal.int96_to_timestamp(temporal.timestamp_to_int96(ts(text))) == ts(text))
        assert len(b) == 12 and same
    assert one(spark, n=temporal.int96_to_timestamp(F.lit(b"short")), a=temporal.is_after_epoch(ts("1970-01-01")), b=temporal.is_after_epoch(ts("1970-01-02"))) == (None, False, True)


def test_instants(spark):
    text = lambda c: c.cast("timestamp_ntz").cast("string")
    got = one(
        spark, d=temporal.days_to_date(F.lit(9)).cast("string"), ns=text(temporal.unit_to_timestamp(F.lit(42000000000), "NANOS")), us=text(temporal.unit_to_timestamp(F.lit(1423000000), "MICROS")), ms=text(temporal.unit_to_timestamp(F.lit(45299450), "MILLIS", False)),
        before=temporal.timestamp_to_unit(F.lit("1969-12-31 23:59:59.9995").cast("timestamp"), "MILLIS"), days=temporal.date_to_days(F.lit("1960-01-01").cast("date")),
    )
    assert got == ("1970-01-10", "1970-01-01 00:00:42", "1970-01-01 00:23:43", "1970-01-01 12:34:59.45", -1, -3653)
    guesses = [(1700000000, "2023-11-14 22:13:20"), (1700000000123, "2023-11-14 22:13:20.123"), (1700000000123456, "2023-11-14 22:13:20.123456"), (1700000000123456789, "2023-11-14 22:13:20.123456")]
    assert [one(spark, t=text(temporal.guess_unix(F.lit(n))))[0] for n, _ in guesses] == [t for _, t in guesses]
    parsed = [("2024-02-03", "2024-02-03 00:00:00"), ("02/03/2024", "2024-02-03 00:00:00"), ("2024-02-03T04:05:06Z", "2024-02-03 04:05:06"), ("20240203", "2024-02-03 00:00:00"), ("no time", None)]
    assert [one(spark, t=text(temporal.parse_any(F.lit(s))))[0] for s, _ in parsed] == [t for _, t in parsed]


def test_times_of_day(spark):
    t = lambda *a: temporal.make_time(*[F.lit(x) for x in a])
    assert one(spark, a=temporal.time_string(t(0, 0, 30, 0)), b=temporal.time_string(t(13, 45, 35, 0)), c=temporal.time_string(t(13, 45, 35, 300)), d=temporal.time_string(temporal.time_from(F.lit(14620200), "MILLIS"))) == ("00:00:30", "13:45:35", "13:45:35.000000300", "04:03:40.200000000")
    for bad in ((-1, 0, 0, 0), (24, 0, 0, 0), (0, -30, 0, 0), (0, 76, 0, 0), (0, 0, -100, 0), (0, 0, 200, 0), (0, 0, 0, -1), (0, 0, 0, 30_000_000_000)):
        with pytest.raises(Exception, match="no time of day"):
            one(spark, t=t(*bad))
    x = F.lit(210000020 * 1000)
    assert one(spark, m=temporal.time_part(x, "minute"), s=temporal.time_part(x, "second"), us=temporal.time_part(x, "microsecond"), ms=temporal.time_to(x, "MILLIS"), full=temporal.time_to(x, "MICROS")) == (3, 30, 20, 210000, 210000020)
    assert one(spark, a=temporal.on_that_day(t(1, 2, 3, 4000), F.lit("2020-02-02").cast("date"), False).cast("string"), b=temporal.time_of(F.lit("1969-12-31 01:00:00").cast("timestamp"))) == ("2020-02-02 01:02:03.000004", 3600 * 10**9)
    assert one(spark, t=temporal.spark_time(t(13, 45, 35, 123456000)).cast("string"))[0] == "13:45:35.123456"
    assert one(spark, m=temporal.interval_parts(F.lit(bytes([1, 0, 0, 0, 2, 0, 0, 0, 0, 1, 0, 0])))[2])[0] == 256


# fields


def test_fields(spark):
    h = lambda s, k: one(spark, v=handlers.handle(F.lit(s), k))[0]
    assert [h(s, "boolean") for s in ("true", "F", "1", "")] == [True, False, True, None]
    assert [h("-1234", "int64"), h("+7", "int8"), h("255", "uint8"), h(str(2**64 - 1), "uint64"), h("000000000000000000000000012", "int32")] == [-1234, 7, 255, 2**64 - 1, 12]
    assert h("1.5e3", "double") == 1500.0 and h("abc", "byte_array") == bytearray(b"abc") and h('{"a": [1]}', "json") == '{"a": [1]}' and math.isnan(h("NaN", "float"))
    for s, k in (("invalid", "boolean"), ("tRuE", "boolean"), ("x", "int32"), ("128", "int8"), ("-1", "uint32"), (str(2**64), "uint64"), (" 1", "int64"), ("1e400", "double"), ("0x1", "double"), ('{"a":', "json"), ("1 2", "json"), ("NaN", "json")):
        with pytest.raises(Exception, match="isn't of type"):
            h(s, k)
    assert handlers.parse_hints("foo=boolean, bar = string ,") == {"foo": "boolean", "bar": "string"} and handlers.parse_hints("") == {}
    for bad in ("foo", "foo=nothing", "a=b=c", "=int32"):
        with pytest.raises(ValueError, match="isn't"):
            handlers.parse_hints(bad)


def test_sizes(spark):
    good = {"1000": 1000, "100KB": 102400, "100KiB": 100000, "3MB": 3 << 20, "3MiB": 3 * 10**6, "2GB": 2 << 30, "1TB": 1 << 40, "1PB": 1 << 50, "5PiB": 5 * 10**15}
    assert {s: handlers.bytes_of(s) for s in good} == good and {s: one(spark, n=handlers.size_to_bytes(F.lit(s)))[0] for s in good} == good
    for bad in ("ABCD", "ABCDPiB", "", "5 MB", "5kb", "-1"):
        assert one(spark, n=handlers.size_to_bytes(F.lit(bad)))[0] is None
        with pytest.raises(ValueError, match="size"):
            handlers.bytes_of(bad)


def test_lists_and_maps(spark):
    m = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    assert one(spark, a=lists.put(m, F.lit("a"), F.lit(9)), b=lists.merge_pairs(m, F.create_map(F.lit("b"), F.lit(5), F.lit("c"), F.lit(6)))) == ({"a": 9, "b": 2}, {"a": 1, "b": 5, "c": 6})
    x = F.array(F.lit(1), F.lit(2))
    assert one(spark, a=lists.append(x, F.lit(3)), b=lists.append(F.lit(None).cast("array<int>"), F.lit(3)), c=lists.fixed(x, 1), d=lists.empty_as_null(F.array().cast("array<int>"))) == ([1, 2, 3], [3], [1], None)
    u = uuid.uuid4()
    assert one(spark, t=lists.uuid_text(F.lit(u.bytes)), b=lists.uuid_bytes(F.lit(str(u)))) == (str(u), bytearray(u.bytes))
    with pytest.raises(Exception, match="16 bytes"):
        one(spark, t=lists.uuid_text(F.lit(b"short")))


def test_hashes(spark):
    texts = ["", "a", "foobar", "é" * 50, None, "x" * 3000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").coalesce(1)
    got = df.select("k", hashes.fnv1_64("t").alias("f"), hashes.crc32(F.col("t")).alias("c")).orderBy("k").collect()
    assert [r["f"] for r in got] == [None if t is None else hashes.fnv1(t.encode()) for t in texts] and hashes.fnv1(b"foobar") == 0x340D8765A4DDA9C2
    assert [r["c"] for r in got] == [None if t is None else zlib.crc32(t.encode()) for t in texts]
    even = spark.createDataFrame([(f"name{k}",) for k in range(50)], "t string").select("t", hashes.fnv1_64("t").alias("f")).collect()
    assert all(r["f"] == hashes.fnv1(r["t"].encode()) for r in even)


# typed rows


@dataclasses.dataclass
class Item:
    n: int
    note: str | None = None


@dataclasses.dataclass
class Order:
    id: int
    who: uuid.UUID
    items: list[Item]
    tags: dict[str, int]
    ratio: float | None = dataclasses.field(default=None, metadata={"parquet": "r"})
    secret: str = dataclasses.field(default="", metadata={"parquet": "-"})


class Own:
    def __init__(self, a):
        self.a = a

    def to_row(self):
        return {"a": self.a * 2}

    @classmethod
    def from_row(cls, row):
        return cls(row["a"] // 2)


def test_objects(spark, tmp_path):
    objects = [Order(1, uuid.uuid4(), [Item(1, "x"), Item(2)], {"a": 1}, 0.5, "s"), Order(2, uuid.uuid4(), [], {})]
    rows.write_objects(spark, objects, Order, str(tmp_path / "d"))
    back = sorted(rows.read_objects(spark.read.parquet(str(tmp_path / "d")), Order), key=lambda o: o.id)
    assert back == [dataclasses.replace(o, secret="") for o in objects]
    with pytest.raises(rows.FieldNotPresent):
        rows.from_row({"note": "x"}, Item)
    assert rows.from_row({"n": 3}, Item) == Item(3) and rows.to_row({"a": Item(1)}) == {"a": {"n": 1, "note": None}}
    df = rows.objects_to_df(spark, [Own(1), Own(4)], struct=to_struct_type(parse("message m { required int64 a; }")))
    assert sorted(o.a for o in rows.read_objects(df, Own)) == [1, 4]
    doubled = rows.map_rows(df, lambda r: {"a": r["a"], "b": str(r["a"])} if r["a"] > 2 else None, "a long, b string")
    assert [tuple(r) for r in doubled.collect()] == [(8, "8")]


# the catalogue


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in catalogue.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_catalogue(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got
    if name in catalogue.ORACLE:
        rel = duck.sql(catalogue.ORACLE[name].replace("/root/testdata/sf0.01/", f"{SF}/"))
        assert sorted(rel.columns) == columns
        assert got == sorted((tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_types_of_a_class_are_found_once(monkeypatch):
    import dataclasses

    kind = dataclasses.make_dataclass("Kind", [("a", int), ("b", str | None, None)])
    asked, find = [], rows.get_type_hints
    monkeypatch.setattr(rows, "get_type_hints", lambda *x, **y: asked.append(x) or find(*x, **y))
    objects = [rows.from_row({"a": k}, kind) for k in range(50)]
    assert [rows.to_row(o) for o in objects] == [{"a": k, "b": None} for k in range(50)] and len(asked) <= 1


def test_texts_are_parsed_in_few_formats(spark):
    """Only formats that a text may have are tried, and none is lost by that."""
    texts = ["2024-03-01T10:20:30.123456+01:00", "2024-03-01T10:20:30Z", "2024-03-01t10:20:30Z", "2024-03-01 10:20:30", "2024-03-01", "2024/3/1", "03/01/2024 10:20:30", "3/1/2024", "01.03.2024", "20240301102030", "20240301", "mar 1, 2024 10:20:30", "March 1, 2024", "1 Mar 2024 10:20:30 GMT", "1 Mar 2024 10:20:30 +0100", "1 March 2024", "Mar 1 10:20:30 2024", "at noon", "", "+2024-03-01"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    plain = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in temporal.FORMATS], F.try_to_timestamp(t))
    assert all(a == b for a, b in df.select(plain, temporal.parse_any(t)).collect())
    tried = df.select(*[t.rlike(temporal._shape(f)).cast("int") for f in temporal.FORMATS]).collect()
    assert max(map(sum, tried)) <= 6 and sum(tried[texts.index("at noon")]) == 0
