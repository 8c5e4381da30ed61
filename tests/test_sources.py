"""Footers, scans, sinks, CSV, splitting, streams and the command line."""

import json
from contextlib import nullcontext
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lamella import cli
from lamella.functions.handlers import bytes_of
from lamella.schema import ColumnTree, parse, render
from lamella.sources import footer
from lamella.sources.csv import csv_to_parquet, derive_schema, read_typed_csv
from lamella.sources.scan import ScanOptions, head, read_json_array, rows, scan, seek
from lamella.sources.sinks import SinkOptions, codec, conform, merge_files, merge_metadata, register_codec, write, write_with_metadata
from lamella.sources.split import split, split_parts
from lamella.streaming.landing import csv_stream, parquet_stream, windowed_stats, write_stream


@pytest.fixture(scope="module")
def groups(tmp_path_factory):
    """Ten row groups of a hundred rows."""
    path = str(tmp_path_factory.mktemp("g") / "g.parquet")
    n = range(1000)
    table = pa.table({
        "a": pa.array(n, pa.int64()), "x": pa.array([{"c": k, "d": str(k)} if k % 7 else None for k in n], pa.struct([("c", pa.int64()), ("d", pa.string())])), "a.b": pa.array([k % 3 if k % 2 else None for k in n], pa.int32()),
        "l": pa.array([[k, None] if k % 5 else [] for k in n], pa.list_(pa.int32())), "m": pa.array([[("k", k)] for k in n], pa.map_(pa.string(), pa.int64())), "t": pa.array([1000] * 1000, pa.timestamp("ns", "UTC")),
    }, metadata={"made": "here", "empty": ""})
    pq.write_table(table, path, row_group_size=100)
    return path


def test_footer(spark, groups):
    f = footer.footer(spark, groups).first()
    assert (f["num_rows"], f["num_row_groups"], f["num_columns"]) == (1000, 10, 8) and footer.row_count(spark, groups) == 1000
    g = footer.row_groups(spark, groups).orderBy("row_group").collect()
    assert [r["first_row"] for r in g] == list(range(0, 1000, 100)) and all(r["num_rows"] == 100 for r in g)
    c = footer.chunks(spark, groups)
    mine = c.groupBy("path").agg(F.sum("num_values").alias("n"), F.sum("null_count").alias("k")).collect()
    theirs = duckdb.sql(f"SELECT path_in_schema AS p, sum(num_values)::BIGINT n, sum(stats_null_count)::BIGINT k FROM parquet_metadata('{groups}') GROUP BY 1").fetchall()
    assert sorted((r["path"].replace(".", ", "), r["n"], r["k"]) for r in mine) == sorted((p.replace(".", ", "), n, k) for p, n, k in theirs)
    assert footer.kv_metadata(spark, groups).first()["metadata"]["made"] == "here"
    schema = footer.file_schema(groups)
    assert parse(render(schema)) == schema and [c.flat_name for c in ColumnTree(schema).leaves] == ["a", "x.c", "x.d", "`a.b`", "l.list.element", "m.key_value.key", "m.key_value.value", "t"]
    assert [r["path"] for r in footer.columns(spark, groups).orderBy("index").collect()][3] == "`a.b`"
    with pytest.raises(Exception, match="view is one of"):
        footer.footer(spark, groups, "nothing").collect()


def test_scan(spark, groups):
    nanos = ScanOptions(schema=footer.file_schema(groups))
    df = scan(spark, groups, nanos)
    assert df.count() == 1000 and dict(df.dtypes)["t"] == "bigint"
    some = scan(spark, groups, ScanOptions(schema=nanos.schema, columns=("x.c", "a", "nothing", "`a.b`")))
    assert some.schema.simpleString() == "struct<a:bigint,x:struct<c:bigint>,a.b:int>"
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "x:struct<c:bigint>" in plan and "m:map" not in plan
    assert some.filter("x IS NULL").count() == 143
    with pytest.raises(ValueError, match="nothing"):
        scan(spark, groups, ScanOptions(schema=nanos.schema, columns=("nothing",), strict=True))
    part = scan(spark, groups, ScanOptions(schema=nanos.schema, columns=("a",), row_groups=(2, 5), skip_row_groups=(5,)))
    assert sorted(r["a"] for r in part.collect()) == list(range(200, 300))
    checked = scan(spark, groups, ScanOptions(schema=nanos.schema, columns=("a",), verify_checksums=True))
    assert checked.count() == 1000


def test_seek_and_head(spark, tmp_path):
    write(spark.range(1000), str(tmp_path / "d"), SinkOptions(row_group_rows=100))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 1000
    last = {r["file"]: r["n"] for r in footer.row_groups(spark, str(tmp_path / "d")).groupBy("file").agg(F.max("row_group").alias("n")).collect()}
    total = seek(spark, str(tmp_path / "d"), 1).count()
    assert total == 1000 - 100 * len(last)
    one = spark.range(50).coalesce(1)
    write(one, str(tmp_path / "e"))
    df = spark.read.parquet(str(tmp_path / "e"))
    assert [r["id"] for r in head(df).collect()] == [0, 1, 2, 3, 4] and head(df, -1).count() == 50 and len(list(rows(df))) == 50
    assert [r["id"] for r in head(df, 2, ["id"]).collect()] == [0, 1] and head(spark.range(9), 3).count() == 3


@pytest.mark.parametrize("name", ["UNCOMPRESSED", "snappy", "GZIP", "ZSTD"])
@pytest.mark.parametrize("v2", [False, True])
def test_write(spark, tmp_path, name, v2):
    df = spark.range(500).select("id", F.concat(F.lit("v"), F.col("id") % 9).alias("s"), F.when(F.col("id") % 4 > 0, F.col("id")).alias("n"))
    options = SinkOptions(codec=name, row_group_rows=50, page_bytes=512, v2_pages=v2, checksums=True, dictionary={"s": False})
    plain = name == "UNCOMPRESSED" and v2
    with pytest.warns(UserWarning, match="Vectorized") if plain else nullcontext():
        write(df.coalesce(1), str(tmp_path / "d"), options)
    spark.conf.set("spark.sql.parquet.enableVectorizedReader", not plain)
    back = scan(spark, str(tmp_path / "d"), ScanOptions(verify_checksums=True))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}
    spark.conf.unset("spark.sql.parquet.enableVectorizedReader")
    c = footer.chunks(spark, str(tmp_path / "d")).collect()
    assert {r["codec"] for r in c} == {name.upper()} and max(r["row_group"] for r in c) == 9
    assert all(not any("DICTIONARY" in e for e in r["encodings"]) for r in c if r["path"] == "s")
    assert any("DELTA" in e for r in c for e in r["encodings"]) == v2


def test_write_nothing(spark, tmp_path):
    write(spark.range(0).coalesce(1), str(tmp_path / "d"))
    assert spark.read.schema("id long").parquet(str(tmp_path / "d")).count() == 0 and footer.row_count(spark, str(tmp_path / "d")) == 0
    with pytest.raises(ValueError, match="BROTLI"):
        codec("BROTLI")
    register_codec("mine", "zstd")
    assert codec("MINE") == "zstd"


def test_conform(spark, tmp_path):
    schema = parse("message m { required int64 id = 3; optional int32 n; optional binary gone (STRING); }")
    df = spark.range(3).select("id", (F.col("id") + 1).alias("n"), F.lit(1).alias("extra"))
    out = conform(df, schema)
    assert out.columns == ["id", "n", "gone"] and not out.schema["id"].nullable and [tuple(r) for r in out.orderBy("id").collect()] == [(0, 1, None), (1, 2, None), (2, 3, None)]
    write(df, str(tmp_path / "d"), SinkOptions(schema=schema))
    kept = {c.name: c.repetition for c in ColumnTree(footer.file_schema(str(tmp_path / "d"))).leaves}
    assert kept == {"id": "required", "n": "optional", "gone": "optional"}
    with pytest.raises(Exception, match="id is required"):
        conform(df.withColumn("id", F.when(F.col("id") > 0, F.col("id"))), schema).collect()
    with pytest.raises(ValueError, match="no column id"):
        conform(df.drop("id"), schema)


def test_metadata(spark, tmp_path):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("s")).repartition(3)
    made = write_with_metadata(df, str(tmp_path / "d"), {"made by": "me"}, SinkOptions(codec="ZSTD"), {"s": {"b": "own", "c": "!"}}, {"a": "1", "b": "2"})
    assert sum(r["num_rows"] for r in made.collect()) == 100 and spark.read.parquet(str(tmp_path / "d")).count() == 100
    assert {r["metadata"]["made by"] for r in footer.kv_metadata(spark, str(tmp_path / "d")).collect()} == {"me"}
    assert pq.read_schema(made.first()["file"][7:]).field("s").metadata.items() >= {b"a": b"1", b"b": b"own", b"c": b"!"}.items()
    assert footer.column_metadata(spark, str(tmp_path / "d"), "s").first()["metadata"] == {"a": "1", "b": "own", "c": "!"}
    with pytest.raises(ValueError, match="no column z"):
        footer.column_metadata(spark, str(tmp_path / "d"), "z")
    assert merge_metadata({"a": "x", "b": "y"}, {"b": "z"}) == {"a": "x", "b": "z"}


CSV = "person,age,is,score,note\nAnn,41,TRUE,1.5,\"a, \"\"b\"\"\nc\"\nBob,,0,,\nÇe,7,f,-2e3,x\n"
HINTS = "age=int8, is=boolean,score=double, nobody=int64"


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    df = read_typed_csv(spark, str(tmp_path / "a.csv"), HINTS)
    assert df.schema.simpleString() == "struct<person:string,age:tinyint,is:boolean,score:double,note:string>"
    assert [tuple(r) for r in df.collect()] == [("Ann", 41, True, 1.5, 'a, "b"\nc'), ("Bob", None, False, None, None), ("Çe", 7, False, -2000.0, "x")]
    csv_to_parquet(spark, str(tmp_path / "a.csv"), str(tmp_path / "p"), HINTS)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    assert render(derive_schema(["a", "b.c"], {"a": "uint16", "z": "json"})) == "message msg {\n  optional int32 a (INT(16, false));\n  optional binary b.c (STRING);\n}\n"


@pytest.mark.parametrize(("text", "hints"), [("a,b\n1\n", ""), ("a,b\n1,2,3\n", ""), ("a\nx\n", "a=int32"), ("a\n300\n", "a=uint8"), ("a\nyes\n", "a=boolean"), ("a\n{\n", "a=json"), ("a\n1e999\n", "a=double")])
def test_csv_errors(spark, tmp_path, text, hints):
    (tmp_path / "a.csv").write_text(text)
    with pytest.raises(Exception, match=r"(?s)."):
        read_typed_csv(spark, str(tmp_path / "a.csv"), hints).collect()


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1, "b": ["x"]}, {"a": None}]))
    assert sorted(str(r) for r in read_json_array(spark, str(tmp_path / "a.json")).collect()) == ["Row(a=1, b=['x'])", "Row(a=None, b=None)"]


def test_split(spark, tmp_path):
    df = spark.range(1000).select("id", F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("s"))
    parts = {}
    for r in split_parts(df, ["id"], 1000).collect():
        parts.setdefault(r["part"], []).append((r["id"], 8 + r["id"] % 90))
    ordered = [sorted(parts[k]) for k in sorted(parts)]
    assert sorted(parts) == list(range(1, len(parts) + 1)) and [i for p in ordered for i, _ in p] == list(range(1000))
    upto = 0
    for p in ordered[:-1]:
        upto += sum(n for _, n in p)
        assert upto - p[-1][1] < 1000 * (ordered.index(p) + 1) <= upto
    split(df, str(tmp_path / "d"), ["id"], "10KB", "5KB")
    files = footer.list_files(str(tmp_path / "d"))
    assert len(files) == len({f.split("/part=")[1].split("/")[0] for f in files}) > 2 and spark.read.parquet(str(tmp_path / "d")).count() == 1000
    merge_files(spark.read.parquet(str(tmp_path / "d")), str(tmp_path / "e"))
    assert len(footer.list_files(str(tmp_path / "e"))) == 1


def test_streams(spark, tmp_path):
    schema = parse("message m { optional int64 id; optional binary s (STRING); }")
    spark.range(30).select("id", F.lit("x").alias("s")).write.parquet(str(tmp_path / "in"))
    write_stream(parquet_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    spark.range(30, 50).select("id", F.lit("y").alias("s")).write.mode("append").parquet(str(tmp_path / "in"))
    write_stream(parquet_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(50))
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv/a.csv").write_text("t,v\n2024-01-01T00:10:00Z,1\n2024-01-01T00:50:00Z,\n2024-01-01T02:00:00Z,5\n")
    stream = csv_stream(spark, str(tmp_path / "csv"), ["t", "v"], "v=int64").withColumn("t", F.to_timestamp("t"))
    query = windowed_stats(stream, "t", "v").writeStream.outputMode("complete").format("memory").queryName("stats").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r)[1:] for r in spark.sql("SELECT * FROM stats ORDER BY window_start").collect()] == [(2, 1, 1, 1), (1, 0, 5, 5)]


def test_commands(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], (2.5, None), bytearray(b"x")), (2, None, None, None)], "id long, l array<string>, s struct<u:double,v:int>, b binary").coalesce(1)
    write(df, str(tmp_path / "d"))
    run = lambda *a: cli.run(spark, cli.parser().parse_args([*a]))
    path = str(tmp_path / "d")
    assert run("cat", path) == ['b = x\nid = 1\nl = ["a","b"]\ns:\n.u = 2.5\n', "id = 2\n"]
    assert [json.loads(x)["id"] for x in run("head", path, "-n", "1", "--json", "--columns", "id")] == [1]
    assert run("rowcount", path) == ["Total RowCount: 2"] and run("schema", path)[0].startswith("message ")
    assert run("meta", path)[1] == "l.list.element:\t\tOPTIONAL BINARY R:1 D:3"
    run("split", path, str(tmp_path / "s"), "--order", "id", "--file-size", "1KB")
    run("merge", path, str(tmp_path / "m"))
    (tmp_path / "a.csv").write_text(CSV)
    run("csv2parquet", "--input", str(tmp_path / "a.csv"), "--output", str(tmp_path / "c"), "--typehints", HINTS)
    assert spark.read.parquet(str(tmp_path / "s")).count() == spark.read.parquet(str(tmp_path / "m")).count() == 2 and spark.read.parquet(str(tmp_path / "c")).count() == 3
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["fly"])
    assert bytes_of("100MB") == 100 * 1024 * 1024


def test_only_the_chosen_row_groups_are_read(spark, tmp_path):
    """The bytes of another group may be anything."""
    path = str(tmp_path / "t")
    write(spark.range(3000).select("id", F.col("id").cast("string").alias("s")).coalesce(1), path, SinkOptions(row_group_rows=1000, codec="UNCOMPRESSED"))
    name = footer.list_files(path)[0].removeprefix("file://")
    at = [r["data_page_offset"] for r in footer.chunks(spark, path).orderBy("row_group", "column").collect()]
    data = bytearray(Path(name).read_bytes())
    data[at[2] : at[4] - 8] = bytes(at[4] - 8 - at[2])  # all pages of group 1
    Path(name).write_bytes(bytes(data))
    for crc in Path(name).parent.glob(".*.crc"):
        crc.unlink()
    for options in (ScanOptions(row_groups=(0, 2)), ScanOptions(skip_row_groups=(1,)), ScanOptions(columns=("id",), skip_row_groups=(1,))):
        df = scan(spark, path, options)
        assert sorted(r["id"] for r in df.collect()) == [*range(1000), *range(2000, 3000)]
        assert "FileScan" not in df._jdf.queryExecution().toString()
    assert seek(spark, path, 2).count() == 1000 and scan(spark, path, ScanOptions(row_groups=())).count() == 0


def test_column_pairs_by_path(spark, tmp_path):
    df = spark.range(3).select("id", F.struct(F.col("id").alias("bar"), F.array("id").alias("l")).alias("x"))
    path = str(tmp_path / "t")
    write_with_metadata(df, path, {}, column_metadata={"x.bar": {"k": "v"}, "x.l": {"m": "n"}}, everywhere={"a": "b"})
    pairs = {r["metadata"]["k"] for r in footer.column_metadata(spark, path, "x.bar").collect()}
    assert pairs == {"v"} and footer.column_metadata(spark, path, "x.l").first()["metadata"] == {"m": "n"}
    assert footer.column_metadata(spark, path, "id").first()["metadata"] == {"a": "b"}
    with pytest.raises(ValueError, match="no column"):
        footer.column_metadata(spark, path, "x.foo")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 1, 2]


def test_local_folders_are_for_local_masters(spark, monkeypatch):
    from lamella.plans import scratch

    class Remote:
        conf, sparkContext = type("C", (), {"get": lambda *a: None})(), type("S", (), {"master": "spark://there:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.base_folder(Remote)


def test_paths_inside_lists_and_maps(spark, tmp_path):
    path = str(tmp_path / "t")
    entry = F.struct(F.col("id").alias("a"), F.col("id").cast("string").alias("b"))
    write(spark.range(3).select("id", F.array(entry).alias("l"), F.create_map(F.col("id"), entry).alias("m")), path)
    df = scan(spark, path, ScanOptions(columns=("l.list.element.b", "m.key_value.value.a", "none")))
    assert df.schema.simpleString() == "struct<l:array<struct<b:string>>,m:map<bigint,struct<a:bigint>>>"
    assert sorted((r["l"][0]["b"], *r["m"].items()) for r in df.collect()) == [(str(k), (k, (k,))) for k in range(3)]
    assert "ReadSchema: struct<l:array<struct<b:string>>,m:map<bigint,struct<a:bigint>>>" in df._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="no column"):
        scan(spark, path, ScanOptions(columns=("l.list.element.b", "none"), strict=True))


def test_schema_leaves_of_several_files(spark, tmp_path):
    """A table's leaves come once, however many files it has."""
    from lamella import catalogue_files

    spark.range(8, numPartitions=4).selectExpr("id AS vec_id", "array(1.0f) AS embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(r["path"] for r in catalogue_files.schema_leaves(spark, str(tmp_path)).collect()) == ["embedding.list.element", "vec_id"]


def _orders(spark, folder, n):
    spark.range(n, numPartitions=3).selectExpr(f"(id * 7919) % {n} AS o_orderkey", "1.25D AS o_totalprice", "concat('p', id) AS o_orderpriority").write.parquet(str(folder / "orders.parquet"))


def test_row_groups_through_several_files(spark, tmp_path, monkeypatch):
    """Groups are numbered as in one file, but no task holds or sorts the table."""
    from lamella import catalogue_files

    monkeypatch.setattr(catalogue_files, "_FILE_ROWS", 2000)
    _orders(spark, tmp_path, 5500)
    files, store = [], catalogue_files.write
    monkeypatch.setattr(catalogue_files, "write", lambda df, path, options: store(df, path, options) or files.append(footer.footer(spark, path).select("num_rows").collect()))
    got = {}
    for r in catalogue_files.row_group_scan(spark, str(tmp_path)).collect():
        got.setdefault(r["part"], []).append(r["o_orderkey"])
    want = {"chosen": [*range(1000), *range(2000, 3000)], "skipped": [*range(1000, 2000), *range(3000, 5500)], "sought": [*range(3000, 5500)]}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert sorted(r[0] for r in files[0]) == [1500, 2000, 2000]


def test_sinks_count_groups_of_large_tables(spark, tmp_path, monkeypatch):
    """What is beyond a row group's bytes goes to further files, not to further groups of one."""
    import dataclasses

    from lamella import catalogue_files

    monkeypatch.setattr(catalogue_files, "_FILE_ROWS", 2000)
    small = {k: (dataclasses.replace(o, row_group_bytes=60_000), c, n) for k, (o, c, n) in catalogue_files._SINKS.items() if k in ("none", "groups")}
    monkeypatch.setattr(catalogue_files, "_SINKS", small)
    _orders(spark, tmp_path, 9500)
    assert {r["sink"]: (r["num_rows"], r["row_groups"]) for r in catalogue_files.sinks(spark, str(tmp_path)).collect()} == {"none": (9500, 1), "groups": (9500, 10)}
