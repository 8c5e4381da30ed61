"""The queries over the library's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import collections as lists
from lamella.functions import handlers, temporal
from lamella.operators import dictionary, encodings, levels, stats
from lamella.plans.numbering import numbered
from lamella.schema import ColumnTree, from_struct_type
from lamella.sources import footer
from lamella.sources.scan import ScanOptions, head, scan
from lamella.sources.split import split_parts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_SQL = ", ".join(LINE)


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# scans and projection


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def scan_project(spark: SparkSession, sf: str) -> DataFrame:
    return scan(spark, f"{sf}/lineitem.parquet", ScanOptions(columns=("l_orderkey", "l_quantity")))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def scan_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_size AS c FROM part WHERE p_size > 10")
def nested_project(spark: SparkSession, sf: str) -> DataFrame:
    nested = table(spark, sf, "part").select("p_partkey", F.struct(F.col("p_size").alias("c"), F.col("p_name").alias("d")).alias("x"))
    return nested.filter("x.c > 10").select("p_partkey", "x.c")


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def head_n(spark: SparkSession, sf: str) -> DataFrame:
    return head(table(spark, sf, "orders"), 5, ["o_orderkey"])


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS num_rows FROM {t}" for t in TABLES))
def rowcount(spark: SparkSession, sf: str) -> DataFrame:
    return footer.row_counts(spark, {t: f"{sf}/{t}.parquet" for t in TABLES})


@query("SELECT row_group, count(*) AS num_rows, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS row_group FROM orders) GROUP BY row_group")
def row_group_assign(spark: SparkSession, sf: str) -> DataFrame:
    groups = stats.row_group_assign(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 1000)
    return groups.groupBy("row_group").agg(F.count("*").alias("num_rows"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("SELECT o_orderkey, row_group FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS row_group FROM orders) WHERE row_group NOT IN (0, 2)")
def row_group_skip(spark: SparkSession, sf: str) -> DataFrame:
    return stats.row_group_assign(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 1000).filter("row_group NOT IN (0, 2)")


# statistics

_NUMBERS = {"l_orderkey": 8, "l_partkey": 8, "l_suppkey": 8, "l_linenumber": 4, "l_quantity": 8, "l_extendedprice": 8, "l_discount": 8, "l_tax": 8}
_STATS = [f"SELECT '{c}' AS \"column\", count(*) AS num_values, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, min({c})::DOUBLE AS min_num, max({c})::DOUBLE AS max_num, NULL::VARCHAR AS min_text, NULL::VARCHAR AS max_text, (count({c}) * {n})::BIGINT AS total_bytes FROM lineitem" for c, n in _NUMBERS.items()]
_STATS += [f"SELECT '{c}', count(*), count(*) - count({c}), count(DISTINCT {c}), NULL, NULL, min({c}), max({c}), sum(strlen({c}))::BIGINT FROM lineitem" for c in ("l_returnflag", "l_linestatus")]
_STATS += ["SELECT 'l_shipdate', count(*), count(*) - count(l_shipdate), count(DISTINCT l_shipdate), min(epoch_us(l_shipdate))::DOUBLE, max(epoch_us(l_shipdate))::DOUBLE, NULL, NULL, (count(l_shipdate) * 8)::BIGINT FROM lineitem"]


@query(" UNION ALL ".join(_STATS))
def column_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.column_stats(table(spark, sf, "lineitem"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS num_values, count(*) - count(nullif({c}, {v})) AS null_count, min(nullif({c}, {v}))::DOUBLE AS min_num, max(nullif({c}, {v}))::DOUBLE AS max_num FROM lineitem" for c, v in (("l_tax", "0.0"), ("l_linenumber", "1"))))
def null_stats(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select(F.nullif("l_tax", F.lit(0.0)).alias("l_tax"), F.nullif("l_linenumber", F.lit(1)).alias("l_linenumber"))
    return stats.column_stats(df, distinct="none").select("column", "num_values", "null_count", "min_num", "max_num")


@query("SELECT (upto - bytes) // 4096 AS page, count(*) AS num_values, count(*) - count(v) AS null_count, sum(bytes)::BIGINT AS bytes FROM (SELECT c_name AS v, strlen(c_name)::BIGINT AS bytes, sum(strlen(c_name)) OVER (ORDER BY c_custkey)::BIGINT AS upto FROM customer) GROUP BY ALL")
def page_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.page_stats(table(spark, sf, "customer"), "c_name", ["c_custkey"], 4096)


@query("SELECT row_group, c AS \"column\", count(*) AS num_values, count(*) - count(v) AS null_count, min(v) AS min_num, max(v) AS max_num FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 5000 AS row_group, o_custkey, o_totalprice FROM orders) t, LATERAL (VALUES ('o_custkey', o_custkey::DOUBLE), ('o_totalprice', o_totalprice)) u(c, v) GROUP BY ALL")
def row_group_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.row_group_stats(table(spark, sf, "orders"), ["o_custkey", "o_totalprice"], ["o_orderkey"], 5000)


# dictionaries

_PLACED = "SELECT {v} AS v, row_number() OVER (ORDER BY {o}) - 1 AS p FROM {t}"
_ENTRIES = "SELECT v, row_number() OVER (ORDER BY min(p)) - 1 AS i FROM a WHERE v IS NOT NULL GROUP BY v"


@query(f"WITH a AS ({_PLACED.format(v='p_type', o='p_partkey', t='part')}), d AS ({_ENTRIES}) SELECT a.p AS position, d.i AS index FROM a LEFT JOIN d USING (v)")
def dict_encode(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary.dictionary_encode(table(spark, sf, "part"), "p_type", ["p_partkey"])


@query(f"WITH a AS ({_PLACED.format(v='p_type', o='p_partkey', t='part')}) SELECT v AS value, min(p) AS first_position, row_number() OVER (ORDER BY min(p)) - 1 AS index FROM a GROUP BY v")
def dict_entries(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary.dictionary(table(spark, sf, "part"), "p_type", ["p_partkey"])


@query("SELECT p_partkey, p_type FROM part")
def dict_decode(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    encoded = dictionary.dictionary_encode(part, "p_type", ["p_partkey"])
    values = dictionary.dictionary_decode(encoded, dictionary.dictionary(part, "p_type", ["p_partkey"]))
    keys = numbered(part.select("p_partkey"), ["p_partkey"])
    return values.join(keys, "position").select("p_partkey", F.col("value").alias("p_type"))


_DICT = "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS entries, count(DISTINCT {c}) <= 32767 AS eligible, length(bin(count(DISTINCT {c})))::INTEGER AS index_bits, (SELECT sum({s}) FROM (SELECT DISTINCT {c} FROM lineitem))::BIGINT + 4 * count({c}) AS dictionary_bytes, sum({s})::BIGINT AS plain_bytes FROM lineitem"


@query(" UNION ALL ".join(_DICT.format(c=c, s=s) for c, s in (("l_partkey", "8"), ("l_returnflag", "strlen(l_returnflag)"), ("l_linenumber", "4"), ("l_extendedprice", "8"))))
def dict_eligible(spark: SparkSession, sf: str) -> DataFrame:
    return dictionary.dictionary_report(table(spark, sf, "lineitem"), ["l_partkey", "l_returnflag", "l_linenumber", "l_extendedprice"])


@query("SELECT n, CASE WHEN n = 0 THEN 0 ELSE length(bin(n)) END::INTEGER AS bits FROM (SELECT DISTINCT l_partkey - 1 AS n FROM lineitem)")
def dict_bit_width(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "lineitem").select((F.col("l_partkey") - 1).alias("n")).distinct()
    return n.select("n", dictionary.bit_width(F.col("n")).alias("bits"))


# encodings

_DELTA = f"SELECT row_number() OVER w - 1 AS p, l_orderkey AS v, l_orderkey - lag(l_orderkey) OVER w AS d FROM (SELECT l_partkey AS l_orderkey, l_orderkey AS k, l_linenumber, l_suppkey FROM lineitem) WINDOW w AS (ORDER BY k, l_linenumber, l_orderkey, l_suppkey)"


@query(f"SELECT p AS position, v AS value, d AS delta, CASE WHEN p > 0 THEN (p - 1) // 128 END AS block, CASE WHEN p > 0 THEN (p - 1) // 32 END AS miniblock FROM ({_DELTA})")
def delta_encode(spark: SparkSession, sf: str) -> DataFrame:
    return encodings.delta_encode(table(spark, sf, "lineitem"), "l_partkey", LINE)


@query(f"WITH m AS (SELECT (p - 1) // 128 AS block, (p - 1) // 32 AS miniblock, min(d) AS lo, max(d) AS hi FROM ({_DELTA}) WHERE p > 0 GROUP BY ALL), b AS (SELECT *, min(lo) OVER (PARTITION BY block) AS min_delta FROM m) SELECT block, miniblock, min_delta, CASE WHEN hi = min_delta THEN 0 ELSE length(bin(hi - min_delta)) END::INTEGER AS bits FROM b")
def delta_widths(spark: SparkSession, sf: str) -> DataFrame:
    return encodings.delta_widths(table(spark, sf, "lineitem"), "l_partkey", LINE)


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_custkey AS value FROM orders")
def delta_decode(spark: SparkSession, sf: str) -> DataFrame:
    return encodings.delta_decode(encodings.delta_encode(table(spark, sf, "orders"), "o_custkey", ["o_orderkey"]))


@query("SELECT row_number() OVER w - 1 AS position, strlen(p_name)::BIGINT AS length, (strlen(p_name) - lag(strlen(p_name)) OVER w)::BIGINT AS delta FROM part WINDOW w AS (ORDER BY p_partkey)")
def delta_length(spark: SparkSession, sf: str) -> DataFrame:
    return encodings.delta_lengths(table(spark, sf, "part"), "p_name", ["p_partkey"])


@query("WITH a AS (SELECT row_number() OVER w - 1 AS position, c_name AS v, lag(c_name) OVER w AS b FROM customer WINDOW w AS (ORDER BY c_custkey)) SELECT position, coalesce(len(list_filter(range(1, least(length(v), length(b)) + 1), lambda i: v[1:i] = b[1:i])), 0)::INTEGER AS prefix, substr(v, coalesce(len(list_filter(range(1, least(length(v), length(b)) + 1), lambda i: v[1:i] = b[1:i])), 0) + 1) AS suffix FROM a")
def front_coding(spark: SparkSession, sf: str) -> DataFrame:
    return encodings.front_encode(table(spark, sf, "customer"), "c_name", ["c_custkey"]).withColumn("suffix", F.col("suffix").cast("string"))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS position, c_name AS value FROM customer")
def front_decoding(spark: SparkSession, sf: str) -> DataFrame:
    encoded = encodings.front_encode(table(spark, sf, "customer"), "c_name", ["c_custkey"], 500)
    return encodings.front_decode(encoded, 500).withColumn("value", F.col("value").cast("string"))


@query("WITH a AS (SELECT o_orderkey, o_orderstatus AS v, row_number() OVER w - 1 AS p, CASE WHEN lag(o_orderstatus) OVER w = o_orderstatus THEN 0 ELSE 1 END AS n FROM orders WINDOW w AS (ORDER BY o_orderkey)), b AS (SELECT *, sum(n) OVER (ORDER BY p) - 1 AS run FROM a) SELECT run::BIGINT AS run, any_value(v) AS value, min(p) AS start, count(*) AS length FROM b GROUP BY run")
def rle_runs(spark: SparkSession, sf: str) -> DataFrame:
    return encodings.runs(table(spark, sf, "orders"), "o_orderstatus", ["o_orderkey"])


@query("SELECT l_returnflag, count(*) AS n, ((count(*) + 7) // 8 * length(bin(max(l_linenumber)))) AS bytes FROM lineitem GROUP BY l_returnflag")
def hybrid_size(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("top"))
    return g.select("l_returnflag", "n", encodings.hybrid_size(F.col("n"), dictionary.bit_width(F.col("top"))).alias("bytes"))


# levels


def _tree(df: DataFrame) -> ColumnTree:
    return ColumnTree(from_struct_type(df.schema))


@query("SELECT vec_id AS key, pos::INTEGER AS seq, v::DOUBLE AS value, 3::INTEGER AS d, CASE WHEN pos = 0 THEN 0 ELSE 1 END::INTEGER AS r FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS pos FROM embeddings)")
def shred_list(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return levels.shred(df, _tree(df), "embedding.list.element", "vec_id").withColumn("value", F.col("value").cast("double"))


@query("SELECT o_orderkey AS key, nullif(o_orderpriority, '5-LOW') AS value, CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END::INTEGER AS d, 0::INTEGER AS r FROM orders")
def shred_optional(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("v"))
    return levels.shred(df, _tree(df), "v", "o_orderkey").drop("seq")


_WORDS = "SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents"


@query(f"SELECT doc_id AS key, seq::INTEGER AS seq, value, d::INTEGER AS d, r::INTEGER AS r FROM (SELECT doc_id, unnest(range(0, len(ls))) AS seq, unnest(ls) AS value, 2 AS d, unnest(list_transform(range(0, len(ls)), lambda i: CASE WHEN i = 0 THEN 0 ELSE 1 END)) AS r FROM ({_WORDS}) UNION ALL SELECT doc_id, 0, NULL, 1, 0 FROM ({_WORDS}) WHERE len(ls) = 0)")
def shred_lines(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: x != "").alias("ls"))
    return levels.shred(df, _tree(df), "ls.list.element", "doc_id")


@query("SELECT vec_id AS key, len(embedding)::INTEGER AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def assemble_list(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "embeddings").select("vec_id", "embedding")
    back = levels.assemble_list(levels.shred(df, _tree(df), "embedding.list.element", "vec_id"), 3)
    return back.select("key", F.size("value").alias("n"), F.round(F.aggregate("value", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@query("SELECT conv_id AS key, turn AS t, role, length(text)::INTEGER AS n FROM conversations")
def assemble_records(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    tree = _tree(turns)
    back = levels.assemble({c.flat_name: levels.shred(turns, tree, c.flat_name, "conv_id") for c in tree.leaves}, tree)
    return back.select("key", F.explode("turns").alias("x")).select("key", F.col("x.turn").alias("t"), "x.role", F.length("x.text").alias("n"))


# time

_US = "epoch_us(ts)"


@query(f"SELECT event_id, (date_diff('day', DATE '1970-01-01', ts::DATE) + 2440588)::INTEGER AS julian_day, ({_US} % 86400000000) * 1000 AS nanos FROM events")
def int96(spark: SparkSession, sf: str) -> DataFrame:
    day, nanos = temporal.int96_parts(F.col("ts"))
    return table(spark, sf, "events").select("event_id", day.alias("julian_day"), nanos.alias("nanos"))


@query("SELECT event_id, ts::TIMESTAMP AS back FROM events")
def int96_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", temporal.int96_to_timestamp(temporal.timestamp_to_int96(F.col("ts"))).cast("timestamp_ntz").alias("back"))


@query("SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INTEGER AS days FROM orders")
def date_days(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", temporal.date_to_days(F.col("o_orderdate")).alias("days"))


@query(f"SELECT event_id, {_US} // 1000 AS ms, {_US} AS us, {_US} * 1000 AS ns, {_US} > 0 AS after FROM events")
def ts_units(spark: SparkSession, sf: str) -> DataFrame:
    unit = lambda u: temporal.timestamp_to_unit(F.col("ts"), u)
    return table(spark, sf, "events").select("event_id", unit("MILLIS").alias("ms"), unit("MICROS").alias("us"), unit("NANOS").alias("ns"), temporal.is_after_epoch(F.col("ts")).alias("after"))


_PARTS = f"(SELECT event_id, ({_US} % 86400000000) * 1000 AS t FROM events)"


@query(f"SELECT event_id, t, (t // 3600000000000)::INTEGER AS h, (t // 60000000000 % 60)::INTEGER AS m, (t // 1000000000 % 60)::INTEGER AS s, (t // 1000000 % 1000)::INTEGER AS ms, (t // 1000 % 1000000)::INTEGER AS us, (t % 1000000000)::INTEGER AS ns, t // 1000000 AS of_day FROM {_PARTS}")
def time_parts(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("event_id", temporal.time_of(F.col("ts")).alias("t"))
    names = {"h": "hour", "m": "minute", "s": "second", "ms": "millisecond", "us": "microsecond", "ns": "nanosecond"}
    return df.select("event_id", "t", *[temporal.time_part(F.col("t"), p).alias(n) for n, p in names.items()], temporal.time_to(F.col("t"), "MILLIS").alias("of_day"))


@query(f"SELECT event_id, printf('%02d:%02d:%02d', t // 3600000000000, t // 60000000000 % 60, t // 1000000000 % 60) || CASE WHEN t % 1000000000 = 0 THEN '' ELSE printf('.%09d', t % 1000000000) END AS text FROM {_PARTS}")
def time_string(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", temporal.time_string(temporal.time_of(F.col("ts"))).alias("text"))


@query("SELECT event_id, ts::TIMESTAMP AS again FROM events")
def time_on_day(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf, "events").select("event_id", temporal.on_that_day(temporal.time_of(ts), ts, utc=False).alias("again"))


@query(f"SELECT event_id, k, make_timestamp(CASE k WHEN 's' THEN {_US} // 1000000 * 1000000 WHEN 'ms' THEN {_US} // 1000 * 1000 ELSE {_US} END) AS at FROM events, (VALUES ('s'), ('ms'), ('us'), ('ns')) u(k)")
def unix_guess(spark: SparkSession, sf: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    forms = F.explode(F.create_map(F.lit("s"), F.floor(us / 1_000_000).cast("long"), F.lit("ms"), temporal.timestamp_to_unit(F.col("ts"), "MILLIS"), F.lit("us"), us, F.lit("ns"), us * 1000))
    return table(spark, sf, "events").select("event_id", forms.alias("k", "n")).select("event_id", "k", temporal.guess_unix(F.col("n")).cast("timestamp_ntz").alias("at"))


# fields and sizes


@query("SELECT c_custkey, c_name AS name, c_custkey::INTEGER AS n, c_acctbal AS balance, nullif(c_mktsegment, 'BUILDING') AS segment, c_nationkey % 2 = 0 AS even FROM customer")
def csv_typed(spark: SparkSession, sf: str) -> DataFrame:
    text = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_name").alias("name"), F.col("c_custkey").cast("string").alias("n"), F.col("c_acctbal").cast("string").alias("balance"),
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_nationkey") % 2 == 0, "T").otherwise("false").alias("even"),
    )
    kinds = {"name": "string", "n": "int32", "balance": "double", "segment": "string", "even": "boolean"}
    return text.select("c_custkey", *[handlers.handle(F.col(c), k, c).alias(c) for c, k in kinds.items()])


_SPELL = ("1", "t", "T", "TRUE", "true", "True", "0", "f", "F", "FALSE", "false", "False", "yes", "tRuE", "", " true")


@query("SELECT o_orderkey, s, CASE WHEN s IN ('1', 't', 'T', 'TRUE', 'true', 'True') THEN true WHEN s IN ('0', 'f', 'F', 'FALSE', 'false', 'False') THEN false END AS b FROM (SELECT o_orderkey, [" + ", ".join(f"'{s}'" for s in _SPELL) + f"][o_orderkey % {len(_SPELL)} + 1] AS s FROM orders)")
def parse_bool(spark: SparkSession, sf: str) -> DataFrame:
    s = F.element_at(F.array(*map(F.lit, _SPELL)), (F.col("o_orderkey") % len(_SPELL) + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", s.alias("s")).withColumn("b", handlers.parse_boolean(F.col("s")))


@query("SELECT o_orderkey, s, CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') THEN try_cast(s AS TINYINT) END AS i8, CASE WHEN regexp_full_match(s, '[0-9]+') AND try_cast(s AS HUGEINT) BETWEEN 0 AND 65535 THEN try_cast(s AS INTEGER) END AS u16 FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '-' WHEN 2 THEN '+' ELSE 'x' END || (o_orderkey * 37)::VARCHAR AS s FROM orders)")
def parse_int(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = F.concat(F.when(k % 4 == 0, "").when(k % 4 == 1, "-").when(k % 4 == 2, "+").otherwise("x"), (k * 37).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", "s", handlers.parse_integer(F.col("s"), 8).alias("i8"), handlers.parse_integer(F.col("s"), 16, False).alias("u16"))


@query("SELECT event_id, json_valid(CASE WHEN event_id % 3 = 0 THEN props || '}' ELSE props END) AS ok FROM events")
def json_valid(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", handlers.is_json(text).alias("ok"))


_SUFFIX = ("", "KB", "KiB", "MB", "MiB", "GB", "GiB", "B", "kb")


@query("SELECT p_partkey, s, CASE u WHEN '' THEN 1 WHEN 'KB' THEN 1024 WHEN 'KiB' THEN 1000 WHEN 'MB' THEN 1048576 WHEN 'MiB' THEN 1000000 WHEN 'GB' THEN 1073741824 WHEN 'GiB' THEN 1000000000 END::BIGINT * p_size AS n FROM (SELECT p_partkey, p_size, [" + ", ".join(f"'{s}'" for s in _SUFFIX) + f"][p_partkey % {len(_SUFFIX)} + 1] AS u, p_size::VARCHAR || u AS s FROM part)")
def human_bytes(spark: SparkSession, sf: str) -> DataFrame:
    s = F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, _SUFFIX)), (F.col("p_partkey") % len(_SUFFIX) + 1).cast("int")))
    return table(spark, sf, "part").select("p_partkey", s.alias("s")).withColumn("n", handlers.size_to_bytes(F.col("s")))


# files and splitting

@query("SELECT part, count(*) AS num_rows, sum(b)::BIGINT AS bytes FROM (SELECT b, (sum(b) OVER (ORDER BY o_orderkey) - b)::BIGINT // 100000 + 1 AS part FROM (SELECT o_orderkey, 8 + 8 + strlen(o_orderstatus) + 8 + 8 + strlen(o_orderpriority) AS b FROM orders)) GROUP BY part")
def split_table(spark: SparkSession, sf: str) -> DataFrame:
    from lamella.sources.split import row_bytes

    orders = table(spark, sf, "orders")
    parts = split_parts(orders.withColumn("b", row_bytes(orders)), ["o_orderkey"], 100_000, F.col("b"))
    return parts.groupBy("part").agg(F.count("*").alias("num_rows"), F.sum("b").alias("bytes"))


#: The files whose footers the SQL reads: those of the scale at which queries and SQL are compared.
_FILE = "'/root/testdata/sf0.01/lineitem.parquet'"


@query(f"SELECT num_rows, num_row_groups::INTEGER AS num_row_groups FROM parquet_file_metadata({_FILE})")
def footers(spark: SparkSession, sf: str) -> DataFrame:
    return footer.footer(spark, f"{sf}/lineitem.parquet").select("num_rows", "num_row_groups")


@query(f"SELECT row_group_id::INTEGER AS row_group, any_value(row_group_num_rows) AS num_rows, sum(total_compressed_size)::BIGINT AS total_compressed_size FROM parquet_metadata({_FILE}) GROUP BY ALL")
def footer_row_groups(spark: SparkSession, sf: str) -> DataFrame:
    return footer.row_groups(spark, f"{sf}/lineitem.parquet").select("row_group", "num_rows", "total_compressed_size")


@query(f"SELECT row_group_id::INTEGER AS row_group, column_id::INTEGER AS \"column\", path_in_schema AS path, compression AS codec, num_values, stats_null_count AS null_count, total_compressed_size AS compressed_size, total_uncompressed_size AS uncompressed_size FROM parquet_metadata({_FILE})")
def footer_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return footer.chunks(spark, f"{sf}/lineitem.parquet").select("row_group", "column", "path", "codec", "num_values", "null_count", "compressed_size", "uncompressed_size")


# lists, maps and pairs


@query("SELECT o_custkey, key, max_by(value, o_orderkey) AS value FROM (SELECT o_custkey, o_orderpriority AS key, o_totalprice AS value, o_orderkey FROM orders) GROUP BY o_custkey, key")
def map_build(spark: SparkSession, sf: str) -> DataFrame:
    grouped = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_totalprice"))).alias("x"))
    pairs = F.transform("x", lambda e: F.struct(e["o_orderpriority"].alias("key"), e["o_totalprice"].alias("value")))
    return grouped.select("o_custkey", F.explode(lists.last_wins(pairs)))


@query("SELECT p_partkey, p_name AS a, NULL::VARCHAR AS b FROM part")
def map_lookup(spark: SparkSession, sf: str) -> DataFrame:
    m = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", m.alias("m")).select("p_partkey", F.col("m")["name"].alias("a"), F.col("m")["none"].alias("b"))


@query("SELECT c_custkey, key, value FROM customer, LATERAL (VALUES ('a', c_name), ('b', 'own'), ('c', c_mktsegment)) u(key, value)")
def kv_merge(spark: SparkSession, sf: str) -> DataFrame:
    everywhere = F.create_map(F.lit("a"), F.col("c_name"), F.lit("b"), F.lit("all"))
    own = F.create_map(F.lit("b"), F.lit("own"), F.lit("c"), F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", F.explode(lists.merge_pairs(everywhere, own)))


@query("SELECT o_custkey, len(list(o_orderkey))::INTEGER AS n, list_min(list(o_orderkey)) AS lo, list_max(list(o_orderkey)) AS hi FROM orders GROUP BY o_custkey")
def list_build(spark: SparkSession, sf: str) -> DataFrame:
    grouped = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("x"))
    return grouped.select("o_custkey", F.size("x").alias("n"), F.element_at("x", 1).alias("lo"), F.element_at("x", -1).alias("hi"))
