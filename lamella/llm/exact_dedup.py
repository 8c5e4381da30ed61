"""Exact deduplication by skew-safe combining.

Texts are equal when identical after lower-casing A-Z. Three stages find the row that stays, each comparing
whole texts, however long, and not just digests: (1) every batch of a task is deduplicated where it lies; (2) its winners
meet by digest and a salt, so that a text that a third of all rows share reaches many tasks; (3) the winners of the
salts, at most one a salt, meet by digest. The rows then learn their group's result, one record for each batch and text
instead of one for each row, by the identity of the group: its digests and size, after it was counted that no two texts
have the same ones (if any had, by the text itself). The largest groups are sent to every task, so their rows needn't
come together for that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import is_scan, pin_splits, record_batch, slices, stored, utf8, view

SALTS = 16
#: Groups of more rows than HOT are sent to every task, at most so many, the largest: no other group has more than HOT
#: rows, or a HOT_GROUPS-th of all.
HOT, HOT_GROUPS = 1 << 20, 1 << 17

#: A winner is one number: its id (null is the least) and, where rows repeat an id, the first place.
_PLACES = 1 << 61
_LEAST = -(1 << 63) - 1

_KEY = [("digest", pa.binary()), ("check", pa.int64()), ("size", pa.int64())]
KEY = [c for c, _ in _KEY]
_WINNERS = pa.schema([*_KEY, ("content", pa.binary()), ("win_id", pa.int64()), ("win", pa.decimal128(38, 0)), ("n", pa.int64())])
_WINNERS_DDL = "digest binary, check long, size long, content binary, win_id long, win decimal(38,0), n long"
_MEMBERS = pa.schema([*_KEY, ("content", pa.binary()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64()))])


def digests(text: bytes) -> tuple[bytes, int]:
    return hashlib.sha256(text).digest(), xxhash.xxh3_64_intdigest(text) - (1 << 63)


def winner(i: int | None, row: int) -> int:
    return ((_LEAST if i is None else i) - _LEAST) * _PLACES + _PLACES - 1 - row


def _local(members: bool, contents: bool, of: Callable[[bytes], tuple[bytes, int]]):
    """One row for each text of a batch: its winner, or its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            groups: dict[bytes, list[tuple[int | None, int]]] = {}
            for i, r, text in zip(batch["id"].to_pylist(), batch["row"].to_pylist(), utf8(batch["text"])):
                groups.setdefault(text.lower(), []).append((i, r))  # bytes: A-Z only; a dict compares whole keys
            digest, check = zip(*map(of, groups)) if groups else ((), ())
            columns: dict[str, object] = {"digest": digest, "check": check, "size": [len(t) for t in groups], "content": list(groups) if contents else [None] * len(groups)}
            if members:
                yield record_batch(_MEMBERS, columns | {"ids": [[i for i, _ in m] for m in groups.values()], "rows": [[r for _, r in m] for m in groups.values()]})
            else:
                best = [max(((winner(i, r), i) for i, r in m), key=lambda x: x[0]) for m in groups.values()]
                yield record_batch(_WINNERS, columns | {"win_id": [i for _, i in best], "win": [Decimal(w) for w, _ in best], "n": [len(m) for m in groups.values()]})

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and row, a number that is the same each time a scan of files is read; other inputs are written first."""
    pin_splits(docs.sparkSession)
    rows = view(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), "text")
    return (rows if is_scan(docs) else stored(rows, "rows")).withColumn("row", F.monotonically_increasing_id())


def merged(local: DataFrame, salts: int = SALTS) -> DataFrame:
    """digest, check, size, content, keep_id, win and group_size of local winners: by digest and salt first, then by digest, each time for equal content only."""
    key = [*KEY, "content"]
    salt = F.pmod(F.xxhash64("win_id"), F.lit(salts)).alias("salt")
    salted = local.groupBy(*key, salt).agg(F.max("win_id").alias("win_id"), F.max("win").alias("win"), F.sum("n").alias("n"))
    return salted.groupBy(*key).agg(F.max("win_id").alias("keep_id"), F.max("win").alias("win"), F.sum("n").alias("group_size"))


def _results(groups: DataFrame) -> list:
    place = F.lit(_PLACES - 1) - (F.col("win") % F.lit(Decimal(_PLACES))).cast("long")
    return ["keep_id", place.alias("keep_row"), "group_size"]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct text of two rows or more: digest, check, size, content, keep_id, group_size."""
    local = _rows(docs, id_col, text_col).mapInArrow(_local(False, True, digests), _WINNERS_DDL)
    return merged(local, salts).filter("group_size > 1").drop("win")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, of: Callable[[bytes], tuple[bytes, int]] = digests, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest id stays. Null text counts as empty, and empty texts are equal to one another.
    A null id loses to any other. Of rows that repeat the same id and text one stays (the first in the table's
    order) and the others are dropped, so that keep_id equals their own id. An empty table gives no rows.
    """
    rows = _rows(docs, id_col, text_col)
    all_groups = merged(rows.mapInArrow(_local(False, True, of), _WINNERS_DDL), salts)
    counted = all_groups.groupBy(*KEY).agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("win").alias("win"), F.sum("group_size").alias("group_size"))
    groups = stored(counted.filter("group_size > 1"), "groups")
    by, contents = KEY, False
    if groups.filter("texts > 1").limit(1).count():
        by, contents = [*KEY, "content"], True
        groups = stored(all_groups.filter("group_size > 1"), "groups")
    groups = groups.select(*by, *_results(groups))
    members = rows.mapInArrow(_local(True, contents, of), "digest binary, check long, size long, content binary, ids array<long>, rows array<long>")
    if groups.filter(F.col("group_size") > hot).limit(1).count():
        largest = groups.filter(F.col("group_size") > hot).orderBy(F.desc("group_size")).limit(HOT_GROUPS)
        sent = largest.select(*by, *[F.col(c).alias(f"hot_{c}") for c in ("keep_id", "keep_row", "group_size")])
        # rows of the largest groups have theirs; in the join of the others they are spread by their own places
        members = members.join(F.broadcast(sent), by, "left").withColumn("apart", F.when(F.col("hot_group_size").isNotNull(), F.element_at("rows", 1)).otherwise(F.lit(-1)))
        joined = members.join(groups.withColumn("apart", F.lit(-1).cast("long")), [*by, "apart"], "left")
        joined = joined.withColumns({c: F.when(F.col("hot_group_size").isNotNull(), F.col(f"hot_{c}")).otherwise(F.col(c)) for c in ("keep_id", "keep_row", "group_size")})
    else:
        joined = members.join(groups, by, "left")
    each = joined.select("digest", "keep_id", "keep_row", "group_size", F.explode(F.arrays_zip("ids", "rows")).alias("m"))
    alone, doc_id = F.col("group_size").isNull(), F.col("m.ids")
    return each.select(
        doc_id.alias("doc_id"),
        F.when(alone, doc_id).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("m.rows") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
"""
