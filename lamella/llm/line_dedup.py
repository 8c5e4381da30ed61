"""Line deduplication over a range-partitioned list of line hashes.

Each document emits one record for each different line of its own: a 128-bit hash of the line's key, its id and
the line's positions. The records are partitioned by ranges of (hash, id) and sorted by (hash, id, position); a
line that very many documents hold is thereby spread over as many partitions as it needs. A task streams its
partition and drops every record whose id isn't the first of its hash. What can't be known inside a partition is
whether its first hash began in an earlier one: each partition therefore states its first and its last hash with
the first id of each, and those two records a partition are stitched together. The result is a compressed bitmap
of kept lines for each document that loses some; texts, whole and of any length, move only where the bitmaps are applied.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import discard, parallelism, record_batch, slices, stored, utf8, view

MIN_CHARS = 10
#: A null id comes after every other one.
LAST = (1 << 63) - 1

_LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("fp", pa.int64()), ("n_lines", pa.int32()), ("pos", pa.list_(pa.int32()))])
_LINES_DDL = "h1 long, h2 long, id long, fp long, n_lines int, pos array<int>"
_OUT = pa.schema([*_LINES, ("edge", pa.int8())])


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # of bytes: [\x20\x09-\x0D] and A-Z


def chars(b: bytes) -> int:
    return len(b) if b.isascii() else len(b.decode("utf-8", "replace"))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out: dict[str, list] = {f.name: [] for f in _LINES}
        for i, fp, text in zip(batch["id"].to_pylist(), batch["fp"].to_pylist(), utf8(batch["text"])):
            places: dict[bytes, list[int]] = {}
            lines = text.split(b"\n")
            for p, line in enumerate(lines):
                key = line_key(line)
                if len(key) >= MIN_CHARS and chars(key) >= MIN_CHARS:
                    places.setdefault(key, []).append(p)
            for key, pos in places.items():
                h = xxhash.xxh3_128_intdigest(key)
                out["h1"].append((h >> 64) - (1 << 63))
                out["h2"].append((h & (1 << 64) - 1) - (1 << 63))
                out["pos"].append(pos)
            out["id"] += [i] * len(places)
            out["fp"] += [fp] * len(places)
            out["n_lines"] += [len(lines)] * len(places)
        yield record_batch(_LINES, out)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a sorted partition: the records that go (edge 0), and those of the first id of its first hash (1) and of its last (2)."""
    h1 = h2 = first = None
    head, tail = True, None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, i = (batch[c].to_numpy(zero_copy_only=False) for c in ("h1", "h2", "id"))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        new[0] = (a[0], b[0]) != (h1, h2)
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - (1 if new[0] else 0)
        firsts = i[starts] if new[0] else np.concatenate([[first], i[starts]])
        drop = i > firsts[group]
        edge = np.where(drop, 0, -1).astype(np.int8)
        head = head and not (new[0] and h1 is not None)
        if head:  # the first hash may go on over several batches
            at = group == 0
            edge[at & ~drop] = 1
            head = len(firsts) == 1
        take = np.flatnonzero(edge >= 0)
        if len(take):
            yield pa.RecordBatch.from_arrays([*[batch[f.name].take(pa.array(take)).cast(f.type) for f in _LINES], pa.array(edge[take])], schema=_OUT)
        h1, h2, first = a[-1], b[-1], firsts[-1]
        tail = batch.slice(batch.num_rows - 1, 1)
    if tail is not None:
        row = {f.name: tail[f.name].cast(f.type) for f in _LINES}
        yield record_batch(_OUT, row | {"id": [int(first)], "edge": [2]})


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per document that loses lines: id, fp (xxhash64 of its text), n_lines, n_dropped, keep (zlib of the
    packed bits of its lines, first line first). A null id stands as 2^63-1."""
    rows = view(docs, id=id_col, text=text_col).select(F.coalesce(F.col("id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64("text").alias("fp"), "text")
    lines = stored(rows.mapInArrow(_lines, _LINES_DDL), "lines")  # the ranges' bounds are drawn from it as well
    ranged = lines.repartitionByRange(partitions or parallelism(docs), "h1", "h2", "id").sortWithinPartitions("h1", "h2", "id", "pos")
    found = stored(ranged.mapInArrow(_stream, _LINES_DDL + ", edge byte"), "dropped")
    discard(lines)
    # at most two ids of two hashes a partition are at its edges
    edges = found.filter("edge > 0").groupBy("h1", "h2").agg(F.min("id").alias("first"))
    late = found.filter("edge = 1").join(edges, ["h1", "h2"]).filter("id > first").drop("first")
    gone = found.filter("edge = 0").select("id", "fp", "n_lines", "pos").unionByName(late.select("id", "fp", "n_lines", "pos"))
    each = gone.distinct().groupBy("id", "fp", "n_lines").agg(F.flatten(F.collect_list("pos")).alias("pos"))
    return each.mapInArrow(_bits, "id long, fp long, n_lines int, n_dropped int, keep binary")


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("n_lines", pa.int32()), ("n_dropped", pa.int32()), ("keep", pa.binary())])
    for batch in batches:
        dropped, keep = [], []
        for n, pos in zip(batch["n_lines"].to_pylist(), batch["pos"].to_pylist()):
            bits = np.ones(n, bool)
            bits[pos] = False
            dropped.append(len(pos))
            keep.append(zlib.compress(np.packbits(bits).tobytes()))
        yield record_batch(schema, {"id": batch["id"], "fp": batch["fp"], "n_lines": batch["n_lines"], "n_dropped": dropped, "keep": keep})


def kept_text(text: bytes, keep: bytes | None) -> tuple[bytes, int, int]:
    """The text of the kept lines, and the numbers of lines and of dropped ones."""
    lines = text.split(b"\n")
    if keep is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    left = [x for x, k in zip(lines, bits) if k]
    return b"\n".join(left), len(lines), len(lines) - len(left)


def _with_bitmaps(docs: DataFrame, id_col: str, text_col: str, partitions: int | None) -> DataFrame:
    """docs with the bitmap of each row, or null, as the last column."""
    mark = "__"
    while any(c.startswith(mark) for c in docs.columns):
        mark = f"_{mark}"
    maps = line_bitmaps(docs, id_col, text_col, partitions).select(F.col("id").alias(f"{mark}id"), F.col("fp").alias(f"{mark}fp"), F.col("keep").alias(f"{mark}keep"))
    on = (F.coalesce(docs[f"`{id_col}`"].cast("long"), F.lit(LAST)) == maps[f"{mark}id"]) & (F.xxhash64(docs[f"`{text_col}`"]) == maps[f"{mark}fp"])
    return docs.join(maps, on, "left").drop(f"{mark}id", f"{mark}fp")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, min_words: int = 0) -> DataFrame:
    """docs with the lines that an earlier document holds taken out of its text; every other column stays, and so does
    every row, unless it lost lines and has fewer than min_words words left.

    A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. Keys of 10 code points or
    more lose all their lines but those of the smallest id. Rows with the same id are one document here: none of
    them loses a line to the other. A null id comes last. Null text has one empty line and stays null; a text that
    loses all its lines becomes empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index(text_col)
            old, keep = batch.column(at), batch.column(batch.num_columns - 1).to_pylist()
            texts = [t if k is None else kept_text(t.encode(), k)[0].decode() for t, k in zip(old.to_pylist(), keep)]
            columns = [pa.array(texts, old.type) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            out = pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])
            stays = [k is None or len(t.encode().split()) >= min_words for t, k in zip(texts, keep)] if min_words else [True]
            yield out if all(stays) else out.filter(pa.array(stays))

    return _with_bitmaps(docs, id_col, text_col, partitions).mapInArrow(run, docs.schema)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept_sha256. The cases are those of line_dedup; null text counts as empty here."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            done = [kept_text(t, k) for t, k in zip(utf8(batch["text"]), batch.column(2).to_pylist())]
            yield record_batch(schema, {"doc_id": batch["doc_id"], "n_lines": [n for _, n, _ in done], "n_dropped": [d for _, _, d in done], "kept_sha256": [hashlib.sha256(t).hexdigest() for t, _, _ in done]})

    rows = view(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return _with_bitmaps(rows, "doc_id", "text", partitions).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
