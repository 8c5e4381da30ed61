"""Packing by concatenating and cutting.

First pass: every split of the input is tokenised, once, into a scratch table in which each document knows its
offset within its split; the splits' token totals are summed. Their prefix sums, one number a split, are the second
pass's start: a document's global offset is its split's plus its own, so that fixed windows of the one long
sequence of tokens can be cut where the documents lie, without a shuffle of tokens. A window that crosses from one
split to the next is delivered in parts, its boundary records, which alone are brought together. Texts of any length
are tokenised whole, and cut into as many windows as they need.

The order is that of the files and of the rows in them (so an input written in a certain order is packed in it);
an input that isn't a plain scan is written to files first, in the order of its partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.common import located, place_key, record_batch, slices, stored
from lamella.llm.tokens import Encoder, default_vocabulary

LENGTH = 2048
END_ID = 1
#: Offsets of so many splits are sent to every task; for more, they are joined.
BROADCAST_SPLITS = 1 << 21

_DOCS = pa.schema([("doc_id", pa.int64()), ("split", pa.string()), ("block", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
_SEQUENCES = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and the split of the row: its file and the place in it."""
    rows = located(docs, [docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text")], "split", "block")
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def tokenised(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The scratch table of the first pass: doc_id, split, block, start (in the split), n and ids (16 bits each, the end id last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, at, here = Encoder.at(vocabulary), np.array([end_id], "<u2"), 0, None
        for batch in slices(batches, 512):
            ids, starts = [], []
            for text, *place in zip(batch["text"].to_pylist(), batch["split"].to_pylist(), batch["block"].to_pylist()):
                if place != here:
                    at, here = 0, place
                ids.append(np.concatenate([encoder.encode(text or ""), end]).tobytes())
                starts.append(at)
                at += len(ids[-1]) // 2
            yield record_batch(_DOCS, {"doc_id": batch["doc_id"], "split": batch["split"], "block": batch["block"], "start": starts, "n": [len(x) // 2 for x in ids], "ids": ids})

    if not 0 <= end_id < 1 << 16:
        raise ValueError("end_id takes 16 bits")
    return stored(placed(docs, id_col, text_col).mapInArrow(run, "doc_id long, split string, block long, start long, n long, ids binary"), "tokens")


def offset_documents(tokens: DataFrame) -> DataFrame:
    """tokens with base, the global offset of the document's split."""
    totals = tokens.groupBy("split", "block").agg(F.sum("n").alias("total"))
    # a row for each input split: under a million of them for 100 TB
    order = Window.orderBy(F.length("split"), "split", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(totals.select(*place_key("split", "block"), F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base")), "offsets")
    if bases.count() <= BROADCAST_SPLITS:
        bases = F.broadcast(bases)
    return tokens.select("*", *place_key("split", "block")).join(bases, ["key", "check"]).drop("key", "check")


def pieces(documents: DataFrame, length: int) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for i, at, n, ids in zip(batch["doc_id"].to_pylist(), (batch["base"].to_numpy() + batch["start"].to_numpy()).tolist(), batch["n"].to_pylist(), batch["ids"].to_pylist()):
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                a = 0
                while a < n:
                    s, o = divmod(at + a, length)
                    b = min(n, a + length - o)
                    out.append((i, a, b - a, zlib.crc32(wide[a:b]), n, s, o))
                    a = b
            yield record_batch(_PIECES, dict(zip(_PIECES.names, map(list, zip(*out)))) if out else {c: [] for c in _PIECES.names})

    return documents.select("doc_id", "base", "start", "n", "ids").mapInArrow(run, ", ".join(f"{c} long" for c in _PIECES.names))


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents in sequences of length tokens, of which only the last is padded.

    A document is its ids and end_id; null text counts as empty and so has the one id. Ids may be null or repeated:
    each row is a document of its own. An empty table gives no rows.
    """
    return pieces(offset_documents(tokenised(docs, vocabulary or default_vocabulary(), end_id, id_col, text_col)), length)


def sequences(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, end_id: int = END_ID, pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sequence: sequence_id, n_tokens (without padding) and input_ids, an array of length ids. The cases are those of pack."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows, or the parts of them that lie here."""
        held: list[np.ndarray] = []
        first = after = 0
        for batch in slices(batches):
            out: list[tuple[int, int, bytes]] = []

            def flush(last: bool) -> None:
                nonlocal held, first
                run = np.concatenate(held) if held else np.zeros(0, "<u2")
                a = 0
                while a < len(run):
                    s, o = divmod(first + a, length)
                    b = a + length - o
                    if b > len(run) and not last:
                        break
                    out.append((s, o, run[a:b].tobytes()))
                    a = b
                held, first = [run[a:]], first + a

            for at, ids in zip((batch["base"].to_numpy() + batch["start"].to_numpy()).tolist(), batch["ids"].to_pylist()):
                if at != after:
                    flush(True)
                    held, first = [], at
                held.append(np.frombuffer(ids, "<u2"))
                after = at + len(held[-1])
            flush(False)
            if out:
                yield record_batch(_SEQUENCES, dict(zip(_SEQUENCES.names, map(list, zip(*out)))))
        if held and len(held[0]):
            run = held[0]
            s, o = divmod(first, length)
            yield record_batch(_SEQUENCES, {"sequence_id": [s], "offset": [o], "ids": [run.tobytes()]})

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [np.frombuffer(b"".join(x), "<u2").astype(np.int32) for x in batch["parts"].to_pylist()]
            full = [np.concatenate([x, np.full(length - len(x), pad_id, np.int32)]) for x in rows]
            yield pa.RecordBatch.from_arrays([batch["sequence_id"], pa.array([len(x) for x in rows], pa.int64()), pa.array(full, pa.list_(pa.int32()))], names=["sequence_id", "n_tokens", "input_ids"])

    documents = offset_documents(tokenised(docs, vocabulary or default_vocabulary(), end_id, id_col, text_col))
    parts = stored(documents.select("base", "start", "ids").mapInArrow(cut, "sequence_id long, offset long, ids binary"), "windows")
    whole = F.octet_length("ids") == 2 * length
    one = parts.filter(whole).select("sequence_id", F.array("ids").alias("parts"))
    crossing = parts.filter(~whole).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return one.unionByName(crossing.select("sequence_id", F.col("x.ids").alias("parts"))).mapInArrow(arrays, "sequence_id long, n_tokens long, input_ids array<int>")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
