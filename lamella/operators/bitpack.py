"""Encodings as bytes: bit packing, runs and bit-packed groups, deltas, lengths and front coding, over numpy arrays.

Each encoder takes all values of a page and returns its bytes; each decoder takes those and the number of values.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

BLOCK, MINIBLOCKS = 128, 4


def pack(values: np.ndarray, width: int) -> bytes:
    """Groups of eight values of a width from 0 to 64 bits, the lowest bit first; the last group is filled with zeros."""
    if not width:
        return b""
    v = np.zeros(-(-len(values) // 8) * 8, np.uint64)
    v[: len(values)] = np.asarray(values).astype(np.uint64, copy=False)
    bits = (v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * width).reshape(n, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def unzigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def hybrid_encode(values: np.ndarray, width: int, least_run: int = 8) -> bytes:
    """Runs of least_run or more equal values as runs, what lies between in bit-packed groups of eight."""
    out, v = bytearray(), np.asarray(values)
    starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, int)
    ends = np.r_[starts[1:], len(v)]
    at = 0

    def packed(upto: int) -> None:
        nonlocal at
        if upto > at:
            out.extend(varint(-(-(upto - at) // 8) << 1 | 1) + pack(v[at:upto], width))
            at = upto

    for a, b in zip(starts.tolist(), ends.tolist()):
        a = max(a, at)
        begin = at + -(-(a - at) // 8) * 8  # groups before a run are whole
        if b - begin >= least_run:
            packed(begin)
            out += varint((b - begin) << 1) + int(v[begin]).to_bytes(-(-width // 8), "little")
            at = b
    packed(len(v))
    return bytes(out)


def hybrid_decode(data: bytes, width: int, n: int) -> np.ndarray:
    out, at, have = [], 0, 0
    while have < n:
        head, at = read_varint(data, at)
        if head & 1:
            count = (head >> 1) * 8
            size = (head >> 1) * width
            out.append(unpack(data[at : at + size].ljust(size, b"\0"), width, count)[: n - have])
        else:
            count, size = head >> 1, -(-width // 8)
            out.append(np.full(min(count, n - have), int.from_bytes(data[at : at + size], "little"), np.uint64))
        at += size
        have += count
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def levels_encode(levels: np.ndarray, highest: int, sized: bool = True) -> bytes:
    """Repetition or definition levels: sized (pages of version 1) behind their length in 32 bits, else bare. Where the highest level is 0 there are none."""
    if not highest:
        return b""
    data = hybrid_encode(levels, highest.bit_length())
    return len(data).to_bytes(4, "little") + data if sized else data


def levels_decode(data: bytes, highest: int, n: int, sized: bool = True) -> np.ndarray:
    return hybrid_decode(data[4:] if sized else data, highest.bit_length(), n) if highest else np.zeros(n, np.uint64)


def delta_encode(values: np.ndarray, bits: int = 64) -> bytes:
    """Blocks of 128 deltas in four parts, each with a width of its own; arithmetic wraps around at 32 or 64 bits."""
    kind, wide = (np.int32, np.uint32) if bits == 32 else (np.int64, np.uint64)
    v = np.asarray(values).astype(kind)
    out = bytearray(varint(BLOCK) + varint(MINIBLOCKS) + varint(len(v)) + varint(zigzag(int(v[0]) if len(v) else 0)))
    with np.errstate(over="ignore"):
        deltas = v[1:] - v[:-1]
        part = BLOCK // MINIBLOCKS
        for a in range(0, len(deltas), BLOCK):
            block = deltas[a : a + BLOCK]
            low = block.min()
            above = (block - low).view(wide)
            parts = [above[k : k + part] for k in range(0, BLOCK, part)]
            widths = [int(p.max()).bit_length() if len(p) else 0 for p in parts]
            out += varint(zigzag(int(low))) + bytes(widths)
            for p, w in zip(parts, widths):
                if len(p):
                    out += pack(np.r_[p, np.zeros(part - len(p), wide)], w)
    return bytes(out)


def delta_decode(data: bytes, bits: int = 64) -> tuple[np.ndarray, int]:
    """The values, and where the bytes end."""
    kind = np.int32 if bits == 32 else np.int64
    block, at = read_varint(data, 0)
    count, at = read_varint(data, at)
    n, at = read_varint(data, at)
    first, at = read_varint(data, at)
    deltas, left, part = [np.array([unzigzag(first)], np.int64)] if n else [], n - 1, block // count
    while left > 0:
        low, at = read_varint(data, at)
        widths, at = data[at : at + count], at + count
        for w in widths:
            if left <= 0:
                break
            size = part * w // 8
            with np.errstate(over="ignore"):
                deltas.append((unpack(data[at : at + size], w, part)[: min(part, left)].view(np.int64) + np.int64(unzigzag(low))))
            at += size
            left -= part
    with np.errstate(over="ignore"):
        return (np.cumsum(np.concatenate(deltas), dtype=np.int64).astype(kind) if deltas else np.zeros(0, kind)), at


def lengths_encode(values: list[bytes]) -> bytes:
    return delta_encode(np.array([len(v) for v in values], np.int64), 32) + b"".join(values)


def lengths_decode(data: bytes) -> list[bytes]:
    sizes, at = delta_decode(data, 32)
    ends = at + np.cumsum(sizes.astype(np.int64))
    return [data[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist())]


def prefix_length(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y))


def front_encode(values: list[bytes]) -> bytes:
    prefixes = [prefix_length(a, b) for a, b in zip([b"", *values], values)]
    return delta_encode(np.array(prefixes, np.int64), 32) + lengths_encode([v[p:] for v, p in zip(values, prefixes)])


def front_decode(data: bytes) -> list[bytes]:
    prefixes, at = delta_decode(data, 32)
    out, last = [], b""
    for p, s in zip(prefixes.tolist(), lengths_decode(data[at:])):
        last = last[:p] + s
        out.append(last)
    return out


def plain_encode(values: list, kind: str) -> bytes:
    """Values of a physical type, one after another."""
    numbers = {"int32": "<i4", "int64": "<i8", "float": "<f4", "double": "<f8"}
    if kind in numbers:
        return np.array(values, numbers[kind]).tobytes()
    if kind == "boolean":
        return np.packbits(np.array(values, bool), bitorder="little").tobytes()
    if kind == "binary":
        return b"".join(len(v).to_bytes(4, "little") + v for v in values)
    return b"".join(values)


def plain_decode(data: bytes, kind: str, n: int, length: int = 12) -> list:
    numbers = {"int32": "<i4", "int64": "<i8", "float": "<f4", "double": "<f8"}
    if kind in numbers:
        return np.frombuffer(data, numbers[kind], n).tolist()
    if kind == "boolean":
        return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n).astype(bool).tolist()
    if kind == "binary":
        out, at = [], 0
        for _ in range(n):
            size = int.from_bytes(data[at : at + 4], "little")
            out.append(data[at + 4 : at + 4 + size])
            at += 4 + size
        return out
    return [data[k * length : (k + 1) * length] for k in range(n)]


def _page(encode: Callable[[list], bytes]):  # noqa: ANN202
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else encode(list(x)))

    return run


#: Encodings that encode_pages takes: of an array of a page's values.
ENCODERS: dict[str, Callable[[list], bytes]] = {
    "DELTA_BINARY_PACKED": lambda x: delta_encode(np.array(x, np.int64)),
    "DELTA_LENGTH_BYTE_ARRAY": lambda x: lengths_encode([v.encode() if isinstance(v, str) else bytes(v) for v in x]),
    "DELTA_BYTE_ARRAY": lambda x: front_encode([v.encode() if isinstance(v, str) else bytes(v) for v in x]),
    "PLAIN_INT64": lambda x: plain_encode(x, "int64"),
    "PLAIN_BYTE_ARRAY": lambda x: plain_encode([v.encode() if isinstance(v, str) else bytes(v) for v in x], "binary"),
    "RLE_BOOLEAN": lambda x: hybrid_encode(np.array(x, np.uint64), 1),
    "RLE": lambda x: hybrid_encode(np.array(x, np.uint64), int(max(x, default=0)).bit_length()),
}


def encode_pages(df: DataFrame, value: str, order: list[str], encoding: str, page_rows: int = 4096) -> DataFrame:
    """page, num_values and data, the bytes of each page of a column in an order; nulls are left out."""
    from lamella.plans.numbering import numbered

    placed = numbered(df.filter(F.col(value).isNotNull()).select(*dict.fromkeys([*order, value])), order)
    pages = placed.groupBy(F.floor(F.col("position") / page_rows).cast("long").alias("page")).agg(F.sort_array(F.collect_list(F.struct("position", F.col(value).alias("v")))).alias("x"))
    encode = F.pandas_udf(_page(ENCODERS[encoding]), BinaryType())
    return pages.select("page", F.size("x").cast("long").alias("num_values"), encode(F.col("x.v")).alias("data"))
