"""Checksums and hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def crc32(c: Column) -> Column:
    """Of the bytes of a binary or string."""
    return F.crc32(c.cast("binary"))


def fnv1(data: bytes, h: int = 0xCBF29CE484222325) -> int:
    """64-bit FNV-1, as a signed number; h: the hash of what comes before."""
    for b in data:
        h = (h * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF) ^ b
    return h - (1 << 64) if h >> 63 else h


#: Places of values that are multiplied in one block, and the values from which numpy does it.
_BLOCK, _FEW = 64, 16


def fnv1_all(raw: list[bytes | None]) -> list[int | None]:
    """fnv1 of many values: one multiplication for each place, over all values that reach it; the few longest are finished
    one by one."""
    sizes = np.array([len(r) if r is not None else 0 for r in raw])
    order = np.argsort(-sizes, kind="stable")
    ordered, acc, at = sizes[order], np.full(len(raw), 0xCBF29CE484222325, np.uint64), 0
    with np.errstate(over="ignore"):
        while (live := int(np.searchsorted(-ordered, -at, side="left"))) >= _FEW:
            block = np.zeros((live, _BLOCK), np.uint8)
            for k in range(live):
                part = np.frombuffer(raw[order[k]], np.uint8)[at : at + _BLOCK]
                block[k, : len(part)] = part
            for p in range(min(_BLOCK, int(ordered[0]) - at)):
                n = int(np.searchsorted(-ordered, -(at + p), side="left"))
                acc[:n] = (acc[:n] * np.uint64(0x100000001B3)) ^ block[:n, p]
            at += _BLOCK
    for k in range(live):
        acc[k] = fnv1(raw[order[k]][at:], int(acc[k])) & 0xFFFFFFFFFFFFFFFF
    out = np.empty(len(raw), np.uint64)
    out[order] = acc
    return [None if r is None else int(v) for r, v in zip(raw, out.view(np.int64))]


@F.pandas_udf(LongType())
def fnv1_64(values: pd.Series) -> pd.Series:
    """64-bit FNV-1 of strings or bytes."""
    return pd.Series(fnv1_all([None if v is None else v.encode() if isinstance(v, str) else bytes(v) for v in values]), dtype="Int64")


def key_hash(*columns: Column) -> Column:
    """Where any good hash will do: on the JVM."""
    return F.xxhash64(*columns)
