"""Documents joined by the Jaccard similarity of their word n-grams, exactly, as a join in a metric space.

Two documents link when their sets of 3-word shingles share 70 % of their union. The join has these steps.

1. Screen. A partner of x lacks at most 30 % of x, so a document most of whose shingles occur in no other document has
   none. Shingles of half the hash space are counted by ranges of their hashes, as many as the input's size asks for, each
   task having combined its own documents' first, and each document learns how many of its own were found elsewhere. No text moves.
2. Classes. Documents that remain and have equal sets, by 128-bit digests, become one class, with a weight. Only one
   document of each class has its set written.
3. Regions. In one order of all shingles, the rarest first, linked sets share k of their first floor(0.3 n) + k. Sets that
   share SHARED there are in the same region, and what reaches over several such steps is too: one rare shingle that two
   sets have by chance doesn't join their regions, which would grow with the input. Pairs are counted for shingles of up
   to PAIRED sets; all sets of a more frequent one are in one region. A region is closed: no set needs to be copied into another.
4. Cells. A region is divided, in memory where it fits, by pivots into Voronoi cells, with the sets near a boundary
   replicated by the triangle inequality, again and again (regions.py). A region beyond REGION_SHINGLES is divided so
   by distributed steps first, one after another while they make it smaller; cells that no pivots divide are compared block by block.
5. Components of the links found.

Pivots alone, without step 3, can't divide a corpus: nearly all of its documents are at a distance of about 1 from
any pivot, so the windows of the triangle inequality would replicate every document into every cell.

Texts of any length are taken whole. Where many rows look up one key (of a hub, a component, a text with many copies),
common.looked_up keeps them apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.common import HOT, discard, is_scan, looked_up, parallelism, record_batch, slices, stored, utf8, view
from lamella.llm.regions import EPS, PERCENT, Region

N = 3
#: Documents of a chunk have numbers of 16 bits, the last of which stands for none of them.
NUMBER_BITS = 16
CHUNK_DOCS = NONE = (1 << NUMBER_BITS) - 1
CHUNK_SHINGLES = 1 << 20
#: Bytes of the input for each range of hashes. Ranges have at most 2^15 numbers, so that those of a chunk aren't empty.
RANGE_BYTES = 4 << 20
MIN_RANGE_BITS, MAX_RANGE_BITS = 4, 15
#: Of their floor(0.3 n) + SHARED rarest shingles linked sets share SHARED.
SHARED = 8
#: Sets of a shingle up to which its pairs are counted.
PAIRED = 64
#: What one task compares at a time: 32 MB of shingles.
REGION_SHINGLES = 4 << 20
#: Bins of small parts for each such amount.
BINS = 8
#: About so many pivots divide a region beyond that, at most MAX_PIVOTS, again and again, at most LEVELS times.
CELL_PIVOTS, MAX_PIVOTS, LEVELS = 32, 64, 8
#: A cell that has more than this of what was divided isn't divided again.
SHRINKS = 0.8
#: Rows a task up to which the keys of a semi join are held in memory.
HELD_ROWS = 1 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: bytes) -> np.ndarray:
    """The set of a text: 64-bit hashes of its distinct 3-word shingles, sorted."""
    words = text.lower().split()  # of bytes: A-Z, and [\x20\x09-\x0D]+
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < N:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    distinct = dict.fromkeys(words)
    number = dict(zip(distinct, map(xxhash.xxh3_64_intdigest, distinct)))
    h = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
    s = (h[:-2] * _M1) ^ (h[:-2] >> np.uint64(29))
    s = (s + h[1:-1]) * _M2
    s ^= s >> np.uint64(32)
    s = (s + h[2:]) * _M1
    s ^= s >> np.uint64(29)
    s *= _M2
    s ^= s >> np.uint64(32)
    return np.unique(s)


def spare(n: np.ndarray) -> np.ndarray:
    """How many shingles of a set of n a linked set may lack."""
    return (100 - PERCENT) * n // 100


def _pack(a: np.ndarray) -> bytes:
    """An array of integers, its bytes by significance, compressed."""
    return zstandard.ZstdCompressor(1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) if len(a) else b""


def _unpack(b: bytes, kind: str) -> np.ndarray:
    if not b:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _pack_sorted(a: np.ndarray) -> bytes:
    return _pack(np.diff(a, prepend=a.dtype.type(0)))


def _unpack_sorted(b: bytes, kind: str) -> np.ndarray:
    return np.cumsum(_unpack(b, kind), dtype=kind)


def _range_bits(size: int) -> int:
    """Of the numbers of ranges for an input of so many bytes."""
    return min(MAX_RANGE_BITS, max(MIN_RANGE_BITS, (max(1, size // RANGE_BYTES) - 1).bit_length()))


def _bytes(df: DataFrame, column: str) -> int:
    """About how many a column has: of a scan those of its files, otherwise they are summed."""
    if is_scan(df):
        return int(str(df.select(column)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


def _chunk_id(k: int) -> int:
    return (TaskContext.get().partitionId() << 20) + k


def _split(v: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Range, begin and end of the parts of v, sorted numbers of bits + 32 bits."""
    edges = np.searchsorted(v, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
    for r in range(1 << bits):
        if edges[r] < edges[r + 1]:
            yield r, int(edges[r]), int(edges[r + 1])


# 1. screen

_PIECES = pa.schema([("bin", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("ids", pa.list_(pa.int64())), ("fps", pa.list_(pa.int64())), ("counts", pa.binary())])
_PIECES_DDL = "bin long, chunk long, keys binary, docs binary, ids array<long>, fps array<long>, counts binary"
_SCREENED = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("alive", pa.bool_())])


def _pieces(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = k = 0

    def flush() -> pa.RecordBatch:
        chunk = _chunk_id(k)
        half = [s[: np.searchsorted(s, np.uint64(1 << 63))] for *_, s in held]
        counts = np.zeros((3, len(held)), np.int32)
        counts[0], counts[1] = [len(s) for *_, s in held], [len(s) for s in half]
        v = np.concatenate(half) >> np.uint64(31 - bits)
        v = (v << np.uint64(NUMBER_BITS)) | np.repeat(np.arange(len(held), dtype=np.uint64), counts[1])
        v.sort()
        docs, v = (v & np.uint64(NONE)).astype(np.int64), v >> np.uint64(NUMBER_BITS)
        new = np.r_[True, v[1:] != v[:-1]] if len(v) else np.zeros(0, bool)
        alone = new & np.r_[new[1:], True] if len(v) else new
        counts[2] = np.bincount(docs[~alone], minlength=len(held))
        docs = np.where(alone, docs, NONE)[new].astype(np.uint16)
        v = v[new]
        rows = [(r, chunk, _pack_sorted((v[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), _pack(docs[a:b]), None, None, None) for r, a, b in _split(v, bits)]
        rows.append((chunk % (1 << bits), chunk, None, None, [h[0] for h in held], [h[1] for h in held], counts.tobytes()))
        return record_batch(_PIECES, dict(zip(_PIECES.names, map(list, zip(*rows)))))

    for batch in slices(batches, 256):
        for i, fp, text in zip(batch["doc_id"].to_pylist(), batch["fp"].to_pylist(), utf8(batch["text"])):
            held.append((i, fp, shingles(text)))
            size += len(held[-1][2])
            if len(held) == CHUNK_DOCS or size >= CHUNK_SHINGLES:
                yield flush()
                held, size, k = [], 0, k + 1
    if held:
        yield flush()


def _found_elsewhere(table: pa.Table) -> pa.Table:
    """For a range: how many of each chunk's documents' shingles occur in other documents. The lists of documents pass through."""
    pieces = [(c, _unpack_sorted(k, "u4"), _unpack(d, "u2")) for c, k, d in zip(*(table[x].to_pylist() for x in ("chunk", "keys", "docs"))) if k is not None]
    out = [(c, None, i, f, n) for c, i, f, n in zip(*(table[x].to_pylist() for x in ("chunk", "ids", "fps", "counts"))) if n is not None]
    if pieces:
        ordered = np.sort(np.concatenate([k for _, k, _ in pieces]))
        several = ordered[1:][ordered[1:] == ordered[:-1]]
        several = several[np.r_[True, several[1:] != several[:-1]]] if len(several) else several
        for c, keys, docs in pieces:
            if len(several):
                at = np.searchsorted(several, keys)
                at[at == len(several)] = 0
                hit = docs[several[at] == keys]
                hit = hit[hit != NONE]
                if len(hit):
                    there, times = np.unique(hit, return_counts=True)
                    out.append((c, _pack(np.concatenate([there, times]).astype(np.uint32)), None, None, None))
    names = ["chunk", "found", "ids", "fps", "counts"]
    schema = pa.schema([("chunk", pa.int64()), ("found", pa.binary()), *[(f.name, f.type) for f in _PIECES if f.name in names[2:]]])
    return pa.Table.from_batches([record_batch(schema, dict(zip(names, map(list, zip(*out)))) if out else {n: [] for n in names})])


def _verdict(table: pa.Table) -> pa.Table:
    found, row = np.zeros(NONE, np.int64), None
    for f, ids, fps, counts in zip(*(table[x].to_pylist() for x in ("found", "ids", "fps", "counts"))):
        if f is not None:
            there, times = _unpack(f, "u4").reshape(2, -1)
            found[there] += times
        else:
            row = ids, fps, np.frombuffer(counts, np.int32).reshape(3, -1).astype(np.int64)
    ids, fps, (n, half, local) = row
    missing = half - local - found[: len(n)]
    return pa.Table.from_batches([record_batch(_SCREENED, {"doc_id": ids, "fp": fps, "n": n, "alive": (n > 0) & (missing <= spare(n))})])


def screen(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, fp, text): doc_id, fp, n (size of its set) and alive, false if it has no partner."""
    bits = _range_bits(_bytes(docs, "text"))
    pieces = docs.mapInArrow(partial(_pieces, bits), _PIECES_DDL)
    found = pieces.groupBy("bin").applyInArrow(_found_elsewhere, "chunk long, found binary, ids array<long>, fps array<long>, counts binary")
    return found.groupBy("chunk").applyInArrow(_verdict, "doc_id long, fp long, n long, alive boolean")


# 2. classes

_NAMED = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("digest", pa.binary())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 512):
        digests = [xxhash.xxh3_128_digest(shingles(t).tobytes()) for t in utf8(batch["text"])]
        yield record_batch(_NAMED, {"doc_id": batch["doc_id"], "fp": batch["fp"], "digest": digests})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The column text replaced by its set, shingles."""
    for batch in slices(batches, 512):
        rest = [c for c in batch.schema.names if c != "text"]
        sets = pa.array([shingles(t).tobytes() for t in utf8(batch["text"])], pa.binary())
        yield pa.RecordBatch.from_arrays([sets, *(batch[c] for c in rest)], names=["shingles", *rest])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds n, the size of the set, chunk, and number: the chunk and the place in it."""
    at = k = size = 0
    for batch in slices(batches, 256):
        sizes, chunks, numbers = [], [], []
        for s in batch["shingles"].to_pylist():
            if at == CHUNK_DOCS or size >= CHUNK_SHINGLES:
                at, k, size = 0, k + 1, 0
            c = _chunk_id(k)
            sizes.append(len(s) // 8)
            chunks.append(c)
            numbers.append((c << NUMBER_BITS) | at)
            at, size = at + 1, size + sizes[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in (sizes, chunks, numbers))], names=[*batch.schema.names, "n", "chunk", "number"])


# 3. regions

_KEYS = pa.schema([("bin", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_KEYS_DDL = "bin long, chunk long, keys binary, counts binary"
_RARE = pa.schema([("key", pa.int64()), ("number", pa.int64()), ("need", pa.int64())])


def _all_keys(sets: list[np.ndarray], bits: int) -> np.ndarray:
    return np.concatenate(sets) >> np.uint64(32 - bits) if sets else np.zeros(0, np.uint64)


def _chunk_keys(bits: int, table: pa.Table) -> pa.Table:
    v, n = np.unique(_all_keys([np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()], bits), return_counts=True)
    chunk = table["chunk"][0].as_py()
    rows = [(r, chunk, _pack_sorted((v[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), _pack(n[a:b].astype(np.uint32))) for r, a, b in _split(v, bits)]
    return pa.Table.from_batches([record_batch(_KEYS, dict(zip(_KEYS.names, map(list, zip(*rows)))))])


def _key_counts(table: pa.Table) -> pa.Table:
    """For a range: each chunk's keys that occur in several sets, and in how many."""
    bin_ = table["bin"][0].as_py()
    pieces = [(c, _unpack_sorted(k, "u4"), _unpack(n, "u4")) for c, k, n in zip(*(table[x].to_pylist() for x in ("chunk", "keys", "counts")))]
    v, inverse = np.unique(np.concatenate([k for _, k, _ in pieces]), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([n for *_, n in pieces])).astype(np.int64)
    rows, at = [], 0
    for c, keys, _ in pieces:
        n = total[inverse[at : at + len(keys)]]
        at += len(keys)
        rows.append((bin_, c, _pack_sorted(keys[n > 1]), _pack(np.minimum(n[n > 1], (1 << 32) - 1).astype(np.uint32))))
    return pa.Table.from_batches([record_batch(_KEYS, dict(zip(_KEYS.names, map(list, zip(*rows)))))])


def _rarest(bits: int, classes: pa.Table, counts: pa.Table) -> pa.Table:
    """The floor(0.3 n) + need rarest shingles of each class of a chunk, without those that are in no other."""
    known, times = [], []
    for r, k, n in sorted(zip(*(counts[x].to_pylist() for x in ("bin", "keys", "counts")))):
        known.append(_unpack_sorted(k, "u4").astype(np.uint64) | (np.uint64(r) << np.uint64(32)))
        times.append(_unpack(n, "u4"))
    keys, often = (np.concatenate(known), np.concatenate(times)) if known else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
    out_k, out_n, out_m = [], [], []
    for number, raw in zip(classes["number"].to_pylist(), classes["shingles"].to_pylist()):
        s = np.frombuffer(raw, np.uint64)
        v = s >> np.uint64(32 - bits)
        at = np.searchsorted(keys, v)
        at[at == len(keys)] = 0
        n = np.where(keys[at] == v, often[at], 1) if len(keys) else np.ones(len(s), np.uint32)
        may_lack = int(spare(np.int64(len(s))))
        need = min(SHARED, len(s) - may_lack)
        first = np.lexsort((s, n))[: may_lack + need]
        first = first[n[first] > 1]
        out_k.append(s[first])
        out_n.append(np.full(len(first), number, np.int64))
        out_m.append(np.full(len(first), need, np.int64))
    return pa.Table.from_batches([record_batch(_RARE, {"key": pa.array(np.concatenate(out_k).view(np.int64)), "number": pa.array(np.concatenate(out_n)), "need": pa.array(np.concatenate(out_m))})])


def rare_shingles(classes: DataFrame) -> DataFrame:
    """key and number of the shingles of each class of which a linked class must share need (the lesser need of the two)."""
    bits = _range_bits(_bytes(classes, "shingles"))

    def chunk_keys(table: pa.Table) -> pa.Table:
        return _chunk_keys(bits, table)

    def rarest(left: pa.Table, counts: pa.Table) -> pa.Table:
        return _rarest(bits, left, counts) if left.num_rows else pa.Table.from_batches([], schema=_RARE)

    keys = classes.select("chunk", "shingles").groupBy("chunk").applyInArrow(chunk_keys, _KEYS_DDL)
    counts = keys.groupBy("bin").applyInArrow(_key_counts, _KEYS_DDL)
    left = classes.select("chunk", "number", "shingles").groupBy("chunk")
    return left.cogroup(counts.groupBy("chunk")).applyInArrow(rarest, "key long, number long, need long")


_NODES = pa.schema([("node", pa.int64()), ("component", pa.int64())])


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all edges that come."""
    parts = [(batch["a"].to_numpy(), batch["b"].to_numpy()) for batch in batches]
    a, b = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, (u, v) = np.arange(len(nodes)), ends.reshape(2, -1)
    while (label[u] != label[v]).any():
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while (label != label[label]).any():
            label = label[label]
    yield record_batch(_NODES, {"node": nodes, "component": nodes[label]})


def components(edges: DataFrame, hot: int = HOT) -> DataFrame:
    """node and component (its least node) of a graph of edges a, b. Up to hot edges are gone through in one task. Beyond
    that labels spread to neighbours and, by looking up the label's own label, over twice the distance each time; each
    round is a written table."""
    few = stored(edges.filter("a <> b"), "edges")
    if few.count() <= hot:
        return stored(few.coalesce(1).mapInArrow(_union, "node long, component long"), "components")
    both = stored(few.select(F.col("a").alias("node"), F.col("b").alias("v")).unionByName(few.select(F.col("b").alias("node"), F.col("a").alias("v"))).distinct(), "edges")
    discard(few)
    degrees = both.groupBy("node").agg(F.least(F.min("v"), F.col("node")).alias("component"), F.count("*").alias("degree"))
    labels = stored(degrees, "labels")
    while True:
        spread = looked_up(both, labels, "node", "degree", "v", hot).select(F.col("v").alias("node"), "component", F.lit(0).cast("long").alias("degree"))
        spread = stored(spread.unionByName(labels).groupBy("node").agg(F.min("component").alias("component"), F.max("degree").alias("degree")), "spread")
        users = spread.groupBy("component").agg(F.count("*").alias("users"))
        own = stored(users.join(spread.select(F.col("node").alias("component"), F.col("component").alias("further")), "component"), "own")
        after = stored(looked_up(spread, own, "component", "users", "node", hot).select("node", F.col("further").alias("component"), "degree"), "labels")
        old = labels.select("node", F.col("component").alias("before"))
        done = after.join(old, "node").filter("component <> before").limit(1).count() == 0
        for table in (labels, spread, own):
            discard(table)
        if done:
            discard(both)
            return after.drop("degree")
        labels = after


def near(rare: DataFrame, leaders: DataFrame, many: int | None = None, paired: int = PAIRED) -> DataFrame:
    """Edges a, b between classes whose regions are one, from what rare_shingles returns and leader and users of each key."""
    placed = looked_up(rare, leaders, "key", "users", "number", many)
    frequent = placed.filter((F.col("users") > paired) & (F.col("number") != F.col("leader"))).select(F.col("leader").alias("a"), F.col("number").alias("b"))
    # most keys of near copies have the same sets: these are paired once
    sets = placed.filter(F.col("users") <= paired).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("number", "need"))).alias("sets"))
    each = sets.groupBy("sets").agg(F.count("*").alias("times")).select("times", "sets", F.explode("sets").alias("x"))
    pairs = each.select("times", "x", F.explode(F.filter("sets", lambda y: y["number"] > F.col("x.number"))).alias("y"))
    pairs = pairs.select("times", F.col("x.number").alias("a"), F.col("y.number").alias("b"), F.least("x.need", "y.need").alias("need"))
    shared = pairs.groupBy("a", "b").agg(F.sum("times").alias("times"), F.min("need").alias("need")).filter("times >= need")
    return shared.select("a", "b").unionByName(frequent.distinct())


# 4. cells

_LINKS = pa.schema([("number", pa.int64()), ("similar", pa.int64()), ("to", pa.int64())])
_LINKS_DDL = "number long, similar long, to long"


def _join_parts(table: pa.Table) -> pa.Table:
    """Joins each part of the table; a row per set: the weight of those linked with it, and the least number it reaches."""
    parts: dict[str, list[int]] = {}
    for k, p in enumerate(table["part"].to_pylist()):
        parts.setdefault(p, []).append(k)
    numbers, weights = table["number"].to_numpy(), table["weight"].to_numpy()
    home, raw = np.array(table["home"].to_pylist(), bool), table["shingles"]
    out: dict[str, list] = {"number": [], "similar": [], "to": []}
    for rows in parts.values():
        rows = sorted(rows, key=lambda k: numbers[k])
        sides = None if table["side"][rows[0]].as_py() is None else table["side"].take(pa.array(rows)).to_numpy()
        region = Region([np.frombuffer(raw[k].as_py(), np.uint64) for k in rows], weights[rows], home[rows], sides)
        region.join()
        hit = np.flatnonzero((region.counts > 0) | (region.label != np.arange(len(rows))))
        own = numbers[rows]
        out["number"] += own[hit].tolist()
        out["similar"] += region.counts[hit].tolist()
        out["to"] += own[region.label[hit]].tolist()
    return pa.Table.from_batches([record_batch(_LINKS, out)])


_CELLS = pa.schema([("of", pa.string()), ("member", pa.int64()), ("cell", pa.int64()), ("at_home", pa.bool_())])
_CELLS_DDL = "of string, member long, cell long, at_home boolean"


def cells_of(s: np.ndarray, home: bool, n: np.ndarray, keys: np.ndarray, masks: np.ndarray) -> list[tuple[int, bool]]:
    """The cells of a set, and whether it is at home there: its nearest pivot's, and those that it visits. n: the pivots' sizes;
    masks: bit j says that a key is in pivot j."""
    at = np.searchsorted(keys, s)
    at[at == len(keys)] = 0
    bits = np.unpackbits(masks[at[keys[at] == s]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    shared = bits.sum(axis=0, dtype=np.int64)[: len(n)]
    d = 1 - shared / (n + len(s) - shared)
    near, close = int(d.argmin()), d <= d.min() + 2 * (1 - PERCENT / 100) + EPS
    # of two sets at home in different cells, that of the higher one visits the lower; a visitor visits all
    return [(j, home and j == near) for j in np.flatnonzero(close).tolist() if not home or j <= near]


def _divide(sets: pa.Table, seeds: pa.Table) -> pa.Table:
    """The cells of some sets of a part, by the part's pivots: numbers alone, since a set may be copied into MAX_PIVOTS cells."""
    out: list[tuple] = []
    if sets.num_rows and seeds.num_rows:
        found = sorted(seeds["pivots"][0].as_py() or [], key=lambda x: x["number"])[:MAX_PIVOTS]
        pivots = [np.frombuffer(x["shingles"], np.uint64) for x in found]
        keys, place = np.unique(np.concatenate(pivots), return_inverse=True) if pivots else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        masks, at = np.zeros(len(keys), np.uint64), 0
        for j, x in enumerate(pivots):
            masks[place[at : at + len(x)]] |= np.uint64(1 << j)
            at += len(x)
        n, shingles = np.array([len(x) for x in pivots]), sets["shingles"]
        for k, (part, number, home) in enumerate(zip(*(sets[c].to_pylist() for c in ("part", "number", "home")))):
            cells = cells_of(np.frombuffer(shingles[k].as_py(), np.uint64), home, n, keys, masks) if pivots else [(0, home)]
            out += [(part, number, j, at_home) for j, at_home in cells]
    return pa.Table.from_batches([record_batch(_CELLS, dict(zip(_CELLS.names, map(list, zip(*out)))) if out else {c: [] for c in _CELLS.names})])


def divided(parts: DataFrame, limit: int, level: int) -> DataFrame:
    """The cells of parts (part, number, weight, shingles, home, sets, inside, homes), as parts. A part whose cells would
    have more copies than block_links makes stays whole, with a before that says that it can't be divided."""
    # about CELL_PIVOTS sets of each part, whatever its size, are its pivots
    chosen = F.col("home") & (F.pmod(F.xxhash64("number", F.lit(level)), F.lit(1 << 40)) < F.lit(float(CELL_PIVOTS * (1 << 40))) / F.col("homes"))
    pivots = parts.filter(chosen).groupBy("part").agg(F.collect_list(F.struct("number", "shingles")).alias("pivots"))
    salts = F.ceil(F.col("inside") / limit).cast("int")
    tasks = parts.select("part", "inside").distinct().join(pivots, "part", "left").select(F.col("part").alias("of"), "pivots", F.explode(F.sequence(F.lit(0), salts)).alias("task"))
    sets = parts.select("part", "number", "shingles", "home", F.pmod(F.xxhash64("number"), salts + 1).cast("int").alias("salt"))
    cells = sets.groupBy("part", "salt").cogroup(tasks.groupBy("of", "task")).applyInArrow(_divide, _CELLS_DDL)
    cells = stored(cells, "numbers")
    sizes = parts.select("part", "sets", _blocks(limit).alias("blocks")).distinct()
    whole = cells.groupBy("of").agg(F.count("*").alias("copies")).join(sizes, F.col("of") == F.col("part")).filter("copies >= blocks * sets").select("part")  # fewer than large regions
    kept = parts.join(F.broadcast(whole), "part", "left_semi").select("part", "number", "weight", "shingles", "home", F.lit(0).cast("long").alias("before"))
    cells = cells.join(F.broadcast(whole.withColumnRenamed("part", "of")), "of", "left_anti")
    # the copies are made row by row in this join, not in a task's memory
    copies = cells.join(parts, (cells["of"] == parts["part"]) & (cells["member"] == parts["number"]))
    return copies.select(F.concat_ws("/", "of", "cell").alias("part"), "number", "weight", "shingles", F.col("at_home").alias("home"), F.col("inside").alias("before")).unionByName(kept)


def _blocks(limit: int) -> Column:
    """How many blocks a part is compared in, and so how many copies of it that takes."""
    return F.ceil(2 * F.col("inside") / limit).cast("int")


def block_links(parts: DataFrame, limit: int) -> DataFrame:
    """The links of parts (with inside), each block of a part by itself, and each two blocks with the pairs between them."""
    placed = parts.withColumn("blocks", _blocks(limit))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.concat_ws("/", "part", F.least("block", "other"), F.greatest("block", "other")).alias("part")
    side = F.when(F.col("block") != F.col("other"), F.col("block")).alias("side")
    return pairs.select(F.xxhash64(part).alias("bin"), part, "number", "weight", "shingles", "home", side).groupBy("bin").applyInArrow(_join_parts, _LINKS_DDL)


def part_links(parts: DataFrame, total: int, limit: int) -> DataFrame:
    """The links of parts of at most limit shingles, about as many parts at a time as have a BINS-th of that together: chance
    puts several times the mean into some bins, beside a part that may be as large as the limit."""
    bins = max(parallelism(parts), -(-BINS * total // limit))
    binned = parts.select(F.pmod(F.xxhash64("part"), F.lit(bins)).alias("bin"), "part", "number", "weight", "shingles", "home", F.lit(None).cast("int").alias("side"))
    return binned.groupBy("bin").applyInArrow(_join_parts, _LINKS_DDL)


def region_links(classes: DataFrame, regions: DataFrame, limit: int = REGION_SHINGLES, hot: int = HOT) -> DataFrame:
    """number, similar and to of classes (number, n, weight, shingles) in regions (node, component): partial counts, to be summed, and edges."""
    thin = classes.select("number", "n").join(regions.select(F.col("node").alias("number"), F.col("component").alias("region")), "number")
    sizes = stored(thin.groupBy("region").agg(F.count("*").alias("sets"), F.sum("n").alias("inside")).filter("sets > 1"), "regions")
    total, most = sizes.agg(F.sum("inside"), F.max("inside")).first()
    placed = looked_up(thin.drop("n"), sizes, "region", "sets", "number", hot if classes.count() > hot else None)
    held = classes.select("number", "weight", "shingles").join(placed, "number").select(F.col("region").cast("string").alias("part"), "number", "weight", "shingles", F.lit(True).alias("home"), "inside")
    out = part_links(held.filter(F.col("inside") <= limit), total or 0, limit)
    if (most or 0) <= limit:
        return out
    parts = stored(held.filter(F.col("inside") > limit).withColumn("before", F.lit(None).cast("long")).drop("inside"), "large")
    for level in range(LEVELS + 1):
        n = F.octet_length("shingles").cast("long") / 8
        each = parts.groupBy("part").agg(F.count("*").alias("sets"), F.sum(n).cast("long").alias("inside"), F.count(F.when(F.col("home"), 1)).alias("homes"))
        each = stored(each.filter("homes > 0 AND sets > 1"), "sizes")
        sized = looked_up(parts, each, "part", "sets", "number", hot)
        fits, stuck = F.col("inside") <= limit, F.col("before").isNotNull() & (F.col("inside") > SHRINKS * F.col("before"))
        if level == LEVELS:
            stuck = F.lit(True)
        out = out.unionByName(part_links(sized.filter(fits), each.filter(fits).agg(F.sum("inside")).first()[0] or 0, limit))
        out = out.unionByName(block_links(sized.filter(~fits & stuck), limit))
        left = sized.filter(~fits & ~stuck)
        if level == LEVELS or left.limit(1).count() == 0:
            return out
        parts = stored(divided(left, limit, level), "cells")
    return out


# all of it


def _found(docs: DataFrame, id_col: str, text_col: str, limit: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """The screened rows, and a row for each that isn't alone: k_id, k_fp, component (a number), n_similar, least."""
    rows = view(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("fp"))
    if not is_scan(docs):  # chunks of a task that is repeated must have the same rows
        rows = stored(rows, "rows")
    screened = stored(screen(rows), "screened")
    alive = screened.filter("alive").select(F.col("doc_id").alias("k_id"), F.col("fp").alias("k_fp")).distinct()
    key = rows["doc_id"].eqNullSafe(F.col("k_id")) & (rows["fp"] == F.col("k_fp"))
    n = screened.filter("alive").count()
    many = hot if n > hot else None  # no key below has more rows than there are
    kept = stored if many else lambda df, name: df
    named = stored(rows.join(_held(alive, n), key, "left_semi").mapInArrow(_digests, "doc_id long, fp long, digest binary"), "named")
    each = named.groupBy("digest", "doc_id", "fp").agg(F.count("*").alias("rows")).groupBy("digest")
    ones = stored(each.agg(F.min(F.struct("doc_id", "fp", "rows")).alias("one"), F.min("doc_id").alias("least"), F.sum("rows").alias("weight")), "ones")
    ones_ = ones.select(F.col("one.doc_id").alias("k_id"), F.col("one.fp").alias("k_fp"), "digest", "least", "weight")
    sets = rows.join(_held(ones_, n), key).select("text", "digest", "least", "weight").mapInArrow(_sets, "shingles binary, digest binary, least long, weight long")
    if ones.filter("one.rows > 1").limit(1).count():  # rows that repeat an id and its text
        sets = sets.dropDuplicates(["digest"])
    classes = stored(sets.mapInArrow(_numbered, "shingles binary, digest binary, least long, weight long, n long, chunk long, number long"), "classes")

    rare = stored(rare_shingles(classes), "rare")
    leaders = kept(rare.groupBy("key").agg(F.min("number").alias("leader"), F.count("*").alias("users")).filter("users > 1"), "leaders")
    regions = components(near(rare, leaders, many), hot)
    discard(rare)
    discard(leaders)

    links = stored(region_links(classes, regions, limit, hot), "links")
    similar = links.groupBy("number").agg(F.sum("similar").alias("similar"))
    linked = components(links.filter("number <> to").select(F.col("number").alias("a"), F.col("to").alias("b")).distinct(), hot)
    known = classes.select("digest", "least", "weight", "number").join(similar, "number", "left").join(linked, F.col("number") == linked["node"], "left")
    known = known.filter((F.col("weight") > 1) | F.col("similar").isNotNull()).withColumn("component", F.coalesce("component", "number"))
    known = stored(known.select("digest", "least", "weight", "number", "component", (F.col("weight") - 1 + F.coalesce("similar", F.lit(0))).alias("n_similar")), "known")
    least = kept(known.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")), "least")
    known = kept(looked_up(known, least, "component", "classes", "number", many).select("digest", "component", "n_similar", "component_id", "weight"), "known")
    found = looked_up(named, known, "digest", "weight", "doc_id", many)
    return screened, found.select(F.col("doc_id").alias("k_id"), F.col("fp").alias("k_fp"), "component", "n_similar", "component_id")


def _held(keys: DataFrame, n: int) -> DataFrame:
    """keys, to be held in memory for a join with texts, which needn't be sorted then, if they are few for each task."""
    return keys.hint("shuffle_hash") if n <= HELD_ROWS * parallelism(keys) else keys


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = REGION_SHINGLES, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, n_similar, component_id.

    Null or empty text, or one without words, has the empty set and is linked with nothing. Each row is a document,
    also where rows repeat an id or an id and its text; component_id is the least id that isn't null. A null id alone
    in its component has a null there. An empty table gives no rows.
    """
    screened, found = _found(docs, id_col, text_col, limit, hot)
    found = found.drop("component").distinct()
    key = screened["doc_id"].eqNullSafe(F.col("k_id")) & (screened["fp"] == F.col("k_fp"))
    return screened.join(found, key, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"),
        F.when(F.col("k_fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = REGION_SHINGLES, hot: int = HOT) -> DataFrame:
    """docs with one row of each component, that of the least id (null comes last), and all rows linked with nothing;
    all columns stay. Of rows that repeat both that id and its text one stays. The other cases are those of similar_documents."""
    _, found = _found(docs, id_col, text_col, limit, hot)
    found = stored(found.groupBy("component", "k_id", "k_fp").agg(F.count("*").alias("n")), "found")
    one = stored(found.groupBy("component").agg(F.min(F.struct(F.col("k_id").isNull().alias("none"), "k_id", "k_fp")).alias("one"), F.count("*").alias("members")), "first")
    n = found.count()
    beside = looked_up(found, one, "component", "members", "k_fp", hot if n > hot else None).withColumn("stays", F.col("k_id").eqNullSafe(F.col("one.k_id")) & (F.col("k_fp") == F.col("one.k_fp")))

    def of(rows: DataFrame, keys: DataFrame):
        return rows[f"`{id_col}`"].cast("long").eqNullSafe(keys["k_id"]) & (F.xxhash64(rows[f"`{text_col}`"]) == keys["k_fp"])

    gone = _held(beside.filter("NOT stays").select("k_id", "k_fp"), n)
    kept = docs.join(gone, of(docs, gone), "left_anti")
    repeated = beside.filter("stays AND n > 1").select("k_id", "k_fp")
    if repeated.limit(1).count() == 0:
        return kept
    number = "__row"
    while number in docs.columns:
        number = f"_{number}"
    rest = kept.join(repeated, of(kept, repeated), "left_anti")
    by = Window.partitionBy(F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))).orderBy(F.lit(1))
    first = kept.join(repeated, of(kept, repeated), "left_semi").withColumn(number, F.row_number().over(by)).filter(F.col(number) == 1).drop(number)
    return rest.unionByName(first)


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [ws] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i : i + 2]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 70 * (nx.n + ny.n - i)),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.reach = l.x),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id),
k AS (SELECT x, count(*) AS n_similar FROM l GROUP BY x)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.n_similar, 0) AS n_similar, c.component_id
FROM c LEFT JOIN n USING (doc_id) LEFT JOIN k ON k.x = c.doc_id
"""
