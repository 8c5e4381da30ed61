"""Mixing sources to target weights by Pfair scheduling.

The documents of each source, in the table's order, form blocks of equally many. A source of weight w may place its
block k (from 0) from slot floor(k/w) on, its release time, and must have placed it before slot ceil((k+1)/w), its
deadline. Filling each slot with the released block of the earliest deadline keeps, at every slot, each source
within one block of its weight. Blocks are of rows, whose texts of any length aren't looked at. Weights are fractions without rounding. When a source has no blocks left, a new phase
begins in which the others share its weight in proportion; so all rows are kept, once, and every phase has the property
above.

Where the weights are whole numbers of some part of their sum, each source has placed a whole number of blocks after so
many slots, all next blocks are released at once, and the schedule begins again. Such a period is made once and stands
for a phase of any length: the plan's size is that of the periods and not of the table. The plan is made in the driver
and sent to every task if it has at most BROADCAST_SLOTS slots, periods counted once; else (very many sources, or
weights without a short period) one task writes the places of all blocks, a slot at a time and holding a few numbers a
source, to a scratch table, with which the rows are joined.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.common import extended, located, parallelism, place_key, record_batch, slices, stored

BLOCK_ROWS = 64
#: A plan of so many slots (12 bytes each) is sent to every task, and the numbers of rows before as many splits' sources.
BROADCAST_SLOTS = BROADCAST_ROWS = 1 << 21
#: The weight of the largest source among default weights, which are whole numbers from 1 on.
TOP_WEIGHT = 256
#: A task that writes all places keeps periods up to this length; longer ones it goes through again.
KEPT_PERIOD = 1 << 22
#: Sources up to which each phase looks for a common divisor of its weights.
REDUCED_SOURCES = 4096
#: A later deadline, of a weight so small that 64 bits don't hold it, is given as this.
LAST = (1 << 63) - 1


def fraction(w: float | Fraction) -> Fraction:
    """A weight as it is written: the float 0.1 is a tenth."""
    return Fraction(repr(float(w))) if not isinstance(w, (int, Fraction)) else Fraction(w)


@dataclass
class Phase:
    """length slots from slot start on, at the end of which the source last is through. Slot t of it goes to the source
    pattern[t % len(pattern)]. whole: the sum of the parts (whole_parts) of its sources."""

    start: int
    length: int
    last: int
    pattern: list[int]
    whole: int


def phases(blocks: list[int], weights: list[float | Fraction], limit: int | None = None, keep: int = KEPT_PERIOD) -> Iterator[Phase]:
    """Phase after phase: of the released blocks that of the earliest deadline goes first, and of equal ones that of the
    larger weight and then of the first source. A phase whose period is longer than keep comes with all its slots in
    several parts, of which the last names the source that is through (the others -1). Stops beyond limit slots of patterns.

    A phase begins with the first blocks of all sources, all released, whose deadlines are in the order of the weights:
    so they wait in one list for all phases, and a phase costs no more than its own slots, or those of its period."""
    parts = whole_parts(weights)
    order = sorted((s for s, n in enumerate(blocks) if n), key=lambda s: (-parts[s], s))
    head, after, before = order[0] if order else -1, dict(zip(order, [*order[1:], -1])), dict(zip(order, [-1, *order]))
    whole, done, start, spent, active = sum(parts[s] for s in order), [0] * len(blocks), 0, 0, len(order)
    while head >= 0:
        divisor = math.gcd(*(parts[s] for s in _listed(head, after))) if active <= REDUCED_SOURCES else 1
        period = whole // divisor
        first = {}  # the sources that have begun in this phase: their first block here
        fresh, t, begun, last = head, 0, start, -1
        waiting: list[tuple[int, int]] = []  # by release
        ready: list[tuple[int, int, int]] = []  # by deadline
        out: list[int] = []
        while last < 0 and not (t == period and period <= keep):
            while waiting and waiting[0][0] <= t:
                s = heapq.heappop(waiting)[1]
                heapq.heappush(ready, (-(-(done[s] - first[s] + 1) * whole // parts[s]), -parts[s], s))
            if fresh >= 0 and (not ready or (-(-whole // parts[fresh]), -parts[fresh], fresh) < ready[0]):
                s, fresh = fresh, after[fresh]
                first[s] = done[s]
            else:
                s = heapq.heappop(ready)[2]
            out.append(s)
            done[s] += 1
            t += 1
            if done[s] == blocks[s]:
                last = s
                break
            heapq.heappush(waiting, ((done[s] - first[s]) * whole // parts[s], s))
            if period > keep and len(out) == 1 << 15:
                spent += len(out)
                yield Phase(begun, len(out), -1, out, whole)
                if limit is not None and spent > limit:
                    return
                begun, out = begun + len(out), []
        if last < 0:  # a whole period: it is repeated until a source is through, in the period after so many
            there, place = np.unique(out, return_inverse=True)
            a_period = np.bincount(place)
            left = np.array([blocks[s] - first[s] for s in there.tolist()])
            times = int(((left - 1) // a_period).min())
            stop = int(np.argmax(_ranks(place) + 1 == (left - times * a_period)[place]))
            last, t = out[stop], times * period + stop + 1
            for s, n in zip(there.tolist(), (times * a_period + np.bincount(place[: stop + 1], minlength=len(there))).tolist()):
                done[s] = first[s] + n
        spent += len(out)
        yield Phase(begun, start + t - begun, last, out, whole)
        if limit is not None and spent > limit:
            return
        whole, start, active = whole - parts[last], start + t, active - 1
        if before[last] >= 0:
            after[before[last]] = after[last]
        else:
            head = after[last]
        if after[last] >= 0:
            before[after[last]] = before[last]


def whole_parts(weights: list[float | Fraction]) -> list[int]:
    """Whole numbers in the proportions of the weights."""
    exact = [fraction(w) for w in weights]
    scale = math.lcm(*(w.denominator for w in exact)) if exact else 1
    parts = [int(w * scale) for w in exact]
    least = math.gcd(*parts) if parts else 1
    return [p // least for p in parts]


def _listed(head: int, after: dict[int, int]) -> Iterator[int]:
    while head >= 0:
        yield head
        head = after[head]


def _ranks(pattern: np.ndarray) -> np.ndarray:
    """For each slot how many earlier ones went to the same source."""
    order = np.argsort(pattern, kind="stable")
    ordered = pattern[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    out = np.empty(len(pattern), np.int64)
    out[order] = np.arange(len(pattern)) - np.repeat(starts, np.diff(np.r_[starts, len(pattern)]))
    return out


def _whole_numbers(x: Iterable[int]) -> np.ndarray:
    """Of 64 bits where those hold them, else of any size."""
    x = list(x)
    return np.array(x, np.int64 if max(x, default=0) < 1 << 62 else object)


def _product(a: np.ndarray, b: np.ndarray, of: np.ndarray, up: bool) -> np.ndarray:
    """a * b / of, rounded down or up, in whole numbers of any size."""
    if a.dtype == object or b.dtype == object or of.dtype == object or (len(a) and int(a.max()) * int(b.max()) >= 1 << 62):
        a, b, of = a.astype(object), b.astype(object), of.astype(object)
    return -(-a * b // of) if up else a * b // of


class Schedule:
    """All phases for sources of known numbers of blocks, with for each source the phases in which it places some."""

    def __init__(self, blocks: list[int], weights: list[float | Fraction], found: list[Phase]) -> None:
        self.phases = [Phase(p.start, p.length, p.last, [], p.whole) for p in found]
        self.total, self.parts = sum(blocks), _whole_numbers(whole_parts(weights) or [0])
        self.begins, self.wholes, lengths = (_whole_numbers([getattr(p, c) for p in found] or [1]) for c in ("start", "whole", "length"))
        self.periods = np.array([len(p.pattern) for p in found] or [1])
        source = np.fromiter((s for p in found for s in p.pattern), np.int64)
        phase = np.repeat(np.arange(len(found)), self.periods[: len(found)])
        slot = np.arange(len(source)) - (np.cumsum(self.periods) - self.periods)[phase]
        order = np.lexsort((slot, phase, source))
        source, phase, slot = source[order], phase[order], slot[order]
        starts = np.flatnonzero(np.r_[True, (source[1:] != source[:-1]) | (phase[1:] != phase[:-1])]) if len(source) else np.zeros(0, np.int64)
        times, rest = np.divmod(lengths, self.periods)
        self.source, self.phase, self.at, self.count = source[starts], phase[starts], starts, np.diff(np.r_[starts, len(source)])
        placed = self.count * times[self.phase] + (np.add.reduceat(slot < rest[phase], starts, dtype=np.int64) if len(starts) else 0)
        before = np.cumsum(placed) - placed  # of all sources; then of the same one
        begins = np.flatnonzero(np.r_[True, self.source[1:] != self.source[:-1]]) if len(starts) else starts
        self.first, self.slots = before - np.repeat(before[begins], np.diff(np.r_[begins, len(starts)])), slot.astype(np.int32)

    @classmethod
    def of(cls, blocks: list[int], weights: list[float | Fraction], limit: int | None = None) -> Schedule | None:
        """None if its patterns have more than limit slots."""
        found = list(phases(blocks, weights, limit, 1 << 62))
        return None if limit is not None and sum(len(p.pattern) for p in found) > limit else cls(blocks, weights, found)

    def find(self, source: int | np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phase, slot, release and deadline of blocks of a source, or of one source each."""
        source = np.broadcast_to(np.asarray(source, np.int64), block.shape)
        if not len(block):
            return (np.zeros(0, np.int64),) * 4
        e = np.searchsorted(self.source * (1 << 40) + self.first, source * (1 << 40) + block, side="right") - 1
        phase, k = self.phase[e], block - self.first[e]
        again, rank = np.divmod(k, self.count[e])
        begin = self.begins[phase]
        slot = begin + again * self.periods[phase] + self.slots[self.at[e] + rank]
        release, deadline = (begin + _product(n, self.wholes[phase], self.parts[source], up) for n, up in ((k, False), (k + 1, True)))
        return phase.astype(np.int64), slot, release.astype(np.int64), np.minimum(deadline, LAST).astype(np.int64)


def placed_rows(blocks: list[int], weights: list[float | Fraction], rows: int = 1 << 15) -> Iterator[dict[str, list | np.ndarray]]:
    """source, block, phase, slot, release and deadline of all blocks, slot by slot, about so many at a time."""
    names, parts, done, number = ("source", "block", "phase", "slot", "release", "deadline"), whole_parts(weights), [0] * len(blocks), 0
    exact, held, first, begin = _whole_numbers(parts or [0]), [], {}, 0
    for p in phases(blocks, weights):
        if p.length == len(p.pattern):
            for slot, s in enumerate(p.pattern, p.start):
                k = done[s] - first.setdefault(s, done[s])
                held.append((s, done[s], number, slot, begin + k * p.whole // parts[s], min(begin - (-(k + 1) * p.whole // parts[s]), LAST)))
                done[s] += 1
                if len(held) == rows:
                    yield dict(zip(names, map(list, zip(*held))))
                    held = []
        else:
            if held:
                yield dict(zip(names, map(list, zip(*held))))
                held = []
            pattern = np.array(p.pattern)
            there, place = np.unique(pattern, return_inverse=True)
            a_period, rank, base = np.bincount(place), _ranks(place), np.array([done[s] for s in there.tolist()])
            for t in range(0, p.length, rows):
                again, i = np.divmod(np.arange(t, min(p.length, t + rows)), len(pattern))
                k = again * a_period[place[i]] + rank[i]
                whole = np.full(len(k), p.whole, np.int64 if p.whole < 1 << 62 else object)
                release, deadline = (_product(n, whole, exact[pattern[i]], up) + p.start for n, up in ((k, False), (k + 1, True)))
                columns = pattern[i], base[place[i]] + k, np.full(len(k), number), p.start + np.arange(t, t + len(k)), release.astype(np.int64), np.minimum(deadline, LAST).astype(np.int64)
                yield dict(zip(names, columns))
            times, rest = divmod(p.length, len(pattern))
            for s, n in zip(there.tolist(), (a_period * times + np.bincount(place[:rest], minlength=len(there))).tolist()):
                done[s] += n
        if p.last >= 0:
            first, begin, number = {}, p.start + p.length, number + 1
    if held:
        yield dict(zip(names, map(list, zip(*held))))


def default_weights(blocks: list[int]) -> list[int]:
    """In proportion to the root of a source's blocks, in whole numbers: large sources are thinned, small ones come more often."""
    top = max(blocks, default=1)
    return [max(1, round(TOP_WEIGHT * (n / top) ** 0.5)) for n in blocks]


class _Counter:
    """The number of each row among those of its source in its split; the rows of a split come one after another."""

    def __init__(self) -> None:
        self.here, self.seen = None, {}

    def count(self, batch: pa.RecordBatch, split: int, at: int, source: int) -> np.ndarray:
        out = np.zeros(batch.num_rows, np.int64)
        for i, (*here, x) in enumerate(zip(*(batch.column(c).to_pylist() for c in (split, at, source)))):
            if here != self.here:
                self.here, self.seen = here, {}
            out[i] = self.seen.get(x, 0)
            self.seen[x] = self.seen.get(x, 0) + 1
        return out


def _places(k: int):
    """Adds the place within the split, where the columns from k on are source, split and at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counter.count(batch, k + 1, k + 2, k))], names=[*batch.schema.names, "local"])

    return run


def _planned(totals: Iterable[tuple[str | None, int]], weights: Mapping[str | None, float] | None, block_rows: int) -> tuple[list[str | None], list[int], list[float]]:
    """The sources in order, their blocks and their weights."""
    rows = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    blocks = [-(-n // block_rows) for _, n in rows]
    given = default_weights(blocks) if weights is None else [w if isinstance(w := weights.get(s, 1.0), (int, Fraction)) else float(w) for s, _ in rows]
    return [s for s, _ in rows], blocks, given


_PLAN = pa.schema([("source", pa.string()), ("block", pa.int64()), ("phase", pa.int32()), ("slot", pa.int64()), ("release", pa.int64()), ("deadline", pa.int64())])
_EXTRA = [("phase", "integer"), ("block", "long"), ("seat", "integer"), ("release", "long"), ("deadline", "long"), ("slot", "long")]


def scheduled(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source_col: str = "source", block_rows: int = BLOCK_ROWS, mark: str = "", keep: list[str] | None = None, broadcast_rows: int = BROADCAST_ROWS, broadcast_slots: int = BROADCAST_SLOTS) -> tuple[DataFrame, int]:
    """docs (or its columns keep) with phase, block, seat (place in the block), release, deadline and slot, their names behind mark; and the number of slots.

    weights: a positive number for each source; one that isn't named has weight 1. Without weights: default_weights.
    A null source is a source of its own, and there may be any number of them. An empty table has no slots.
    """
    spark, kept = docs.sparkSession, keep or docs.columns
    names = [f"__{n}_{mark}" for n in ("split", "at", "base", "source", "local", "key", "check")]
    plain = [docs[f"`{c}`"] for c in kept]
    source = docs[f"`{source_col}`"].cast("string").alias(names[3])
    rows = located(docs, [*plain, source], names[0], names[1])
    split, at, src = (F.col(f"`{names[k]}`") for k in (0, 1, 3))
    counts = stored(rows.groupBy(split.alias("split"), at.alias("at"), src.alias("source")).agg(F.count("*").alias("n")), "counts")  # a row for each split and source
    before = Window.partitionBy("source").orderBy(F.length("split"), "split", "at").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(counts.select(*place_key("split", "at", "source"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "bases")
    few = bases.count() <= broadcast_rows
    bases = bases.select(*[F.col(c).alias(f"__base_{mark}{c}") for c in bases.columns])
    totals = stored(counts.groupBy("source").agg(F.sum("n").alias("n")), "totals")
    total = totals.agg(F.sum(F.ceil(F.col("n") / block_rows))).first()[0] or 0
    if weights is not None:
        low = [s for s, w in weights.items() if not w > 0]
        if low and totals.filter(F.col("source").isin([s for s in low if s is not None]) | (F.col("source").isNull() & F.lit(None in low))).limit(1).count():
            raise ValueError("weights are positive")
    sent = None
    if totals.count() <= broadcast_slots:
        sources, blocks, given = _planned(((r["source"], r["n"]) for r in totals.collect()), weights, block_rows)
        plan = Schedule.of(blocks, given, broadcast_slots)
        sent = plan and spark.sparkContext.broadcast((plan, {s: k for k, s in enumerate(sources)}))
    if not few:  # a shuffle would lose the order, so the place within the split is taken before
        rows = rows.mapInArrow(_places(len(kept)), extended(rows, {names[4]: "long"}))
    keyed = rows.withColumns(dict(zip(names[5:], place_key(split, at, src))))
    same = (F.col(f"`{names[5]}`") == F.col(f"`__base_{mark}key`")) & (F.col(f"`{names[6]}`") == F.col(f"`__base_{mark}check`"))
    joined = keyed.join(F.broadcast(bases) if few else bases, same).withColumn(names[2], F.col(f"`__base_{mark}before`"))
    joined = joined.select(*[F.col(f"`{c}`") for c in [*kept, *names[: 4 if few else 5]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, k = _Counter(), len(kept)
        for batch in slices(batches):
            local = counter.count(batch, k, k + 1, k + 3) if few else batch.column(k + 4).to_numpy()
            rank = batch.column(k + 2).to_numpy() + local
            block = rank // block_rows
            seat = pa.array(rank % block_rows, pa.int32())
            if sent is None:
                extra, new = [batch.column(k + 3), pa.array(block), seat], [names[3], mark + "block", mark + "seat"]
            else:
                schedule, number = sent.value
                phase, slot, release, deadline = schedule.find(np.array([number[x] for x in batch.column(k + 3).to_pylist()], np.int64), block)
                extra, new = [pa.array(phase, pa.int32()), pa.array(block), seat, pa.array(release), pa.array(deadline), pa.array(slot)], [mark + c for c, _ in _EXTRA]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *extra], names=[*batch.schema.names[:k], *new])

    narrow = docs.select(*plain)
    if sent is not None:
        return joined.mapInArrow(run, extended(narrow, {mark + c: kind for c, kind in _EXTRA})), total

    def plan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources, blocks, given = _planned(((s, n) for batch in batches for s, n in zip(batch["source"].to_pylist(), batch["n"].to_pylist())), weights, block_rows)
        for part in placed_rows(blocks, given):
            yield record_batch(_PLAN, part | {"source": [sources[s] for s in part["source"]]})

    places = stored(totals.coalesce(1).mapInArrow(plan_rows, "source string, block long, phase integer, slot long, release long, deadline long"), "schedule")
    places = places.select(*[F.col(c).alias(f"__place_{mark}{c}") for c in places.columns])
    rows = joined.mapInArrow(run, extended(narrow, {names[3]: "string", mark + "block": "long", mark + "seat": "integer"}))
    at = F.col(f"`{names[3]}`").eqNullSafe(F.col(f"`__place_{mark}source`")) & (F.col(f"`{mark}block`") == F.col(f"`__place_{mark}block`"))
    there = {c: F.col(f"`{mark}{c}`" if c in ("block", "seat") else f"`__place_{mark}{c}`").alias(mark + c) for c, _ in _EXTRA}
    return rows.join(places, at).select(*[F.col(f"`{c}`") for c in kept], *there.values()), total


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source_col: str = "source", block_rows: int = BLOCK_ROWS, partitions: int | None = None) -> DataFrame:
    """All rows of docs, in the order of the schedule: partitions follow one another, and so do the rows within them.

    Written to files, that order is the order of the files. The other cases are those of scheduled.
    """
    mark = "__mix_"
    while any(c.startswith(mark) for c in docs.columns):
        mark = f"_{mark}"
    rows, total = scheduled(docs, weights, source_col, block_rows, mark)
    n = max(1, partitions or parallelism(docs))
    slot = F.col(f"`{mark}slot`")
    part = F.floor(slot * F.lit(n) / F.lit(max(1, total))).cast("int")
    return rows.repartitionById(n, part).sortWithinPartitions(slot, F.col(f"`{mark}seat`")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scheduled(docs, keep=["doc_id", "source"])[0]
