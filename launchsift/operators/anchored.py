"""Windows anchored at their first hit.

A window opens at the first hit that no open window covers and lasts ``period_s``; the
next hit at or after its end opens the next one.  Where a window starts depends on
every window before it, so the rule is sequential per key.  To keep a hot key parallel,
hits are dealt once by ranges of (key, time, id) into sorted parts, which stay as they are
for all further steps.  A part holds whole keys except for its first and its last one:

1. every part names these two and their times, two rows a part; a key that goes on in the
   next part is a chain of cells;
2. in a cell, hits that would lead to the same last anchor form a class.  A class is one
   row: its last anchor and when the window after it may begin;
3. that time points to a class of a later cell.  The pointers are composed with themselves
   by joins, so that round k reaches 2^k cells further, and the classes reached from the
   key's first hit double with every round;
4. at most one class a cell is reached.  It tells the later cells which window they
   inherit, and all parts replay their hits in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from launchsift.functions.runs import numbers, run_starts, values_at
from launchsift.functions.text import micros
from launchsift.operators.lineage import cut_plan

_NEVER = 2**62


@dataclass
class Chain:
    """The cells of one key that lies in several parts, in order; times in microseconds."""

    key: tuple
    parts: list[int]
    last_at: np.ndarray
    before: np.ndarray

    def cell_after(self, ready: np.ndarray) -> np.ndarray:
        """The cell that holds the first hit at or after each time; the number of cells if none does."""
        return np.searchsorted(self.last_at, ready, side="left")


def chains_of(edges: list[tuple]) -> list[Chain]:
    """Chains from (key, part, first, last_at, rows) of the first and last key of every part."""
    chains: list[Chain] = []
    run: list[tuple] = []

    def close() -> None:
        if len(run) > 1:
            before = np.cumsum([0, *[e[4] for e in run[:-1]]])
            chains.append(Chain(run[0][0], [e[1] for e in run], np.array([e[3] for e in run]), before))

    for edge in sorted(edges, key=lambda e: (e[1], not e[2])):
        if run and run[-1][0] != edge[0]:
            close()
            run = []
        run.append(edge)
    close()
    return chains


def _parts(hits: DataFrame, keys: list[str], ts: str, id_col: str, parts: int | None) -> DataFrame:
    """(keys, ts, id, _at) sorted in range parts that stay the same for every later reading."""
    slim = hits.select(*keys, ts, id_col, micros(F.col(ts)).alias("_at")).filter(F.col("_at").isNotNull())
    order = [*keys, "_at", id_col]
    dealt = slim.repartitionByRange(*order) if parts is None else slim.repartitionByRange(parts, *order)
    return cut_plan(dealt.sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches with the number of their part; one of several parts is cut between them."""
    for batch in batches:
        if batch.num_rows:
            part, starts = numbers(batch, "_part"), run_starts(batch, ["_part"])
            for begin, end in zip(starts, [*starts[1:], batch.num_rows]):
                yield int(part[begin]), batch.slice(begin, end - begin)


def _edges(ranged: DataFrame, keys: list[str]) -> list[tuple]:
    """(key, part, first, last_at, rows) of the first and the last key of every part."""
    kinds = [ranged.schema[k] for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[tuple]] = {}
        for part, batch in _by_part(batches):
            kind, ends = batch.schema, seen.setdefault(part, [])
            starts, at = run_starts(batch, keys), numbers(batch, "_at")
            for k in sorted({0, len(starts) - 1}):
                stop = starts[k + 1] if k + 1 < len(starts) else batch.num_rows
                key, size = values_at(batch, keys, starts[k]), int(stop - starts[k])
                if ends and ends[-1][0] == key:
                    ends[-1] = (key, int(at[stop - 1]), ends[-1][2] + size)
                else:
                    ends[1:] = [(key, int(at[stop - 1]), size)]
        for part, ends in seen.items():
            columns = list(zip(*[key for key, _, _ in ends]))
            arrays = [pa.array(c, kind.field(k).type) for k, c in zip(keys, columns)]
            n = len(ends)
            rest = [pa.array(c) for c in ([part] * n, [True, False][:n], [x[1] for x in ends], [x[2] for x in ends])]
            yield pa.RecordBatch.from_arrays([*arrays, *rest], names=[*keys, "_part", "_first", "_last_at", "_rows"])

    extra = [("_part", T.LongType()), ("_first", T.BooleanType()), ("_last_at", T.LongType()), ("_rows", T.LongType())]
    schema = T.StructType([*kinds, *[T.StructField(n, t) for n, t in extra]])
    # Two rows a part at most.
    found = ranged.mapInArrow(run, schema).collect()
    return [(tuple(r[: len(keys)]), *r[len(keys) :]) for r in found]


CLASS = "chain bigint, cell bigint, upto bigint, anchor bigint, rank bigint, ready bigint, target bigint"


def classes_of(at: np.ndarray, chain: Chain, number: int, cell: int, period: int) -> dict[str, np.ndarray]:
    """The classes of one cell; ``upto`` is the latest beginning that leads into a class."""
    last = np.searchsorted(at, at + period, side="left")
    last = np.where(last < len(at), last, np.arange(len(at)))
    while not np.array_equal(last[last], last):
        last = last[last]
    # The chain begins with its first hit; a later cell with any that an open window can end before.
    latest = at[0] if cell == 0 else chain.last_at[cell - 1] + period
    before = np.append(-_NEVER, at[:-1])
    entry = np.flatnonzero((at != before) & (before < latest))[: 1 if cell == 0 else None]
    end = last[entry]
    kept = np.append(end[1:] != end[:-1], True)
    entry, end = entry[kept], end[kept]
    same, ready = np.ones(len(end), np.int64), at[end] + period
    return {
        "chain": same * number, "cell": same * cell, "upto": at[entry], "anchor": at[end],
        "rank": chain.before[cell] + end, "ready": ready, "target": chain.cell_after(ready),
    }


def _classes(ranged: DataFrame, keys: list[str], chains: list[Chain], period: int) -> DataFrame:
    cells = {(p, c.key): (n, k) for n, c in enumerate(chains) for k, p in enumerate(c.parts)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None

        def closed() -> Iterator[pa.RecordBatch]:
            if held:
                number, cell = cells[current]
                found = classes_of(np.concatenate(held), chains[number], number, cell, period)
                yield pa.RecordBatch.from_pydict(found)
                held.clear()

        for part, batch in _by_part(batches):
            starts, at = run_starts(batch, keys), numbers(batch, "_at")
            # Only a batch's first and last key can be the part's.
            for k in sorted({0, len(starts) - 1}):
                key = (part, values_at(batch, keys, starts[k]))
                if key != current:
                    yield from closed()
                    current = key
                if key in cells:
                    held.append(at[starts[k] : starts[k + 1] if k + 1 < len(starts) else None])
        yield from closed()

    return ranged.mapInArrow(run, CLASS)


def _pointers(classes: DataFrame) -> DataFrame:
    """(chain, rank, next): the class in which the window after a class begins."""
    own = classes.select("chain", "cell", F.col("upto").alias("at"), F.lit(False).alias("asks"), "rank")
    asked = classes.select("chain", F.col("target").alias("cell"), F.col("ready").alias("at"), F.lit(True).alias("asks"), "rank")
    back = Window.partitionBy("chain", "cell").orderBy(F.col("at").desc(), "asks").rowsBetween(Window.unboundedPreceding, 0)
    nearest = F.last(F.when(~F.col("asks"), F.col("rank")), True).over(back)
    return own.unionByName(asked).withColumn("next", nearest).filter("asks and next is not null").select("chain", "rank", "next")


def _reached(classes: DataFrame, cells: int) -> DataFrame:
    """The classes that the first hits of the chains lead to, by doubling."""
    at = ["chain", "rank"]
    reached = classes.filter("cell = 0").select(*at)
    pointers = cut_plan(_pointers(classes))
    rounds = (cells - 1).bit_length()
    for k in range(rounds):
        further = reached.join(pointers, at).select("chain", F.col("next").alias("rank"))
        reached = cut_plan(reached.unionByName(further))
        if k + 1 < rounds:
            on = pointers.select("chain", F.col("rank").alias("next"), F.col("next").alias("after"))
            pointers = cut_plan(pointers.join(on, ["chain", "next"]).select(*at, F.col("after").alias("next")))
    return reached.join(classes, at).select("chain", "cell", "anchor", "rank")


class _Replay:
    """Windows of the hits of one part, batch by batch; ``carry`` is the key still open."""

    def __init__(self, keys: list[str], period: int, carry: tuple | None) -> None:
        self.keys, self.period = keys, period
        # (key, anchor's time, anchor's rank, rank of the next hit)
        self.carry = carry

    def windows(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(window_start, hit_no) of every row of a batch."""
        at, start = numbers(batch, "_at"), run_starts(batch, self.keys)
        offset = at - at[np.repeat(start, np.diff(np.append(start, len(at))))]
        stride = int(offset.max()) + self.period + 1
        if len(start) > 1 and stride > _NEVER // len(start):
            half = len(at) // 2
            parts = [self.windows(batch.slice(0, half)), self.windows(batch.slice(half))]
            return tuple(np.concatenate(p) for p in zip(*parts))
        rows, stop = np.arange(len(at)), np.append(start[1:], len(at))
        run = np.repeat(np.arange(len(start)), stop - start)
        # One increasing axis for all keys, with room for a window's length between them.
        axis = offset + run * stride
        following = np.searchsorted(axis, axis + self.period, side="left")
        rank, opener = rows - start[run], start.copy()
        goes_on = self.carry is not None and values_at(batch, self.keys, 0) == self.carry[0]
        anchor_at, anchor_rank = 0, 0
        if goes_on:
            _, anchor_at, anchor_rank, reached = self.carry
            rank[: stop[0]] += reached
            opener[0] = np.searchsorted(at[: stop[0]], anchor_at + self.period, side="left")
        opens = np.zeros(len(at), bool)
        inside = opener < stop
        now, end = opener[inside], stop[inside]
        while len(now):
            opens[now] = True
            now = following[now]
            inside = now < end
            now, end = now[inside], end[inside]
        anchor = np.maximum.accumulate(np.where(opens, rows, -1))
        own = anchor >= start[run]
        window_start = np.where(own, at[anchor], anchor_at)
        first = np.where(own, rank[anchor], anchor_rank)
        key = values_at(batch, self.keys, len(at) - 1)
        self.carry = (key, int(window_start[-1]), int(first[-1]), int(rank[-1]) + 1)
        return window_start, rank - first + 1


def _inherited(chains: list[Chain], reached: list[tuple]) -> dict[int, tuple]:
    """By part: (key, anchor's time, anchor's rank, rank) where its first key goes on."""
    visited: dict[int, dict[int, tuple]] = {}
    for chain, cell, anchor, rank in reached:
        visited.setdefault(chain, {})[cell] = (anchor, rank)
    out = {}
    for n, chain in enumerate(chains):
        window = None
        for cell, part in enumerate(chain.parts):
            if cell:
                out[part] = (chain.key, *window, int(chain.before[cell]))
            window = visited[n].get(cell, window)
    return out


def anchored_windows(
    hits: DataFrame, keys: list[str], ts: str, id_col: str, period_s: float, parts: int | None = None
) -> DataFrame:
    """(keys, ts, id, window_start, hit_no): the window of every hit.

    ``window_start`` is in epoch microseconds and ``hit_no`` counts from 1, the anchor; hits
    at one time follow ``id_col``.  Null keys are a key; hits without a time are left out.
    ``parts`` sets into how many parts the hits are dealt (the session's shuffle width unless
    given) and never changes a result.  What the driver sees is two rows a part.
    """
    period = int(period_s * 1_000_000)
    ranged = _parts(hits, keys, ts, id_col, parts)
    chains = chains_of(_edges(ranged, keys))
    carried: dict[int, tuple] = {}
    if chains:
        classes = cut_plan(_classes(ranged, keys, chains, period))
        # One class a cell at most.
        reached = _reached(classes, max(len(c.parts) for c in chains)).collect()
        carried = _inherited(chains, [tuple(r) for r in reached])
    passed = [*keys, ts, id_col]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_part, state = None, None
        for part, batch in _by_part(batches):
            if part != at_part:
                at_part, state = part, _Replay(keys, period, carried.get(part))
            window_start, hit_no = state.windows(batch)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in passed], pa.array(window_start), pa.array(hit_no)],
                names=[*passed, "window_start", "hit_no"],
            )

    result = T.StructType(
        [hits.schema[name] for name in passed]
        + [T.StructField("window_start", T.LongType()), T.StructField("hit_no", T.LongType())]
    )
    return ranged.mapInArrow(replay, result)


def quota_overflow(
    hits: DataFrame, keys: list[str], ts: str, id_col: str, capacity: int, period_s: float,
    parts: int | None = None,
) -> DataFrame:
    """Flags the hits beyond ``capacity`` of their window; refused hits still count."""
    return anchored_windows(hits, keys, ts, id_col, period_s, parts).withColumn(
        "refused", F.col("hit_no") > capacity
    )


def quota_by_clock(hits: DataFrame, keys: list[str], ts: str, capacity: int, period: str) -> DataFrame:
    """Clock-aligned form: hits and refusals per key and window."""
    return (
        hits.groupBy(*keys, F.window(F.col(ts).cast("timestamp"), period).alias("w"))
        .agg(F.count(F.lit(1)).alias("hits"))
        .select(
            *keys,
            micros(F.col("w.start")).alias("window_start"),
            "hits",
            F.greatest(F.col("hits") - capacity, F.lit(0)).alias("refused"),
        )
    )


def first_per_period(
    rows: DataFrame, keys: list[str], ts: str, id_col: str, period_s: float, parts: int | None = None
) -> DataFrame:
    """Keeps a row when at least ``period_s`` passed since the last kept row of its key.

    Returns (keys, ts, id) of the kept rows.
    """
    return (
        anchored_windows(rows, keys, ts, id_col, period_s, parts)
        .filter(F.col("hit_no") == 1)
        .drop("hit_no", "window_start")
    )
