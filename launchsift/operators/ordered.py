"""Per-key ordered computations cut into time buckets.

A plain window over a key sorts all rows of that key in one task.  Here each key is
cut into time buckets: a window runs inside (key, bucket), one summary row per bucket
is combined along the key, and the summary is joined back on (key, bucket).  The rows
are shuffled once; later steps reuse the same distribution.  Results equal the plain
window for any bucket width, so the width is purely a sizing knob.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from launchsift.functions.text import micros

BUCKET = "_bucket"
DAY_S = 86_400


def bucket_of(ts: Column, width_s: float) -> Column:
    return F.floor(micros(ts) / F.lit(int(width_s * 1_000_000))).cast("bigint")


@dataclass(frozen=True)
class Step:
    """One result: inside its cell, as summary of the cell, and carried along the key."""

    name: str
    near: Column
    edge: Column
    carried: Column
    merge: Callable[[Column, Column], Column]


class OrderedKeys:
    """Ordered view of ``df``: rows of a key follow ``order`` (timestamp first).

    Steps are collected and answered together by one pass: one window inside the cells,
    one summary row per cell taken from the cell's last row, one join.  A step whose
    value uses an earlier result starts a second pass.  ``bucket`` replaces the time
    bucket where the first order column is not a timestamp; it must never decrease along
    the order.
    """

    def __init__(
        self, df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket_s: float = DAY_S,
        bucket: Column | None = None,
    ) -> None:
        self.keys = list(keys)
        self.order = list(order)
        self.steps: list[Step] = []
        if bucket is None:
            bucket = bucket_of(F.col(self.order[0]), bucket_s)
        self.df = df.withColumn(BUCKET, bucket)

    def _step(self, name: str, near: Column, edge: Column, carried: Column, merge) -> OrderedKeys:
        self.steps.append(Step(name, near, edge, carried, merge))
        return self

    def _windows(self):
        cell = [*self.keys, BUCKET]
        inside = Window.partitionBy(*cell).orderBy(*self.order)
        across = Window.partitionBy(*self.keys).orderBy(BUCKET)
        return inside, across

    def previous(self, name: str, value: Column) -> OrderedKeys:
        """``value`` of the row before, null on the first row of a key."""
        inside, across = self._windows()
        boxed, edge = F.struct(value.alias("v")), F.col(f"_edge_{name}")
        return self._step(
            name, F.lag(boxed).over(inside), boxed, F.lag(edge).over(across),
            lambda near, far: F.coalesce(near, far)["v"],
        )

    def following(self, name: str, value: Column) -> OrderedKeys:
        """``value`` of the row after, null on the last row of a key."""
        inside, across = self._windows()
        boxed, edge = F.struct(value.alias("v")), F.col(f"_edge_{name}")
        whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return self._step(
            name, F.lead(boxed).over(inside), F.first(boxed).over(whole), F.lead(edge).over(across),
            lambda near, far: F.coalesce(near, far)["v"],
        )

    def running(self, name: str, amount: Column) -> OrderedKeys:
        """Sum of ``amount`` up to and including the row."""
        inside, across = self._windows()
        upto = inside.rowsBetween(Window.unboundedPreceding, 0)
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        near, zero = F.sum(amount).over(upto), F.lit(0)
        return self._step(
            name, near, near, F.sum(f"_edge_{name}").over(before),
            lambda near, far: F.coalesce(near, zero) + F.coalesce(far, zero),
        )

    def latest(self, name: str, value: Column) -> OrderedKeys:
        """Last non-null ``value`` up to and including the row."""
        inside, across = self._windows()
        upto = inside.rowsBetween(Window.unboundedPreceding, 0)
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        near = F.last(value, True).over(upto)
        return self._step(
            name, near, near, F.last(f"_edge_{name}", True).over(before), F.coalesce
        )

    def upcoming(self, name: str, value: Column) -> OrderedKeys:
        """First non-null ``value`` after the row."""
        inside, across = self._windows()
        ahead = inside.rowsBetween(1, Window.unboundedFollowing)
        whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        after = across.rowsBetween(1, Window.unboundedFollowing)
        return self._step(
            name, F.first(value, True).over(ahead), F.first(value, True).over(whole),
            F.first(f"_edge_{name}", True).over(after), F.coalesce,
        )

    def with_column(self, name: str, value: Column) -> OrderedKeys:
        """Adds a plain column, which later steps may use."""
        self._answer()
        self.df = self.df.withColumn(name, value)
        return self

    def _answer(self) -> None:
        if not self.steps:
            return
        cell, (inside, _) = [*self.keys, BUCKET], self._windows()
        near = self.df.withColumns(
            {f"_near_{s.name}": s.near for s in self.steps}
            | {f"_edge_{s.name}": s.edge for s in self.steps}
            | {"_more": F.lead(F.lit(True)).over(inside)}
        )
        edges = [f"_edge_{s.name}" for s in self.steps]
        summary = near.filter(F.col("_more").isNull()).select(*cell, *edges).select(
            *cell, *[s.carried.alias(f"_far_{s.name}") for s in self.steps]
        )
        merged = near.drop("_more", *edges).join(summary, cell, "left").withColumns(
            {s.name: s.merge(F.col(f"_near_{s.name}"), F.col(f"_far_{s.name}")) for s in self.steps}
        )
        helpers = [f"_{side}_{s.name}" for s in self.steps for side in ("near", "far")]
        self.df, self.steps = merged.drop(*helpers), []

    def rows(self) -> DataFrame:
        self._answer()
        return self.df.drop(BUCKET)


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    back_s: float,
    aggregates: dict[str, Column],
    bucket_s: float = DAY_S,
) -> DataFrame:
    """Counts over the ``back_s`` seconds up to and including each row.

    Only the rows in the last ``back_s`` of a bucket are repeated, as context for the
    next bucket, so a key with most of the rows is still spread over its buckets.  A
    count is that of all rows of the cell up to a row less that of the rows out of reach:
    both frames only grow, where a sliding frame is summed anew for every row.
    ``aggregates`` are counts, or sums of whole numbers without nulls.
    """
    if back_s > bucket_s:
        raise ValueError("the look-back must not exceed the bucket width")
    width, back = int(bucket_s * 1_000_000), int(back_s * 1_000_000)
    home = bucket_of(F.col(ts), bucket_s)
    at = micros(F.col(ts))
    near_end = at >= (home + 1) * width - back
    spread = (
        df.withColumn("_at", at)
        .withColumn("_home", home)
        .withColumn(
            BUCKET,
            F.explode(
                F.when(near_end, F.array(F.col("_home"), F.col("_home") + 1))
                .otherwise(F.array(F.col("_home")))
            ),
        )
    )
    inside = Window.partitionBy(*keys, BUCKET).orderBy("_at")
    upto = inside.rangeBetween(Window.unboundedPreceding, 0)
    gone = inside.rangeBetween(Window.unboundedPreceding, -back - 1)
    for name, value in aggregates.items():
        spread = spread.withColumn(name, value.over(upto) - F.coalesce(value.over(gone), F.lit(0)))
    return spread.filter(F.col(BUCKET) == F.col("_home")).drop(BUCKET, "_home", "_at")


def newest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, bucket_s: float = DAY_S
) -> DataFrame:
    """The newest ``n`` rows of every key, for an ``n`` too large to rank directly.

    Row counts per (key, bucket) tell which buckets are kept whole and which single
    bucket is cut; only rows of the cut bucket are ranked.
    """
    keys, order = list(keys), list(order)
    cell = [*keys, BUCKET]
    rows = df.withColumn(BUCKET, bucket_of(F.col(order[0]), bucket_s))
    newer = (
        Window.partitionBy(*keys).orderBy(F.col(BUCKET).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).select(
        *cell, "_n", F.coalesce(F.sum("_n").over(newer), F.lit(0)).alias("_newer")
    )
    whole = cells.filter(F.col("_newer") + F.col("_n") <= n).select(*cell)
    cut = cells.filter(
        (F.col("_newer") < n) & (F.col("_newer") + F.col("_n") > n)
    ).select(*cell, (F.lit(n) - F.col("_newer")).alias("_room"))
    rank = F.row_number().over(
        Window.partitionBy(*cell).orderBy(*[F.col(c).desc() for c in order])
    )
    partly = (
        rows.join(cut, cell).withColumn("_rank", rank)
        .filter(F.col("_rank") <= F.col("_room")).drop("_rank", "_room")
    )
    return rows.join(whole, cell, "left_semi").unionByName(partly).drop(BUCKET)
