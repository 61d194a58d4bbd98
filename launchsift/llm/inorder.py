"""Values of a key joined or hashed in order, however many rows the key has."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame


def run_starts(columns: list[pa.Array]) -> np.ndarray:
    """Rows at which any of the columns changes; two nulls are alike."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        after, before = c.slice(1), c.slice(0, max(n - 1, 0))
        differ = pc.fill_null(pc.not_equal(after, before), False)
        one_null = pc.xor(pc.is_null(after), pc.is_null(before))
        new[1:] |= pc.or_(differ, one_null).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def pieces(df: DataFrame, keys: list[str], order: list[str], value: str, gap: str) -> DataFrame:
    """(keys, part, seq, piece): the strings ``value`` of every key, joined in ``order``.

    Rows are dealt by ranges of (keys, order), so a key with most of the rows is spread over
    many tasks.  Each task joins what it has of a key, batch by batch; sorting the pieces by
    part and seq gives the order of the rows.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            columns = [batch.column(k) for k in keys]
            starts = run_starts(columns)
            ends = np.append(starts, batch.num_rows).astype(np.int32)
            values = batch.column(value).cast(pa.string())
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), values), gap)
            taken = [c.take(pa.array(starts)) for c in columns]
            same = np.ones(len(starts), np.int64)
            yield pa.RecordBatch.from_arrays(
                [*taken, pa.array(same * part), pa.array(same * seq), joined], names=[*keys, "part", "seq", "piece"]
            )

    ranged = df.select(*keys, *[o for o in order if o not in keys], value)
    ranged = ranged.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return ranged.mapInArrow(join, f"{kinds}, part bigint, seq bigint, piece string")


def digests(joined: DataFrame, keys: list[str], gap: str, name: str) -> DataFrame:
    """SHA-256 (lowercase hex) of all pieces of every key with ``gap`` between them.

    A digest is sequential, so the pieces of one key pass through one task; it holds one
    batch of them at a time.
    """
    kinds = ", ".join(f"`{k}` {joined.schema[k].dataType.simpleString()}" for k in keys)
    between = gap.encode()

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            rows = zip(*[batch.column(k).to_pylist() for k in keys])
            done = []
            for key, piece in zip(rows, batch.column("piece").to_pylist()):
                if digest is not None and key == last:
                    digest.update(between)
                else:
                    if digest is not None:
                        done.append((*last, digest.hexdigest()))
                    last, digest = key, hashlib.sha256()
                digest.update(piece.encode())
            if done:
                yield rows_of(done, batch)
        if digest is not None:
            yield rows_of([(*last, digest.hexdigest())], batch)

    def rows_of(done: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(zip(*done))
        arrays = [pa.array(c, like.schema.field(k).type) for k, c in zip(keys, columns)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[-1], pa.string())], names=[*keys, name])

    ordered = joined.repartition(*keys).sortWithinPartitions(*keys, "part", "seq")
    return ordered.mapInArrow(feed, f"{kinds}, `{name}` string")
