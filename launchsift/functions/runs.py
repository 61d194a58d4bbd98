"""Runs of equal keys in sorted Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def values_at(batch: pa.RecordBatch, names: list[str], row: int) -> tuple:
    return tuple(batch.column(n)[int(row)].as_py() for n in names)


def run_starts(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """The rows at which a new key begins; nulls are equal to each other."""
    begins = np.ones(batch.num_rows, bool)
    if batch.num_rows > 1:
        begins[1:] = False
        for name in names:
            # As positions in the list of distinct values, nulls included.
            place = pc.dictionary_encode(batch.column(name), null_encoding="encode").indices.to_numpy()
            begins[1:] |= place[1:] != place[:-1]
    return np.flatnonzero(begins)
