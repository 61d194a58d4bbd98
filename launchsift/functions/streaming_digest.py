"""SHA-256 over a sorted group without assembling the group."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def digest_ordered_turns(
    pieces: DataFrame, key: str, order: list[str], piece: str, out: str = "prompt_hash"
) -> DataFrame:
    """One digest per key over ``piece`` in ``order``, fed batch by batch."""
    key_type = pieces.schema[key].dataType.simpleString()

    def feed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, digest = None, None
        for batch in batches:
            done = []
            for value, part in batch.groupby(key, sort=False, dropna=False):
                value = None if pd.isna(value) else value
                if digest is not None and value != current:
                    done.append((current, digest.hexdigest()))
                    digest = None
                if digest is None:
                    current, digest = value, hashlib.sha256()
                for text in part[piece]:
                    digest.update(text.encode("utf-8"))
            if done:
                yield pd.DataFrame(done, columns=[key, out])
        if digest is not None:
            yield pd.DataFrame([(current, digest.hexdigest())], columns=[key, out])

    ordered = pieces.repartition(F.col(key)).sortWithinPartitions(key, *order)
    return ordered.mapInPandas(feed, f"{key} {key_type}, {out} string")
