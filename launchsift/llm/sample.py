"""Bounded samples of labelled rows for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from launchsift.llm.common import written


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, per_class: bool) -> DataFrame:
    """(doc_id, text, label): at most ``rows`` labelled documents, a written table.

    The rows with the lowest hash of their id are taken, of either label as many as
    ``rows`` / 2 if ``per_class``.  Labels that are null or neither 0 nor 1, and ids labelled
    both ways or held by several documents, are left out.
    """
    clear = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("_high"))
        .filter("label = _high")
        .select("doc_id", "label", F.xxhash64("doc_id", F.lit(17)).alias("_order"))
    )
    order = ["_order", "doc_id"]
    if per_class:
        half = rows // 2
        ids = clear.filter("label = 1").orderBy(*order).limit(half).union(
            clear.filter("label = 0").orderBy(*order).limit(half)
        )
    else:
        ids = clear.orderBy(*order).limit(rows)
    chosen = written(ids.select("doc_id", "label"), "sample-ids")
    # The ids are at most ``rows``, so they are broadcast.
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    once = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text"), F.first("label").alias("label"))
    return written(once.filter("n = 1").select("doc_id", "text", "label"), "sample")


def fold(key: Column, folds: int) -> Column:
    """A fold from 0, by the CRC-32 of the key as text."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)).cast("int")
