"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from launchsift.llm.common import packed, text_key

#: Hash bits that enter a score; 52 fit a double exactly.
BITS = 52
#: Parts in which the rows of one shard are numbered in parallel.
BUCKETS = 4096


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (from 0) with the highest score for ``key``.

    A shard's score depends on the key, its own number and its own weight alone:
    ``weight / -ln(u)`` with u uniform from MD5.  A shard is therefore chosen in proportion
    to its weight, a new shard takes rows only into itself, and one whose weight grows takes
    rows but gives none.  A weight of 0 keeps a shard empty.
    """
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must be at least 0 and not all 0")

    def score(shard: int, weight: float) -> Column:
        text = F.md5(F.concat_ws(":", key, F.lit(str(shard))).cast("binary"))
        whole = F.conv(F.substring(text, 1, BITS // 4), 16, 10).cast("double")
        return F.lit(float(weight)) / -F.log((whole + 0.5) / float(2**BITS))

    scored = [
        F.struct(score(s, w).alias("score"), F.lit(-s).alias("minus"))
        for s, w in enumerate(weights)
        if w > 0
    ]
    best = scored[0] if len(scored) == 1 else F.greatest(*scored)
    return (-best["minus"]).cast("int")


def numbered(df: DataFrame, group: str, bucket: str, order: list[str], name: str) -> DataFrame:
    """Adds gapless numbers from 0 inside every ``group``, ordered by ``bucket``, then ``order``.

    Rows are numbered per (group, bucket) in parallel; what precedes a bucket comes from
    counts, of which there are groups times buckets.
    """
    sizes = df.groupBy(group, bucket).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        group, bucket, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(group, bucket).orderBy(*order)
    return (
        df.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(offsets, [group, bucket])
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_before", "_inside")
    )


def shard_documents(docs: DataFrame, weights: list[float]) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 1 (null has none).  ``shard`` follows from doc_id
    and the weights alone (law ``key``), so rows that repeat a doc_id share a shard and a null
    doc_id is a key of its own; ``grown_shard`` is the shard with one more of mean weight.
    ``slot`` counts the rows of a shard from 0.  Equal texts keep no company: their ids decide.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    mean = sum(weights) / len([w for w in weights if w > 0])
    text = F.col("row.text")
    placed = packed(docs).select(
        F.col("row.doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        # By id and text: rows without id, or with the same one, are numbered in several tasks.
        F.pmod(F.xxhash64("row.doc_id", text_key(text)), F.lit(BUCKETS)).cast("int").alias("_bucket"),
    ).select(
        "*",
        F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, mean]).alias("grown_shard"),
    )
    order = ["doc_id", "text_crc32", "size"]
    return numbered(placed, "shard", "_bucket", order, "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def write_shards(docs: DataFrame, weights: list[float], path: str, rows_per_file: int = 1_000_000) -> None:
    """Writes the documents with their ``shard`` as Parquet, one folder per shard.

    A shard is split into several write tasks by the key's hash, so that none holds a whole
    shard; ``rows_per_file`` bounds each file.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    (
        docs.withColumn("shard", rendezvous(key, weights))
        .repartition(int(parts), "shard", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
        .write.option("maxRecordsPerFile", rows_per_file)
        .partitionBy("shard")
        .parquet(path)
    )
