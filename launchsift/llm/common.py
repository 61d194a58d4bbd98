"""Helpers shared by the operators: shared-folder tables, words and row keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Between words of letters and digits; bytes above ASCII belong to words.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A table with at most so many narrow rows may be broadcast (about 20 MB in memory).
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which every executor sees.

    Only a local session without that setting gets a temporary folder of its own, which
    goes when the process ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="launchsift-llm-")
    atexit.register(shutil.rmtree, own, True)
    context.setCheckpointDir(own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: short lineage, survives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table marked for broadcast if its counted size allows it, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else untouched."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters; null and wordless text have none."""
    clean = F.coalesce(lower_ascii(text), F.lit(""))
    return F.array_remove(F.split(clean, WORD_GAP), "")


def text_key(text: Column) -> Column:
    """Tells texts under a repeated id apart; joined together with that id."""
    return F.coalesce(F.xxhash64(text), F.lit(0))


def sorted_digest(items: Column) -> Column:
    """SHA-256 of the comma-joined array in lowercase hex."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end the worker gives free Arrow memory back to the machine."""
    yield from batches
    pa.default_memory_pool().release_unused()


def packed(df: DataFrame) -> DataFrame:
    """All columns of ``df`` inside one column ``row``, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``row`` in order, some of them replaced."""
    return df.select(
        *[changed.get(c, F.col("row").getField(c)).alias(c) for c in columns]
    )
