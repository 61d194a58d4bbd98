"""Readers for feed pages, logs, envelopes, explorer extracts and snippets.

Collection (HTTP, RPC, browsers) happens elsewhere; these read what it stored.  Every
reader works on a batch path or, with ``stream=True``, on a growing folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from launchsift.functions.schemas import ENVELOPE, EXPLORER_ROWS, LOG_ENTRY
from launchsift.functions.text import strip

ITEMS = "array<string>"


# Messages are read in small batches; with one message per file this is the batch size.
BATCH_FILES = 16


def _reader(spark: SparkSession, stream: bool, files_per_trigger: int):
    if not stream:
        return spark.read
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger)


def page_items(page: Column) -> Column:
    """Items of a feed page: the root list, or the list under "items"; else null."""
    text = strip(page)
    nested = F.get_json_object(text, "$.items")
    return (
        F.when(text.startswith("["), F.from_json(text, ITEMS))
        .when(text.startswith("{") & nested.startswith("["), F.from_json(nested, ITEMS))
    )


def read_launch_feed(
    spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int = BATCH_FILES
) -> DataFrame:
    """(page, pos, item): one row per item of every stored feed page."""
    pages = _reader(spark, stream, files_per_trigger).option("wholetext", True).text(path)
    return pages.select(
        F.col("_metadata.file_name").alias("page"), F.posexplode(page_items(F.col("value")))
    ).withColumnRenamed("col", "item")


#: Folder column of stored logs: the block divided by the width of a range.
BLOCK_RANGE = "block_range"


def write_logs(logs: DataFrame, path: str, width: int = 10_000) -> None:
    """Appends log entries in folders of ``width`` blocks; entries without a block belong to none."""
    ranged = logs.filter("block is not null").withColumn(BLOCK_RANGE, F.expr(f"block div {width}"))
    ranged.write.mode("append").partitionBy(BLOCK_RANGE).parquet(path)


def logs_between(logs: DataFrame, last_block: int, latest_block: int, address: str, topic: str) -> DataFrame:
    """Log entries of one contract and event in blocks (last_block, latest_block]."""
    return logs.filter(
        (F.col("block") > last_block)
        & (F.col("block") <= latest_block)
        & (F.col("address") == address)
        & (F.try_element_at("topics", F.lit(1)) == topic)
    )


def read_logs_since(
    spark: SparkSession, path: str, last_block: int, latest_block: int, address: str, topic: str, width: int | None = None
) -> DataFrame:
    """``logs_between`` of stored logs; with the ``width`` of their ranges only those folders are read."""
    if width is None:
        return logs_between(spark.read.schema(LOG_ENTRY).parquet(path), last_block, latest_block, address, topic)
    stored = spark.read.schema(T.StructType([*LOG_ENTRY.fields, T.StructField(BLOCK_RANGE, T.LongType())])).parquet(path)
    ranges = F.col(BLOCK_RANGE).between((last_block + 1) // width, latest_block // width)
    return logs_between(stored.filter(ranges), last_block, latest_block, address, topic).drop(BLOCK_RANGE)


def decode_envelopes(lines: DataFrame, line: str = "value") -> DataFrame:
    """Envelope columns of JSON lines; ``raw`` keeps the text and bad lines give nulls.

    Absent ``upstream_ids`` are an empty list, a payload that is no JSON object is null, and
    ``extra_keys`` lists keys that an envelope does not have.
    """
    entries = F.try_variant_get(F.try_parse_json(line), "$", "map<string,variant>")
    read = lines.select(
        F.col(line).alias("raw"),
        F.from_json(line, ENVELOPE, {"mode": "PERMISSIVE"}).alias("e"),
        entries.alias("m"),
    )
    payload = F.try_element_at("m", F.lit("payload"))
    parents = F.try_element_at("m", F.lit("upstream_ids"))
    none, known = F.array().cast("array<string>"), F.array(*[F.lit(f.name) for f in ENVELOPE.fields])
    decoded = {f.name: F.col(f"e.{f.name}") for f in ENVELOPE.fields}
    decoded["payload"] = F.when(F.schema_of_variant(payload).startswith("OBJECT"), F.col("e.payload"))
    decoded["upstream_ids"] = F.when(F.col("m").isNotNull() & parents.isNull(), none).otherwise(F.col("e.upstream_ids"))
    return read.select(
        "raw",
        *[c.alias(n) for n, c in decoded.items()],
        F.coalesce(F.array_except(F.map_keys("m"), known), none).alias("extra_keys"),
    )


def read_envelopes(
    spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int = BATCH_FILES
) -> DataFrame:
    return decode_envelopes(_reader(spark, stream, files_per_trigger).text(path))


def explorer_rows(extracts: DataFrame, kind: str) -> DataFrame:
    """Rows of explorer answers given as (token_address, result text).

    A result that is not a list gives no rows and entries that are not objects are
    dropped; ``pos`` is the position in the answer.
    """
    result = strip(F.col("result"))
    listed = F.when(result.startswith("["), F.from_json(result, ITEMS))
    return (
        extracts.select("token_address", F.posexplode(listed).alias("pos", "_entry"))
        .filter(F.col("_entry").startswith("{"))
        .select("token_address", "pos", F.from_json("_entry", EXPLORER_ROWS[kind]).alias("e"))
        .select("token_address", "pos", "e.*")
    )


def read_explorer_extract(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Explorer answers stored as JSON lines {"token_address": ..., "result": ...}."""
    schema = "token_address STRING, result STRING"
    return explorer_rows(spark.read.schema(schema).json(path), kind)


def read_snippets(
    spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int = BATCH_FILES
) -> DataFrame:
    """(channel, pos, text) message extracts."""
    schema = "channel STRING, pos BIGINT, text STRING"
    return _reader(spark, stream, files_per_trigger).schema(schema).json(path)
