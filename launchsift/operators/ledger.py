"""Audit of an append-only ledger: who may write, which write counts, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from launchsift.operators.ordered import OrderedKeys
from launchsift.operators.skew import split_count

ZERO32 = bytes(32)
POSITION = ["block", "idx"]
BLOCKS_PER_BUCKET = 100_000


def ledger_key(msg_id: Column) -> Column:
    """Message id as 32 bytes, padded with zeros on the right."""
    return F.rpad(msg_id.cast("binary"), 32, F.lit(b"\x00"))


def ledger_hash(hex_text: Column) -> Column:
    return F.when(F.length(hex_text) == 64, F.unhex(hex_text))


def _block_range(blocks_per_bucket: int) -> Column:
    return F.floor(F.col("block") / blocks_per_bucket).cast("bigint")


def allowlist_asof(
    attempts: DataFrame, grants: DataFrame, owner: str, blocks_per_bucket: int = BLOCKS_PER_BUCKET
) -> DataFrame:
    """Adds ``is_agent``: the last grant or revoke of the sender before each attempt.

    ``grants`` has (sender, granted, block, idx).  The owner is granted from the start.
    """
    changes = grants.select("sender", "block", "idx", F.col("granted").alias("_granted"))
    marked = attempts.withColumn("_granted", F.lit(None).cast("boolean")).withColumn(
        "_attempt", F.lit(True)
    )
    timeline = marked.unionByName(changes, allowMissingColumns=True)
    scan = OrderedKeys(
        timeline, ["sender"], POSITION,
        bucket=_block_range(blocks_per_bucket),
    ).latest("_state", F.col("_granted"))
    return (
        scan.rows()
        .filter(F.col("_attempt"))
        .withColumn("is_agent", F.coalesce(F.col("_state"), F.col("sender") == owner))
        .drop("_granted", "_attempt", "_state")
    )


def _refusal() -> Column:
    """First broken rule of an attempt, before looking at earlier writes."""
    zero = F.lit(ZERO32)
    return (
        F.when(~F.col("is_agent"), F.lit("NotAgent"))
        .when(F.col("msg_id") == zero, F.lit("ZeroMsgId"))
        .when(F.col("payload_hash") == zero, F.lit("ZeroPayloadHash"))
        .when(F.length("agent") == 0, F.lit("EmptyAgent"))
    )


def ledger_of(attempts: DataFrame) -> DataFrame:
    """The ledger: for every id the first write that breaks no rule."""
    row = F.struct("payload_hash", "agent", "block", "idx")
    return (
        attempts.filter(_refusal().isNull())
        .groupBy("msg_id")
        .agg(F.min_by(row, F.struct(*POSITION)).alias("_row"))
        .select("msg_id", "_row.*")
    )


def merge_ledger(attempts: DataFrame, blocks_per_bucket: int = BLOCKS_PER_BUCKET) -> DataFrame:
    """Adds ``outcome`` to every attempt: ``Recorded`` or the reason of its refusal.

    An id that is replayed very often is cut by block ranges, so counting its valid
    writes in order is spread like any other work.
    """
    good = _refusal().isNull()
    # Refused attempts, such as all those with the zero id, count for nothing in the order and
    # are spread at will.
    spread = F.pmod(F.xxhash64(*POSITION), F.lit(split_count(attempts))).cast("int")
    parted = attempts.withColumn("_part", F.when(good, F.lit(-1)).otherwise(spread))
    scan = OrderedKeys(
        parted, ["msg_id", "_part"], POSITION, bucket=_block_range(blocks_per_bucket)
    ).running("_valid_no", F.when(good, F.lit(1)))
    write = F.when(F.col("_valid_no") == 1, F.lit("Recorded")).otherwise(F.lit("AlreadyRecorded"))
    return scan.rows().withColumn("outcome", F.coalesce(_refusal(), write)).drop("_valid_no", "_part")


def lookup_ledger(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every finding with its ledger record; an unknown id gives nulls and ``exists`` false."""
    record = ledger.select(
        F.col("msg_id").alias("_key"),
        F.col("payload_hash").alias("_hash"),
        F.col("agent").alias("ledger_agent"),
        F.col("block").alias("ledger_block"),
    )
    keyed = findings.withColumn("_key", ledger_key(F.col("msg_id")))
    return keyed.join(record, "_key", "left").select(
        *findings.columns,
        F.lower(F.hex("_hash")).alias("ledger_hash"),
        "ledger_agent",
        "ledger_block",
        F.col("_hash").isNotNull().alias("exists"),
    )


def existing(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Only the findings that have a ledger record."""
    keys = ledger.select(F.col("msg_id").alias("_key"))
    keyed = findings.withColumn("_key", ledger_key(F.col("msg_id")))
    return keyed.join(keys, "_key", "left_semi").drop("_key")


def pending_anchors(
    findings: DataFrame, ledger: DataFrame, oldest: int | None = None
) -> DataFrame:
    """Findings without a ledger record; with ``oldest`` only that many, oldest first."""
    keys = ledger.select(F.col("msg_id").alias("_key"))
    keyed = findings.withColumn("_key", ledger_key(F.col("msg_id")))
    open_ones = keyed.join(keys, "_key", "left_anti").drop("_key")
    if oldest is None:
        return open_ones
    return open_ones.orderBy("created_at", "msg_id").limit(oldest)
