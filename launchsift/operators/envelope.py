"""Building, hashing, storing and de-duplicating envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from launchsift.functions.canonical import (
    canonical_struct,
    canonical_text,
    derived_id,
    sha256_hex,
)
from launchsift.functions.streaming_digest import digest_ordered_turns


def build_envelopes(
    rows: DataFrame,
    agent: str,
    payload: T.StructType,
    now_iso: str,
    upstream_ids: Column | None = None,
    model_used: Column | None = None,
) -> DataFrame:
    """Seals typed payload columns into envelopes with content-derived ids."""
    upstream = F.array().cast("array<string>") if upstream_ids is None else upstream_ids
    model = F.lit(None).cast("string") if model_used is None else model_used
    text = canonical_struct(payload)
    return (
        rows.select(upstream.alias("upstream_ids"), text.alias("payload"), model.alias("model_used"))
        .withColumn("payload_hash", sha256_hex(F.col("payload")))
        .select(
            derived_id(F.lit(agent), F.col("upstream_ids"), F.col("payload_hash")).alias("msg_id"),
            F.lit(agent).alias("agent"),
            "upstream_ids",
            "payload_hash",
            "payload",
            F.lit(now_iso).alias("created_at"),
            "model_used",
        )
    )


def hash_payloads(rows: DataFrame, payload: T.StructType) -> DataFrame:
    """Adds ``canonical`` and ``payload_hash`` computed from typed columns."""
    return rows.withColumn("canonical", canonical_struct(payload)).withColumn(
        "payload_hash", sha256_hex(F.col("canonical"))
    )


def hash_stored(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``local_hash`` of payloads stored as arbitrary JSON text."""
    return rows.withColumn("local_hash", sha256_hex(canonical_text(F.col(payload))))


def dedup_by_hash(rows: DataFrame, order: list[str], hash_col: str = "payload_hash") -> DataFrame:
    """First row of every hash and the number of its copies."""
    row = F.struct(*[c for c in rows.columns if c != hash_col])
    return (
        rows.groupBy(hash_col)
        .agg(
            F.min_by(row, F.struct(*order)).alias("_first"),
            (F.count(F.lit(1)) - 1).alias("copies"),
        )
        .select(hash_col, "_first.*", "copies")
    )


def append_findings(
    incoming: DataFrame, stored: DataFrame, arrival: list[str], key: str = "msg_id"
) -> DataFrame:
    """Rows to insert: the first arrival of every id that is not stored yet."""
    row = F.struct(*[c for c in incoming.columns if c != key])
    first = (
        incoming.groupBy(key)
        .agg(F.min_by(row, F.struct(*arrival)).alias("_row"))
        .select(key, "_row.*")
    )
    return first.join(stored.select(key), key, "left_anti")


def attach_receipts(findings: DataFrame, receipts: DataFrame, order: list[str]) -> DataFrame:
    """Findings with the transaction and block of their latest receipt."""
    latest = receipts.groupBy("msg_id").agg(
        F.max_by(F.struct("on_chain_tx", "on_chain_block"), F.struct(*order)).alias("_r")
    ).select("msg_id", "_r.*")
    base = findings.drop("on_chain_tx", "on_chain_block")
    return base.join(latest, "msg_id", "left")


def prompt_hash(turns: DataFrame, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """SHA-256 of the system text and then the ordered messages of each prompt.

    The sorted rows of every prompt run through one digest, so memory stays at one batch
    whatever a prompt's size.  Turns without role or text add nothing.
    """
    pieces = turns.select(
        conversation,
        (F.col("role") != "system").cast("int").alias("_part"),
        F.col(order).alias("_turn"),
        F.coalesce(
            F.concat(F.col("role"), F.lit("\0"), F.col("text"), F.lit("\0")), F.lit("")
        ).alias("_piece"),
    )
    return digest_ordered_turns(pieces, conversation, ["_part", "_turn", "_piece"], "_piece")
