"""Read queries over the stored findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from launchsift.functions.text import head, iso_utc
from launchsift.operators.envelope import hash_stored


def list_briefs(findings: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of narrator findings, newest first; ids break ties."""
    if not (1 <= limit <= 200 and offset >= 0):
        raise ValueError("limit must be 1 to 200 and offset not negative")
    return (
        findings.filter(F.col("agent") == "narrator")
        .orderBy(F.col("created_at").desc(), F.col("msg_id").desc())
        .offset(offset)
        .limit(limit)
    )


def get_finding(findings: DataFrame, msg_id) -> DataFrame:
    """The finding with this id, or no row."""
    return findings.filter(F.col("msg_id") == msg_id).withColumn(
        "created_at", iso_utc(F.col("created_at"))
    )


def verify_findings(findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Re-hashes every stored payload and compares it with the stored and ledger hash.

    ``ledger`` has one row per ``msg_id`` with ``ledger_hash``.  As the ledger check is
    against the stored hash, a changed payload shows as ``hash_match`` false alone.
    """
    found = ledger.select("msg_id", "ledger_hash")
    return (
        hash_stored(findings)
        .join(found, "msg_id", "left")
        .select(
            "msg_id",
            "local_hash",
            F.col("payload_hash").alias("stored_hash"),
            F.coalesce(F.col("local_hash") == F.col("payload_hash"), F.lit(False)).alias("hash_match"),
            F.col("ledger_hash").isNotNull().alias("on_chain_present"),
            F.coalesce(F.col("ledger_hash") == F.col("payload_hash"), F.lit(False)).alias(
                "on_chain_match"
            ),
        )
    )


def latest_briefs(findings: DataFrame, n: int = 5, width: int = 200) -> DataFrame:
    """Name, tier and opening of the newest briefs."""
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    return list_briefs(findings, n).select(
        "msg_id",
        F.coalesce(field("token_name"), F.lit("unknown")).alias("token_name"),
        F.coalesce(field("conviction_tier"), F.lit("?")).alias("conviction_tier"),
        head(F.coalesce(field("thesis"), F.lit("")), width).alias("thesis"),
    )


def filter_briefs(briefs: DataFrame, since: Column, tier: str | None = None) -> DataFrame:
    """Briefs created at or after ``since``, optionally of one tier."""
    recent = briefs.filter(F.col("created_at") >= since)
    return recent if tier is None else recent.filter(F.col("conviction_tier") == tier)


def recent_events(streams: dict[str, DataFrame], n: int = 100) -> DataFrame:
    """The newest ``n`` messages over all streams."""
    tagged = [
        df.select(F.lit(name).alias("stream"), "msg_id", "created_at")
        for name, df in streams.items()
    ]
    return (
        reduce(DataFrame.unionByName, tagged)
        .orderBy(F.col("created_at").desc(), "stream", F.col("msg_id").desc())
        .limit(n)
    )
