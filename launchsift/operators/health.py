"""Heartbeats, counters, stream depth, latency and completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from launchsift.functions.constants import AGENTS, BEAT_SECONDS, LATENCY_BOUNDS, STREAM_KEEP
from launchsift.functions.text import micros
from launchsift.operators.ordered import DAY_S, OrderedKeys, newest_per_key


def latest_heartbeats(log: DataFrame, order: Sequence[str] = ("last_seen",)) -> DataFrame:
    """Last heartbeat of every agent, sorted by agent."""
    row = F.struct(*[c for c in log.columns if c != "agent"])
    return (
        log.groupBy("agent")
        .agg(F.max_by(row, F.struct(*order)).alias("_row"))
        .select("agent", "_row.*")
        .orderBy("agent")
    )


def overall_status(heartbeats: DataFrame) -> DataFrame:
    """One row: ok only if there are agents and all are online."""
    online = F.col("status") == "online"
    return heartbeats.agg(
        F.count_if(online).alias("online"),
        F.count(F.lit(1)).alias("agents"),
        F.coalesce(F.bool_and(F.coalesce(online, F.lit(False))), F.lit(False)).alias("_ok"),
    ).select(
        F.when(F.col("_ok"), F.lit("ok")).otherwise(F.lit("degraded")).alias("status"),
        "online",
        "agents",
    )


def events_per_beat(events: DataFrame, beats: DataFrame, bucket_s: float = 3600) -> DataFrame:
    """Processed events of each agent since the heartbeat before.

    ``events`` has (agent, ts), ``beats`` (agent, ts).  An event at the very time of a
    beat still belongs to it.
    """
    timeline = events.select("agent", "ts", F.lit(0).alias("_beat")).unionByName(
        beats.select("agent", "ts", F.lit(1).alias("_beat"))
    )
    scan = OrderedKeys(timeline, ["agent"], ["ts", "_beat"], bucket_s).upcoming(
        "_next", F.when(F.col("_beat") == 1, micros(F.col("ts")))
    )
    rows = scan.rows()
    own = F.when(F.col("_beat") == 1, micros(F.col("ts"))).otherwise(F.col("_next"))
    return (
        rows.withColumn("beat_at", own)
        .filter(F.col("beat_at").isNotNull())
        .groupBy("agent", "beat_at")
        .agg(F.count_if(F.col("_beat") == 0).alias("events"))
    )


def events_per_slot(events: DataFrame, seconds: int = BEAT_SECONDS) -> DataFrame:
    """Clock-aligned form of :func:`events_per_beat`."""
    return (
        events.groupBy("agent", F.window(F.col("ts").cast("timestamp"), f"{seconds} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select("agent", micros(F.col("w.start")).alias("slot_start"), "events")
    )


def event_counters(events: DataFrame) -> DataFrame:
    """Processed and failed events per agent."""
    return events.groupBy("agent").agg(
        F.count_if(F.col("success")).alias("processed"),
        F.count_if(~F.col("success")).alias("failed"),
    )


def processing_histogram(
    events: DataFrame, bounds: Sequence[float] = LATENCY_BOUNDS
) -> DataFrame:
    """Cumulative counts per agent and upper bound, with an open last bucket."""
    counts = [F.count_if(F.col("seconds") <= b).alias(f"_{i}") for i, b in enumerate(bounds)]
    row = events.groupBy("agent").agg(*counts, F.count(F.lit(1)).alias("_all"))
    pairs = [
        F.struct(F.lit(str(b)).alias("le"), F.col(f"_{i}").alias("events"))
        for i, b in enumerate(bounds)
    ]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("events")))
    return row.select("agent", F.inline(F.array(*pairs)))


def pending_depth(delivered: DataFrame, acks: DataFrame) -> DataFrame:
    """Delivered but unacknowledged entries per stream and group."""
    key = ["stream", "group", "entry_id"]
    open_entries = delivered.select(*key).distinct().join(acks.select(*key), key, "left_anti")
    return open_entries.groupBy("stream", "group").agg(F.count(F.lit(1)).alias("pending"))


def stream_length(entries: DataFrame) -> DataFrame:
    return entries.groupBy("stream").agg(F.count(F.lit(1)).alias("length"))


def retain_last(
    entries: DataFrame, n: int = STREAM_KEEP, order: Sequence[str] = ("ts", "entry_id"),
    bucket_s: float = DAY_S,
) -> DataFrame:
    """The newest ``n`` entries of every stream."""
    return newest_per_key(entries, ["stream"], order, n, bucket_s)


def stage_gaps(findings: DataFrame) -> DataFrame:
    """(stage, seconds) from each parent to each of its children."""
    child = findings.select(
        F.col("agent").alias("stage"), "created_at", F.explode("upstream_ids").alias("_parent")
    )
    parent = findings.select(F.col("msg_id").alias("_parent"), F.col("created_at").alias("_from"))
    return child.join(parent, "_parent").select(
        "stage",
        F.floor((micros(F.col("created_at")) - micros(F.col("_from"))) / 1_000_000).alias("seconds"),
    )


def stage_latency(gaps: DataFrame, by: str = "stage") -> DataFrame:
    """Median and 95th percentile per stage from whole-second counts.

    Counting equal values first keeps the exact percentile's memory at the number of
    distinct seconds instead of the number of messages.
    """
    counted = gaps.groupBy(by, "seconds").agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(by).agg(
        F.sum("_n").alias("messages"),
        F.percentile("seconds", 0.5, F.col("_n")).alias("p50"),
        F.percentile("seconds", 0.95, F.col("_n")).alias("p95"),
    )


def end_to_end_latency(closure: DataFrame, findings: DataFrame) -> DataFrame:
    """(stage, seconds) from the root candidate to each start of ``closure``."""
    first, last = AGENTS[0], AGENTS[-1]
    times = findings.select("msg_id", "created_at", "agent")
    rows = closure.select("start_id", "msg_id").join(times, "msg_id")
    ends = rows.groupBy("start_id").agg(
        F.min(F.when(F.col("agent") == first, micros(F.col("created_at")))).alias("_from"),
        F.max(F.when(F.col("msg_id") == F.col("start_id"), micros(F.col("created_at")))).alias("_to"),
    )
    return ends.filter(F.col("_from").isNotNull()).select(
        F.lit(f"{first} to {last}").alias("stage"),
        F.floor((F.col("_to") - F.col("_from")) / 1_000_000).alias("seconds"),
    )


def lost_candidates(candidates: DataFrame, closure: DataFrame) -> DataFrame:
    """Candidates that do not lead to exactly one final message.

    ``closure`` is the lineage of the final messages; ``candidates`` has ``msg_id``.
    """
    reached = closure.select("start_id", "msg_id").distinct().groupBy("msg_id").agg(
        F.count(F.lit(1)).alias("_finals")
    )
    return (
        candidates.select("msg_id")
        .join(reached, "msg_id", "left")
        .withColumn("finals", F.coalesce("_finals", F.lit(0)))
        .filter(F.col("finals") != 1)
        .select("msg_id", "finals")
    )
