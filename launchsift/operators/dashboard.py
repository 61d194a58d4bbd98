"""Aggregates behind the dashboard panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from launchsift.functions import schemas
from launchsift.functions.schemas import LONG, TEXT, TEXTS, struct
from launchsift.functions.text import computed_once, micros
from launchsift.operators.validate import validate_envelopes, validate_payload

HOURS = 24


def activity_24h(briefs: DataFrame, now: Column, created: str = "created_at") -> DataFrame:
    """24 hourly counts back from ``now`` (bucket 23 is the latest hour), zero-filled.

    ``created`` may be a text; unreadable and future times are skipped.  ``height_pct``
    is relative to the fullest hour.
    """
    if dict(briefs.dtypes)[created] == "string":
        at = F.try_to_timestamp(F.col(created))
    else:
        at = F.col(created)
    age = F.floor((micros(now) - micros(at)) / 3_600_000_000)
    counted = (
        briefs.select(age.alias("_age"))
        .filter(F.col("_age").between(0, HOURS - 1))
        .groupBy("_age")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select((F.lit(HOURS - 1) - F.col("_age")).alias("bucket"), "_n")
    )
    # All that follows works on 24 rows.
    slots = briefs.sparkSession.range(HOURS).select(F.col("id").alias("bucket"))
    filled = slots.join(counted, "bucket", "left").select(
        "bucket", F.coalesce("_n", F.lit(0)).alias("briefs")
    )
    everything = F.struct("bucket", "briefs")
    return (
        filled.agg(
            F.collect_list(everything).alias("_rows"),
            F.greatest(F.lit(1), F.max("briefs")).alias("_max"),
            F.sum("briefs").alias("total"),
        )
        .select(F.inline("_rows"), "_max", "total")
        .select("bucket", "briefs", (F.col("briefs") / F.col("_max") * 100).alias("height_pct"), "total")
    )


def model_usage(briefs: DataFrame) -> DataFrame:
    """Uses of every model over all briefs and their rounded share, most used first."""
    counts = (
        briefs.select(F.explode("model_attribution").alias("model"))
        .groupBy("model")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    total = briefs.agg(F.sum(F.greatest(F.size("model_attribution"), F.lit(0)))).scalar()
    share = F.floor(F.col("uses") / total * 100 + 0.5).cast("bigint")
    return counts.select("model", "uses", share.alias("percent")).orderBy(
        F.col("uses").desc(), "model"
    )


FRAME = struct(
    msg_id=TEXT, payload=TEXT, payload_hash=TEXT, upstream_ids=TEXTS, model_used=TEXT,
    created_at=TEXT, on_chain_tx=TEXT, on_chain_block=LONG,
)


def parse_frames(frames: DataFrame, frame: str = "frame", newest: int | None = None) -> DataFrame:
    """Well-formed brief frames; greetings and malformed texts are ignored.

    The thesis length is not checked here: the live view also shows short ones.  With
    ``newest`` only that many are returned, newest first, without sorting the rest.
    """
    parsed = (
        computed_once(frames, "_f", F.from_json(frame, FRAME)).select("_f.*")
        .filter(F.col("msg_id").isNotNull() & F.col("payload").isNotNull())
        .withColumn("agent", F.lit("narrator"))
    )
    kept = validate_envelopes(parsed).filter(F.size("errors") == 0).drop("errors", "agent")
    short_thesis_only = F.size(F.array_except("errors", F.array(F.lit("thesis")))) == 0
    briefs = (
        validate_payload(kept, "brief", keep="brief")
        .filter(short_thesis_only & F.col("brief.thesis").isNotNull())
        .drop("errors", "payload")
    )
    if newest is None:
        return briefs
    return briefs.orderBy(F.col("created_at").desc(), F.col("msg_id").desc()).limit(newest)
