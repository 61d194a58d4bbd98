"""Launch feed and log decoding, cursors, candidate defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from launchsift.functions.constants import (
    DEFAULT_SOURCE_URL,
    ONCHAIN_NAME,
    TX_URL,
    UNKNOWN_NAME,
    UNKNOWN_SYMBOL,
)
from launchsift.functions.schemas import FEED_ITEM
from launchsift.functions.text import blank_to_null, computed_once, strip
from launchsift.operators.skew import skew_join

REQUIRED = ("address", "creator", "name", "symbol")


def decode_feed_items(items: DataFrame, item: str = "item") -> DataFrame:
    """Typed launch rows from feed items given as JSON object texts.

    Non-objects, items without a required key and items whose liquidity is not a number
    are dropped; absent optional fields become empty.  Other columns pass through.
    """
    text = strip(F.col(item))
    keys = F.json_object_keys(text)
    present = F.lit(True)
    for name in REQUIRED:
        present = present & F.array_contains(keys, name)
    value = F.from_json(text, FEED_ITEM)
    rows = computed_once(items.filter(text.startswith("{") & present), "_v", value)
    v = F.col("_v")
    required = {n: F.coalesce(v[n], F.lit("None")) for n in REQUIRED}
    liquidity_text = strip(F.coalesce(v["liquidityUsd"], F.lit("")))
    liquidity = F.when(
        liquidity_text.isin("", "false"), F.lit(0.0)
    ).otherwise(liquidity_text.try_cast("double"))
    return (
        rows.withColumn("initial_liquidity_usd", liquidity)
        .filter(F.col("initial_liquidity_usd").isNotNull())
        .select(
            *[c for c in items.columns if c != item],
            F.lower(required["address"]).alias("token_address"),
            F.lower(required["creator"]).alias("creator_address"),
            required["name"].alias("token_name"),
            required["symbol"].alias("token_symbol"),
            "initial_liquidity_usd",
            F.coalesce(v["launchedAt"], F.lit("")).alias("launch_timestamp"),
            F.coalesce(v["url"], F.lit("")).alias("source_url"),
        )
    )


def new_since_cursor(pages: DataFrame, cursors: DataFrame, feed: str = "feed") -> DataFrame:
    """Rows of newest-first pages that precede the last seen address of their feed.

    ``pages`` has (feed, pos, token_address, ...), ``cursors`` (feed, last_seen), one row
    per feed.  A cursor that is not on the page keeps the whole page.  ``emit_order``
    counts down the page, so ascending order is oldest first.
    """
    seen = (
        pages.select(feed, "pos", "token_address")
        .join(cursors.select(feed, F.col("last_seen").alias("token_address")), [feed, "token_address"])
        .groupBy(feed)
        .agg(F.min("pos").alias("_stop"))
    )
    return (
        skew_join(pages, seen, [feed], ["pos"])
        .filter(F.col("_stop").isNull() | (F.col("pos") < F.col("_stop")))
        .withColumn("emit_order", -F.col("pos"))
        .drop("_stop")
    )


def advance_cursor(pages: DataFrame, feed: str = "feed") -> DataFrame:
    """The next cursor of every feed: the first row of its page."""
    return pages.groupBy(feed).agg(F.min_by("token_address", "pos").alias("last_seen"))


def _topic_address(topic: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.right(topic, F.lit(40))))


def decode_launch_logs(logs: DataFrame) -> DataFrame:
    """Launch rows from creation logs with at least three topics."""
    topics = F.col("topics")
    return logs.filter(F.size(topics) >= 3).select(
        *[c for c in logs.columns if c not in ("topics", "data", "transactionHash", "address")],
        _topic_address(topics[1]).alias("token_address"),
        _topic_address(topics[2]).alias("creator_address"),
        F.lit(ONCHAIN_NAME).alias("token_name"),
        F.lit(UNKNOWN_SYMBOL).alias("token_symbol"),
        F.lit(0.0).alias("initial_liquidity_usd"),
        F.lit("").alias("launch_timestamp"),
        F.concat(F.lit(TX_URL), F.coalesce("transactionHash", F.lit(""))).alias("source_url"),
    )


def normalize_candidates(
    rows: DataFrame, now_iso: str, default_url: str = DEFAULT_SOURCE_URL
) -> DataFrame:
    """Fills empty launch time, name, symbol and link with their defaults."""
    defaults = {
        "launch_timestamp": now_iso,
        "token_name": UNKNOWN_NAME,
        "token_symbol": UNKNOWN_SYMBOL,
        "source_url": default_url,
    }
    return rows.withColumns(
        {c: F.coalesce(blank_to_null(F.col(c)), F.lit(d)) for c, d in defaults.items()}
    )
