"""Subscriptions, threshold matching, repeat suppression and message text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from launchsift.functions.constants import (
    DELIVERY_MEMORY_S,
    EXPLORER_LABEL,
    TIERS,
    TOKEN_URL,
)
from launchsift.functions.text import head, micros
from launchsift.operators.modeltext import text_list
from launchsift.operators.ordered import DAY_S, OrderedKeys
from launchsift.operators.skew import split_count


def tier_rank(tier: Column) -> Column:
    """Position of a tier, ignoring case; an unknown tier counts as the lowest."""
    return F.greatest(
        F.array_position(F.array(*map(F.lit, TIERS)), F.lower(tier)).cast("int") - 1, F.lit(0)
    )


def current_subscriptions(changes: DataFrame) -> DataFrame:
    """(chat_id, threshold, active) after replaying the change log.

    ``changes`` has (chat_id, ts, seq, action, threshold) with the actions subscribe,
    unsubscribe and set.  The first subscription always follows any earlier change of an
    unknown chat, so the last relevant change decides each column.
    """
    action = F.col("action")
    when = F.struct("ts", "seq")
    sets = action.isin("subscribe", "set")
    switches = action.isin("subscribe", "unsubscribe")
    return (
        changes.groupBy("chat_id")
        .agg(
            F.max_by("threshold", F.when(sets, when)).alias("threshold"),
            F.max_by(action == "subscribe", F.when(switches, when)).alias("active"),
            F.bool_or(action == "subscribe").alias("_known"),
        )
        .filter("_known")
        .drop("_known")
    )


def _accepting(subs: DataFrame) -> DataFrame:
    """Active subscribers once per tier they accept (at most four rows each)."""
    lowest = tier_rank(F.col("threshold"))
    return subs.filter("active").select(
        "chat_id", F.explode(F.sequence(lowest, F.lit(len(TIERS) - 1))).alias("_tier")
    )


def match_threshold(briefs: DataFrame, subs: DataFrame) -> DataFrame:
    """(msg_id, chat_id) deliveries of a batch of new briefs.

    The ordering comparison becomes an equality on the accepted tiers.  As there are only
    four tiers, subscribers are salted and the batch's few briefs repeated per salt, so
    the deliveries of one tier are produced by many tasks.
    """
    parts = split_count(briefs)
    left = briefs.select(
        "msg_id",
        tier_rank(F.col("conviction_tier")).alias("_tier"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_salt"),
    )
    right = _accepting(subs).withColumn(
        "_salt", F.pmod(F.xxhash64("chat_id"), F.lit(parts)).cast("int")
    )
    return left.join(right, ["_tier", "_salt"]).select("msg_id", "chat_id")


def reach_of_briefs(briefs: DataFrame, subs: DataFrame) -> DataFrame:
    """Number of subscribers each brief goes to, without forming the deliveries."""
    per_tier = _accepting(subs).groupBy("_tier").agg(F.count(F.lit(1)).alias("recipients"))
    # One row per tier: at most four rows, whatever the number of subscribers.
    return (
        briefs.withColumn("_tier", tier_rank(F.col("conviction_tier")))
        .join(F.broadcast(per_tier), "_tier", "left")
        .select("msg_id", F.coalesce("recipients", F.lit(0)).alias("recipients"))
    )


def deliveries_by_tier(briefs: DataFrame, subs: DataFrame) -> DataFrame:
    """(tier, threshold, deliveries) that ``match_threshold`` would form, counted from both sides' counts.

    ``tier`` is the rank of the briefs' conviction tier.  Either side is first reduced to a row
    per tier.
    """
    per_tier = briefs.groupBy(tier_rank(F.col("conviction_tier")).alias("_tier")).agg(F.count(F.lit(1)).alias("_briefs"))
    accepting = (
        subs.filter("active").groupBy(F.lower("threshold").alias("threshold")).agg(F.count(F.lit(1)).alias("_chats"))
        .withColumn("_tier", F.explode(F.sequence(tier_rank(F.col("threshold")), F.lit(len(TIERS) - 1))))
    )
    return per_tier.join(accepting, "_tier").select(
        F.col("_tier").alias("tier"), "threshold", (F.col("_briefs") * F.col("_chats")).alias("deliveries")
    )


def deliveries_by_chat(briefs: DataFrame, subs: DataFrame) -> DataFrame:
    """(chat_id, deliveries): how many of ``briefs`` go to each chat, by ``match_threshold`` itself.

    Briefs of one tier go to the same chats, so one of each tier is matched and stands for their
    number.  Chats that get nothing are left out.
    """
    tiers = briefs.groupBy(tier_rank(F.col("conviction_tier")).alias("_tier")).agg(
        F.min_by("conviction_tier", "msg_id").alias("conviction_tier"), F.min("msg_id").alias("msg_id"), F.count(F.lit(1)).alias("_briefs")
    )
    # One row per tier: at most four rows, whatever the number of briefs.
    return (
        match_threshold(tiers, subs)
        .join(F.broadcast(tiers.select("msg_id", "_briefs")), "msg_id")
        .groupBy("chat_id").agg(F.sum("_briefs").alias("deliveries"))
    )


def undelivered(
    matches: DataFrame, sent: DataFrame, now: Column, memory_s: int = DELIVERY_MEMORY_S,
    bucket_s: float = DAY_S,
) -> DataFrame:
    """Matches not sent before, as far as the chat's memory reaches.

    A chat remembers everything sent since its last silence of ``memory_s`` or more;
    every send restarts that clock for the whole chat.
    """
    span = int(memory_s * 1_000_000)
    at = micros(F.col("sent_at"))
    until = F.coalesce(F.col("_next"), micros(now))
    scan = (
        OrderedKeys(sent, ["chat_id"], ["sent_at", "msg_id"], bucket_s)
        .following("_next", at)
        .with_column("_silent", F.when(until - at >= span, F.lit(True)))
        .upcoming("_later", F.col("_silent"))
    )
    # A send is forgotten when it, or any later send, is followed by a long silence.
    remembered = (
        scan.rows().filter(F.col("_silent").isNull() & F.col("_later").isNull())
        .select("chat_id", "msg_id").distinct()
    )
    return matches.join(remembered, ["chat_id", "msg_id"], "left_anti")


def format_brief(briefs: DataFrame) -> DataFrame:
    """(msg_id, body): the message text of a brief."""
    caveats = F.slice(text_list(F.col("caveats")), 1, 5)
    bullets = F.array_join(F.transform(caveats, lambda c: F.concat(F.lit("• "), c)), "\n")
    block = F.when(
        F.size(caveats) > 0, F.concat(F.lit("\n\n*Caveats*:\n"), bullets)
    ).otherwise(F.lit(""))
    body = F.concat(
        F.lit("*"), F.col("token_name"), F.lit("* — conviction: *"), F.col("conviction_tier"),
        F.lit("*\n\n"), head(F.col("thesis"), 900), block,
        F.lit(f"\n\n[{EXPLORER_LABEL}]({TOKEN_URL}"), F.col("token_address"), F.lit(") · `"),
        F.col("msg_id").cast("string"), F.lit("`"),
    )
    return briefs.select("msg_id", body.alias("body"))
