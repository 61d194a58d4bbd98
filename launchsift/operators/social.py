"""Mention counting, snippets, posting patterns and the social score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from launchsift.functions.constants import (
    CHANNEL_TAIL,
    FLAG_CHANNEL_BLOCKED,
    FLAG_SCORER_EXHAUSTED,
    FLAG_SEARCH_BLOCKED,
    POSTING_HANDLES,
    SAMPLE_COUNT,
    SAMPLE_WIDTH,
    SEARCH_PAGE,
)
from launchsift.functions.text import chosen, head, strip
from launchsift.operators.modeltext import text_list
from launchsift.operators.skew import skew_join, top_k_per_group

GRAM = 3


def channel_tail(messages: DataFrame, last_n: int = CHANNEL_TAIL) -> DataFrame:
    """The newest ``last_n`` messages of every channel."""
    return top_k_per_group(
        messages, ["channel"], [F.col("pos").desc()], last_n, rank="_age"
    ).drop("_age")


def _grams(text: Column) -> Column:
    """Distinct runs of one to three characters of a text (overlapping matches)."""
    return F.array_distinct(F.concat(*[_runs(text, width) for width in range(1, GRAM + 1)]))


def _runs(text: Column, width: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1))


def rarest_grams(grams: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_symbol, _gram): every symbol with that of its own three-character runs which ``grams`` has least often.

    A symbol of up to three characters stands for itself.  Symbols with a run that never occurs
    are in no text and are left out.  ``grams`` has a row per message and gram; either side is
    counted by gram alone, so neither symbols nor messages of one gram are gathered.
    """
    short = F.length("_symbol") <= GRAM
    own = wanted.select(
        "_symbol", F.explode(F.when(short, F.array("_symbol")).otherwise(F.array_distinct(_runs(F.col("_symbol"), GRAM)))).alias("_gram")
    )
    counted = grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_times"))
    rated = own.join(counted, "_gram", "left").groupBy("_symbol").agg(
        F.min(F.struct(F.coalesce("_times", F.lit(0)).alias("times"), "_gram")).alias("_rarest")
    )
    return rated.filter("_rarest.times > 0").select("_symbol", F.col("_rarest._gram").alias("_gram"))


def match_symbols(messages: DataFrame, symbols: DataFrame, symbol: str = "symbol") -> DataFrame:
    """(symbol, channel, pos, text) where the text contains the symbol, ignoring case.

    Containment becomes an equi-join: a text can contain a symbol only if it contains the
    symbol's rarest three-character run (``rarest_grams``), so symbols with a common beginning
    do not all meet every text that has it.  Only message keys and one symbol each travel
    through the join, the texts themselves are fetched back only for the candidates and then
    checked exactly.  Equal messages are one with a number of copies until then.
    """
    wanted = symbols.select(F.lower(symbol).alias("_symbol")).filter(F.col("_symbol") != "").distinct()
    message = ["channel", "pos", "_text"]
    # One row per message, so messages under a repeated position do not multiply.
    keyed = messages.groupBy("channel", "pos", F.xxhash64("text").alias("_text")).agg(
        F.first("text").alias("text"), F.count(F.lit(1)).alias("_copies")
    )
    grams = keyed.select(*message, F.explode(_grams(F.lower("text"))).alias("_gram"))
    candidates = grams.join(rarest_grams(grams, wanted), "_gram").select(*message, "_symbol")
    # A null channel or position is a key like any other.
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"m.{c}")) for c in message]
    return (
        candidates.alias("k").join(keyed.alias("m"), same)
        .filter(F.contains(F.lower("m.text"), F.col("_symbol")))
        .select(F.col("_symbol").alias(symbol), "m.channel", "m.pos", "m.text", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
        .drop("_copy")
    )


def count_mentions(
    messages: DataFrame, tokens: DataFrame, last_n: int = CHANNEL_TAIL, token: str = "token_address"
) -> DataFrame:
    """(token, mentions) over the tail of every channel; tokens have (token, symbol)."""
    hits = match_symbols(channel_tail(messages, last_n), tokens).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("mentions")
    )
    keyed = tokens.select(token, F.lower("symbol").alias("symbol"))
    return skew_join(keyed, hits, ["symbol"], [token]).select(
        token, F.coalesce("mentions", F.lit(0)).alias("mentions")
    )


def sample_snippets(
    messages: DataFrame,
    symbols: DataFrame,
    last_n: int = CHANNEL_TAIL,
    k: int = SAMPLE_COUNT,
    width: int = SAMPLE_WIDTH,
) -> DataFrame:
    """First ``k`` matching messages per symbol, in channel and then page order."""
    matched = match_symbols(channel_tail(messages, last_n), symbols)
    return top_k_per_group(
        matched, ["symbol"], [F.col("channel"), F.col("pos")], k, rank="sample_no"
    ).select("symbol", "sample_no", head(strip(F.col("text")), width).alias("snippet"))


def count_search_hits(articles: DataFrame, limit: int = SEARCH_PAGE) -> DataFrame:
    """Non-blank articles among the first ``limit`` of every query; none is degraded."""
    page = top_k_per_group(articles, ["query"], [F.col("pos")], limit)
    return page.groupBy("query").agg(
        F.count_if(strip(F.col("text")) != "").alias("mentions")
    ).withColumn("degraded", F.col("mentions") == 0)


def source_status(fetches: DataFrame, by: str = "source") -> DataFrame:
    """A source is degraded unless at least one of its channels was read."""
    return fetches.groupBy(by).agg((~F.bool_or("success")).alias("degraded"))


def assemble_social(
    candidates: DataFrame, search: DataFrame, channels: DataFrame, scored: DataFrame
) -> DataFrame:
    """The social score of every candidate; each input has one row per token."""
    search = search.select(
        "token_address", F.col("mentions").alias("_x"), F.col("degraded").alias("_xd")
    )
    channels = channels.select(
        "token_address", F.col("mentions").alias("_t"), F.col("degraded").alias("_td")
    )
    scored = scored.select(
        "token_address",
        F.col("organic_score").alias("_organic"),
        F.col("sentiment").alias("_sentiment"),
        F.col("model_flags").alias("_flags"),
        F.col("influencer_mentions").alias("_who"),
        F.col("model_used").alias("_model"),
        F.lit(True).alias("_scored"),
    )
    xd = F.coalesce("_xd", F.lit(True))
    td = F.coalesce("_td", F.lit(True))
    silent = F.col("_scored").isNull()
    own = chosen(
        (xd, F.lit(FLAG_SEARCH_BLOCKED)),
        (td, F.lit(FLAG_CHANNEL_BLOCKED)),
        (silent, F.lit(FLAG_SCORER_EXHAUSTED)),
    )
    return (
        candidates.select("token_address")
        .join(search, "token_address", "left")
        .join(channels, "token_address", "left")
        .join(scored, "token_address", "left")
        .select(
            "token_address",
            F.coalesce("_organic", F.lit(0)).alias("organic_score"),
            (F.coalesce("_x", F.lit(0)) + F.coalesce("_t", F.lit(0))).alias("mentions_24h"),
            F.coalesce("_sentiment", F.lit(0.0)).alias("sentiment"),
            F.concat(own, text_list(F.col("_flags"))).alias("red_flags"),
            text_list(F.col("_who")).alias("influencer_mentions"),
            F.when(xd | td | silent, F.lit("degraded")).otherwise(F.lit("ok")).alias("data_quality"),
            F.col("_model").alias("model_used"),
        )
    )


def coordinated_posting(messages: DataFrame, min_handles: int = POSTING_HANDLES) -> DataFrame:
    """Texts posted by more than ``min_handles`` distinct handles."""
    text_hash = F.sha2(strip(F.lower("text")).cast("binary"), 256)
    return (
        messages.groupBy(text_hash.alias("text_hash"))
        .agg(
            F.count_distinct("handle").alias("handles"),
            F.count(F.lit(1)).alias("posts"),
        )
        .filter(F.col("handles") > min_handles)
    )
