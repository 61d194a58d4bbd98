"""Holder, transfer, contract and creator metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from launchsift.functions.constants import (
    CREATOR_PAGE,
    CREATOR_TX_PER_TOKEN,
    DEFAULT_DECIMALS,
    HOLDER_PAGE,
    HOLDER_TOP,
    TRANSFER_PAGE,
    WHALE_THRESHOLD,
    ZERO_ADDRESS,
)
from launchsift.functions.text import blank_to_null, round_even, strip
from launchsift.operators.skew import first_k_per_group, split_count

TOKEN = "token_address"


def _number(text: str, default: str = "0"):
    """Text as double; absent or empty reads as ``default``, junk as null."""
    return F.coalesce(blank_to_null(F.col(text)), F.lit(default)).try_cast("double")


def _places(rows: DataFrame) -> list[Column]:
    """``pos`` as plain columns in its order: a sort that compares structs makes an object for each comparison."""
    kind = rows.schema["pos"].dataType
    parts = [f"pos.{name}" for name in kind.names] if isinstance(kind, StructType) else ["pos"]
    return [F.col("pos").isNotNull().alias("_placed"), *[F.col(p).alias(f"_p{i}") for i, p in enumerate(parts)]]


def _in_order(places: list[Column], nulls_last: bool = False) -> list[Column]:
    placed = F.col("_placed").desc() if nulls_last else F.col("_placed")
    return [placed, *[F.col(f"_p{i}") for i in range(len(places) - 1)]]


def holder_concentration(
    holders: DataFrame, page: int = HOLDER_PAGE, k: int = HOLDER_TOP, token: str = TOKEN
) -> DataFrame:
    """Holders on the page and the share of the first ``k`` in percent.

    ``holders`` has (token, pos, quantity as text) in page order.  One malformed
    quantity zeroes its token.
    """
    places = _places(holders)
    read = holders.select(token, *places, _number("quantity").alias("_q"))
    listed = first_k_per_group(read, [token], _in_order(places), page, rank="_n")
    total, top = F.col("_total"), F.col("_top")
    return (
        listed.groupBy(token)
        .agg(
            F.count(F.lit(1)).alias("_count"),
            F.sum("_q").alias("_total"),
            F.sum(F.when(F.col("_n") <= k, F.col("_q"))).alias("_top"),
            F.bool_or(F.col("_q").isNull()).alias("_bad"),
        )
        .select(
            token,
            F.when(F.col("_bad"), F.lit(0)).otherwise(F.col("_count")).cast("int").alias("holder_count"),
            F.when(~F.col("_bad") & (total > 0), round_even(top / total * 100.0, 2))
            .otherwise(F.lit(0.0))
            .alias("top10_concentration_pct"),
        )
    )


def recent_transfers(
    transfers: DataFrame, n: int = TRANSFER_PAGE, token: str = TOKEN
) -> DataFrame:
    """The first ``n`` transfers per token in page order (newest first)."""
    return first_k_per_group(transfers, [token], [F.col("pos")], n, rank="_n")


def tx_velocity(transfers: DataFrame, n: int = TRANSFER_PAGE, unit_s: float = 60.0, token: str = TOKEN) -> DataFrame:
    """Transfers per ``unit_s`` between the oldest and the newest of the page."""
    stamp = F.coalesce(F.col("time_stamp"), F.lit("0"))
    listed = recent_transfers(transfers, n, token).withColumn(
        "_t", strip(stamp).try_cast("bigint")
    )
    return _velocity(listed.groupBy(token).agg(*_velocity_parts()), token, unit_s)


def _velocity_parts():
    return [
        F.count(F.lit(1)).alias("_count"),
        F.min_by("_t", "_n").alias("_newest"),
        F.max_by("_t", "_n").alias("_oldest"),
    ]


def _velocity_value(unit_s: float):
    span = F.greatest(F.lit(1), F.col("_newest") - F.col("_oldest"))
    rate = F.col("_count") / (span / F.lit(unit_s))
    usable = (F.col("_count") >= 2) & F.col("_newest").isNotNull() & F.col("_oldest").isNotNull()
    return F.when(usable, round_even(rate, 2)).otherwise(F.lit(0.0))


def _velocity(parts: DataFrame, token: str, unit_s: float) -> DataFrame:
    return parts.select(token, _velocity_value(unit_s).alias("velocity"))


def _is_whale(threshold: float):
    decimals = F.coalesce(
        blank_to_null(F.col("decimals")), F.lit(str(DEFAULT_DECIMALS))
    ).try_cast("int")
    return F.try_divide(_number("value"), F.pow(F.lit(10.0), decimals)) > threshold


def whale_entries(
    transfers: DataFrame,
    threshold: float = WHALE_THRESHOLD,
    n: int | None = TRANSFER_PAGE,
    token: str = TOKEN,
) -> DataFrame:
    """Transfers of more than ``threshold`` token units; malformed ones are skipped."""
    listed = transfers if n is None else recent_transfers(transfers, n, token)
    return listed.groupBy(token).agg(
        F.count_if(F.coalesce(_is_whale(threshold), F.lit(False))).cast("int").alias("whale_entries")
    )


def transfer_metrics(
    transfers: DataFrame,
    threshold: float = WHALE_THRESHOLD,
    n: int = TRANSFER_PAGE,
    unit_s: float = 60.0,
    token: str = TOKEN,
) -> DataFrame:
    """Velocity and whale count from one pass over the page.

    Times and amounts are read before the page is cut: two numbers are sorted instead of three texts.
    """
    stamp = F.coalesce(F.col("time_stamp"), F.lit("0"))
    places = _places(transfers)
    read = transfers.select(
        token, *places, strip(stamp).try_cast("bigint").alias("_t"),
        F.coalesce(_is_whale(threshold), F.lit(False)).alias("_whale"),
    )
    return (
        first_k_per_group(read, [token], _in_order(places), n, rank="_n").groupBy(token)
        .agg(*_velocity_parts(), F.count_if("_whale").cast("int").alias("whale_entries"))
        .select(token, _velocity_value(unit_s).alias("velocity"), "whale_entries")
    )


def contract_meta(contracts: DataFrame, token: str = TOKEN) -> DataFrame:
    """Verification flag and creator from the first contract row of a token."""
    # Not an aggregate: a smallest row of texts is kept by sorting and one interpreted step a row.
    places = _places(contracts)
    rows = contracts.select(
        token, *places, (F.length(F.coalesce("source_code", F.lit(""))) > 0).alias("_verified"), "creator"
    )
    first = first_k_per_group(rows, [token], _in_order(places, nulls_last=True), 1, rank="_n")
    return first.select(
        token,
        (F.col("_placed") & F.col("_verified")).alias("verified"),
        F.lower(
            F.coalesce(F.when(F.col("_placed"), blank_to_null(F.col("creator"))), F.lit(ZERO_ADDRESS))
        ).alias("creator_address"),
    )


def creator_history(
    transactions: DataFrame,
    page: int = CREATOR_PAGE,
    per: int = CREATOR_TX_PER_TOKEN,
    creator: str = "creator_address",
) -> DataFrame:
    """Estimated earlier tokens per creator from the transactions on one page."""
    return transactions.groupBy(creator).agg(
        F.floor(F.least(F.count(F.lit(1)), F.lit(page)) / per).cast("int").alias(
            "creator_previous_tokens"
        )
    )


def with_creator_history(meta: DataFrame, history: DataFrame, spread: str = TOKEN) -> DataFrame:
    """``meta`` with the creator's earlier tokens.

    Every token without a known creator has the zero address, so that key is cut into parts.
    """
    parts = split_count(meta)
    zero = F.col("creator_address") == ZERO_ADDRESS
    left = meta.withColumn(
        "_part", F.when(zero, F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int")).otherwise(F.lit(0))
    )
    right = history.withColumn(
        "_part",
        F.explode(F.when(zero, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))),
    )
    return left.join(right, ["creator_address", "_part"], "left").drop("_part")


def assemble_chain(
    candidates: DataFrame,
    holders: DataFrame,
    meta: DataFrame,
    transfers: DataFrame,
    failures: DataFrame | None = None,
    lp_locked: DataFrame | None = None,
) -> DataFrame:
    """Chain metrics of every candidate.

    ``failures`` has (token, source) for fetches that failed: their values are replaced
    by defaults and the quality becomes degraded.  A token that is merely absent from
    an input was fetched and found empty, which is not a failure.
    """
    out = (
        candidates.select(TOKEN, F.col("initial_liquidity_usd").alias("liquidity_usd"))
        .join(holders, TOKEN, "left")
        .join(meta, TOKEN, "left")
        .join(transfers, TOKEN, "left")
    )
    if failures is not None:
        failed = failures.groupBy(TOKEN).agg(
            *[
                F.bool_or(F.col("source") == s).alias(f"_no_{s}")
                for s in ("holders", "meta", "transfers")
            ]
        )
        out = out.join(failed, TOKEN, "left")
    if lp_locked is not None:
        out = out.join(lp_locked.select(TOKEN, "lp_locked"), TOKEN, "left")

    def lost(source: str):
        if failures is None:
            return F.lit(False)
        return F.coalesce(F.col(f"_no_{source}"), F.lit(False))

    def kept(source: str, value: str, default):
        return F.when(lost(source) | F.col(value).isNull(), F.lit(default)).otherwise(F.col(value))

    verified = kept("meta", "verified", False)
    any_lost = lost("holders") | lost("meta") | lost("transfers")
    return out.select(
        TOKEN,
        kept("holders", "holder_count", 0).alias("holder_count"),
        kept("holders", "top10_concentration_pct", 0.0).alias("top10_concentration_pct"),
        "liquidity_usd",
        kept("transfers", "velocity", 0.0).alias("buy_sell_velocity_tx_per_min"),
        kept("transfers", "whale_entries", 0).alias("whale_entries"),
        verified.alias("contract_verified"),
        verified.alias("honeypot_check_passed"),
        (F.coalesce("lp_locked", F.lit(False)) if lp_locked is not None else F.lit(False)).alias(
            "lp_locked"
        ),
        kept("meta", "creator_previous_tokens", 0).alias("creator_previous_tokens"),
        F.when(any_lost, F.lit("degraded")).otherwise(F.lit("ok")).alias("data_quality"),
    )
