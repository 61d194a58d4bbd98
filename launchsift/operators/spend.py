"""Model-call cost, failures, quotas and circuit history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from launchsift.functions.constants import (
    CIRCUIT_COOLDOWN_S,
    CIRCUIT_FAILURES,
    DAILY_CAPS,
    FALLBACKS,
    PRICES,
)
from launchsift.functions.text import micros
from launchsift.operators.ordered import BUCKET, OrderedKeys, bucket_of, trailing

MONEY = "decimal(10,6)"


def _lookup(table: Mapping[str, object], key: Column) -> Column:
    """Value of a small configuration table, as a literal map inside the plan."""
    flat = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*flat), key)


def call_cost(
    calls: DataFrame, prices: Mapping[str, tuple[float, float]] = PRICES
) -> DataFrame:
    """Adds ``cost_usd``; prices are per 1,000 tokens, unknown models cost nothing."""
    model = F.col("model")
    rate_in = F.coalesce(_lookup({m: p[0] for m, p in prices.items()}, model), F.lit(0.0))
    rate_out = F.coalesce(_lookup({m: p[1] for m, p in prices.items()}, model), F.lit(0.0))
    cost = F.col("input_tokens") / 1000.0 * rate_in + F.col("output_tokens") / 1000.0 * rate_out
    return calls.withColumn("cost_usd", cost.cast(MONEY))


def cost_by_provider(calls: DataFrame) -> DataFrame:
    return calls.groupBy("provider").agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0).cast(MONEY)).alias("total")
    )


def failures(calls: DataFrame, since: Column) -> DataFrame:
    """Failed calls after ``since`` by provider and error class."""
    return (
        calls.filter((F.col("created_at") > since) & ~F.col("success"))
        .groupBy("provider", "error_class")
        .agg(F.count(F.lit(1)).alias("failures"))
    )


def daily_spend(calls: DataFrame, now: Column) -> DataFrame:
    """Calls and cost of the 24 hours before ``now`` by provider and model."""
    day = calls.filter(F.col("created_at") > now - F.expr("INTERVAL 24 HOURS"))
    return (
        day.groupBy("provider", "model")
        .agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost_usd"), 4).alias("usd"))
        .orderBy(F.col("usd").desc(), "provider", "model")
    )


def hourly_usage(calls: DataFrame) -> DataFrame:
    """Calls, errors and cost per hour, agent, provider and model."""
    return (
        calls.groupBy(F.window("created_at", "1 hour").alias("w"), "agent", "provider", "model")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.count_if(~F.col("success")).alias("errors"),
            F.sum("cost_usd").alias("usd"),
        )
        .select(F.col("w.start").alias("hour"), "agent", "provider", "model", "calls", "errors", "usd")
    )


def error_rate(
    calls: DataFrame, back_s: int = 300, keys: Sequence[str] = ("agent",), bucket_s: float | None = None
) -> DataFrame:
    """Adds the failed share of each agent's calls in the ``back_s`` seconds up to each call.

    An agent is cut into cells of twelve look-backs unless ``bucket_s`` is given.
    """
    counted = trailing(
        calls, keys, "created_at", back_s,
        {"recent_calls": F.count(F.lit(1)), "recent_failures": F.count_if(~F.col("success"))},
        12 * back_s if bucket_s is None else bucket_s,
    )
    return counted.withColumn("error_rate", F.col("recent_failures") / F.col("recent_calls"))


def cap_breach(
    calls: DataFrame, caps: Mapping[str, float] = DAILY_CAPS, cell_s: int = 900
) -> DataFrame:
    """First call of each provider and day that pushes the day's spend over its cap.

    Spend per quarter hour locates the breach; only the calls of that one quarter hour
    are then summed one by one.
    """
    cap = _lookup({p: float(c) for p, c in caps.items()}, F.col("provider")).cast("decimal(18,6)")
    spent = (
        calls.select("provider", "created_at", "call_id", "cost_usd")
        .withColumn("day", F.to_date("created_at"))
        .withColumn(BUCKET, bucket_of(F.col("created_at"), cell_s))
    )
    cell = ["provider", "day", BUCKET]
    earlier = (
        Window.partitionBy("provider", "day").orderBy(BUCKET)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    crossing = (
        spent.groupBy(*cell)
        .agg(F.sum("cost_usd").alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .withColumn("cap_usd", cap)
        .filter(
            (F.col("_before") <= F.col("cap_usd"))
            & (F.col("_before") + F.col("_sum") > F.col("cap_usd"))
        )
        .select(*cell, "_before", "cap_usd")
    )
    upto = (
        Window.partitionBy(*cell).orderBy("created_at", "call_id")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    over = (
        spent.join(crossing, cell)
        .withColumn("spent_usd", F.col("_before") + F.sum("cost_usd").over(upto))
        .filter(F.col("spent_usd") > F.col("cap_usd"))
    )
    row = F.struct("call_id", "created_at", "spent_usd", "cap_usd")
    return (
        over.groupBy("provider", "day")
        .agg(F.min_by(row, F.struct("created_at", "call_id")).alias("_first"))
        .select("provider", "day", "_first.*")
    )


def circuit_intervals(
    calls: DataFrame,
    threshold: int = CIRCUIT_FAILURES,
    cooldown_s: float = CIRCUIT_COOLDOWN_S,
    bucket_s: float = 3600,
) -> DataFrame:
    """(provider, opened_at, closed_at) in epoch microseconds.

    A circuit opens at the failure that makes ``threshold`` in a row; further failures of
    that row do not open it again.  It closes after the cooldown or at the next success.
    """
    ok = F.col("success")
    scan = (
        OrderedKeys(
            calls.select("provider", "created_at", "call_id", "success"),
            ["provider"], ["created_at", "call_id"], bucket_s,
        )
        .running("_no", F.lit(1))
        .upcoming("_next_ok", F.when(ok, micros(F.col("created_at"))))
        .with_column("_ok_no", F.when(ok, F.col("_no")))
        .latest("_last_ok", F.col("_ok_no"))
    )
    in_row = F.col("_no") - F.coalesce("_last_ok", F.lit(0))
    opened = micros(F.col("created_at"))
    return scan.rows().filter(~ok & (in_row == threshold)).select(
        "provider",
        opened.alias("opened_at"),
        F.least(opened + int(cooldown_s * 1_000_000), F.col("_next_ok")).alias("closed_at"),
    )


def served_by(
    requests: DataFrame,
    attempts: DataFrame,
    fallbacks: Mapping[str, Sequence[str]] = FALLBACKS,
    gateway: str = "dgrid",
    providers: Sequence[str] = ("anthropic", "openai", "google"),
) -> DataFrame:
    """Which provider and model answered each request, or that all were exhausted.

    ``requests`` has (request_id, primary_model), ``attempts`` (request_id, provider,
    model, success).  The gateway is asked first with the primary model, then the
    primary model and its fallbacks directly; providers without a client are skipped.
    """
    primary = F.col("primary_model")
    chains = F.create_map(
        *[x for m, rest in fallbacks.items() for x in (F.lit(m), F.array(*map(F.lit, rest)))]
    )
    chain = F.concat(
        F.array(primary), F.coalesce(F.try_element_at(chains, primary), F.array().cast("array<string>"))
    )
    by_gateway = (F.col("provider") == gateway) & (F.col("model") == primary)
    direct = F.array_position(chain, F.col("model"))
    place = F.when(by_gateway, F.lit(0)).when(
        F.col("provider").isin(*providers) & (direct > 0), direct
    )
    good = attempts.filter("success").join(requests, "request_id").withColumn("_place", place)
    best = (
        good.filter(F.col("_place").isNotNull())
        .groupBy("request_id")
        .agg(F.min_by(F.struct("provider", "model"), "_place").alias("_best"))
    )
    return requests.join(best, "request_id", "left").select(
        "request_id",
        primary,
        F.col("_best.provider").alias("provider"),
        F.col("_best.model").alias("model"),
        F.col("_best").isNull().alias("exhausted"),
    )
