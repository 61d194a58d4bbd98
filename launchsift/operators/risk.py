"""Pairing of the two signals, rules, scores and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from launchsift.functions.constants import PAIR_TIMEOUT_S, TEXT_NO_MODEL
from launchsift.functions.rules import Rule, default_rules
from launchsift.functions.text import chosen, micros
from launchsift.operators.ordered import BUCKET, DAY_S, bucket_of

SIDES = ("social", "chain")
FORCED_TAG, FORCED_SCORE = "honeypot-suspected", 5


def pair_latest(
    social: DataFrame, chain: DataFrame, timeout_s: float = PAIR_TIMEOUT_S, token: str = "token_address"
) -> DataFrame:
    """Full outer join for one row per token and side, within ``timeout_s``.

    A pair further apart than the timeout is two unmatched halves.
    """
    near = F.abs(micros(F.col("s.ts")) - micros(F.col("c.ts"))) <= int(timeout_s * 1_000_000)
    same = F.col(f"s.{token}") == F.col(f"c.{token}")
    return (
        social.alias("s")
        .join(chain.alias("c"), same & near, "full_outer")
        .select(
            F.coalesce(f"s.{token}", f"c.{token}").alias(token),
            F.col("s.msg_id").alias("social_id"),
            F.col("c.msg_id").alias("chain_id"),
            F.when(F.col("c.msg_id").isNull(), F.lit("chain"))
            .when(F.col("s.msg_id").isNull(), F.lit("social"))
            .alias("missing"),
        )
    )


def pair_outcomes(
    signals: DataFrame, timeout_s: float = PAIR_TIMEOUT_S, token: str = "token_address",
    bucket_s: float = DAY_S,
) -> DataFrame:
    """What the consuming pairing does with every signal, in arrival order (ts, msg_id).

    After a signal either that very signal waits or nothing does, so a signal can only
    pair with its direct predecessor: the sides must differ, the wait must not exceed
    the timeout, and the predecessor must not have been used itself.  Within a run of
    such links every second one therefore pairs, which is a position parity and needs no
    row-by-row state.

    Adds ``outcome``: ``paired`` (with ``partner_id``), ``replaced`` (a newer signal of
    the same side arrived in time), ``expired`` (timeout passed before the next signal)
    or ``waiting`` (no later signal of that token).
    """
    limit = int(timeout_s * 1_000_000)
    at = micros(F.col("ts"))
    here = F.struct(F.col("msg_id").alias("id"), F.col("side").alias("side"), at.alias("at"))

    def linked(before: Column, after: Column) -> Column:
        return (before["side"] != after["side"]) & (after["at"] - before["at"] <= limit)

    # Inside each (token, time bucket); "_broke" is the last position that does not link
    # to its predecessor.  The first row is left open, as its predecessor is elsewhere.
    cell = [token, BUCKET]
    inside = Window.partitionBy(*cell).orderBy("ts", "msg_id")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = (
        signals.withColumns({BUCKET: bucket_of(F.col("ts"), bucket_s), "_here": here})
        .withColumns(
            {
                "_prev": F.lag("_here").over(inside),
                "_succ": F.lead("_here").over(inside),
                "_no": F.row_number().over(inside).cast("bigint"),
                "_head": F.first("_here").over(whole),
            }
        )
        .withColumn("_link", linked(F.col("_prev"), F.col("_here")))
        .withColumn("_broke", F.max(F.when(~F.col("_link"), F.col("_no"))).over(upto))
    )

    # One row per bucket, carried along the token: the neighbours across the border, the
    # number of earlier signals and the last break among them.
    along = Window.partitionBy(token).orderBy(BUCKET)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    own_break = F.coalesce(F.col("_broke"), F.when(~F.col("_first_links"), F.lit(1)))
    carried = (
        near.filter(F.col("_succ").isNull())
        .select(
            *cell, "_broke", "_no",
            F.lag("_here").over(along).alias("_before"),
            F.lead("_head").over(along).alias("_after"),
            F.coalesce(F.sum("_no").over(earlier), F.lit(0)).alias("_skipped"),
            "_head",
        )
        .withColumn(
            "_first_links", F.coalesce(linked(F.col("_before"), F.col("_head")), F.lit(False))
        )
        .withColumn("_last_break", F.max(F.col("_skipped") + own_break).over(earlier))
        .select(*cell, "_before", "_after", "_skipped", "_first_links", "_last_break")
    )

    link = F.coalesce(F.col("_link"), F.col("_first_links"))
    start = F.coalesce(
        F.col("_skipped") + F.col("_broke"),
        F.when(~F.col("_first_links"), F.col("_skipped") + 1),
        F.col("_last_break"),
    )
    odd = (F.col("_skipped") + F.col("_no") - start) % 2 == 1
    prev, succ = F.coalesce("_prev", "_before"), F.coalesce("_succ", "_after")
    second = link & odd
    first = ~second & F.coalesce(linked(F.col("_here"), succ), F.lit(False))
    outcome = (
        F.when(second | first, F.lit("paired"))
        .when(succ.isNull(), F.lit("waiting"))
        .when(succ["at"] - F.col("_here.at") <= limit, F.lit("replaced"))
        .otherwise(F.lit("expired"))
    )
    partner = F.when(second, prev["id"]).when(first, succ["id"])
    return near.drop("_head").join(carried, cell, "left").select(
        *signals.columns, outcome.alias("outcome"), partner.alias("partner_id")
    )


def pair_signals(
    signals: DataFrame, timeout_s: float = PAIR_TIMEOUT_S, token: str = "token_address",
    bucket_s: float = DAY_S, now: Column | None = None,
) -> DataFrame:
    """One row per pair and per expired half: (token, social_id, chain_id, missing).

    With ``now`` a waiting half counts as expired once its timeout has passed.
    """
    rows = pair_outcomes(signals, timeout_s, token, bucket_s)
    social = F.col("side") == "social"
    lapsed = F.col("outcome") == "expired"
    if now is not None:
        late = micros(now) - micros(F.col("ts")) > int(timeout_s * 1_000_000)
        lapsed = lapsed | ((F.col("outcome") == "waiting") & late)
    paired = (F.col("outcome") == "paired") & social
    return rows.filter(paired | lapsed).select(
        token,
        F.when(social, F.col("msg_id")).alias("social_id"),
        F.when(paired, F.col("partner_id")).when(~social, F.col("msg_id")).alias("chain_id"),
        F.when(lapsed, F.when(social, F.lit("chain")).otherwise(F.lit("social"))).alias("missing"),
    )


def partial_verdicts(
    pairs: DataFrame, timeout_s: float = PAIR_TIMEOUT_S, token: str = "token_address"
) -> DataFrame:
    """Verdicts for the halves whose partner did not arrive."""
    missing = F.col("missing")
    return pairs.filter(missing.isNotNull()).select(
        token,
        F.coalesce("social_id", "chain_id").alias("upstream_id"),
        F.lit(None).cast("int").alias("score_0_100"),
        F.array(F.concat(F.lit("missing-"), missing, F.lit("-input"))).alias("red_flags"),
        F.concat(
            F.initcap(missing), F.lit(f" data did not arrive within {timeout_s:.0f}s.")
        ).alias("rationale"),
        F.array(missing).alias("missing_inputs"),
        F.lit("low").alias("confidence"),
        F.lit(True).alias("requires_human_review"),
    )


def run_rules(pairs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Adds ``findings``: (tag, weight, reason) of every rule that fires, in order."""
    hits = [
        (
            r.when,
            F.struct(
                F.lit(r.tag).alias("tag"), F.lit(r.weight).alias("weight"), r.reason.alias("reason")
            ),
        )
        for r in (default_rules() if rules is None else rules)
    ]
    return pairs.withColumn("findings", chosen(*hits))


def score_of(findings: Column) -> Column:
    """100 less the weights, at least 0; a suspected honeypot is always 5."""
    weights = F.aggregate(findings["weight"], F.lit(0), lambda total, w: total + w)
    return F.when(
        F.array_contains(findings["tag"], FORCED_TAG), F.lit(FORCED_SCORE)
    ).otherwise(F.greatest(F.lit(0), F.lit(100) - weights))


def aggregate_score(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", score_of(F.col("findings")))


def build_verdict(rows: DataFrame) -> DataFrame:
    """Verdict payloads from scored rows.

    Rows carry (token_address, social_id, chain_id, findings, score) and, where a model
    answered, (rationale, confidence, model_used).
    """
    answered = F.col("model_used").isNotNull()
    return rows.select(
        "token_address",
        F.when(answered, F.col("score")).alias("score_0_100"),
        F.col("findings.tag").alias("red_flags"),
        F.when(answered, F.col("rationale")).otherwise(F.lit(TEXT_NO_MODEL)).alias("rationale"),
        F.array().cast("array<string>").alias("missing_inputs"),
        F.when(answered, F.col("confidence")).alias("confidence"),
        (~answered).alias("requires_human_review"),
        F.array("social_id", "chain_id").alias("upstream_ids"),
        "model_used",
    )
