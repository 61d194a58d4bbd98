"""The risk-rule catalogue: a rule is a tag, a weight and two columns.

Rules read the columns of a joined (social, chain) row named as in :data:`INPUTS`, and
more rules can be appended to the list given to ``run_rules``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from launchsift.functions.constants import EXPLORER_LABEL


@dataclass(frozen=True)
class Rule:
    tag: str
    weight: int
    when: Column
    reason: Column


INPUTS = (
    "organic_score", "sentiment", "red_flags", "social_quality",
    "holder_count", "top10_concentration_pct", "liquidity_usd", "buy_sell_velocity_tx_per_min",
    "whale_entries", "contract_verified", "honeypot_check_passed", "lp_locked",
    "creator_previous_tokens", "chain_quality",
)


def _flagged(flag: str) -> Column:
    return F.array_contains("red_flags", flag)


def _say(template: str, value: Column) -> Column:
    return F.format_string(template, value)


def default_rules() -> list[Rule]:
    """The fifteen built-in rules in their fixed order.

    Tags, weights, limits and texts are fixed values.  Printed numbers are rounded half
    to even first, because formatting alone would round half up.
    """
    c = F.col
    pct, liquidity = c("top10_concentration_pct"), c("liquidity_usd")
    velocity, sentiment = c("buy_sell_velocity_tx_per_min"), c("sentiment")
    thousands = F.format_number(F.bround(liquidity, 0), 0)
    return [
        Rule("unverified-contract", 25, ~c("contract_verified"),
             F.lit(f"Contract source not verified on {EXPLORER_LABEL}.")),
        Rule("honeypot-suspected", 40, ~c("honeypot_check_passed"),
             F.lit("Honeypot check did not pass.")),
        Rule("lp-not-locked", 20, ~c("lp_locked"),
             F.lit("Liquidity pool tokens are not locked.")),
        Rule("high-top10-concentration", 20, pct > 70.0,
             _say("Top 10 wallets hold %.1f%% of supply.", F.bround(pct, 1))),
        Rule("low-holder-count", 10, c("holder_count") < 20,
             _say("Only %d holders.", c("holder_count"))),
        Rule("liquidity-too-thin", 15, liquidity < 1000,
             F.concat(F.lit("Liquidity only $"), thousands, F.lit("."))),
        Rule("wash-trading-suspected", 15, velocity > 300,
             _say("Velocity %.0f tx/min suggests wash trading.", F.bround(velocity, 0))),
        Rule("serial-launcher", 20, c("creator_previous_tokens") > 10,
             _say("Creator has launched %d tokens previously.", c("creator_previous_tokens"))),
        Rule("no-organic-buzz", 10, c("organic_score") < 15,
             _say("organic_score is only %d.", c("organic_score"))),
        Rule("negative-sentiment", 10, sentiment < -0.4,
             _say("Sentiment is %.2f.", F.bround(sentiment, 2))),
        Rule("copy-paste-shilling", 15, _flagged("copy-paste-shilling"),
             F.lit("Social agent flagged copy-paste shilling.")),
        Rule("paid-promotion-disclosure", 5, _flagged("paid-promotion-disclosure"),
             F.lit("Social agent flagged paid promotion.")),
        Rule("whale-sniping", 10, c("whale_entries") > 5,
             _say("%d whale entries detected early — possible sniping.", c("whale_entries"))),
        Rule("social-data-degraded", 5, c("social_quality") == "degraded",
             F.lit("Social data could not be fully gathered — confidence reduced.")),
        Rule("chain-data-degraded", 5, c("chain_quality") == "degraded",
             F.lit("Chain data could not be fully gathered — confidence reduced.")),
    ]
