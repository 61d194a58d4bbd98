"""Routing of verdicts, human-review requests and briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from launchsift.functions.constants import (
    TEXT_CAVEAT_NO_MODEL,
    TEXT_NO_THESIS,
    TEXT_REVIEW,
    TEXT_THESIS_NO_MODEL,
)
from launchsift.functions.text import blank_to_null, head, strip
from launchsift.operators.modeltext import text_list


def needs_review() -> Column:
    return F.coalesce("requires_human_review", F.lit(False)) | F.col("score_0_100").isNull()


def route_verdicts(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts to brief, verdicts for human review)."""
    return verdicts.filter(~needs_review()), verdicts.filter(needs_review())


def human_review(verdicts: DataFrame, now_iso: str) -> DataFrame:
    """Review requests for verdicts with (msg_id, token_address, red_flags)."""
    flags = F.array_join(text_list(F.col("red_flags")), "; ")
    return verdicts.select(
        "token_address",
        F.coalesce(blank_to_null(flags), F.lit(TEXT_REVIEW)).alias("reason"),
        F.col("msg_id").alias("risk_verdict_msg_id"),
        F.lit(now_iso).alias("raised_at"),
    )


def tier_of(score: Column) -> Column:
    # Lowest score of each tier.
    return (
        F.when(score >= 85, F.lit("high"))
        .when(score >= 65, F.lit("moderate"))
        .when(score >= 40, F.lit("speculative"))
        .otherwise(F.lit("degen"))
    )


def conviction_tier(rows: DataFrame, score: str = "score_0_100") -> DataFrame:
    return rows.withColumn("conviction_tier", tier_of(F.coalesce(score, F.lit(0))))


def build_brief(rows: DataFrame, now_iso: str) -> DataFrame:
    """Brief payloads.

    Rows carry the verdict (msg_id, token_address, score_0_100, rationale), the lineage
    results (token_name, model_attribution) and the parsed narration: ``data`` of
    ``parse_responses`` and ``model_used``, which is null when no model answered.
    """
    answered = F.col("model_used").isNotNull()
    data = F.col("data")
    opening = blank_to_null(head(F.col("rationale"), 400))
    told = blank_to_null(strip(F.coalesce(data["thesis"], F.lit(""))))
    thesis = F.when(answered, F.coalesce(told, opening)).otherwise(
        F.coalesce(opening, F.lit(TEXT_THESIS_NO_MODEL))
    )
    return rows.select(
        F.col("msg_id").alias("verdict_id"),
        "token_name",
        "token_address",
        F.coalesce(head(thesis, 2000), F.lit(TEXT_NO_THESIS)).alias("thesis"),
        tier_of(F.coalesce("score_0_100", F.lit(0))).alias("conviction_tier"),
        F.when(answered, text_list(data["caveats"]))
        .otherwise(F.array(F.lit(TEXT_CAVEAT_NO_MODEL)))
        .alias("caveats"),
        F.when(answered, text_list(data["sources"]))
        .otherwise(F.array().cast("array<string>"))
        .alias("sources"),
        "model_attribution",
        F.lit(now_iso).alias("brief_generated_at"),
        F.when(answered, F.lit("ok")).otherwise(F.lit("degraded")).alias("confidence_tier"),
        "model_used",
    )
