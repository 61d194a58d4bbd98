"""Reading stored model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from launchsift.functions.constants import CONFIDENCES, TEXT_NO_MODEL, TEXT_NO_RATIONALE
from launchsift.functions.schemas import TEXT, TEXTS, struct
from launchsift.functions.text import blank_to_null, fence_body, head, is_fenced, model_tag, strip

STRICT = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
RESPONSE = struct(
    organic_score=TEXT, sentiment=TEXT, red_flags=TEXTS, influencer_mentions=TEXTS,
    rationale=TEXT, confidence=TEXT, thesis=TEXT, caveats=TEXTS, sources=TEXTS,
)


def _is_object(body: Column) -> Column:
    return body.startswith("{") & body.endswith("}") & F.json_object_keys(body).isNotNull()


def parse_responses(rows: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``body`` (fence removed), ``fenced``, ``well_formed`` and ``data``.

    ``data`` is null unless the body is a JSON object.
    """
    body = F.col("body")
    return (
        rows.withColumn("body", fence_body(F.col(content)))
        .withColumn("fenced", is_fenced(F.col(content)))
        .withColumn("well_formed", F.coalesce(_is_object(body), F.lit(False)))
        .withColumn("data", F.when(F.col("well_formed"), F.from_json(body, RESPONSE, STRICT)))
    )


def response_quality(parsed: DataFrame, by: str = "model") -> DataFrame:
    """Fenced, plain and malformed responses per model."""
    return parsed.groupBy(by).agg(
        F.count_if(F.col("fenced")).alias("fenced"),
        F.count_if(~F.col("fenced")).alias("plain"),
        F.count_if(~F.col("well_formed")).alias("malformed"),
    )


def text_list(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def score_responses(parsed: DataFrame) -> DataFrame:
    """Clamped scores, lists and the model tag of parsed social responses."""
    data = F.col("data")
    organic = F.coalesce(
        data["organic_score"].try_cast("double").cast("decimal(38,6)").try_cast("bigint"), F.lit(0)
    )
    sentiment = F.coalesce(data["sentiment"].try_cast("double"), F.lit(0.0))
    return parsed.withColumns(
        {
            "organic_score": F.greatest(F.lit(0), F.least(F.lit(100), organic)).cast("int"),
            "sentiment": F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sentiment)),
            "model_flags": text_list(data["red_flags"]),
            "influencer_mentions": text_list(data["influencer_mentions"]),
            "model_used": model_tag(F.col("provider"), F.col("model")),
        }
    ).drop("data", "body")


def parse_rationales(rows: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``rationale``, ``confidence`` and ``model_used`` (null without a response)."""
    parsed = parse_responses(rows, content)
    data, raw = F.col("data"), F.col(content)
    said = F.lower(F.coalesce(data["confidence"], F.lit("medium")))
    rationale = (
        F.when(raw.isNull(), F.lit(TEXT_NO_MODEL))
        .when(
            F.col("well_formed"),
            F.coalesce(
                blank_to_null(strip(F.coalesce(data["rationale"], F.lit("")))),
                F.lit(TEXT_NO_RATIONALE),
            ),
        )
        .otherwise(head(raw, 400))
    )
    confidence = (
        F.when(raw.isNull(), F.lit(None))
        .when(~F.col("well_formed"), F.lit("low"))
        .when(said.isin(*CONFIDENCES), said)
        .otherwise(F.lit("medium"))
    )
    tag = F.when(raw.isNotNull(), model_tag(F.col("provider"), F.col("model")))
    return parsed.withColumns(
        {"rationale": rationale, "confidence": confidence, "model_used": tag}
    ).drop("data", "body", "fenced", "well_formed")
