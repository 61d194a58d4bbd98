"""Explicit Spark schemas of the stored and exchanged entities."""

from __future__ import annotations

from pyspark.sql import types as T


TEXT, LONG, INT, DOUBLE = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
FLAG, TIME, MONEY = T.BooleanType(), T.TimestampType(), T.DecimalType(10, 6)
TEXTS = T.ArrayType(TEXT)


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


FEED_ITEM = struct(
    address=TEXT, creator=TEXT, name=TEXT, symbol=TEXT, liquidityUsd=TEXT, launchedAt=TEXT,
    url=TEXT,
)
LOG_ENTRY = struct(block=LONG, address=TEXT, topics=TEXTS, data=TEXT, transactionHash=TEXT)
ENVELOPE = struct(
    msg_id=TEXT, agent=TEXT, upstream_ids=TEXTS, payload_hash=TEXT, payload=TEXT,
    created_at=TEXT, model_used=TEXT,
)
FINDING = struct(
    msg_id=TEXT, agent=TEXT, payload_hash=TEXT, upstream_ids=TEXTS, payload=TEXT,
    model_used=TEXT, created_at=TIME, on_chain_tx=TEXT, on_chain_block=LONG,
)
MODEL_CALL = struct(
    agent=TEXT, provider=TEXT, model=TEXT, prompt_hash=TEXT, response_hash=TEXT,
    input_tokens=LONG, output_tokens=LONG, cost_usd=MONEY, latency_ms=LONG, success=FLAG,
    error_class=TEXT, created_at=TIME,
)
SIGNAL = struct(msg_id=TEXT, token_address=TEXT, side=TEXT, ts=TIME)

CANDIDATE = struct(
    token_address=TEXT, launch_timestamp=TEXT, creator_address=TEXT, token_name=TEXT,
    token_symbol=TEXT, initial_liquidity_usd=DOUBLE, source_url=TEXT,
)
SOCIAL = struct(
    token_address=TEXT, organic_score=INT, mentions_24h=INT, sentiment=DOUBLE, red_flags=TEXTS,
    influencer_mentions=TEXTS, data_quality=TEXT,
)
CHAIN = struct(
    token_address=TEXT, holder_count=INT, top10_concentration_pct=DOUBLE, liquidity_usd=DOUBLE,
    buy_sell_velocity_tx_per_min=DOUBLE, whale_entries=INT, contract_verified=FLAG,
    honeypot_check_passed=FLAG, lp_locked=FLAG, creator_previous_tokens=INT, data_quality=TEXT,
)
VERDICT = struct(
    token_address=TEXT, score_0_100=INT, red_flags=TEXTS, rationale=TEXT, missing_inputs=TEXTS,
    confidence=TEXT, requires_human_review=FLAG,
)
BRIEF = struct(
    token_name=TEXT, token_address=TEXT, thesis=TEXT, conviction_tier=TEXT, caveats=TEXTS,
    sources=TEXTS, model_attribution=TEXTS, brief_generated_at=TEXT, confidence_tier=TEXT,
)
REVIEW = struct(
    token_address=TEXT, reason=TEXT, risk_verdict_msg_id=TEXT, raised_at=TEXT,
)

EXPLORER_ROWS = {
    "holders": struct(TokenHolderQuantity=TEXT),
    "transfers": struct(timeStamp=TEXT, value=TEXT, tokenDecimal=TEXT),
    "contracts": struct(SourceCode=TEXT, ContractCreator=TEXT),
    "transactions": struct(hash=TEXT, timeStamp=TEXT),
}
