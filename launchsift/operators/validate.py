"""Declarative validation of envelopes and payloads, and the dead-letter split.

Every check is a named Boolean column; a row's ``errors`` array lists the names of the
checks it fails, so bad rows can be routed instead of failing a job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from launchsift.functions import schemas
from launchsift.functions.constants import (
    ADDRESS,
    AGENTS,
    CONFIDENCES,
    CROCKFORD_ID,
    HEX64,
    QUALITIES,
    TIERS,
)
from launchsift.functions.text import chosen, computed_once, strip


def _errors(checks: list[tuple[str, Column]]) -> Column:
    """Names of the checks that are not true (a null outcome counts as failed)."""
    return chosen(*[(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks])


def validate_envelopes(envelopes: DataFrame) -> DataFrame:
    """Adds ``errors``; texts are compared stripped and ids upper-cased, as they are stored.

    ``extra_keys``, which decoding adds, is checked and dropped.
    """
    created = strip(F.col("created_at"))
    model = strip(F.col("model_used"))
    zoned = (
        created.endswith("Z")
        | F.contains(created, F.lit("+"))
        | F.contains(F.substring(created, 11, 2**31 - 1), F.lit("-"))
    )
    checks = [
        ("msg_id", F.upper(strip(F.col("msg_id"))).rlike(CROCKFORD_ID)),
        ("agent", F.col("agent").isin(*AGENTS)),
        (
            "upstream_ids",
            F.forall("upstream_ids", lambda u: F.upper(strip(u)).rlike(CROCKFORD_ID)),
        ),
        ("payload_hash", strip(F.col("payload_hash")).rlike(HEX64)),
        ("payload", strip(F.col("payload")).startswith("{")),
        ("created_at", F.contains(created, F.lit("T")) & zoned),
        (
            "model_used",
            model.isNull()
            | (F.contains(model, F.lit("/")) & ~model.startswith("/") & ~model.endswith("/")),
        ),
    ]
    if "extra_keys" in envelopes.columns:
        checks.append(("unknown_keys", F.size("extra_keys") == 0))
    return envelopes.withColumn("errors", _errors(checks)).drop("extra_keys")


def _has_type(kind: Column, value: Column, dtype: T.DataType) -> Column:
    """Whether a JSON value of ``kind`` may stand for ``dtype``: its own type, or a text that spells it."""
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE)")
    spelled = (kind == "STRING") & value.isNotNull()
    if isinstance(dtype, T.StringType):
        return kind == "STRING"
    if isinstance(dtype, T.BooleanType):
        return (kind == "BOOLEAN") | spelled
    if isinstance(dtype, T.ArrayType):
        texts = kind.isin("ARRAY<STRING>", "ARRAY<VOID>")
        return texts & F.coalesce(F.forall(value, lambda x: x.isNotNull()), F.lit(False))
    if isinstance(dtype, T.DoubleType):
        return number | spelled
    # A fraction reads as null where a whole number is asked for (see ``_reading``).
    return (number & value.isNotNull()) | spelled


def _reading(raw: Column, dtype: T.DataType) -> Column:
    """(kind, value) of a JSON value; an absent one has no kind, a null is of kind VOID."""
    kind = F.schema_of_variant(raw)
    value = F.try_variant_get(raw, "$", dtype.simpleString())
    if isinstance(dtype, (T.IntegerType, T.LongType)):
        exact = F.try_variant_get(raw, "$", "double")
        value = F.when((kind == "BIGINT") | (exact == F.floor(exact)), value)
    return F.struct(kind.alias("kind"), value.alias("value"))


@dataclass(frozen=True)
class Field:
    """Rules of one payload field; ``optional`` ones may be absent, ``nullable`` ones null."""

    name: str
    pattern: str | None = None
    length: tuple[int, int] | None = None
    low: float | None = None
    high: float | None = None
    among: tuple[str, ...] | None = None
    optional: bool = False
    nullable: bool = False

    def ok(self, read: Column, dtype: T.DataType) -> Column:
        """``read`` is the field's (kind, value)."""
        kind, value = read["kind"], read["value"]
        if isinstance(dtype, T.StringType):
            value = strip(value)
        good = value.isNotNull() & _has_type(kind, value, dtype)
        if self.pattern is not None:
            good = good & value.rlike(self.pattern)
        if self.length is not None:
            good = good & F.length(value).between(*self.length)
        if isinstance(dtype, T.DoubleType):
            good = good & ~F.isnan(value)
        if self.low is not None:
            good = good & (value >= self.low)
        if self.high is not None:
            good = good & (value <= self.high)
        if self.among is not None:
            good = good & value.isin(*self.among)
        return (
            F.when(kind.isNull(), F.lit(self.optional))
            .when(kind == "VOID", F.lit(self.nullable))
            .otherwise(good)
        )


@dataclass(frozen=True)
class PayloadRules:
    schema: T.StructType
    fields: tuple[Field, ...]


_ADDRESS = Field("token_address", pattern=ADDRESS)
_QUALITY = {"among": QUALITIES, "optional": True}

# Field limits of the six payload kinds.
PAYLOADS: dict[str, PayloadRules] = {
    "candidate": PayloadRules(
        schemas.CANDIDATE,
        (
            _ADDRESS,
            Field("launch_timestamp"),
            Field("creator_address", pattern=ADDRESS),
            Field("token_name", length=(1, 128)),
            Field("token_symbol", length=(1, 32)),
            Field("initial_liquidity_usd", low=0),
            Field("source_url", length=(1, 1024)),
        ),
    ),
    "social": PayloadRules(
        schemas.SOCIAL,
        (
            _ADDRESS,
            Field("organic_score", low=0, high=100),
            Field("mentions_24h", low=0),
            Field("sentiment", low=-1.0, high=1.0),
            Field("red_flags", optional=True),
            Field("influencer_mentions", optional=True),
            Field("data_quality", **_QUALITY),
        ),
    ),
    "chain": PayloadRules(
        schemas.CHAIN,
        (
            _ADDRESS,
            Field("holder_count", low=0),
            Field("top10_concentration_pct", low=0, high=100),
            Field("liquidity_usd", low=0),
            Field("buy_sell_velocity_tx_per_min", low=0),
            Field("whale_entries", low=0),
            Field("contract_verified"),
            Field("honeypot_check_passed"),
            Field("lp_locked"),
            Field("creator_previous_tokens", low=0),
            Field("data_quality", **_QUALITY),
        ),
    ),
    "verdict": PayloadRules(
        schemas.VERDICT,
        (
            _ADDRESS,
            Field("score_0_100", low=0, high=100, optional=True, nullable=True),
            Field("red_flags", optional=True),
            Field("rationale", length=(0, 4000)),
            Field("missing_inputs", optional=True),
            Field("confidence", among=CONFIDENCES, optional=True, nullable=True),
            Field("requires_human_review", optional=True),
        ),
    ),
    "brief": PayloadRules(
        schemas.BRIEF,
        (
            Field("token_name", length=(1, 128)),
            _ADDRESS,
            Field("thesis", length=(50, 2000)),
            Field("conviction_tier", among=TIERS),
            Field("caveats", optional=True),
            Field("sources", optional=True),
            Field("model_attribution", optional=True),
            Field("brief_generated_at"),
            Field("confidence_tier", **_QUALITY),
        ),
    ),
    "review": PayloadRules(
        schemas.REVIEW,
        (
            _ADDRESS,
            Field("reason", length=(1, 1024)),
            Field("risk_verdict_msg_id", length=(26, 26)),
            Field("raised_at"),
        ),
    ),
}


#: Fields that are read and checked in one step.
STEP = 2


def validate_payload(
    rows: DataFrame, kind: str, payload: str = "payload", keep: str | None = None
) -> DataFrame:
    """Adds ``errors`` for a JSON payload column: failed fields, then ``unknown_keys``.

    With ``keep`` the decoded payload stays in a column of that name.
    """
    rules = PAYLOADS[kind]
    # Parsed once: absent keys, nulls and wrong types all stay apart.
    entries = F.try_variant_get(F.try_parse_json(F.col(payload)), "$", "map<string,variant>")
    known = F.array(*[F.lit(f.name) for f in rules.fields])
    parsed = computed_once(rows, "_json", entries)
    types = {f.name: rules.schema[f.name].dataType for f in rules.fields}
    # Few fields a step: the code made for one step stays small enough to be compiled.
    names, read, checks = list(types), {}, []
    for at in range(0, len(names), STEP):
        mine = names[at : at + STEP]
        readings = [_reading(F.try_element_at(F.col("_json"), F.lit(n)), types[n]).alias(n) for n in mine]
        parsed = computed_once(parsed, f"_read{at}", F.struct(*readings))
        read |= {n: F.col(f"_read{at}")[n] for n in mine}
        oks = [f.ok(read[f.name], types[f.name]).alias(f.name) for f in rules.fields if f.name in mine]
        parsed = computed_once(parsed, f"_ok{at}", F.struct(*oks))
        checks += [(f.name, F.col(f"_ok{at}")[f.name]) for f in rules.fields if f.name in mine]
    order = [f.name for f in rules.fields]
    checks.sort(key=lambda c: order.index(c[0]))
    helpers = [f"_{kind}{at}" for kind in ("read", "ok") for at in range(0, len(names), STEP)]
    extra = F.array_except(F.coalesce(F.map_keys("_json"), F.array().cast("array<string>")), known)
    checks.append(("unknown_keys", F.size(extra) == 0))
    checked = parsed.withColumn("errors", _errors(checks))
    if keep is not None:
        checked = checked.withColumn(keep, F.struct(*[r["value"].alias(n) for n, r in read.items()]))
    return checked.drop("_json", *helpers)


#: The payload kinds that each agent may send.
KINDS = {
    "hunter": ("candidate",), "social": ("social",), "chain": ("chain",), "risk": ("verdict",),
    "narrator": ("brief", "review"),
}


def validate_messages(envelopes: DataFrame) -> DataFrame:
    """``validate_envelopes`` and, for valid envelopes, the errors of the agent's payload kind.

    Of several kinds the payload needs to fit one; the errors of the first are told otherwise.
    """
    checked = validate_envelopes(envelopes).withColumnRenamed("errors", "_envelope")
    wrong = F.lit(None).cast("array<string>")
    for agent, kinds in KINDS.items():
        found = []
        for kind in kinds:
            mine = F.when((F.col("agent") == agent) & (F.size("_envelope") == 0), F.col("payload"))
            checked = validate_payload(checked.withColumn("_mine", mine), kind, "_mine").withColumnRenamed("errors", f"_{kind}").drop("_mine")
            found.append(F.col(f"_{kind}"))
        told = found[0]
        for other in found[1:]:
            told = F.when(F.size(other) == 0, other).otherwise(told)
        wrong = F.when(F.col("agent") == agent, told).otherwise(wrong)
    all_kinds = [f"_{kind}" for kinds in KINDS.values() for kind in kinds]
    errors = F.when(F.size("_envelope") > 0, F.col("_envelope")).otherwise(
        F.coalesce(F.transform(wrong, lambda e: F.concat(F.lit("payload."), e)), F.array().cast("array<string>"))
    )
    return checked.withColumn("errors", errors).drop("_envelope", *all_kinds)


def split_quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without ``errors``, rejected rows with ``errors``)."""
    bad = F.size("errors") > 0
    return checked.filter(~bad).drop("errors"), checked.filter(bad)
