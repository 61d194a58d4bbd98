"""From paired signals to verdicts, briefs and review requests, a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from launchsift.functions.constants import PAIR_TIMEOUT_S
from launchsift.functions.schemas import BRIEF, CHAIN, REVIEW, SOCIAL, VERDICT
from launchsift.operators.brief import build_brief, human_review, route_verdicts
from launchsift.operators.envelope import build_envelopes
from launchsift.operators.lineage import cut_plan, kept_lineage, kept_names, model_attribution
from launchsift.operators.modeltext import parse_responses
from launchsift.operators.risk import aggregate_score, build_verdict, partial_verdicts, run_rules
from launchsift.sources.sinks import find_findings, findings_index, store_findings
from launchsift.streaming.jobs import named, run

Step = Callable[[DataFrame], DataFrame]


def unanswered(scored: DataFrame) -> DataFrame:
    """No model gave a rationale."""
    return scored.withColumns({c: F.lit(None).cast("string") for c in ("rationale", "confidence", "model_used")})


def untold(verdicts: DataFrame) -> DataFrame:
    """No model told a brief."""
    return verdicts.withColumns({c: F.lit(None).cast("string") for c in ("content", "model_used")})


def _side(findings: DataFrame, side: str, schema: T.StructType) -> DataFrame:
    p = F.from_json("payload", schema)
    return findings.filter(F.col("agent") == side).select(F.col("msg_id").alias(f"{side}_id"), p.alias(f"_{side}"))


def verdicts_of(
    pairs: DataFrame, findings: DataFrame, answer: Step = unanswered, timeout_s: float = PAIR_TIMEOUT_S
) -> DataFrame:
    """Verdict payloads with ``upstream_ids`` and ``model_used`` for pairs and lone halves.

    ``answer`` adds (rationale, confidence, model_used) to scored rows.  A pair one of whose
    messages is not stored counts as the other half alone.
    """
    found = (
        pairs.join(_side(findings, "social", SOCIAL), "social_id", "left")
        .join(_side(findings, "chain", CHAIN), "chain_id", "left")
        .withColumn(
            "missing",
            F.coalesce(
                "missing",
                F.when(F.col("_chain").isNull(), F.lit("chain")).when(F.col("_social").isNull(), F.lit("social")),
            ),
        )
    )
    s, c = F.col("_social"), F.col("_chain")
    rows = found.filter("missing is null").select(
        "token_address", "social_id", "chain_id",
        *[s[n].alias(n) for n in ("organic_score", "sentiment", "red_flags")],
        s["data_quality"].alias("social_quality"), c["data_quality"].alias("chain_quality"),
        *[c[f.name].alias(f.name) for f in CHAIN.fields if f.name not in ("token_address", "data_quality")],
    )
    whole = build_verdict(answer(aggregate_score(run_rules(rows))))
    lone = found.filter("missing is not null").withColumns(
        {
            "social_id": F.when(F.col("missing") == "chain", F.col("social_id")),
            "chain_id": F.when(F.col("missing") == "social", F.col("chain_id")),
        }
    )
    part = partial_verdicts(lone, timeout_s).withColumns(
        {"upstream_ids": F.array("upstream_id"), "model_used": F.lit(None).cast("string")}
    )
    return whole.unionByName(part.drop("upstream_id"))


def decide(
    pairs: DataFrame,
    table: str,
    checkpoint: str,
    now: Callable[[int], str],
    answer: Step = unanswered,
    tell: Step = untold,
    continuous: bool = False,
    timeout_s: float = PAIR_TIMEOUT_S,
) -> StreamingQuery:
    """Stores a verdict for every pair and a brief or a review request for every verdict.

    ``now`` gives a batch's time; with it all ids follow from the content, so a repeated
    batch changes nothing.  ``tell`` adds (content, model_used) to verdicts that get a brief.
    A batch reads the folders of its own messages and the index entries of what lies upstream
    of them; neither grows with the table.
    """

    def each(paired: DataFrame, batch_id: int) -> None:
        # Kept, as every further reading would run the pairing's state again.
        batch = paired.persist()
        try:
            if not batch.isEmpty():
                settle(batch, batch_id)
        finally:
            batch.unpersist()

    def settle(batch: DataFrame, batch_id: int) -> None:
        at, name = now(batch_id), named(checkpoint, batch_id)
        halves = [batch.select(F.col(f"{side}_id").alias("msg_id")) for side in ("social", "chain")]
        asked = halves[0].unionByName(halves[1]).filter("msg_id is not null")
        made = verdicts_of(batch, find_findings(asked, table), answer, timeout_s)
        sealed = build_envelopes(made, "risk", VERDICT, at, F.col("upstream_ids"), F.col("model_used")).persist()
        try:
            store_findings(sealed, table, f"{name}-risk")
            verdicts = sealed.select("msg_id", F.from_json("payload", VERDICT).alias("v")).select("msg_id", "v.*")
            to_brief, to_review = route_verdicts(verdicts)
            reviews = build_envelopes(human_review(to_review, at), "narrator", REVIEW, at, F.array("risk_verdict_msg_id"))
            store_findings(reviews, table, f"{name}-review")
            told = parse_responses(tell(to_brief)).withColumn("start_id", F.col("msg_id"))
            closure = cut_plan(kept_lineage(told.select("start_id"), findings_index(table).lookup))
            models = model_attribution(
                closure.select("start_id", "msg_id"),
                closure.select("msg_id", "model_used").distinct(),
                told.select("start_id", "model_used"),
            )
            rows = told.join(kept_names(closure), "start_id").join(models, "start_id")
            briefs = build_envelopes(
                build_brief(rows, at), "narrator", BRIEF, at, F.array("verdict_id"), F.col("model_used")
            )
            store_findings(briefs, table, f"{name}-brief")
        finally:
            sealed.unpersist()

    return run(pairs, each, checkpoint, continuous)
