"""From launch events to social and chain signals, a micro-batch at a time.

Explorer answers and search results are kept in keyed tables that the collectors refresh; a
batch of candidates looks up its own tokens in them, so that neither side's batches grow with
what was ever collected.  Each side is a query of its own with its own checkpoint.  Message ids
follow from the content and the batch's time, so a repeated batch stores nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from launchsift.functions.schemas import CANDIDATE, CHAIN, FINDING, SOCIAL, TEXT, TEXTS, TIME, struct
from launchsift.operators.chain import (
    assemble_chain,
    contract_meta,
    creator_history,
    holder_concentration,
    transfer_metrics,
    with_creator_history,
)
from launchsift.operators.envelope import build_envelopes
from launchsift.operators.ingest import decode_feed_items, normalize_candidates
from launchsift.operators.social import assemble_social, count_mentions, count_search_hits, source_status
from launchsift.sources.keyed import Keyed
from launchsift.sources.readers import BATCH_FILES, explorer_rows
from launchsift.sources.sinks import FOLDERS, store_findings
from launchsift.streaming.jobs import named, run

Now = Callable[[int], str]
TOKEN = "token_address"


@dataclass(frozen=True)
class Extracts:
    """Keyed tables of what was collected: the last answer about an address counts."""

    path: str

    def _table(self, name: str, **value: T.DataType) -> Keyed:
        return Keyed(f"{self.path}/{name}", TOKEN, struct(token_address=TEXT, **value, fetched_at=TIME), ("fetched_at",))

    def answers(self, kind: str) -> Keyed:
        """(token_address, result, fetched_at) of an explorer; ``transactions`` go by creator."""
        return self._table(kind, result=TEXT)

    @property
    def articles(self) -> Keyed:
        """(token_address, texts, fetched_at): the search results about a token, in order."""
        return self._table("articles", texts=TEXTS)


def hunt(feed: DataFrame, table: str, checkpoint: str, now: Now, continuous: bool = False) -> StreamingQuery:
    """Stores a candidate message for every item of the launch feed (``read_launch_feed``)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        at = now(batch_id)
        found = normalize_candidates(decode_feed_items(batch), at)
        store_findings(build_envelopes(found, "hunter", CANDIDATE, at), table, named(checkpoint, batch_id))

    return run(feed, each, checkpoint, continuous)


def stored_stream(spark: SparkSession, table: str, files_per_trigger: int = BATCH_FILES) -> DataFrame:
    """The findings table as a stream: every message comes at least once."""
    schema = T.StructType([*FINDING.fields, *FOLDERS.fields])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(table).drop("stored_by")


def candidates_of(findings: DataFrame) -> DataFrame:
    """(candidate_id, columns of the candidate) of the hunters' messages; others are left out."""
    read = findings.filter(F.col("agent") == "hunter").select(
        F.col("msg_id").alias("candidate_id"), F.from_json("payload", CANDIDATE).alias("c")
    )
    return read.select("candidate_id", "c.*").filter(F.col(TOKEN).isNotNull()).dropDuplicates(["candidate_id"])


def signals_of(findings: DataFrame) -> DataFrame:
    """(msg_id, token_address, side, ts) of the social and chain messages, ready to be paired."""
    return findings.filter(F.col("agent").isin("social", "chain")).select(
        "msg_id", F.get_json_object("payload", f"$.{TOKEN}").alias(TOKEN), F.col("agent").alias("side"), F.col("created_at").alias("ts")
    )


def chain_metrics(candidates: DataFrame, extracts: Extracts) -> DataFrame:
    """Chain metrics of candidates with their ``candidate_id``.

    A token that the explorer gave no answer about is degraded; an empty list is an answer.
    """
    tokens = candidates.select(TOKEN).distinct()
    names = {
        "holders": {"TokenHolderQuantity": "quantity"},
        "transfers": {"timeStamp": "time_stamp", "value": "value", "tokenDecimal": "decimals"},
        "contracts": {"SourceCode": "source_code", "ContractCreator": "creator"},
    }
    rows, failures = {}, None
    for kind, columns in names.items():
        answered = extracts.answers(kind).lookup(tokens).filter("result is not null")
        rows[kind] = explorer_rows(answered, kind).select(TOKEN, "pos", *[F.col(c).alias(n) for c, n in columns.items()])
        source = "meta" if kind == "contracts" else kind
        lost = tokens.join(answered.select(TOKEN), TOKEN, "left_anti").withColumn("source", F.lit(source))
        failures = lost if failures is None else failures.unionByName(lost)
    meta = contract_meta(rows["contracts"])
    creators = meta.select(F.col("creator_address").alias(TOKEN)).distinct()
    sent = explorer_rows(extracts.answers("transactions").lookup(creators), "transactions")
    known = with_creator_history(meta, creator_history(sent.withColumnRenamed(TOKEN, "creator_address")))
    asked = candidates.select(TOKEN, "initial_liquidity_usd").distinct()
    metrics = assemble_chain(asked, holder_concentration(rows["holders"]), known, transfer_metrics(rows["transfers"]), failures)
    same = F.col("liquidity_usd").eqNullSafe(F.col("_liquidity")) & (F.col(TOKEN) == F.col("_token"))
    ids = candidates.select("candidate_id", F.col(TOKEN).alias("_token"), F.col("initial_liquidity_usd").alias("_liquidity"))
    return metrics.join(ids, same).drop("_token", "_liquidity")


def no_score(candidates: DataFrame) -> DataFrame:
    """No model scored a candidate."""
    kinds = {"organic_score": "int", "sentiment": "double", "model_flags": "array<string>", "influencer_mentions": "array<string>", "model_used": "string"}
    return candidates.select(TOKEN).limit(0).withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()})


def social_scores(
    candidates: DataFrame, extracts: Extracts, messages: DataFrame, fetches: DataFrame, score: Callable[[DataFrame], DataFrame] = no_score
) -> DataFrame:
    """Social scores of candidates with their ``candidate_id``.

    ``messages`` (channel, pos, text) are the channels' pages, ``fetches`` (source, channel,
    success) tells which could be read.  ``score`` gives the model's parsed answers per token.
    """
    tokens = candidates.groupBy(TOKEN).agg(F.min("token_symbol").alias("symbol"))
    articles = extracts.articles.lookup(tokens).select(F.col(TOKEN).alias("query"), F.posexplode("texts").alias("pos", "text"))
    search = count_search_hits(articles).withColumnRenamed("query", TOKEN)
    unread = source_status(fetches.withColumn("all", F.lit(1)), "all").select("degraded").first()
    channels = count_mentions(messages, tokens).withColumn("degraded", F.lit(True if unread is None else bool(unread[0])))
    scored = assemble_social(tokens, search, channels, score(candidates))
    return scored.join(candidates.select("candidate_id", TOKEN), TOKEN)


def _with_candidates(each: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Hands on the candidates of a batch of findings, if it has any."""

    def run_each(batch: DataFrame, batch_id: int) -> None:
        found = candidates_of(batch).persist()
        try:
            if not found.isEmpty():
                each(found, batch_id)
        finally:
            found.unpersist()

    return run_each


def chain_side(
    findings: DataFrame, extracts: Extracts, table: str, checkpoint: str, now: Now, continuous: bool = False
) -> StreamingQuery:
    """Stores a chain message for every candidate message of ``findings``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        made = chain_metrics(batch, extracts)
        sealed = build_envelopes(made, "chain", CHAIN, now(batch_id), F.array("candidate_id"))
        store_findings(sealed, table, named(checkpoint, batch_id))

    return run(findings, _with_candidates(each), checkpoint, continuous)


def social_side(
    findings: DataFrame,
    extracts: Extracts,
    messages: Callable[[], DataFrame],
    fetches: Callable[[], DataFrame],
    table: str,
    checkpoint: str,
    now: Now,
    score: Callable[[DataFrame], DataFrame] = no_score,
    continuous: bool = False,
) -> StreamingQuery:
    """Stores a social message for every candidate message of ``findings``.

    ``messages`` and ``fetches`` are read again for every batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        made = social_scores(batch, extracts, messages(), fetches(), score)
        sealed = build_envelopes(made, "social", SOCIAL, now(batch_id), F.array("candidate_id"), F.col("model_used"))
        store_findings(sealed, table, named(checkpoint, batch_id))

    return run(findings, _with_candidates(each), checkpoint, continuous)
