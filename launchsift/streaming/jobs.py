"""Streaming queries: checkpoints stand for consumer groups, folders for streams.

Each query has its own checkpoint, so two queries on one folder are two groups that both
see every message.  A restarted query continues after its last finished batch and
repeats an unfinished one; the sinks ignore ids they already hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from datetime import datetime
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from launchsift.functions.constants import DELIVERY_MEMORY_S
from launchsift.functions.schemas import INT, TEXT, TIME, struct
from launchsift.functions.text import strip
from launchsift.operators.delivery import match_threshold
from launchsift.operators.validate import split_quarantine, validate_messages
from launchsift.sources.files import exists, remove
from launchsift.sources.keyed import Keyed
from launchsift.sources.sinks import store_findings

BLOCK = "5 seconds"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def run(
    stream: DataFrame,
    each_batch: Callable[[DataFrame, int], None],
    checkpoint: str,
    continuous: bool = False,
    every: str = BLOCK,
) -> StreamingQuery:
    """Starts a query that hands every micro-batch to ``each_batch``.

    Without ``continuous`` it processes what is there and stops.
    """
    writer = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    return start(writer, continuous, every, stream.sparkSession)


def start(
    writer: DataStreamWriter, continuous: bool = False, every: str = BLOCK, spark: SparkSession | None = None
) -> StreamingQuery:
    """Starts ``writer`` for good or for what is there.

    Timers by the clock ask for batches without data, with which a query over what is there
    would never end; those are left out, and its timers fire with the next data.  ``spark`` is
    the stream's session, if it may not be the active one.
    """
    if continuous:
        return writer.trigger(processingTime=every).start()
    conf = (spark or SparkSession.active()).conf
    before = conf.get(EMPTY_BATCHES)
    conf.set(EMPTY_BATCHES, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(EMPTY_BATCHES, before)


def named(checkpoint: str, batch_id: int) -> str:
    """A name of a batch that no other query has: checkpoints tell queries apart."""
    return f"{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}-{batch_id}"


def without_time(rows: DataFrame, ts: str = "launch_ts", key: str = "token_address") -> DataFrame:
    """Rows that lack their time or key, for the dead letters."""
    return rows.filter(F.col(ts).isNull() | F.col(key).isNull())


def dedup_launches(
    candidates: DataFrame, ts: str = "launch_ts", window_s: int = 86_400, late_s: int = 7 * 86_400
) -> DataFrame:
    """One candidate per address and ``window_s`` seconds of ``ts``.

    A row that lies apart from every candidate passed on so far is passed on, whenever it
    arrives.  The times passed on are remembered per address for ``late_s`` seconds: those that
    lie further back than the newest one by that and the window are forgotten, and so is an
    address that was silent by the clock for as long.  Only a row that comes later than
    ``late_s`` can therefore repeat a launch.  ``without_time`` gives the rows left out here.
    """
    limit, late = window_s * 1_000_000, late_s * 1_000_000

    def step(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("_at")
        keep = []
        for at in rows["_at"].astype(int):
            keep.append(all(abs(at - k) >= limit for k in known))
            if keep[-1]:
                known.append(at)
        newest = max(known)
        state.update(([k for k in known if k >= newest - late - limit],))
        state.setTimeoutDuration((window_s + late_s) * 1000)
        yield rows[keep].drop(columns="_at")

    return (
        candidates.filter(F.col(ts).isNotNull() & F.col("token_address").isNotNull())
        .withColumn("_at", F.unix_micros(ts))
        .groupBy("token_address")
        .applyInPandasWithState(
            step, candidates.schema, "times array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout
        )
    )


#: How often a message is tried before it goes to the dead letters.
ATTEMPTS = 3


def retried(
    stream: DataFrame,
    work: Callable[[DataFrame, str], None],
    dead_letters: str,
    waiting: str,
    checkpoint: str,
    attempts: int = ATTEMPTS,
    key: str = "msg_id",
    continuous: bool = False,
) -> StreamingQuery:
    """Hands every batch to ``work``; a message whose work raises does not stop the others.

    A batch that fails is halved by a hash of ``key`` until the failing messages stand alone.
    Each of them waits with its count of attempts and is tried again with the next batch; at
    ``attempts`` it goes to the dead letters with its last error.  The counts lie in
    ``waiting`` by batch, so they survive a restart and a repeated batch counts once.  ``work``
    gets a name per part and must do nothing twice under that name.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, failed = batch.sparkSession, []
        todo, before = batch.withColumn("attempts", F.lit(0)), f"{waiting}/batch={batch_id - 1}"
        if exists(spark, before):
            todo = todo.unionByName(spark.read.schema(todo.schema).parquet(before))
        todo = todo.withColumn("_hash", F.xxhash64(F.col(key).cast("string"))).persist()

        def attempt(part: DataFrame, bits: str) -> None:
            try:
                work(part.drop("attempts", "_hash"), f"{named(checkpoint, batch_id)}-{bits}")
            except Exception as error:
                if part.select("_hash").distinct().limit(2).count() == 1:
                    failed.append(part.withColumn("error", F.lit(str(error)[:500])))
                    return
                for bit in (0, 1):
                    half = part.filter(F.shiftright("_hash", len(bits)).bitwiseAND(F.lit(1)) == bit)
                    if not half.isEmpty():
                        attempt(half, f"{bits}{bit}")

        try:
            if not todo.isEmpty():
                attempt(todo, "")
            remove(spark, f"{waiting}/batch={batch_id}")
            if failed:
                counted = reduce(DataFrame.unionByName, failed).withColumn("attempts", F.col("attempts") + 1).drop("_hash")
                given_up = F.col("attempts") >= attempts
                counted.filter(given_up).write.mode("overwrite").json(f"{dead_letters}/batch={batch_id}")
                counted.filter(~given_up).drop("error").write.mode("overwrite").parquet(f"{waiting}/batch={batch_id}")
            remove(spark, f"{waiting}/batch={batch_id - 2}")
        finally:
            todo.unpersist()

    return run(stream, each, checkpoint, continuous)


def store_valid(
    envelopes: DataFrame, table: str, dead_letters: str, checkpoint: str, continuous: bool = False
) -> StreamingQuery:
    """Envelopes with valid payloads into the findings table, the others to the dead letters.

    Each batch writes its dead letters into its own folder, overwriting what an earlier
    attempt of the same batch left there.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        checked = validate_messages(batch).persist()
        try:
            good, bad = split_quarantine(checked)
            good = good.drop("raw").withColumns(
                {
                    "msg_id": F.upper(strip(F.col("msg_id"))),
                    "upstream_ids": F.transform("upstream_ids", lambda u: F.upper(strip(u))),
                    "payload_hash": strip(F.col("payload_hash")),
                    "created_at": strip(F.col("created_at")),
                    "model_used": strip(F.col("model_used")),
                }
            )
            store_findings(good, table, named(checkpoint, batch_id))
            bad.write.mode("overwrite").json(f"{dead_letters}/batch={batch_id}")
        finally:
            checked.unpersist()

    return run(envelopes, each, checkpoint, continuous)


def deliver(
    briefs: DataFrame,
    subscriptions: Callable[[], DataFrame],
    outbox: str,
    checkpoint: str,
    continuous: bool = False,
    now: Callable[[int], Column] | None = None,
) -> StreamingQuery:
    """Writes the deliveries that each batch of new briefs calls for.

    What a chat remembers is looked up for the batch's chats and messages alone: when the
    chat's unbroken row of sends began and ended, and when a message was sent to it.  Neither
    lookup grows with the outbox.  A repeated batch does not see its own deliveries and
    replaces them; its time of sending is kept, so it decides the same.  ``subscriptions`` is
    read again for every batch; ``now`` gives a batch's time of sending (the clock unless given).
    """
    chats, sends = delivery_memory(outbox)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, named(checkpoint, batch_id)
        at = F.lit(_time_of(spark, f"{outbox}_times/batch={batch_id}", now and now(batch_id)))
        due = due_deliveries(match_threshold(batch, subscriptions()), chats, sends, at, name).persist()
        try:
            sent = due.select("msg_id", "chat_id", at.alias("sent_at"))
            sent.write.mode("overwrite").parquet(f"{outbox}/batch={batch_id}")
            sends.put(sent.select(pair_key(), "sent_at"), name)
            chats.put(due.groupBy("chat_id").agg(F.min("since").alias("since"), F.lit(at).alias("last")), name)
        finally:
            due.unpersist()

    return run(briefs, each, checkpoint, continuous)


def _time_of(spark: SparkSession, path: str, given: Column | None) -> datetime:
    """The time of a batch: what was noted when it was tried first, else the given or present one."""
    if not exists(spark, path):
        once = spark.range(1).select((F.current_timestamp() if given is None else given).alias("at"))
        once.coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.schema("at timestamp").parquet(path).first()[0]


def pair_key() -> Column:
    return F.concat_ws(":", "chat_id", "msg_id").alias("pair")


def delivery_memory(outbox: str) -> tuple[Keyed, Keyed]:
    """(chats with the first and last send of their present row of sends, sends by chat and message)."""
    chats = struct(chat_id=INT, since=TIME, last=TIME)
    return (
        Keyed(f"{outbox}_chats", "chat_id", chats, ("last", "since")),
        Keyed(f"{outbox}_sends", "pair", struct(pair=TEXT, sent_at=TIME), ("sent_at",)),
    )


def due_deliveries(
    matches: DataFrame, chats: Keyed, sends: Keyed, at: Column, batch: str, memory_s: int = DELIVERY_MEMORY_S
) -> DataFrame:
    """(msg_id, chat_id, since) of the matches that the chats do not remember.

    A chat remembers what it was sent since its last silence of ``memory_s`` or more; ``since``
    is when its row of sends began, counting the present one.
    """
    matches = matches.select("msg_id", "chat_id", pair_key()).distinct()
    known = chats.lookup(matches, batch).filter(F.unix_micros(at) - F.unix_micros("last") < memory_s * 1_000_000)
    told = sends.lookup(matches, batch)
    return (
        matches.join(known.select("chat_id", "since"), "chat_id", "left")
        .join(told, "pair", "left")
        .filter(F.coalesce(F.col("sent_at") < F.col("since"), F.lit(True)))
        .select("msg_id", "chat_id", F.coalesce("since", at).alias("since"))
    )
