"""Append-only tables and JSON streams."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from launchsift.functions.schemas import ENVELOPE, FINDING, LONG, TEXT, TIME, struct
from launchsift.operators.envelope import append_findings
from launchsift.operators.lineage import ABOVE, MISSING, closures
from launchsift.sources.files import exists
from launchsift.sources.keyed import Keyed


def envelope_lines(envelopes: DataFrame) -> DataFrame:
    """One canonical JSON text per envelope.

    The payload is already canonical text, so it is placed into the line as it is.
    """
    names = sorted(f.name for f in ENVELOPE.fields)
    parts = []
    for name in names:
        lead = F.lit(f'{"," if parts else "{"}"{name}":')
        if name == "payload":
            value = F.col(name)
        else:
            listed = F.to_json(F.array(name), {"ignoreNullFields": "false"})
            value = F.substring(listed, F.lit(2), F.length(listed) - 2)
        parts += [lead, value]
    return envelopes.select(F.concat(*parts, F.lit("}")).alias("value"))


def write_envelopes(envelopes: DataFrame, path: str) -> None:
    envelope_lines(envelopes).write.mode("append").text(path)


#: Columns that are folders of a findings table.
FOLDERS = struct(day=T.DateType(), stored_by=TEXT)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*FINDING.fields, *FOLDERS.fields])).parquet(path)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path).drop("stored_by")


SENT = "msg_id string, chat_id int, sent_at timestamp, batch bigint"


def read_sent(spark: SparkSession, outbox: str, before: int | None = None) -> DataFrame:
    """(chat_id, msg_id, sent_at) of the deliveries in an outbox, of batches below ``before``."""
    if not exists(spark, outbox):
        return spark.createDataFrame([], SENT).drop("batch")
    sent = spark.read.schema(SENT).parquet(outbox)
    return (sent if before is None else sent.filter(F.col("batch") < before)).drop("batch")


#: What the index knows of a stored id: its folder, what lies upstream and which parents were not stored.
INDEXED = struct(msg_id=TEXT, agent=TEXT, day=T.DateType(), stored_by=TEXT, above=ABOVE, missing=MISSING)
#: A search names so many folders in its filter.
NAMED_FOLDERS = 200


def findings_index(path: str) -> Keyed:
    """The index of a findings table, by id."""
    return Keyed(f"{path.rstrip('/')}_index", "msg_id", INDEXED, ("stored_by",))


def store_findings(envelopes: DataFrame, path: str, batch: str | None = None) -> None:
    """Inserts envelopes whose id is not stored yet; repeats are no-ops.

    Files are laid out by agent, day and batch, so that the reads of one agent or of recent
    days touch only their folders.  Whether an id is stored, and what lies upstream of its
    parents, is asked of the index, whose reading follows the batch and not the table.  The
    table is written before the index: a batch that is repeated under its name finds the same
    rows new and replaces its files.
    """
    name, index = batch or uuid.uuid4().hex, findings_index(path)
    arrived = envelopes.withColumn("created_at", F.to_timestamp("created_at"))
    asked = arrived.select(F.explode(F.concat(F.array("msg_id"), F.coalesce("upstream_ids", F.array()))).alias("msg_id"))
    # Looked up again after a loss they are the same: the batch does not see its own entries.
    entries = index.lookup(asked, name).persist()
    new = (
        append_findings(arrived, entries, ["created_at", "payload_hash"])
        .withColumn("on_chain_tx", F.lit(None).cast("string"))
        .withColumn("on_chain_block", F.lit(None).cast("bigint"))
        .withColumn("day", F.to_date("created_at"))
        .withColumn("stored_by", F.lit(name))
        .persist()
    )
    try:
        if new.isEmpty():
            return
        (
            # One task per agent, day and slice of the ids, so a batch leaves few files.
            new.repartition("agent", "day", F.pmod(F.xxhash64("msg_id"), F.lit(8)))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("agent", "day", "stored_by")
            .parquet(path)
        )
        above = closures(new, entries)
        index.put(new.select("msg_id", "agent", "day", "stored_by").join(above, "msg_id"), name)
    finally:
        new.unpersist()
        entries.unpersist()


def find_findings(asked: DataFrame, path: str) -> DataFrame:
    """The stored findings of the ids (``msg_id``) in ``asked``, read from their folders alone."""
    spark = asked.sparkSession
    places = findings_index(path).lookup(asked)
    folders = places.select("agent", "day", "stored_by").distinct().limit(NAMED_FOLDERS + 1).collect()
    if not folders:
        return spark.createDataFrame([], T.StructType([*FINDING.fields, FOLDERS["day"]]))
    stored = _stored(spark, path)
    if len(folders) <= NAMED_FOLDERS:
        day = [F.col("day") == F.lit(f["day"]) if f["day"] else F.col("day").isNull() for f in folders]
        each = [(F.col("agent") == f["agent"]) & d & (F.col("stored_by") == f["stored_by"]) for f, d in zip(folders, day)]
        stored = stored.filter(reduce(or_, each))
    return stored.drop("stored_by").join(asked.select("msg_id").distinct(), "msg_id", "left_semi")


def receipts_of(path: str) -> Keyed:
    """The receipts of a findings table; of several for an id the last one seen counts."""
    receipt = struct(msg_id=TEXT, on_chain_tx=TEXT, on_chain_block=LONG, seen_at=TIME)
    return Keyed(f"{path.rstrip('/')}_receipts", "msg_id", receipt, ("seen_at", "on_chain_block", "on_chain_tx"))


def store_receipts(receipts: DataFrame, path: str, batch: str | None = None) -> None:
    """Writes back (msg_id, on_chain_tx, on_chain_block, seen_at) of anchored findings.

    The findings stay as they are; the last receipt seen of an id wins when they are read.  The
    same batch again replaces its receipts.
    """
    table = receipts_of(path)
    given = receipts.filter("msg_id is not null").select(*[f.name for f in table.schema.fields])
    table.put(given, batch or uuid.uuid4().hex)


def with_receipts(findings: DataFrame, path: str) -> DataFrame:
    """Stored findings with the transaction and block of their last receipt.

    For some findings, such as those of ``find_findings``, only their receipts are looked up;
    pass ``read_findings`` for all.
    """
    latest = receipts_of(path).lookup(findings).drop("seen_at")
    return findings.drop("on_chain_tx", "on_chain_block").join(latest, "msg_id", "left")


def audited(calls: DataFrame) -> DataFrame:
    """Audit rows of model calls; failed calls carry zero tokens and cost."""
    failed = ~F.col("success")
    zero = {"input_tokens": 0, "output_tokens": 0}
    return calls.withColumns(
        {c: F.when(failed, F.lit(z)).otherwise(F.col(c)) for c, z in zero.items()}
    ).withColumn(
        "cost_usd", F.when(failed, F.lit(0)).otherwise(F.col("cost_usd")).cast("decimal(10,6)")
    ).withColumn("day", F.to_date("created_at"))


def append_llm_calls(calls: DataFrame, path: str) -> None:
    """Appends audit rows to a table laid out by day."""
    audited(calls).write.mode("append").partitionBy("day").parquet(path)
