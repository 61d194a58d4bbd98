"""Streaming queries: equal to batch, unharmed by a restart, repeatable sinks."""

import json
import random
import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F
from pyspark.sql import types as T

from launchsift.functions import schemas
from launchsift.operators import delivery, envelope, lineage, risk
from launchsift.sources import files as files_of
from launchsift.sources import keyed, readers, sinks
from launchsift.streaming import decide, jobs, pairing

START = datetime(2026, 1, 1, tzinfo=timezone.utc)
SIGNALS = "msg_id string, token_address string, side string, ts timestamp"


def at(seconds):
    return START + timedelta(seconds=seconds)


def signals(spark, data):
    return spark.createDataFrame([(m, t, s, at(x)) for m, t, s, x in data], SIGNALS)


def drain(stream, spark, folder, checkpoint, mode="append"):
    writer = stream.writeStream.format("parquet").option("path", str(folder))
    query = jobs.start(writer.option("checkpointLocation", str(checkpoint)).outputMode(mode))
    assert query.awaitTermination(90)
    return spark.read.schema(stream.schema).parquet(str(folder))


def test_exact_pairing_equals_batch_over_restarts(spark, rows, tmp_path):
    rng = random.Random(21)
    data, t = [], 0
    for i in range(160):
        t += rng.randint(1, 60)
        data.append((f"{i:04d}", rng.choice(["hot", "hot", "a", "b"]), rng.choice(["social", "chain"]), t))
    end = [("zzzz", "sentinel", "social", t + 10_000)]
    want = rows(
        risk.pair_signals(signals(spark, data), 120, now=F.lit(at(t + 10_000))),
    )
    source = tmp_path / "in"
    stream = lambda: pairing.pair_exact(
        spark.readStream.schema(SIGNALS).parquet(str(source)), 120, idle_s=600
    )
    # Three runs of the same query: each continues from the checkpoint of the one before.
    for part in (data[:50], data[50:110], data[110:]):
        signals(spark, part).coalesce(1).write.mode("append").parquet(str(source))
        out = drain(stream(), spark, tmp_path / "out", tmp_path / "cp")
    open_ends = [r for r in want if r not in rows(out)]
    # What is missing waits in the state: at most one half per token, of the last rows.
    assert set(rows(out)) <= set(want) and len(open_ends) <= 3 and all(r[3] for r in open_ends)
    signals(spark, end).coalesce(1).write.mode("append").parquet(str(source))
    out = drain(stream(), spark, tmp_path / "out", tmp_path / "cp")
    assert set(rows(out)) <= set(want)


def fed(spark, tmp_path, batches, idle_s=600, waits=()):
    """Results of the pairing stream after each batch arrived on its own."""
    source, out = tmp_path / "in", None
    for k, part in enumerate(batches):
        time.sleep(waits[k] if k < len(waits) else 0)
        signals(spark, part).coalesce(1).write.mode("append").parquet(str(source))
        stream = pairing.pair_exact(spark.readStream.schema(SIGNALS).parquet(str(source)), 120, idle_s)
        out = drain(stream, spark, tmp_path / "out", tmp_path / "cp")
    return out


def test_late_halves_pair_or_become_partial(spark, rows, tmp_path):
    out = fed(
        spark,
        tmp_path,
        [
            [("s1", "a", "social", 1000), ("c9", "x", "chain", 9000)],
            [("c1", "a", "chain", 950)],  # late, within the timeout: pairs
            [("s2", "b", "social", 5000)],
            [("c2", "b", "chain", 500)],  # far too old for s2: partial at once, s2 waits on
            [("c3", "b", "chain", 5060)],
            [("s4", "c", "social", 100), ("s5", "c", "social", 90)],  # the newer one waits
            [("c5", "c", "chain", 110)],
        ],
    )
    assert rows(out) == sorted(
        [("a", "s1", "c1", None), ("b", None, "c2", "social"), ("b", "s2", "c3", None), ("c", "s4", "c5", None)], key=repr
    )


def test_every_late_message_once(spark, tmp_path):
    rng = random.Random(8)
    data = [(f"{i:04d}", rng.choice("ab"), rng.choice(["social", "chain"]), 1000 * rng.randint(0, 40)) for i in range(60)]
    data = [m for m in {(t, x): (i, t, s, x) for i, t, s, x in data}.values()]  # no two of a token at one time
    rng.shuffle(data)
    end = [("zz", t, "social", 10**6) for t in ("a", "b")]
    out = fed(spark, tmp_path, [data[:20], data[20:40], data[40:], [end[0]], [end[1]]])
    seen = [m for r in out.collect() for m in (r.social_id, r.chain_id) if m]
    assert sorted(seen) == sorted(i for i, *_ in data)  # all lie apart, so all are partial


def test_silent_halves_expire_by_the_clock(spark, rows, tmp_path):
    out = fed(spark, tmp_path, [[("s1", "a", "social", 100)], [("s2", "b", "social", 100)]], 1, (0, 3))
    assert ("a", "s1", None, "chain") in rows(out)


def test_launch_dedup(spark, tmp_path):
    kind = "token_address string, launch_ts timestamp"
    (tmp_path / "in").mkdir()
    stream = jobs.dedup_launches(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
    hour = 3600
    batches = [
        [("a", at(0)), ("a", at(60)), ("b", at(0))],
        [("a", at(hour)), ("d", at(100 * hour))],
        [("c", at(100 * hour)), ("d", at(2 * hour))],  # d at hour 2 arrives late and is the first of its day
        [("a", at(101 * hour)), ("d", at(90 * hour)), ("e", at(1))],
    ]
    for batch in batches:
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = drain(stream, spark, tmp_path / "out", tmp_path / "cp")
    got = sorted((r.token_address, (r.launch_ts.replace(tzinfo=timezone.utc) - START).total_seconds() / hour) for r in out.collect())
    assert [(a, round(h)) for a, h in got] == [("a", 0), ("a", 101), ("b", 0), ("c", 100), ("d", 2), ("d", 100), ("e", 0)]


def test_rows_without_time_or_token(spark, rows, tmp_path):
    kind = "token_address string, launch_ts timestamp"
    source = str(tmp_path / "launches")
    spark.createDataFrame([("a", at(0)), ("a", None), (None, at(5)), ("a", at(86_400))], kind).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(kind).parquet(source)
    out = drain(jobs.dedup_launches(stream()), spark, tmp_path / "o", tmp_path / "c")
    assert out.count() == 2 and {r.token_address for r in out.collect()} == {"a"}
    dead = drain(jobs.without_time(stream()), spark, tmp_path / "d", tmp_path / "e")
    assert dead.count() == 2
    halves = [("s1", "a", "social", at(0)), ("c0", "a", "chain", None), ("c1", "a", "chain", at(9)), ("s2", None, "social", at(0)),
              ("c2", None, "chain", at(1)), (None, "b", "social", None), ("x", "b", "other", at(0)), ("s3", "b", "social", None)]
    source = str(tmp_path / "signals")
    spark.createDataFrame(halves, SIGNALS).coalesce(1).write.parquet(source)
    got = drain(pairing.pair_exact(spark.readStream.schema(SIGNALS).parquet(source)), spark, tmp_path / "p", tmp_path / "q")
    assert rows(got) == sorted(
        [("a", "s1", "c1", None), ("a", None, "c0", "social"), (None, "s2", None, "chain"), (None, None, "c2", "social"),
         ("b", None, None, "chain"), ("b", "s3", None, "chain")], key=repr
    )


def test_failing_messages_are_counted_and_the_rest_proceeds(spark, tmp_path):
    kind, source = "msg_id string, n int", str(tmp_path / "in")
    paths = [str(tmp_path / x) for x in ("dead", "waiting", "cp")]
    fail_until = {"bad": 99, "slow": 2}  # attempts that raise
    tried = {}

    def work(part, name):
        ids = [r.msg_id for r in part.collect()]
        for i in ids:
            if i in fail_until and tried.get(i, 0) < fail_until[i] and len(ids) == 1:
                tried[i] = tried.get(i, 0) + 1
                raise ValueError(f"cannot do {i}")
            if i in fail_until and tried.get(i, 0) < fail_until[i]:
                raise ValueError("cannot do them all")
        part.write.mode("overwrite").parquet(f"{tmp_path}/out/part={name}")

    def done():
        return sorted(r.msg_id for r in spark.read.schema(kind).parquet(f"{tmp_path}/out").collect())

    def go(ids):
        spark.createDataFrame([(i, 1) for i in ids], kind).coalesce(1).write.mode("append").parquet(source)
        query = jobs.retried(spark.readStream.schema(kind).parquet(source), work, *paths, attempts=3)
        assert query.awaitTermination(120) and query.exception() is None

    go(["a", "bad", "b", "slow", "c", "d"])
    assert done() == ["a", "b", "c", "d"]
    go(["e"])  # each run is a restart; both are tried a second time
    assert done() == ["a", "b", "c", "d", "e"] and tried == {"bad": 2, "slow": 2}
    go(["f"])
    assert done() == ["a", "b", "c", "d", "e", "f", "slow"]
    dead = [r.asDict() for r in spark.read.json(paths[0]).collect()]
    assert [(r["msg_id"], r["attempts"], "cannot do bad" in r["error"]) for r in dead] == [("bad", 3, True)]
    go(["g"])
    assert done()[-2:] == ["g", "slow"] and tried["bad"] == 3


def test_receipts_are_written_back(spark, tmp_path):
    table, kind = str(tmp_path / "t"), "msg_id string, on_chain_tx string, on_chain_block bigint, seen_at timestamp"
    sealed = envelopes(spark, range(3))
    sinks.store_findings(sealed, table)
    ids = sorted(r.msg_id for r in sealed.collect())
    everything = lambda: {r.msg_id: (r.on_chain_tx, r.on_chain_block) for r in sinks.with_receipts(sinks.read_findings(spark, table), table).collect()}
    assert everything() == dict.fromkeys(ids, (None, None))
    first = spark.createDataFrame([(ids[0], "x", 9, at(0)), (ids[1], "y", 1, at(0)), (ids[1], "z", 2, at(5)), (None, "n", 1, at(0))], kind)
    for _ in range(2):  # a replay changes nothing
        sinks.store_receipts(first, table, "b0")
        assert everything() == {ids[0]: ("x", 9), ids[1]: ("z", 2), ids[2]: (None, None)}
    sinks.store_receipts(spark.createDataFrame([(ids[0], "w", 3, at(9))], kind), table, "b1")
    one = sinks.with_receipts(sinks.find_findings(sealed.filter(F.col("msg_id") == ids[0]), table), table).first()
    assert (one.on_chain_tx, one.on_chain_block) == ("w", 3)


def envelopes(spark, numbers):
    data = [("0x" + f"{n:040d}", "2026-01-01T00:00:00Z", "0x" + "2" * 40, f"T{n}", "S", 1.5, "https://x") for n in numbers]
    rows = spark.createDataFrame(data, schemas.CANDIDATE)
    return envelope.build_envelopes(rows, "hunter", schemas.CANDIDATE, "2026-01-01T00:00:00Z")


def test_stream_storing_with_dead_letters_and_replay(spark, tmp_path):
    source, table, dead = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "dead")

    def go(checkpoint):
        stream = readers.read_envelopes(spark, source, stream=True, files_per_trigger=1)
        jobs.store_valid(stream, table, dead, str(tmp_path / checkpoint)).awaitTermination()

    sinks.write_envelopes(envelopes(spark, range(10)).coalesce(1), source)
    (tmp_path / "in" / "bad.txt").write_text("not json\n" + json.dumps({"msg_id": "x", "payload": {}}) + "\n")
    go("one")
    sinks.write_envelopes(envelopes(spark, range(5, 15)).coalesce(1), source)
    go("one")
    go("one")
    assert sinks.read_findings(spark, table).count() == 15
    assert spark.read.json(dead).count() == 2
    # A second group on the same folder reads everything again; the table does not change.
    go("two")
    assert sinks.read_findings(spark, table).count() == 15


def test_deliveries_are_not_repeated(spark, tmp_path):
    kind = "msg_id string, conviction_tier string"
    subs = lambda: spark.createDataFrame([(1, "moderate", True), (2, "degen", True)], "chat_id int, threshold string, active boolean")
    out = str(tmp_path / "out")
    hour = lambda n: F.lit(at(3600 * n)).cast("timestamp")

    def go(rows, checkpoint="cp"):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        jobs.deliver(stream, subs, out, str(tmp_path / checkpoint), now=hour).awaitTermination()

    go([("m1", "high"), ("m2", "degen")])
    go([("m1", "high"), ("m3", "moderate")])  # m1 comes again and is not sent again
    got = sinks.read_sent(spark, out)
    assert sorted((r.msg_id, r.chat_id) for r in got.collect()) == [
        ("m1", 1), ("m1", 2), ("m2", 2), ("m3", 1), ("m3", 2)
    ]
    assert sinks.read_sent(spark, out, before=1).count() == 3


def test_delivery_memory_equals_batch(spark, tmp_path):
    """Chats fall silent for longer and shorter than their memory; messages come again."""
    rng, out, kind = random.Random(17), str(tmp_path / "out"), "msg_id string, conviction_tier string"
    subs = spark.createDataFrame([(c, t, True) for c, t in enumerate(["degen", "moderate", "high"])], "chat_id int, threshold string, active boolean")
    days = [0, 3, 9, 17, 18, 24, 40]
    now = lambda k: F.lit(START + timedelta(days=days[k])).cast("timestamp")
    sent = spark.createDataFrame([], "msg_id string, chat_id int, sent_at timestamp")
    for k in range(len(days)):
        rows = [(f"m{rng.randint(0, 4)}", rng.choice(["degen", "moderate", "high"])) for _ in range(2)]
        batch = spark.createDataFrame(rows, kind)
        due = delivery.undelivered(delivery.match_threshold(batch, subs).distinct(), sent, now(k)).withColumn("sent_at", now(k))
        sent = lineage.cut_plan(sent.unionByName(due.select("msg_id", "chat_id", "sent_at")))
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        jobs.deliver(stream, lambda: subs, out, str(tmp_path / "cp"), now=now).awaitTermination()
        seen = lambda df: sorted((r.msg_id, r.chat_id, r.sent_at) for r in df.collect())
        assert seen(sinks.read_sent(spark, out)) == seen(sent)


def rows_scanned(spark):
    """Rows that all scans of this session have read so far."""
    none, gateway = spark._jvm.java.util.ArrayList(), spark.sparkContext._gateway
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return sum(stages.apply(k).inputRecords() for k in range(stages.size()))


def test_keyed_tables_read_what_is_asked(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.LongType())])
    table = keyed.Keyed(str(tmp_path / "k"), "id", schema, ("v",), slots=4, waiting=4, small=3)
    model, costs = {}, []
    for batch in range(34):
        ids = range(batch * 4000, batch * 4000 + 4000)
        model |= {str(i): i for i in ids} | {"again": batch}
        rows = spark.range(ids[0], ids[-1] + 1, 1, 1).select(F.col("id").cast("string").alias("id"), F.col("id").alias("v"))
        table.put(rows.union(spark.createDataFrame([("again", batch)], schema)).coalesce(1), f"b{batch}")
        if batch in (8, 33):
            before = rows_scanned(spark)
            asked = spark.createDataFrame([("7",), ("again",), (None,), ("none",)], "id string")
            got = {r.id: r.v for r in table.lookup(asked).collect()}
            costs.append(rows_scanned(spark) - before)
            assert got == {"7": 7, "again": batch}
    assert costs[1] <= 1.5 * costs[0] < 40_000
    assert {r.id: r.v for r in table.rows(spark).collect()} == model
    files = [len(files_of.listed(spark, slot)) for slot, _ in files_of.listed(spark, f"{table.path}/sorted")]
    assert len(files) == 4 and max(files) <= 4 and len(files_of.listed(spark, f"{table.path}/waiting")) < 4
    # Many keys at once; a batch does not see itself, and what it puts again replaces what it had put.
    many = spark.createDataFrame([(str(i),) for i in range(0, 136_000, 400)], "id string")
    assert {r.id: r.v for r in table.lookup(many).collect()} == {str(i): i for i in range(0, 136_000, 400)}
    assert [r.v for r in table.lookup(asked, "b33").filter("id = 'again'").collect()] == [32]
    table.put(spark.createDataFrame([("again", 99)], schema), "b34")
    table.put(spark.createDataFrame([("new", 1)], schema), "b34")
    assert {r.id for r in table.lookup(spark.createDataFrame([("again",), ("new",)], "id string")).filter("v = 33 or v = 1").collect()} == {"again", "new"}


def test_storing_one_agents_long_history(spark, tmp_path, monkeypatch):
    """What a batch reads does not follow what its agent has stored."""
    monkeypatch.setattr(keyed, "PAGE", ("parquet.page.row.count.limit", "50"))
    table, costs = str(tmp_path / "t"), []
    for size, numbers in ((300, range(300)), (3000, range(300, 3300))):
        sinks.store_findings(envelopes(spark, numbers), table, f"h{size}")
        before = rows_scanned(spark)
        sinks.store_findings(envelopes(spark, [1, 2, 10_000 + size]), table, f"b{size}")
        costs.append(rows_scanned(spark) - before)
    stored = sinks.read_findings(spark, table)
    assert stored.count() == stored.select("msg_id").distinct().count() == 3302
    assert costs[1] <= costs[0] + 1000  # some pages, not the 3,000 new entries
    asked = envelopes(spark, [5, 10_300]).select("msg_id")
    assert sinks.find_findings(asked, table).count() == 2
    # A batch that stops between table and index leaves nothing double when it comes again.
    files_of.remove(spark, sinks.findings_index(table).path + "/waiting/batch=b3000")
    sinks.store_findings(envelopes(spark, [1, 2, 13_000]), table, "b3000")
    assert sinks.read_findings(spark, table).count() == 3302


def test_kept_lineage_equals_the_walk(spark, rows, tmp_path):
    rng = random.Random(14)
    names = [f"F{i:025d}" for i in range(60)]
    # Edges point to earlier findings, some to unknown ones; one pair forms a cycle.
    data = [(m, "risk", rng.sample(names[max(0, i - 8) : i], min(i, rng.choice([0, 1, 1, 2]))) + (["lost"] if i % 9 == 0 else []),
             "h", json.dumps({"token_name": rng.choice(["", "A", "B"])} if i % 3 else {}), "2026-01-01T00:00:00Z",
             rng.choice([None, "lab/a", "lab/b"])) for i, m in enumerate(names)]
    data[3][2].append(names[4])
    data[4][2].append(names[3])
    order = ["msg_id", "agent", "upstream_ids", "payload_hash", "payload", "created_at", "model_used"]
    df = spark.createDataFrame(data, ", ".join(f"{c} {'array<string>' if c == 'upstream_ids' else 'string'}" for c in order))
    table = str(tmp_path / "t")
    shuffled = rng.sample(names, len(names))  # children before their parents, parents in the same batch
    for k in range(3):
        sinks.store_findings(df.filter(F.col("msg_id").isin(shuffled[k * 20 : k * 20 + 20])), table, f"b{k}")
    starts = spark.createDataFrame([(m,) for m in [*names, "lost"]], "start_id string")
    kept = lineage.cut_plan(lineage.kept_lineage(starts, sinks.findings_index(table).lookup))
    walked = lineage.cut_plan(lineage.lineage(df, starts))
    assert rows(kept, "start_id", "msg_id", "depth") == rows(walked, "start_id", "msg_id", "depth")
    assert rows(lineage.kept_names(kept)) == rows(lineage.token_names(walked, df))


def test_pairs_become_verdicts_briefs_and_reviews(spark, tmp_path):
    table, now = str(tmp_path / "t"), "2026-01-01T00:00:00Z"
    tokens = ["0x" + f"{n:040d}" for n in range(3)]
    launch = [(a, now, "0x" + "2" * 40, f"T{n}", "S", 1.5, "https://x") for n, a in enumerate(tokens)]
    hunted = envelope.build_envelopes(spark.createDataFrame(launch, schemas.CANDIDATE), "hunter", schemas.CANDIDATE, now)
    sinks.store_findings(hunted, table)
    parent = {json.loads(r.payload)["token_address"]: r.msg_id for r in hunted.collect()}
    social = [(a, 50, 3, 0.1, [], [], "ok") for a in tokens]
    chained = [(a, 500, 10.0, 5e4, 1.0, 0, n != 1, True, True, 0, "ok") for n, a in enumerate(tokens)]
    ids = {}
    for side, data, schema in (("social", social, schemas.SOCIAL), ("chain", chained, schemas.CHAIN)):
        rows = spark.createDataFrame(data, schema)
        up = F.array(F.element_at(F.create_map(*[F.lit(x) for p in parent.items() for x in p]), F.col("token_address")))
        sealed = envelope.build_envelopes(rows, side, schema, now, up, F.lit("lab/s") if side == "social" else None)
        sinks.store_findings(sealed, table)
        ids |= {(side, json.loads(r.payload)["token_address"]): r.msg_id for r in sealed.collect()}
    pairs = [(a, ids["social", a], ids["chain", a], None) for a in tokens[:2]] + [(tokens[2], ids["social", tokens[2]], None, "chain")]
    spark.createDataFrame(pairs, pairing.PAIRS).coalesce(1).write.parquet(str(tmp_path / "pairs"))

    def answer(scored):
        known = F.col("token_address") == tokens[0]
        return scored.withColumns(
            {
                "rationale": F.when(known, F.lit("Looks sound.")),
                "confidence": F.when(known, F.lit("high")),
                "model_used": F.when(known, F.lit("lab/r")),
            }
        )

    def go(checkpoint):
        stream = spark.readStream.schema(pairing.PAIRS).parquet(str(tmp_path / "pairs"))
        decide.decide(stream, table, str(tmp_path / checkpoint), lambda _: now, answer).awaitTermination()
        return {(r.agent, r.msg_id): r for r in sinks.read_findings(spark, table).collect()}

    rows = go("one")
    verdicts = {p["token_address"]: (p, r) for r in rows.values() if r.agent == "risk" for p in [json.loads(r.payload)]}
    told = [json.loads(r.payload) for r in rows.values() if r.agent == "narrator"]
    briefs, reviews = [p for p in told if "thesis" in p], [p for p in told if "reason" in p]
    assert verdicts[tokens[0]][0]["score_0_100"] == 100 and not verdicts[tokens[0]][0]["requires_human_review"]
    assert verdicts[tokens[1]][0]["red_flags"] == ["unverified-contract"] and verdicts[tokens[1]][0]["score_0_100"] is None
    assert verdicts[tokens[2]][0]["missing_inputs"] == ["chain"]
    assert verdicts[tokens[2]][1].upstream_ids == [ids["social", tokens[2]]]
    assert [(b["token_name"], b["conviction_tier"], b["model_attribution"]) for b in briefs] == [("T0", "high", ["lab/r", "lab/s"])]
    assert sorted(r["token_address"] for r in reviews) == tokens[1:]
    # The same messages again, as after a lost checkpoint: every id is there already.
    assert go("two") == rows
