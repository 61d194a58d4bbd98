"""Order-dependent operators against plain-Python models on seeded random data.

Each data set has one key with about half of all rows, and bucket widths are varied:
the width must never change a result.
"""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from launchsift.operators import anchored, chain, health, ledger, risk, skew, spend
from launchsift.operators.ordered import OrderedKeys, newest_per_key, trailing

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return START + timedelta(seconds=seconds)


def keyed(rng):
    return "hot" if rng.random() < 0.5 else f"k{rng.randint(0, 9)}"


# -- pairing --------------------------------------------------------------------------
def pair_model(signals, timeout):
    waiting, out = {}, []
    for msg_id, token, side, t in sorted(signals, key=lambda s: (s[3], s[0])):
        held = waiting.pop(token, None)
        if held and t - held[2] > timeout:
            out.append((token, *((held[0], None, "chain") if held[1] == "social" else (None, held[0], "social"))))
            held = None
        if held is None or held[1] == side:
            waiting[token] = (msg_id, side, t)
        elif side == "social":
            out.append((token, msg_id, held[0], None))
        else:
            out.append((token, held[0], msg_id, None))
    return sorted(out, key=repr), waiting


@pytest.mark.parametrize("bucket_s", [50, 3600, 10**7])
@pytest.mark.parametrize("seed", [1, 2])
def test_pairing(table, rows, seed, bucket_s):
    rng = random.Random(seed)
    signals = [(i, keyed(rng), rng.choice(["social", "chain"]), rng.randint(0, 20000)) for i in range(600)]
    want, waiting = pair_model(signals, 120)
    df = table([(i, k, s, at(t)) for i, k, s, t in signals], "msg_id bigint, token_address string, side string, ts timestamp")
    assert rows(risk.pair_signals(df, 120, bucket_s=bucket_s)) == want
    late = risk.pair_signals(df, 120, bucket_s=bucket_s, now=F.lit(at(10**6)))
    assert late.count() == len(want) + len(waiting)


def test_pairing_edges(table, rows):
    def run(*signals):
        df = table([(i, "t", s, at(t)) for i, (s, t) in enumerate(signals)], "msg_id int, token_address string, side string, ts timestamp")
        return {r.msg_id: r.outcome for r in risk.pair_outcomes(df, 120).collect()}

    assert run(("social", 0)) == {0: "waiting"}
    assert run(("social", 0), ("chain", 120)) == {0: "paired", 1: "paired"}
    assert run(("chain", 0), ("social", 121)) == {0: "expired", 1: "waiting"}
    assert run(("social", 0), ("social", 90), ("chain", 180)) == {0: "replaced", 1: "paired", 2: "paired"}
    assert run(("social", 0), ("chain", 1), ("social", 2), ("chain", 3)) == dict.fromkeys(range(4), "paired")


# -- anchored windows -----------------------------------------------------------------
def anchor_model(hits, period):
    opened, out = {}, {}
    for i, key, t in sorted(hits, key=lambda h: (h[2], h[0])):
        anchor, count = opened.get(key, (None, 0))
        if anchor is None or t >= anchor + period:
            anchor, count = t, 0
        opened[key] = (anchor, count + 1)
        out[i] = (anchor, count + 1)
    return out


@pytest.mark.parametrize("parts", [None, 7])
@pytest.mark.parametrize("period", [1, 60, 3000])
def test_anchored_windows(table, parts, period):
    rng = random.Random(period)
    hits = [(i, keyed(rng), rng.randint(0, 8000)) for i in range(900)]
    want = anchor_model(hits, period)
    df = table([(i, k, at(t)) for i, k, t in hits], "id bigint, key string, ts timestamp")
    got = anchored.anchored_windows(df, ["key"], "ts", "id", period, parts).collect()
    base = int(START.timestamp() * 1_000_000)
    assert {r.id: ((r.window_start - base) // 1_000_000, r.hit_no) for r in got} == want


@pytest.mark.parametrize("period", [7, 500, 10**5])
def test_one_hot_key_over_many_parts(spark, table, period):
    rng = random.Random(period)
    # Even steps never let two chains of windows meet; the crowded second half has many hits at one time.
    times = [i * 3 for i in range(400)] + [1200 + rng.randint(0, 40) for _ in range(400)] + [1300 + i for i in range(300)]
    hits = [(i, None if i % 50 == 0 else "hot", t) for i, t in enumerate(times)]
    df = table([(i, k, at(t)) for i, k, t in hits], "id bigint, key string, ts timestamp")
    found = anchored.anchored_windows(df, ["key"], "ts", "id", period, 23)
    got = found.collect()
    base = int(START.timestamp() * 1_000_000)
    assert {r.id: ((r.window_start - base) // 1_000_000, r.hit_no) for r in got} == anchor_model(hits, period)
    # No task holds more than a small share of the hot key's hits.
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 20 and max(sizes) <= len(hits) // 8
    # The parts keep their numbers where the result is combined with others.
    both = found.unionByName(found.coalesce(2)).groupBy("id").agg(F.countDistinct("window_start", "hit_no").alias("n"), F.count("*").alias("rows"))
    assert both.filter("n <> 1 or rows <> 2").isEmpty()


def test_anchored_windows_of_awkward_hits(table):
    kind = "id bigint, a string, b int, ts timestamp, _at string"
    hits = [(1, None, 1, at(0), "x"), (2, None, 1, at(59), "x"), (3, None, None, at(60), "x"), (4, "", 1, None, "x"), (5, "k", 1, at(10**9), "x"), (6, "k", 1, at(0), "x"), (6, "k", 1, at(0), "x")]
    got = anchored.anchored_windows(table(hits, kind), ["a", "b"], "ts", "id", 60, 4).collect()
    assert sorted((r.id, r.hit_no) for r in got) == [(1, 1), (2, 2), (3, 1), (5, 1), (6, 1), (6, 2)]
    assert anchored.anchored_windows(table([], kind), ["a", "b"], "ts", "id", 60).count() == 0


def test_large_ids_survive_and_refusals_count(table):
    first = 2**60 + 1
    df = table([(first + i, "a", at(i)) for i in range(5)] + [(first + 9, "a", at(60))], "id bigint, key string, ts timestamp")
    got = {r.id - first: r.refused for r in anchored.quota_overflow(df, ["key"], "ts", "id", 3, 60).collect()}
    assert got == {0: False, 1: False, 2: False, 3: True, 4: True, 9: False}


def test_first_per_day(table, rows):
    df = table([(i, "a", at(h * 3600)) for i, h in enumerate([0, 23, 24, 47, 49])], "id int, token string, ts timestamp")
    assert rows(anchored.first_per_period(df, ["token"], "ts", "id", 86400), "id") == [(0,), (2,), (4,)]


# -- generic steps --------------------------------------------------------------------
@pytest.mark.parametrize("bucket_s", [7, 100, 10**6])
def test_ordered_steps_equal_plain_windows(table, bucket_s):
    rng = random.Random(5)
    data = [(i, keyed(rng), at(rng.randint(0, 900)), rng.choice([None, 1, 2, 3])) for i in range(500)]
    df = table(data, "id int, key string, ts timestamp, v int")
    w = Window.partitionBy("key").orderBy("ts", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    want = df.select(
        "id", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("f"), F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"),
        F.last("v", True).over(upto).alias("l"), F.first("v", True).over(ahead).alias("u"),
    )
    got = (
        OrderedKeys(df, ["key"], ["ts", "id"], bucket_s).previous("p", F.col("v")).following("f", F.col("v"))
        .running("s", F.col("v")).latest("l", F.col("v")).upcoming("u", F.col("v")).rows().select(*want.columns)
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("bucket_s", [30, 100, 10**6])
def test_trailing_and_newest(table, bucket_s):
    rng = random.Random(6)
    data = [(i, keyed(rng), at(rng.randint(0, 900))) for i in range(400)]
    df = table(data, "id int, key string, ts timestamp")
    got = {r.id: r.n for r in trailing(df, ["key"], "ts", 30, {"n": F.count(F.lit(1))}, bucket_s).collect()}
    assert got == {i: sum(k2 == k and 0 <= (t - t2).total_seconds() <= 30 for _, k2, t2 in data) for i, k, t in data}
    kept = {r.id for r in newest_per_key(df, ["key"], ["ts", "id"], 25, bucket_s).collect()}
    want = set()
    for key in {k for _, k, _ in data}:
        want |= {i for i, k, t in sorted(data, key=lambda d: (d[2], d[0]), reverse=True) if k == key and True} & {
            d[0] for d in sorted([d for d in data if d[1] == key], key=lambda d: (d[2], d[0]))[-25:]
        }
    assert kept == want


def test_top_k_and_skew_join(table):
    rng = random.Random(8)
    data = [(i, keyed(rng), rng.randint(0, 99)) for i in range(600)]
    df = table(data, "id int, key string, v int").repartition(7)
    got = {(r.key, r.rank): r.id for r in skew.top_k_per_group(df, ["key"], [F.col("v").desc(), F.col("id")], 9).collect()}
    want = {}
    for key in {d[1] for d in data}:
        best = sorted([d for d in data if d[1] == key], key=lambda d: (-d[2], d[0]))[:9]
        want.update({(key, n + 1): d[0] for n, d in enumerate(best)})
    assert got == want
    assert [r.key for r in skew.hot_keys(df, ["key"]).collect()] == ["hot"]
    dim = table([("hot", 1), ("k1", 2)], "key string, x int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(tuple, df.join(dim, "key", how).collect()), key=repr)
        salted = skew.skew_join(df, dim, ["key"], ["id"], how)
        assert sorted(map(tuple, salted.select(*df.join(dim, "key", how).columns).collect()), key=repr) == plain


def test_skew_join_spreads_null_keys(table):
    df = table([(i, None if i % 2 else "a") for i in range(400)], "id int, key string").repartition(5)
    dim = table([("a", 1), (None, 2)], "key string, x int")
    for how, n in (("left", 400), ("left_anti", 200), ("inner", 200), ("left_semi", 200)):
        out = skew.skew_join(df, dim, ["key"], ["id"], how)
        assert out.count() == n
        if how == "left":
            assert all((r.x is None) == (r.key is None) for r in out.collect())


def test_zero_creator_is_split(table, rows):
    zero = "0x" + "0" * 40
    meta = table([(f"t{i}", zero if i % 2 else f"c{i}") for i in range(100)], "token_address string, creator_address string")
    history = table([(zero, 7), ("c2", 3)], "creator_address string, creator_previous_tokens int")
    got = chain.with_creator_history(meta, history)
    assert rows(got, "token_address", "creator_previous_tokens") == rows(
        meta.join(history, "creator_address", "left"), "token_address", "creator_previous_tokens"
    )


# -- circuit --------------------------------------------------------------------------
@pytest.mark.parametrize("bucket_s", [40, 10**6])
def test_circuit(table, bucket_s):
    rng = random.Random(9)
    calls = [(i, keyed(rng), i * 10, rng.random() < 0.4) for i in range(500)]
    want, streak = [], {}
    for i, p, t, ok in calls:
        streak[p] = 0 if ok else streak.get(p, 0) + 1
        if streak[p] == 3:
            again = [t2 for j, p2, t2, ok2 in calls if p2 == p and ok2 and j > i]
            want.append((p, t, min([t + 60, *again[:1]])))
    df = table([(i, p, at(t), ok) for i, p, t, ok in calls], "call_id int, provider string, created_at timestamp, success boolean")
    base = int(START.timestamp() * 1_000_000)
    got = [
        (r.provider, (r.opened_at - base) // 1_000_000, (r.closed_at - base) // 1_000_000)
        for r in spend.circuit_intervals(df, bucket_s=bucket_s).collect()
    ]
    assert sorted(got) == sorted(want)


# -- ledger ---------------------------------------------------------------------------
@pytest.mark.parametrize("seed", [11, 12])
def test_ledger_against_a_contract_model(table, seed):
    rng = random.Random(seed)
    zero, ids = bytes(32), [bytes([n]) * 32 for n in range(1, 8)]
    granted, record, want, attempts, grants = {"owner": True}, {}, {}, [], []
    for n in range(400):
        block, idx = n // 3, n
        sender = rng.choice(["owner", "a", "b"])
        if rng.random() < 0.2:
            value = rng.random() < 0.6
            grants.append((sender, value, block, idx))
            granted[sender] = value
            continue
        row = (rng.choice([zero, *ids]), rng.choice([zero, bytes([9]) * 32]), rng.choice(["", "risk"]), sender, block, idx)
        attempts.append(row)
        if not granted.get(sender, False):
            want[idx] = "NotAgent"
        elif row[0] == zero:
            want[idx] = "ZeroMsgId"
        elif row[1] == zero:
            want[idx] = "ZeroPayloadHash"
        elif not row[2]:
            want[idx] = "EmptyAgent"
        elif row[0] in record:
            want[idx] = "AlreadyRecorded"
        else:
            record[row[0]] = idx
            want[idx] = "Recorded"
    tried = table(attempts, "msg_id binary, payload_hash binary, agent string, sender string, block bigint, idx bigint")
    changes = table(grants, "sender string, granted boolean, block bigint, idx bigint")
    judged = ledger.allowlist_asof(tried, changes, "owner", blocks_per_bucket=10)
    assert {r.idx: r.outcome for r in ledger.merge_ledger(judged).collect()} == want
    assert {bytes(r.msg_id): r.idx for r in ledger.ledger_of(judged).collect()} == record


def test_lookup_and_pending(table, rows):
    found = table([("A" * 26, at(1)), ("B" * 26, at(0))], "msg_id string, created_at timestamp")
    book = table([(b"A" * 26 + bytes(6), bytes([10]) * 32, "risk", 5, 1)], "msg_id binary, payload_hash binary, agent string, block bigint, idx bigint")
    assert rows(ledger.lookup_ledger(found, book), "msg_id", "ledger_hash", "exists") == [
        ("A" * 26, "0a" * 32, True), ("B" * 26, None, False),
    ]
    assert rows(ledger.existing(found, book), "msg_id") == [("A" * 26,)]
    assert rows(ledger.pending_anchors(found, book, oldest=5), "msg_id") == [("B" * 26,)]


# -- beats ----------------------------------------------------------------------------
def test_events_between_beats(table, rows):
    events = table([("a", at(t)) for t in (1, 5, 10, 11, 25, 31)], "agent string, ts timestamp")
    beats = table([("a", at(t)) for t in (10, 20, 30)], "agent string, ts timestamp")
    got = [r.events for r in health.events_per_beat(events, beats, bucket_s=7).orderBy("beat_at").collect()]
    assert got == [3, 1, 1]
