"""Steps whose cost must not grow faster than their input, checked on their plans and on odd rows."""

import random
import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from launchsift import session
from launchsift.operators import chain, skew, spend
from launchsift.plans.tables import address

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_error_rate_has_no_sliding_frame(table):
    rng = random.Random(3)
    data = [(i, rng.choice("ab"), START + timedelta(seconds=rng.randint(0, 3000)), rng.random() < 0.7) for i in range(300)]
    counted = spend.error_rate(table(data, "call_id int, agent string, created_at timestamp, success boolean"), 60)
    frames = re.findall(r"specifiedwindowframe\(\w+, ([^,]+),", plan(counted))
    assert frames and all(lower == "unboundedpreceding$()" for lower in frames)
    got = {r.call_id: (r.recent_calls, r.recent_failures) for r in counted.collect()}
    for i, agent, t, _ in data:
        near = [ok for _, a, t2, ok in data if a == agent and 0 <= (t - t2).total_seconds() <= 60]
        assert got[i] == (len(near), near.count(False))


def test_chain_metrics_send_each_row_once(table):
    transfers = table([("t", i, str(i), "5", "0") for i in range(9)], "token_address string, pos int, time_stamp string, value string, decimals string")
    contracts = table([("t", 0, "x", "0xA")], "token_address string, pos int, source_code string, creator string")
    holders = table([("t", 0, "1")], "token_address string, pos int, quantity string")
    for metric in (chain.transfer_metrics(transfers), chain.contract_meta(contracts), chain.holder_concentration(holders)):
        assert plan(metric).count("Exchange hashpartitioning") == 1
        assert "WindowGroupLimit" in plan(metric) and "SortAggregate" not in plan(metric)


def test_chain_metrics_sort_numbers_not_structs(table):
    pos = "pos struct<t: bigint, o: string>"
    rows = [("t", (i % 5, None if i % 4 == 0 else str(i)), str(100 + i), "200", "0") for i in range(40)] + [("t", None, "7", "1", "0")]
    df = table(rows, f"token_address string, {pos}, time_stamp string, value string, decimals string")
    metrics = chain.transfer_metrics(df, threshold=100, n=12, unit_s=1.0)
    assert not re.search(r"Sort \[[^\]]*\bpos#", plan(metrics))
    # Page order: a missing place, then by its parts with nulls first.
    page = sorted(rows, key=lambda r: (r[1] is not None, r[1] and (r[1][0], r[1][1] is not None, r[1][1])))[:12]
    span = max(1, int(page[0][2]) - int(page[-1][2]))
    assert [tuple(r) for r in metrics.collect()] == [("t", round(12 / span, 2), 11)]
    assert chain.tx_velocity(df, 12, 1.0).first().velocity == metrics.first().velocity


def test_contract_meta_takes_the_first_place(table, rows):
    data = [("a", (2, "x"), "", "0xB"), ("a", (1, "y"), "code", "0xAB"), ("a", None, "code", "0xZ"), ("b", None, "code", "0xC")]
    meta = chain.contract_meta(table(data, "token_address string, pos struct<n: int, s: string>, source_code string, creator string"))
    assert rows(meta) == [("a", True, "0xab"), ("b", False, "0x" + "0" * 40)]


def test_hot_group_is_cut_before_the_shuffle(table):
    df = table([(i, "hot" if i % 3 else f"k{i % 7}", i * 37 % 1000) for i in range(3000)], "id int, key string, v int").repartition(6)
    got = skew.first_k_per_group(df, ["key"], [F.col("v"), F.col("id")], 5)
    assert "Partial" in plan(got)
    best = sorted((i * 37 % 1000, i) for i in range(3000) if i % 3)[:5]
    assert [(r.v, r.id) for r in got.filter("key = 'hot'").orderBy("rank").collect()] == best


def test_addresses(table):
    df = table([(0,), (26,), (2**40 + 11,), (-1,), (None,)], "n bigint")
    want = F.concat(F.lit("0x"), F.reverse(F.lpad(F.lower(F.hex("n")), 40, "0")))
    assert all(r.got == r.want for r in df.select(address(F.col("n")).alias("got"), want.alias("want")).collect())


def test_task_shares_leave_the_owners_choice(spark):
    own = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    other = spark.newSession()
    other.conf.set(own, "8m")
    session.prepare(other)
    assert other.conf.get(own) == "8m"
    other.conf.unset(own)
    session.prepare(other)
    assert other.conf.get(own) == session.SHARES[own]
