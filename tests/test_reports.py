import json
from datetime import datetime, timedelta, timezone
from decimal import Decimal

from pyspark.sql import functions as F

from launchsift.functions.constants import PRICES
from launchsift.operators import brief, dashboard, delivery, findings, health, lineage, modeltext, spend

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return START + timedelta(seconds=seconds)


# -- lineage and briefs ----------------------------------------------------------------
def messages(table):
    data = [
        ("c", "hunter", [], {"token_name": "Moon"}, None, 0), ("s", "social", ["c"], {"x": 1}, "p/s", 10),
        ("k", "chain", ["c"], {}, None, 12), ("r", "risk", ["s", "k"], {}, "p/r", 20),
        ("b", "narrator", ["r", "gone"], {"token_name": ""}, "p/r", 30),
        ("x", "risk", ["y"], {}, None, 0), ("y", "risk", ["x"], {}, None, 0), ("lone", "risk", ["lone"], {}, None, 0),
    ]
    return table(
        [(m, a, u, json.dumps(p), mod, at(t)) for m, a, u, p, mod, t in data],
        "msg_id string, agent string, upstream_ids array<string>, payload string, model_used string, created_at timestamp",
    )


def test_lineage_names_models_latency(table, rows):
    found = messages(table)
    starts = table([("b",), ("x",), ("lone",), ("missing",)], "start_id string")
    closure = lineage.lineage(found, starts, None)
    assert rows(closure) == sorted(
        [("b", "b", 0), ("b", "r", 1), ("b", "s", 2), ("b", "k", 2), ("b", "c", 3), ("x", "x", 0), ("x", "y", 1), ("lone", "lone", 0)],
        key=repr,
    )
    assert rows(lineage.lineage(found, starts, 1).filter("start_id = 'b'"), "msg_id") == [("b",), ("r",)]
    assert dict(rows(lineage.token_names(closure, found))) == {"b": "Moon", "x": "Unknown", "lone": "Unknown"}
    own = table([("b", "own/m"), ("x", None)], "start_id string, model_used string")
    assert dict(rows(lineage.model_attribution(closure, found, own))) == {"b": ["own/m", "p/r", "p/s"], "x": [], "lone": []}
    finals = lineage.lineage(found, table([("b",)], "start_id string"), None)
    assert rows(health.lost_candidates(found.filter("agent = 'hunter'"), finals)) == []
    assert health.lost_candidates(found.filter("msg_id = 'x'"), finals).first().finals == 0
    assert rows(health.end_to_end_latency(finals, found)) == [("hunter to narrator", 30)]
    stats = {r.stage: (r.messages, r.p50) for r in health.stage_latency(health.stage_gaps(found.filter("msg_id in ('c','s','k','r','b')"))).collect()}
    assert stats == {"social": (1, 10.0), "chain": (1, 12.0), "risk": (2, 9.0), "narrator": (1, 10.0)}


def test_briefs_with_and_without_a_model(table):
    df = table(
        [("v1", 90, "why", '{"thesis":" T ","caveats":["c"],"sources":["u"]}', "a/b"), ("v2", None, "r" * 500, None, None),
         ("v3", 50, "only rationale", "junk", "a/b"), ("v4", 50, "", "{}", "a/b")],
        "msg_id string, score_0_100 int, rationale string, content string, model_used string",
    ).withColumns({"token_address": F.lit("0x"), "token_name": F.lit("N"), "model_attribution": F.array(F.lit("a/b"))})
    got = {r.verdict_id: r for r in brief.build_brief(modeltext.parse_responses(df), "now").collect()}
    assert (got["v1"].thesis, got["v1"].caveats, got["v1"].sources, got["v1"].conviction_tier) == ("T", ["c"], ["u"], "high")
    assert (len(got["v2"].thesis), got["v2"].confidence_tier, got["v2"].conviction_tier) == (400, "degraded", "degen")
    assert got["v3"].thesis == "only rationale" and got["v4"].thesis == "No thesis available."


def test_read_queries(table, rows):
    df = table([(f"m{i}", "narrator" if i % 2 else "risk", at(i), '{"token_name":"T","thesis":"x"}') for i in range(20)],
               "msg_id string, agent string, created_at timestamp, payload string")
    assert [r.msg_id for r in findings.list_briefs(df, 3, 1).collect()] == ["m17", "m15", "m13"]
    assert findings.get_finding(df, "m3").first().created_at == "2026-01-01T00:00:03Z"
    assert findings.get_finding(df, "nope").count() == 0
    assert findings.latest_briefs(df).first().conviction_tier == "?"
    assert [r.msg_id for r in findings.recent_events({"a": df.filter("agent='risk'"), "b": df.filter("agent<>'risk'")}, 2).collect()] == ["m19", "m18"]


# -- spend -------------------------------------------------------------------------------
def test_cost_and_sums(table, rows):
    model = next(iter(PRICES))
    calls = table([(1, "p", model, 1000, 2000), (2, "q", "unknown", 5, 5)],
                  "call_id int, provider string, model string, input_tokens bigint, output_tokens bigint")
    costed = spend.call_cost(calls)
    price_in, price_out = PRICES[model]
    assert rows(costed, "call_id", "cost_usd") == [(1, Decimal(str(price_in + 2 * price_out)).quantize(Decimal("0.000001"))), (2, Decimal("0.000000"))]
    nothing = costed.withColumn("cost_usd", F.lit(None).cast("decimal(10,6)"))
    assert {r.total for r in spend.cost_by_provider(nothing).collect()} == {Decimal(0)}


def test_cap_breach_is_the_first_call_over(table, rows):
    calls = table([(i, "openai", at(i * 400), Decimal(9)) for i in range(20)] + [(99, "google", at(0), Decimal(20))],
                  "call_id int, provider string, created_at timestamp, cost_usd decimal(10,6)")
    assert rows(spend.cap_breach(calls), "provider", "call_id") == [("openai", 5)]


def test_served_by_order(table, rows):
    chains = {"a/x": ["b/y"]}
    requests = table([(i, "a/x") for i in range(5)], "request_id int, primary_model string")
    tries = table(
        [(0, "gate", "a/x", True), (1, "gate", "a/x", False), (1, "b", "b/y", True), (1, "a", "a/x", True),
         (2, "b", "b/y", True), (3, "a", "a/x", False), (4, "c", "c/z", True)],
        "request_id int, provider string, model string, success boolean",
    )
    got = spend.served_by(requests, tries, chains, "gate", ("a", "b"))
    assert rows(got, "request_id", "provider", "exhausted") == [
        (0, "gate", False), (1, "a", False), (2, "b", False), (3, None, True), (4, None, True),
    ]


# -- delivery ------------------------------------------------------------------------------
def test_subscription_replay(table, rows):
    changes = table(
        [(1, at(0), 0, "set", "high"), (1, at(1), 1, "subscribe", "moderate"), (1, at(2), 2, "set", "degen"),
         (2, at(0), 0, "subscribe", "moderate"), (2, at(1), 1, "unsubscribe", None), (2, at(2), 2, "set", "high"),
         (3, at(0), 0, "set", "high"), (3, at(1), 1, "unsubscribe", None),
         (4, at(0), 0, "subscribe", "moderate"), (4, at(1), 1, "unsubscribe", None), (4, at(2), 2, "subscribe", "moderate")],
        "chat_id int, ts timestamp, seq int, action string, threshold string",
    )
    assert rows(delivery.current_subscriptions(changes)) == [(1, "degen", True), (2, "high", False), (4, "moderate", True)]


def test_threshold_pairs_and_counts(table, rows):
    tiers = ["degen", "Speculative", "MODERATE", "high", "weird"]
    rank = {"speculative": 1, "moderate": 2, "high": 3}
    briefs = table([(i, t) for i, t in enumerate(tiers)], "msg_id int, conviction_tier string")
    subs = table([(i, t, True) for i, t in enumerate(tiers)] + [(9, "degen", False)], "chat_id int, threshold string, active boolean")
    want = [(b, c) for b, bt in enumerate(tiers) for c, ct in enumerate(tiers) if rank.get(bt.lower(), 0) >= rank.get(ct.lower(), 0)]
    assert rows(delivery.match_threshold(briefs, subs)) == sorted(want, key=repr)
    assert rows(delivery.reach_of_briefs(briefs, subs)) == [(b, sum(x == b for x, _ in want)) for b in range(5)]


def test_delivery_memory_restarts_with_each_send(table, rows):
    day = 86400
    sent = table(
        [("a", "m1", at(0)), ("a", "m2", at(6 * day)), ("b", "m1", at(0)), ("b", "m2", at(8 * day)), ("c", "m1", at(0))],
        "chat_id string, msg_id string, sent_at timestamp",
    )
    matches = table([(c, m) for c in "abcd" for m in ("m1", "m2")], "chat_id string, msg_id string")
    got = delivery.undelivered(matches, sent, F.lit(at(12 * day)))
    assert rows(got, "chat_id", "msg_id") == [("b", "m1"), ("c", "m1"), ("c", "m2"), ("d", "m1"), ("d", "m2")]


def test_message_text(table):
    df = table([("id", "Moon", "0xab", "high", "t" * 1000, list("abcdef")), ("id2", "N", "0x", "degen", "t", [])],
               "msg_id string, token_name string, token_address string, conviction_tier string, thesis string, caveats array<string>")
    full, bare = [r.body for r in delivery.format_brief(df).orderBy("msg_id").collect()]
    assert full.startswith("*Moon* — conviction: *high*\n\n" + "t" * 900 + "\n\n*Caveats*:\n• a\n") and "• e" in full and "• f" not in full
    assert full.endswith("0xab) · `id`") and "Caveats" not in bare


# -- health and dashboard --------------------------------------------------------------------
def test_status(table):
    empty = table([], "agent string, status string")
    assert tuple(health.overall_status(empty).first()) == ("degraded", 0, 0)
    beats = table([("a", "online", at(1)), ("a", "down", at(0)), ("b", "online", at(0))], "agent string, status string, last_seen timestamp")
    latest = health.latest_heartbeats(beats)
    assert tuple(health.overall_status(latest).first()) == ("ok", 2, 2)


def test_counters_depth_histogram(table, rows):
    events = table([("a", True, 0.02), ("a", False, 3.0)], "agent string, success boolean, seconds double")
    assert rows(health.event_counters(events)) == [("a", 1, 1)]
    assert dict((r.le, r.events) for r in health.processing_histogram(events, (0.01, 0.05, 5.0)).collect()) == {
        "0.01": 0, "0.05": 1, "5.0": 2, "+Inf": 2,
    }
    delivered = table([("s", "g", 1), ("s", "g", 1), ("s", "g", 2), ("s", "h", 1)], "stream string, group string, entry_id int")
    acks = table([("s", "g", 1)], "stream string, group string, entry_id int")
    assert rows(health.pending_depth(delivered, acks)) == [("s", "g", 1), ("s", "h", 1)]


def test_activity_and_usage(table, rows):
    created = ["2026-01-01T23:30:00Z", "2026-01-01T22:10:00Z", "2026-01-01T22:20:00Z", "not-a-date", "2026-01-03T00:00:00Z", "2025-12-30T00:00:00Z"]
    got = dashboard.activity_24h(table([(c,) for c in created], "created_at string"), F.lit(at(86400))).orderBy("bucket").collect()
    assert len(got) == 24 and got[23].briefs == 1 and got[22].briefs == 2 and got[0].total == 3
    assert (got[22].height_pct, got[23].height_pct) == (100.0, 50.0)
    usage = table([(["a", "b"],), (["a"],), ([],)], "model_attribution array<string>")
    assert [tuple(r) for r in dashboard.model_usage(usage).collect()] == [("a", 2, 67), ("b", 1, 33)]
    assert dashboard.model_usage(table([([],)], "model_attribution array<string>")).count() == 0


def test_frames(table):
    payload = {"token_name": "A", "token_address": "0x" + "0" * 40, "thesis": "t", "conviction_tier": "degen", "caveats": [],
               "sources": [], "model_attribution": [], "brief_generated_at": "2026-04-22T06:50:00Z", "confidence_tier": "ok"}
    frame = {"msg_id": "01ARZ3NDEKTSV4RRFFQ69G5FAV", "payload": payload, "payload_hash": "a" * 64, "upstream_ids": [],
             "model_used": None, "created_at": "2026-04-22T06:50:00Z", "on_chain_tx": None, "on_chain_block": None}
    later = {**frame, "msg_id": "01ARZ3NDEKTSV4RRFFQ69G5FAA", "created_at": "2026-04-22T06:51:00Z"}
    review = {**frame, "payload": {"token_address": "0x" + "0" * 40, "reason": "r"}}
    df = table([(json.dumps(f),) for f in (frame, later, review, {"type": "hello"})] + [("not-json",)], "frame string")
    assert [r.msg_id[-1] for r in dashboard.parse_frames(df, newest=10).collect()] == ["A", "V"]


def test_deliveries_by_chat_are_those_of_the_pairs(table, rows):
    briefs = table([(n, t) for n, t in enumerate(["high", "HIGH", "degen", "odd", "Moderate", "speculative", None])], "msg_id bigint, conviction_tier string")
    subs = table(
        [(1, "degen", True), (2, "high", True), (3, "speculative", False), (4, "moderate", True), (5, "Speculative", True)],
        "chat_id bigint, threshold string, active boolean",
    )
    pairs = delivery.match_threshold(briefs, subs).groupBy("chat_id").count()
    assert rows(delivery.deliveries_by_chat(briefs, subs)) == rows(pairs)
    assert rows(delivery.deliveries_by_chat(briefs.limit(0), subs)) == []
