"""From the launch feed to verdicts and briefs, every stage restarted in between."""

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from launchsift.sources import readers, sinks
from launchsift.streaming import decide, pairing, signals

START = datetime(2026, 1, 1, tzinfo=timezone.utc)
ANSWER = "token_address string, result string, fetched_at timestamp"


def address(n):
    return f"0x{n:040x}"


def test_launch_events_become_briefs_over_restarts(spark, tmp_path):
    feed, table = tmp_path / "feed", str(tmp_path / "findings")
    feed.mkdir()
    extracts, fetched = signals.Extracts(str(tmp_path / "extracts")), START
    messages = lambda: spark.createDataFrame([("c", 1, "buy $ONE now"), ("c", 2, "one two"), ("d", 1, "nothing")], "channel string, pos bigint, text string")
    fetches = lambda: spark.createDataFrame([("telegram", "c", True), ("telegram", "d", False)], "source string, channel string, success boolean")

    def page(name, numbers, symbols):
        items = [{"address": address(n).upper().replace("0X", "0x"), "creator": address(99), "name": f"Token {n}", "symbol": s, "liquidityUsd": "50000",
                  "launchedAt": "2026-01-01T00:00:00Z", "url": "https://x"} for n, s in zip(numbers, symbols)]
        (feed / name).write_text(json.dumps({"items": items}))

    def collect(numbers, kinds, quantity="10"):
        for kind in kinds:
            rows = {
                "holders": [{"TokenHolderQuantity": quantity}] * 60,
                "transfers": [{"timeStamp": str(1000 - 60 * k), "value": "1", "tokenDecimal": "0"} for k in range(5)],
                "contracts": [{"SourceCode": "code", "ContractCreator": address(99)}],
            }[kind]
            data = [(address(n), json.dumps(rows), fetched) for n in numbers]
            extracts.answers(kind).put(spark.createDataFrame(data, ANSWER), f"{kind}-{numbers[0]}-{fetched:%d}")
        sent = [(address(99), json.dumps([{"hash": str(k), "timeStamp": "1"} for k in range(60)]), fetched)]
        extracts.answers("transactions").put(spark.createDataFrame(sent, ANSWER), f"sent-{fetched:%d}")
        texts = [(address(n), ["an article", " ", "another"], fetched) for n in numbers]
        extracts.articles.put(spark.createDataFrame(texts, "token_address string, texts array<string>, fetched_at timestamp"), f"articles-{numbers[0]}-{fetched:%d}")

    def score(candidates):
        return candidates.select("token_address").distinct().select(
            "token_address", F.lit(60).alias("organic_score"), F.lit(0.5).alias("sentiment"), F.array().cast("array<string>").alias("model_flags"),
            F.array(F.lit("@a")).alias("influencer_mentions"), F.lit("lab/s").alias("model_used"))

    def answer(scored):
        return scored.withColumns({"rationale": F.lit("It holds."), "confidence": F.lit("high"), "model_used": F.lit("lab/r")})

    now = lambda k: (START + timedelta(seconds=10 * k)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def go():
        cp = lambda name: str(tmp_path / "cp" / name)
        stored = lambda: signals.stored_stream(spark, table)
        stages = [
            lambda: signals.hunt(readers.read_launch_feed(spark, str(feed), stream=True), table, cp("hunt"), now),
            lambda: signals.social_side(stored(), extracts, messages, fetches, table, cp("social"), now, score),
            lambda: signals.chain_side(stored(), extracts, table, cp("chain"), now),
            lambda: decide.decide(pairing.pair_exact(signals.signals_of(stored())), table, cp("decide"), now, answer),
        ]
        for stage in stages:
            query = stage()
            assert query.awaitTermination(120) and query.exception() is None
        return {(r.agent, r.msg_id): r for r in sinks.read_findings(spark, table).collect()}

    def by_token(rows, agent):
        found = [(json.loads(r.payload), r) for (a, _), r in rows.items() if a == agent]
        return {p["token_address"]: (p, r) for p, r in found}

    page("p1.json", [1, 2], ["ONE", "TWO"])
    collect([1], ["holders", "transfers", "contracts"])
    collect([2], ["transfers", "contracts"])
    rows = go()
    social, chain, hunted = (by_token(rows, a) for a in ("social", "chain", "hunter"))
    assert set(social) == set(chain) == set(hunted) == {address(1), address(2)}
    one, two = chain[address(1)][0], chain[address(2)][0]
    assert (one["holder_count"], one["top10_concentration_pct"], one["data_quality"], one["creator_previous_tokens"]) == (60, 16.67, "ok", 1)
    assert one["buy_sell_velocity_tx_per_min"] == 1.25 and one["contract_verified"]
    assert (two["holder_count"], two["data_quality"]) == (0, "degraded")
    assert (social[address(1)][0]["mentions_24h"], social[address(1)][0]["data_quality"]) == (4, "ok")
    assert all(chain[t][1].upstream_ids == [hunted[t][1].msg_id] == social[t][1].upstream_ids for t in hunted)
    verdicts, told = by_token(rows, "risk"), by_token(rows, "narrator")
    assert set(verdicts) == set(told) == set(hunted)
    assert sorted(verdicts[address(1)][1].upstream_ids) == sorted([social[address(1)][1].msg_id, chain[address(1)][1].msg_id])
    assert told[address(1)][0]["token_name"] == "Token 1" and told[address(1)][0]["model_attribution"] == ["lab/r", "lab/s"]
    # A restart without new events changes nothing; a refreshed extract serves the next launch.
    assert go() == rows
    fetched = START + timedelta(days=1)
    page("p2.json", [3], ["THREE"])
    collect([3], ["holders", "transfers", "contracts"], "7")
    later = go()
    assert rows.items() <= later.items() and len(later) == len(rows) + 5
    assert by_token(later, "chain")[address(3)][0]["holder_count"] == 60
