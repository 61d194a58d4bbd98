import json

from pyspark.sql import functions as F

from launchsift.functions.text import fence_body
from launchsift.operators import ingest
from launchsift.sources import readers


def test_pages_of_either_shape_and_others(spark, tmp_path):
    item = {"address": "0xAB", "creator": "0xCD", "name": "n", "symbol": "s", "liquidityUsd": 5}
    for i, page in enumerate([[item], {"items": [item, 3]}, {"rows": [item]}, "text"]):
        (tmp_path / f"p{i}.json").write_text(json.dumps(page))
    feed = readers.read_launch_feed(spark, str(tmp_path))
    found = sorted((r.page, r.pos) for r in feed.collect())
    assert found == [("p0.json", 0), ("p1.json", 0), ("p1.json", 1)]
    decoded = ingest.decode_feed_items(feed).collect()
    assert len(decoded) == 2
    assert decoded[0].token_address == "0xab" and decoded[0].initial_liquidity_usd == 5.0
    assert decoded[0].launch_timestamp == "" and decoded[0].source_url == ""


def test_decoding_drops_bad_items(table, rows):
    base = {"address": "0xA", "creator": "0xB", "name": "n", "symbol": "s"}
    cases = [
        {**base, "liquidityUsd": "12.5"},
        {**base, "liquidityUsd": None},
        {**base, "liquidityUsd": "x"},
        {k: v for k, v in base.items() if k != "name"},
        [1],
    ]
    df = table([(i, json.dumps(c)) for i, c in enumerate(cases)], "n int, item string")
    assert rows(ingest.decode_feed_items(df), "n", "initial_liquidity_usd") == [(0, 12.5), (1, 0.0)]


def test_cursor(table, rows):
    pages = table([(f, p, f"t{f}{p}") for f in (1, 2, 3) for p in range(4)], "feed int, pos int, token_address string")
    cursors = table([(1, "t12"), (2, "gone"), (3, "t30")], "feed int, last_seen string")
    kept = ingest.new_since_cursor(pages, cursors)
    assert rows(kept, "feed", "pos") == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (2, 3)]
    assert [r.token_address for r in kept.filter("feed = 1").orderBy("emit_order").collect()] == ["t11", "t10"]
    assert rows(ingest.advance_cursor(pages)) == [(1, "t10"), (2, "t20"), (3, "t30")]


def test_logs_and_incremental_read(spark, table, rows, tmp_path):
    topic = "0x" + "0" * 24
    logs = table(
        [
            (1, "0xf", ["sig", topic + "A" * 40, topic + "b" * 40], "", "0x1"),
            (2, "0xf", ["sig", topic + "c" * 40], "", "0x2"),
            (3, "0xf", [], "", "0x3"),
            (4, "0xother", ["sig", topic + "d" * 40, topic + "e" * 40], "", None),
        ],
        "block bigint, address string, topics array<string>, data string, transactionHash string",
    )
    assert rows(ingest.decode_launch_logs(logs), "token_address", "token_symbol") == [
        ("0x" + "a" * 40, "?"),
        ("0x" + "d" * 40, "?"),
    ]
    logs.write.parquet(str(tmp_path / "logs"))
    found = readers.read_logs_since(spark, str(tmp_path / "logs"), 0, 2, "0xf", "sig")
    assert rows(found, "block") == [(1,), (2,)]


def test_defaults(table, rows):
    df = table([("", "", None, "")], "launch_timestamp string, token_name string, token_symbol string, source_url string")
    assert rows(ingest.normalize_candidates(df, "now", "url")) == [("now", "unknown", "?", "url")]


def test_explorer_results(table, rows):
    df = table(
        [("t", json.dumps([{"TokenHolderQuantity": "5"}, "x", {}])), ("u", '"Max rate"'), ("v", None)],
        "token_address string, result string",
    )
    assert rows(readers.explorer_rows(df, "holders")) == [("t", 0, "5"), ("t", 2, None)]


def test_fences(table, rows):
    cases = {
        '```json\n{"a":1}\n```': '{"a":1}',
        '```\n{"a":1}```': '{"a":1}',
        '  {"a":1}\n': '{"a":1}',
        "```json{}```": "```json{}",
        "plain ```": "plain ```",
    }
    df = table([(k, v) for k, v in cases.items()], "given string, want string")
    assert df.filter(fence_body(F.col("given")) != F.col("want")).count() == 0
