import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from launchsift.functions import schemas
from launchsift.functions.canonical import canonical_struct, canonical_text
from launchsift.functions.schemas import DOUBLE, TEXT, TEXTS, struct
from launchsift.operators import envelope, findings, validate
from launchsift.sources import readers, sinks

ID = "01ARZ3NDEKTSV4RRFFQ69G5FAV"


def python_canonical(value):
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def test_canonical_struct_equals_python_for_any_double(spark):
    rng = random.Random(7)
    values = [0.0, -0.0, 1e-5, 1e16, 12345678.5, 5000.0, 1e22, 1.5e300, -2.5e-7, 0.0001, 123456789012345680.0]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 20) for _ in range(3000)]
    kind = struct(z=DOUBLE, a=TEXT, list=TEXTS)
    df = spark.createDataFrame([(v, 'é"\n', ["x", None]) for v in values], kind)
    got = [r.c for r in df.select(canonical_struct(kind).alias("c")).collect()]
    for value, text in zip(values, got):
        back = json.loads(text)
        assert back["z"] == value and text == python_canonical(back)
        assert text == python_canonical({"z": value, "a": 'é"\n', "list": ["x", None]})


def test_nan_is_refused(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),)], struct(z=DOUBLE))
    assert [r.c for r in df.select(canonical_struct(struct(z=DOUBLE)).alias("c")).collect()] == [None, None]
    texts = spark.createDataFrame([('{"z": NaN}',)], "t string")
    assert texts.select(canonical_text("t").alias("c")).first().c is None


def test_canonical_text_sorts_every_level(spark):
    df = spark.createDataFrame([('{"b":{"y":1,"x":"é"},"a":2}',)], "t string")
    assert df.select(canonical_text("t").alias("c")).first().c == '{"a":2,"b":{"x":"é","y":1}}'


def candidate(address="0x" + "1" * 40):
    return (address, "2026-01-01T00:00:00Z", "0x" + "2" * 40, "Name", "SYM", 5000.0, "https://x")


def test_built_envelopes_are_valid_repeatable_and_verify(spark):
    df = spark.createDataFrame([candidate()], schemas.CANDIDATE)
    sealed = envelope.build_envelopes(df, "hunter", schemas.CANDIDATE, "2026-01-01T00:00:00Z")
    row = sealed.first()
    assert row.payload_hash == hashlib.sha256(row.payload.encode()).hexdigest()
    assert row.payload == python_canonical(json.loads(row.payload))
    assert sealed.first().msg_id == row.msg_id and len(row.msg_id) == 26
    assert validate.validate_envelopes(sealed).first().errors == []
    checked = validate.validate_payload(sealed, "candidate").first()
    assert checked.errors == []
    ledger = sealed.select("msg_id", F.col("payload_hash").alias("ledger_hash"))
    seen = findings.verify_findings(sealed, ledger).first()
    assert seen.hash_match and seen.on_chain_present and seen.on_chain_match
    changed = sealed.withColumn("payload", F.lit('{"token_name":"other"}'))
    seen = findings.verify_findings(changed, ledger).first()
    assert not seen.hash_match and seen.on_chain_match


@pytest.mark.parametrize(
    "change, wrong",
    [
        ({"msg_id": "short"}, "msg_id"),
        ({"msg_id": ID[:-1] + "U"}, "msg_id"),
        ({"msg_id": ID.lower()}, None),
        ({"agent": "Hunter"}, "agent"),
        ({"payload_hash": "A" * 64}, "payload_hash"),
        ({"upstream_ids": [ID, "x"]}, "upstream_ids"),
        ({"created_at": "2026-01-01"}, "created_at"),
        ({"created_at": "2026-01-01T00:00:00+00:00"}, None),
        ({"created_at": "2026-01-01T00:00:00-05:00"}, None),
        ({"model_used": "gpt"}, "model_used"),
        ({"model_used": "/x"}, "model_used"),
        ({"model_used": None}, None),
    ],
)
def test_envelope_rules(spark, change, wrong):
    row = {
        "msg_id": ID, "agent": "risk", "upstream_ids": [], "payload_hash": "a" * 64, "payload": "{}",
        "created_at": "2026-01-01T00:00:00Z", "model_used": "a/b", **change,
    }
    df = spark.createDataFrame([tuple(row[f.name] for f in schemas.ENVELOPE.fields)], schemas.ENVELOPE)
    assert validate.validate_envelopes(df).first().errors == ([] if wrong is None else [wrong])


def test_payload_rules(table, rows):
    good = {
        "token_address": "0x" + "1" * 40, "organic_score": 50, "mentions_24h": 1, "sentiment": 0.2,
        "red_flags": [], "influencer_mentions": [],
    }
    cases = [
        good,
        {**good, "organic_score": 101},
        {**good, "sentiment": -1.5, "extra": 1},
        {k: v for k, v in good.items() if k != "mentions_24h"},
    ]
    df = table([(i, json.dumps(c)) for i, c in enumerate(cases)], "n int, payload string")
    assert rows(validate.validate_payload(df, "social"), "n", "errors") == [
        (0, []), (1, ["organic_score"]), (2, ["sentiment", "unknown_keys"]), (3, ["mentions_24h"]),
    ]


SOCIAL = {"token_address": "0x" + "1" * 40, "organic_score": 50, "mentions_24h": 1, "sentiment": 0.2}
VERDICT = {"token_address": "0x" + "1" * 40, "rationale": "because"}


@pytest.mark.parametrize(
    "kind, base, change, wrong",
    [
        ("social", SOCIAL, {"red_flags": "oops"}, ["red_flags"]),
        ("social", SOCIAL, {"red_flags": None, "data_quality": None}, ["red_flags", "data_quality"]),
        ("social", SOCIAL, {"red_flags": [1]}, ["red_flags"]),
        ("social", SOCIAL, {"red_flags": [], "influencer_mentions": ["a"]}, []),
        ("social", SOCIAL, {"red_flags": [None]}, ["red_flags"]),
        ("social", SOCIAL, {"organic_score": 50.5}, ["organic_score"]),
        ("social", SOCIAL, {"organic_score": 50.0, "mentions_24h": "7"}, []),
        ("social", SOCIAL, {"sentiment": "x"}, ["sentiment"]),
        ("social", SOCIAL, {"token_address": 5}, ["token_address"]),
        ("verdict", VERDICT, {"score_0_100": "abc", "requires_human_review": "maybe"}, ["score_0_100", "requires_human_review"]),
        ("verdict", VERDICT, {"rationale": 7}, ["rationale"]),
        ("verdict", VERDICT, {"score_0_100": None, "confidence": None}, []),
        ("verdict", VERDICT, {"missing_inputs": None}, ["missing_inputs"]),
        ("verdict", VERDICT, {"requires_human_review": True, "confidence": "low", "score_0_100": 100}, []),
    ],
)
def test_types_nulls_and_absence(table, kind, base, change, wrong):
    df = table([(json.dumps({**base, **change}),)], "payload string")
    assert validate.validate_payload(df, kind).first().errors == wrong


def test_decoded_envelopes(table, rows):
    base = {"msg_id": f" {ID.lower()} ", "agent": "risk", "payload_hash": "a" * 64, "payload": VERDICT, "created_at": "2026-01-01T00:00:00Z"}
    lines = [
        base,
        {**base, "upstream_ids": None},
        {**base, "note": 1},
        {**base, "payload": json.dumps(VERDICT)},
        {**base, "payload": {**VERDICT, "score_0_100": 101}},
        {**base, "agent": "narrator", "payload": {"token_address": "0x" + "1" * 40, "reason": "r", "risk_verdict_msg_id": ID, "raised_at": "now"}},
        {**base, "agent": "narrator"},
    ]
    df = table([(i, json.dumps(x)) for i, x in enumerate(lines)], "n int, value string")
    decoded = readers.decode_envelopes(df)
    checked = {json.dumps(json.loads(r.raw)): r.errors for r in validate.validate_messages(decoded).collect()}
    got = [checked[json.dumps(x)] for x in lines]
    assert got[:6] == [[], ["upstream_ids"], ["unknown_keys"], ["payload"], ["payload.score_0_100"], []]
    assert "payload.thesis" in got[6]


def test_short_thesis_is_quarantined(table):
    brief = {
        "token_name": "A", "token_address": "0x" + "1" * 40, "thesis": "No thesis available.",
        "conviction_tier": "degen", "brief_generated_at": "2026-01-01T00:00:00Z",
    }
    df = table([(json.dumps(brief),)], "payload string")
    good, bad = validate.split_quarantine(validate.validate_payload(df, "brief"))
    assert good.count() == 0 and bad.first().errors == ["thesis"]


def test_append_is_idempotent_and_first_wins(table, rows):
    incoming = table([("a", 2, "late"), ("a", 1, "first"), ("b", 1, "x")], "msg_id string, seq int, v string")
    stored = table([("b",)], "msg_id string")
    assert rows(envelope.append_findings(incoming, stored, ["seq"]), "msg_id", "v") == [("a", "first")]


def test_receipts_last_wins(table, rows):
    found = table([("a",), ("b",)], "msg_id string")
    receipts = table(
        [("a", "0x1", 5, 1), ("a", "0x2", 4, 2)], "msg_id string, on_chain_tx string, on_chain_block bigint, seq int"
    )
    assert rows(envelope.attach_receipts(found, receipts, ["seq"])) == [("a", "0x2", 4), ("b", None, None)]


def test_prompt_hash(table, rows):
    turns = [(1, 1, "user", "hello é"), (1, 0, "system", "be brief"), (1, 2, "assistant", "ok"), (2, 0, "user", "x")]
    df = table(turns, "conv_id int, turn int, role string, text string")

    def expected(conv):
        mine = [t for t in turns if t[0] == conv]
        ordered = sorted(mine, key=lambda t: (t[2] != "system", t[1]))
        data = b"".join(t[2].encode() + b"\0" + t[3].encode() + b"\0" for t in ordered)
        return hashlib.sha256(data).hexdigest()

    want = [(1, expected(1)), (2, expected(2))]
    assert rows(envelope.prompt_hash(df)) == want
    gaps = table([*turns, (2, 1, None, "y"), (2, 2, "user", None), (None, 0, "user", "x")], df.schema)
    assert rows(envelope.prompt_hash(gaps)) == sorted([*want, (None, want[1][1])], key=repr)


def test_bad_payloads_hash_to_null(table):
    deep = "[" * 100_000 + "]" * 100_000
    df = table([("a", '{"x": "\\ud800"}'), ("b", '{"x": ' + deep + "}"), ("c", '{"b": 1, "a": 2}'), ("d", "NaN"), ("e", None)], "k string, payload string")
    got = {r.k: r.local_hash for r in envelope.hash_stored(df).collect()}
    assert got == {"a": None, "b": None, "c": hashlib.sha256(b'{"a":2,"b":1}').hexdigest(), "d": None, "e": None}


def test_lines_round_trip_and_bad_lines(spark, tmp_path, rows):
    df = spark.createDataFrame([candidate(), candidate("0x" + "3" * 40)], schemas.CANDIDATE)
    sealed = envelope.build_envelopes(df, "hunter", schemas.CANDIDATE, "2026-01-01T00:00:00Z")
    sinks.write_envelopes(sealed, str(tmp_path / "s"))
    (tmp_path / "s" / "bad.txt").write_text("not json\n{}\n")
    back = readers.read_envelopes(spark, str(tmp_path / "s"))
    checked = validate.validate_envelopes(back)
    good, bad = validate.split_quarantine(checked)
    assert rows(good.drop("raw").select(*sealed.columns)) == rows(sealed)
    assert bad.count() == 2
    line = spark.read.text(str(tmp_path / "s")).filter(F.col("value").startswith('{"agent"')).first().value
    assert line == python_canonical(json.loads(line))


def test_stored_findings_ignore_repeats(spark, tmp_path):
    df = spark.createDataFrame([candidate()], schemas.CANDIDATE)
    sealed = envelope.build_envelopes(df, "hunter", schemas.CANDIDATE, "2026-01-01T00:00:00Z")
    path = str(tmp_path / "findings")
    sinks.store_findings(sealed, path)
    sinks.store_findings(sealed.unionByName(sealed), path)
    assert sinks.read_findings(spark, path).count() == 1


def test_call_log_zeroes_failures(spark, table, tmp_path):
    from datetime import datetime, timezone
    from decimal import Decimal

    when = datetime(2026, 1, 1, tzinfo=timezone.utc)
    calls = table(
        [("a", True, 5, 6, Decimal("1.5"), when), ("b", False, 5, 6, Decimal("1.5"), when)],
        "agent string, success boolean, input_tokens bigint, output_tokens bigint, cost_usd decimal(10,6), "
        "created_at timestamp",
    )
    sinks.append_llm_calls(calls, str(tmp_path / "calls"))
    sinks.append_llm_calls(calls, str(tmp_path / "calls"))
    back = spark.read.parquet(str(tmp_path / "calls"))
    assert back.count() == 4
    assert {tuple(r) for r in back.filter("not success").select("input_tokens", "cost_usd").collect()} == {(0, Decimal(0))}


def test_snippets_and_explorer_files(spark, tmp_path, rows):
    (tmp_path / "s.json").write_text('{"channel":"c","pos":1,"text":"hi"}\n')
    assert rows(readers.read_snippets(spark, str(tmp_path / "s.json"))) == [("c", 1, "hi")]
    (tmp_path / "t.json").write_text('{"token_address":"t","result":[{"timeStamp":"5","value":"7"}, "bad"]}\n')
    got = readers.read_explorer_extract(spark, str(tmp_path / "t.json"), "transfers")
    assert rows(got) == [("t", 0, "5", "7", None)]
