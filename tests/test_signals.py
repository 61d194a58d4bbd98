import pytest
from pyspark.sql import functions as F

from launchsift.functions.rules import Rule
from launchsift.operators import brief, chain, modeltext, risk, social

TOKEN = "0x" + "1" * 40


# -- social ---------------------------------------------------------------------------
def test_mentions_against_brute_force(table, rows):
    texts = ["Big DOGE day", "dogecoin", "nothing", "ab", "a", "DOG", "été Ünï", "x" * 50 + "doge", "d\noge"]
    messages = [(c, p, texts[(p * 7 + c) % len(texts)]) for c in range(3) for p in range(60)]
    symbols = ["doge", "DOG", "a", "AB", "é", "zzz", "coin", "ünï", "oge"]
    tokens = [(f"t{i}", s) for i, s in enumerate(symbols)]
    tail = [m for m in messages if m[1] >= 20]
    want = sorted((t, sum(s.lower() in m[2].lower() for m in tail)) for t, s in tokens)
    got = social.count_mentions(
        table(messages, "channel int, pos int, text string"), table(tokens, "token_address string, symbol string")
    )
    assert rows(got) == want


def test_repeated_positions_count_once_per_message(table, rows):
    messages = [(1, 5, "doge moon"), (1, 5, "other doge"), (1, 5, "doge moon"), (2, 1, "dog")]
    got = social.count_mentions(
        table(messages, "channel int, pos int, text string"), table([("t", "DOGE"), ("u", "dog")], "token_address string, symbol string")
    )
    assert rows(got) == [("t", 3), ("u", 4)]


def test_symbols_with_a_common_beginning_meet_few_messages(table, rows):
    texts = [f"launch of moon{n:03d} today" for n in range(40)] + ["moon", "the moon launch"]
    messages = table([(1, p, t) for p, t in enumerate(texts)], "channel int, pos int, text string")
    symbols = [f"MOON{n:03d}" for n in range(0, 400, 3)] + ["moon", "un"]
    got = social.match_symbols(messages, table([(s,) for s in symbols], "symbol string"))
    want = sorted(((s.lower(), p) for s in symbols for p, t in enumerate(texts) if s.lower() in t), key=repr)
    assert rows(got, "symbol", "pos") == want
    grams = messages.select("pos", F.explode(social._grams("text")).alias("_gram"))
    wanted = table([(s.lower(),) for s in symbols], "_symbol string")
    chosen = social.rarest_grams(grams, wanted)
    # Only symbols all of whose runs occur are left, none of them under the common beginning.
    assert {r._symbol for r in chosen.filter("_gram in ('moo', 'oon')").collect()} == {"moon"}
    assert grams.join(chosen.filter("_symbol like 'moon_%'"), "_gram").count() < 5 * 40


def test_mentions_under_null_places_and_empty_tables(table, rows):
    messages = [(None, 1, "doge"), (1, None, "doge"), (1, 2, None), (1, 3, "")]
    schema = "channel int, pos int, text string"
    tokens = table([("t", "DOGE"), ("u", None), ("v", "")], "token_address string, symbol string")
    assert rows(social.count_mentions(table(messages, schema), tokens)) == [("t", 2), ("u", 0), ("v", 0)]
    assert rows(social.count_mentions(table([], schema), tokens)) == [("t", 0), ("u", 0), ("v", 0)]


def test_snippets_follow_channel_then_page(table):
    messages = [(c, p, f"  pump {c}-{p} " + "x" * 400) for c in (1, 2) for p in range(4)]
    got = social.sample_snippets(
        table(messages, "channel int, pos int, text string"), table([("PUMP",)], "symbol string")
    ).orderBy("sample_no").collect()
    assert [r.snippet[:8] for r in got] == ["pump 1-0", "pump 1-1", "pump 1-2", "pump 1-3", "pump 2-0"]
    assert {len(r.snippet) for r in got} == {280}


def test_search_hits_and_status(table, rows):
    articles = [("q", p, "hit" if p % 2 else "  ") for p in range(30)] + [("none", 0, "\n")]
    assert rows(social.count_search_hits(table(articles, "query string, pos int, text string"))) == [
        ("none", 0, True), ("q", 10, False),
    ]
    fetches = table([("tg", False), ("tg", True), ("x", False)], "source string, success boolean")
    assert rows(social.source_status(fetches)) == [("tg", False), ("x", True)]


def test_assembled_social_flags(table):
    cands = table([("a",), ("b",)], "token_address string")
    search = table([("a", 3, False)], "token_address string, mentions int, degraded boolean")
    channels = table([("a", 4, True), ("b", 1, False)], "token_address string, mentions int, degraded boolean")
    scored = table(
        [("a", 40, 0.5, ["bot-networks"], ["@x"], "p/m")],
        "token_address string, organic_score int, sentiment double, model_flags array<string>, "
        "influencer_mentions array<string>, model_used string",
    )
    a, b = social.assemble_social(cands, search, channels, scored).orderBy("token_address").collect()
    assert (a.mentions_24h, a.red_flags, a.data_quality) == (7, ["telegram_scrape_blocked", "bot-networks"], "degraded")
    assert b.red_flags == ["x_scrape_blocked", "social_llm_exhausted"] and b.organic_score == 0


def test_coordinated_posting_is_strict(table):
    posts = table([(f"h{i}", " Buy NOW ") for i in range(11)] + [(f"h{i}", "x") for i in range(10)], "handle string, text string")
    assert [tuple(r)[1:] for r in social.coordinated_posting(posts).collect()] == [(11, 11)]


# -- chain ----------------------------------------------------------------------------
def test_holder_concentration(table, rows):
    data = [("even", i, "10") for i in range(20)] + [("bad", 0, "5"), ("bad", 1, "junk")]
    data += [("zero", 0, "0"), ("zero", 1, None), ("zero", 2, "")] + [("page", i, "1") for i in range(150)]
    got = rows(chain.holder_concentration(table(data, "token_address string, pos int, quantity string")))
    assert got == [("bad", 0, 0.0), ("even", 20, 50.0), ("page", 100, 10.0), ("zero", 3, 0.0)]


def test_velocity_and_whales(table, rows):
    data = [("fast", i, str(1000 - 6 * i), "0", "18") for i in range(100)]
    data += [("same", i, "500", "0", "18") for i in range(2)]
    data += [("one", 0, "500", str(5 * 10**21), "18")]
    data += [("bad", 0, "abc", str(10**20), "18"), ("bad", 1, "1", "5", "x")]
    data += [("blank", 0, "9", None, None), ("blank", 1, "3", "2000", "0")]
    df = table(data, "token_address string, pos int, time_stamp string, value string, decimals string")
    speed = dict(rows(chain.tx_velocity(df)))
    assert speed == {"fast": 10.1, "same": 120.0, "one": 0.0, "bad": 0.0, "blank": 20.0}
    whales = dict(rows(chain.whale_entries(df)))
    assert whales == {"fast": 0, "same": 0, "one": 1, "bad": 0, "blank": 1}
    both = {r.token_address: (r.velocity, r.whale_entries) for r in chain.transfer_metrics(df).collect()}
    assert both == {t: (speed[t], whales[t]) for t in speed}


def test_contracts_creators_and_assembly(table, rows):
    contracts = table(
        [("a", 0, "code", "0xAB"), ("a", 1, "", "0xCD"), ("b", 0, "", None)],
        "token_address string, pos int, source_code string, creator string",
    )
    meta = chain.contract_meta(contracts)
    assert rows(meta) == [("a", True, "0xab"), ("b", False, "0x" + "0" * 40)]
    txs = table([("x",)] * 120 + [("y",)] * 60 + [("z",)] * 49, "creator_address string")
    assert rows(chain.creator_history(txs)) == [("x", 2), ("y", 1), ("z", 0)]
    cands = table([("a", 5.0), ("b", 6.0), ("c", 7.0)], "token_address string, initial_liquidity_usd double")
    holders = table([("a", 9, 40.0), ("b", 9, 40.0)], "token_address string, holder_count int, top10_concentration_pct double")
    moves = table([("a", 3.0, 1)], "token_address string, velocity double, whale_entries int")
    full = meta.withColumn("creator_previous_tokens", F.lit(1))
    failures = table([("b", "holders")], "token_address string, source string")
    a, b, c = chain.assemble_chain(cands, holders, full, moves, failures).orderBy("token_address").collect()
    assert (a.holder_count, a.contract_verified, a.honeypot_check_passed, a.lp_locked, a.data_quality) == (9, True, True, False, "ok")
    assert (b.holder_count, b.data_quality) == (0, "degraded")
    assert (c.holder_count, c.whale_entries, c.data_quality) == (0, 0, "ok")


# -- rules ----------------------------------------------------------------------------
CLEAN = {
    "organic_score": 50, "sentiment": 0.2, "red_flags": [], "social_quality": "ok", "holder_count": 100,
    "top10_concentration_pct": 10.0, "liquidity_usd": 10000.0, "buy_sell_velocity_tx_per_min": 10.0,
    "whale_entries": 0, "contract_verified": True, "honeypot_check_passed": True, "lp_locked": True,
    "creator_previous_tokens": 0, "chain_quality": "ok",
}
SCHEMA = (
    "organic_score int, sentiment double, red_flags array<string>, social_quality string, holder_count int, "
    "top10_concentration_pct double, liquidity_usd double, buy_sell_velocity_tx_per_min double, whale_entries int, "
    "contract_verified boolean, honeypot_check_passed boolean, lp_locked boolean, creator_previous_tokens int, "
    "chain_quality string"
)
CASES = [
    ({}, [], 100),
    ({"contract_verified": False}, ["unverified-contract"], 75),
    ({"honeypot_check_passed": False}, ["honeypot-suspected"], 5),
    ({"lp_locked": False}, ["lp-not-locked"], 80),
    ({"top10_concentration_pct": 70.0}, [], 100),
    ({"top10_concentration_pct": 70.01}, ["high-top10-concentration"], 80),
    ({"holder_count": 20}, [], 100),
    ({"holder_count": 19}, ["low-holder-count"], 90),
    ({"liquidity_usd": 1000.0}, [], 100),
    ({"liquidity_usd": 999.0}, ["liquidity-too-thin"], 85),
    ({"buy_sell_velocity_tx_per_min": 300.5}, ["wash-trading-suspected"], 85),
    ({"creator_previous_tokens": 11}, ["serial-launcher"], 80),
    ({"organic_score": 14}, ["no-organic-buzz"], 90),
    ({"sentiment": -0.4}, [], 100),
    ({"sentiment": -0.41}, ["negative-sentiment"], 90),
    ({"red_flags": ["copy-paste-shilling", "paid-promotion-disclosure"]},
     ["copy-paste-shilling", "paid-promotion-disclosure"], 80),
    ({"whale_entries": 6}, ["whale-sniping"], 90),
    ({"social_quality": "degraded", "chain_quality": "degraded"}, ["social-data-degraded", "chain-data-degraded"], 90),
    ({"contract_verified": False, "lp_locked": False, "top10_concentration_pct": 99.0, "holder_count": 1,
      "liquidity_usd": 1.0, "creator_previous_tokens": 50},
     ["unverified-contract", "lp-not-locked", "high-top10-concentration", "low-holder-count", "liquidity-too-thin",
      "serial-launcher"], 0),
]


def test_rule_catalogue_and_scores(table):
    data = [(i, *{**CLEAN, **change}.values()) for i, (change, _, _) in enumerate(CASES)]
    scored = risk.aggregate_score(risk.run_rules(table(data, "n int, " + SCHEMA))).orderBy("n").collect()
    for row, (_, tags, score) in zip(scored, CASES):
        assert ([f.tag for f in row.findings], row.score) == (tags, score)


def test_reasons_and_own_rules(table):
    df = table([tuple({**CLEAN, "liquidity_usd": 0.5, "top10_concentration_pct": 81.25}.values())], SCHEMA)
    reasons = [f.reason for f in risk.run_rules(df).first().findings]
    assert reasons == ["Top 10 wallets hold 81.2% of supply.", "Liquidity only $0."]
    mine = [Rule("always", 7, F.lit(True), F.lit("so"))]
    assert risk.aggregate_score(risk.run_rules(df, mine)).first().score == 93


@pytest.mark.parametrize("score, tier", [(100, "high"), (85, "high"), (84, "moderate"), (65, "moderate"),
                                         (64, "speculative"), (40, "speculative"), (39, "degen"), (0, "degen")])
def test_tiers(table, score, tier):
    assert brief.conviction_tier(table([(score,)], "score_0_100 int")).first().conviction_tier == tier


def test_rationales(table):
    df = table(
        [(1, '```json\n{"rationale":" fine ","confidence":"HIGH"}\n```'), (2, "prose " * 100), (3, None),
         (4, '{"confidence":"odd"}')],
        "n int, content string",
    ).withColumns({"provider": F.lit("gate"), "model": F.lit("vendor/name")})
    got = {r.n: (r.rationale, r.confidence, r.model_used) for r in modeltext.parse_rationales(df).collect()}
    assert got[1] == ("fine", "high", "gate/name")
    assert got[2] == (("prose " * 100)[:400], "low", "gate/name")
    assert got[3][1:] == (None, None) and got[3][0].startswith("LLM providers unreachable")
    assert got[4] == ("No rationale produced.", "medium", "gate/name")


def test_review_reasons(table, rows):
    df = table(
        [("m1", "t", None, ["a", "b"], False), ("m2", "t", 50, [], True), ("m3", "t", 50, [], False)],
        "msg_id string, token_address string, score_0_100 int, red_flags array<string>, requires_human_review boolean",
    )
    to_brief, to_review = brief.route_verdicts(df)
    assert rows(to_brief, "msg_id") == [("m3",)]
    assert rows(brief.human_review(to_review, "now"), "risk_verdict_msg_id", "reason") == [
        ("m1", "a; b"), ("m2", "requires-human-review"),
    ]
