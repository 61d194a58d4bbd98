"""Feed, envelope, validation, hashing and model-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from launchsift.functions import schemas
from launchsift.functions.constants import DEFAULT_SOURCE_URL, TX_URL
from launchsift.functions.schemas import LONG, TEXT, struct
from launchsift.operators import envelope, ingest, modeltext, validate
from launchsift.plans.registry import Section
from launchsift.plans.tables import address, joined, or_none, sql_address, sql_strip, with_views
from launchsift.sources import readers

section = Section()
add = section.add


# -- launch feed --------------------------------------------------------------------
def feed_items(t):
    size = F.col("p_size")
    item = F.to_json(
        F.struct(
            F.upper("token_address").alias("address"),
            F.upper("creator_address").alias("creator"),
            F.when(size != 4, F.col("token_name")).alias("name"),
            F.col("token_symbol").alias("symbol"),
            F.when(size == 1, F.lit("junk"))
            .when(size == 2, F.lit(None))
            .when(size == 3, F.lit(""))
            .otherwise(F.col("initial_liquidity_usd").cast("string")).alias("liquidityUsd"),
            F.when(size != 5, F.col("launch_timestamp")).alias("launchedAt"),
            F.col("source_url").alias("url"),
        )
    )
    shaped = F.when(size == 6, F.lit('"text"')).when(size == 7, F.substring(item, 1, 20)).otherwise(item)
    return t.candidates().select("token_id", shaped.alias("item"))


@add(
    "q01_decode_feed_items",
    with_views(
        "v_candidate",
        body="""select token_id, token_address, creator_address, token_name, token_symbol,
               case when p_size in (2, 3) then 0.0 else initial_liquidity_usd end initial_liquidity_usd,
               case when p_size = 5 then '' else launch_timestamp end launch_timestamp, source_url
        from v_candidate where p_size not in (1, 4, 6, 7)""",
    ),
)
def decode_feed(t):
    return ingest.decode_feed_items(feed_items(t))


def feed_pages(t):
    return t.candidates().select(
        F.col("creator_id").alias("feed"), "token_id", (-F.col("token_id")).alias("pos"), "token_address", "p_size"
    )


CURSOR_SQL = f"""
    select creator_id feed,
           case when creator_id % 7 = 0 then '0xdead'
                else {sql_address('max(token_id) filter (p_size > 45)')} end last_seen
    from v_candidate group by 1 having count(*) filter (p_size > 45) > 0"""


@add(
    "q02_new_since_cursor",
    with_views(
        "v_candidate",
        cursors=CURSOR_SQL,
        body="""
        select c.creator_id feed, token_id, token_id emit_order from v_candidate c
        left join cursors k on c.creator_id = k.feed
        left join (select c2.creator_id, max(c2.token_id) stop from v_candidate c2
                   join cursors k2 on c2.creator_id = k2.feed and c2.token_address = k2.last_seen
                   group by 1) s on s.creator_id = c.creator_id
        where s.stop is null or token_id > s.stop""",
    ),
)
def new_rows(t):
    pages = feed_pages(t)
    cursors = (
        pages.filter(F.col("p_size") > 45).groupBy("feed")
        .agg(F.max_by("token_address", "token_id").alias("_a"))
        .select("feed", F.when(F.col("feed") % 7 == 0, F.lit("0xdead")).otherwise(F.col("_a")).alias("last_seen"))
    )
    return ingest.new_since_cursor(pages, cursors).select("feed", "token_id", "emit_order")


@add(
    "q02_advance_cursor",
    with_views(
        "v_candidate",
        body=f"select creator_id feed, {sql_address('max(token_id)')} last_seen from v_candidate group by 1",
    ),
)
def next_cursor(t):
    return ingest.advance_cursor(feed_pages(t))


@add(
    "q03_decode_launch_logs",
    with_views(
        "v_candidate",
        body=f"""select token_id block, token_address, creator_address, '(on-chain)' token_name,
               '?' token_symbol, 0.0::double initial_liquidity_usd, '' launch_timestamp,
               '{TX_URL}0x' || lpad(lower(to_hex(token_id * 7)), 64, '0') source_url
        from v_candidate where p_size > 3""",
    ),
)
def launch_logs(t):
    def topic(digits):
        return F.concat(F.lit("0x"), F.lpad(F.upper(digits), 64, "0"))

    def digits_of(column):
        return F.substring(column, 3, 40)

    size = F.col("p_size")
    logs = t.candidates().select(
        F.col("token_id").alias("block"),
        F.slice(
            F.array(F.lit("0xfeed"), topic(digits_of("token_address")), topic(digits_of("creator_address"))),
            F.lit(1),
            F.when(size <= 2, F.lit(2)).when(size == 3, F.lit(0)).otherwise(F.lit(3)),
        ).alias("topics"),
        F.lit("0x").alias("data"),
        F.lower(topic(F.hex(F.col("token_id") * 7))).alias("transactionHash"),
    )
    return ingest.decode_launch_logs(logs)


@add(
    "q03_logs_since",
    """select o_orderkey block, '0x' || lpad(o_custkey::varchar, 40, '0') creator from orders
       where o_orderkey > 500 and o_orderkey <= (select max(o_orderkey) - 500 from orders)
       and o_orderpriority <> '5-LOW' and o_orderstatus <> 'P'""",
)
def logs_since(t):
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    logs = t.orders.select(
        F.col("o_orderkey").alias("block"),
        F.when(priority != "5-LOW", F.lit("0xfeed")).otherwise(F.lit("0xother")).alias("address"),
        F.when(status == "P", F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("launch"), F.lpad(F.col("o_custkey").cast("string"), 40, "0"))).alias("topics"),
    )
    head = t.orders.agg(F.max("o_orderkey")).first()[0] - 500
    found = readers.logs_between(logs, 500, head, "0xfeed", "launch")
    return found.select("block", F.concat(F.lit("0x"), F.col("topics")[1]).alias("creator"))


NOW = "2024-02-01T00:00:00Z"


@add(
    "q04_normalize_candidates",
    with_views(
        "v_candidate",
        body=f"""select token_id,
               case when p_size = 1 then '{NOW}' else launch_timestamp end launch_timestamp,
               case when p_size = 2 then 'unknown' else token_name end token_name,
               case when p_size = 3 then '?' else token_symbol end token_symbol,
               case when p_size in (4, 5) then '{DEFAULT_SOURCE_URL}' else source_url end source_url
        from v_candidate""",
    ),
)
def normalized(t):
    size = F.col("p_size")

    def blank(column, at):
        return F.when(size == at, F.lit("")).otherwise(F.col(column)).alias(column)

    raw = t.candidates().select(
        "token_id", blank("launch_timestamp", 1), blank("token_name", 2), blank("token_symbol", 3),
        F.when(size == 4, F.lit("")).when(size == 5, F.lit(None)).otherwise(F.col("source_url")).alias("source_url"),
    )
    return ingest.normalize_candidates(raw, NOW)


# -- storing --------------------------------------------------------------------------
ARRIVAL = "l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@add(
    "q05_append_findings",
    f"""select l_orderkey msg_id, l_partkey, l_linenumber from (
            select *, row_number() over (partition by l_orderkey order by {ARRIVAL}) rn from lineitem)
        where rn = 1 and l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')""",
)
def appended(t):
    incoming = t.lineitem.select(
        F.col("l_orderkey").alias("msg_id"), "l_partkey", "l_linenumber", "l_shipdate", "l_suppkey", "l_extendedprice"
    )
    stored = t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("msg_id"))
    return envelope.append_findings(incoming, stored, ARRIVAL.split(", ")).select(
        "msg_id", "l_partkey", "l_linenumber"
    )


@add(
    "q06_attach_receipts",
    """select o_orderkey msg_id, tx on_chain_tx, coalesce(block, -1) on_chain_block from orders left join (
            select l_orderkey, 'tx' || l_suppkey tx, epoch_us(l_shipdate) // 1000000 block,
                   row_number() over (partition by l_orderkey order by l_shipdate desc,
                        l_linenumber desc, l_partkey desc, l_suppkey desc) rn
            from lineitem) on o_orderkey = l_orderkey and rn = 1""",
)
def receipts(t):
    found = t.lineitem.select(
        F.col("l_orderkey").alias("msg_id"),
        F.concat(F.lit("tx"), F.col("l_suppkey").cast("string")).alias("on_chain_tx"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("on_chain_block"),
        "l_linenumber", "l_partkey", "l_suppkey",
    )
    findings = t.orders.select(F.col("o_orderkey").alias("msg_id"))
    order = ["on_chain_block", "l_linenumber", "l_partkey", "l_suppkey"]
    return or_none(envelope.attach_receipts(findings, found, order), "on_chain_block")


# -- validation -----------------------------------------------------------------------
def raw_envelopes(t):
    kind = F.col("user_id") % 11
    number = F.col("event_id").cast("string")
    digest = F.sha2(number.cast("binary"), 256)

    def case(cases, other):
        out = None
        for value, column in cases.items():
            out = F.when(kind == value, column) if out is None else out.when(kind == value, column)
        return out.otherwise(other)

    return t.events.select(
        "event_id",
        case(
            {
                0: F.lpad(number, 25, "0"),
                1: F.concat(F.lit("U"), F.lpad(number, 25, "0")),
                2: F.concat(F.lit("a"), F.lpad(number, 25, "0")),
            },
            F.lpad(number, 26, "0"),
        ).alias("msg_id"),
        case({3: F.lit("Hunter")}, F.lit("risk")).alias("agent"),
        case({4: F.upper(digest)}, digest).alias("payload_hash"),
        case(
            {5: F.array(F.lpad(number, 26, "0"), F.lit("short"))}, F.array(F.lpad(number, 26, "0"))
        ).alias("upstream_ids"),
        F.lit("{}").alias("payload"),
        case({6: F.lit("2024-01-01"), 9: F.lit("2024-01-01T00:00:00-05:00")}, F.lit("2024-01-01T00:00:00Z")).alias(
            "created_at"
        ),
        case({7: F.lit("/x"), 8: F.lit(None)}, F.lit("a/b")).alias("model_used"),
    )


RAW_ENVELOPES = """
    select event_id, user_id % 11 k, sha256(event_id::varchar) h,
           case user_id % 11 when 0 then lpad(event_id::varchar, 25, '0')
                when 1 then 'U' || lpad(event_id::varchar, 25, '0')
                when 2 then 'a' || lpad(event_id::varchar, 25, '0')
                else lpad(event_id::varchar, 26, '0') end msg_id
    from events"""
ENVELOPE_ERRORS = """
    concat_ws(',',
        case when not regexp_full_match(upper(msg_id), '[0-9A-HJKMNP-TV-Z]{26}') then 'msg_id' end,
        case when k = 3 then 'agent' end,
        case when k = 5 then 'upstream_ids' end,
        case when not regexp_full_match(case when k = 4 then upper(h) else h end, '[0-9a-f]{64}')
             then 'payload_hash' end,
        case when k = 6 then 'created_at' end,
        case when k = 7 then 'model_used' end)"""


@add(
    "q07_validate_envelopes",
    with_views(raw=RAW_ENVELOPES, body=f"select event_id, msg_id, {ENVELOPE_ERRORS} errors from raw"),
)
def envelopes_checked(t):
    return validate.validate_envelopes(raw_envelopes(t)).select("event_id", "msg_id", joined(F.col("errors")).alias("errors"))


@add(
    "q09_split_quarantine",
    with_views(
        raw=RAW_ENVELOPES,
        checked=f"select event_id, {ENVELOPE_ERRORS} errors from raw",
        body="select event_id, case when errors = '' then 'good' else 'dead' end route, errors from checked",
    ),
)
def quarantine(t):
    good, bad = validate.split_quarantine(validate.validate_envelopes(raw_envelopes(t)))
    return good.select("event_id", F.lit("good").alias("route"), F.lit("").alias("errors")).unionByName(
        bad.select("event_id", F.lit("dead").alias("route"), joined(F.col("errors")).alias("errors"))
    )


def _payloads(kind, rows, id_col, spoil=(), **columns):
    """JSON payloads with the given columns, checked as ``kind``.

    ``spoil`` lists (condition, pattern, replacement) by which some texts get wrong types.
    """
    body = F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]))
    for condition, pattern, new in spoil:
        body = F.when(condition, F.regexp_replace(body, pattern, new)).otherwise(body)
    checked = validate.validate_payload(rows.select(id_col, body.alias("payload")), kind)
    return checked.select(F.col(id_col).alias("row_id"), joined(F.col("errors")).alias("errors"))


def _expected(table, id_col, *checks):
    cases = ", ".join(f"case when {bad} then '{name}' end" for name, bad in checks)
    return f"select {id_col} row_id, concat_ws(',', {cases}) errors from {table}"


@add(
    "q08_validate_candidate",
    with_views(
        "v_candidate",
        body=_expected(
            "v_candidate", "token_id",
            ("token_address", "p_size = 1"), ("launch_timestamp", "p_size = 2"),
            ("token_name", "p_size = 3"), ("initial_liquidity_usd", "p_size = 4"),
            ("source_url", "p_size = 6"), ("unknown_keys", "p_size = 5"),
        ),
    ),
)
def check_candidate(t):
    size = F.col("p_size")
    return _payloads(
        "candidate", t.candidates(), "token_id",
        token_address=F.when(size == 1, F.lit("0xBAD")).otherwise(F.col("token_address")),
        launch_timestamp=F.when(size != 2, F.col("launch_timestamp")),
        creator_address=F.col("creator_address"),
        token_name=F.when(size == 3, F.lit(" \n ")).otherwise(F.col("token_name")),
        token_symbol=F.col("token_symbol"),
        initial_liquidity_usd=F.when(size == 4, F.lit(-1.0)).otherwise(F.col("initial_liquidity_usd")),
        source_url=F.when(size == 6, F.repeat(F.lit("u"), F.lit(1025))).otherwise(F.col("source_url")),
        note=F.when(size == 5, F.lit("x")),
    )


@add(
    "q08_validate_social",
    _expected(
        "events", "event_id",
        ("token_address", "event_type = 'view' and user_id % 2 = 0"),
        ("organic_score", "floor(value) > 100"),
        ("mentions_24h", "user_id % 13 = 3"),
        ("sentiment", "value / 100 - 1 > 1"),
        ("red_flags", "user_id % 13 in (1, 2)"),
        ("data_quality", "event_type = 'error'"),
    ),
)
def check_social(t):
    kind = F.col("event_type")
    return _payloads(
        "social", t.events, "event_id",
        spoil=[
            (F.col("user_id") % 13 == 1, r'"red_flags":\[[^\]]*\]', '"red_flags":"oops"'),
            (F.col("user_id") % 13 == 2, r'"red_flags":\[[^\]]*\]', '"red_flags":null'),
            (F.col("user_id") % 13 == 3, r'"mentions_24h":(\d+)', '"mentions_24h":$1.5'),
        ],
        token_address=F.when((kind == "view") & (F.col("user_id") % 2 == 0), F.lit("0x12")).otherwise(
            address(F.col("user_id"))
        ),
        organic_score=F.floor("value"),
        mentions_24h=F.get_json_object("props", "$.k").cast("int"),
        sentiment=F.col("value") / 100 - 1,
        red_flags=F.array(kind),
        influencer_mentions=F.array().cast("array<string>"),
        data_quality=F.when(kind == "error", F.lit("bad")).when(kind == "click", F.lit(None)).otherwise(F.lit("ok")),
    )


@add(
    "q08_validate_chain",
    _expected(
        "lineitem", "l_orderkey * 1000 + l_linenumber",
        ("top10_concentration_pct", "l_discount * 1500 > 100"),
        ("buy_sell_velocity_tx_per_min", "l_tax * 100 - 1 < 0"),
        ("honeypot_check_passed", "l_linestatus = 'F' and l_returnflag = 'A'"),
    ),
)
def check_chain(t):
    rows = t.lineitem.withColumn("row", F.col("l_orderkey") * 1000 + F.col("l_linenumber"))
    return _payloads(
        "chain", rows, "row",
        token_address=address(F.col("l_partkey")),
        holder_count=F.col("l_quantity").cast("int"),
        top10_concentration_pct=F.col("l_discount") * 1500,
        liquidity_usd=F.col("l_extendedprice"),
        buy_sell_velocity_tx_per_min=F.col("l_tax") * 100 - 1,
        whale_entries=F.col("l_linenumber"),
        contract_verified=F.col("l_returnflag") == "R",
        honeypot_check_passed=F.when(
            ~((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A")), F.lit(True)
        ),
        lp_locked=F.lit(False),
        creator_previous_tokens=F.col("l_linenumber") - 1,
        data_quality=F.lit("ok"),
    )


@add(
    "q08_validate_verdict",
    _expected(
        "orders", "o_orderkey",
        ("score_0_100", "cast(floor(o_totalprice) as bigint) % 120 > 100 and o_orderkey % 17 <> 3"),
        ("rationale", "length(o_orderpriority) * (1 + o_orderkey % 600) > 4000 or o_orderkey % 17 = 2"),
        ("confidence", "o_orderstatus = 'P'"),
        ("requires_human_review", "o_orderkey % 17 = 1"),
    ),
)
def check_verdict(t):
    status = F.col("o_orderstatus")
    return _payloads(
        "verdict", t.orders, "o_orderkey",
        spoil=[
            (F.col("o_orderkey") % 17 == 1, '"requires_human_review":false', '"requires_human_review":"maybe"'),
            (F.col("o_orderkey") % 17 == 2, '"rationale":"[^"]*"', '"rationale":7'),
            (F.col("o_orderkey") % 17 == 3, r'"score_0_100":\d+', '"score_0_100":null'),
        ],
        token_address=address(F.col("o_orderkey")),
        score_0_100=F.when(status != "O", F.floor("o_totalprice") % 120)
        .otherwise(F.floor("o_totalprice") % 120),
        red_flags=F.array(F.col("o_orderpriority")),
        rationale=F.repeat(F.col("o_orderpriority"), (F.lit(1) + F.col("o_orderkey") % 600).cast("int")),
        missing_inputs=F.array().cast("array<string>"),
        confidence=F.when(status == "F", F.lit("low")).when(status == "P", F.lit("certain")),
        requires_human_review=F.lit(False),
    )


@add(
    "q08_validate_brief",
    _expected(
        "documents", "doc_id",
        ("thesis", f"length({sql_strip('text')}) not between 50 and 2000"),
        ("conviction_tier", "lang = 'de'"),
    ),
)
def check_brief(t):
    lang = F.col("lang")
    return _payloads(
        "brief", t.documents, "doc_id",
        token_name=F.col("source"),
        token_address=address(F.col("doc_id")),
        thesis=F.col("text"),
        conviction_tier=F.when(lang == "en", F.lit("high")).when(lang == "de", F.lit("Moderate"))
        .when(lang == "fr", F.lit("degen")).otherwise(F.lit("speculative")),
        caveats=F.array(lang),
        sources=F.array().cast("array<string>"),
        model_attribution=F.array().cast("array<string>"),
        brief_generated_at=F.lit(NOW),
        confidence_tier=F.lit("ok"),
    )


@add(
    "q08_validate_review",
    _expected(
        "customer", "c_custkey",
        ("reason", "length(c_name) * (c_custkey % 70) not between 1 and 1024"),
        ("risk_verdict_msg_id", "c_custkey % 3 = 0"),
    ),
)
def check_review(t):
    number = F.col("c_custkey").cast("string")
    return _payloads(
        "review", t.customer, "c_custkey",
        token_address=address(F.col("c_custkey")),
        reason=F.repeat(F.col("c_name"), (F.col("c_custkey") % 70).cast("int")),
        risk_verdict_msg_id=F.when(F.col("c_custkey") % 3 == 0, F.lpad(number, 20, "0")).otherwise(
            F.lpad(number, 26, "0")
        ),
        raised_at=F.lit(NOW),
    )


# -- hashing ------------------------------------------------------------------------------
CANDIDATE_JSON = """to_json({
    'creator_address': creator_address, 'initial_liquidity_usd': initial_liquidity_usd,
    'launch_timestamp': launch_timestamp, 'source_url': source_url, 'token_address': token_address,
    'token_name': token_name, 'token_symbol': token_symbol})::varchar"""


@add(
    "q10_build_envelopes",
    with_views(
        "v_candidate",
        sealed=f"select {CANDIDATE_JSON} payload, sha256({CANDIDATE_JSON}) payload_hash from v_candidate",
        body=f"""select upper(substr(sha256('hunter||' || payload_hash), 1, 26)) msg_id, 'hunter' agent,
                payload_hash, payload, '{NOW}' created_at from sealed""",
    ),
)
def sealed(t):
    return envelope.build_envelopes(t.candidates(), "hunter", schemas.CANDIDATE, NOW).select(
        "msg_id", "agent", "payload_hash", "payload", "created_at"
    )


DOCUMENT = struct(doc_id=LONG, lang=TEXT, n_chars=LONG, source=TEXT, text=TEXT)
DOCUMENT_JSON = (
    "to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source, 'text': text})::varchar"
)


@add("q11_hash_payloads", f"select doc_id, sha256({DOCUMENT_JSON}) payload_hash from documents")
def hashed(t):
    return envelope.hash_payloads(t.documents, DOCUMENT).select("doc_id", "payload_hash")


@add(
    "q12_dedup_by_hash",
    """select sha256(text) payload_hash, min(doc_id) doc_id, count(*) - 1 copies
       from documents group by 1""",
)
def deduplicated(t):
    rows = t.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("payload_hash"))
    return envelope.dedup_by_hash(rows, ["doc_id"])


@add(
    "q13_prompt_hash",
    """select conv_id, sha256(string_agg(role || chr(0) || text || chr(0), ''
              order by case when role = 'system' then 0 else 1 end, turn)) prompt_hash
       from conversations group by 1""",
)
def prompts(t):
    return envelope.prompt_hash(t.conversations)


# -- model text -----------------------------------------------------------------------------
def stored_responses(t):
    kind = F.col("turn") % 6
    body = F.to_json(F.struct(F.col("text").alias("thesis"), F.col("role").alias("confidence")))
    content = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("```\n"), body, F.lit("\n```\n")))
        .when(kind == 2, F.concat(F.lit("  \n"), body, F.lit("\n ")))
        .when(kind == 3, F.concat(F.lit("no json: "), F.col("text")))
        .when(kind == 4, F.concat(F.lit("["), body, F.lit("]")))
        .otherwise(F.concat(F.lit("```json"), body, F.lit("```")))
    )
    return t.messages().select(
        "msg_id", F.concat(F.lit("model"), (F.col("conv_id") % 6).cast("string")).alias("model"),
        F.lit("prov").alias("provider"), content.alias("content"), "text",
    )


@add(
    "q14_parse_responses",
    with_views(
        "v_message",
        body="""select msg_id, turn % 6 in (0, 1, 5) fenced, turn % 6 in (0, 1, 2) well_formed,
               case when turn % 6 in (0, 1, 2) then text else '' end thesis from v_message""",
    ),
)
def responses(t):
    parsed = modeltext.parse_responses(stored_responses(t))
    return parsed.select(
        "msg_id", "fenced", "well_formed", F.coalesce("data.thesis", F.lit("")).alias("thesis")
    )


@add(
    "q14_response_quality",
    with_views(
        "v_message",
        body="""select 'model' || (conv_id % 6) model, count(*) filter (turn % 6 in (0, 1, 5)) fenced,
               count(*) filter (turn % 6 not in (0, 1, 5)) plain,
               count(*) filter (turn % 6 not in (0, 1, 2)) malformed from v_message group by 1""",
    ),
)
def quality(t):
    return modeltext.response_quality(modeltext.parse_responses(stored_responses(t)))


def scored_responses(t):
    body = F.to_json(
        F.struct(
            (F.floor("value") - 50).alias("organic_score"),
            (F.col("value") / 100 - 1.5).alias("sentiment"),
            F.array("event_type").alias("red_flags"),
            F.when(F.col("user_id") % 3 != 0, F.array(F.concat(F.lit("@u"), F.col("user_id").cast("string"))))
            .alias("influencer_mentions"),
        )
    )
    rows = t.events.select(
        "event_id", "user_id", "ts",
        F.concat(F.lit("prov"), (F.col("user_id") % 4).cast("string")).alias("provider"),
        F.concat(F.lit("vendor/model"), (F.col("user_id") % 6).cast("string")).alias("model"),
        F.when(F.col("event_id") % 7 == 0, F.lit("oops")).otherwise(body).alias("content"),
    )
    return modeltext.score_responses(modeltext.parse_responses(rows))


SCORED = """
    select event_id, user_id, ts,
           case when event_id % 7 = 0 then 0
                else greatest(0, least(100, cast(floor(value) as int) - 50)) end organic_score,
           case when event_id % 7 = 0 then 0.0
                else greatest(-1.0::double, least(1.0::double, value / 100 - 1.5)) end sentiment,
           case when event_id % 7 = 0 then '' else event_type end flags,
           case when event_id % 7 = 0 or user_id % 3 = 0 then '' else '@u' || user_id end who,
           'prov' || (user_id % 4) || '/model' || (user_id % 6) model_used
    from events"""


@add(
    "q15_score_responses",
    with_views(
        scored=SCORED,
        body="""select event_id, organic_score, sentiment, flags red_flags, who influencer_mentions,
                model_used from scored""",
    ),
)
def social_scores(t):
    return scored_responses(t).select(
        "event_id", "organic_score", "sentiment", joined(F.col("model_flags")).alias("red_flags"),
        joined(F.col("influencer_mentions")).alias("influencer_mentions"), "model_used",
    )
