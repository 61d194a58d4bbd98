"""Queries over stored findings and the ledger audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from launchsift.operators import brief, findings, ledger
from launchsift.plans.intake import DOCUMENT_JSON
from launchsift.plans.registry import Section
from launchsift.plans.tables import epoch, or_none, with_views

section = Section()
add = section.add


# -- read queries ------------------------------------------------------------------------
def stored_briefs(t):
    urgent = F.col("priority").isin("1-URGENT", "2-HIGH")
    tier = brief.tier_of(F.col("score"))
    payload = F.to_json(
        F.struct(
            F.when(F.col("msg_id") % 3 != 0, F.concat(F.lit("tok"), F.col("msg_id").cast("string"))).alias("token_name"),
            tier.alias("conviction_tier"),
            F.repeat(F.concat_ws(" ", "priority", "status"), 30).alias("thesis"),
        )
    )
    return t.briefs().select(
        "msg_id", F.when(urgent, F.lit("narrator")).otherwise(F.lit("risk")).alias("agent"),
        "created_at", tier.alias("conviction_tier"), payload.alias("payload"),
    )


STORED = """
    select msg_id, case when priority in ('1-URGENT', '2-HIGH') then 'narrator' else 'risk' end agent, created_at,
           case when score >= 85 then 'high' when score >= 65 then 'moderate' when score >= 40 then 'speculative'
                else 'degen' end conviction_tier,
           case when msg_id % 3 <> 0 then 'tok' || msg_id else 'unknown' end token_name,
           repeat(priority || ' ' || status, 30) thesis
    from v_brief"""


@add(
    "q40_list_briefs",
    with_views(
        "v_brief", stored=STORED,
        body="""select msg_id, conviction_tier, epoch_us(created_at) created_us from stored where agent = 'narrator'
                order by created_at desc, msg_id desc limit 50 offset 100""",
    ),
)
def page(t):
    return findings.list_briefs(stored_briefs(t), limit=50, offset=100).select(
        "msg_id", "conviction_tier", epoch(F.col("created_at")).alias("created_us")
    )


@add(
    "q41_get_finding",
    with_views(
        "v_brief", stored=STORED,
        body="""select msg_id, agent, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') created_at, conviction_tier
                from stored where msg_id = 1001""",
    ),
)
def one(t):
    return findings.get_finding(stored_briefs(t), 1001).drop("payload")


@add(
    "q42_verify_findings",
    f"""select doc_id msg_id, sha256({DOCUMENT_JSON}) local_hash,
              case when doc_id % 10 = 0 then sha256(source) else sha256({DOCUMENT_JSON}) end stored_hash,
              doc_id % 10 <> 0 hash_match, doc_id % 3 <> 0 on_chain_present,
              doc_id % 3 <> 0 and doc_id % 7 <> 0 on_chain_match
       from documents""",
)
def verified(t):
    doc = F.col("doc_id")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    sorted_json = F.to_json(F.struct("doc_id", "lang", "n_chars", "source", "text"))
    stored = t.documents.select(
        doc.alias("msg_id"),
        F.to_json(F.struct("text", "source", "doc_id", "n_chars", "lang")).alias("payload"),
        F.when(doc % 10 == 0, sha(F.col("source"))).otherwise(sha(sorted_json)).alias("payload_hash"),
    )
    record = (
        stored.filter(F.col("msg_id") % 3 != 0)
        .select(
            "msg_id",
            F.when(F.col("msg_id") % 7 == 0, F.lit("f" * 64)).otherwise(F.col("payload_hash")).alias("ledger_hash"),
        )
    )
    return findings.verify_findings(stored, record)


@add(
    "q43_latest_briefs",
    with_views(
        "v_brief", stored=STORED,
        body="""select msg_id, token_name, conviction_tier, left(thesis, 200) thesis from stored
                where agent = 'narrator' order by created_at desc, msg_id desc limit 5""",
    ),
)
def latest(t):
    return findings.latest_briefs(stored_briefs(t))


@add(
    "q44_filter_briefs",
    with_views(
        "v_brief", stored=STORED,
        body="""select msg_id from stored where created_at >= timestamp '2000-01-01' and conviction_tier = 'high'""",
    ),
)
def recent_high(t):
    since = F.to_timestamp(F.lit("2000-01-01 00:00:00"))
    return findings.filter_briefs(stored_briefs(t), since, "high").select("msg_id")


KINDS = {
    "stream:candidates": "signup",
    "stream:social": "view",
    "stream:chain": "click",
    "stream:risk": "purchase",
    "stream:human_review": "error",
}
SIX = " union all ".join(
    [f"select '{s}' stream, event_id msg_id, ts created_at from events where event_type = '{k}'" for s, k in KINDS.items()]
    + ["select 'stream:briefs' stream, o_orderkey msg_id, o_orderdate created_at from orders"]
)


@add(
    "q45_recent_events",
    f"""select stream, msg_id, epoch_us(created_at) created_us from ({SIX})
        order by created_at desc, stream, msg_id desc limit 100""",
)
def recent(t):
    events = t.events.select(
        F.col("event_id").alias("msg_id"), F.col("ts").cast("timestamp").alias("created_at"), "event_type"
    )
    streams = {s: events.filter(F.col("event_type") == k) for s, k in KINDS.items()}
    streams["stream:briefs"] = t.briefs().select("msg_id", "created_at")
    return findings.recent_events(streams).select("stream", "msg_id", epoch(F.col("created_at")).alias("created_us"))


# -- ledger --------------------------------------------------------------------------------
DAY_US = 86_400_000_000
ORDER = "((10 * l_orderkey + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey"


def attempts(t):
    c = F.col
    text_id = F.lpad(c("l_orderkey").cast("string"), 26, "0")
    digest = F.unhex(F.sha2(c("l_partkey").cast("string").cast("binary"), 256))
    zero = F.lit(ledger.ZERO32)
    return t.lineitem.select(
        F.when(c("l_partkey") % 50 == 0, zero).otherwise(ledger.ledger_key(text_id)).alias("msg_id"),
        F.when(c("l_partkey") % 51 == 0, zero).otherwise(digest).alias("payload_hash"),
        F.when(c("l_linenumber") == 6, F.lit("")).otherwise(c("l_returnflag")).alias("agent"),
        (c("l_suppkey") % 20).cast("string").alias("sender"),
        F.floor(epoch(c("l_shipdate")) / DAY_US).alias("block"),
        F.expr(ORDER).alias("idx"),
    )


def grants(t):
    return t.orders.select(
        (F.col("o_custkey") % 20).cast("string").alias("sender"),
        (F.col("o_orderstatus") != "F").alias("granted"),
        F.floor(epoch(F.col("o_orderdate")) / DAY_US).alias("block"),
        (F.col("o_orderkey") * 10_000_000_000 + 999_999_999).alias("idx"),
    )


def judged(t):
    return ledger.allowlist_asof(attempts(t), grants(t), owner="0", blocks_per_bucket=30)


AUDIT = {
    "attempts": f"""
        select case when l_partkey % 50 = 0 then repeat('00', 32)
                    else lower(hex(lpad(l_orderkey::varchar, 26, '0'))) || repeat('00', 6) end msg_id,
               case when l_partkey % 51 = 0 then repeat('00', 32) else sha256(l_partkey::varchar) end payload_hash,
               case when l_linenumber = 6 then '' else l_returnflag end agent, (l_suppkey % 20)::varchar sender,
               epoch_us(l_shipdate) // {DAY_US} block, {ORDER} idx
        from lineitem""",
    "grants": f"""
        select (o_custkey % 20)::varchar sender, o_orderstatus <> 'F' granted,
               epoch_us(o_orderdate) // {DAY_US} block, o_orderkey * 10000000000 + 999999999 idx
        from orders""",
    "judged": """
        select a.*, coalesce(g.granted, a.sender = '0') is_agent
        from (select *, block::hugeint * 1000000000000000000 + idx pos from attempts) a
        asof left join (select *, block::hugeint * 1000000000000000000 + idx pos from grants) g
        on a.sender = g.sender and a.pos >= g.pos""",
    "reasons": """
        select *, case when not is_agent then 'NotAgent' when msg_id = repeat('00', 32) then 'ZeroMsgId'
                       when payload_hash = repeat('00', 32) then 'ZeroPayloadHash'
                       when agent = '' then 'EmptyAgent' end reason from judged""",
    "outcomes": """
        select *, case when reason is not null then reason
                       when row_number() over (partition by msg_id, reason is null order by block, idx) = 1
                       then 'Recorded' else 'AlreadyRecorded' end outcome from reasons""",
}


@add(
    "q46_merge_ledger",
    with_views(**AUDIT, body="select msg_id, sender, block, idx, outcome from outcomes"),
)
def merged(t):
    return ledger.merge_ledger(judged(t), blocks_per_bucket=365).select(
        F.lower(F.hex("msg_id")).alias("msg_id"), "sender", "block", "idx", "outcome"
    )


@add(
    "q47_allowlist_asof",
    with_views(**AUDIT, body="select sender, block, idx, is_agent from judged"),
)
def allowed(t):
    return judged(t).select("sender", "block", "idx", "is_agent")


def text_findings(t):
    return t.orders.select(
        F.lpad(F.col("o_orderkey").cast("string"), 26, "0").alias("msg_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


FOUND = """
    select lpad(o_orderkey::varchar, 26, '0') msg_id, r.payload_hash ledger_hash, r.agent ledger_agent,
           coalesce(r.block, -1) ledger_block, r.msg_id is not null "exists"
    from orders left join (from outcomes where outcome = 'Recorded') r
    on r.msg_id = lower(hex(lpad(o_orderkey::varchar, 26, '0'))) || repeat('00', 6)"""


@add("q48_lookup_ledger", with_views(**AUDIT, found=FOUND, body="select * from found"))
def looked_up(t):
    found = ledger.lookup_ledger(text_findings(t), ledger.ledger_of(judged(t))).drop("created_at")
    return or_none(found, "ledger_block")


@add(
    "q48_existing_findings",
    with_views(**AUDIT, found=FOUND, body='select msg_id from found where "exists"'),
)
def existing(t):
    return ledger.existing(text_findings(t), ledger.ledger_of(judged(t))).select("msg_id")


@add(
    "q49_pending_anchors",
    with_views(**AUDIT, found=FOUND, body='select msg_id from found where not "exists"'),
)
def pending(t):
    return ledger.pending_anchors(text_findings(t), ledger.ledger_of(judged(t))).select("msg_id")
