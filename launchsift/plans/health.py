"""Health, operations, dashboard and launch de-duplication queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from launchsift.operators import anchored, brief, dashboard, health, lineage
from launchsift.plans.registry import Section
from launchsift.plans.tables import address, epoch, joined, sql_address, with_views

section = Section()
add = section.add


def beats(t):
    return t.events.select(
        F.col("event_type").alias("agent"), F.col("ts").cast("timestamp").alias("last_seen"),
        F.when(F.col("value") < 100, F.lit("online")).otherwise(F.lit("down")).alias("status"),
        F.col("user_id").alias("events_last_min"), "event_id",
    )


LAST = """
    select * from (select event_type agent, ts last_seen,
                          case when value < 100 then 'online' else 'down' end status, user_id events_last_min,
                          row_number() over (partition by event_type order by ts desc, event_id desc) rn from events)
    where rn = 1"""


@add(
    "q64_latest_heartbeats",
    with_views(b=LAST, body="select agent, epoch_us(last_seen) last_seen_us, status, events_last_min from b"),
)
def last_beats(t):
    return health.latest_heartbeats(beats(t), ["last_seen", "event_id"]).select(
        "agent", epoch(F.col("last_seen")).alias("last_seen_us"), "status", "events_last_min"
    )


@add(
    "q65_overall_status",
    with_views(
        b=LAST,
        body="""select case when count(*) > 0 and count(*) filter (status = 'online') = count(*) then 'ok'
                else 'degraded' end status, count(*) filter (status = 'online') online, count(*) agents from b""",
    ),
)
def overall(t):
    return health.overall_status(health.latest_heartbeats(beats(t), ["last_seen", "event_id"]))


@add(
    "q66_events_per_beat",
    """with e as (select 'agent' || (user_id % 5) agent, epoch_us(ts) us from events where event_type <> 'signup'),
            b as (select 'agent' || (user_id % 5) agent, epoch_us(ts) us from events where event_type = 'signup'),
            hit as (select e.agent, b.us from e asof join b on b.agent = e.agent and b.us >= e.us)
       select agent, us beat_at, count(h_us) events from (
            select b.agent, b.us, h.us h_us from b left join hit h on h.agent = b.agent and h.us = b.us)
       group by 1, 2""",
)
def per_beat(t):
    rows = t.events.select(
        F.concat(F.lit("agent"), (F.col("user_id") % 5).cast("string")).alias("agent"),
        F.col("ts").cast("timestamp").alias("ts"), "event_type",
    )
    signup = F.col("event_type") == "signup"
    return health.events_per_beat(rows.filter(~signup).drop("event_type"), rows.filter(signup).drop("event_type"))


@add(
    "q66_events_per_slot",
    """select event_type agent, epoch_us(ts) // 10000000 * 10000000 slot_start, count(*) events
       from events group by 1, 2""",
)
def per_slot(t):
    return health.events_per_slot(t.events.select(F.col("event_type").alias("agent"), "ts"))


@add(
    "q67_event_counters",
    with_views(
        "v_call",
        body="""select agent, count(*) filter (success) processed, count(*) filter (not success) failed
                from v_call group by 1""",
    ),
)
def counters(t):
    return health.event_counters(t.calls())


BOUNDS = (1.0, 5.0, 10.0, 50.0, 100.0, 250.0)


@add(
    "q68_processing_histogram",
    f"""select 'agent' || (user_id % 5) agent, le,
              count(*) filter (value <= case le when '+Inf' then 'inf'::double else le::double end) events
       from events, (values {', '.join(f"('{b}')" for b in (*BOUNDS, '+Inf'))}) b(le) group by 1, 2""",
)
def histogram(t):
    rows = t.events.select(
        F.concat(F.lit("agent"), (F.col("user_id") % 5).cast("string")).alias("agent"), F.col("value").alias("seconds")
    )
    return health.processing_histogram(rows, BOUNDS)


@add(
    "q69_pending_depth",
    """select l_shipmode stream, g "group", count(*) pending from (
            select distinct l_returnflag l_shipmode, l_linestatus g, l_orderkey e from lineitem) d
       where not exists (select 1 from orders where o_orderkey = e and o_orderstatus = g) group by 1, 2""",
)
def depth(t):
    delivered = t.lineitem.select(
        F.col("l_returnflag").alias("stream"), F.col("l_linestatus").alias("group"), F.col("l_orderkey").alias("entry_id")
    )
    acks = t.orders.select(
        F.explode(F.array(*[F.lit(x) for x in "ANR"])).alias("stream"), F.col("o_orderstatus").alias("group"),
        F.col("o_orderkey").alias("entry_id"),
    )
    return health.pending_depth(delivered, acks)


@add("q70_stream_length", "select event_type stream, count(*) length from events group by 1")
def lengths(t):
    return health.stream_length(t.events.select(F.col("event_type").alias("stream")))


@add(
    "q71_retain_last",
    """select stream, entry_id from (
            select event_type stream, event_id entry_id,
                   row_number() over (partition by event_type order by ts desc, event_id desc) rn from events)
       where rn <= 700""",
)
def retained(t):
    entries = t.events.select(
        F.col("event_type").alias("stream"), F.col("event_id").alias("entry_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    return health.retain_last(entries, 700).select("stream", "entry_id")


# -- latency and completeness: a conversation is one launch travelling through the stages ---
STAGES = ("hunter", "social", "chain", "risk", "narrator")
STAGED = """
    select msg_id, upstream, conv_id, turn,
           case least(turn, 4) when 0 then 'hunter' when 1 then 'social' when 2 then 'chain' when 3 then 'risk'
                else 'narrator' end agent,
           1704067200 + conv_id * 60 + turn * (5 + conv_id % 11) + turn * turn created_s
    from v_message"""


def staged(t):
    turn, conv = F.col("turn"), F.col("conv_id")
    agent = F.element_at(F.array(*map(F.lit, STAGES)), (F.least(turn, F.lit(4)) + 1).cast("int"))
    at = F.lit(1_704_067_200) + conv * 60 + turn * (F.lit(5) + conv % 11) + turn * turn
    return t.messages().select(
        "msg_id", "upstream_ids", "conv_id", "turn", agent.alias("agent"), F.timestamp_seconds(at).alias("created_at")
    )


@add(
    "q72_stage_latency",
    with_views(
        "v_message", staged=STAGED,
        body="""select c.agent stage, count(*) messages,
                round(quantile_cont(c.created_s - p.created_s, 0.5), 6) p50,
                round(quantile_cont(c.created_s - p.created_s, 0.95), 6) p95
                from staged c join staged p on p.msg_id = c.upstream group by 1""",
    ),
)
def stages(t):
    return health.stage_latency(health.stage_gaps(staged(t))).withColumns(
        {"p50": F.round("p50", 6), "p95": F.round("p95", 6)}
    )


def finals(t, messages):
    """The last message of a conversation, if it got as far as the last stage."""
    return messages.filter(F.col("turn") >= 4).groupBy("conv_id").agg(
        F.max("msg_id").alias("start_id")
    ).select("start_id")


@add(
    "q72_end_to_end_latency",
    with_views(
        "v_message", staged=STAGED,
        ends="select conv_id, max(created_s) - min(created_s) s from staged group by 1 having max(turn) >= 4",
        body="""select 'hunter to narrator' stage, count(*) messages, round(quantile_cont(s, 0.5), 6) p50,
                round(quantile_cont(s, 0.95), 6) p95 from ends""",
    ),
)
def end_to_end(t):
    messages = staged(t)
    closure = lineage.lineage(messages, finals(t, messages), max_depth=None)
    return health.stage_latency(health.end_to_end_latency(closure, messages)).withColumns(
        {"p50": F.round("p50", 6), "p95": F.round("p95", 6)}
    )


@add(
    "q73_lost_candidates",
    with_views(
        "v_message",
        body="""select min(msg_id) msg_id, 0 finals from v_message group by conv_id having max(turn) < 4""",
    ),
)
def lost(t):
    messages = staged(t)
    closure = lineage.lineage(messages, finals(t, messages), max_depth=None)
    return health.lost_candidates(messages.filter(F.col("turn") == 0), closure)


# -- dashboard -------------------------------------------------------------------------------
NOW = "2024-01-20 06:30:00"


@add(
    "q74_activity_24h",
    f"""with n as (
            select 23 - (epoch_us(timestamp '{NOW}') - epoch_us(ts)) // 3600000000 bucket, count(*) c from events
            where event_type <> 'error' and ts <= timestamp '{NOW}'
              and (epoch_us(timestamp '{NOW}') - epoch_us(ts)) // 3600000000 < 24 group by 1),
        f as (select r.b bucket, coalesce(c, 0) briefs from range(24) r(b) left join n on n.bucket = r.b)
        select bucket, briefs, briefs / (select greatest(1, max(briefs)) from f) * 100 height_pct,
               (select sum(briefs)::bigint from f) total from f""",
)
def activity(t):
    text = F.when(F.col("event_type") == "error", F.lit("not-a-date")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
    return dashboard.activity_24h(t.events.select(text.alias("created_at")), F.to_timestamp(F.lit(NOW)))


@add(
    "q75_model_usage",
    with_views(
        "v_brief",
        used="""select unnest(case when msg_id % 10 = 0 then [] else ['prov' || (msg_id % 3) || '/' || status, priority]
                end) model from v_brief""",
        body="""select model, count(*) uses,
                cast(floor(count(*) / (select count(*) from used) * 100 + 0.5) as bigint) percent from used group by 1""",
    ),
)
def usage(t):
    tags = F.array(
        F.concat(F.lit("prov"), (F.col("msg_id") % 3).cast("string"), F.lit("/"), F.col("status")), F.col("priority")
    )
    rows = t.briefs().select(
        F.when(F.col("msg_id") % 10 == 0, F.array().cast("array<string>")).otherwise(tags).alias("model_attribution")
    )
    return dashboard.model_usage(rows)


@add(
    "q76_parse_frames",
    with_views(
        "v_brief",
        body=f"""select lpad(msg_id::varchar, 26, '0') msg_id, {sql_address('msg_id')} token_address,
                case when score >= 85 then 'high' when score >= 65 then 'moderate' when score >= 40 then 'speculative'
                     else 'degen' end conviction_tier, priority || ',' || status models
                from v_brief where msg_id % 11 not in (0, 1, 2, 3)""",
    ),
)
def frames(t):
    number = F.col("msg_id")
    kind = number % 11
    payload = F.struct(
        F.lit("A").alias("token_name"), address(number).alias("token_address"), F.lit("t").alias("thesis"),
        F.when(kind == 2, F.lit("huge")).otherwise(brief.tier_of(F.col("score"))).alias("conviction_tier"),
        F.array().cast("array<string>").alias("caveats"), F.array().cast("array<string>").alias("sources"),
        F.array("priority", "status").alias("model_attribution"),
        F.lit("2026-04-22T06:50:00Z").alias("brief_generated_at"), F.lit("ok").alias("confidence_tier"),
    )
    frame = F.to_json(
        F.struct(
            F.lpad(number.cast("string"), 26, "0").alias("msg_id"), payload.alias("payload"),
            F.lit("a" * 64).alias("payload_hash"), F.array().cast("array<string>").alias("upstream_ids"),
            F.lit(None).cast("string").alias("model_used"),
            F.when(kind == 3, F.lit("today")).otherwise(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .alias("created_at"),
        ),
        {"ignoreNullFields": "false"},
    )
    shaped = F.when(kind == 0, F.lit("not-json")).when(kind == 1, F.lit('{"type":"hello"}')).otherwise(frame)
    return dashboard.parse_frames(t.briefs().select(shaped.alias("frame"))).select(
        "msg_id", "brief.token_address", "brief.conviction_tier", joined(F.col("brief.model_attribution")).alias("models")
    )


DAY_US = 86_400_000_000


@add(
    "q77_first_per_24h",
    f"""with recursive hits as (select event_id, user_id, epoch_us(ts) hit_us from events),
        step as (
            select user_id, hit_us, min(hit_us) over (partition by user_id order by hit_us
                   range between {DAY_US} following and unbounded following) nxt from hits),
        kept as (
            select user_id, min(hit_us) hit_us from hits group by 1
            union all
            select s.user_id, s.nxt from kept k join step s on s.user_id = k.user_id and s.hit_us = k.hit_us
            where s.nxt is not null)
        select event_id, h.user_id from hits h join kept k on k.user_id = h.user_id and k.hit_us = h.hit_us""",
)
def first_launches(t):
    rows = t.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return anchored.first_per_period(rows, ["user_id"], "ts", "event_id", 86_400).select(
        "event_id", "user_id"
    )
