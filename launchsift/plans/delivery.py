"""Subscription and delivery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from launchsift.functions.constants import TOKEN_URL
from launchsift.operators import brief, delivery
from launchsift.plans.registry import Section
from launchsift.plans.tables import address, sql_address, with_views

section = Section()
add = section.add

# -- change log: one change per order, seen as the customer's chat ------------------------
CHANGES = """
    select o_custkey chat_id, o_orderdate ts, o_orderkey seq,
           case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'subscribe'
                when o_orderpriority = '3-MEDIUM' then 'unsubscribe' else 'set' end action,
           case o_orderstatus when 'F' then 'degen' when 'O' then 'moderate' else 'high' end threshold
    from orders"""


def changes(t):
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    return t.orders.select(
        F.col("o_custkey").alias("chat_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), F.lit("subscribe"))
        .when(priority == "3-MEDIUM", F.lit("unsubscribe")).otherwise(F.lit("set")).alias("action"),
        F.when(status == "F", F.lit("degen")).when(status == "O", F.lit("moderate"))
        .otherwise(F.lit("high")).alias("threshold"),
    )


@add(
    "q60_current_subscriptions",
    f"""with recursive changes as ({CHANGES}),
        ordered as (select *, row_number() over (partition by chat_id order by ts, seq) rn from changes),
        replay as (
            select chat_id, 0::bigint rn, null::varchar threshold, null::boolean active from changes group by 1
            union all
            select r.chat_id, o.rn,
                   case when o.action = 'subscribe' or (o.action = 'set' and r.active is not null)
                        then o.threshold else r.threshold end,
                   case when o.action = 'subscribe' then true
                        when o.action = 'unsubscribe' and r.active is not null then false else r.active end
            from replay r join ordered o on o.chat_id = r.chat_id and o.rn = r.rn + 1)
        select chat_id, threshold, active from replay
        where active is not null and rn = (select max(rn) from ordered o where o.chat_id = replay.chat_id)""",
)
def subscriptions(t):
    return delivery.current_subscriptions(changes(t))


# -- matching -----------------------------------------------------------------------------
RANK = "case lower({}) when 'speculative' then 1 when 'moderate' then 2 when 'high' then 3 else 0 end"
TIERED = """select *, case when score >= 85 then 'HIGH' when score >= 65 then 'Moderate'
            when score >= 40 then 'speculative' when score >= 20 then 'degen' else 'other' end conviction_tier
            from v_brief"""


def tiered(t):
    score = F.col("score")
    return t.briefs().withColumn(
        "conviction_tier",
        F.when(score >= 85, F.lit("HIGH")).when(score >= 65, F.lit("Moderate"))
        .when(score >= 40, F.lit("speculative")).when(score >= 20, F.lit("degen")).otherwise(F.lit("other")),
    )


@add(
    "q61_reach_of_briefs",
    with_views(
        "v_brief", "v_sub", tiered=TIERED,
        ranks=f"select distinct {RANK.format('conviction_tier')} r from tiered",
        reach=f"""select r, (select count(*) from v_sub where active and r >= {RANK.format('threshold')}) n from ranks""",
        body=f"select msg_id, n recipients from tiered join reach on r = {RANK.format('conviction_tier')}",
    ),
)
def reach(t):
    return delivery.reach_of_briefs(tiered(t), t.subscribers())


@add(
    "q61_deliveries_by_tier",
    with_views(
        "v_brief", "v_sub", tiered=TIERED,
        ranked=f"select {RANK.format('conviction_tier')} tier from tiered",
        chats=f"select lower(threshold) threshold, {RANK.format('threshold')} lowest from v_sub where active",
        body="""select tier, threshold, count(*) deliveries from ranked join chats on tier >= lowest
                group by tier, threshold""",
    ),
)
def by_tier(t):
    return delivery.deliveries_by_tier(tiered(t), t.subscribers())


@add(
    "q61_deliveries_by_chat",
    with_views(
        "v_brief", "v_sub", tiered=TIERED,
        counted=f"select {RANK.format('conviction_tier')} tier, count(*) n from tiered group by 1",
        body=f"""select chat_id, sum(n)::bigint deliveries from v_sub join counted on tier >= {RANK.format('threshold')}
                where active group by chat_id""",
    ),
)
def by_chat(t):
    return delivery.deliveries_by_chat(tiered(t), t.subscribers())


@add(
    "q61_match_by_chat",
    with_views(
        "v_brief", "v_sub", tiered=TIERED,
        body=f"""select msg_id, chat_id from tiered join v_sub on customer = chat_id
                where active and {RANK.format('conviction_tier')} >= {RANK.format('threshold')}""",
    ),
)
def own_matches(t):
    return addressed(t)


def addressed(t):
    """Deliveries of briefs addressed to one chat each, as far as its threshold allows."""
    meets = delivery.tier_rank(F.col("conviction_tier")) >= delivery.tier_rank(F.col("threshold"))
    return (
        tiered(t).join(t.subscribers().filter("active"), F.col("customer") == F.col("chat_id"))
        .filter(meets).select("msg_id", "chat_id")
    )


MEMORY_S = 200 * 86400
NOW = "2001-08-02 00:00:00"


@add(
    "q62_undelivered",
    with_views(
        "v_brief", "v_sub", tiered=TIERED,
        matches=f"""select msg_id, chat_id from tiered join v_sub on customer = chat_id
                    where active and {RANK.format('conviction_tier')} >= {RANK.format('threshold')}""",
        sent="select customer chat_id, msg_id, created_at sent_at from v_brief where status <> 'P'",
        gaps=f"""select *, coalesce(lead(sent_at) over (partition by chat_id order by sent_at, msg_id),
                 timestamp '{NOW}') nxt from sent""",
        alive=f"""select chat_id, msg_id from gaps g where not exists (
                 select 1 from gaps h where h.chat_id = g.chat_id and (h.sent_at, h.msg_id) >= (g.sent_at, g.msg_id)
                 and epoch_us(h.nxt) - epoch_us(h.sent_at) >= {MEMORY_S * 1_000_000})""",
        body="""select msg_id, chat_id from matches m where not exists (
                select 1 from alive a where a.chat_id = m.chat_id and a.msg_id = m.msg_id)""",
    ),
)
def undelivered(t):
    sent = t.briefs().filter(F.col("status") != "P").select(
        F.col("customer").alias("chat_id"), "msg_id", F.col("created_at").alias("sent_at")
    )
    now = F.to_timestamp(F.lit(NOW))
    return delivery.undelivered(addressed(t), sent, now, MEMORY_S, bucket_s=365 * 86400).select("msg_id", "chat_id")


@add(
    "q63_format_brief",
    f"""select doc_id msg_id, '*' || source || '* — conviction: *high*' || chr(10) || chr(10) || left(text, 900)
              || case when lang = 'de' then '' else chr(10) || chr(10) || '*Caveats*:' || chr(10)
                 || '• ' || lang || chr(10) || '• b' || chr(10) || '• c' || chr(10) || '• d' || chr(10) || '• e' end
              || chr(10) || chr(10) || '[BscScan]({TOKEN_URL}' || {sql_address('doc_id')} || ') · `' || doc_id || '`' body
       from documents""",
)
def bodies(t):
    caveats = F.when(
        F.col("lang") != "de", F.array(F.col("lang"), *[F.lit(x) for x in "bcdef"])
    )
    rows = t.documents.select(
        F.col("doc_id").alias("msg_id"), F.col("source").alias("token_name"), F.lit("high").alias("conviction_tier"),
        F.col("text").alias("thesis"), caveats.alias("caveats"), address(F.col("doc_id")).alias("token_address"),
    )
    return delivery.format_brief(rows)
