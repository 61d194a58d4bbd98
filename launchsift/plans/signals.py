"""Social and chain signal queries, and the flagship that scores every token."""

from __future__ import annotations

from pyspark.sql import functions as F

from launchsift.functions.constants import BLANKS  # noqa: F401  (same blanks as the SQL)
from launchsift.operators import brief, chain, risk, social
from launchsift.plans.intake import SCORED, scored_responses
from launchsift.plans.registry import Section
from launchsift.plans.tables import (
    address,
    joined,
    sql_address,
    sql_round,
    sql_strip,
    with_views,
)

section = Section()
add = section.add

TAIL = """
    select source channel, doc_id pos, text from (
        select *, row_number() over (partition by source order by doc_id desc) rn from documents)
    where rn <= 40"""
WANTED = "select distinct lower(token_symbol) symbol from v_candidate"
HITS = """
    select symbol, channel, pos, text from wanted join tail on contains(lower(text), symbol)"""
SOCIAL_CTES = {"tail": TAIL, "wanted": WANTED, "hits": HITS}


def tokens(t):
    return t.candidates().select("token_address", F.col("token_symbol").alias("symbol"))


@add(
    "q16_count_mentions",
    with_views(
        "v_candidate", **SOCIAL_CTES,
        body="""select token_address, coalesce(n, 0) mentions from v_candidate
                left join (select symbol, count(*) n from hits group by 1) h
                on lower(token_symbol) = h.symbol""",
    ),
)
def mentions(t):
    return social.count_mentions(t.snippets(), tokens(t))


@add(
    "q17_sample_snippets",
    with_views(
        "v_candidate", **SOCIAL_CTES,
        body=f"""select symbol, rn sample_no, left({sql_strip('text')}, 280) snippet from (
                select *, row_number() over (partition by symbol order by channel, pos) rn from hits)
                where rn <= 5""",
    ),
)
def samples(t):
    return social.sample_snippets(t.snippets(), tokens(t))


@add(
    "q18_count_search_hits",
    f"""select query, count(*) filter ({sql_strip('body')} <> '') mentions,
              count(*) filter ({sql_strip('body')} <> '') = 0 degraded
       from (select source || '/' || lang query,
                    case when doc_id % 3 = 0 or lang = 'fr' then ' ' else text end body,
                    row_number() over (partition by source, lang order by doc_id) rn from documents)
       where rn <= 20 group by 1""",
)
def search_hits(t):
    blank = (F.col("doc_id") % 3 == 0) | (F.col("lang") == "fr")
    articles = t.documents.select(
        F.concat_ws("/", "source", "lang").alias("query"), F.col("doc_id").alias("pos"),
        F.when(blank, F.lit(" ")).otherwise(F.col("text")).alias("text"),
    )
    return social.count_search_hits(articles)


@add(
    "q18_source_status",
    """select source, count(*) filter (n_chars > 15000) = 0 degraded from documents group by 1""",
)
def status(t):
    return social.source_status(
        t.documents.select("source", (F.col("n_chars") > 15000).alias("success"))
    )


def social_inputs(t):
    """Search, channel and scorer results per token, derived from trades and events."""
    token = address(F.col("l_partkey")).alias("token_address")
    search = (
        t.lineitem.filter(F.col("l_returnflag") == "A").groupBy(token)
        .agg(F.count(F.lit(1)).alias("mentions"))
        .withColumn("degraded", F.col("mentions") < 5)
    )
    channels = (
        t.lineitem.filter(F.col("l_linestatus") == "O").groupBy(token)
        .agg(F.count(F.lit(1)).alias("mentions"))
        .withColumn("degraded", F.col("mentions") % 3 == 0)
    )
    newest = F.struct("ts", "event_id")
    row = F.struct("organic_score", "sentiment", "model_flags", "influencer_mentions", "model_used")
    scored = (
        scored_responses(t).groupBy(address(F.col("user_id")).alias("token_address"))
        .agg(F.max_by(row, newest).alias("r")).select("token_address", "r.*")
    )
    return search, channels, scored


SOCIAL_PARTS = {
    "search": """select l_partkey token_id, count(*) mentions, count(*) < 5 degraded from lineitem
                 where l_returnflag = 'A' group by 1""",
    "channels": """select l_partkey token_id, count(*) mentions, count(*) % 3 = 0 degraded from lineitem
                   where l_linestatus = 'O' group by 1""",
    "scored": SCORED,
    "latest": """select * from (select *, row_number() over (partition by user_id
                 order by ts desc, event_id desc) rn from scored) where rn = 1""",
    "social": """
        select c.token_address, c.token_id, coalesce(l.organic_score, 0) organic_score,
               coalesce(s.mentions, 0) + coalesce(h.mentions, 0) mentions_24h,
               coalesce(l.sentiment, 0.0) sentiment,
               concat_ws(',', case when coalesce(s.degraded, true) then 'x_scrape_blocked' end,
                    case when coalesce(h.degraded, true) then 'telegram_scrape_blocked' end,
                    case when l.user_id is null then 'social_llm_exhausted' end,
                    case when l.flags <> '' then l.flags end) red_flags,
               coalesce(l.who, '') influencer_mentions,
               case when coalesce(s.degraded, true) or coalesce(h.degraded, true) or l.user_id is null
                    then 'degraded' else 'ok' end data_quality,
               l.model_used
        from v_candidate c left join search s on s.token_id = c.token_id
        left join channels h on h.token_id = c.token_id
        left join latest l on l.user_id = c.token_id""",
}


@add(
    "q19_assemble_social",
    with_views("v_candidate", **SOCIAL_PARTS, body="select * exclude (token_id) from social"),
)
def social_score(t):
    out = social.assemble_social(t.candidates(), *social_inputs(t))
    return out.withColumn("red_flags", joined(F.col("red_flags"))).withColumn(
        "influencer_mentions", joined(F.col("influencer_mentions"))
    )


@add(
    "q20_coordinated_posting",
    f"""select sha256({sql_strip('lower(text)')}) text_hash, count(distinct source) handles, count(*) posts
        from documents group by 1 having count(distinct source) > 1""",
)
def coordinated(t):
    posts = t.documents.select(F.col("source").alias("handle"), "text")
    return social.coordinated_posting(posts, min_handles=1)


# -- chain -----------------------------------------------------------------------------
CONCENTRATION = f"""
    select token_id, token_address, case when bool_or(bad) then 0 else count(*) end holder_count,
           case when bool_or(bad) or sum(qty) <= 0 then 0.0
                else {sql_round('sum(qty) filter (rn <= 10) / sum(qty) * 100.0', 2)} end
                top10_concentration_pct
    from (select *, row_number() over (partition by token_id order by qty desc, holder_id) rn
          from v_holder) where rn <= 100 group by 1, 2"""


@add(
    "q21_holder_concentration",
    with_views("v_holder", c=CONCENTRATION, body="select * exclude (token_id) from c"),
)
def concentration(t):
    return chain.holder_concentration(t.holders())


PAGE, UNIT_S, WHALE = 20, 30 * 86400, 90000.0
TRANSFER_CTE = f"""
    select token_id, token_address,
           case when count(*) < 2 then 0.0 else {sql_round(
               f"count(*) / (greatest(1, arg_min(ts_s, rn) - arg_max(ts_s, rn)) / {float(UNIT_S)})", 2)}
           end velocity,
           count(*) filter (l_linenumber <> 7 and val > {WHALE}) whale_entries
    from v_transfer where rn <= {PAGE} group by 1, 2"""


@add(
    "q22_tx_velocity",
    with_views("v_transfer", m=TRANSFER_CTE, body="select token_address, velocity from m"),
)
def velocity(t):
    return chain.tx_velocity(t.transfers(), PAGE, UNIT_S)


@add(
    "q23_whale_entries",
    with_views("v_transfer", m=TRANSFER_CTE, body="select token_address, whale_entries from m"),
)
def whales(t):
    return chain.whale_entries(t.transfers(), WHALE, PAGE)


META = f"""
    select l_partkey token_id, {sql_address('l_partkey')} token_address, l_returnflag <> 'R' verified,
           case when l_linestatus = 'F' then '0x' || repeat('0', 40) else {sql_address('l_suppkey')} end
           creator_address
    from (select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber,
                 l_suppkey, l_returnflag, l_linestatus) rn from lineitem) where rn = 1"""


@add("q24_contract_meta", with_views(m=META, body="select * exclude (token_id) from m"))
def meta(t):
    return chain.contract_meta(t.contracts())


HISTORY = f"""
    select {sql_address('l_suppkey')} creator_address, least(count(*), 700) // 50 creator_previous_tokens
    from lineitem group by 1"""


@add("q25_creator_history", with_views(h=HISTORY, body="select * from h"))
def history(t):
    return chain.creator_history(t.creator_transactions(), page=700)


def chain_metrics(t):
    known = chain.with_creator_history(
        chain.contract_meta(t.contracts()), chain.creator_history(t.creator_transactions(), page=700)
    )
    failures = t.candidates().filter(F.col("p_size") <= 3).select(
        "token_address",
        F.when(F.col("p_size") == 1, F.lit("holders")).when(F.col("p_size") == 2, F.lit("meta"))
        .otherwise(F.lit("transfers")).alias("source"),
    )
    locked = t.candidates().select("token_address", (F.col("p_size") > 25).alias("lp_locked"))
    return chain.assemble_chain(
        t.candidates(),
        chain.holder_concentration(t.holders()),
        known,
        chain.transfer_metrics(t.transfers(), WHALE, PAGE, UNIT_S),
        failures,
        locked,
    )


CHAIN_PARTS = {
    "concentration": CONCENTRATION,
    "moves": TRANSFER_CTE,
    "meta": META,
    "history": HISTORY,
    "chain": """
        select c.token_id, c.token_address,
               case when p_size = 1 then 0 else coalesce(holder_count, 0) end holder_count,
               case when p_size = 1 then 0.0 else coalesce(top10_concentration_pct, 0.0) end
                    top10_concentration_pct,
               initial_liquidity_usd liquidity_usd,
               case when p_size = 3 then 0.0 else coalesce(velocity, 0.0) end
                    buy_sell_velocity_tx_per_min,
               case when p_size = 3 then 0 else coalesce(whale_entries, 0) end whale_entries,
               p_size <> 2 and coalesce(verified, false) contract_verified,
               p_size <> 2 and coalesce(verified, false) honeypot_check_passed,
               p_size > 25 lp_locked,
               case when p_size = 2 then 0 else coalesce(creator_previous_tokens, 0) end
                    creator_previous_tokens,
               case when p_size <= 3 then 'degraded' else 'ok' end data_quality
        from v_candidate c left join concentration h on h.token_id = c.token_id
        left join moves v on v.token_id = c.token_id
        left join meta m on m.token_id = c.token_id
        left join history p on p.creator_address = m.creator_address""",
}


@add(
    "q26_assemble_chain",
    with_views(
        "v_candidate", "v_holder", "v_transfer", **CHAIN_PARTS, body="select * exclude (token_id) from chain"
    ),
)
def assembled(t):
    return chain_metrics(t)


# -- flagship ----------------------------------------------------------------------------
def rule_inputs(social_rows, chain_rows):
    s = social_rows.withColumnRenamed("data_quality", "social_quality")
    c = chain_rows.withColumnRenamed("data_quality", "chain_quality")
    return s.join(c, "token_address")


RULE_CASES = """concat_ws(',',
    case when not contract_verified then 'unverified-contract' end,
    case when not honeypot_check_passed then 'honeypot-suspected' end,
    case when not lp_locked then 'lp-not-locked' end,
    case when top10_concentration_pct > 70 then 'high-top10-concentration' end,
    case when holder_count < 20 then 'low-holder-count' end,
    case when liquidity_usd < 1000 then 'liquidity-too-thin' end,
    case when buy_sell_velocity_tx_per_min > 300 then 'wash-trading-suspected' end,
    case when creator_previous_tokens > 10 then 'serial-launcher' end,
    case when organic_score < 15 then 'no-organic-buzz' end,
    case when sentiment < -0.4 then 'negative-sentiment' end,
    case when contains(',' || red_flags || ',', ',copy-paste-shilling,') then 'copy-paste-shilling' end,
    case when contains(',' || red_flags || ',', ',paid-promotion-disclosure,')
         then 'paid-promotion-disclosure' end,
    case when whale_entries > 5 then 'whale-sniping' end,
    case when social_quality = 'degraded' then 'social-data-degraded' end,
    case when chain_quality = 'degraded' then 'chain-data-degraded' end)"""
SCORE_CASES = """case when not honeypot_check_passed then 5 else greatest(0, 100
    - case when not contract_verified then 25 else 0 end
    - case when not lp_locked then 20 else 0 end
    - case when top10_concentration_pct > 70 then 20 else 0 end
    - case when holder_count < 20 then 10 else 0 end
    - case when liquidity_usd < 1000 then 15 else 0 end
    - case when buy_sell_velocity_tx_per_min > 300 then 15 else 0 end
    - case when creator_previous_tokens > 10 then 20 else 0 end
    - case when organic_score < 15 then 10 else 0 end
    - case when sentiment < -0.4 then 10 else 0 end
    - case when contains(',' || red_flags || ',', ',copy-paste-shilling,') then 15 else 0 end
    - case when contains(',' || red_flags || ',', ',paid-promotion-disclosure,') then 5 else 0 end
    - case when whale_entries > 5 then 10 else 0 end
    - case when social_quality = 'degraded' then 5 else 0 end
    - case when chain_quality = 'degraded' then 5 else 0 end) end"""
TIER_CASES = """case when score >= 85 then 'high' when score >= 65 then 'moderate'
    when score >= 40 then 'speculative' else 'degen' end"""


@add(
    "q00_score_tokens",
    with_views(
        "v_candidate", "v_holder", "v_transfer",
        **{k: v for k, v in SOCIAL_PARTS.items() if k != "social"}, **SOCIAL_CTES, **CHAIN_PARTS,
        counted="select symbol, count(*) n from hits group by 1",
        social=SOCIAL_PARTS["social"],
        pairs="""select s.token_address, organic_score, mentions_24h + coalesce(n, 0) mentions_24h, sentiment,
                 red_flags, s.data_quality social_quality, c.* exclude (token_id, token_address, data_quality),
                 c.data_quality chain_quality
                 from social s join chain c on c.token_address = s.token_address
                 join v_candidate v on v.token_address = s.token_address
                 left join counted on counted.symbol = lower(v.token_symbol)""",
        scores=f"select *, {RULE_CASES} flags, {SCORE_CASES} score from pairs",
        body=f"""select token_address, mentions_24h, holder_count, top10_concentration_pct,
                buy_sell_velocity_tx_per_min, whale_entries, flags, score, {TIER_CASES} conviction_tier
                from scores""",
    ),
)
def score_tokens(t):
    said = social.count_mentions(t.snippets(), tokens(t))
    scores = social.assemble_social(t.candidates(), *social_inputs(t)).join(said, "token_address", "left")
    scores = scores.withColumn("mentions_24h", F.col("mentions_24h") + F.coalesce("mentions", F.lit(0)))
    rows = risk.aggregate_score(risk.run_rules(rule_inputs(scores, chain_metrics(t))))
    return brief.conviction_tier(rows, "score").select(
        "token_address", "mentions_24h", "holder_count", "top10_concentration_pct",
        "buy_sell_velocity_tx_per_min", "whale_entries",
        joined(F.col("findings.tag")).alias("flags"),
        "score", "conviction_tier",
    )
