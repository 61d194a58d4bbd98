"""Pairing, rule, verdict, lineage and brief queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from launchsift.functions.constants import (
    TEXT_CAVEAT_NO_MODEL,
    TEXT_NO_MODEL,
    TEXT_NO_RATIONALE,
    TEXT_THESIS_NO_MODEL,
)
from launchsift.operators import brief, lineage, modeltext, risk
from launchsift.plans.intake import NOW
from launchsift.plans.registry import Section
from launchsift.plans.signals import RULE_CASES, SCORE_CASES
from launchsift.plans.tables import address, joined, or_none, sql_address, sql_strip, with_views

section = Section()
add = section.add

WAIT_S = 6 * 3600
WAIT_US = WAIT_S * 1_000_000


@add(
    "q27_pair_latest",
    with_views(
        "v_signal",
        latest="""select * from (select *, row_number() over (partition by token_id, side
                  order by ts desc, msg_id desc) rn from v_signal) where rn = 1""",
        body=f"""select coalesce(s.token_id, c.token_id) token_id, coalesce(s.msg_id, -1) social_id,
                coalesce(c.msg_id, -1) chain_id, case when c.msg_id is null then 'chain' when s.msg_id is null then 'social' end missing
                from (from latest where side = 'social') s full join (from latest where side = 'chain') c
                on s.token_id = c.token_id and abs(epoch_us(s.ts) - epoch_us(c.ts)) <= {WAIT_US}""",
    ),
)
def latest_pairs(t):
    newest = (
        t.signals().groupBy("token_id", "side")
        .agg(F.max_by(F.struct("msg_id", "ts"), F.struct("ts", "msg_id")).alias("r"))
        .select("token_id", "side", "r.*")
    )
    social = newest.filter(F.col("side") == "social")
    chain = newest.filter(F.col("side") == "chain")
    return or_none(risk.pair_latest(social, chain, WAIT_S, "token_id"), "social_id", "chain_id")


# The checking SQL walks every token signal by signal instead of using run parity.
WALK = f"""
    ordered as (select *, row_number() over (partition by token_id order by ts, msg_id) rn from v_signal),
    walk as (
        select token_id, rn, msg_id, side, ts, true waits, null::bigint partner from ordered where rn = 1
        union all
        select o.token_id, o.rn, o.msg_id, o.side, o.ts,
               not (w.waits and w.side <> o.side and epoch_us(o.ts) - epoch_us(w.ts) <= {WAIT_US}),
               case when w.waits and w.side <> o.side and epoch_us(o.ts) - epoch_us(w.ts) <= {WAIT_US}
                    then w.msg_id end
        from walk w join ordered o on o.token_id = w.token_id and o.rn = w.rn + 1),
    fates as (
        select w.token_id, w.msg_id, w.side, coalesce(w.partner, n.msg_id_if_partner) partner,
               case when w.partner is not null or n.partner = w.msg_id then 'paired'
                    when n.rn is null then 'waiting'
                    when epoch_us(n.ts) - epoch_us(w.ts) <= {WAIT_US} then 'replaced'
                    else 'expired' end outcome
        from walk w left join (select *, case when partner is not null then msg_id end msg_id_if_partner
                               from walk) n
             on n.token_id = w.token_id and n.rn = w.rn + 1),
    pairs as (
        select token_id, case when side = 'social' then msg_id end social_id,
               case when outcome = 'paired' then partner when side = 'chain' then msg_id end chain_id,
               case when outcome = 'expired' then case side when 'social' then 'chain' else 'social' end
               end missing
        from fates where outcome = 'expired' or (outcome = 'paired' and side = 'social'))"""


def walked(body):
    view = with_views("v_signal", body="").strip()
    return view.replace("with ", "with recursive ", 1) + ",\n" + WALK + "\n" + body


@add("q28_pair_outcomes", walked("select msg_id, outcome from fates"))
def outcomes(t):
    return risk.pair_outcomes(t.signals(), WAIT_S, "token_id").select("msg_id", "outcome")


def exact_pairs(t):
    return risk.pair_signals(t.signals(), WAIT_S, "token_id")


@add("q28_pair_signals", walked(
    "select token_id, coalesce(social_id, -1) social_id, coalesce(chain_id, -1) chain_id, missing from pairs"
))
def pairs(t):
    return or_none(exact_pairs(t), "social_id", "chain_id")


@add(
    "q29_partial_verdicts",
    walked(
        f"""select token_id, coalesce(social_id, chain_id) upstream_id,
            'missing-' || missing || '-input' red_flags,
            case missing when 'chain' then 'Chain' else 'Social' end
                || ' data did not arrive within {WAIT_S}s.' rationale,
            missing missing_inputs, 'low' confidence, true requires_human_review
            from pairs where missing is not null"""
    ),
)
def partials(t):
    return risk.partial_verdicts(exact_pairs(t), WAIT_S, "token_id").select(
        "token_id", "upstream_id", joined(F.col("red_flags")).alias("red_flags"), "rationale",
        joined(F.col("missing_inputs")).alias("missing_inputs"), "confidence", "requires_human_review",
    )


# -- rules ---------------------------------------------------------------------------------
ROW_ID = ["l_orderkey", "l_linenumber", "l_partkey"]


def rule_rows(t):
    c = F.col
    flags = (
        F.when(c("l_returnflag") == "A", F.array(F.lit("copy-paste-shilling")))
        .when(c("l_returnflag") == "R", F.array(F.lit("paid-promotion-disclosure"), F.lit("x")))
        .otherwise(F.array().cast("array<string>"))
    )
    quality = lambda bad: F.when(bad, F.lit("degraded")).otherwise(F.lit("ok"))
    return t.lineitem.select(
        *ROW_ID,
        (c("l_linenumber") * 7 + c("l_partkey") % 60).cast("int").alias("organic_score"),
        (c("l_discount") * 20 - 1).alias("sentiment"),
        flags.alias("red_flags"),
        quality(c("l_linestatus") == "F").alias("social_quality"),
        c("l_quantity").cast("int").alias("holder_count"),
        (c("l_discount") * 1000).alias("top10_concentration_pct"),
        (c("l_extendedprice") / 20).alias("liquidity_usd"),
        (c("l_tax") * 5000).alias("buy_sell_velocity_tx_per_min"),
        c("l_linenumber").alias("whale_entries"),
        (c("l_suppkey") % 4 != 0).alias("contract_verified"),
        (c("l_suppkey") % 5 != 0).alias("honeypot_check_passed"),
        (c("l_partkey") % 2 == 0).alias("lp_locked"),
        (c("l_orderkey") % 15).cast("int").alias("creator_previous_tokens"),
        quality(c("l_partkey") % 10 == 0).alias("chain_quality"),
    )


RULE_ROWS = """
    select l_orderkey, l_linenumber, l_partkey, cast(l_linenumber * 7 + l_partkey % 60 as int) organic_score,
           l_discount * 20 - 1 sentiment,
           case l_returnflag when 'A' then 'copy-paste-shilling' when 'R' then 'paid-promotion-disclosure,x'
                else '' end red_flags,
           case when l_linestatus = 'F' then 'degraded' else 'ok' end social_quality,
           cast(l_quantity as int) holder_count, l_discount * 1000 top10_concentration_pct,
           l_extendedprice / 20 liquidity_usd, l_tax * 5000 buy_sell_velocity_tx_per_min,
           l_linenumber whale_entries, l_suppkey % 4 <> 0 contract_verified,
           l_suppkey % 5 <> 0 honeypot_check_passed, l_partkey % 2 = 0 lp_locked,
           cast(l_orderkey % 15 as int) creator_previous_tokens,
           case when l_partkey % 10 = 0 then 'degraded' else 'ok' end chain_quality
    from lineitem"""
REASONS = """concat_ws('|',
    case when not contract_verified then 'Contract source not verified on BscScan.' end,
    case when not honeypot_check_passed then 'Honeypot check did not pass.' end,
    case when not lp_locked then 'Liquidity pool tokens are not locked.' end,
    case when top10_concentration_pct > 70 then
        'Top 10 wallets hold ' || printf('%.1f', top10_concentration_pct) || '% of supply.' end,
    case when holder_count < 20 then 'Only ' || holder_count || ' holders.' end,
    case when liquidity_usd < 1000 then 'Liquidity only $' || format('{:,.0f}', liquidity_usd) || '.' end,
    case when buy_sell_velocity_tx_per_min > 300 then
        'Velocity ' || printf('%.0f', buy_sell_velocity_tx_per_min) || ' tx/min suggests wash trading.' end,
    case when creator_previous_tokens > 10 then
        'Creator has launched ' || creator_previous_tokens || ' tokens previously.' end,
    case when organic_score < 15 then 'organic_score is only ' || organic_score || '.' end,
    case when sentiment < -0.4 then 'Sentiment is ' || printf('%.2f', sentiment) || '.' end,
    case when red_flags = 'copy-paste-shilling' then 'Social agent flagged copy-paste shilling.' end,
    case when red_flags like 'paid%' then 'Social agent flagged paid promotion.' end,
    case when whale_entries > 5 then whale_entries || ' whale entries detected early — possible sniping.' end,
    case when social_quality = 'degraded'
         then 'Social data could not be fully gathered — confidence reduced.' end,
    case when chain_quality = 'degraded'
         then 'Chain data could not be fully gathered — confidence reduced.' end)"""
KEYS_SQL = "l_orderkey, l_linenumber, l_partkey"


@add(
    "q30_run_rules",
    with_views(r=RULE_ROWS, body=f"select {KEYS_SQL}, {RULE_CASES} tags, {REASONS} reasons from r"),
)
def rules(t):
    found = risk.run_rules(rule_rows(t))
    return found.select(
        *ROW_ID,
        joined(F.col("findings.tag")).alias("tags"),
        F.array_join(F.col("findings.reason"), "|").alias("reasons"),
    )


@add("q31_aggregate_score", with_views(r=RULE_ROWS, body=f"select {KEYS_SQL}, {SCORE_CASES} score from r"))
def scores(t):
    return risk.aggregate_score(risk.run_rules(rule_rows(t))).select(*ROW_ID, "score")


@add(
    "q32_build_verdict",
    with_views(
        r=RULE_ROWS,
        body=f"""select {sql_address('l_partkey')} token_address, 's' || l_orderkey || ',c' || l_linenumber
               upstream_ids, case when l_linenumber > 1 then {SCORE_CASES} else -1 end score_0_100,
               {RULE_CASES} red_flags,
               case when l_linenumber > 1 then 'because ' || l_orderkey else '{TEXT_NO_MODEL}' end rationale,
               case when l_linenumber > 1 then 'high' end confidence,
               l_linenumber = 1 requires_human_review from r""",
    ),
)
def verdicts(t):
    answered = F.col("l_linenumber") > 1
    rows = risk.aggregate_score(risk.run_rules(rule_rows(t))).withColumns(
        {
            "token_address": address(F.col("l_partkey")),
            "social_id": F.concat(F.lit("s"), F.col("l_orderkey").cast("string")),
            "chain_id": F.concat(F.lit("c"), F.col("l_linenumber").cast("string")),
            "rationale": F.concat(F.lit("because "), F.col("l_orderkey").cast("string")),
            "confidence": F.lit("high"),
            "model_used": F.when(answered, F.lit("a/b")),
        }
    )
    return or_none(risk.build_verdict(rows), "score_0_100").select(
        "token_address", joined(F.col("upstream_ids")).alias("upstream_ids"), "score_0_100",
        joined(F.col("red_flags")).alias("red_flags"), "rationale", "confidence", "requires_human_review",
    )


SAID_JSON = """to_json({'rationale': case when turn = 2 then '  ' else text end,
    'confidence': case turn % 3 when 0 then 'HIGH' when 1 then 'low' else 'weird' end})::varchar"""


@add(
    "q33_parse_rationales",
    with_views(
        "v_message",
        said=f"select *, {SAID_JSON} j from v_message",
        body=f"""select msg_id,
                case when turn % 7 = 6 then '{TEXT_NO_MODEL}' when turn % 4 = 3 then left('not json ' || j, 400)
                     when turn = 2 then '{TEXT_NO_RATIONALE}' else {sql_strip('text')} end rationale,
                case when turn % 7 = 6 then null when turn % 4 = 3 then 'low'
                     when turn % 3 = 0 then 'high' when turn % 3 = 1 then 'low' else 'medium' end confidence,
                case when turn % 7 <> 6 then 'prov/name' end model_used from said""",
    ),
)
def rationales(t):
    turn = F.col("turn")
    body = F.to_json(
        F.struct(
            F.when(turn == 2, F.lit("  ")).otherwise(F.col("text")).alias("rationale"),
            F.when(turn % 3 == 0, F.lit("HIGH")).when(turn % 3 == 1, F.lit("low"))
            .otherwise(F.lit("weird")).alias("confidence"),
        )
    )
    content = (
        F.when(turn % 7 == 6, F.lit(None))
        .when(turn % 4 == 3, F.concat(F.lit("not json "), body))
        .otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    )
    rows = t.messages().select(
        "msg_id", content.alias("content"), F.lit("prov").alias("provider"), F.lit("vendor/name").alias("model")
    )
    return modeltext.parse_rationales(rows).select("msg_id", "rationale", "confidence", "model_used")


# -- routing ---------------------------------------------------------------------------------
def stored_verdicts(t):
    return t.briefs().select(
        "msg_id", address(F.col("msg_id")).alias("token_address"),
        F.when(F.col("status") != "P", F.col("score")).alias("score_0_100"),
        (F.col("priority") == "1-URGENT").alias("requires_human_review"),
        F.when(F.col("priority") == "5-LOW", F.array().cast("array<string>"))
        .otherwise(F.array("priority", "status")).alias("red_flags"),
    )


@add(
    "q34_route_verdicts",
    with_views(
        "v_brief",
        body="""select msg_id, case when status = 'P' or priority = '1-URGENT' then 'review' else 'brief' end
                route from v_brief""",
    ),
)
def routed(t):
    to_brief, to_review = brief.route_verdicts(stored_verdicts(t))
    return to_brief.select("msg_id", F.lit("brief").alias("route")).unionByName(
        to_review.select("msg_id", F.lit("review").alias("route"))
    )


@add(
    "q34_human_review",
    with_views(
        "v_brief",
        body=f"""select {sql_address('msg_id')} token_address,
                case when priority = '5-LOW' then 'requires-human-review' else priority || '; ' || status end
                reason, msg_id risk_verdict_msg_id, '{NOW}' raised_at
                from v_brief where status = 'P' or priority = '1-URGENT'""",
    ),
)
def reviews(t):
    return brief.human_review(brief.route_verdicts(stored_verdicts(t))[1], NOW)


@add(
    "q37_conviction_tier",
    with_views(
        "v_brief",
        body="""select msg_id, score, case when score >= 85 then 'high' when score >= 65 then 'moderate'
                when score >= 40 then 'speculative' else 'degen' end conviction_tier from v_brief""",
    ),
)
def tiers(t):
    return brief.conviction_tier(t.briefs(), "score").select("msg_id", "score", "conviction_tier")


# -- lineage -----------------------------------------------------------------------------------
def stored_messages(t):
    turn, conv = F.col("turn"), F.col("conv_id")
    name = F.when((turn == 0) & (conv % 3 != 0), F.concat(F.lit("tok"), conv.cast("string"))).when(
        turn == 1, F.lit("")
    )
    return t.messages().select(
        "msg_id", "upstream_ids", "agent", "conv_id", "turn", "text",
        F.to_json(F.struct(name.alias("token_name"))).alias("payload"),
        F.when(F.col("role") == "assistant", F.concat(F.lit("prov"), (turn % 3).cast("string"), F.lit("/m"))).alias(
            "model_used"
        ),
    )


def last_messages(messages):
    return messages.groupBy("conv_id").agg(F.max("msg_id").alias("start_id")).select("start_id")


CLOSURE = """
    closure as (
        select max(msg_id) start_id, max(msg_id) msg_id, 0 depth from v_message group by conv_id
        union all
        select c.start_id, m.upstream, c.depth + 1 from closure c join v_message m on m.msg_id = c.msg_id
        where m.upstream is not null)"""


def closed(body, **ctes):
    view = with_views("v_message", body="").strip()
    extra = "".join(f",\n{k} as ({v})" for k, v in ctes.items())
    return view.replace("with ", "with recursive ", 1) + ",\n" + CLOSURE + extra + "\n" + body


def closure_of(messages):
    return lineage.lineage(messages, last_messages(messages), max_depth=None)


@add("q35_lineage", closed("select start_id, msg_id, depth from closure"))
def closure(t):
    return closure_of(stored_messages(t))


@add(
    "q35_lineage_report",
    closed(
        "select start_id, c.msg_id, depth, agent from closure c join v_message m on m.msg_id = c.msg_id "
        "where depth <= 4"
    ),
)
def report(t):
    messages = stored_messages(t)
    return lineage.lineage_report(messages, last_messages(messages)).select("start_id", "msg_id", "depth", "agent")


NAMES = """select start_id, coalesce(max(case when turn = 0 and conv_id % 3 <> 0 then 'tok' || conv_id end),
           'Unknown') token_name from closure c join v_message m on m.msg_id = c.msg_id group by 1"""
MODELS = """select start_id, coalesce(string_agg(distinct tag, ',' order by tag), '') model_attribution from (
           select start_id, case when role = 'assistant' then 'prov' || (turn % 3) || '/m' end tag
           from closure c join v_message m on m.msg_id = c.msg_id) group by 1"""


@add("q36_token_name", closed("select * from names", names=NAMES))
def names(t):
    messages = stored_messages(t)
    return lineage.token_names(closure_of(messages), messages)


@add("q38_model_attribution", closed("select * from models", models=MODELS))
def models(t):
    messages = stored_messages(t)
    return lineage.model_attribution(closure_of(messages), messages).withColumn(
        "model_attribution", joined(F.col("model_attribution"))
    )


@add(
    "q39_build_brief",
    closed(
        f"""select m.msg_id verdict_id, token_name, {sql_address('conv_id')} token_address,
            case when conv_id % 4 = 3 then coalesce(nullif(left(text, 400), ''), '{TEXT_THESIS_NO_MODEL}')
                 when conv_id % 4 = 2 then left(text, 400)
                 else left({sql_strip("'Thesis: ' || text")}, 2000) end thesis,
            case when score >= 85 then 'high' when score >= 65 then 'moderate' when score >= 40 then 'speculative'
                 else 'degen' end conviction_tier,
            case when conv_id % 4 = 3 then '{TEXT_CAVEAT_NO_MODEL}' when conv_id % 4 = 2 then '' else agent end caveats,
            list_aggregate(list_sort(list_distinct(list_filter(string_split(model_attribution, ',')
                || case when conv_id % 4 = 3 then [] else ['own/n'] end, lambda x: x <> ''))), 'string_agg', ',')
                model_attribution,
            case when conv_id % 4 = 3 then 'degraded' else 'ok' end confidence_tier
            from (select *, conv_id * 7 % 101 score from v_message) m join names n on n.start_id = m.msg_id
            join models d on d.start_id = m.msg_id""",
        names=NAMES,
        models=MODELS,
    ),
)
def briefs(t):
    messages = stored_messages(t)
    closed_set = closure_of(messages)
    conv = F.col("conv_id")
    body = F.to_json(
        F.struct(F.concat(F.lit("Thesis: "), F.col("text")).alias("thesis"), F.array("agent").alias("caveats"))
    )
    content = (
        F.when(conv % 4 == 3, F.lit(None)).when(conv % 4 == 2, F.lit("[]"))
        .otherwise(F.concat(F.lit("```\n"), body, F.lit("\n```")))
    )
    narrated = modeltext.parse_responses(
        messages.join(last_messages(messages), F.col("msg_id") == F.col("start_id")).select(
            "start_id", "msg_id", "conv_id", address(conv).alias("token_address"),
            (conv * 7 % 101).cast("int").alias("score_0_100"), F.col("text").alias("rationale"),
            content.alias("content"), F.when(conv % 4 != 3, F.lit("own/n")).alias("model_used"),
        )
    )
    own = narrated.select("start_id", "model_used")
    rows = narrated.join(lineage.token_names(closed_set, messages), "start_id").join(
        lineage.model_attribution(closed_set, messages, own), "start_id"
    )
    return brief.build_brief(rows, NOW).select(
        "verdict_id", "token_name", "token_address", "thesis", "conviction_tier",
        joined(F.col("caveats")).alias("caveats"),
        F.nullif(joined(F.col("model_attribution")), F.lit("")).alias("model_attribution"), "confidence_tier",
    )
