"""Model-spend and reliability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from launchsift.operators import anchored, spend
from launchsift.plans.registry import Section
from launchsift.plans.tables import epoch, with_views

section = Section()
add = section.add

PRICES = {"model0": (15.0, 75.0), "model1": (3.0, 15.0), "model2": (0.15, 0.6), "model3": (0.075, 0.3)}
PRICE_SQL = "(values " + ", ".join(f"('{m}', {i}::double, {o}::double)" for m, (i, o) in PRICES.items()) + ") p(pm, pi, po)"
COSTED = f"""
    select c.*, cast(input_tokens / 1000.0::double * coalesce(pi, 0) + output_tokens / 1000.0::double * coalesce(po, 0)
                     as decimal(10, 6)) cost_usd
    from v_call c left join {PRICE_SQL} on c.model = pm"""
COST = {"costed": COSTED}


def costed(t):
    return spend.call_cost(t.calls(), PRICES)


def money(column):
    return F.col(column).cast("double").alias(column)


@add("q50_call_cost", with_views("v_call", **COST, body="select call_id, cost_usd::double cost_usd from costed"))
def cost(t):
    return costed(t).select("call_id", money("cost_usd"))


@add(
    "q51_cost_by_provider",
    with_views("v_call", **COST, body="select provider, sum(cost_usd)::double total from costed group by 1"),
)
def by_provider(t):
    return spend.cost_by_provider(costed(t)).select("provider", money("total"))


NOON = "2024-01-15 12:00:00"


@add(
    "q52_failures",
    with_views(
        "v_call",
        body=f"""select provider, error_class, count(*) failures from v_call
                where created_at > timestamp '{NOON}' and not success group by 1, 2""",
    ),
)
def failed(t):
    return spend.failures(t.calls(), F.to_timestamp(F.lit(NOON)))


@add(
    "q53_daily_spend",
    with_views(
        "v_call", **COST,
        body=f"""select provider, model, count(*) calls, round(sum(cost_usd), 4)::double usd from costed
                where created_at > timestamp '{NOON}' - interval 24 hours group by 1, 2""",
    ),
)
def day(t):
    return spend.daily_spend(costed(t), F.to_timestamp(F.lit(NOON))).withColumn("usd", F.col("usd").cast("double"))


@add(
    "q54_hourly_usage",
    with_views(
        "v_call", **COST,
        body="""select epoch_us(date_trunc('hour', created_at)) hour_us, agent, provider, model, count(*) calls,
                count(*) filter (not success) errors, sum(cost_usd)::double usd from costed group by 1, 2, 3, 4""",
    ),
)
def hourly(t):
    return spend.hourly_usage(costed(t)).select(
        epoch(F.col("hour")).alias("hour_us"), "agent", "provider", "model", "calls", "errors", money("usd")
    )


BACK_S = 6 * 3600


@add(
    "q55_error_rate",
    with_views(
        "v_call",
        body=f"""select call_id, count(*) over w recent_calls, count(*) filter (not success) over w recent_failures
                from v_call window w as (partition by agent order by epoch_us(created_at)
                range between {BACK_S * 1_000_000} preceding and current row)""",
    ),
)
def errors(t):
    return spend.error_rate(t.calls(), BACK_S).select("call_id", "recent_calls", "recent_failures")


CAPS = {"prov0": 300.0, "prov1": 50.0, "prov2": 200.0, "prov3": 10.0}
CAP_SQL = "(values " + ", ".join(f"('{p}', {c})" for p, c in CAPS.items()) + ") k(kp, cap)"


@add(
    "q56_cap_breach",
    with_views(
        "v_call", **COST,
        running=f"""select *, sum(cost_usd) over (partition by provider, created_at::date
                    order by created_at, call_id rows unbounded preceding) spent
                    from costed join {CAP_SQL} on provider = kp""",
        body="""select provider, strftime(created_at, '%Y-%m-%d') "day", call_id, spent::double spent_usd,
                cap::double cap_usd
                from (select *, row_number() over (partition by provider, created_at::date
                      order by created_at, call_id) rn from running where spent > cap) where rn = 1""",
    ),
)
def breaches(t):
    return spend.cap_breach(costed(t), CAPS).select(
        "provider", F.date_format("day", "yyyy-MM-dd").alias("day"), "call_id", money("spent_usd"), money("cap_usd")
    )


QUOTA, PERIOD_S = 8, 2 * 86400
PERIOD_US = PERIOD_S * 1_000_000


@add(
    "q57_quota_overflow",
    f"""with recursive hits as (
            select event_id call_id, 'agent' || (user_id % 5) agent, 'prov' || (user_id % 4) provider,
                   epoch_us(ts) hit_us from events),
        step as (
            select agent, provider, hit_us, min(hit_us) over (partition by agent, provider order by hit_us
                   range between {PERIOD_US} following and unbounded following) nxt from hits),
        anchors as (
            select agent, provider, min(hit_us) a from hits group by all
            union all
            select s.agent, s.provider, s.nxt from anchors x join step s
            on s.agent = x.agent and s.provider = x.provider and s.hit_us = x.a where s.nxt is not null),
        placed as (
            select h.*, max(x.a) over (partition by h.agent, h.provider order by h.hit_us) a
            from hits h left join anchors x on x.agent = h.agent and x.provider = h.provider and x.a = h.hit_us)
        select call_id, a window_start, row_number() over (partition by agent, provider, a order by hit_us, call_id) hit_no,
               row_number() over (partition by agent, provider, a order by hit_us, call_id) > {QUOTA} refused
        from placed""",
)
def quota(t):
    return anchored.quota_overflow(
        t.calls(), ["agent", "provider"], "created_at", "call_id", QUOTA, PERIOD_S
    ).select("call_id", "window_start", "hit_no", "refused")


@add(
    "q57_quota_by_clock",
    with_views(
        "v_call",
        body="""select agent, provider, epoch_us(date_trunc('hour', created_at)) window_start, count(*) hits,
                greatest(count(*) - 2, 0) refused from v_call group by 1, 2, 3""",
    ),
)
def clock_quota(t):
    return anchored.quota_by_clock(t.calls(), ["agent", "provider"], "created_at", 2, "1 hour")


COOL_S = 3 * 3600


@add(
    "q58_circuit_intervals",
    with_views(
        "v_call",
        marked="""select *, sum(success::int) over (partition by provider order by created_at, call_id) island
                  from v_call""",
        failed="""select *, row_number() over (partition by provider, island order by created_at, call_id) n
                  from marked where not success""",
        body=f"""select f.provider, epoch_us(f.created_at) opened_at,
                least(epoch_us(f.created_at) + {COOL_S * 1_000_000},
                      (select min(epoch_us(m.created_at)) from marked m where m.provider = f.provider
                       and m.success and m.island = f.island + 1)) closed_at
                from failed f where n = 3""",
    ),
)
def circuits(t):
    return spend.circuit_intervals(t.calls(), cooldown_s=COOL_S)


CHAINS = {"a/x": ["b/y", "c/z"], "b/y": ["a/x"], "c/z": ["d/w", "a/x"]}
NAMES = ["a/x", "b/y", "c/z", "d/w"]


def requests(t):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("user_id") % 4 + 1).cast("int"))
    return t.events.select(F.col("event_id").alias("request_id"), name.alias("primary_model"))


def attempts(t):
    """One gateway attempt per request, and direct ones derived from the lines of its order."""
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("l_partkey") % 4 + 1).cast("int"))
    direct = t.lineitem.select(
        F.col("l_orderkey").alias("request_id"), F.substring_index(name, "/", 1).alias("provider"),
        name.alias("model"), (F.col("l_returnflag") == "A").alias("success"),
    )
    gateway = requests(t).join(
        t.events.select(F.col("event_id").alias("request_id"), (F.col("event_type") == "click").alias("success")),
        "request_id",
    ).select("request_id", F.lit("gate").alias("provider"), F.col("primary_model").alias("model"), "success")
    return direct.unionByName(gateway)


@add(
    "q59_served_by",
    f"""with requests as (
            select event_id request_id, ([{', '.join(repr(n) for n in NAMES)}])[user_id % 4 + 1] primary_model,
                   event_type = 'click' via_gateway from events),
        direct as (
            select l_orderkey request_id, ([{', '.join(repr(n) for n in NAMES)}])[l_partkey % 4 + 1] model
            from lineitem where l_returnflag = 'A'),
        chains as (
            {' union all '.join(
                f"select '{p}' primary_model, '{m}' model, {i + 1} place"
                for p in NAMES for i, m in enumerate([p, *CHAINS.get(p, [])]))}),
        options as (
            select request_id, 0 place, 'gate' provider, primary_model model from requests where via_gateway
            union all
            select r.request_id, place, split_part(c.model, '/', 1), c.model
            from requests r join chains c on c.primary_model = r.primary_model
            join direct d on d.request_id = r.request_id and d.model = c.model
            where split_part(c.model, '/', 1) <> 'd'),
        best as (select request_id, arg_min(provider, place) provider, arg_min(model, place) model
                 from options group by 1)
        select r.request_id, r.primary_model, b.provider, b.model, b.request_id is null exhausted
        from requests r left join best b on b.request_id = r.request_id""",
)
def served(t):
    return spend.served_by(requests(t), attempts(t), CHAINS, gateway="gate", providers=("a", "b", "c"))
