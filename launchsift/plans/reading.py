"""Queries over texts as readers meet them: feed pages, envelope lines, explorer answers, audit rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from launchsift.plans.intake import RAW_ENVELOPES, raw_envelopes
from launchsift.plans.registry import Section
from launchsift.plans.spend import COST, costed
from launchsift.plans.tables import address, sql_address, with_views
from launchsift.sources import readers, sinks

section = Section()
add = section.add


def listed(t, entry):
    """(l_orderkey, entries): the JSON texts of an order's lines, in order."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", entry.alias("entry"))))
    return t.lineitem.groupBy("l_orderkey").agg(
        F.array_join(F.transform(lines, lambda x: x["entry"]), ", ").alias("entries")
    )


@add(
    "q78_feed_pages",
    f"""select l_orderkey page, l_linenumber - 1 pos, {sql_address('l_partkey')} address
        from (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey
              order by l_linenumber, '{{"address": "' || {sql_address('l_partkey')} || '"}}') l_linenumber from lineitem)
        where l_orderkey % 4 in (0, 1)""",
)
def feed_pages(t):
    item = F.format_string('{"address": "%s"}', address(F.col("l_partkey")))
    kind, entries = F.col("l_orderkey") % 4, F.col("entries")
    page = (
        F.when(kind == 0, F.concat(F.lit(" ["), entries, F.lit("]\n")))
        .when(kind == 1, F.concat(F.lit('{"items": ['), entries, F.lit("]}")))
        .when(kind == 2, F.lit('{"items": 5}'))
        .otherwise(entries)
    )
    pages = listed(t, item).select("l_orderkey", F.posexplode(readers.page_items(page)).alias("pos", "item"))
    return pages.select(
        F.col("l_orderkey").alias("page"), F.col("pos").cast("long").alias("pos"),
        F.get_json_object("item", "$.address").alias("address"),
    )


@add(
    "q79_envelope_lines",
    with_views(
        raw=RAW_ENVELOPES,
        body="""select msg_id, case when k = 3 then 'Hunter' else 'risk' end agent,
                case when k = 4 then upper(h) else h end payload_hash,
                case when k = 5 then 2 else 1 end parents, '{}' payload,
                case k when 7 then '/x' when 8 then null else 'a/b' end model_used, 0 extra from raw""",
    ),
)
def envelope_lines(t):
    read = readers.decode_envelopes(sinks.envelope_lines(raw_envelopes(t)))
    return read.select(
        "msg_id", "agent", "payload_hash", F.size("upstream_ids").alias("parents"), "payload", "model_used",
        F.size("extra_keys").alias("extra"),
    )


@add(
    "q80_explorer_rows",
    f"""select {sql_address('l_orderkey')} token_address, n - 1 pos, quantity from (
            select l_orderkey, cast(cast(l_quantity as bigint) as varchar) quantity, row_number() over (
                partition by l_orderkey order by l_linenumber,
                '{{"TokenHolderQuantity": "' || cast(l_quantity as bigint) || '"}}') n
            from lineitem)
        where l_orderkey % 3 > 0""",
)
def explorer_rows(t):
    entry = F.format_string('{"TokenHolderQuantity": "%d"}', F.col("l_quantity").cast("bigint"))
    answer = F.when(F.col("l_orderkey") % 3 == 0, F.lit("Max rate limit reached")).otherwise(
        F.concat(F.lit("["), F.col("entries"), F.lit(", 5]"))
    )
    extracts = listed(t, entry).select(address(F.col("l_orderkey")).alias("token_address"), answer.alias("result"))
    return readers.explorer_rows(extracts, "holders").select(
        "token_address", F.col("pos").cast("long").alias("pos"), F.col("TokenHolderQuantity").alias("quantity")
    )


@add(
    "q81_audited_calls",
    with_views(
        "v_call", **COST,
        body="""select call_id, case when success then input_tokens else 0 end input_tokens,
                case when success then output_tokens else 0 end output_tokens,
                case when success then cost_usd::double else 0 end cost_usd from costed""",
    ),
)
def audited_calls(t):
    rows = sinks.audited(costed(t))
    return rows.select("call_id", "input_tokens", "output_tokens", F.col("cost_usd").cast("double").alias("cost_usd"))
