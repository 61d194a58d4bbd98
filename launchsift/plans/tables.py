"""The given tables seen as launch-signal entities, in Spark and as SQL views.

``VIEWS`` holds the same definitions as SQL text for the checker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from launchsift.functions.constants import BLANKS
from launchsift.functions.text import micros
from launchsift.session import prepare

EPOCH_2024 = 1_704_067_200


class Tables:
    """Lazily read tables and entity views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = prepare(spark)
        self.folder = folder
        self.opened: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self.opened:
            self.opened[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.opened[name]

    # -- views -----------------------------------------------------------------
    def candidates(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("token_id"),
            address(F.col("p_partkey")).alias("token_address"),
            F.col("p_name").alias("token_name"),
            F.element_at(F.split("p_name", " "), -1).alias("token_symbol"),
            F.col("p_retailprice").alias("initial_liquidity_usd"),
            (F.col("p_partkey") % 50).alias("creator_id"),
            address(F.col("p_partkey") % 50).alias("creator_address"),
            F.date_format(
                F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("p_partkey")), "yyyy-MM-dd'T'HH:mm:ss'Z'"
            ).alias("launch_timestamp"),
            F.concat(F.lit("https://feed.example/t/"), F.col("p_partkey").cast("string")).alias(
                "source_url"
            ),
            "p_size",
        )

    def holders(self) -> DataFrame:
        """Summed holdings; larger ones come first on a token's page."""
        owned = self.orders.select("o_orderkey", "o_custkey")
        qty = (
            self.lineitem.select("l_orderkey", "l_partkey", "l_quantity")
            .join(owned, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(F.col("l_partkey").alias("token_id"), F.col("o_custkey").alias("holder_id"))
            .agg(F.sum("l_quantity").alias("qty"))
        )
        return qty.select(
            address(F.col("token_id")).alias("token_address"),
            "holder_id",
            F.when(
                (F.col("token_id") % 40 == 0) & (F.col("holder_id") % 10 == 0), F.lit("n/a")
            ).otherwise(F.col("qty").cast("string")).alias("quantity"),
            F.struct((-F.col("qty")).alias("q"), F.col("holder_id").alias("h")).alias("pos"),
        )

    def transfers(self) -> DataFrame:
        """Shipments as transfers, newest first on a token's page."""
        at = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
        return self.lineitem.select(
            address(F.col("l_partkey")).alias("token_address"),
            at.cast("string").alias("time_stamp"),
            F.when(F.col("l_linenumber") == 7, F.lit("n/a"))
            .otherwise(F.col("l_extendedprice").cast("string")).alias("value"),
            F.lit("0").alias("decimals"),
            F.struct((-at).alias("t"), "l_orderkey", "l_linenumber", "l_extendedprice").alias("pos"),
        )

    def contracts(self) -> DataFrame:
        return self.lineitem.select(
            address(F.col("l_partkey")).alias("token_address"),
            F.when(F.col("l_returnflag") == "R", F.lit("")).otherwise(F.col("l_returnflag")).alias(
                "source_code"
            ),
            F.when(F.col("l_linestatus") == "F", F.lit(""))
            .otherwise(F.upper(address(F.col("l_suppkey")))).alias("creator"),
            F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus").alias("pos"),
        )

    def creator_transactions(self) -> DataFrame:
        return self.lineitem.select(address(F.col("l_suppkey")).alias("creator_address"))

    def snippets(self) -> DataFrame:
        return self.documents.select(
            F.col("source").alias("channel"), F.col("doc_id").alias("pos"), "text"
        )

    def signals(self) -> DataFrame:
        kind = F.col("event_type")
        return self.events.filter(kind.isin("click", "view", "purchase")).select(
            F.col("event_id").alias("msg_id"),
            F.col("user_id").alias("token_id"),
            F.when(kind == "purchase", F.lit("chain")).otherwise(F.lit("social")).alias("side"),
            F.col("ts").cast("timestamp").alias("ts"),
        )

    def messages(self) -> DataFrame:
        number = F.col("conv_id") * 1000 + F.col("turn")
        return self.conversations.select(
            number.alias("msg_id"),
            F.when(F.col("turn") > 0, F.array(number - 1))
            .otherwise(F.array().cast("array<bigint>")).alias("upstream_ids"),
            F.col("role").alias("agent"),
            "conv_id", "turn", "role", "text",
        )

    def briefs(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("msg_id"),
            (F.floor("o_totalprice") % 101).cast("int").alias("score"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
            F.col("o_custkey").alias("customer"),
            F.col("o_orderpriority").alias("priority"),
            F.col("o_orderstatus").alias("status"),
        )

    def subscribers(self) -> DataFrame:
        segment = F.col("c_mktsegment")
        return self.customer.select(
            F.col("c_custkey").alias("chat_id"),
            F.when(segment == "BUILDING", F.lit("degen"))
            .when(segment == "FURNITURE", F.lit("speculative"))
            .when(segment == "MACHINERY", F.lit("moderate"))
            .when(segment == "HOUSEHOLD", F.lit("high"))
            .otherwise(F.lit("Unknown")).alias("threshold"),
            (F.col("c_acctbal") > 0).alias("active"),
        )

    def calls(self) -> DataFrame:
        def numbered(prefix: str, n: int) -> Column:
            return F.concat(F.lit(prefix), (F.col("user_id") % n).cast("string"))

        failed = F.col("event_type") == "error"
        return self.events.select(
            F.col("event_id").alias("call_id"),
            F.col("ts").cast("timestamp").alias("created_at"),
            numbered("agent", 5).alias("agent"),
            numbered("prov", 4).alias("provider"),
            numbered("model", 6).alias("model"),
            F.floor(F.col("value") * 10).cast("bigint").alias("input_tokens"),
            F.get_json_object("props", "$.k").cast("bigint").alias("output_tokens"),
            (~failed).alias("success"),
            F.when(failed, numbered("Error", 3)).alias("error_class"),
        )


def address(number: Column) -> Column:
    # Low digits first: real addresses differ early, and sorting relies on that.
    # Filled up last: only the digits are turned round, and no zero is copied by itself.
    return F.substring(F.concat(F.lit("0x"), F.reverse(F.lower(F.hex(number))), F.lit("0" * 40)), 1, 42)


def joined(values: Column) -> Column:
    """Array as one text, so that it compares alike everywhere."""
    return F.array_join(values, ",")


def or_none(df: DataFrame, *columns: str) -> DataFrame:
    """Missing numbers shown as -1, because readers disagree on how to show a null number."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(-1)) for c in columns})


def epoch(ts: Column) -> Column:
    return micros(ts)


# -- SQL --------------------------------------------------------------------------

QUOTED_BLANKS = "'" + BLANKS + "'"


def sql_address(number: str) -> str:
    return f"('0x' || reverse(lpad(lower(to_hex({number})), 40, '0')))"


def sql_strip(text: str) -> str:
    return f"trim({text}, {QUOTED_BLANKS})"


def sql_round(value: str, digits: int) -> str:
    return f"round_even({value}, {digits})"


VIEWS = {
    "v_candidate": f"""
        select p_partkey token_id, {sql_address('p_partkey')} token_address, p_name token_name,
               list_extract(string_split(p_name, ' '), -1) token_symbol,
               p_retailprice initial_liquidity_usd, p_partkey % 50 creator_id,
               {sql_address('p_partkey % 50')} creator_address,
               strftime(make_timestamp(({EPOCH_2024} + p_partkey) * 1000000),
                        '%Y-%m-%dT%H:%M:%SZ') launch_timestamp,
               'https://feed.example/t/' || p_partkey source_url, p_size
        from part""",
    "v_holder": f"""
        select l_partkey token_id, {sql_address('l_partkey')} token_address, o_custkey holder_id,
               sum(l_quantity) qty,
               l_partkey % 40 = 0 and o_custkey % 10 = 0 bad
        from lineitem join orders on l_orderkey = o_orderkey
        group by l_partkey, o_custkey""",
    "v_transfer": f"""
        select l_partkey token_id, {sql_address('l_partkey')} token_address,
               epoch_us(l_shipdate) // 1000000 ts_s, l_extendedprice val, l_orderkey, l_linenumber,
               row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey,
                                  l_linenumber, l_extendedprice) rn
        from lineitem""",
    "v_signal": """
        select event_id msg_id, user_id token_id,
               case when event_type = 'purchase' then 'chain' else 'social' end side, ts
        from events where event_type in ('click', 'view', 'purchase')""",
    "v_message": """
        select conv_id * 1000 + turn msg_id, case when turn > 0 then conv_id * 1000 + turn - 1 end upstream,
               role agent, conv_id, turn, role, text
        from conversations""",
    "v_brief": """
        select o_orderkey msg_id, cast(floor(o_totalprice) as bigint) % 101 score,
               o_orderdate created_at, o_custkey customer, o_orderpriority priority,
               o_orderstatus status
        from orders""",
    "v_sub": """
        select c_custkey chat_id,
               case c_mktsegment when 'BUILDING' then 'degen' when 'FURNITURE' then 'speculative'
                    when 'MACHINERY' then 'moderate' when 'HOUSEHOLD' then 'high'
                    else 'Unknown' end threshold,
               c_acctbal > 0 active
        from customer""",
    "v_call": """
        select event_id call_id, ts created_at, 'agent' || (user_id % 5) agent,
               'prov' || (user_id % 4) provider, 'model' || (user_id % 6) model,
               cast(floor(value * 10) as bigint) input_tokens,
               cast(json_extract(props, '$.k') as bigint) output_tokens,
               event_type <> 'error' success,
               case when event_type = 'error' then 'Error' || (user_id % 3) end error_class
        from events""",
}


def with_views(*parts: str, body: str, **ctes: str) -> str:
    """SQL text with the named views and extra expressions in front of ``body``."""
    named = [f"{v} as ({VIEWS[v]})" for v in parts]
    named += [f"{name} as ({text})" for name, text in ctes.items()]
    return ("with " + ",\n".join(named) + "\n" if named else "") + body
