"""The test tables in the shapes of the operators: a user is a request or an issuer, an event is an observation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment at which all queries over events look back, in Spark and in SQL, and the days they look.
AS_OF, LOOKBACK = "2024-01-31 00:00:00", 30
ORDERS_AS_OF, ORDERS_LOOKBACK = "2001-08-01 00:00:00", 90


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of(text: str = AS_OF):
    return F.to_timestamp_ntz(F.lit(text))


#: evidence() in SQL.
EVIDENCE_SQL = """
    evidence as (
        select user_id as request_id, event_id as ordinal,
            case event_type when 'signup' then 'filings_news' when 'purchase' then 'insider_trading' when 'error' then 'options_flow'
                when 'view' then 'technical' else 'social' end as family,
            event_type || '_' || (event_id % 3) as signal,
            case when value > 300 then 'bullish' when value < 150 then 'bearish' else 'neutral' end as direction,
            least(1.0, value / 500) as strength, 0.5 + (event_id % 50) / 100.0::double as confidence,
            0.6 + (user_id % 4) / 10.0::double as quality, ts,
            'https://example.org/' || (event_id % 7) || '/' as source_url
        from events
    )
"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.col("event_type")
    named = (
        F.when(family == "signup", "filings_news").when(family == "purchase", "insider_trading").when(family == "error", "options_flow")
        .when(family == "view", "technical").otherwise("social")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("request_id"), F.col("event_id").alias("ordinal"), named.alias("family"),
        F.concat_ws("_", "event_type", F.col("event_id") % 3).alias("signal"),
        F.when(F.col("value") > 300, "bullish").when(F.col("value") < 150, "bearish").otherwise("neutral").alias("direction"),
        F.least(F.lit(1.0), F.col("value") / 500).alias("strength"), (0.5 + (F.col("event_id") % 50) / 100.0).alias("confidence"),
        (0.6 + (F.col("user_id") % 4) / 10.0).alias("quality"), "ts",
        F.concat(F.lit("https://example.org/"), F.col("event_id") % 7, F.lit("/")).alias("source_url"),
    )


#: trades() in SQL: a supplier is the issuer, a customer the owner, a line item the trade.
TRADES_SQL = """
    trades as (
        select l_suppkey as issuer, o_custkey as owner, case when l_returnflag = 'R' then 'S' else 'P' end as code,
            case when l_returnflag = 'R' then 'D' else 'A' end as acquired_disposed, l_linestatus = 'O' and l_linenumber = 1 as derivative,
            l_linenumber % 3 = 0 as planned, l_quantity as shares, l_extendedprice / l_quantity as price, l_shipdate as ts,
            'https://example.org/' || (l_orderkey % 500) as url
        from lineitem join orders on l_orderkey = o_orderkey
    )
"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sold = F.col("l_returnflag") == "R"
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("issuer"), F.col("o_custkey").alias("owner"), F.when(sold, "S").otherwise("P").alias("code"),
        F.when(sold, "D").otherwise("A").alias("acquired_disposed"), ((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 1)).alias("derivative"),
        (F.col("l_linenumber") % 3 == 0).alias("planned"), F.col("l_quantity").alias("shares"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_shipdate").alias("ts"), F.concat(F.lit("https://example.org/"), F.col("l_orderkey") % 500).alias("url"),
    )
