"""Queries of replay, retention, funnels, redaction and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import operations, redact, resolve
from ferrule.plans.inputs import AS_OF, as_of, table
from ferrule.plans.registry import query


@query("""select o_orderkey, 'cek_' || sha256(o_custkey || chr(31) || o_orderstatus || chr(31) || o_orderkey) as observation_key,
        'ceo_' || sha256('cek_' || sha256(o_custkey || chr(31) || o_orderstatus || chr(31) || o_orderkey)) as observation_id
    from orders where greatest(o_orderdate, o_orderdate + interval (o_orderkey % 400) days) <= timestamp '1999-01-01'""")
def replay_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 400).cast("int"))
    records = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").alias("accepted_at"), late.alias("available_at"))
    found = operations.eligible(records, as_of("1999-01-01 00:00:00"))
    return operations.observation_ids(found, "o_custkey", "o_orderstatus", "o_orderkey").select("o_orderkey", "observation_key", "observation_id")


@query("""select o_custkey, count(*) as lines, sha256(string_agg(sha256(o_orderkey || ',' || o_orderstatus), chr(10) order by o_orderkey)) as digest from orders group by 1""")
def replay_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return operations.order_free_digest(orders, ["o_custkey"], F.concat_ws(",", "o_orderkey", "o_orderstatus"), "o_orderkey")


@query(f"""select event_id, event_type from events where case event_type when 'click' then ts > timestamp '{AS_OF}' - interval 1 days when 'view' then ts > timestamp '{AS_OF}' - interval 2 days
    when 'purchase' then ts > timestamp '{AS_OF}' - interval 180 days else true end""")
def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return operations.unexpired(rows, as_of(), {"click": 1, "view": 2, "purchase": 180}, kind="event_type").select("event_id", "event_type")


@query("""with days as (select event_type as issuer, ts::date as day, count(*) as posts from events group by all)
    select issuer, day::varchar as day, posts from days qualify row_number() over (partition by issuer order by day desc) <= 14""")
def bucket_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("issuer"), F.to_date("ts").alias("day")).agg(F.count("*").alias("posts"))
    return operations.latest_buckets(days, 14).withColumn("day", F.col("day").cast("string"))


@query("""with kept as (select user_id, event_type, event_id from events where value >= 5 qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1),
    visits as (select user_id % 5 as variant, user_id, bool_or(event_type = 'view') as viewed, bool_or(event_type = 'signup' and event_id % 2 = 0) as converted from kept group by all),
    counts as (select variant, count(*) filter (viewed) as views, count(*) filter (viewed and converted) as conversions from visits group by 1),
    rates as (select *, conversions / views::double as p, 1.6448536269514722::double as z from counts)
    select variant, views, conversions, round(p, 9) as rate, round(greatest(0.0, (p + z * z / (2 * views) - z * sqrt((p * (1 - p) + z * z / (4 * views)) / views)) / (1 + z * z / views)), 9) as lower, views >= 250 as ready from rates""")
def funnel_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("visitor"), F.col("event_type").alias("kind"), "ts", F.col("event_id").alias("ordinal"), "value")
    kept = operations.once_per_visitor(events, F.col("value") < 5)
    visits = kept.groupBy((F.col("visitor") % 5).alias("variant"), "visitor").agg(
        F.max(F.col("kind") == "view").alias("viewed"), F.max((F.col("kind") == "signup") & (F.col("ordinal") % 2 == 0)).alias("converted")
    )
    found = operations.funnel(visits, ["variant"])
    return found.withColumns({c: F.round(c, 9) for c in ("rate", "lower")})


@query("""select event_id from events qualify row_number() over (partition by user_id % 3, date_trunc('minute', ts) order by ts, event_id) = 1""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("address"), "ts", F.col("event_id").alias("ordinal"))
    return operations.one_per_minute(rows).select(F.col("ordinal").alias("event_id"))


@query("""select event_id, json_extract_string(props, '$.k') as k, 'v' || (event_id % 3) as kept from events""")
def redact_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw signals with sensitive names beside the event's own properties; only the rest stays."""
    raw = F.regexp_replace("props", r"\}$", ', "api-key": "s", "Access_Token": "t", "e.mail": "m", "note": "v') 
    raw = F.concat(raw, F.col("event_id") % 3, F.lit('"}'))
    kept = redact.redact_flat(raw)
    return table(spark, sf_dir, "events").select("event_id", kept["k"].alias("k"), kept["note"].alias("kept"))


@query("""with rows as (select doc_id as row_id, source, strftime(date '2024-01-01' + (doc_id % 300)::int, '%Y-%m-%d') as b, case when doc_id % 7 = 0 then '9999-12-31' else strftime(date '2024-01-01' + (doc_id % 300 + doc_id % 3)::int, '%Y-%m-%d') end as e,
        source || (doc_id % 40) as k from documents)
    select distinct r.row_id, r.k as rule_key from rows r join rows p on r.k = p.k and (p.b < r.b or (p.b = r.b and p.row_id < r.row_id)) and r.b <= p.e""")
def registry_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = lambda more: F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300 + more).cast("int")), "yyyy-MM-dd")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), F.concat("source", F.col("doc_id") % 40).alias("rule_key"), start(0).alias("valid_from"), F.when(F.col("doc_id") % 7 != 0, start(F.col("doc_id") % 3)).alias("valid_to")
    )
    return resolve.overlapping_intervals(rows, ["rule_key"])


@query("""with rule as (select d.doc_id, quality, regexp_matches(text, '[#$%&*!|]{2}| \\| ') as junk from documents d join labels l using (doc_id))
    select count(*) filter (junk and quality = 0) as hits, count(*) filter (junk and quality = 1) as false_alarms, count(*) filter (not junk and quality = 0) as misses,
        round(hits / nullif(hits + false_alarms, 0), 9)::double as precision, round(hits / nullif(hits + misses, 0), 9)::double as recall from rule""")
def label_quality_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: how well a rule on marks finds what labels call bad."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    found = rows.agg(*operations.binary_quality(F.col("text").rlike(r"[#$%&*!|]{2}| \| "), F.col("quality") == 0))
    return found.withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


@query("""select gate, bool_and(coalesce(state = 'passed', false)) as passed, count(*) filter (state is null) as missing
    from (select * from (values ('g0', 'c0'), ('g0', 'c1'), ('g1', 'c0'), ('g1', 'c2'), ('g2', 'c9')) as r(gate, chk))
    left join (select 'g' || (o_custkey % 3) as gate, 'c' || (o_custkey % 5) as chk, case when min(o_totalprice) > 0 then 'passed' else 'failed' end as state from orders group by all) using (gate, chk) group by 1""")
def capability_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_custkey")
    checks = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("g"), key % 3).alias("gate"), F.concat(F.lit("c"), key % 5).alias("check"))
    checks = checks.agg(F.when(F.min("o_totalprice") > 0, "passed").otherwise("failed").alias("state"))
    required = spark.createDataFrame([("g0", "c0"), ("g0", "c1"), ("g1", "c0"), ("g1", "c2"), ("g2", "c9")], "gate string, check string")
    return operations.gates_passed(checks, required)
