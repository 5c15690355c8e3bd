"""Queries of signals: insiders, sentiment, options, lobbying, technical series and attention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.operators import signals
from ferrule.plans.inputs import AS_OF, LOOKBACK, ORDERS_AS_OF, ORDERS_LOOKBACK, TRADES_SQL, as_of, table, trades
from ferrule.plans.registry import query


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


INSIDER_SQL = f"""
    with {TRADES_SQL}, windowed as (
        select *, case when ts >= timestamp '{ORDERS_AS_OF}' - interval 45 days then 'current' when ts >= timestamp '{ORDERS_AS_OF}' - interval 90 days then 'prior' end as w,
            shares * price * case when code = 'S' then -1 else 1 end as value
        from trades where (not derivative or {{derivatives}}) and shares > 0 and price > 0
    ), net as (
        select issuer, coalesce(sum(value) filter (w = 'current'), 0) as net, coalesce(sum(value) filter (w = 'prior'), 0) as prior_net,
            count(distinct owner) filter (w = 'current' and code = 'P') as buyers, count(distinct owner) filter (w = 'current' and code = 'S') as sellers,
            count(distinct owner) filter (w = 'current' and code = 'S' and not planned) as unplanned,
            coalesce(bool_or(w = 'current' and code = 'S' and planned), false) as any_planned, max(ts) filter (w = 'current') as latest,
            count(distinct url) filter (w = 'current') as source_count
        from windowed where w is not null group by 1 having latest is not null
    ), sized as (
        select *, case when net > 0 then 'purchase' when net < 0 then 'sale' else 'mixed' end as kind,
            case when net > 0 then 'bullish' when net < 0 then 'bearish' else 'neutral' end as direction,
            (case when net > 0 then buyers when net < 0 then sellers else 0 end)::int as owners from net
    )
"""


@query(f"""{INSIDER_SQL.format(derivatives="false")} select issuer, 'insider_' || kind || case when owners >= 3 then '_strong_cluster' when owners >= 2 then '_cluster' else '_activity' end as signal, direction,
        round(least(1.0, 0.45::double + 0.12::double * owners), 6) as strength,
        case when net < 0 then least(case when any_planned then 0.5 else 1 end, case when unplanned >= 3 then 0.72 when unplanned >= 2 then 0.66 else 0.52 end)
            else case when owners >= 3 then 0.88 when owners >= 2 then 0.82 else 0.68 end end::double as confidence,
        case when prior_net = 0 then 'new_activity' when (net > 0) <> (prior_net > 0) then 'direction_reversal' when abs(net) > abs(prior_net) then 'increased' else 'decreased' end as novelty,
        case when owners >= 2 then 'material' else 'contextual' end as materiality, round(net, 2) as net, round(prior_net, 2) as prior_net, owners, source_count::int as source_count, latest
    from sized""")
def insider_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(signals.insider_clusters(trades(spark, sf_dir), as_of(ORDERS_AS_OF), ORDERS_LOOKBACK), 6, "strength").withColumns({c: F.round(c, 2) for c in ("net", "prior_net")})


@query(f"""{INSIDER_SQL.format(derivatives="true")} select issuer, direction, round(least(1.0, 0.45::double + 0.15::double * owners), 6) as strength,
        (case when net < 0 then case when any_planned then 0.5 when owners >= 2 then 0.82 else 0.62 end else case when owners >= 2 then 0.82 else 0.65 end end)::double as confidence,
        round(net, 2) as net, round(prior_net, 2) as prior_net, owners as people, latest from sized""")
def insider_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("code") == "S", " S-Sale").otherwise("P-Purchase ")
    rows = trades(spark, sf_dir).select("issuer", F.col("owner").alias("person"), kind.alias("transaction_type"), "planned", "shares", "price", "ts")
    found = signals.vendor_insider(rows, as_of(ORDERS_AS_OF), ORDERS_LOOKBACK)
    return _rounded(found, 6, "strength").withColumns({c: F.round(c, 2) for c in ("net", "prior_net")})


HALVES_SQL = f"""case when ts >= timestamp '{AS_OF}' - interval 15 days then 'current' when ts >= timestamp '{AS_OF}' - interval 30 days then 'prior' end as w"""


@query(f"""with rows as (
        select user_id as issuer, ts, {HALVES_SQL}, case when event_id % 5 = 0 then null else value end as mentions, value / 3 as positive, value / 5 as negative,
            case when event_id % 3 = 0 then null else (event_id % 7 - 3) / 2.0::double end as score from events
    ), seen as (
        select issuer, ts, w, coalesce(mentions, positive + negative) as mentions,
            least(1.0, greatest(-1.0, coalesce(score, (positive - negative) / greatest(1.0, positive + negative)))) as score from rows where w is not null
    ), sums as (
        select issuer, coalesce(sum(mentions) filter (w = 'current'), 0) as mentions, coalesce(sum(mentions) filter (w = 'prior'), 0) as prior_mentions,
            coalesce(sum(score * mentions) filter (w = 'current'), 0) as s, coalesce(sum(score * mentions) filter (w = 'prior'), 0) as ps, max(ts) as latest
        from seen where mentions > 0 group by 1
    ), deltas as (
        select *, case when prior_mentions > 0 then s / greatest(1.0, mentions) - ps / prior_mentions else 0 end as delta from sums where mentions > 0
    ), directed as (
        select *, case when prior_mentions > 0 and mentions >= prior_mentions and delta >= 0.05 then 'bullish'
            when prior_mentions > 0 and mentions >= prior_mentions and delta <= -0.05 then 'bearish' else 'neutral' end as direction from deltas
    ) select issuer, case when prior_mentions <= 0 then 'social_current_observation' when direction = 'bullish' then 'social_sentiment_increase'
            when direction = 'bearish' then 'social_sentiment_decrease' else 'social_attention_change' end as signal, direction,
        round(least(1.0, 0.35 + abs(delta)), 5) as strength, (case when direction <> 'neutral' then 0.72 else 0.60 end)::double as confidence,
        round(mentions, 3) as mentions, round(prior_mentions, 3) as prior_mentions, round(delta, 5) as sentiment_delta, latest from directed""")
def sentiment_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("issuer"), "ts", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("mentions"), (F.col("value") / 3).alias("positive"),
        (F.col("value") / 5).alias("negative"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 7 - 3) / 2.0).alias("score"),
    )
    found = signals.social_sentiment(rows, as_of(), LOOKBACK)
    return _rounded(_rounded(found, 5, "strength", "sentiment_delta"), 3, "mentions", "prior_mentions")


@query(f"""with rows as (
        select user_id as issuer, ts, {HALVES_SQL}, case when event_type in ('view', 'click') then 'call' when event_type in ('purchase', 'signup') then 'put' end as leg,
            value, event_id % 100 as volume, event_id % 40 as oi, event_id % 4 = 0 as large from events
    ), sums as (
        select issuer, coalesce(sum(value) filter (w = 'current' and leg = 'call'), 0) as cc, coalesce(sum(value) filter (w = 'current' and leg = 'put'), 0) as cp,
            coalesce(sum(value) filter (w = 'prior' and leg = 'call'), 0) as pc, coalesce(sum(value) filter (w = 'prior' and leg = 'put'), 0) as pp,
            coalesce(sum(volume) filter (w = 'current'), 0) as cv, coalesce(sum(oi) filter (w = 'current'), 0) as co, coalesce(sum(volume) filter (w = 'prior'), 0) as pv,
            coalesce(sum(oi) filter (w = 'prior'), 0) as po, count(*) filter (w = 'current' and large) as cl, count(*) filter (w = 'prior' and large) as pl, max(ts) as latest
        from rows where w is not null group by 1 having cc + cp > 0
    ), changed as (
        select *, pc + pp > 0 as has, cc - cp as premium, pc - pp as prior_premium, case when pc + pp > 0 then (cc - cp) - (pc - pp) else cc - cp end as change from sums
    ) select issuer, case when not has and premium > 0 then 'call_dominant_flow_observation' when not has and premium < 0 then 'put_dominant_flow_observation' when not has then 'balanced_flow_observation'
            when change = 0 then 'directional_flow_unchanged'
            when change > 0 then case when greatest(cc - pc, 0) >= greatest(pp - cp, 0) then 'call_flow_increase' else 'put_flow_decrease' end
            else case when greatest(cp - pp, 0) >= greatest(pc - cc, 0) then 'put_flow_increase' else 'call_flow_decrease' end end as signal,
        case when change > 0 then 'bullish' when change < 0 then 'bearish' else 'neutral' end as direction,
        round(least(1.0, abs(change) / greatest(1.0, cc + cp, case when has then pc + pp else 0 end)), 6) as strength, round(premium, 3) as premium, round(prior_premium, 3) as prior_premium,
        cl as large_trades, pl as prior_large_trades, round(cv / nullif(co, 0), 6)::double as volume_to_interest, round(pv / nullif(po, 0), 6)::double as prior_volume_to_interest, latest
    from changed""")
def options_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("issuer"), F.when(kind == "view", "CALL").when(kind == "click", "c").when(kind == "purchase", "Put spread").when(kind == "signup", "P").alias("side"),
        (-F.col("value")).alias("premium"), (F.col("event_id") % 100).cast("double").alias("volume"), (F.col("event_id") % 40).cast("double").alias("open_interest"),
        F.when(F.col("event_id") % 4 == 0, F.when(F.col("event_id") % 8 == 0, "SWEEP").otherwise("a block")).alias("trade_type"), "ts",
    )
    found = signals.options_flow(rows, as_of(), LOOKBACK)
    return _rounded(_rounded(found, 6, "strength", "volume_to_interest", "prior_volume_to_interest"), 3, "premium", "prior_premium")


@query("""with chain as (select user_id as issuer, ts::date as expiration, case when event_type in ('view', 'error') then 'call' else 'put' end as side,
        case when event_id % 9 = 0 then null else event_id % 60 end as volume, event_id % 40 as oi from events),
    nearest as (select * replace (expiration::varchar as expiration) from chain qualify expiration = min(expiration) over (partition by issuer)),
    sums as (select issuer, expiration, coalesce(sum(volume) filter (side = 'call'), 0)::double as calls, coalesce(sum(volume) filter (side = 'put'), 0)::double as puts,
        coalesce(sum(oi) filter (side = 'call'), 0)::double as call_interest, coalesce(sum(oi) filter (side = 'put'), 0)::double as put_interest from nearest group by all)
    select *, case when puts = 0 and calls > 0 then 'bullish' when puts > 0 and calls / puts >= 1.5 then 'bullish' when puts > 0 and calls / puts <= 0.67 then 'bearish' else 'neutral' end as direction,
        round(least(1.0, abs(calls - puts) / greatest(1.0, calls + puts)), 6) as strength from sums""")
def options_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("issuer"), F.to_date("ts").alias("expiration"), F.when(F.col("event_type").isin("view", "error"), "call").otherwise("put").alias("side"),
        F.when(F.col("event_id") % 9 != 0, (F.col("event_id") % 60).cast("double")).alias("volume"), (F.col("event_id") % 40).cast("double").alias("open_interest"),
    )
    return _rounded(signals.chain_imbalance(chain), 6, "strength").withColumn("expiration", F.col("expiration").cast("string"))


@query(f"""with rows as (select user_id as issuer, ts, {HALVES_SQL} from events where event_type = 'signup')
    select issuer, count(*) filter (w = 'current') as current_rows, count(*) filter (w = 'prior') as prior_rows, max(ts) as latest,
        round(least(1.0, 0.35::double + count(*) filter (w = 'current') / 20), 6)::double as strength
    from rows where w is not null group by 1 having current_rows > 0""")
def lobbying_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("user_id").alias("issuer"), "ts")
    return _rounded(signals.lobbying_counts(rows, as_of(), LOOKBACK), 6, "strength")


SERIES_SQL = """
    with days as (select user_id as issuer, ts::date as day, round(avg(value), 6) as close from events group by all),
    series as (
        select *, round(avg(close) over w5, 6) as sma, round(avg(close) over w3, 6) as ema_short, round(avg(close) over w7, 6) as ema_long,
            round(100 * percent_rank, 6) as rsi from (select *, (close % 100) / 100 as percent_rank from days)
        window w5 as (partition by issuer order by day rows 4 preceding), w3 as (partition by issuer order by day rows 2 preceding), w7 as (partition by issuer order by day rows 6 preceding)
    )
"""


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("issuer"), F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("close"))
    mean = lambda n: F.round(F.avg("close").over(Window.partitionBy("issuer").orderBy("day").rowsBetween(1 - n, 0)), 6)
    return days.withColumns({"sma": mean(5), "ema_short": mean(3), "ema_long": mean(7), "rsi": F.round(100 * ((F.col("close") % 100) / 100), 6)})


@query(f"""{SERIES_SQL}, pairs as (
        select *, row_number() over b as n, lead(rsi) over b as pr, lead(close) over b as pc, lead(sma) over b as ps, lead(ema_short) over b as pes, lead(ema_long) over b as pel
        from series window b as (partition by issuer order by day desc)
    ), found as (
        select issuer, day, unnest([case when pr < 30 and rsi >= 30 then 'rsi_recovered_30' when pr <= 70 and rsi > 70 then 'rsi_crossed_70' when pr > 70 and rsi <= 70 then 'rsi_fell_below_70' when pr >= 30 and rsi < 30 then 'rsi_fell_below_30' end,
            case when pc <= ps and close > sma then 'price_crossed_above_sma_20' when pc >= ps and close < sma then 'price_crossed_below_sma_20' end,
            case when pes <= pel and ema_short > ema_long then 'ema_12_crossed_above_26' when pes >= pel and ema_short < ema_long then 'ema_12_crossed_below_26' end]) as signal
        from pairs where n = 1
    ) select * replace (day::varchar as day), case when signal in ('rsi_recovered_30', 'price_crossed_above_sma_20', 'ema_12_crossed_above_26') then 'bullish' else 'bearish' end as direction from found where signal is not null""")
def technical_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.technical_transitions(_series(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query("""select event_type as issuer, ts::date::varchar as day, count(distinct event_id) as post_count, count(distinct user_id) as unique_authors, max(ts) as newest from events group by all""")
def daily_attention_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "events").select(F.col("event_type").alias("issuer"), F.col("event_id").alias("uri"), F.col("user_id").alias("author"), "ts")
    return signals.daily_attention(posts).withColumn("day", F.col("day").cast("string"))


@query("""with posts as (select user_id % 40 as issuer, event_id as uri, user_id as author, ts, ts::date as day from events),
    coverage as (select issuer, day, count(*) >= 3 as adequate from posts group by all),
    held as (select issuer, min(day) as oldest, count(*) filter (day between date '2024-01-17' and date '2024-01-30') as present,
        count(*) filter (day between date '2024-01-17' and date '2024-01-30' and adequate) as adequate_days from coverage group by 1),
    counts as (select issuer, count(distinct uri) filter (day > date '2024-01-23') as posts, count(distinct uri) filter (day <= date '2024-01-23') as prior_posts,
        count(distinct author) filter (day > date '2024-01-23') as authors, count(distinct author) filter (day <= date '2024-01-23') as prior_authors
        from posts where day between date '2024-01-17' and date '2024-01-30' group by 1),
    stated as (select *, case when adequate_days = 14 then 'fresh' when present < 14 and oldest > date '2024-01-17' then 'warm_up' else 'coverage_gap' end as status from held left join counts using (issuer))
    select issuer, status, adequate_days::int as adequate_days, case when status = 'fresh' then posts end as posts, case when status = 'fresh' then prior_posts end as prior_posts,
        case when status = 'fresh' then authors end as authors, case when status = 'fresh' then prior_authors end as prior_authors,
        case when status = 'fresh' then round(least(1.0, abs(posts - prior_posts) / greatest(prior_posts, 1)), 6)::double end as strength from stated""")
def attention_7v7(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("issuer"), F.col("event_id").alias("uri"), F.col("user_id").alias("author"), "ts")
    coverage = posts.groupBy("issuer", F.to_date("ts").alias("day")).agg((F.count("*") >= 3).alias("adequate"))
    found = signals.attention_change(posts, coverage, F.to_date(F.lit("2024-01-30")))
    return found.withColumn("strength", F.round(F.when(F.col("status") == "fresh", F.col("strength")), 6))


@query("""with hashes as (select event_type as issuer, ts::date as day, event_id % 3 as chk, sha256((user_id % 50)::varchar) as hash from events),
    marked as (select *, max(chk) over (partition by issuer, day) as last from hashes),
    sets as (select issuer, day, list_distinct(list(hash) filter (chk < last)) as before, list_distinct(list(hash) filter (chk = last)) as now from marked group by all)
    select issuer, day::varchar as day, len(list_filter(coalesce(before, []), lambda x: not list_contains(now, x))) as missing from sets""")
def retraction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = table(spark, sf_dir, "events").select(F.col("event_type").alias("issuer"), F.to_date("ts").alias("day"), (F.col("event_id") % 3).alias("check"), F.sha2((F.col("user_id") % 50).cast("string"), 256).alias("hash"))
    return signals.retracted(hashes).withColumn("day", F.col("day").cast("string"))
