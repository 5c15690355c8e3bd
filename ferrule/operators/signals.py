"""Signals of a source, from its current half window against the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.numbers import clamp


def half_days(lookback_days: int) -> float:
    return max(1.0, lookback_days / 2)


def _back(as_of: Column, days: float) -> Column:
    return as_of - F.make_dt_interval(secs=F.lit(days * 86400).cast("decimal(18,6)"))


def window_of(ts: Column, as_of: Column, lookback_days: int, whole_lookback: bool = False) -> Column:
    """current, prior or null. The prior window ends with the lookback, or, as feeds of vendors have it, is as long as the current one."""
    half = half_days(lookback_days)
    begin = lookback_days if whole_lookback else half * 2
    return F.when(ts >= _back(as_of, half), "current").when(ts >= _back(as_of, begin), "prior")


def _sum(window: str, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(F.col("window") == window, value)), F.lit(0.0))


def insider_clusters(trades: DataFrame, as_of: Column, lookback_days: int, counted: Column | None = None) -> DataFrame:
    """One signal for each issuer with qualifying trades in the current half.

    trades: issuer, owner, code, acquired_disposed, derivative, planned, shares, price, ts, url. A trade qualifies if it is no
    derivative, a purchase acquired or a sale disposed, with shares and a price. Owners in the direction of the net value
    make the cluster; planned sales weaken a bearish one. All is one aggregation with partial sums; distinct owners are exact. Where a trade has a row for each of its
    owners, counted says which of these its value counts in.
    """
    sided = ((F.col("code") == "P") & (F.col("acquired_disposed") == "A")) | ((F.col("code") == "S") & (F.col("acquired_disposed") == "D"))
    rows = trades.withColumn("window", window_of(F.col("ts"), as_of, lookback_days, True)).where("window is not null")
    rows = rows.where(~F.col("derivative") & sided & (F.col("shares") > 0) & (F.col("price") > 0))
    value = F.col("shares") * F.col("price") * F.when(F.col("code") == "S", -1).otherwise(1)
    value = value if counted is None else F.when(counted, value).otherwise(0.0)
    now = F.col("window") == "current"
    who = lambda code, more=F.lit(True): F.countDistinct(F.when(now & (F.col("code") == code) & more, F.col("owner"))).cast("int")
    found = rows.groupBy("issuer").agg(
        _sum("current", value).alias("net"), _sum("prior", value).alias("prior_net"), who("P").alias("buyers"), who("S").alias("sellers"),
        who("S", ~F.col("planned")).alias("unplanned"), F.max(now & (F.col("code") == "S") & F.col("planned")).alias("any_planned"),
        F.max(F.when(now, F.col("ts"))).alias("latest"), F.countDistinct(F.when(now, F.col("url"))).cast("int").alias("source_count"),
    ).where("latest is not null")
    kind = F.when(F.col("net") > 0, "purchase").when(F.col("net") < 0, "sale").otherwise("mixed")
    owners = F.when(F.col("net") > 0, F.col("buyers")).when(F.col("net") < 0, F.col("sellers")).otherwise(0)
    found = found.withColumn("kind", kind).withColumn("owners", owners)
    size = lambda n: F.when(n >= 3, "strong_cluster").when(n >= 2, "cluster").otherwise("activity")
    graded = lambda n, a, b, c: F.when(n >= 3, a).when(n >= 2, b).otherwise(c)
    sale = graded(F.col("unplanned"), 0.72, 0.66, 0.52)
    confidence = F.when(F.col("net") < 0, F.when(F.col("any_planned"), F.least(sale, F.lit(0.50))).otherwise(sale)).otherwise(graded(F.col("owners"), 0.88, 0.82, 0.68))
    novelty = (
        F.when(F.col("prior_net") == 0, "new_activity").when((F.col("net") > 0) != (F.col("prior_net") > 0), "direction_reversal")
        .when(F.abs("net") > F.abs("prior_net"), "increased").otherwise("decreased")
    )
    return found.select(
        "issuer", F.concat_ws("_", F.lit("insider"), "kind", size(F.col("owners"))).alias("signal"),
        F.when(F.col("net") > 0, "bullish").when(F.col("net") < 0, "bearish").otherwise("neutral").alias("direction"),
        F.least(F.lit(1.0), 0.45 + 0.12 * F.col("owners")).alias("strength"), confidence.alias("confidence"), novelty.alias("novelty"),
        F.when(F.col("owners") >= 2, "material").otherwise("contextual").alias("materiality"), "net", "prior_net", "owners", "source_count", "latest",
    )


def vendor_insider(trades: DataFrame, as_of: Column, lookback_days: int) -> DataFrame:
    """Net value and people of each issuer by a vendor's rows: issuer, person, transaction_type, planned, shares, price, ts."""
    kind = F.lower(F.trim("transaction_type"))
    side = F.when(kind.isin("p-purchase", "purchase", "p"), 1).when(kind.isin("s-sale", "sale", "s"), -1)
    rows = trades.withColumn("side", side).withColumn("window", window_of(F.col("ts"), as_of, lookback_days))
    rows = rows.where("side is not null and window is not null and shares > 0 and price > 0")
    value = F.col("shares") * F.col("price") * F.col("side")
    now = F.col("window") == "current"
    people = lambda s: F.countDistinct(F.when(now & (F.col("side") == s), F.col("person"))).cast("int")
    found = rows.groupBy("issuer").agg(
        _sum("current", value).alias("net"), _sum("prior", value).alias("prior_net"), people(1).alias("buyers"), people(-1).alias("sellers"),
        F.coalesce(F.max(now & (F.col("side") == -1) & F.col("planned")), F.lit(False)).alias("planned"), F.max(F.when(now, F.col("ts"))).alias("latest"),
    ).where("latest is not null")
    n = F.when(F.col("net") > 0, F.col("buyers")).when(F.col("net") < 0, F.col("sellers")).otherwise(0)
    direction = F.when(F.col("net") > 0, "bullish").when(F.col("net") < 0, "bearish").otherwise("neutral")
    sale = F.when(F.col("planned"), 0.50).when(n >= 2, 0.82).otherwise(0.62)
    confidence = F.when(F.col("net") < 0, sale).otherwise(F.when(n >= 2, 0.82).otherwise(0.65))
    return found.select("issuer", direction.alias("direction"), F.least(F.lit(1.0), 0.45 + 0.15 * n).alias("strength"), confidence.alias("confidence"), "net", "prior_net", n.alias("people"), "latest")


def social_sentiment(rows: DataFrame, as_of: Column, lookback_days: int) -> DataFrame:
    """Mention-weighted sentiment of each issuer: rows of issuer, mentions, positive, negative, score, ts, any of which may be null but issuer and ts."""
    up, down = F.coalesce("positive", F.lit(0.0)), F.coalesce("negative", F.lit(0.0))
    mentions = F.greatest(F.lit(0.0), F.coalesce("mentions", up + down))
    score = clamp(F.coalesce("score", (up - down) / F.greatest(F.lit(1.0), up + down)), -1, 1)
    seen = rows.select("issuer", "ts", mentions.alias("mentions"), score.alias("score"), window_of(F.col("ts"), as_of, lookback_days).alias("window"))
    seen = seen.where("window is not null and mentions > 0")
    found = seen.groupBy("issuer").agg(
        _sum("current", F.col("mentions")).alias("mentions"), _sum("prior", F.col("mentions")).alias("prior_mentions"),
        _sum("current", F.col("score") * F.col("mentions")).alias("sum"), _sum("prior", F.col("score") * F.col("mentions")).alias("prior_sum"), F.max("ts").alias("latest"),
    ).where("mentions > 0")
    has = F.col("prior_mentions") > 0
    delta = F.when(has, F.col("sum") / F.greatest(F.lit(1.0), F.col("mentions")) - F.col("prior_sum") / F.when(has, F.col("prior_mentions"))).otherwise(0.0)
    found = found.withColumn("sentiment_delta", delta)
    held = has & (F.col("mentions") >= F.col("prior_mentions"))
    direction = F.when(held & (F.col("sentiment_delta") >= 0.05), "bullish").when(held & (F.col("sentiment_delta") <= -0.05), "bearish").otherwise("neutral")
    signal = (
        F.when(~has, "social_current_observation").when(direction == "bullish", "social_sentiment_increase")
        .when(direction == "bearish", "social_sentiment_decrease").otherwise("social_attention_change")
    )
    strength = F.least(F.lit(1.0), 0.35 + F.abs("sentiment_delta"))
    confidence = F.when(direction != "neutral", 0.72).otherwise(0.60)
    return found.select("issuer", signal.alias("signal"), direction.alias("direction"), strength.alias("strength"), confidence.alias("confidence"), "mentions", "prior_mentions", "sentiment_delta", "latest")


def options_flow(rows: DataFrame, as_of: Column, lookback_days: int) -> DataFrame:
    """Directional premium of each issuer: rows of issuer, side, premium, volume, open_interest, trade_type, ts."""
    side, kind = F.lower("side"), F.lower(F.coalesce("trade_type", F.lit("")))
    put_call = F.when(side.contains("call") | (side == "c"), "call").when(side.contains("put") | (side == "p"), "put")
    seen = rows.withColumn("window", window_of(F.col("ts"), as_of, lookback_days)).where("window is not null").withColumn("leg", put_call)
    premium = lambda leg: F.when(F.col("leg") == leg, F.abs(F.coalesce("premium", F.lit(0.0))))
    large = F.when(kind.contains("sweep") | kind.contains("block"), 1.0)
    parts = {"call": premium("call"), "put": premium("put"), "volume": F.col("volume"), "oi": F.col("open_interest"), "large": large}
    found = seen.groupBy("issuer").agg(*(_sum(w, x).alias(f"{w}_{n}") for w in ("current", "prior") for n, x in parts.items()), F.max("ts").alias("latest"))
    found = found.where("current_call + current_put > 0")
    has = F.col("prior_call") + F.col("prior_put") > 0
    now, before = F.col("current_call") - F.col("current_put"), F.col("prior_call") - F.col("prior_put")
    change = F.when(has, now - before).otherwise(now)
    call, put = F.col("current_call") - F.col("prior_call"), F.col("current_put") - F.col("prior_put")
    plus = lambda x: F.greatest(x, F.lit(0.0))
    signal = (
        F.when(~has & (now > 0), "call_dominant_flow_observation").when(~has & (now < 0), "put_dominant_flow_observation").when(~has, "balanced_flow_observation")
        .when(change == 0, "directional_flow_unchanged")
        .when(change > 0, F.when(plus(call) >= plus(-put), "call_flow_increase").otherwise("put_flow_decrease"))
        .otherwise(F.when(plus(put) >= plus(-call), "put_flow_increase").otherwise("call_flow_decrease"))
    )
    all_prior = F.when(has, F.col("prior_call") + F.col("prior_put")).otherwise(0.0)
    strength = F.least(F.lit(1.0), F.abs(change) / F.greatest(F.lit(1.0), F.col("current_call") + F.col("current_put"), all_prior))
    direction = F.when(change > 0, "bullish").when(change < 0, "bearish").otherwise("neutral")
    ratio = lambda w: F.col(f"{w}_volume") / F.when(F.col(f"{w}_oi") > 0, F.col(f"{w}_oi"))
    return found.select(
        "issuer", signal.alias("signal"), direction.alias("direction"), strength.alias("strength"), now.alias("premium"), before.alias("prior_premium"),
        F.col("current_large").cast("long").alias("large_trades"), F.col("prior_large").cast("long").alias("prior_large_trades"),
        ratio("current").alias("volume_to_interest"), ratio("prior").alias("prior_volume_to_interest"), "latest",
    )


def chain_imbalance(chain: DataFrame) -> DataFrame:
    """Call and put volume of the nearest expiry of each issuer: issuer, expiration, side, volume, open_interest."""
    nearest = Window.partitionBy("issuer")
    rows = chain.withColumn("_first", F.min("expiration").over(nearest)).where("expiration = _first")
    leg = lambda s, c: F.coalesce(F.sum(F.when(F.col("side") == s, F.coalesce(c, F.lit(0.0)))), F.lit(0.0))
    found = rows.groupBy("issuer", "expiration").agg(leg("call", "volume").alias("calls"), leg("put", "volume").alias("puts"), leg("call", "open_interest").alias("call_interest"), leg("put", "open_interest").alias("put_interest"))
    ratio = F.col("calls") / F.when(F.col("puts") > 0, F.col("puts"))
    direction = F.when((F.col("puts") == 0) & (F.col("calls") > 0), "bullish").when(ratio >= 1.5, "bullish").when(ratio <= 0.67, "bearish").otherwise("neutral")
    strength = F.abs(F.col("calls") - F.col("puts")) / F.greatest(F.lit(1.0), F.col("calls") + F.col("puts"))
    return found.select("issuer", "expiration", "calls", "puts", "call_interest", "put_interest", direction.alias("direction"), F.least(F.lit(1.0), strength).alias("strength"))


def lobbying_counts(rows: DataFrame, as_of: Column, lookback_days: int) -> DataFrame:
    """Dated rows of each issuer by window, with the strength they carry."""
    seen = rows.withColumn("window", window_of(F.col("ts"), as_of, lookback_days)).where("window is not null")
    found = seen.groupBy("issuer").agg(F.count_if(F.col("window") == "current").alias("current_rows"), F.count_if(F.col("window") == "prior").alias("prior_rows"), F.max("ts").alias("latest"))
    return found.where("current_rows > 0").withColumn("strength", F.least(F.lit(1.0), 0.35 + F.col("current_rows") / 20))


def technical_transitions(series: DataFrame) -> DataFrame:
    """Threshold and crossover signals of the latest pair of days of each issuer: issuer, day, close, rsi, sma, ema_short, ema_long."""
    back = Window.partitionBy("issuer").orderBy(F.col("day").desc())
    fields = ("close", "rsi", "sma", "ema_short", "ema_long")
    pair = series.withColumns({"_n": F.row_number().over(back), **{f"prior_{c}": F.lead(c).over(back) for c in fields}}).where("_n = 1")
    r, pr = F.col("rsi"), F.col("prior_rsi")
    rsi = (
        F.when((pr < 30) & (r >= 30), "rsi_recovered_30").when((pr <= 70) & (r > 70), "rsi_crossed_70")
        .when((pr > 70) & (r <= 70), "rsi_fell_below_70").when((pr >= 30) & (r < 30), "rsi_fell_below_30")
    )
    cross = lambda a, b, over, under: F.when((F.col(f"prior_{a}") <= F.col(f"prior_{b}")) & (F.col(a) > F.col(b)), over).when((F.col(f"prior_{a}") >= F.col(f"prior_{b}")) & (F.col(a) < F.col(b)), under)
    signals = F.array_compact(F.array(rsi, cross("close", "sma", "price_crossed_above_sma_20", "price_crossed_below_sma_20"), cross("ema_short", "ema_long", "ema_12_crossed_above_26", "ema_12_crossed_below_26")))
    found = pair.select("issuer", "day", F.explode(signals).alias("signal"))
    bullish = F.col("signal").isin("rsi_recovered_30", "price_crossed_above_sma_20", "ema_12_crossed_above_26")
    return found.withColumn("direction", F.when(bullish, "bullish").otherwise("bearish"))


def daily_attention(posts: DataFrame) -> DataFrame:
    """One bucket for each issuer and day: posts, unique_authors, newest. posts: issuer, uri, author, ts."""
    return posts.groupBy("issuer", F.to_date("ts").alias("day")).agg(F.countDistinct("uri").alias("post_count"), F.countDistinct("author").alias("unique_authors"), F.max("ts").alias("newest"))


def attention_change(posts: DataFrame, coverage: DataFrame, last_day: Column, days: int = 7) -> DataFrame:
    """Posts and authors of each issuer in the last days against as many before.

    coverage: issuer, day, adequate. Only if every day of both spans has an adequate bucket is a change inferred; else status is
    coverage_gap, or warm_up where the oldest bucket is newer than the span. Authors are distinct over all days of a span.
    """
    begin = F.date_sub(last_day, 2 * days - 1)
    held = coverage.groupBy("issuer").agg(
        F.min("day").alias("oldest"),
        F.size(F.collect_set(F.when(F.col("day").between(begin, last_day), F.col("day")))).alias("present"),
        F.size(F.collect_set(F.when(F.col("day").between(begin, last_day) & F.col("adequate"), F.col("day")))).alias("adequate_days"),
    )
    status = F.when(F.col("adequate_days") == 2 * days, "fresh").when((F.col("present") < 2 * days) & (F.col("oldest") > begin), "warm_up").otherwise("coverage_gap")
    day = F.to_date("ts")
    now = day > F.date_sub(last_day, days)
    rows = posts.where(day.between(begin, last_day))
    counts = rows.groupBy("issuer").agg(
        F.countDistinct(F.when(now, F.col("uri"))).alias("posts"), F.countDistinct(F.when(~now, F.col("uri"))).alias("prior_posts"),
        F.countDistinct(F.when(now, F.col("author"))).alias("authors"), F.countDistinct(F.when(~now, F.col("author"))).alias("prior_authors"),
    )
    found = held.select("issuer", "adequate_days", status.alias("status")).join(counts, "issuer", "left")
    inferred = F.col("status") == "fresh"
    zero = lambda c: F.when(inferred, F.coalesce(c, F.lit(0)))
    delta = zero("posts") - zero("prior_posts")
    strength = F.least(F.lit(1.0), F.abs(delta) / F.greatest(zero("prior_posts"), F.lit(1)))
    return found.select("issuer", "status", "adequate_days", *(zero(c).alias(c) for c in ("posts", "prior_posts", "authors", "prior_authors")), strength.alias("strength"))


def retracted(hashes: DataFrame) -> DataFrame:
    """(issuer, day, missing): of each day's hashes how many the next check of that day no longer shows. hashes: issuer, day, check, hash."""
    seen = hashes.groupBy("issuer", "day", "hash").agg(F.max("check").alias("last"))
    by_last = seen.groupBy("issuer", "day", "last").agg(F.count("hash").alias("n"))  # those last seen in the day's last check are still there
    return by_last.groupBy("issuer", "day").agg((F.sum("n") - F.max_by("n", "last")).alias("missing"))
