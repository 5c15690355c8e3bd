"""Queries of filing context, failures, cached views, registries, daily buckets and confirmations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import collectors, quality
from ferrule.plans.inputs import AS_OF, as_of, table
from ferrule.plans.registry import query


def _values(rows) -> str:
    text = lambda v: "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


_ITEMS = _values((code, i, *collectors.ITEM_CONTEXT[code]) for i, code in enumerate(collectors.ITEM_PRIORITY, 10))
_FORMS = _values((form, *values) for form, values in collectors.FORM_CONTEXT.items())


@query(f"""with filings as (select o_orderkey, coalesce(list('' || (1 + (l_partkey + l_linenumber) % 9) || '.0' || (1 + l_suppkey % 3)) filter (l_quantity > 20), []) as codes,
        ['8-K', '6-K', '10-Q', '10-K/A', 'SC 13D'][1 + o_orderkey % 5] as form from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey),
    items(code, place, type, label, why, materiality) as (values {_ITEMS}), forms(base, type, label, why, materiality) as (values {_FORMS}),
    each_code as (select o_orderkey, unnest(case when list_has_all(codes, ['2.01', '3.01', '5.01']) then list_filter(codes, lambda c: c <> '3.01') else codes end) as code from filings),
    firsts as (select o_orderkey, arg_min(code, place) as code from each_code join items using (code) group by 1)
    select f.o_orderkey, coalesce(i.type, b.type, 'sec_filing') as type, coalesce(i.label, b.label, 'SEC ' || replace(form, '/A', '')) as label,
        coalesce(i.why, b.why, 'The filing updates the issuer''s primary regulatory record.') as why, coalesce(i.materiality, b.materiality, 'contextual') as materiality,
        case when form like '%/A' then 'amendment' else 'new_event' end as novelty
    from filings f left join firsts using (o_orderkey) left join items i on i.code = firsts.code left join forms b on i.code is null and b.base = replace(form, '/A', '')""")
def filing_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a filing, its larger lines are item codes."""
    code = F.concat(1 + (F.col("l_partkey") + F.col("l_linenumber")) % 9, F.lit(".0"), 1 + F.col("l_suppkey") % 3)
    codes = table(spark, sf_dir, "lineitem").where("l_quantity > 20").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(code).alias("codes"))
    filings = table(spark, sf_dir, "orders").select("o_orderkey").join(codes, "o_orderkey", "left")
    form = F.element_at(F.array(*map(F.lit, ("8-K", "6-K", "10-Q", "10-K/A", "SC 13D"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return filings.select("o_orderkey", collectors.filing_context(form, F.col("codes")).alias("context")).select("o_orderkey", "context.*")


@query("""with calls as (select event_id, ['status', 'timeout', 'schema', 'no_file', 'transport', 'other'][1 + event_id % 6] as kind, [401, 403, 404, 429, 500][1 + event_id // 6 % 5] as code from events)
    select event_id, case when kind = 'status' and code = 429 then 'rate_limited' when kind = 'status' and code < 404 then 'permission_required' when kind = 'timeout' then 'timeout'
        when kind = 'schema' then 'schema_error' else 'unavailable' end as request_status,
        case when kind = 'status' and code = 429 then 'rate_limited' when kind = 'status' and code < 404 then 'permission_required' when kind = 'timeout' then 'timeout'
        when kind = 'schema' then 'schema_error' when kind = 'other' then 'unavailable' else 'stale' end as refresh_status,
        case when kind = 'timeout' then kind else 'unavailable' end as named_status from calls""")
def failure_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("status", "timeout", "schema", "no_file", "transport", "other"))), (n % 6 + 1).cast("int"))
    code = F.element_at(F.array(*map(F.lit, (401, 403, 404, 429, 500))), (F.floor(n / 6) % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", collectors.failure_status(kind, code).alias("request_status"), collectors.failure_status(kind, code, refresh=True).alias("refresh_status"),
        collectors.known_status(kind).alias("named_status"),
    )


@query(f"""with checks as (select user_id as issuer, max(ts) as checked, max(ts) filter (event_type <> 'error' and user_id % 5 > 0) as succeeded, arg_max(event_type, event_id) as last from events where user_id % 7 < 6 group by 1),
    states as (select *, case when last = 'error' then 'timeout' when last = 'click' then 'odd' when last = 'view' then null else 'fresh' end as status, case when issuer % 2 = 0 then 'TimeoutError' end as error_class,
        floor(epoch(timestamp '{AS_OF}' - succeeded))::bigint as age from checks),
    judged as (select *, case when (succeeded is null or checked > succeeded) and coalesce(status, '') <> 'fresh' then 'failed' when succeeded is null then 'never_refreshed' when age > 21600 then 'stale' else 'fresh' end as freshness,
        case status when 'timeout' then 'timeout' when 'fresh' then 'fresh' when 'odd' then 'unavailable' else 'stale' end as failed from states)
    select issuer, freshness, freshness <> 'fresh' as degraded, case freshness when 'failed' then failed when 'fresh' then null else 'stale' end as served_status,
        case freshness when 'failed' then 'Background refresh failed with ' || coalesce(error_class, 'unknown error') || ' (' || failed || ')' || coalesce('; last success was ' || age || ' seconds ago', '; no successful refresh has completed') || '.'
            when 'stale' then 'Background cache is stale; last successful refresh was ' || age || ' seconds ago.' when 'never_refreshed' then 'Background refresh has not completed a successful refresh.' end as warning from judged""")
def cached_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is an issuer, whose events are checks of its collector."""
    last = F.max_by("event_type", "event_id")
    good = (F.col("event_type") != "error") & (F.col("user_id") % 5 > 0)
    status = F.when(last == "error", "timeout").when(last == "click", "odd").when(last != "view", "fresh")
    states = table(spark, sf_dir, "events").where("user_id % 7 < 6").groupBy(F.col("user_id").alias("issuer")).agg(
        F.max("ts").alias("last_checked_at"), F.max(F.when(good, F.col("ts"))).alias("last_success_at"), status.alias("status")
    )
    states = states.withColumn("error_class", F.when(F.col("issuer") % 2 == 0, "TimeoutError"))
    return collectors.cached_view(quality.freshness(states, as_of(), 21600)).select("issuer", "freshness", "degraded", "served_status", "warning")


@query("""with days as (select user_id % 20 as issuer, event_type as source_id, ts::date as day, count(*) as posts, count(distinct user_id) as authors from events where user_id % 3 > 0 group by all),
    old as (select *, 1.0::double as coverage, 'adequate' as coverage_state from days),
    fresh as (select distinct issuer, source_id, date '2024-01-20' as day, 0::bigint as posts, 0::bigint as authors, 0.0::double as coverage, case when source_id = 'error' then 'timeout' else 'unavailable' end as coverage_state from old where source_id in ('error', 'view'))
    select issuer, source_id, day::varchar as day, posts, authors, coverage, coverage_state from (from old anti join fresh using (issuer, source_id, day) union all from fresh) as b
    where source_id not in ('error', 'view') or day >= date '2024-01-07'""")
def bucket_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two collectors fail on one day, whose buckets give way to empty ones."""
    days = table(spark, sf_dir, "events").where("user_id % 3 > 0").groupBy((F.col("user_id") % 20).alias("issuer"), F.col("event_type").alias("source_id"), F.to_date("ts").alias("day"))
    old = days.agg(F.count("*").alias("posts"), F.count_distinct("user_id").alias("authors")).select("*", F.lit(1.0).alias("coverage"), F.lit("adequate").alias("coverage_state"))
    failed = old.where("source_id in ('error', 'view')").select("issuer", "source_id", F.lit("2024-01-20").cast("date").alias("day")).distinct()
    new = collectors.failed_day(failed, F.when(F.col("source_id") == "error", "timeout").otherwise("odd"))
    return collectors.replace_days(old, new).withColumn("day", F.col("day").cast("string"))


@query("""with issuers as (select n_nationkey::varchar as issuer, list(s_name order by s_suppkey) as aliases, list('T' || s_suppkey order by s_suppkey) as tickers, '2026-01-0' || (1 + n_nationkey % 9) as reviewed_on
        from nation join supplier on s_nationkey = n_nationkey group by n_nationkey),
    ruled as (select *, list_transform(range(1, len(aliases) + 1), lambda i: {'alias': aliases[i], 'alias_kind': 'legal_name', 'canonical_cik': issuer, 'match_mode': 'phrase', 'negative_context': []::varchar[],
        'required_context': []::varchar[], 'review_note': 'Registry v1 compatibility rule.', 'reviewed_on': reviewed_on, 'rule_id': 'legacy_alias_' || i, 'valid_from': null::varchar, 'valid_to': null::varchar, 'version': '1'}) as rules from issuers)
    select issuer, len(rules) as rules, tickers[1] as default_ticker, 'entity-rules-v2:' || sha256('{"decision_version":"title-alignment-v1","rules":' || to_json(rules)::varchar || '}') as version,
        case when len(aliases) = 1 then '"' || aliases[1] || '"' else '("' || array_to_string(aliases, '" OR "') || '")' end as news_query,
        '$' || array_to_string(tickers, ' | $') || ' | "' || array_to_string(aliases, '" | "') || '"' as social_query from ruled""")
def issuer_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation is an issuer, its suppliers are its aliases and tickers."""
    both = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("s"))
    issuers = table(spark, sf_dir, "nation").join(both, "n_nationkey").select(
        F.col("n_nationkey").cast("string").alias("issuer"), F.col("s.s_name").alias("aliases"), F.transform("s.s_suppkey", lambda k: F.concat(F.lit("T"), k)).alias("tickers"),
        F.concat(F.lit("2026-01-0"), 1 + F.col("n_nationkey") % 9).alias("reviewed_on"),
    )
    return collectors.effective_rules(issuers).select(
        "issuer", F.size("rules").cast("long").alias("rules"), F.get("tickers", F.lit(0)).alias("default_ticker"), collectors.ruleset_version(F.col("rules")).alias("version"),
        collectors.news_query(F.col("aliases")).alias("news_query"), collectors.social_query(F.col("tickers"), F.col("aliases")).alias("social_query"),
    )


@query("""select user_id, 'https://example.org/' || (event_id % 7) as url, arg_max(event_type, event_id) as title, max(event_id) as ordinal from events group by all""")
def last_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("https://example.org/"), F.col("event_id") % 7).alias("url"), F.col("event_type").alias("title"), F.col("event_id").alias("ordinal"))
    return collectors.last_by(rows.withColumn("_at", F.col("ordinal")), ["user_id", "url"], "_at").drop("_at")


@query("""with pending as (select md5('' || user_id % 97) as email, user_id as visitor, ts, event_id as ordinal, case when event_id % 11 = 0 then 'qa' end as excluded_reason, case when event_id % 3 = 0 then ts end as linked_at from events where event_type = 'signup'),
    confirmed as (select email, arg_min(case when excluded_reason is not null then 'excluded' when linked_at is not null then 'linked' else 'unlinked' end, ordinal) as place, arg_min(visitor, ordinal) as visitor,
        arg_min(ts, ordinal) as ts, count(*) - 1 as repeats from (select email, visitor, ts, excluded_reason, linked_at, row_number() over (order by ts, ordinal) as ordinal from pending) as p group by 1),
    reports as (select user_id as visitor, min(ts) as reported from events where event_type = 'purchase' group by 1),
    met as (select c.*, coalesce(c.ts <= reported, false) as earlier from confirmed c left join reports using (visitor))
    select email, case when earlier and place = 'unlinked' and row_number() over (partition by visitor, earlier order by ts desc, email desc) = 1 then 'linked' else place end as place, visitor, repeats from met""")
def confirmation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups are pending confirmations, purchases are activation reports."""
    events, n = table(spark, sf_dir, "events"), F.col("event_id")
    pending = events.where("event_type = 'signup'").select(
        F.md5((F.col("user_id") % 97).cast("string")).alias("email"), F.col("user_id").alias("visitor"), "ts", n.alias("ordinal"), F.when(n % 11 == 0, "qa").alias("excluded_reason"), F.when(n % 3 == 0, F.col("ts")).alias("linked_at")
    )
    reports = events.where("event_type = 'purchase'").select(F.col("user_id").alias("visitor"), "ts")
    return collectors.linked(collectors.confirmations(pending), reports).drop("ts")
