"""Queries of dossier assembly, with the SQL that gives the same rows. A user is a request, a kind of event a collector's result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import assembly
from ferrule.plans.inputs import AS_OF, EVIDENCE_SQL, as_of, evidence, table
from ferrule.plans.registry import query

TICKER_SQL = """case c_custkey % 12 when 0 then ' t' || c_custkey || '.a ' when 1 then 'T--' || c_custkey when 2 then 'a/b' when 3 then '' when 4 then '  ' when 5 then 'dropx' when 6 then chr(9) || 'TAB'
    when 7 then 'x' || c_custkey || '-b' when 8 then '9AB' when 9 then 'ABCDEFGHIJKLM' when 10 then 'or 1=1' else c_mktsegment end"""


@query(f"""with raw as (select c_custkey, {TICKER_SQL} as t from customer), cut as (select *, upper(trim(t, ' ' || chr(9))) as u from raw)
    select c_custkey, case when not regexp_matches(t, '[\\x00-\\x1f\\x7f]') and not regexp_matches(u, '[/\\\\]|--') and not regexp_matches(lower(u), 'script|exec|union|select|drop|delete|insert|update')
        and regexp_matches(u, '^[A-Z][A-Z0-9.-]{{0,11}}$') then u end as ticker from cut""")
def ticker_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    made = (
        F.concat(F.lit(" t"), k, F.lit(".a ")), F.concat(F.lit("T--"), k), F.lit("a/b"), F.lit(""), F.lit("  "), F.lit("dropx"), F.lit("\tTAB"),
        F.concat(F.lit("x"), k, F.lit("-b")), F.lit("9AB"), F.lit("ABCDEFGHIJKLM"), F.lit("or 1=1"),
    )
    text = F.col("c_mktsegment")
    for i, value in enumerate(made):
        text = F.when(k % 12 == i, value).otherwise(text)
    return table(spark, sf_dir, "customer").select("c_custkey", assembly.ticker(text).alias("ticker"))


@query("""with asked as (select c_custkey, 'T' || (c_custkey % 300) || case when c_custkey % 2 = 0 then '.A' else '' end as ticker from customer),
    known as (select 'T' || s_suppkey || case when s_suppkey % 4 = 0 then '-A' when s_suppkey % 4 = 2 then '.A' else '' end as ticker, s_suppkey from supplier)
    select c_custkey, a.ticker, coalesce(x.s_suppkey, y.s_suppkey) as s_suppkey from asked a left join known x on a.ticker = x.ticker left join known y on replace(a.ticker, '.', '-') = y.ticker""")
def ticker_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("T"), k % 300, F.when(k % 2 == 0, ".A").otherwise("")).alias("ticker"))
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("T"), s, F.when(s % 4 == 0, "-A").when(s % 4 == 2, ".A").otherwise("")).alias("ticker"), "s_suppkey")
    return assembly.by_ticker(asked, known)


@query("""with users as (select distinct user_id as request_id, 'U' || user_id as ticker from events)
    select request_id, ticker, provider, family from users, (values ('sec', 'filings_news', false), ('sec_funds', 'alternative', true), ('gdelt', 'filings_news', true)) as c(provider, family, limited)
    where not limited or (provider = 'sec_funds' and request_id % 5 = 0) or (provider = 'gdelt' and request_id % 3 = 0)""")
def collector_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), F.concat(F.lit("U"), "user_id").alias("ticker")).distinct()
    collectors = spark.createDataFrame([("sec", "filings_news", False), ("sec_funds", "alternative", True), ("gdelt", "filings_news", True)], "provider string, family string, limited boolean")
    limited = users.where("request_id % 5 = 0").select(F.lit("sec_funds").alias("provider"), "ticker").unionByName(users.where("request_id % 3 = 0").select(F.lit("gdelt").alias("provider"), "ticker"))
    return assembly.supported(users, collectors, limited).select("request_id", "ticker", "provider", "family")


PROVIDERS = tuple(assembly.DECISIONS)
RESULTS_SQL = f"""results as (
        select user_id as request_id, hash_free as ordinal, family, case when (user_id + hash_free) % 11 = 0 then 'other' else family end as returned_family,
            ([{", ".join(f"'{p}'" for p in PROVIDERS)}])[((user_id + hash_free) % {len(PROVIDERS)} + 1)::int] as provider,
            case when (user_id + hash_free) % 6 = 1 then 'rate_limited' when (user_id + hash_free) % 6 = 2 then 'unsupported' end as status,
            case when (user_id * 3 + hash_free) % 17 = 0 then family || ' failed: token=abc' || user_id end as error,
            case when user_id % 19 = 0 then 'approved' end as decision, items, user_id % 4 = 0 as degraded
        from (select user_id, case event_type when 'signup' then 'filings_news' when 'purchase' then 'insider_trading' when 'error' then 'options_flow' when 'view' then 'technical' else 'social' end as family,
            length(event_type) as hash_free, count(*) filter (value > 150)::bigint as items from events where value > 20 group by all)
    ), judged as (
        select *, coalesce(decision, {{"sql": 1}}) as d from results
    )""".replace('{"sql": 1}', "case provider " + " ".join(f"when '{k}' then '{v}'" for k, v in assembly.DECISIONS.items()) + " end") + """, flagged as (
        select *, error is null and returned_family <> family as mismatch, error is not null or returned_family <> family as failed,
            not (error is not null or returned_family <> family) and d in ('permission_required', 'licensed_feed_required', 'development_private_only') as refused,
            coalesce(status, case when items > 0 then 'fresh' else 'no_observations' end) as inferred from judged
    ), admitted as (
        select request_id, ordinal, family, provider, items, case when mismatch then 'schema_error' when failed then coalesce(status, 'unavailable')
                when refused and d = 'development_private_only' then case when family = 'options_flow' then 'licensed_feed_required' else 'unavailable' end when refused then d else inferred end as status,
            not failed and not refused as admitted,
            case when failed then 'source_unavailable' when refused then 'source_unsupported' when items = 0 then case inferred when 'no_observations' then 'observed_none' when 'unsupported' then 'source_unsupported' else 'source_unavailable' end end as reason,
            case when error is not null then error when mismatch then provider || ' returned a mismatched family.' when refused and d = 'permission_required' then family || ' provider ' || provider || ' requires permission.'
                when refused and d = 'licensed_feed_required' then family || ' provider ' || provider || ' requires a licensed feed.'
                when refused then family || ' provider ' || provider || ' is private diagnostic only; no production evidence or coverage credit was granted.'
                when degraded then family || ' used degraded provider ' || provider || '.' end as warning,
            case when refused then d end as d from flagged
    )"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.col("event_type")
    named = F.when(family == "signup", "filings_news").when(family == "purchase", "insider_trading").when(family == "error", "options_flow").when(family == "view", "technical").otherwise("social")
    rows = table(spark, sf_dir, "events").where("value > 20").groupBy("user_id", named.alias("family"), F.length("event_type").alias("ordinal")).agg(F.count_if(F.col("value") > 150).alias("items"))
    user, at = F.col("user_id"), F.col("user_id") + F.col("ordinal")
    return rows.select(
        user.alias("request_id"), "ordinal", "family", F.when(at % 11 == 0, "other").otherwise(F.col("family")).alias("returned_family"),
        F.element_at(F.array(*map(F.lit, PROVIDERS)), (at % len(PROVIDERS) + 1).cast("int")).alias("provider"), F.when(at % 6 == 1, "rate_limited").when(at % 6 == 2, "unsupported").alias("status"),
        F.when((user * 3 + F.col("ordinal")) % 17 == 0, F.concat("family", F.lit(" failed: token=abc"), user)).alias("error"), F.when(user % 19 == 0, "approved").alias("decision"), "items", (user % 4 == 0).alias("degraded"),
    )


@query(f"""with {RESULTS_SQL} select request_id, ordinal, family, provider, status, admitted, reason, case when d is not null then d when reason is not null then status end as detail, warning from admitted""")
def policy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.admitted(_results(spark, sf_dir)).select("request_id", "ordinal", "family", "provider", "status", "admitted", "reason", "detail", "warning")


@query(f"""with {EVIDENCE_SQL}, {RESULTS_SQL}, users as (select distinct user_id as request_id from events),
    kept as (select request_id, family, confidence - 0.2 as confidence from evidence where ts >= timestamp '{AS_OF}' - interval 2 days), stale as (select distinct request_id, family from evidence where ts < timestamp '{AS_OF}' - interval 25 days),
    wanted as (select request_id, family from users, (values {", ".join(f"('{f}')" for f in assembly.EXPECTED)}) as e(family)),
    by_family as (select request_id, family, array_to_string(list_sort(list(distinct provider)), ', ') as providers, bool_or(not admitted and reason = 'source_unavailable') as failed from admitted group by all),
    said as (
        select request_id, 1 as step, lpad(ordinal::varchar, 12, '0') as o, regexp_replace(warning, '(?i)\\b(api[_-]?key|token|authorization|password|cookie)\\s*[=:]\\s*\\S+', '\\1=[redacted]', 'g') as text from admitted where warning is not null
        union all select w.request_id, 2, w.family, case when providers is null then w.family || ' is unconfigured; expected ' || case w.family {" ".join(f"when '{k}' then '{v}'" for k, v in assembly.EXPECTED_PROVIDERS.items())} else 'a configured provider' end || ' and has no fresh evidence.'
                when not failed then w.family || ' has no fresh evidence from ' || providers || '.' end from wanted w left join by_family b on w.request_id = b.request_id and w.family = b.family
            where not exists (from kept k where k.request_id = w.request_id and k.family = w.family)
        union all select request_id, 3, family, family || ' contained evidence older than the lookback window.' from stale
        union all select distinct request_id, 4, family, family || ' contains evidence with confidence below 0.50.' from kept where confidence < 0.5
        union all select request_id, 5, '', 'Overall confidence is below 0.50.' from users where request_id % 3 = 0
    ), firsts as (select * from said where text is not null qualify row_number() over (partition by request_id, text order by step, o, text) = 1)
    select u.request_id, coalesce((select list(text order by step, o, text) from firsts f where f.request_id = u.request_id), [])[:18] || {list(assembly.CAVEATS)!r} as warnings from users u""")
def warning_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = evidence(spark, sf_dir).withColumn("confidence", F.col("confidence") - 0.2)
    users = items.select("request_id").distinct()
    fresh = items.where(F.col("ts") >= as_of() - F.make_dt_interval(F.lit(2)))
    stale = items.where(F.col("ts") < as_of() - F.make_dt_interval(F.lit(25)))
    whole = users.withColumn("confidence", F.when(F.col("request_id") % 3 == 0, 0.4).otherwise(0.6))
    return assembly.dossier_warnings(users, assembly.admitted(_results(spark, sf_dir)), fresh, stale, whole)


@query(f"""with {RESULTS_SQL} select distinct request_id, provider as source_id, 'The GDELT Project' as name, 'https://www.gdeltproject.org/' as url from admitted where admitted and provider = 'gdelt'""")
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = assembly.admitted(_results(spark, sf_dir)).where("admitted")
    return assembly.attributions(used.select("request_id", F.col("provider").alias("source_id")))


@query(f"""with {EVIDENCE_SQL} select ordinal, case when ordinal % 4 = 0 then 'clm_' || ordinal else 'candidate_' || sha256(family || chr(31) || signal || chr(31) || strftime(ts, '%Y-%m-%dT%H:%M:%S')
    || case when microsecond(ts) % 1000000 = 0 then '' else strftime(ts, '.%f') end || '+00:00' || chr(31) || case when ordinal % 3 = 0 then '' else 'r' || ordinal end) end as scope_id from evidence""")
def candidate_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("ordinal")
    claim, record = F.when(n % 4 == 0, F.concat(F.lit("clm_"), n)), F.when(n % 3 != 0, F.concat(F.lit("r"), n))
    return evidence(spark, sf_dir).select("ordinal", assembly.scope_id(claim, F.col("family"), F.col("signal"), F.col("ts"), record).alias("scope_id"))


SOURCES_SQL = f"""{EVIDENCE_SQL}, sources as (
        select request_id, ordinal as item, family, case when ordinal % 9 = 0 then 'financing' else signal end as signal, direction,
            ([null, 'sec', 'issuer_feed', 'gdelt', 'user_ohlc', '', 'bluesky'])[(ordinal % 7 + 1)::int] as source_id,
            (['SEC EDGAR', 'FMP news', 'Finnhub x', 'FlowAlgo', 'yfinance chain snapshot', 'Other'])[(ordinal % 6 + 1)::int] as source_name,
            case when ordinal % 5 = 0 then 'approved' else 'approved_discovery' end as decision from evidence where ts >= timestamp '{AS_OF}' - interval 3 days
    ), named as (select *, case when coalesce(source_id, '') <> '' then source_id else case when source_name = 'SEC EDGAR' then 'sec' when source_name like 'FMP %' then 'fmp' when source_name like 'Finnhub %' then 'finnhub'
            when source_name = 'FlowAlgo' then 'flowalgo' when source_name like 'yfinance%' then 'yfinance' end end as provider, coalesce(source_id = 'sec', false) or source_name = 'SEC EDGAR' as sec from sources)"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("ordinal")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    items = evidence(spark, sf_dir).where(F.col("ts") >= as_of() - F.make_dt_interval(F.lit(3)))
    return items.select(
        "request_id", n.alias("item"), "family", F.when(n % 9 == 0, "financing").otherwise(F.col("signal")).alias("signal"), "direction",
        pick((None, "sec", "issuer_feed", "gdelt", "user_ohlc", "", "bluesky")).alias("source_id"), pick(("SEC EDGAR", "FMP news", "Finnhub x", "FlowAlgo", "yfinance chain snapshot", "Other")).alias("source_name"),
        F.when(n % 5 == 0, "approved").otherwise("approved_discovery").alias("decision"),
    )


@query(f"""with {SOURCES_SQL}, judged as (select *, direction <> 'neutral' and ((family = 'insider_trading' and sec) or coalesce(family = 'filings_news' and source_id in ('sec', 'issuer_feed') and signal = 'financing', false)
        or coalesce(decision = 'approved' and source_id not in ('sec', 'gdelt', 'bluesky', 'mastodon'), false)) as directional from named)
    select request_id, bool_or(sec) as sec_provenance, bool_or(directional) as fresh_directional, coalesce(list_sort(list(distinct provider) filter (directional and provider is not null)), []) as directional_providers,
        bool_or(sec) and bool_or(directional) as ready from judged group by 1""")
def launch_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.readiness(_sources(spark, sf_dir))


@query(f"""with {SOURCES_SQL}, {RESULTS_SQL}, configured as (select distinct request_id, provider, family from admitted), counts as (select request_id, provider, count(distinct item) as n from named group by all),
    each as (select request_id, provider, list_sort(list(distinct family)) as families from configured group by all)
    select request_id, provider, families, case when coalesce(n, 0) > 0 then 'fresh_evidence' else 'no_fresh_evidence' end as status, coalesce(n, 0) as evidence_count from each left join counts using (request_id, provider)""")
def provider_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.provider_status(_results(spark, sf_dir).select("request_id", "provider", "family"), _sources(spark, sf_dir))


@query("""select event_id, format('{:,}', round_even(value * 1000 - 100000, 0)::bigint) as whole, format('{:+.3f}', value / 7 - 30) as change from events""")
def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", assembly.amount(F.col("value") * 1000 - 100000).alias("whole"), assembly.signed(F.col("value") / 7 - 30).alias("change"))
