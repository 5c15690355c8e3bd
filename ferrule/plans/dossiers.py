"""Queries of scores, selections and the quality of dossiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.operators import evidence as ev
from ferrule.operators import quality, score, synthesis
from ferrule.plans.inputs import AS_OF, EVIDENCE_SQL, LOOKBACK, as_of, evidence, table
from ferrule.plans.registry import query

#: Contributions of the items inside the lookback, in SQL.
SCORED_SQL = f"""
    with {EVIDENCE_SQL}, inside as (
        select *, greatest(0.0, epoch(timestamp '{AS_OF}' - ts)::double / 86400) as age,
            case direction when 'bullish' then 1.0::double when 'bearish' then -1.0::double else 0.0::double end as polarity,
            case family when 'filings_news' then 16.0::double when 'insider_trading' then 12 when 'options_flow' then 10 when 'technical' then 6 when 'social' then 4 else 3 end as weight
        from evidence where ts >= timestamp '{AS_OF}' - interval {LOOKBACK} days
    ), raws as (
        select *, polarity * strength * confidence * quality * greatest(0.0::double, 1 - age / {LOOKBACK}) as raw from inside
    ), sums as (
        select *, sum(raw) over (partition by request_id, family) as family_raw from raws
    ), scored as (
        select *, least(1.0, greatest(-1.0, family_raw)) * weight as family_points,
            case when family_raw = 0 then raw * weight else raw * (least(1.0, greatest(-1.0, family_raw)) * weight / family_raw) end as contribution
        from sums
    )
"""


def inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.within_lookback(evidence(spark, sf_dir), as_of(), LOOKBACK)[0]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.contributions(inside(spark, sf_dir), as_of(), LOOKBACK)


@query(f"""{SCORED_SQL}, families as (
        select request_id, family, any_value(family_points) as points, sum(strength) as strength, sum(strength * confidence * quality) as trust,
            max((direction <> 'neutral')::int) as directional, count(*) as items
        from scored group by all
    ), folded as (
        select request_id, sum(points) as points, sum(strength) as strength, sum(trust) as trust, sum(directional) as directional,
            count(*) as families, sum(items)::bigint as items,
            greatest(0.60::double, 1 - 0.15::double * (2 - count(*) filter (family in ('filings_news', 'insider_trading')))
                - 0.05::double * (3 - count(*) filter (family in ('options_flow', 'technical', 'social')))) as coverage
        from families group by 1
    ), final as (
        select *, round_even(least(100.0, greatest(0.0, 50 + points * coverage)), 0)::int as score from folded
    )
    select request_id, score, case when score >= 55 then 'bullish' when score <= 45 then 'bearish' else 'neutral' end as direction,
        round_even(least(0.95, trust / strength * (0.55 + 0.25 * families / 5.0 + 0.20 * least(1.0, directional / 3.0))), 4)::double as confidence,
        round(coverage, 4) as coverage, families, items
    from final""")
def dossier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score.scores(inside(spark, sf_dir), as_of(), LOOKBACK)
    return found.withColumn("coverage", F.round("coverage", 4))


def _six(name: str) -> str:
    """Six places in SQL, where what rounds to zero has no sign, as in Spark."""
    return f"case when round({name}, 6) = 0 then 0::double else round({name}, 6) end as {name}"


@query(f"{SCORED_SQL} select request_id, ordinal, family, {_six('raw')}, {_six('family_points')}, {_six('contribution')} from scored")
def family_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.round(c, 6).alias(c) for c in ("raw", "family_points", "contribution")]
    return scored(spark, sf_dir).select("request_id", "ordinal", "family", *columns)


@query(f"""with {EVIDENCE_SQL} select request_id, count(*) as outside, max(ts) as newest, list_sort(list_distinct(list(family))) as stale_families
    from evidence where ts < timestamp '{AS_OF}' - interval 20 days group by 1""")
def stale_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shorter lookback of 20 days leaves out marks its families stale."""
    old = score.within_lookback(evidence(spark, sf_dir), as_of(), 20)[1]
    return old.groupBy("request_id").agg(F.count("*").alias("outside"), F.max("ts").alias("newest"), F.array_sort(F.collect_set("family")).alias("stale_families"))


@query(f"""with {EVIDENCE_SQL}, coarse as (select * replace (date_trunc('day', ts) as ts) from evidence)
    select request_id, ordinal, family, signal, ts from coarse
    qualify row_number() over (partition by request_id, family, signal, ts, rtrim(source_url, '/') order by ordinal) = 1""")
def evidence_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = evidence(spark, sf_dir).withColumn("ts", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return ev.first_of_each(coarse).select("request_id", "ordinal", "family", "signal", "ts")


def _swap_sql(source: str, keys: str, most: int, tie: str, rank: str) -> str:
    """A selection with a contradicting item, in SQL."""
    return f"""
        {rank}_ranked as (
            select *, row_number() over (partition by {keys} order by abs(contribution) desc, ts desc, {tie}) as {rank},
                case when direction <> 'neutral' then direction end as d from {source}
        ), {rank}_facts as (
            select *, count(distinct d) over (partition by {keys}) as n_all,
                count(distinct case when {rank} <= {most} then d end) over (partition by {keys}) as n_top,
                min(case when {rank} <= {most} then d end) over (partition by {keys}) as top from {rank}_ranked
        ), {rank}_other as (
            select *, min(case when d <> top then {rank} end) over (partition by {keys}) as other from {rank}_facts
        ), {rank}_kept as (
            select * exclude (d, n_all, n_top, top, other) from {rank}_other
            where case when n_all = 2 and n_top = 1 then {rank} < {most} or {rank} = other else {rank} <= {most} end
        )"""


ROUNDED_SQL = "rounded as (select * replace (round(contribution, 9) as contribution) from scored)"
FAMILY_SQL = _swap_sql("rounded", "request_id, family", ev.PER_FAMILY, "ordinal", "family_rank")


def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions rounded, so that engines that sum in another order rank alike."""
    return scored(spark, sf_dir).withColumn("contribution", F.round("contribution", 9))


@query(f"{SCORED_SQL}, {ROUNDED_SQL}, {FAMILY_SQL} select request_id, family, ordinal, direction, family_rank from family_rank_kept")
def compact_topk_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.compact_families(rounded(spark, sf_dir))
    return found.select("request_id", "family", "ordinal", "direction", F.col("family_rank").cast("long").alias("family_rank"))


@query(f"""{SCORED_SQL}, {ROUNDED_SQL}, {FAMILY_SQL}, {_swap_sql("family_rank_kept", "request_id", 4, "family_rank, ordinal", "dossier_rank")}
    select request_id, family, ordinal, direction, dossier_rank from dossier_rank_kept""")
def compact_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dossiers of four items, few enough that some lose a direction and get it back."""
    found = ev.compact_dossier(ev.compact_families(rounded(spark, sf_dir)), 4)
    return found.select("request_id", "family", "ordinal", "direction", F.col("dossier_rank").cast("long").alias("dossier_rank"))


STATUSES = ("no_observations", "timeout", "unsupported", "rate_limited", "schema_error")
STATUS_SQL = f"""
    with {EVIDENCE_SQL}, inside as (select * from evidence where ts >= timestamp '{AS_OF}' - interval 1 days),
    requests as (select distinct request_id from evidence),
    wanted as (select request_id, family from requests, (values ('filings_news'), ('insider_trading'), ('options_flow'), ('technical'), ('social')) as f(family)),
    seen as (select request_id, family, max(ts) as observed_at from inside group by all),
    polled as (
        select request_id, family, ordinal, ['no_observations', 'timeout', 'unsupported', 'rate_limited', 'schema_error'][(ordinal % 5 + 1)::int] as status
        from evidence where ordinal % 11 = 0
    ), worst as (
        select request_id, family, status as worst from polled qualify row_number() over (partition by request_id, family order by
            case status when 'rate_limited' then 7 when 'timeout' then 6 when 'schema_error' then 5 else 3 end desc, ordinal) = 1
    ), statuses as (
        select request_id, family, observed_at is not null as available,
            case when observed_at is not null then 'fresh' else coalesce(worst, case when family in ('options_flow', 'technical') then 'licensed_feed_required' else 'no_observations' end) end as status,
            observed_at, (observed_at is not null)::int::double as coverage_ratio
        from wanted left join seen using (request_id, family) left join worst using (request_id, family)
    )
"""


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_items = evidence(spark, sf_dir)
    polled = all_items.where("ordinal % 11 = 0").withColumn("status", F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("ordinal") % 5 + 1).cast("int")))
    recent = score.within_lookback(all_items, as_of(), 1)[0]
    return quality.family_statuses(all_items.select("request_id").distinct(), recent, polled)


@query(f"""{STATUS_SQL} select *, case when available then 'fresh_evidence'
        when family = 'options_flow' and status = 'licensed_feed_required' then 'licensed_transaction_feed_required'
        when family = 'technical' and status = 'licensed_feed_required' then 'licensed_ohlc_feed_required' else status end as reason
    from statuses""")
def family_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir)


@query(f"""{STATUS_SQL} select request_id, case when count(*) filter (available) = 0 then 'none' when count(*) filter (available) = 5 then 'complete' else 'partial' end as coverage,
    coalesce(list_sort(list(family) filter (not available)), []) as missing_families from statuses group by 1""")
def dossier_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.dossier_coverage(_statuses(spark, sf_dir))


@query(f"""with parts as (
        select user_id as request_id, case event_type when 'error' then 'source_unavailable' when 'view' then 'observed_none' else 'discovery_only' end as code,
            'source' as scope, 'src_' || (event_id % 5) as scope_id, null::varchar as source_id, event_type as family,
            date_trunc('day', ts)::timestamp as observed_at, null::varchar as detail from events
    ), ided as (
        select distinct request_id, code, scope, scope_id, case code when 'source_unavailable' then 10 when 'observed_none' then 40 else 50 end as precedence,
            'rsn_' || sha256(code || chr(31) || scope || chr(31) || scope_id || chr(31) || '' || chr(31) || family || chr(31)
                || strftime(observed_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' || chr(31) || '') as reason_id from parts
    ), placed as (
        select *, row_number() over (partition by request_id order by precedence, code, scope, scope_id, reason_id) as place, count(*) over (partition by request_id) as total from ided
    ) select request_id, reason_id, code, scope_id, place, total, total > 20 as truncated from placed where place <= 20""")
def reason_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("request_id"), F.when(kind == "error", "source_unavailable").when(kind == "view", "observed_none").otherwise("discovery_only").alias("code"),
        F.lit("source").alias("scope"), F.concat(F.lit("src_"), F.col("event_id") % 5).alias("scope_id"), F.lit(None).cast("string").alias("source_id"),
        kind.alias("family"), F.date_trunc("day", "ts").alias("observed_at"), F.lit(None).cast("string").alias("detail"),
    )
    found = quality.ordered_reasons(quality.reasons(rows), 20)
    return found.select("request_id", "reason_id", "code", "scope_id", F.col("place").cast("long").alias("place"), "total", "truncated")


@query("""with states as (
        select user_id, max(ts) as last_checked_at, max(case when event_type <> 'error' then ts end) as last_success_at,
            case when max_by(event_type, ts) = 'error' then 'timeout' else 'fresh' end as status from events group by 1
    ), aged as (
        select *, greatest(0, floor(epoch(timestamp '2024-01-31 00:00:00' - last_success_at)))::bigint as last_success_age_seconds from states
    ) select *, case when last_checked_at is not null and (last_success_at is null or last_checked_at > last_success_at) and status not in ('fresh', 'no_observations') then 'failed'
        when last_success_at is null then 'never_refreshed' when last_success_age_seconds > 172800 then 'stale' else 'fresh' end as freshness from aged""")
def freshness_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by("event_type", "ts")
    states = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.max("ts").alias("last_checked_at"), F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("last_success_at"), F.when(last == "error", "timeout").otherwise("fresh").alias("status")
    )
    return quality.freshness(states, as_of(), 172800)


@query("""with parts as (select user_id, ts >= timestamp '2024-01-16' as late, max(ts) as checked, max(case when event_type <> 'error' then ts end) as succeeded,
        case when max_by(event_type, ts) = 'error' then 'timeout' end as error_class from events group by all),
    old as (select * from parts where not late), new as (select * from parts where late)
    select user_id, coalesce(n.checked, o.checked) as checked, coalesce(n.succeeded, o.succeeded) as succeeded, coalesce(n.error_class, o.error_class) as error_class
    from old o full join new n using (user_id)""")
def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00"))
    state = lambda rows: rows.groupBy("user_id").agg(
        F.max("ts").alias("checked"), F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("succeeded"), F.when(F.max_by("event_type", "ts") == "error", "timeout").alias("error_class")
    )
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    return quality.merge_state(state(events.where(~late)), state(events.where(late)), ["user_id"])


@query("""select role, regexp_replace(left(regexp_replace(text, '(?i)\\b(api[_-]?key|token|authorization|password|cookie)\\s*[=:]\\s*\\S+', '\\1=[redacted]', 'g'), 240), '\\s', ' ', 'g') as warning,
    conv_id, turn from (select * replace (regexp_replace(text, '[\\p{Cc}\\p{Cf}\\p{Zl}\\p{Zp}]', '', 'g') as text) from conversations)""")
def warning_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.functions.text import sanitize_warning

    clean = F.regexp_replace(sanitize_warning(F.col("text")), r"\s", " ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", clean.alias("warning"))


@query(f"""{SCORED_SQL} select request_id, family, ordinal, round(sum(contribution) over (partition by request_id order by ts, ordinal rows unbounded preceding), 5) as running
    from scored where family = 'insider_trading'""")
def contribution_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: how a request's insider contribution builds up over time."""
    order = Window.partitionBy("request_id").orderBy("ts", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    rows = scored(spark, sf_dir).where("family = 'insider_trading'")
    return rows.select("request_id", "family", "ordinal", F.round(F.sum("contribution").over(order), 5).alias("running"))


@query(f"""{SCORED_SQL}, {ROUNDED_SQL}, {FAMILY_SQL}, {_swap_sql("family_rank_kept", "request_id", ev.PER_DOSSIER, "family_rank, ordinal", "dossier_rank")}, told as (
        select request_id, ordinal, family, direction, ts, row_number() over (partition by request_id order by abs(contribution) desc, ts desc, ordinal) as place,
            case family when 'filings_news' then 'Filings and news' when 'insider_trading' then 'Insider activity' when 'options_flow' then 'Options activity'
                when 'technical' then 'Technical transitions' else 'Social attention' end as label,
            label || ' changed during the requested window.' as text,
            case family when 'filings_news' then 'A later SEC amendment or issuer-primary disclosure changes the filed facts.'
                when 'options_flow' then 'Options activity normalizes during the requested horizon.'
                when 'technical' then 'The observed technical transition reverses on daily data.'
                when 'social' then 'Attention or sentiment normalizes during the next comparison window.'
                else 'A later primary-source record changes the normalized facts.' end as invalid,
            case when family = 'filings_news' then 'Open SEC accession ' || ordinal || ' and review the filed item text and exhibits.' end as checked
        from dossier_rank_kept
    ), leader as (
        select request_id, arg_min(direction, place) as leader from told where direction <> 'neutral' group by 1
    ), opposed as (
        select request_id, arg_min(text, place) as other_text, arg_min(direction, place) as other from told join leader using (request_id)
        where direction <> 'neutral' and direction <> leader group by 1
    ), grouped as (
        select request_id, arg_min(label, place) as label, arg_min(text, place) as text, arg_min(invalid, place) as invalid, list(text order by place) as texts,
            arg_max(label, (ts, -ordinal)) as new_label, arg_max(text, (ts, -ordinal)) as new_text, max(ts) as new_ts, max((family <> 'filings_news')::int) as beyond,
            coalesce(list(checked order by ts desc, ordinal) filter (checked is not null), []) as singles
        from told group by 1
    ), requests as (
        select request_id, ['research', 'alert_triage', 'thesis_review'][(request_id % 3 + 1)::int] as mode,
            list_sort(list_filter(['filings_news', 'insider_trading', 'options_flow', 'technical', 'social'], lambda f: not list_contains(list(family), f))) as missing
        from (select * from evidence where ts >= timestamp '{AS_OF}' - interval {LOOKBACK} days) group by 1
    ), ready as (
        select *, array_to_string(missing, ', ') as lacking from requests join grouped using (request_id) left join opposed using (request_id)
    )
    select request_id,
        case mode when 'alert_triage' then new_label || ': ' || new_text || ' Observed ' || strftime(new_ts, '%Y-%m-%dT%H:%M:%S') || case when strftime(new_ts, '%f') = '000000' then '' else '.' || strftime(new_ts, '%f') end || '+00:00.'
            when 'thesis_review' then 'Thesis-review evidence — ' || label || ': ' || text else label || ': ' || text end as headline,
        list_slice(list_concat(list_slice(list_filter(texts, lambda x, i: list_position(texts, x) = i), 1, 4),
            case when other is not null then ['Conflicting evidence: ' || other_text] when lacking <> '' then ['Missing confirmation: ' || lacking || '.'] else [] end), 1, 5) as what_changed,
        'The leading observation is the strongest normalized change in the current window.'
            || coalesce(' Conflicting ' || other || ' evidence is also present: ' || other_text, '')
            || case when lacking <> '' then ' Confidence remains constrained by missing ' || lacking || '.' else '' end as why_it_matters,
        list_filter([invalid, 'The conflicting ' || other || ' observation becomes the better-supported primary-source account.',
            case when lacking <> '' then 'Obtain missing confirmation from ' || lacking || '.' end,
            case when beyond = 1 then 'A sector-wide event fully explains the ticker-specific observations.' end], lambda x: x is not null) as what_would_invalidate,
        list_slice(list_concat(list_slice(singles, 1, 3), list_filter([
            case when other is not null then 'Resolve conflicting evidence against the highest-tier primary source.' end,
            'Check whether a sector-wide event explains the observation.',
            case mode when 'thesis_review' then 'Compare the evidence with the prior thesis invalidation criteria.'
                when 'alert_triage' then 'Confirm the newest event timestamp before escalating the alert.' end], lambda x: x is not null)), 1, 5) as next_checks
    from ready""")
def dossier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of each dossier, over the items that its selection keeps; risk modes take turns."""
    kept = ev.compact_dossier(ev.compact_families(rounded(spark, sf_dir)))
    items = kept.withColumns({"record_id": F.col("ordinal").cast("string"), "has_sources": F.lit(True)})
    modes = F.array(F.lit("research"), F.lit("alert_triage"), F.lit("thesis_review"))
    expected = F.array(*map(F.lit, score.EXPECTED))
    requests = inside(spark, sf_dir).groupBy("request_id").agg(F.array_except(expected, F.collect_set("family")).alias("missing"))
    requests = requests.withColumns({"risk_mode": F.get(modes, (F.col("request_id") % 3).cast("int")), "lookback_days": F.lit(LOOKBACK)})
    return synthesis.summaries(items, requests)
