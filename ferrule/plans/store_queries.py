"""Queries of the evidence store's reads, over documents as observations, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import event_store, graph
from ferrule.plans.inputs import as_of, table, trades, TRADES_SQL
from ferrule.plans.registry import query
from ferrule.plans.text_queries import DECISION_SQL, TITLE_SQL, _decisions, _observations

SINCE = "2024-01-10 00:00:00"
STORE_SQL = f"""with seen as (
        select lang as issuer, source as source_id, (doc_id % 50)::varchar as record_id, doc_id as arrival, 'https://example.org/' || substr(md5(text), 1, 2) as canonical_url,
            {TITLE_SQL.format("split_part(text, chr(10), 1)")} as normal_title, split_part(text, chr(10), 1) as title, timestamp '2024-01-01' + to_hours(7 * doc_id::int) as published_at,
            case doc_id % 5 when 0 then 50 when 1 then 80 when 2 then 95 when 3 then 100 else 10 end as rank,
            case doc_id % 5 when 0 then 'discovery' when 1 then 'authorized_vendor' when 2 then 'issuer_primary' when 3 then 'primary_regulator' else 'other' end as tier from documents
    ), keyed as (
        select *, sha256(source_id || chr(31) || record_id || chr(31) || canonical_url || chr(31) || normal_title) as observation_key,
            sha256(issuer || chr(31) || normal_title || chr(31) || canonical_url) as event_key from seen where normal_title <> ''
    ), observations as (
        select observation_key, min(arrival) as observation_id, arg_min(source_id, arrival) as source_id, arg_min(tier, arrival) as tier, arg_min(canonical_url, arrival) as canonical_url,
            arg_min(title, arrival) as title, arg_min(published_at, arrival) as published_at from keyed group by 1
    ), canonical as (
        select event_key, issuer, min(arrival) as event_id, min(published_at) as published_at, 'clm_' || sha256(issuer || chr(31) || event_key) as claim_id from keyed group by all
    ), linked as (select event_key, issuer, observation_key, min(arrival) as relation_id, max(rank) as rank from keyed group by all
    ), links as (
        select event_id, claim_id, issuer, c.published_at as event_at, observation_id, relation_id, rank, source_id, tier, canonical_url, title, o.published_at, 'src_' || sha256(observation_key) as source_reference_id
        from linked join canonical c using (event_key, issuer) join observations o using (observation_key)
    )"""


def _tables(spark: SparkSession, sf_dir: str) -> event_store.EventTables:
    return event_store.event_tables(graph.observations(_observations(spark, sf_dir, F.substring_index("text", "\n", 1))))


@query(f"""{STORE_SQL}, numbered as (select *, row_number() over (partition by claim_id order by relation_id) as n, count(*) over (partition by claim_id) as total_sources from links),
    whole as (select claim_id, list_sort(list(distinct source_id)) as source_ids, list_sort(list(distinct tier)) as tiers from links group by 1)
    select claim_id, relation_id, source_reference_id, source_id, (n - 1) // 3 + 1 as page, case when n % 3 = 0 and n < total_sources then relation_id end as next_cursor, total_sources, source_ids, tiers
    from numbered join whole using (claim_id)""")
def claim_source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_store.source_pages(_tables(spark, sf_dir), 3)
    return found.select("claim_id", "relation_id", "source_reference_id", "source_id", "page", "next_cursor", "total_sources", "source_ids", "tiers")


@query(f"""{STORE_SQL}, asked as (select case when event_id % 7 = 0 then 'clm_x' when event_id % 7 = 1 then 'clm_' || sha256('no' || event_id) else claim_id end as claim_id, event_id % 5 - 1 as "cursor", event_id % 23 as "limit" from canonical)
    select a.claim_id, "cursor", "limit", case when a.claim_id = 'clm_x' then 'invalid_claim_id' when "cursor" < 0 then 'invalid_cursor' when "limit" not between 1 and 20 then 'invalid_limit' when c.claim_id is null then 'unknown_claim' end as error
    from asked a left join canonical c on a.claim_id = c.claim_id""")
def claim_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _tables(spark, sf_dir)
    n = F.col("event_id")
    claim = F.when(n % 7 == 0, "clm_x").when(n % 7 == 1, F.concat(F.lit("clm_"), F.sha2(F.concat(F.lit("no"), n), 256))).otherwise(F.col("claim_id"))
    return event_store.checked_claims(tables.claims.select(claim.alias("claim_id"), (n % 5 - 1).alias("cursor"), (n % 23).alias("limit")), tables.claims)


@query(f"""{STORE_SQL}, pairs as (select distinct issuer, source_id, event_id, event_at as published_at from links where event_at >= timestamp '{SINCE}')
    select *, row_number() over (partition by issuer, source_id order by published_at desc, event_id desc) as place from pairs qualify place <= 100""")
def source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_store.events_of_sources(_tables(spark, sf_dir), as_of(SINCE))
    return found.select("issuer", "source_id", "event_id", "published_at", "place")


@query(f"""{STORE_SQL} select event_id, issuer, row_number() over (partition by issuer order by published_at desc, event_id desc) as place from canonical where published_at >= timestamp '{SINCE}' qualify place <= 100""")
def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = _tables(spark, sf_dir).events.where(F.col("published_at") >= as_of(SINCE))
    return event_store.newest(recent, "issuer").select("event_id", "issuer", "place")


@query(f"""{STORE_SQL} select issuer, source_id, observation_id, sha256(title) as title_sha, row_number() over (partition by issuer, source_id order by event_at desc, event_id desc, observation_id) as place
    from links where event_at >= timestamp '{SINCE}' qualify place <= 500""")
def source_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_store.titles_of_sources(_tables(spark, sf_dir), as_of(SINCE))
    return found.select("issuer", "source_id", "observation_id", F.sha2("title", 256).alias("title_sha"), "place")


VIEW_SQL = """, support as (select claim_id, count(*) as source_count, list(source_reference_id order by relation_id)[:20] as supporting_ids, list_sort(list(distinct tier)) as tiers from links group by 1),
    viewed as (select event_id, issuer, claim_id, primary_id, primary_source,
        coalesce(list(canonical_url order by -rank, observation_id) filter (observation_id <> primary_id and not {hidden}), []::varchar[])[:20] as related_urls from links join primaries using (event_id) group by all)
    select event_id, issuer, claim_id, primary_id, primary_source, related_urls, source_count, tiers, supporting_ids, source_count > 20 as truncated from viewed join support using (claim_id)"""
VIEW_COLUMNS = ("event_id", "issuer", "claim_id", "primary_id", "primary_source", "related_urls", "source_count", "tiers", "supporting_ids", "truncated")


@query(f"""{STORE_SQL}, primaries as (select event_id, observation_id as primary_id, source_id as primary_source from links qualify row_number() over (partition by event_id order by rank desc, observation_id) = 1)
    {VIEW_SQL.format(hidden="false")}""")
def event_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_store.event_views(_tables(spark, sf_dir)).select(*VIEW_COLUMNS)


@query(f"""{STORE_SQL}, primaries as (select event_id, observation_id as primary_id, source_id as primary_source from links where source_id = 'src1' and length(title) % 2 = 0
        qualify row_number() over (partition by event_id order by observation_id) = 1)
    {VIEW_SQL.format(hidden="(source_id = 'src1' and length(title) % 2 = 1)")}""")
def source_event_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one source saw them, by those of its titles that pass a test."""
    return event_store.event_views(_tables(spark, sf_dir), "src1", F.length("title") % 2 == 0).select(*VIEW_COLUMNS)


@query(f"""{STORE_SQL} select event_id, claim_id from canonical where event_id % 3 <> 0""")
def claim_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event has its claim; the others get theirs."""
    tables = _tables(spark, sf_dir)
    return event_store.missing_claims(tables.events, tables.claims.where("event_id % 3 = 0"))


@query(f"""{DECISION_SQL} select text_id, issuer, reason, row_number() over (partition by issuer order by text_id) as place from decisions where not accepted and text_id >= 20 qualify place <= 500""")
def audit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _decisions(spark, sf_dir).withColumn("observed_at", F.col("text_id"))
    return event_store.audits(rows, since=F.lit(20), accepted=False, ident="text_id").select("text_id", "issuer", "reason", "place")


@query(f"""with {TRADES_SQL}, grouped as (select issuer::varchar as issuer, owner as evidence_id, list(struct_pack(r := url || '#' || code, u := url) order by ts, url, code) as s, bool_and(not derivative) as complete from trades group by all having count(*) >= 2 and complete),
    titled as (select *, sha256(array_to_string(list_sort(list_transform(s, lambda x: x.r)), chr(31))) as h from grouped),
    referred as (select *, list_transform(s, lambda x: 'src_' || sha256(sha256('sec' || chr(31) || x.r || chr(31) || x.u || chr(31) || 'sec ownership group ' || h))) as refs from titled),
    once as (select *, list_transform(list_filter(list_transform(refs, lambda x, i: struct_pack(x := x, i := i)), lambda p: list_position(refs, p.x) = p.i), lambda p: p.x) as ids from referred)
    select issuer || '/' || evidence_id as evidence_id, 'sec-ownership-group-' || h as title, 'clm_' || sha256(issuer || chr(31) || sha256(issuer || chr(31) || 'sec ownership group ' || h || chr(31) || s[1].u)) as claim_id,
        len(ids)::int as source_count, len(ids)::int - 1 as corroborating, ids[:20] as supporting_ids, len(ids) > 20 as truncated from once""")
def grouped_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An owner's trades of one issuer are an item of evidence that groups them; one with a derivative trade is incomplete."""
    each = F.struct("ts", "url", "code", (~F.col("derivative")).alias("complete"))
    rows = trades(spark, sf_dir).groupBy(F.col("issuer").cast("string").alias("issuer"), F.col("owner")).agg(F.array_sort(F.collect_list(each)).alias("t"))
    source = lambda t: F.struct(F.lit("sec").alias("source_id"), F.concat(t["url"], F.lit("#"), t["code"]).alias("record_id"), t["url"].alias("canonical_url"), t["complete"].alias("complete"))
    return event_store.grouped_claims(rows.select(F.concat_ws("/", "issuer", "owner").alias("evidence_id"), "issuer", F.transform("t", source).alias("sources")))


@query("""select 'events' as name, count(*) as rows from events union all select 'orders', count(*) from orders union all select 'pages', count(*) from pages""")
def structural_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ferrule.sources.store import counts

    return counts({name: table(spark, sf_dir, name) for name in ("events", "orders", "pages")})
