"""Queries of texts, entities, URLs, documents and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions import text, urls
from ferrule.operators import documents, graph, resolve
from ferrule.plans.inputs import table
from ferrule.plans.registry import query

TITLE_SQL = r"trim(regexp_replace(replace(replace(lower({0}), 'ß', 'ss'), '&', ' and '), '[^\p{{L}}\p{{N}}%]+', ' ', 'g'))"
ENTITY_SQL = r"trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


@query(f"select doc_id, sha256({TITLE_SQL.format('text')}) as title_sha, length({TITLE_SQL.format('text')}) as n from documents")
def title_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = text.normalize_title(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(title, 256).alias("title_sha"), F.length(title).cast("long").alias("n"))


@query(f"select doc_id, sha256({ENTITY_SQL.format('text')}) as entity_sha from documents")
def entity_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalize_entity(F.col("text")), 256).alias("entity_sha"))


#: Rules over the invented words of the test documents: issuer, rule, alias, required terms, negative terms, validity.
RULES = (
    ("alpha", "a1", "the", ["licensed under"], ["von"], None, None),
    ("alpha", "a2", "of the", [], ["password"], "2024-01-05", None),
    ("beta", "b1", "in the", ["of", "der"], [], None, "2024-01-20"),
    ("beta", "b2", "licensed under", [], [], None, None),
    ("gamma", "g1", "Que de", ["los"], ["del"], None, None),
    ("delta", "d1", "des", [], ["les"], "2024-01-10", "2024-01-25"),
)
RULES_SQL = "rules(issuer, rule_id, alias, required, negative, valid_from, valid_to) as (values " + ", ".join(
    "({})".format(", ".join("[" + ", ".join(f"'{t}'" for t in v) + "]::varchar[]" if isinstance(v, list) else "null::varchar" if v is None else f"'{v.lower() if i == 2 else v}'" for i, v in enumerate(r))) for r in RULES
) + ")"


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "issuer string, rule_id string, alias string, required array<string>, negative array<string>, valid_from string, valid_to string")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")), "yyyy-MM-dd")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text", F.substring_index("text", "\n", 1).alias("title"), day.alias("day"))


MATCH_SQL = f"""
    with {RULES_SQL}, texts as (
        select doc_id as text_id, {ENTITY_SQL.format('text')} as body, ' ' || {ENTITY_SQL.format("split_part(text, chr(10), 1)")} || ' ' as title,
            strftime(date '2024-01-01' + (doc_id % 30)::int, '%Y-%m-%d') as day from documents
    ), matches as (
        select text_id, issuer, rule_id, alias, body, title, day, valid_from, valid_to, required, negative,
            list_filter(required, lambda t: contains(' ' || body || ' ', ' ' || t || ' ')) as required_met,
            list_filter(negative, lambda t: contains(' ' || body || ' ', ' ' || t || ' ')) as negative_met
        from texts, rules where contains(' ' || body || ' ', ' ' || alias || ' ')
    )
"""


@query(f"{MATCH_SQL} select text_id, issuer, rule_id, len(required_met)::int as required_met, len(negative_met)::int as negative_met from matches")
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve.match_rules(_texts(spark, sf_dir), _rules(spark))
    return found.select("text_id", "issuer", "rule_id", F.size("required_met").alias("required_met"), F.size("negative_met").alias("negative_met"))


DECISION_SQL = f"""{MATCH_SQL}, graded as (
        select *, case when (valid_from is not null and day < valid_from) or (valid_to is not null and day > valid_to) then 'outside_validity'
            when len(negative_met) > 0 then 'negative_context' when len(required) > 0 and len(required_met) = 0 then 'missing_required_context' else 'accepted' end as status,
            contains(title, ' ' || alias || ' ') as aligned from matches
    ), decided as (
        select text_id, issuer, min((lpad((1000 - length(alias))::varchar, 4, '0') || rule_id)) filter (status = 'accepted') as best,
            min_by(status, lpad((1000 - length(alias))::varchar, 4, '0') || rule_id) as specific, bool_or(status = 'negative_context') as negative, bool_or(aligned) as aligned,
            list_sort(list_distinct(list(rule_id))) as rule_ids, sha256(any_value(sha256(body))) as context_key from graded group by all
    ), decisions as (
        select text_id, issuer, best is not null and aligned as accepted, case when best is not null and not aligned then 'title_not_aligned' when best is not null then 'accepted'
            when negative then 'negative_context' else specific end as reason, case when best is not null and aligned then substr(best, 5) end as rule_id, rule_ids, context_key from decided
    )"""


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve.match_rules(_texts(spark, sf_dir), _rules(spark))
    aligned = text.has_phrase(text.normalize_entity(F.col("title")), F.col("alias_text"))
    return resolve.decide(found, F.col("day"), aligned)


@query(f"{DECISION_SQL} select * from decisions")
def entity_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir)


@query(f"""{DECISION_SQL} select issuer, count(*) as candidates, count(*) filter (accepted) as accepted, count(*) filter (not accepted) as rejected from decisions group by 1""")
def rejection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.rejections(_decisions(spark, sf_dir), ["issuer"]).drop("reasons")


@query(f"""{DECISION_SQL} select issuer, reason, count(*) as n from decisions where not accepted group by all""")
def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve.rejections(_decisions(spark, sf_dir), ["issuer"])
    return found.select("issuer", F.explode("reasons").alias("reason", "n"))


@query(f"""{DECISION_SQL}, printed as (select sha256(text_id || chr(31) || issuer || chr(31) || accepted::int || chr(31) || reason || chr(31) || coalesce(rule_id, '') || chr(31) || context_key) as fingerprint, text_id, issuer from decisions)
    select fingerprint, text_id, issuer from printed where fingerprint not in (select fingerprint from printed where text_id % 2 = 0)""")
def audit_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of even texts are known; auditing all adds those of odd ones alone."""
    decisions = _decisions(spark, sf_dir)
    known = resolve.audit(decisions.where("text_id % 2 = 0"))
    return resolve.audit(decisions, known).select("fingerprint", "text_id", "issuer")


@query("""with parts as (
        select page_id, regexp_extract(url, '^https://([^/?#]*)', 1) as host, regexp_extract(url, '^https://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '\\?([^#]*)', 1) as query
        from pages where url like 'https://%'
    ), pairs as (
        select page_id, unnest(string_split(query, '&')) as pair from parts where query <> ''
    ), kept as (
        select page_id, string_agg(pair, '&' order by split_part(pair, '=', 1), pair) as query from pairs
        where not split_part(pair, '=', 1) like 'utm_%' and split_part(pair, '=', 1) not in ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'source') group by 1
    )
    select p.page_id, 'https://' || lower(host) || case when path in ('', '/') then '/' else rtrim(regexp_replace(path, '/{2,}', '/', 'g'), '/') end || coalesce('?' || k.query, '') as canonical
    from parts p left join kept k using (page_id)""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))
    return pages.where("canonical is not null")


PUBLISHERS = (("example.com", 0.70), ("example.net", 0.65), ("blog.ththth.example.org", 0.68), ("ththe.example.com", 0.62), ("org", 0.61))


@query("""with publishers(domain, quality) as (values """ + ", ".join(f"('{d}', {q}::double)" for d, q in PUBLISHERS) + """),
    hosts as (select page_id as url_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) as host from pages),
    met as (select * from hosts, publishers where host = domain or suffix(host, '.' || domain)),
    best as (select url_id, max_by(domain, length(domain)) as publisher_domain, max_by(quality, length(domain)) as quality from met group by 1)
    select url_id, host, coalesce(publisher_domain, 'unreviewed') as publisher_domain, coalesce(quality, 0.60::double) as quality from hosts left join best using (url_id)""")
def publisher_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    publishers = spark.createDataFrame(PUBLISHERS, "domain string, quality double")
    return resolve.publisher_quality(table(spark, sf_dir, "pages").select(F.col("page_id").alias("url_id"), "url"), publishers)


@query(r"""select page_id, sha256(body) as body_sha, length(body) as n from (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'),
    '(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g')) as body from pages)""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = documents.html_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(body, 256).alias("body_sha"), F.length(body).cast("long").alias("n"))


def _observations(spark: SparkSession, sf_dir: str, title: Column) -> DataFrame:
    """A document is an observation of its language's issuer."""
    tier = F.element_at(F.array(*map(F.lit, ("discovery", "authorized_vendor", "issuer_primary", "primary_regulator", "other"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("issuer"), F.col("source").alias("source_id"), (F.col("doc_id") % 50).cast("string").alias("record_id"), tier.alias("tier"),
        F.concat(F.lit("https://example.org/"), F.substring(F.md5("text"), 1, 2), F.lit("/?utm_source=x")).alias("url"), title.alias("title"),
        (F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(hours=F.col("doc_id").cast("int") * 7)).alias("published_at"), F.col("doc_id").alias("arrival"),
    )


@query(f"""with seen as (
        select lang as issuer, source as source_id, (doc_id % 50)::varchar as record_id, doc_id as arrival, 'https://example.org/' || substr(md5(text), 1, 2) as canonical_url,
            {TITLE_SQL.format("split_part(text, chr(10), 1)")} as normal_title, case doc_id % 5 when 0 then 50 when 1 then 80 when 2 then 95 when 3 then 100 else 10 end as rank from documents
    ), keyed as (
        select *, sha256(source_id || chr(31) || record_id || chr(31) || canonical_url || chr(31) || normal_title) as observation_key,
            sha256(issuer || chr(31) || normal_title || chr(31) || canonical_url) as event_key from seen where normal_title <> ''
    ), first as (select observation_key, min(arrival) as observation_id from keyed group by 1),
    linked as (select event_key, issuer, observation_key, max(rank) as rank, min(arrival) as arrival from keyed group by all)
    select event_key, issuer, count(*) as sources, arg_min(observation_key, lpad((1000 - rank)::varchar, 5, '0') || lpad(observation_id::varchar, 12, '0')) as primary_key, min(arrival) as first_arrival,
        'clm_' || sha256(issuer || chr(31) || event_key) as claim_id
    from linked join first using (observation_key) group by all""")
def exact_event_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title is the whole first line."""
    return graph.exact_events(graph.observations(_observations(spark, sf_dir, F.substring_index("text", "\n", 1))))


@query()
def fuzzy_event_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title is the whole first line."""
    return graph.near_events(graph.observations(_observations(spark, sf_dir, F.substring_index("text", "\n", 1))))


@query("""select conv_id, turn, (row_number() over c - 1) // 2 + 1 as page, case when row_number() over c % 2 = 0 and row_number() over c < count(*) over (partition by conv_id) then turn end as next_cursor
    from conversations window c as (partition by conv_id order by turn)""")
def claim_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.claim_pages(table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", 2)
