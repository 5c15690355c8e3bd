"""Queries of the collectors, from tickers to evidence and what is said, over tables as landed payloads, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import documents, drivers
from ferrule.plans.collector_queries import _FORMS, _ITEMS
from ferrule.plans.inputs import ORDERS_AS_OF, as_of, table
from ferrule.plans.registry import query
from ferrule.plans.source_queries import _tag

CUTOFF = "1998-01-01 00:00:00"
FORMS, CODES = ("8-K", "6-K", "10-Q", "8-K/A", "SC 13D", "8-K"), ("8.01", "1.01,9.01", "", "1.03, 8.01")


def rule_hits_sql(text: str) -> str:
    """The rules that a text meets, for texts whose rules' words stand in their last 400 characters."""
    parts = []
    for rule, _, _, _, patterns, exclusions in documents.DOCUMENT_RULES:
        hit, out = (" or ".join(f"regexp_matches({t}, '(?i){p}')" for p in ps) for t, ps in ((text, patterns), (f"right({text}, 400)", exclusions)))
        parts.append(f"case when ({hit}) and not ({out}) then '{rule}' end")
    return f"list_filter([{', '.join(parts)}], lambda x: x is not null)"


GENERIC = next(r[0] for r in documents.DOCUMENT_RULES if r[3])
SPECIFIC = f"len(list_filter(hits, lambda x: x <> '{GENERIC}'))"
STATUS_SQL = f"case when len(hits) = 0 then 'no_match' when {SPECIFIC} > 1 then 'ambiguous' else 'matched' end"
RULE_SQL = f"case when {SPECIFIC} <= 1 then coalesce(list_filter(hits, lambda x: x <> '{GENERIC}')[1], hits[1]) end"
_KINDS = ", ".join(f"('{r[0]}', '{r[2]}', " + ", ".join("'" + v.replace("'", "''") + "'" for v in documents.RULE_CONTEXT[r[0]]) + ")" for r in documents.DOCUMENT_RULES)
_PHRASES = "[" + ", ".join(f"'{p}'" for p in documents.PHRASES) + "]"


@query(f"""with kinds(rule_id, event_type, label, why, materiality) as (values {_KINDS}), f as (select doc_id as filing_id, text || ' ' || {_PHRASES}[1 + doc_id % 7] as text from documents), h as (select filing_id, {rule_hits_sql('text')} as hits from f),
    j as (select filing_id, {STATUS_SQL} as status, {RULE_SQL} as rule_id, hits as candidates from h)
    select filing_id, status, rule_id, event_type, candidates from j left join kinds using (rule_id)""")
def document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings built around phrases of the rules, one for each document."""
    return documents.classify(documents.sample_filings(table(spark, sf_dir, "documents")))


def pick(values, n) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _cik(key: str) -> Column:
    return F.lpad(F.col(key).cast("string"), 10, "0")


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A customer is a ticker; every tenth is a fund, and of every tenth nobody knows the company."""
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), k).alias("ticker"), k.alias("k"), _cik("c_custkey").alias("cik"))
    return asked.select("ticker"), asked.where("k % 10 = 0").select("ticker"), asked.where("k % 10 <> 1").select("ticker", "cik")


def _submissions(rows: DataFrame) -> DataFrame:
    """(cik, payload) of rows (cik, o, ts, form, codes, accession, document): parallel arrays, newest first."""
    entry = F.struct((-F.unix_date(F.col("ts").cast("date"))).alias("back"), "o", "form", F.date_format("ts", "yyyy-MM-dd").alias("filed"), "accession", "document", "codes")
    held = rows.groupBy("cik").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    names = {"form": "form", "filingDate": "filed", "accessionNumber": "accession", "primaryDocument": "document", "items": "codes"}
    column = lambda c: F.transform("e", lambda x: x[c])
    recent = F.struct(*(column(c).alias(n) for n, c in names.items()))
    return held.select("cik", F.to_json(F.struct("cik", F.struct(recent.alias("recent")).alias("filings"))).alias("payload"))


def _filings(spark: SparkSession, sf_dir: str) -> drivers.Collected:
    """An order is a filing of its customer. Some documents aren't there, some are empty; some indexes aren't there, some don't parse."""
    o = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(
        _cik("o_custkey").alias("cik"), o.alias("o"), F.col("o_orderdate").alias("ts"), pick(FORMS, o).alias("form"), pick(CODES, F.floor(o / 2)).alias("codes"),
        F.concat(F.lit("a-"), o).alias("accession"), F.concat(F.lit("d"), o, F.lit(".htm")).alias("document"), "o_orderpriority",
    )
    n, m = F.floor(F.col("o") / 4) % 5, F.floor(F.col("o") / 3) % 4
    body = F.concat(F.lit("<html><script>we repurchased 5 shares</script><body><p>Priority <b>"), F.col("o_orderpriority"), F.lit("</b>.</p> "), pick(documents.PHRASES, F.floor(F.col("o") / 20)), F.lit("</body></html>"))
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.regexp_replace("cik", "^0+(?=.)", ""), F.lit("/a"), "o", F.lit("/d"), "o", F.lit(".htm"))
    landed = orders.where(n != 1).select(url.alias("url"), F.when(n == 2, " ").otherwise(body).alias("html"))
    index = F.when(m == 1, "no json").otherwise('{"directory": {"item": [{"name": "x.htm", "type": "8-K"}, {"name": "y.htm", "type": "EX-99.1"}]}}')
    return drivers.collect_filings(*_asked(spark, sf_dir), _submissions(orders), landed, orders.where(m != 2).select("accession", index.alias("payload")), F.to_timestamp_ntz(F.lit(CUTOFF)))


FILINGS_SQL = f"""with items(code, place, type, label, why, materiality) as (values {_ITEMS}), forms(base, type, label, why, materiality) as (values {_FORMS}), kinds(rule_id, event_type, label, why, materiality) as (values {_KINDS}),
    asked as (select 'C' || c_custkey as ticker, c_custkey as k, case when c_custkey % 10 = 0 then 'fund' when c_custkey % 10 = 1 then 'unresolved' else 'company' end as lane from customer),
    rows as (select o_custkey as k, o_orderkey as o, o_orderdate as ts, {list(FORMS)}[1 + o_orderkey % 6] as form, {list(CODES)}[1 + o_orderkey // 2 % 4] as codes, o_orderkey // 4 % 5 as n, o_orderkey // 3 % 4 as m,
        row_number() over (partition by o_custkey order by o_orderdate::date desc, o_orderkey) as ordinal from orders),
    listed as (select *, replace(form, '/A', '') as base, form in ('8-K', '6-K', '8-K/A') as current, split_part(codes, ',', 1) as code from rows join asked using (k) where lane = 'company' and form <> 'SC 13D' and ts::date >= date '1998-01-01'
        qualify row_number() over (partition by k order by ordinal) <= 10),
    read as (select *, current and codes = '8.01' as asks, case when n not in (1, 2) then {_PHRASES}[1 + o // 20 % 7] end as phrase from listed),
    judged as (select *, {rule_hits_sql('phrase')} as hits from read),
    spoken as (select *, case when asks then case when phrase is null then 'unavailable' else {STATUS_SQL} end end as document_status, case when asks and phrase is not null then {RULE_SQL} end as rule_id from judged)"""


@query(f"""{FILINGS_SQL} select ticker, 'a-' || o as accession, case when s.code = '1.03' and s.base = '8-K' then 'bankruptcy' else 'sec_form_' || lower(replace(replace(form, '-', '_'), '/', '_')) end as signal,
        case when s.code = '1.03' and s.base = '8-K' then 'bearish' else 'neutral' end as direction, coalesce(r.event_type, i.type, f.type, 'sec_filing') as type, coalesce(r.label, i.label, f.label, 'SEC ' || s.base) as label,
        coalesce(r.why, i.why, f.why, 'The filing updates the issuer''s primary regulatory record.') as why, coalesce(r.materiality, i.materiality, f.materiality, 'contextual') as materiality, case when form like '%/A' then 'amendment' else 'new_event' end as novelty,
        case when codes <> '' then 'SEC ' || form || ' filing reports item codes ' || replace(codes, ' ', '') || '.' else 'SEC ' || form || ' filing metadata.' end || coalesce(' ' || r.label || ' identified by ' || r.rule_id || '@1.', '') as notes,
        document_status, s.rule_id, case when r.rule_id is null then 'sec-events-v1' else 'sec-events-v1+sec-primary-document-v1' end as parser_version, case when current and m not in (1, 2) then ['y.htm'] end as exhibits
    from spoken s left join kinds r on r.rule_id = s.rule_id left join items i on i.code = s.code left join forms f on s.code = '' and f.base = s.base""")
def filings_collector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _filings(spark, sf_dir).evidence
    return found.select("ticker", "accession", "signal", "direction", "context.type", "context.label", "context.why", "context.materiality", "context.novelty", "notes", "document_status", "rule_id", "parser_version", "exhibits")


def told(found: drivers.Collected) -> DataFrame:
    """results with warnings, in order, and reasons as code:scope:scope_id:detail, sorted."""
    said = found.warnings.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "warning"))), lambda w: w["warning"]).alias("warnings"))
    why = found.reasons.groupBy("ticker").agg(F.array_sort(F.collect_list(F.concat_ws(":", "code", "scope", "scope_id", "detail"))).alias("reasons"))
    none = F.array().cast("array<string>")
    return found.results.join(said, "ticker", "left").join(why, "ticker", "left").select("ticker", "status", "items", F.coalesce("warnings", none).alias("warnings"), F.coalesce("reasons", none).alias("reasons"))


@query(f"""{FILINGS_SQL}, said as (
        select ticker, ordinal * 2 as place, 'SEC a-' || o || ' primary document was unavailable or malformed.' as warning from spoken where document_status = 'unavailable'
        union all select ticker, ordinal * 2 + 1, 'SEC a-' || o || ' exhibit index was unavailable or malformed.' from spoken where current and m in (1, 2)),
    each as (select ticker, list(warning order by place) as warnings from said group by 1), counted as (select ticker, count(*) as items from listed group by 1)
    select ticker, case when lane = 'fund' then 'unsupported' when items > 0 then 'fresh' else 'no_observations' end as status, coalesce(items, 0) as items,
        case when lane = 'fund' then [ticker || ' uses the SEC fund lane; corporate filing semantics were skipped.'] when lane = 'unresolved' then ['SEC has no CIK for ' || ticker || ' in its mapping or company search.']
            when items is null then ['No tracked SEC filings found for ' || ticker || ' in the lookback window.'] else coalesce(warnings, []::varchar[]) end as warnings,
        case lane when 'fund' then ['source_unsupported:evaluation:' || ticker || ':fund_uses_distinct_sec_lane'] when 'unresolved' then ['entity_rejected:evaluation:' || ticker || ':cik_unresolved'] else []::varchar[] end as reasons
    from asked left join counted using (ticker) left join each using (ticker)""")
def filings_collector_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(_filings(spark, sf_dir))


def _fund_reports(spark: SparkSession, sf_dir: str) -> drivers.Collected:
    """A customer is a ticker: a third are reviewed funds, some of them without an official identity. Orders are reports; some documents name another company or aren't there."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), k).alias("ticker"), k, _cik("c_custkey").alias("cik"))
    kind = F.when(k % 9 == 0, "issuer_only").otherwise("official_series_class")
    identities = asked.where("c_custkey % 3 = 0").select("ticker", kind.alias("identity_status"), "cik", F.concat(F.lit("S"), k).alias("series"), F.lit("K").alias("class"))
    orders = table(spark, sf_dir, "orders").where("o_custkey % 3 = 0").select(
        "o_custkey", _cik("o_custkey").alias("cik"), o.alias("o"), F.col("o_orderdate").alias("ts"), pick(("NPORT-P", "N-CEN", "10-K"), o).alias("form"), F.lit("").alias("codes"),
        F.concat(F.lit("a-"), o).alias("accession"), F.concat(F.lit("d"), o, F.lit(".xml")).alias("document"),
    )
    payloads = _submissions(orders).withColumn("payload_cik", F.col("cik"))
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), "o_custkey", F.lit("/a"), "o", F.lit("/d"), "o", F.lit(".xml"))
    n = F.floor(F.col("o") / 3) % 4
    ids = F.concat(_tag("seriesId", F.concat(F.lit("S"), "o_custkey")), _tag("classId", F.lit("K")))
    xml = _tag("edgarSubmission", _tag("submissionType", F.col("form")), _tag("cik", F.when(n == 1, "1").otherwise(F.col("cik"))), ids, _tag("repPdDate", F.date_format("ts", "yyyy-MM-dd")), "<invstOrSec/><invstOrSec/>")
    return drivers.collect_funds(asked.select("ticker"), identities, payloads, orders.where(n != 2).select(url.alias("url"), xml.alias("xml")), F.to_timestamp_ntz(F.lit(CUTOFF)))


@query("""with asked as (select 'C' || c_custkey as ticker, c_custkey as k, case when c_custkey % 3 = 0 then case when c_custkey % 9 = 0 then 'issuer_only' else 'official' end end as kind from customer),
    entries as (select ticker, o_orderkey as o, o_orderkey // 3 % 4 in (1, 2) as failed, row_number() over (partition by o_custkey order by o_orderdate::date desc, o_orderkey) as ordinal
        from orders join asked on k = o_custkey where kind = 'official' and o_orderkey % 3 < 2 and o_orderdate::date >= date '1998-01-01'),
    told as (select ticker, count(*) filter (not failed) as items, count(*) as entries, list('SEC fund filing a-' || o || ' was unavailable, oversized, or invalid.' order by ordinal) filter (failed) as warnings,
        list('source_unavailable:candidate:a-' || o || ':fund_document_unavailable_or_invalid' order by 'source_unavailable:candidate:a-' || o || ':fund') filter (failed) as reasons from entries group by 1)
    select ticker, case when kind = 'issuer_only' then 'unsupported' when items > 0 then 'fresh' when entries > 0 then 'unavailable' else 'no_observations' end as status, coalesce(items, 0) as items,
        case when kind = 'issuer_only' then [ticker || ' fund identity is typed issuer_only; no series/class identity was inferred.'] when kind = 'official' and entries is null then ['No N-CEN or NPORT filings found for ' || ticker || ' in the lookback window.']
            else coalesce(warnings, []::varchar[]) end as warnings, case when kind = 'issuer_only' then ['source_unsupported:evaluation:' || ticker || ':issuer_only'] else coalesce(reasons, []::varchar[]) end as reasons
    from asked left join told using (ticker)""")
def fund_collector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(_fund_reports(spark, sf_dir))


INSIDER_LOOKBACK = 730


def _insiders(spark: SparkSession, sf_dir: str) -> drivers.Collected:
    """An order is an ownership filing of its customer, its lines are the trades; every fourth is a notice of a proposed sale, every eleventh entry names no document. Every other has a second owner."""
    o = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(
        o.alias("o"), "o_custkey", _cik("o_custkey").alias("cik"), F.col("o_orderdate").alias("ts"), pick(("4", "144", "4/A", "4"), o).alias("form"), F.lit("").alias("codes"),
        F.concat(F.lit("a-"), o).alias("accession"), F.when(o % 11 == 0, "").otherwise(F.concat(F.lit("d"), o, F.lit(".xml"))).alias("document"),
    )
    value = lambda name, x: _tag(name, _tag("value", x))
    sold = F.col("l_returnflag") == "R"
    amounts = _tag("transactionAmounts", value("transactionShares", F.col("l_quantity").cast("string")), value("transactionPricePerShare", F.col("l_extendedprice").cast("string")), value("transactionAcquiredDisposedCode", F.when(sold, "D").otherwise("A")))
    trade = _tag("nonDerivativeTransaction", value("transactionDate", F.date_format("l_shipdate", "yyyy-MM-dd")), _tag("transactionCoding", _tag("transactionCode", F.when(sold, "S").otherwise("P"))), amounts)
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.array_join(F.array_sort(F.collect_list(trade)), "").alias("trades"))
    owner = lambda name: _tag("reportingOwner", _tag("reportingOwnerId", _tag("rptOwnerName", name)))
    second = F.when(F.col("o") % 2 == 1, owner("Owner 9")).otherwise("")
    xml = _tag("ownershipDocument", _tag("documentType", F.col("form")), owner(F.concat(F.lit("Owner "), F.col("o") % 3)), second, _tag("nonDerivativeTable", F.coalesce("trades", F.lit(""))))
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), "o_custkey", F.lit("/a"), "o", F.lit("/d"), "o", F.lit(".xml"))
    landed = orders.where("document <> ''").join(held, "o", "left").select(url.alias("url"), xml.alias("xml"))
    # as in the SQL, all documents of a company are read
    return drivers.collect_insiders(*_asked(spark, sf_dir), _submissions(orders), landed, as_of(ORDERS_AS_OF), INSIDER_LOOKBACK, most=None)


INSIDERS_SQL = f"""with asked as (select 'C' || c_custkey as ticker, c_custkey as k, case when c_custkey % 10 = 0 then 'fund' when c_custkey % 10 = 1 then 'unresolved' else 'company' end as lane from customer),
    entries as (select ticker, o_orderkey as o, ['4', '144', '4/A', '4'][1 + o_orderkey % 4] as form, row_number() over (partition by o_custkey order by o_orderdate::date desc, o_orderkey) as place, o_orderdate::date as ts from orders join asked on k = o_custkey
        where lane = 'company'),
    recent as (select * from entries where ts >= timestamp '{ORDERS_AS_OF}' - to_days({INSIDER_LOOKBACK})), planned as (select * from recent where o % 11 <> 0),
    trades as (select ticker, o, case l_returnflag when 'R' then 'S' else 'P' end as code, l_quantity * l_extendedprice * case l_returnflag when 'R' then -1 else 1 end as value, case when o % 2 = 1 then ['Owner ' || o % 3, 'Owner 9'] else ['Owner ' || o % 3] end as names,
        case when l_shipdate::date >= timestamp '{ORDERS_AS_OF}' - to_days({INSIDER_LOOKBACK // 2}) then 'current' when l_shipdate::date >= timestamp '{ORDERS_AS_OF}' - to_days({INSIDER_LOOKBACK}) then 'prior' end as w
        from planned join lineitem on l_orderkey = o where form <> '144'),
    summed as (select ticker, coalesce(sum(value) filter (w = 'current'), 0) as net, coalesce(sum(value) filter (w = 'prior'), 0) as prior_net, count(distinct o) filter (w = 'current') as source_count,
        len(list_distinct(flatten(list(names) filter (w = 'current' and code = 'P')))) as buyers, len(list_distinct(flatten(list(names) filter (w = 'current' and code = 'S')))) as sellers from trades where w is not null group by 1 having source_count > 0),
    sized as (select *, coalesce(case when net > 0 then buyers when net < 0 then sellers else 0 end, 0)::int as owners, coalesce(sellers, 0) as unplanned from summed),
    evidence as (
        select ticker, 'insider_' || case when net > 0 then 'purchase' when net < 0 then 'sale' else 'mixed' end || case when owners >= 3 then '_strong_cluster' when owners >= 2 then '_cluster' else '_activity' end as signal,
            case when net > 0 then 'bullish' when net < 0 then 'bearish' else 'neutral' end as direction, round(least(1.0, 0.45::double + 0.12::double * owners), 6) as strength,
            case when net < 0 then case when unplanned >= 3 then 0.72 when unplanned >= 2 then 0.66 else 0.52 end else case when owners >= 3 then 0.88 when owners >= 2 then 0.82 else 0.68 end end::double as confidence,
            case when prior_net = 0 then 'new_activity' when (net > 0) <> (prior_net > 0) then 'direction_reversal' when abs(net) > abs(prior_net) then 'increased' else 'decreased' end as novelty,
            owners, round(net, 2) as net, source_count::int as source_count, null::varchar as accession from sized
        union all select ticker, 'insider_proposed_sale', 'neutral', null, null, 'new_event', null, null, 1, 'a-' || o from planned where form = '144')"""


@query(f"{INSIDERS_SQL} select * from evidence")
def insider_collector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _insiders(spark, sf_dir).evidence
    return found.select("ticker", "signal", "direction", F.round("strength", 6).alias("strength"), "confidence", "novelty", "owners", F.round("net", 2).alias("net"), "source_count", "accession")


@query(f"""{INSIDERS_SQL}, omitted as (select ticker, list('SEC ' || form || ' entry omitted accession or primary document.' order by place) as warnings from recent where o % 11 = 0 group by 1), counted as (select ticker, count(*) as items from evidence group by 1)
    select ticker, case when lane = 'fund' then 'unsupported' when items > 0 then 'fresh' else 'no_observations' end as status, coalesce(items, 0) as items,
        case when lane = 'fund' then [ticker || ' is a reviewed fund; corporate-insider semantics were skipped.'] when lane = 'unresolved' then ['SEC has no CIK for ' || ticker || ' in its mapping or company search.']
            else coalesce(warnings, []::varchar[]) || case when items is null then ['No qualifying direct SEC insider activity found for ' || ticker || '.'] else []::varchar[] end end as warnings,
        case lane when 'fund' then ['source_unsupported:family:insider_trading:fund_has_no_corporate_insider_semantics'] when 'unresolved' then ['entity_rejected:evaluation:' || ticker || ':cik_unresolved'] else []::varchar[] end as reasons
    from asked left join counted using (ticker) left join omitted using (ticker)""")
def insider_collector_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(_insiders(spark, sf_dir))
