"""Queries of landed payloads: the test tables are put into the form in which sources land, read back by their readers, and compared with SQL over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.plans.inputs import AS_OF, as_of, table
from ferrule.plans.registry import query
from ferrule.sources import feeds, filings, store


def _iso(ts: str | Column, end: str = "Z") -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(end))


def _utc(ts: str) -> Column:
    """A reader's instant as the tables have times."""
    return F.col(ts).cast("timestamp_ntz").alias(ts)


@query("""select 'S' || s_suppkey as ticker, lpad(s_suppkey::varchar, 10, '0') as cik from supplier where s_suppkey % 7 <> 3 and s_nationkey % 5 <> 4""")
def ticker_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload for each nation; every seventh row is short, every fifth payload lacks a column."""
    k = F.col("s_suppkey").cast("string")
    row = F.when(F.col("s_suppkey") % 7 == 3, F.array(k)).otherwise(F.array(k, F.concat(F.lit("s"), k), F.col("s_name")))
    names = F.when(F.col("s_nationkey") % 5 == 4, F.array(F.lit("cik"), F.lit("title"))).otherwise(F.array(*map(F.lit, ("cik", "ticker", "title"))))
    payloads = table(spark, sf_dir, "supplier").groupBy(names.alias("fields"), "s_nationkey").agg(F.collect_list(row).alias("data"))
    return filings.ticker_map(payloads.select(F.to_json(F.struct("fields", "data")).alias("payload")))


@query("""select c_custkey, case when c_custkey % 3 > 0 then lpad(c_custkey::varchar, 10, '0') end as cik from customer""")
def cik_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 3 == 1, F.concat(F.lit("<feed><cik>"), k, F.lit("</cik><cik>9</cik></feed>"))).when(k % 3 == 2, F.concat(F.lit("<CIK>"), k, F.lit("</CIK>"))).otherwise("<feed><cik>none</cik></feed>")
    return table(spark, sf_dir, "customer").select("c_custkey", filings.cik_of_feed(text).alias("cik"))


FORMS = ("8-K", "10-Q", "4", "10-K/A", "6-K")
FILINGS_SQL = f"""filings as (
        select o_custkey::varchar as cik, row_number() over (partition by o_custkey order by o_orderkey) - 1 as ordinal, ([{", ".join(f"'{f}'" for f in FORMS)}])[(o_orderkey % 5 + 1)::int] as form,
            case when o_orderkey % 4 > 0 then o_orderdate + interval 90 minutes else o_orderdate::date::timestamp end as ts, lpad(o_orderkey::varchar, 10, '0') || '-24-000001' as accession,
            case o_orderkey % 6 when 0 then '../x.htm' when 1 then 'a/d' || o_orderkey || '.htm' when 2 then 'bad name.htm' else 'd' || o_orderkey || '.htm' end as document,
            case o_orderkey % 5 when 0 then ['1.01', '9.01'] when 1 then ['4.02'] when 2 then []::varchar[] when 3 then ['3.01', '2.01', '5.01'] else ['1.03', '3.01'] end as items from orders
    )"""


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload for each customer, its orders as filings in parallel arrays; every fourth filing has no time of acceptance."""
    k = F.col("o_orderkey")
    form = F.element_at(F.array(*map(F.lit, FORMS)), (k % 5 + 1).cast("int"))
    document = F.when(k % 6 == 0, "../x.htm").when(k % 6 == 1, F.concat(F.lit("a/d"), k, F.lit(".htm"))).when(k % 6 == 2, "bad name.htm").otherwise(F.concat(F.lit("d"), k, F.lit(".htm")))
    items = F.when(k % 5 == 0, "1.01,9.01").when(k % 5 == 1, "4.02").when(k % 5 == 2, "").when(k % 5 == 3, "3.01, 2.01,5.01").otherwise("1.03,3.01")
    accepted = F.when(k % 4 > 0, _iso(F.col("o_orderdate") + F.make_dt_interval(mins=F.lit(90)))).otherwise("")
    each = F.struct(
        k.alias("k"), form.alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filingDate"), accepted.alias("acceptanceDateTime"),
        F.concat(F.lpad(k.cast("string"), 10, "0"), F.lit("-24-000001")).alias("accessionNumber"), document.alias("primaryDocument"), items.alias("items"),
    )
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("cik")).agg(F.array_sort(F.collect_list(each)).alias("r"))
    column = lambda name: F.transform("r", lambda x: x[name]).alias(name)
    recent = F.struct(*map(column, ("form", "filingDate", "acceptanceDateTime", "accessionNumber", "primaryDocument", "items")))
    payloads = rows.select("cik", F.to_json(F.struct("cik", F.struct(recent.alias("recent")).alias("filings"))).alias("payload"))
    return filings.submissions(payloads)


@query(f"with {FILINGS_SQL} select * from filings")
def submissions_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _submissions(spark, sf_dir).select("cik", F.col("ordinal").cast("long").alias("ordinal"), "form", _utc("ts"), "accession", "document", "items")


@query(f"""with {FILINGS_SQL}, kept as (select *, row_number() over (partition by cik order by ordinal) as n from filings where form <> '4' and ts >= timestamp '1997-01-01')
    select cik, ordinal, form, ts, regexp_replace(regexp_replace('sec_form_' || lower(form), '[^a-z0-9_]+', '_', 'g'), '_+$', '_') as signal, case form when '8-K' then 0.8::double when '6-K' then 0.75 when '10-Q' then 0.65 when '10-K' then 0.7 else 0.6 end as strength, suffix(form, '/A') as amended,
        case when document not in ('../x.htm', 'bad name.htm') then 'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || replace(accession, '-', '') || '/' || regexp_replace(document, '^.*/', '')
            when document = '../x.htm' then 'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || replace(accession, '-', '') || '/x.htm' end as url from kept where n <= 10""")
def filing_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filings.filings(_submissions(spark, sf_dir), F.to_timestamp(F.lit("1997-01-01 00:00:00")))
    return found.select("cik", F.col("ordinal").cast("long").alias("ordinal"), "form", _utc("ts"), "signal", "strength", "amended", "url")


@query("""with items as (select o_custkey, o_orderkey, 'doc' || o_orderkey || case o_orderkey % 3 when 0 then '_ex-99.htm' when 1 then '.htm' else 'ex991.htm' end as name, o_orderkey % 7 = 1 as typed from orders),
    kept as (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from items where o_orderkey % 3 <> 1 or typed)
    select o_custkey, coalesce(list(name order by o_orderkey) filter (kept.name is not null and n <= 20), []) as exhibits from (select distinct o_custkey from orders) left join kept using (o_custkey) group by 1""")
def exhibit_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat(F.lit("doc"), k, F.when(k % 3 == 0, "_ex-99.htm").when(k % 3 == 1, ".htm").otherwise("ex991.htm"))
    item = F.struct(k.alias("k"), name.alias("name"), F.when(k % 7 == 1, "EX-99.1").otherwise("GRAPHIC").alias("type"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(item)).alias("item"))
    return rows.select("o_custkey", filings.exhibits(F.to_json(F.struct(F.struct("item").alias("directory")))).alias("exhibits"))


def _tag(name: str, *inner: Column | str) -> Column:
    return F.concat(F.lit(f"<{name}>"), *(F.lit(x) if isinstance(x, str) else x.cast("string") for x in inner), F.lit(f"</{name}>"))


@query("""with lines as (select *, l_linenumber % 4 = 0 as derivative from lineitem), placed as (select *, row_number() over (partition by l_orderkey order by derivative, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as place from lines)
    select 'u' || l_orderkey as url, place as ordinal, 'SUP' || (l_orderkey % 10) as issuer, ['Owner ' || l_orderkey] as owners, case l_returnflag when 'R' then 'S' else 'P' end as code, case l_returnflag when 'R' then 'D' else 'A' end as acquired_disposed,
        derivative, l_orderkey % 3 = 0 or l_orderkey % 5 = 0 as planned, case when l_linenumber = 3 then null else l_quantity end as shares, case when l_orderkey % 4 = 0 then null else l_extendedprice end as price, l_shipdate::date::timestamp as ts from placed""")
def ownership_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each order, its lines as trades: some numbers aren't finite, plans are flagged or told in a footnote."""
    value = lambda name, x: _tag(name, _tag("value", x))
    sold, k = F.col("l_returnflag") == "R", F.col("l_orderkey")
    shares, price = F.when(F.col("l_linenumber") == 3, "NaN").otherwise(F.col("l_quantity").cast("string")), F.when(k % 4 == 0, "n/a").otherwise(F.col("l_extendedprice").cast("string"))
    amounts = _tag("transactionAmounts", value("transactionShares", shares), value("transactionPricePerShare", price), value("transactionAcquiredDisposedCode", F.when(sold, "D").otherwise("A")))
    body = F.concat(value("securityTitle", "Common"), value("transactionDate", F.date_format("l_shipdate", "yyyy-MM-dd")), _tag("transactionCoding", _tag("transactionCode", F.when(sold, "S").otherwise("P"))), amounts)
    derivative = F.col("l_linenumber") % 4 == 0
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*(F.array_sort(F.collect_list(F.when(w, F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", _tag(f"{n}Transaction", body).alias("x"))))).alias(n) for n, w in (("nonDerivative", ~derivative), ("derivative", derivative))))
    joined = lambda n: _tag(f"{n}Table", F.array_join(F.transform(n, lambda x: x["x"]), ""))
    xml = _tag(
        "ownershipDocument", "<documentType>4</documentType>", _tag("issuer", _tag("issuerTradingSymbol", "sup", k % 10)), _tag("reportingOwner", _tag("reportingOwnerId", _tag("rptOwnerName", " Owner ", k, " "))),
        _tag("aff10b5One", F.when(k % 3 == 0, "1").otherwise("0")), joined("nonDerivative"), joined("derivative"), _tag("footnotes", _tag("footnote", F.when(k % 5 == 0, "under a Rule 10b5-1 plan").otherwise("none"))),
    )
    found = filings.ownership(lines.select(F.concat(F.lit("u"), k).alias("url"), xml.alias("xml")))
    return found.select("url", F.col("ordinal").cast("long").alias("ordinal"), "issuer", "owners", "code", "acquired_disposed", "derivative", "planned", "shares", "price", _utc("ts"))


@query("""select 'u' || o_orderkey as url, 'Issuer ' || o_custkey as issuer, case when o_orderkey % 3 > 0 then 'Seller ' || o_orderkey end as seller, 'Common' as class, case when o_orderkey % 4 > 0 then (o_orderkey % 1000)::double end as units,
    o_totalprice as value, o_orderdate::date::timestamp as sale_date, case when o_orderkey % 2 = 0 then 'Broker' end as broker from orders""")
def proposed_sale_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    seller = F.when(k % 3 == 1, _tag("filerName", "Seller ", k)).when(k % 3 == 2, _tag("p:sellerName", " Seller ", k, " ")).otherwise("")
    units = F.when(k % 4 > 0, F.concat(F.when(k % 2 == 0, _tag("noOfUnitsSold", k % 1000)).otherwise(_tag("unitsToBeSold", k % 1000)))).otherwise("<noOfUnitsSold>inf</noOfUnitsSold>")
    xml = F.concat(
        F.lit('<p:notice xmlns:p="urn:p">'), _tag("p:issuerName", "Issuer ", F.col("o_custkey")), seller, _tag("securitiesClassTitle", "Common"), units, _tag("aggregateMarketValue", F.col("o_totalprice")),
        _tag("approxSaleDate", F.date_format("o_orderdate", "yyyy-MM-dd")), F.when(k % 2 == 0, "<brokerName>Broker</brokerName>").otherwise(""), F.lit("</p:notice>"),
    )
    found = filings.proposed_sales(table(spark, sf_dir, "orders").select(F.concat(F.lit("u"), k).alias("url"), xml.alias("xml")))
    return found.select("url", "issuer", "seller", "class", "units", "value", _utc("sale_date"), "broker")


FUND_SQL = """facts as (select 'f' || s_suppkey as url, case s_suppkey % 4 when 0 then 'N-CEN' else 'NPORT-P' end as form, case when s_suppkey % 5 = 0 then 'form' when s_suppkey % 7 = 0 then 'company' when s_suppkey % 4 > 0 and s_suppkey % 11 = 0 then 'series' end as reason, s_suppkey % 6 as holdings from supplier)"""


def _funds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    form, url = F.when(k % 4 == 0, "N-CEN").otherwise("NPORT-P"), F.concat(F.lit("f"), k)
    cik = lambda more: F.lpad((k + more).cast("string"), 10, "0")
    xml = F.concat(
        F.lit('<n:edgarSubmission xmlns:n="urn:n">'), _tag("n:submissionType", F.when(k % 5 == 0, "N-PX").otherwise(form)), _tag("n:cik", F.when(k % 7 == 0, cik(1)).otherwise(cik(0))),
        _tag("seriesId", F.when(k % 11 == 0, "S0").otherwise(F.concat(F.lit("S"), k))), _tag("seriesId", "S9"), _tag("classId", "C", k), F.repeat(F.lit("<n:invstOrSec><name>x</name></n:invstOrSec>"), (k % 6).cast("int")), F.lit("</n:edgarSubmission>"),
    )
    suppliers = table(spark, sf_dir, "supplier")
    expected = suppliers.select(url.alias("url"), form.alias("form"), cik(0).alias("cik"), F.concat(F.lit("S"), k).alias("series"), F.concat(F.lit("C"), k).alias("class"))
    return filings.fund_reports(suppliers.select(url.alias("url"), xml.alias("xml")), expected)


@query(f"with {FUND_SQL} select url, form, holdings::int as holdings, reason from facts")
def fund_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = _funds(spark, sf_dir)
    none = F.lit(None)
    both = good.select("url", "form", "holdings", none.cast("string").alias("reason")).unionByName(bad.select("url", none.cast("string").alias("form"), none.cast("int").alias("holdings"), "reason"))
    wanted = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), "s_suppkey").alias("url"), F.when(F.col("s_suppkey") % 4 == 0, "N-CEN").otherwise("NPORT-P").alias("form"), (F.col("s_suppkey") % 6).cast("int").alias("holdings"))
    return both.drop("form", "holdings").join(wanted, "url")


@query("""select o_custkey::varchar as cik, o_orderkey, case o_orderkey % 4 when 0 then 'N-CEN' when 1 then 'NPORT-P/A' else 'NPORT-P' end as form from orders where o_custkey % 5 > 0 and o_orderkey % 4 < 3 and o_orderdate >= timestamp '1998-01-01'""")
def fund_filing_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth payload is another company's."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(
        c.cast("string").alias("cik"), F.when(c % 5 > 0, c).otherwise(c + 1).cast("string").alias("payload_cik"), "o_orderkey", F.col("o_orderdate").alias("ts"),
        F.when(k % 4 == 0, "N-CEN").when(k % 4 == 1, "NPORT-P/A").when(k % 4 == 2, "NPORT-P").otherwise("485BPOS").alias("form"),
    )
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_custkey").cast("string").alias("cik"))
    return filings.fund_filings(rows, F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")), expected).select("cik", "o_orderkey", "form")


@query(f"""with entries as (select user_id as feed_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as n, event_type from events),
    kept as (select * from entries where n <= 50), bad as (select feed_id from kept group by 1 having bool_or(event_id % 97 = 0))
    select feed_id, n - 1 as ordinal, 'Title ' || event_id as title, 'https://www.f' || feed_id || '.com/' || event_id as url, case when feed_id % 2 = 0 then 'g' || event_id else 'https://www.f' || feed_id || '.com/' || event_id end as record_id, date_trunc('second', ts) as ts
    from kept where feed_id not in (select feed_id from bad) and event_type <> 'error' and date_trunc('second', ts) >= timestamp '{AS_OF}' - interval 25 days""")
def feed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed for each user, RSS where even, Atom where odd; a link to another host fails its whole feed, and an entry without a title goes."""
    n, feed = F.col("event_id"), F.col("user_id")
    url = F.concat(F.lit("https://"), F.when(n % 97 == 0, "evil.example").otherwise(F.concat(F.lit("www.f"), feed, F.lit(".com"))), F.lit("/"), n)
    title = F.when(F.col("event_type") == "error", " ").otherwise(F.concat(F.lit("Title "), n))
    rss = _tag("item", _tag("title", title), _tag("link", url), _tag("guid", "g", n), _tag("pubDate", F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), " GMT"))
    atom = _tag("entry", _tag("title", title), F.concat(F.lit('<link rel="self" href="https://other.example/x"/><link rel="alternate" href="'), url, F.lit('"/>')), _tag("id", url), _tag("updated", _iso("ts")))
    each = F.struct("ts", "event_id", F.when(feed % 2 == 0, rss).otherwise(atom).alias("x"))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(each)).alias("e"))
    body = F.array_join(F.transform("e", lambda e: e["x"]), "")
    xml = F.when(feed % 2 == 0, _tag("rss", _tag("channel", body))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), body, F.lit("</feed>")))
    found, _ = feeds.issuer_feed(rows.select(feed.alias("feed_id"), F.concat(F.lit("f"), feed, F.lit(".com")).alias("official_host"), xml.alias("xml")), (as_of() - F.make_dt_interval(F.lit(25))).cast("timestamp"))
    return found.select("feed_id", F.col("ordinal").cast("long").alias("ordinal"), "title", "url", "record_id", _utc("ts"))


@query("""with e as (select user_id as issuer, event_id, date_trunc('second', ts) as ts, row_number() over (partition by user_id order by ts, event_id) - 1 as ordinal from events)
    select issuer, ordinal, 'News ' || event_id as title, 'https://n.example/' || event_id as url, 'n.example' as domain, case when event_id % 4 = 3 then date_trunc('day', ts) else ts end as ts from e where ordinal < 50 and event_id % 5 > 0 and event_id % 6 > 0""")
def news_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for each user: times come in four ways, every fifth link isn't https, every sixth title is empty."""
    n = F.col("event_id")
    seen = F.when(n % 4 == 0, F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")).when(n % 4 == 1, F.date_format("ts", "yyyyMMddHHmmss")).when(n % 4 == 2, _iso("ts")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    article = F.struct(
        "ts", n.alias("event_id"), F.concat(F.when(n % 5 == 0, "http").otherwise("https"), F.lit("://n.example/"), n).alias("url"), F.when(n % 6 == 0, " ").otherwise(F.concat(F.lit(" News "), n)).alias("title"),
        seen.alias("seendate"), F.lit("N.example").alias("domain"), F.lit("English").alias("language"),
    )
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("issuer")).agg(F.array_sort(F.collect_list(article)).alias("articles"))
    found = feeds.news_search(rows.select("issuer", F.to_json(F.struct("articles")).alias("payload")))
    return found.select("issuer", F.col("ordinal").cast("long").alias("ordinal"), "title", "url", "domain", _utc("ts"))


@query(r"""with grams as (select source as file, doc_id as line, (doc_id % 300)::varchar as document, ' ' || trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g')) || ' ' as body from documents where doc_id % 10 > 0 and strlen((doc_id % 300)::varchar) + strlen(text) + 3 <= 64000),
    named as (select distinct file, line, document, issuer from grams, (values ('alpha', 'the'), ('beta', 'de'), ('gamma', 'der')) as r(issuer, alias) where contains(body, ' ' || alias || ' ')),
    found as (select file, issuer, document, min(line) as first, count(*) as matches from named group by all),
    candidates as (select * from found qualify row_number() over (partition by file, issuer order by first) <= 200),
    toc as (select source as file, min(doc_id) as line, (doc_id % 300)::varchar as document from documents where doc_id % 300 % 4 > 0 group by all),
    met as (select c.*, row_number() over (partition by file, issuer order by toc.line) as n from candidates c join toc using (file, document)),
    kept as (select file, issuer, count(*) filter (n <= 50) as ingested, count(*) filter (n > 50) as overflow from met group by all)
    select file, issuer, count(*) as candidates, sum(matches)::bigint as matches, coalesce(any_value(ingested), 0) as ingested, coalesce(any_value(overflow), 0) as overflow, coalesce(any_value(ingested + overflow), 0) as accepted
    from candidates left join kept using (file, issuer) group by all""")
def ngram_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each source: tab-separated lines, a whole text each, those over MOST_LINE_BYTES and every tenth of another form, and contents as lines of JSON, some of them broken."""
    docs, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    ident = (n % 300).cast("string")
    gram = F.regexp_replace("text", r"[\t\n\r]", " ")
    line = F.when(n % 20 == 0, F.concat(ident, F.lit("\t"), gram)).when(n % 20 == 10, F.concat(F.lit("x"), ident, F.lit("\t"), gram, F.lit("\t1"))).otherwise(F.concat(ident, F.lit("\t"), gram, F.lit("\t3")))
    grams = feeds.ngram_lines(docs.select(line.alias("value"), F.col("source").alias("file"), n.alias("line")))
    first = docs.groupBy(F.col("source").alias("file"), ident.alias("ID")).agg(F.min("doc_id").alias("line"))
    entry = F.to_json(F.struct("ID", F.concat(F.lit("Title "), "ID").alias("title"), F.concat(F.lit("https://p.example/"), "ID").alias("url"), F.lit("2024-01-02").alias("date")))
    value = F.when(F.col("ID").cast("int") % 4 == 0, F.lit('{"ID": 3, broken')).otherwise(entry)
    toc = feeds.content_lines(first.select(value.alias("value"), "file", "line"))
    rules = [("alpha", "a", "the"), ("beta", "b", "de"), ("gamma", "c", "der")]
    frame = spark.createDataFrame([(*r, [], [], None, None) for r in rules], "issuer string, rule_id string, alias string, required array<string>, negative array<string>, valid_from string, valid_to string")
    return feeds.news_refresh(grams, toc, frame)[1].select("file", "issuer", "candidates", "matches", "ingested", "overflow", "accepted")


@query("""with files as (select distinct date_trunc('minute', ts) as minute from events where ts < timestamp '2024-01-15 12:00:00'), age as (select *, date_diff('minute', minute, timestamp '2024-01-15 12:00:00') as a from files),
    due as (select * from age where a between 5 and 20 order by minute desc limit 5) select 'ngrams-' || strftime(minute, '%Y%m%d%H%M') as path, row_number() over (order by minute) as place from due
    union all select 'none', 0 where not exists (from due)""")
def minute_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five files that are due, to be read oldest first; a row without a file where none is."""
    listing = table(spark, sf_dir, "events").where("ts < timestamp_ntz '2024-01-15 12:00:00'").select(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).distinct()
    due = feeds.minute_files(listing.withColumn("path", F.concat(F.lit("ngrams-"), F.date_format("minute", "yyyyMMddHHmm"))), F.to_timestamp_ntz(F.lit("2024-01-15 12:00:00"))).select("path", F.col("place").cast("long").alias("place"))
    none = spark.range(1).select(F.lit("none").alias("path"), F.lit(0).cast("long").alias("place"))
    return due.unionByName(none.join(due.select(F.lit(True).alias("some")).limit(1), F.lit(True), "left_anti"))


@query("""select user_id as issuer, 'at://did:x/post/' || event_id as uri, sha256('did:' || (event_id % 50)) as author, 'https://bsky.app/profile/h' || (event_id % 50) || '.example/post/' || event_id as url, event_id % 4 < 2 as named, date_trunc('second', ts) as ts from events""")
def post_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    text = F.when(n % 4 == 0, "look at $ACME now").when(n % 4 == 1, "the acme corp rises").when(n % 4 == 2, "$ACMEX only").otherwise("acme corporate")
    record = F.struct(text.alias("text"), F.when(n % 3 > 0, _iso("ts")).otherwise("junk").alias("createdAt"))
    post = F.struct(F.concat(F.lit("at://did:x/post/"), n).alias("uri"), F.struct(F.concat(F.lit("did:"), n % 50).alias("did"), F.concat(F.lit("h"), n % 50, F.lit(".example")).alias("handle")).alias("author"), record.alias("record"), _iso("ts").alias("indexedAt"))
    pages = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("issuer")).agg(F.collect_list(post).alias("posts"))
    found = feeds.posts(pages.select("issuer", F.to_json(F.struct("posts")).alias("payload")))
    return found.select("issuer", "uri", "author", feeds.post_url(F.col("uri"), F.col("handle")).alias("url"), feeds.names_ticker(F.col("text"), "ACME", ("acme corp",)).alias("named"), _utc("ts"))


def _vendor(spark: SparkSession, sf_dir: str, *fields: Column) -> DataFrame:
    """A payload for each user: a list of rows with these fields, by event."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("issuer")).agg(F.array_sort(F.collect_list(F.struct("event_id", *fields))).alias("rows"))
    return rows.select("issuer", F.to_json("rows").alias("payload"))


ORDINAL_SQL = "e as (select *, row_number() over (partition by user_id order by event_id) - 1 as ordinal from events)"


@query(f"""with {ORDINAL_SQL} select user_id as issuer, ordinal, 'Item ' || event_id as title, case when event_id % 3 > 0 then 'site' end as site, date_trunc('second', ts) as ts from e where event_id % 7 > 0 and date_trunc('second', ts) >= timestamp '{AS_OF}' - interval 20 days""")
def vendor_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    title, site = F.when(n % 7 > 0, F.concat(F.lit("Item "), n)), F.when(n % 3 > 0, "site").otherwise("")
    payloads = _vendor(spark, sf_dir, title.alias("title"), site.alias("site"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("publishedDate"))
    found = feeds.vendor_news(payloads, (as_of() - F.make_dt_interval(F.lit(20))).cast("timestamp"))
    return found.select("issuer", F.col("ordinal").cast("long").alias("ordinal"), "title", "site", _utc("ts"))


@query(f"""with {ORDINAL_SQL} select user_id as issuer, ordinal, case event_id % 3 when 0 then 'P-Purchase' when 1 then 'S-Sale' else 'A-Award' end as kind, 'Person ' || (event_id % 9) as person, case when event_id % 5 > 0 then (event_id % 100 + 1)::double end as shares, value as price, ts::date::timestamp as ts from e""")
def vendor_trade_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    fields = (
        F.when(n % 3 == 0, "P-Purchase").when(n % 3 == 1, "S-Sale").otherwise("A-Award").alias("transactionType"), F.concat(F.lit("Person "), n % 9).alias("reportingName"),
        F.when(n % 5 > 0, n % 100 + 1).otherwise(0).alias("securitiesTransacted"), F.col("value").alias("price"), F.date_format("ts", "yyyy-MM-dd").alias("transactionDate"),
    )
    found = feeds.vendor_trades(_vendor(spark, sf_dir, *fields))
    return found.select("issuer", F.col("ordinal").cast("long").alias("ordinal"), "kind", "person", "shares", "price", _utc("ts"))


@query("""with d as (select user_id as issuer, event_type, ts::date::timestamp as ts, round(sum(value), 6) as value from events where event_type in ('view', 'click') group by all),
    r as (select *, row_number() over (partition by issuer, event_type order by ts desc) - 1 as ordinal from d) select issuer, case event_type when 'view' then 'rsi_14' else 'sma_20' end as indicator, ordinal, ts, value from r where ordinal < 12""")
def technical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums as two of the four series, newest first; a lookback of ten days reads twelve rows."""
    days = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("issuer"), "event_type", F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.round(F.sum("value"), 6).alias("value"))
    series = lambda kind, name: F.sort_array(F.collect_list(F.when(F.col("event_type") == kind, F.struct("date", "value"))), asc=False).alias(name)
    rows = days.groupBy("issuer").agg(series("view", "rsi_14"), series("click", "sma_20"))
    found = feeds.technical_series(rows.select("issuer", F.to_json(F.struct("rsi_14", "sma_20")).alias("payload")), F.lit(10))
    return found.select("issuer", "indicator", F.col("ordinal").cast("long").alias("ordinal"), _utc("ts"), "value")


@query(f"""with {ORDINAL_SQL} select user_id as issuer, ordinal, case when event_id % 2 = 0 then ts::date::timestamp else date_trunc('second', ts) end as ts, 'https://l.example/' || event_id as url from e where event_id % 6 > 0""")
def lobbying_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    fields = (F.when(n % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).alias("date"), F.when(n % 6 == 0, "junk").otherwise(_iso("ts")).alias("postedDate"), F.concat(F.lit("https://l.example/"), n).alias("url"))
    payloads = _vendor(spark, sf_dir, F.when(n % 6 == 0, "").otherwise(fields[0]).alias("date"), *fields[1:])
    found = feeds.lobbying_rows(payloads.select("issuer", F.concat(F.lit('{"data":'), "payload", F.lit("}")).alias("payload")))
    return found.select("issuer", F.col("ordinal").cast("long").alias("ordinal"), _utc("ts"), "url")


@query("""select user_id as issuer, case when event_id % 2 = 0 then 'reddit' else 'twitter' end as channel, (event_id % 11)::double as mentions, case when event_id % 3 > 0 then value / 1000 end as score, date_trunc('second', ts) as ts from events where event_id % 13 > 0""")
def sentiment_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    row = F.struct(F.when(n % 13 > 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("soon").alias("atTime"), (n % 11).alias("mention"), F.when(n % 3 > 0, F.col("value") / 1000).alias("score"))
    channel = lambda even: F.collect_list(F.when((n % 2 == 0) == F.lit(even), row))
    payloads = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("issuer")).agg(channel(True).alias("reddit"), channel(False).alias("twitter"))
    found = feeds.sentiment_channels(payloads.select("issuer", F.to_json(F.struct("reddit", "twitter")).alias("payload")))
    return found.select("issuer", "channel", "mentions", "score", _utc("ts"))


@query(f"""with {ORDINAL_SQL} select 'T' || user_id as issuer, ordinal, case when event_id % 2 = 0 then 'call' else 'put' end as side, value as premium, case when event_id % 10 > 0 then (event_id % 10)::double end as volume, date_trunc('second', ts) as ts from e where event_id % 9 > 0""")
def option_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists in three forms by user; zero volumes count as absent, every ninth row is another symbol's."""
    n = F.col("event_id")
    fields = (
        F.when(n % 9 > 0, F.concat(F.lit("t"), "user_id")).otherwise("OTHER").alias("symbol"), F.when(n % 2 == 0, "call").otherwise("put").alias("call_put"), F.col("value").alias("premium"),
        (n % 10).alias("volume"), _iso("ts").alias("timestamp"),
    )
    p, k = F.col("payload"), F.col("issuer") % 3
    wrapped = F.when(k == 0, p).when(k == 1, F.concat(F.lit('{"data":'), p, F.lit("}"))).otherwise(F.concat(F.lit('{"results":'), p, F.lit("}")))
    found = feeds.option_trades(_vendor(spark, sf_dir, *fields).select(F.concat(F.lit("T"), "issuer").alias("issuer"), wrapped.alias("payload")))
    return found.select("issuer", F.col("ordinal").cast("long").alias("ordinal"), "side", "premium", "volume", _utc("ts"))


@query("""select page_id, page_id % 4 = 1 as hit from pages where page_id % 3 > 0""")
def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the cached pages are of an older parser."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    cache = pages.where("page_id % 2 = 1").withColumn("parser_version", F.when(F.col("page_id") % 4 == 1, "2").otherwise("1"))
    hits, misses = store.hits_and_misses(pages.where("page_id % 3 > 0"), cache, "2", "page_id")
    return hits.select("page_id", F.lit(True).alias("hit")).unionByName(misses.select("page_id", F.lit(False).alias("hit")))


@query("""select page_id, case when page_id % 2 = 0 then '2' else '1' end as parser_version, case when page_id % 4 > 0 then date '2024-01-01' else date '2024-02-01' end as filed_at, page_id % 2 = 0 as updated from pages""")
def document_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even pages come again; all but every fourth were known."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    row = lambda version, day, fresh: (F.lit(version).alias("parser_version"), F.lit(day).cast("date").alias("filed_at"), F.lit(fresh).alias("updated"))
    old = pages.where("page_id % 4 > 0").select("page_id", *row("1", "2024-01-01", False))
    new = pages.where("page_id % 2 = 0").select("page_id", *row("2", "2024-02-01", True))
    return store.merge_documents(old, new, "page_id", ("filed_at",))
