"""Landed payloads, the store, and streams against their batch forms."""

import gzip
import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ferrule.operators import graph
from ferrule.sources import feeds, filings, store
from ferrule.streaming import events

NOW = datetime(2026, 7, 12, 16)


def frame(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def test_ticker_map(spark):
    payload = json.dumps({"fields": ["cik", "name", "ticker"], "data": [[123, "A Co", "ab"], [4], [5, "C", "c.d"]]})
    assert {(r.ticker, r.cik) for r in filings.ticker_map(frame(spark, payload=payload)).collect()} == {("AB", "0000000123"), ("C.D", "0000000005")}
    assert frame(spark, t="<feed><CIK>77</CIK></feed>").select(filings.cik_of_feed(F.col("t")).alias("x")).first().x == "0000000077"


def test_submissions_and_filings(spark):
    recent = {"form": ["8-K", "4", "10-Q", "8-K/A"], "filingDate": ["2026-07-01", "2026-07-02", "2026-06-01"], "acceptanceDateTime": ["2026-07-01T10:00:00.000Z"], "accessionNumber": ["1-2-3", "x", "4-5-6", "7"], "primaryDocument": ["a.htm", "b", "xsl/c.htm", "../d"], "items": ["1.03, 9.01"]}
    rows = filings.submissions(frame(spark, cik="0000000123", payload=json.dumps({"filings": {"recent": recent}})))
    assert rows.count() == 4 and rows.orderBy("ordinal").first()["items"] == ["1.03", "9.01"]
    found = {r.ordinal: r for r in filings.filings(rows, F.lit(datetime(2026, 6, 1))).collect()}
    assert set(found) == {0, 2} and found[0].ts == datetime(2026, 7, 1, 10) and found[2].url.endswith("/data/123/456/c.htm") and found[0].strength == 0.8


def test_instants(spark):
    given = ["2026-07-01T10:00:00Z", "2026-07-01", "20260701T100000Z", "20260701100000", "Wed, 01 Jul 2026 10:00:00 GMT", "1782900000", "junk", None]
    got = [r.x for r in spark.createDataFrame([(g,) for g in given], "g string").select(filings.instant(F.col("g")).alias("x")).collect()]
    assert got == [datetime(2026, 7, 1, 10), datetime(2026, 7, 1), *[datetime(2026, 7, 1, 10)] * 3, datetime(2026, 7, 1, 10), None, None]


def test_exhibits(spark):
    index = json.dumps({"directory": {"item": [{"name": "main.htm", "type": "8-K"}, {"name": "q.htm", "type": "EX-99.1"}, {"name": "d_ex99-2.htm", "type": "x"}]}})
    assert frame(spark, p=index).select(filings.exhibits(F.col("p")).alias("x")).first().x == ["q.htm", "d_ex99-2.htm"]


def trade(code, shares, price="2.5"):
    return f"""<securityTitle><value>Common</value></securityTitle><transactionDate><value>2026-07-01</value></transactionDate><transactionCoding><transactionCode>{code}</transactionCode></transactionCoding>
    <transactionAmounts><transactionShares><value>{shares}</value></transactionShares><transactionPricePerShare><value>{price}</value></transactionPricePerShare>
    <transactionAcquiredDisposedCode><value>A</value></transactionAcquiredDisposedCode></transactionAmounts>"""


def test_ownership(spark):
    xml = f"""<ownershipDocument><documentType>4</documentType><issuer><issuerCik>1</issuerCik><issuerTradingSymbol>ab</issuerTradingSymbol></issuer>
    <reportingOwner><reportingOwnerId><rptOwnerName>Jo</rptOwnerName></reportingOwnerId></reportingOwner><reportingOwner><reportingOwnerId><rptOwnerName>Mo</rptOwnerName></reportingOwnerId></reportingOwner>
    <nonDerivativeTable><nonDerivativeTransaction>{trade("P", 10)}</nonDerivativeTransaction><nonDerivativeTransaction>{trade("S", "NaN")}</nonDerivativeTransaction></nonDerivativeTable>
    <derivativeTable><derivativeTransaction>{trade("M", 5)}</derivativeTransaction></derivativeTable><footnotes><footnote id="F1">under a Rule 10b5-1 plan</footnote></footnotes></ownershipDocument>"""
    rows = filings.ownership(frame(spark, url="u", xml=xml)).orderBy("ordinal").collect()
    assert [(r.code, r.shares, r.derivative) for r in rows] == [("P", 10.0, False), ("S", None, False), ("M", 5.0, True)]
    assert rows[0].issuer == "AB" and rows[0].owners == ["Jo", "Mo"] and rows[0].planned and rows[0].ts == datetime(2026, 7, 1)
    assert filings.ownership(frame(spark, url="u", xml="<!DOCTYPE x>" + xml)).count() == 0


def test_proposed_sales_and_funds(spark):
    xml = "<n:doc xmlns:n='urn:x'><n:issuerName>A</n:issuerName><n:noOfUnitsSold>12</n:noOfUnitsSold><n:approxSaleDate>2026-07-02</n:approxSaleDate></n:doc>"
    row = filings.proposed_sales(frame(spark, url="u", xml=xml)).first()
    assert (row.issuer, row.units, row.broker, row.sale_date) == ("A", 12.0, None, datetime(2026, 7, 2))
    fund = "<d xmlns='urn:y'><submissionType>NPORT-P</submissionType><cik>5</cik><seriesId>S1</seriesId><classId>C1</classId><invstOrSec/><invstOrSec/></d>"
    expected = spark.createDataFrame([("a", "NPORT-P", "0000000005", "S1", "C1"), ("b", "NPORT-P", "0000000005", "S2", "C1")], "url string, form string, cik string, series string, class string")
    good, bad = filings.fund_reports(spark.createDataFrame([("a", fund), ("b", fund)], "url string, xml string"), expected)
    assert [(r.url, r.holdings) for r in good.collect()] == [("a", 2)] and [tuple(r) for r in bad.collect()] == [("b", "series")]


def test_feed(spark):
    item = lambda link: f"<item><title> T </title><link>{link}</link><guid>g</guid><pubDate>Wed, 01 Jul 2026 10:00:00 GMT</pubDate></item>"
    feed = lambda *links: "<rss><channel>" + "".join(map(item, links)) + "</channel></rss>"
    rows = [("ok", "a.com", feed("https://ir.a.com/1", "https://a.com/2")), ("off", "a.com", feed("https://a.com/1", "https://b.com/2"))]
    entries, failed = feeds.issuer_feed(spark.createDataFrame(rows, "feed_id string, official_host string, xml string"), F.lit(datetime(2026, 6, 1)))
    assert {(r.feed_id, r.title, r.url) for r in entries.collect()} == {("ok", "T", "https://ir.a.com/1"), ("ok", "T", "https://a.com/2")} and [r.feed_id for r in failed.collect()] == ["off"]


def test_ngrams_and_contents(spark, tmp_path):
    with gzip.open(tmp_path / "m.txt.gz", "wt") as f:
        f.write("d1\tacme wins big\t3\nbad line\nd2\tx\ty\n")
    assert [(r.document, r.n) for r in feeds.ngrams(spark, str(tmp_path / "m.txt.gz")).collect()] == [("d1", 3)]
    (tmp_path / "t.json").write_text('{"ID": "d1", "title": "T", "url": "https://e.org", "date": "20260701100000"}\nnot json\n{"ID": "d2", "url": "http://e.org"}\n')
    assert [(r.document, r.ts) for r in feeds.contents(spark, str(tmp_path / "t.json")).collect()] == [("d1", datetime(2026, 7, 1, 10))]
    first, more = feeds.capped(spark.range(7).selectExpr("id % 2 as k", "id"), ["k"], "id", 3)
    assert first.count() == 6 and [tuple(r) for r in more.collect()] == [(0, 1)]


def test_posts_and_vendors(spark):
    page = json.dumps({"posts": [{"uri": "at://x/1", "author": {"did": "d", "handle": "h"}, "record": {"text": "buy $AB now", "createdAt": "2026-07-01T10:00:00Z"}}]})
    row = feeds.posts(frame(spark, issuer="AB", payload=page)).withColumn("hit", feeds.names_ticker(F.col("text"), "AB")).withColumn("link", feeds.post_url(F.col("uri"), F.col("handle"))).first()
    assert row.hit and row.ts == datetime(2026, 7, 1, 10) and row.link.endswith("/h/post/1")
    assert not frame(spark, t="x$ABC").select(feeds.names_ticker(F.col("t"), "AB").alias("x")).first().x
    social = json.dumps({"reddit": [{"atTime": "2026-07-01 10:00:00", "mention": 3, "score": 0.5}], "twitter": [{"atTime": "2026-07-01 10:00:00", "positiveMention": 2}]})
    assert feeds.sentiment_channels(frame(spark, issuer="AB", payload=social)).count() == 2
    trades = [json.dumps({"data": [{"symbol": "ab", "premium": 0, "total_premium": "7", "type": "call", "date": "2026-07-01"}, {"symbol": "zz", "date": "2026-07-01"}]}), json.dumps([{"call_put": "p", "premium": 2.5, "time": "2026-07-01"}])]
    rows = feeds.option_trades(spark.createDataFrame([("AB", t) for t in trades], "issuer string, payload string")).collect()
    assert {(r.side, r.premium) for r in rows} == {("call", 7.0), ("p", 2.5)}


def test_store(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "k long, v string, etag string")
    assert store.read(spark, path) is None
    store.upsert_state(rows((1, "a", "e1"), (2, "b", None)), path, ["k"])
    store.upsert_state(rows((1, "c", None), (3, "d", None)), path, ["k"])
    assert {tuple(r) for r in store.read(spark, path).collect()} == {(1, "c", "e1"), (2, "b", None), (3, "d", None)}
    cache = spark.createDataFrame([("u1", "p1"), ("u2", "p0")], "url string, parser_version string")
    hit, miss = store.hits_and_misses(spark.createDataFrame([("u1",), ("u2",), ("u3",)], "url string"), cache, "p1")
    assert [r.url for r in hit.collect()] == ["u1"] and {r.url for r in miss.collect()} == {"u2", "u3"}
    assert {tuple(r) for r in store.counts({"a": cache, "b": cache.limit(0)}).collect()} == {("a", 2), ("b", 0)}


def observed(spark):
    titles = ["Acme wins big order", "Acme wins big order today", "Correction: Acme wins big order", "Other", "Acme wins big order"]
    rows = [("XY"[i % 2], f"s{i}", "1", "discovery", f"https://e{i}.org/", titles[i % 5], NOW + timedelta(hours=i), i) for i in range(20)]
    return graph.observations(spark.createDataFrame(rows, "issuer string, source_id string, record_id string, tier string, url string, title string, published_at timestamp_ntz, arrival long"))


def test_graph_stream_equals_batch(spark, tmp_path):
    seen = observed(spark)
    for part in range(2):
        seen.where(F.floor(F.col("arrival") / 10) == part).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = events.graph_stream(stream).writeStream.format("memory").queryName("graph").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {r.arrival: (r.event_id, r.version, r.correction_of) for r in spark.table("graph").collect()}
    assert got == {r.arrival: (r.event_id, r.version, r.correction_of) for r in graph.near_events(seen).collect()}


def test_tables_of_streams(spark, tmp_path):
    seen = observed(spark)
    for part in range(2):
        seen.where(F.col("arrival") % 2 >= part).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    assert events.observations_to_table(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    assert store.read(spark, str(tmp_path / "t")).count() == 20
    days = events.attention_stream(stream.select("issuer", F.col("record_id").alias("uri"), F.col("published_at").cast("timestamp").alias("ts")))
    query = days.writeStream.format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and spark.table("days").columns == ["issuer", "day", "post_count"]


def test_states_of_a_stream(spark, tmp_path):
    schema = "k string, checked timestamp_ntz, succeeded timestamp_ntz"
    for n, rows in enumerate([[("a", NOW, NOW)], [("a", NOW + timedelta(hours=1), None), ("b", NOW, None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    assert events.states_to_table(stream, str(tmp_path / "t"), ["k"], str(tmp_path / "c")).awaitTermination(120)
    assert {r.k: r.succeeded for r in store.read(spark, str(tmp_path / "t")).collect()} == {"a": NOW, "b": None}


def test_additions(spark, tmp_path):
    """Only new keys are written, a table reads as before after compaction, and half a write is no version."""
    path = str(tmp_path / "t")
    for ids in ([1, 2, 2], [2, 3], [3], [4]):
        store.append_new(spark.createDataFrame([(i,) for i in ids], "id long"), path, "id")
    assert store.versions(spark, path) == [0, 1, 2, 3]
    assert sorted(r.id for r in spark.read.parquet(f"{path}/added-1").collect()) == [3] and spark.read.parquet(f"{path}/added-2").count() == 0
    assert store.compact(spark, path) == store.compact(spark, path) == 3 and store.versions(spark, path) == [0, 1, 2, 3] and sorted(r.id for r in store.read(spark, path).collect()) == [1, 2, 3, 4]
    (tmp_path / "t" / "added-4").mkdir()
    store.append_new(spark.createDataFrame([(4,), (5,)], "id long"), path, "id", 4)
    assert sorted(r.id for r in store.read(spark, path).collect()) == [1, 2, 3, 4, 5] and store.compact(spark, str(tmp_path / "none")) is None


def test_a_notice_is_parsed_once_and_a_broken_one_has_no_facts(spark):
    xml = "<n:doc xmlns:n='urn:x'><n:issuerName> A <b>B</b></n:issuerName><issuerName>C</issuerName><filerName/><sellerName>S</sellerName></n:doc>"
    docs = spark.createDataFrame([("good", xml), ("broken", "<doc><issuerName>A</doc>"), ("typed", "<!DOCTYPE d>" + xml), ("none", None)], "url string, xml string")
    found = filings.proposed_sales(docs)
    assert {(r.url, r.issuer, r.seller, r.units) for r in found.collect()} == {("good", "A B", "S", None), *((n, None, None, None) for n in ("broken", "typed", "none"))}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<lambda>(") == 1 and "xpath" not in plan


def test_zero_premium_and_price_are_told(spark):
    options = [{"symbol": "ab", "premium": p, "total_premium": t, "date": "2026-07-01"} for p, t in ((0.0, None), (0, "7"), (None, None), (None, "0"), ("x", 0))]
    rows = feeds.option_trades(spark.createDataFrame([("AB", json.dumps(options))], "issuer string, payload string"))
    assert [r.premium for r in rows.orderBy("ordinal").collect()] == [0.0, 7.0, None, 0.0, 0.0]
    trades = [{"price": p, "shares": 1, "date": "2026-07-01"} for p in (0.0, "0", None, "", 2)]
    rows = feeds.vendor_trades(spark.createDataFrame([("AB", json.dumps(trades))], "issuer string, payload string"))
    assert [r.price for r in rows.orderBy("ordinal").collect()] == [0.0, 0.0, None, None, 2.0]


def test_instants_of_all_forms(spark):
    day = datetime(2026, 7, 1)
    known = {
        "2026-07-01T10:20:30Z": (10, 20, 30), "2026-07-01t10:20:30.5z": (10, 20, 30, 500000), "2026-07-01T10:20:30.500Z": (10, 20, 30, 500000), "2026-07-01T10:20:30+02:00": (8, 20, 30), "2026-07-01T10:20:30": (10, 20, 30), "2026-07-01 10:20:30": (10, 20, 30),
        " 2026-07-01 ": (), "20260701T102030Z": (10, 20, 30), "20260701T102030+0200": (8, 20, 30), "20260701102030": (10, 20, 30), "Wed, 01 Jul 2026 10:20:30 GMT": (10, 20, 30), "1 Jul 2026 10:20:30 +0100": (9, 20, 30), "1782864000": (), "1782864000000": (), "junk": None, "": None,
    }
    rows = spark.createDataFrame([(t,) for t in known], "t string").select("t", filings.instant(F.col("t")).alias("ts")).collect()
    want = {t: None if at is None else day.replace(hour=(at + (0,))[0], minute=(at + (0, 0))[1], second=(at + (0, 0, 0))[2], microsecond=(at + (0, 0, 0, 0))[3]) for t, at in known.items()}
    assert {r.t: r.ts for r in rows} == want


def test_ownership_documents_as_the_source_reads_them(spark):
    """Elements count by their local names, and what doesn't parse as a whole has no trades."""
    from ferrule.sources import filings

    trade = "<{p}nonDerivativeTransaction><{p}transactionDate><{p}value>2024-01-02</{p}value></{p}transactionDate><{p}transactionCoding><{p}transactionCode>p</{p}transactionCode></{p}transactionCoding></{p}nonDerivativeTransaction>"
    whole = lambda p: f"<{p}doc{' xmlns:' + p[:-1] + '=' + chr(34) + 'urn:x' + chr(34) if p else ''}><{p}issuer><{p}issuerTradingSymbol> ab </{p}issuerTradingSymbol></{p}issuer><{p}nonDerivativeTable>{trade.format(p=p) * 2}</{p}nonDerivativeTable></{p}doc>"
    rows = [("plain", whole("")), ("prefixed", whole("n:")), ("junk behind", whole("") + " x"), ("none", None), ("type", "<!DOCTYPE doc>" + whole(""))]
    found = filings.ownership(spark.createDataFrame(rows, "url string, xml string"))
    got = sorted((r.url, r.ordinal, r.issuer, r.code, str(r.ts), r.owners, r.planned, r.shares) for r in found.collect())
    assert got == [(url, n, "AB", "P", "2024-01-02 00:00:00", [], False, None) for url in ("plain", "prefixed") for n in range(2)]
