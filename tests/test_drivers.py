"""Collectors where documents, indexes and identities are missing, too large or too many."""

import json
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from ferrule.operators import documents, drivers
from ferrule.plans import catalogue

NOW = datetime(2026, 7, 12)


def payload(*rows):
    """(form, days ago, accession, document, items)"""
    recent = {
        "form": [r[0] for r in rows], "filingDate": [(NOW - timedelta(days=r[1])).strftime("%Y-%m-%d") for r in rows], "accessionNumber": [r[2] for r in rows], "primaryDocument": [r[3] for r in rows],
        "items": [r[4] if len(r) > 4 else "" for r in rows],
    }
    return json.dumps({"cik": "1", "filings": {"recent": recent}})


def frames(spark, payloads, tickers=("A", "FUND", "LOST")):
    asked = spark.createDataFrame([(t,) for t in tickers], "ticker string")
    return asked, spark.createDataFrame([("FUND",)], "ticker string"), spark.createDataFrame([("A", "0000000001")], "ticker string, cik string"), spark.createDataFrame(payloads, "cik string, payload string")


def url(accession, document):
    return f"https://www.sec.gov/Archives/edgar/data/1/{accession.replace('-', '')}/{document}"


def warnings(found):
    return {r.ticker: [w.warning for w in sorted(r.w)] for r in found.warnings.groupBy("ticker").agg(F.collect_list(F.struct("ordinal", "warning")).alias("w")).collect()}


def test_documents_that_cannot_be_read(spark):
    rows = [("8-K", 1, "a-1", "x.htm", "8.01"), ("8-K", 2, "a-2", "x.htm", "8.01"), ("8-K/A", 3, "a-3", "x.htm", "8.01"), ("6-K", 4, "a-4", "x.htm"), ("10-Q", 5, "a-5", "x.htm"), ("8-K", 6, "a-6", "x.htm", "1.03,8.01"), ("8-K", 400, "a-7", "x.htm", "8.01")]
    landed = [(url("a-1", "x.htm"), "<p>It completed an offering of <b>senior notes</b>.</p><script>repurchased 5 shares</script>"), (url("a-2", "x.htm"), "x" * (documents.MOST_DOCUMENT_BYTES + 1)), (url("a-6", "x.htm"), "We repurchased 5 shares.")]
    indexes = [(f"a-{n}", '{"directory": {"item": [{"name": "ex99.htm", "type": ""}]}}') for n in (1, 2, 3)] + [("a-6", "broken")]
    found = drivers.collect_filings(
        *frames(spark, [("0000000001", payload(*rows))]), spark.createDataFrame(landed, "url string, html string"), spark.createDataFrame(indexes, "accession string, payload string"), F.lit(NOW - timedelta(days=90))
    )
    evidence = {r.accession: r for r in found.evidence.collect()}
    assert sorted(evidence) == ["a-1", "a-2", "a-3", "a-4", "a-5", "a-6"]
    read = evidence["a-1"]
    assert (read.context.type, read.context.label, read.context.novelty, read.rule_id, read.document_status) == ("debt_offering", "Debt offering", "new_event", "completed_debt_offering", "matched")
    assert read.notes.endswith(" Debt offering identified by completed_debt_offering@1.") and read.parser_version == "sec-events-v1+sec-primary-document-v1" and read.exhibits == ["ex99.htm"]
    assert {a: evidence[a].document_status for a in ("a-2", "a-3", "a-4", "a-6")} == {"a-2": "unavailable", "a-3": "unavailable", "a-4": None, "a-6": None}
    assert evidence["a-3"].context.novelty == "amendment" and evidence["a-6"].signal == "bankruptcy" and evidence["a-5"].exhibits is None
    assert warnings(found) == {
        "A": [f"SEC {a} {what} was unavailable or malformed." for a, what in (("a-2", "primary document"), ("a-3", "primary document"), ("a-4", "exhibit index"), ("a-6", "exhibit index"))],
        "FUND": ["FUND uses the SEC fund lane; corporate filing semantics were skipped."], "LOST": ["SEC has no CIK for LOST in its mapping or company search."],
    }
    assert {tuple(r) for r in found.results.collect()} == {("A", "fresh", 6), ("FUND", "unsupported", 0), ("LOST", "no_observations", 0)}
    assert {(r.ticker, r.code, r.detail) for r in found.reasons.collect()} == {("FUND", "source_unsupported", "fund_uses_distinct_sec_lane"), ("LOST", "entity_rejected", "cik_unresolved")}


def test_ten_filings_at_most_and_none(spark):
    many = payload(*(("8-K", 1, f"a-{n}", "x.htm") for n in range(14)))
    none = spark.createDataFrame([], "url string, html string"), spark.createDataFrame([], "accession string, payload string")
    found = drivers.collect_filings(*frames(spark, [("0000000001", many)]), *none, F.lit(NOW - timedelta(days=90)))
    assert sorted(r.accession for r in found.evidence.collect()) == sorted(f"a-{n}" for n in range(10))
    quiet = drivers.collect_filings(*frames(spark, [("0000000001", payload())]), *none, F.lit(NOW))
    assert warnings(quiet)["A"] == ["No tracked SEC filings found for A in the lookback window."]


def ownership(*owners, code="P", shares="10"):
    names = "".join(f"<reportingOwner><reportingOwnerId><rptOwnerName>{o}</rptOwnerName></reportingOwnerId></reportingOwner>" for o in owners)
    trade = f"<nonDerivativeTransaction><transactionCoding><transactionCode>{code}</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>{shares}</value></transactionShares><transactionPricePerShare><value>2</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>{'A' if code == 'P' else 'D'}</value></transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction>"
    return f"<ownershipDocument>{names}<nonDerivativeTable>{trade}</nonDerivativeTable></ownershipDocument>"


def test_insiders(spark):
    rows = [("4", 3, "a-1", "d.xml"), ("4", 2, "a-2", "d.xml"), ("144", 1, "a-3", "d.xml"), ("4", 4, "a-4", "")]
    landed = [(url("a-1", "d.xml"), ownership("One", "Two")), (url("a-2", "d.xml"), ownership("Three")), (url("a-3", "d.xml"), "<notice/>")]
    found = drivers.collect_insiders(*frames(spark, [("0000000001", payload(*rows))]), spark.createDataFrame(landed, "url string, xml string"), F.lit(NOW), 90)
    evidence = {r.signal: r for r in found.evidence.collect()}
    cluster = evidence["insider_purchase_strong_cluster"]
    assert (cluster.owners, cluster.net, cluster.source_count, cluster.confidence) == (3, 40.0, 2, 0.88)  # a joint trade counts once
    assert evidence["insider_proposed_sale"].accession == "a-3"
    assert warnings(found)["A"] == ["SEC 4 entry omitted accession or primary document."]
    assert {(r.code, r.scope, r.scope_id) for r in found.reasons.where("ticker = 'FUND'").collect()} == {("source_unsupported", "family", "insider_trading")}


def test_thirty_ownership_documents_newest_first(spark):
    rows = [("4", n, f"a-{n:02}", "d.xml") for n in range(35)]
    landed = [(url(f"a-{n:02}", "d.xml"), ownership(f"Owner {n}")) for n in range(35)]
    found = drivers.collect_insiders(*frames(spark, [("0000000001", payload(*reversed(rows)))]), spark.createDataFrame(landed, "url string, xml string"), F.lit(NOW), 90)
    assert found.evidence.first().owners == 30
    assert warnings(found)["A"] == ["SEC ownership filings truncated to the 30 most recent of 35 in the lookback window."]


@pytest.mark.parametrize("name", ["insider_collector", "insider_collector_status"])
def test_all_documents_of_a_company_are_read_by_the_queries(spark, tmp_path, name):
    """Two companies with more documents than MOST_OWNERSHIP, and their rows by the SQL, which has no bound."""
    duck = duckdb.connect()
    tables = {
        "customer": "select c as c_custkey from range(5) r(c)",
        "orders": "select o as o_orderkey, 2 + o % 2 as o_custkey, timestamp '2001-07-31' - to_days((o * 4)::int) as o_orderdate from range(160) r(o)",
        "lineitem": "select o // 2 as l_orderkey, (1 + o)::double as l_quantity, 2::double as l_extendedprice, ['A', 'N', 'R'][1 + o % 3] as l_returnflag, timestamp '2001-07-31' - to_days((o * 2)::int) as l_shipdate from range(320) r(o)",
    }
    for t, rows in tables.items():
        duck.execute(f"create table {t} as {rows}")
        duck.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    want = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect())


def test_funds(spark):
    schema = "ticker string, identity_status string, cik string, series string, class string"
    identities = spark.createDataFrame([("GOOD", "official_series_class", "1", "S1", "C1"), ("BAD", "official_series_class", "2", "S2", "C2"), ("TYPED", "issuer_only", "3", None, None), ("QUIET", "official_series_class", "4", "S4", "C4")], schema)
    asked = spark.createDataFrame([(t,) for t in ("GOOD", "BAD", "TYPED", "QUIET", "OTHER")], "ticker string")
    report = lambda n, s: f"<r><submissionType>NPORT-P</submissionType><cik>{n}</cik><seriesId>{s}</seriesId><classId>C{n}</classId></r>"
    payloads = [("0000000001", "1", payload(("NPORT-P", 1, "a-1", "d.xml"), ("N-CEN", 2, "a-2", "d.xml"))), ("0000000002", "2", payload(("NPORT-P", 1, "a-3", "d.xml"))), ("0000000003", "3", payload(("NPORT-P", 1, "a-4", "d.xml"))), ("0000000004", "4", payload())]
    landed = [(url("a-1", "d.xml"), report(1, "S1")), (url("a-3", "d.xml").replace("/1/", "/2/"), report(2, "S9")), (url("a-4", "d.xml").replace("/1/", "/3/"), report(3, "S3"))]
    found = drivers.collect_funds(asked, identities, spark.createDataFrame(payloads, "cik string, payload_cik string, payload string"), spark.createDataFrame(landed, "url string, xml string"), F.lit(NOW - timedelta(days=90)))
    assert {tuple(r) for r in found.results.collect()} == {("GOOD", "fresh", 1), ("BAD", "unavailable", 0), ("TYPED", "unsupported", 0), ("QUIET", "no_observations", 0), ("OTHER", "no_observations", 0)}
    assert [r.accession for r in found.evidence.collect()] == ["a-1"]
    said = warnings(found)
    assert said["GOOD"] == ["SEC fund filing a-2 was unavailable, oversized, or invalid."] and said["BAD"] == ["SEC fund filing a-3 was unavailable, oversized, or invalid."]
    assert said["QUIET"] == ["No N-CEN or NPORT filings found for QUIET in the lookback window."] and "OTHER" not in said
    assert {(r.ticker, r.code, r.scope, r.scope_id) for r in found.reasons.collect()} == {
        ("GOOD", "source_unavailable", "candidate", "a-2"), ("BAD", "source_unavailable", "candidate", "a-3"), ("TYPED", "source_unsupported", "evaluation", "TYPED")
    }


def test_payloads_and_documents_are_read_once(spark, data):
    """Statuses, warnings and evidence are told of rows that were read before, not by reading them again."""
    from ferrule.plans import driver_queries

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for found in (driver_queries._filings(spark, data), driver_queries._insiders(spark, data)):
        for df in (found.results, found.warnings):
            assert not [x for x in ("from_json", "jsontostructs", "from_xml", "xmltostructs", "MapInArrow") if x.lower() in plan(df).lower()]
