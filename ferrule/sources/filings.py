"""Landed payloads of the regulator: ticker map, submissions, filing indexes, ownership and fund documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.numbers import finite
from ferrule.functions.text import first_filled

#: Tracked forms, their strengths, and bounds of a scan.
TRACKED = ("8-K", "8-K/A", "10-Q", "10-Q/A", "10-K", "10-K/A", "6-K", "20-F", "40-F")
STRENGTHS = {"8-K": 0.8, "6-K": 0.75, "10-Q": 0.65, "10-K": 0.7, "20-F": 0.7, "40-F": 0.7}
FUND_FORMS = ("N-CEN", "N-CEN/A", "NPORT-P", "NPORT-P/A")
OTHER_STRENGTH, MOST_FILINGS, MOST_EXHIBITS = 0.6, 10, 20

TICKER_MAP = "fields array<string>, data array<array<string>>"
SUBMISSIONS = "cik string, filings struct<recent: struct<form: array<string>, filingDate: array<string>, acceptanceDateTime: array<string>, accessionNumber: array<string>, primaryDocument: array<string>, items: array<string>>>"
INDEX = "directory struct<item: array<struct<name: string, type: string>>>"


def ticker_map(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(ticker, cik) of payloads of column names and rows; short rows go, and payloads without the two columns have none."""
    parsed = payloads.select(F.from_json(payload, TICKER_MAP).alias("p")).select(F.explode("p.data").alias("row"), F.array_position("p.fields", "ticker").alias("t"), F.array_position("p.fields", "cik").alias("c"))
    parsed = parsed.where("t > 0 and c > 0 and size(row) >= greatest(t, c)")
    found = parsed.select(F.upper(F.element_at("row", F.col("t").cast("int"))).alias("ticker"), F.lpad(F.element_at("row", F.col("c").cast("int")), 10, "0").alias("cik"))
    return found.where("ticker <> '' and cik is not null").dropDuplicates(["ticker"])


def cik_of_feed(text: Column) -> Column:
    """The identifier in the text of a company search, padded; null where there is none."""
    found = F.regexp_extract(text, r"(?i)<cik>([0-9]+)</cik>", 1)
    return F.when(found != "", F.lpad(found, 10, "0"))


def instant(text: Column) -> Column:
    """A time in one of the ways that payloads have it; null for others."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd'T'HHmmssX", "yyyyMMddHHmmss")
    plain = F.trim(text)
    # a form is tried only on texts with its separators, as each failure to parse is an exception
    has_t, has_colon, dashed = plain.rlike("[Tt]"), plain.contains(":"), plain.rlike("[0-9]-")
    zoned = plain.rlike(r"([Zz]|[+-][0-9]{2}:[0-9]{2})$")
    shapes = (has_t & has_colon & zoned, has_t & has_colon & ~zoned, has_colon & ~has_t, dashed & ~has_t & ~has_colon, has_t & ~has_colon, ~dashed & ~has_t & ~has_colon)
    parsed = [F.when(shape, F.try_to_timestamp(plain, F.lit(f))) for f, shape in zip(forms, shapes, strict=True)]
    mail = F.when(plain.rlike(r"[A-Za-z]{3} .*:"), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(plain, r"^[A-Za-z]{3},\s*", ""), "GMT|UTC", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z")))
    epoch = F.when(plain.rlike("^[0-9]{9,10}$"), F.timestamp_seconds(plain.try_cast("double"))).when(plain.rlike("^[0-9]{13}$"), F.timestamp_millis(plain.try_cast("bigint")))
    return F.coalesce(epoch, *parsed, mail)


def submissions(payloads: DataFrame, payload: str = "payload", key: str = "cik") -> DataFrame:
    """One row per filing with its ordinal. Parallel arrays are zipped; where one is short the filing has a null."""
    recent = payloads.select(F.col(key).alias("cik"), F.from_json(payload, SUBMISSIONS)["filings"]["recent"].alias("r"))
    names = ("form", "filingDate", "acceptanceDateTime", "accessionNumber", "primaryDocument", "items")
    empty = F.array().cast("array<string>")
    zipped = F.arrays_zip(*(F.coalesce(F.col(f"r.{n}"), empty).alias(n) for n in names))
    rows = recent.where("r is not null").select("cik", F.posexplode(zipped).alias("ordinal", "f")).select("cik", "ordinal", "f.*")
    codes = F.filter(F.transform(F.split(F.coalesce("items", F.lit("")), ","), lambda c: F.trim(c)), lambda c: c != "")
    return rows.select("cik", "ordinal", "form", F.coalesce(instant(F.col("acceptanceDateTime")), instant(F.col("filingDate"))).alias("ts"), F.col("accessionNumber").alias("accession"), F.col("primaryDocument").alias("document"), codes.alias("items"))


def filings(rows: DataFrame, cutoff: Column, most: int = MOST_FILINGS) -> DataFrame:
    """The first tracked filings of each company in the payload's order, the cutoff included, with their archive URL and strength."""
    kept = rows.where(F.col("form").isin(*TRACKED) & (F.col("ts") >= cutoff) & F.col("accession").isNotNull())
    placed = kept.withColumn("_n", F.row_number().over(Window.partitionBy("cik").orderBy("ordinal"))).where(F.col("_n") <= most).drop("_n")
    strength = F.lit(OTHER_STRENGTH)
    for form, value in STRENGTHS.items():
        strength = F.when(F.col("form") == form, value).otherwise(strength)
    signal = F.concat(F.lit("sec_form_"), F.regexp_replace(F.lower("form"), "[^a-z0-9]+", "_"))
    return placed.withColumns({"url": archive_url(F.col("cik"), F.col("accession"), F.col("document")), "strength": strength, "signal": signal, "amended": F.col("form").endswith("/A")})


def archive_url(cik: Column, accession: Column, document: Column) -> Column:
    """The document's place in the archive by its base name; null for a path that leaves it."""
    name = F.element_at(F.split(document, "/"), -1)
    safe = name.rlike("^[A-Za-z0-9._-]+$") & ~name.isin(".", "..")
    return F.when(safe, F.concat_ws("/", F.lit("https://www.sec.gov/Archives/edgar/data"), F.regexp_replace(cik, "^0+(?=.)", ""), F.replace(accession, F.lit("-"), F.lit("")), name))


def fund_filings(rows: DataFrame, cutoff: Column, expected: DataFrame) -> DataFrame:
    """Tracked fund forms of submissions rows since the cutoff, of the companies in expected (key, cik) whose payload is their own: rows has payload_cik."""
    own = rows.join(expected.select(F.col("key").alias("cik"), F.lpad("cik", 10, "0").alias("_own")), "cik").where(F.lpad("payload_cik", 10, "0") == F.col("_own"))
    return own.where(F.col("form").isin(*FUND_FORMS) & (F.col("ts") >= cutoff)).drop("_own", "payload_cik")


def exhibits(payload: Column) -> Column:
    """Names of the exhibits of a filing's index: by type or by name, the first MOST_EXHIBITS."""
    items = F.coalesce(F.from_json(payload, INDEX)["directory"]["item"], F.array().cast("array<struct<name:string,type:string>>"))
    is_exhibit = lambda i: F.upper(F.coalesce(i["type"], F.lit(""))).startswith("EX-99") | F.contains(F.regexp_replace(F.lower(i["name"]), "[^a-z0-9]", ""), F.lit("ex99"))
    return F.slice(F.transform(F.filter(items, is_exhibit), lambda i: i["name"]), 1, MOST_EXHIBITS)


def _safe(xml: Column) -> Column:
    """XML that declares no document type, as entities are not resolved."""
    return F.when(~xml.rlike("(?i)<!DOCTYPE|<!ENTITY"), xml)


def _named(element, name: str) -> list:
    """Children of an element, null or not, by name; where none has it as it stands, by local name, whatever its case."""
    if element is None:
        return []
    lower = name.lower()
    return element.findall(name) or [e for e in element if isinstance(e.tag, str) and e.tag.rpartition("}")[2].lower() == lower]


def _told(element, *path: str) -> str | None:
    """The trimmed text at a path of names below an element, the last of each name; null without one."""
    for name in path:
        element = next(reversed(_named(element, name)), None)
    if element is None:
        return None
    return ("".join(element.itertext()) if len(element) else element.text or "").strip()


def _trades(xml: str | None) -> list[tuple]:
    """The trades of an ownership document as (ordinal, issuer, owners, flag, notes, derivative, code, acquired_disposed, shares, price, date); none of one that doesn't parse."""
    from xml.etree import ElementTree

    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return []
    owners = [_told(o, "reportingOwnerId", "rptOwnerName") for o in _named(root, "reportingOwner")]
    notes = [_told(n) for n in _named(next(reversed(_named(root, "footnotes")), None), "footnote")]
    whole = (_told(root, "issuer", "issuerTradingSymbol"), owners, _told(root, "aff10b5One"), " ".join(notes))
    rows = []
    for kind, derivative in (("nonDerivative", False), ("derivative", True)):
        for t in _named(next(reversed(_named(root, f"{kind}Table")), None), f"{kind}Transaction"):
            amounts = next(reversed(_named(t, "transactionAmounts")), None)
            amount = [_told(amounts, n, "value") for n in ("transactionAcquiredDisposedCode", "transactionShares", "transactionPricePerShare")]
            rows.append((len(rows), *whole, derivative, _told(t, "transactionCoding", "transactionCode"), *amount, _told(t, "transactionDate", "value")))
    return rows


TOLD = "url string, ordinal int, issuer string, owners array<string>, flag string, notes string, derivative boolean, code string, acquired_disposed string, shares string, price string, date string"


def ownership(documents: DataFrame, xml: str = "xml", key: str = "url") -> DataFrame:
    """One row per transaction of ownership documents, non-derivative first: url, ordinal, issuer, owners, code, acquired_disposed, derivative, planned, shares, price, ts.

    Numbers that aren't finite are null. planned: a flag or a footnote names rule 10b5-1. Elements count by their local names.
    """

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(url, *trade) for url, text in zip(batch["url"].to_pylist(), batch["xml"].to_pylist(), strict=True) for trade in _trades(text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(shape), shape, strict=True)], schema=shape)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shape = to_arrow_schema(StructType.fromDDL(TOLD))
    said = documents.select(F.col(key).cast("string").alias("url"), _safe(F.col(xml)).alias("xml")).mapInArrow(read, TOLD)
    planned = F.lower(F.coalesce("flag", F.lit(""))).isin("1", "true", "yes", "y") | F.col("notes").rlike("(?i)10b5-?1")
    return said.select(
        "url", "ordinal", F.upper("issuer").alias("issuer"), "owners", F.upper("code").alias("code"), F.upper("acquired_disposed").alias("acquired_disposed"),
        "derivative", planned.alias("planned"), finite(F.col("shares")).alias("shares"), finite(F.col("price")).alias("price"), instant(F.col("date")).alias("ts"),
    )


def _any(xml: Column, *names: str) -> Column:
    """The text of the first element with one of these names, whatever its namespace; null if there is none."""
    return first_filled(*(F.trim(F.xpath_string(xml, F.lit(f"//*[local-name()='{n}']"))) for n in names))


def _first_texts(xml: str | None, names: tuple[str, ...]) -> list[str | None] | None:
    """The text of the first element with each name, whatever its namespace; None without one. A document that doesn't parse has none."""
    from xml.etree import ElementTree

    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return None
    first = {}
    for element in root.iter():
        if isinstance(element.tag, str):
            first.setdefault(element.tag.rpartition("}")[2], element)
    return ["".join(first[n].itertext()) if n in first else None for n in names]


#: Elements of a notice of a proposed sale, by the fact that they tell, the first filled one counts.
NOTICE = {
    "issuer": ("issuerName",), "seller": ("nameOfPersonForWhoseAccountTheSecuritiesAreToBeSold", "filerName", "sellerName"), "class": ("securitiesClassTitle", "classTitle"), "units": ("noOfUnitsSold", "unitsToBeSold"),
    "value": ("aggregateMarketValue",), "sale_date": ("approxSaleDate", "saleDate"), "broker": ("brokerName", "name"),
}


def proposed_sales(documents: DataFrame, xml: str = "xml", key: str = "url") -> DataFrame:
    """Facts of notices of proposed sales. A document is parsed once for all of them, one that doesn't parse has none."""
    names = tuple(n for of in NOTICE.values() for n in of)
    read = F.udf(lambda x: _first_texts(x, names), "array<string>", useArrow=True)
    said = documents.select(F.col(key).alias("url"), read(_safe(F.col(xml))).alias("said"))
    facts = said.select("url", *(first_filled(*(F.trim(F.get("said", F.lit(names.index(n)))) for n in of)).alias(fact) for fact, of in NOTICE.items()))
    return facts.withColumns({"units": finite(F.col("units")), "value": finite(F.col("value")), "sale_date": instant(F.col("sale_date"))})


def fund_reports(documents: DataFrame, expected: DataFrame, xml: str = "xml", key: str = "url") -> tuple[DataFrame, DataFrame]:
    """Fund documents that are what they should be, and those that aren't, with a reason.

    expected: url, form, cik, series, class. The form, the company and, for portfolio reports, series and class must hold.
    """
    x = _safe(F.col(xml))
    ids = lambda n: F.xpath(x, F.lit(f"//*[local-name()='{n}']/text()"))
    facts = documents.select(
        F.col(key).alias("url"), _any(x, "submissionType").alias("got_form"), F.lpad(_any(x, "cik", "registrantCik"), 10, "0").alias("got_cik"), ids("seriesId").alias("all_series"), ids("classId").alias("all_classes"),
        instant(_any(x, "repPdDate", "reportEndingPeriod")).alias("period"), F.xpath_int(x, F.lit("count(//*[local-name()='invstOrSec'])")).alias("holdings"),
    )
    both = facts.join(expected, "url")
    member = F.array_contains("all_series", F.col("series")) & F.array_contains("all_classes", F.col("class"))
    reason = F.when(~F.col("got_form").eqNullSafe(F.col("form")), "form").when(~F.col("got_cik").eqNullSafe(F.col("cik")), "company").when(F.col("form").startswith("NPORT") & ~F.coalesce(member, F.lit(False)), "series")
    judged = both.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").select("url", "reason")
