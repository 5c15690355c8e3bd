"""What a dossier is put together from: checked tickers, admitted collector results, warnings, attributions and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.joins import sized, unused
from ferrule.functions.keys import iso_utc, prefixed
from ferrule.functions.text import sanitize_warning
from ferrule.operators.quality import mapped, warnings
from ferrule.operators.score import EXPECTED

#: The form of a ticker, fragments that it must not have, and characters that no input may have.
TICKER, FRAGMENTS, CONTROL = "^[A-Z][A-Z0-9.-]{0,11}$", "script|exec|union|select|drop|delete|insert|update", r"[\x00-\x1f\x7f]"
#: Reviewed decisions about sources, and the one source that has to be named.
DECISIONS = {
    "sec": "approved", "issuer_feed": "approved_per_registry", "gdelt": "approved_discovery", "bluesky": "approved_partial_attention", "mastodon": "approved_per_registry",
    "fmp": "permission_required", "finnhub": "permission_required", "occ": "permission_required", "opra_vendor": "licensed_feed_required", "flowalgo": "licensed_feed_required",
    "cheddarflow": "licensed_feed_required", "user_ohlc": "licensed_feed_required", "yfinance": "development_private_only",
}
ATTRIBUTIONS = {"gdelt": ("The GDELT Project", "https://www.gdeltproject.org/")}
#: Who is expected to fill a family, the caveats of every dossier, and signals that are material by themselves.
EXPECTED_PROVIDERS = {
    "filings_news": "SEC, reviewed issuer feeds, or discovery metadata", "insider_trading": "direct SEC ownership filings",
    "options_flow": "a licensed transaction-plus-quote provider", "technical": "a user-supplied/licensed OHLC provider", "social": "a reviewed partial-attention collector",
}
CAVEATS = ("Deterministic v1 scoring is not backtested.", "This dossier does not provide an investment recommendation.")
MATERIAL = (
    "bankruptcy", "delisting", "restatement", "material_agreement", "material_contract", "earnings_release", "guidance_change", "acquisition", "financing", "adverse_filing",
)
#: Confidence below which a warning says so.
LOW_CONFIDENCE = 0.50


def ticker(text: Column) -> Column:
    """The trimmed upper-case ticker, or null for what is none: empty or control characters, slashes, doubled dashes, fragments of statements."""
    found = F.upper(F.regexp_replace(text, r"^\s+|\s+$", ""))
    bad = text.rlike(CONTROL) | found.rlike(r"[/\\]|--") | F.lower(found).rlike(FRAGMENTS)
    return F.when(~bad & found.rlike(TICKER), found)


def by_ticker(rows: DataFrame, registry: DataFrame, name: str = "ticker") -> DataFrame:
    """rows with the registry's row of their ticker, else of the ticker with dashes for dots; rows without one have nulls.

    registry: one row per ticker. It is measured and broadcast if small, so that a ticker that most rows ask for stays where its rows are;
    a larger one is joined by a shuffle. Columns of rows keep their names and kinds.
    """
    fields = [c for c in registry.columns if c != name]
    known = sized(registry.select(name, F.struct(F.lit(True).alias("_met"), *fields).alias("_found")))
    first, second, one, two = (unused(rows, c) for c in ("_first", "_second", "_one", "_two"))
    tried = rows.withColumns({one: F.col(name), two: F.replace(name, F.lit("."), F.lit("-"))})
    for key, to in ((one, first), (two, second)):
        side = known.select(F.col(name).alias(f"{key}known"), F.col("_found").alias(to))
        tried = tried.join(side, F.col(key) == F.col(f"{key}known"), "left")
    found = lambda c: F.when(F.col(f"{first}._met"), F.col(f"{first}.{c}")).otherwise(F.col(f"{second}.{c}")).alias(c)
    return tried.select(*rows.columns, *map(found, fields))


#: Collectors that requests are dealt to at most.
MOST_COLLECTORS = 1000


def supported(requests: DataFrame, collectors: DataFrame, limited: DataFrame) -> DataFrame:
    """requests (request_id, ticker) with the collectors that serve them: collectors (provider, family, limited), where limited ones serve only
    the tickers of limited (provider, ticker). collectors is a configured list of MOST_COLLECTORS at most; a longer one is refused."""
    listed = collectors.select("provider", "family", "limited").limit(MOST_COLLECTORS + 1).collect()
    if len(listed) > MOST_COLLECTORS:
        raise ValueError(f"more than {MOST_COLLECTORS} collectors")
    kind = "array<struct<provider:string,family:string,limited:boolean>>"
    each = F.array(*(F.struct(F.lit(c.provider).alias("provider"), F.lit(c.family).alias("family"), F.lit(c.limited).alias("limited")) for c in listed)).cast(kind)
    both = requests.withColumn("_c", F.explode(each)).select(*requests.columns, "_c.*")
    served = limited.select("provider", "ticker").distinct()
    return both.where(~F.col("limited")).unionByName(both.where("limited").join(served, ["provider", "ticker"], "left_semi"))


def admitted(results: DataFrame) -> DataFrame:
    """results with status, admitted, reason, detail and warning by the policy of their source.

    results: request_id, ordinal, family, returned_family, provider, status, error, decision, items, degraded. An error or another family than the
    collector's is a failure. A source that needs permission or a licence, or is for development alone, gives no evidence, whatever it
    returned; the row's own decision goes before the reviewed one. Otherwise the status is the row's, or says whether there are items; without items a
    reason says why. warning is null where there is nothing to say.
    """
    decision = F.coalesce("decision", mapped(F.col("provider"), DECISIONS))
    mismatch = F.col("error").isNull() & (F.col("returned_family") != F.col("family"))
    failed = F.col("error").isNotNull() | mismatch
    private = decision == "development_private_only"
    refused = ~failed & F.coalesce(decision.isin("permission_required", "licensed_feed_required") | private, F.lit(False))
    inferred = F.coalesce("status", F.when(F.col("items") > 0, "fresh").otherwise("no_observations"))
    held = F.when(private, F.when(F.col("family") == "options_flow", "licensed_feed_required").otherwise("unavailable")).otherwise(decision)
    status = F.when(mismatch, "schema_error").when(failed, F.coalesce("status", F.lit("unavailable"))).when(refused, held).otherwise(inferred)
    empty = ~failed & ~refused & (F.col("items") == 0)
    reason = F.when(failed, "source_unavailable").when(refused, "source_unsupported").when(
        empty, F.when(inferred == "no_observations", "observed_none").when(inferred == "unsupported", "source_unsupported").otherwise("source_unavailable")
    )
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    family, provider = F.col("family"), F.col("provider")
    warning = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(mismatch, say(provider, " returned a mismatched family."))
        .when(refused & (decision == "permission_required"), say(family, " provider ", provider, " requires permission."))
        .when(refused & (decision == "licensed_feed_required"), say(family, " provider ", provider, " requires a licensed feed."))
        .when(refused, say(family, " provider ", provider, " is private diagnostic only; no production evidence or coverage credit was granted."))
        .when(F.col("degraded"), say(family, " used degraded provider ", provider, "."))
    )
    detail = F.when(refused, decision).when(reason.isNotNull(), status)
    return results.withColumns({"_status": status, "admitted": ~failed & ~refused, "reason": reason, "detail": detail, "warning": warning}).drop("status").withColumnRenamed("_status", "status")


def dossier_warnings(requests: DataFrame, judged: DataFrame, evidence: DataFrame, stale: DataFrame, confidence: DataFrame, expected: tuple[str, ...] = EXPECTED) -> DataFrame:
    """(request_id, warnings): what collectors said, by ordinal; families without fresh evidence; stale families; low confidence by family, then overall.

    judged: from admitted(). evidence: request_id, family, confidence, what is left of it. stale: request_id, family. confidence: request_id,
    confidence of the whole. Texts are sanitised, each once in this order, and the caveats close the list.
    """
    said = judged.where("warning is not null").select("request_id", F.lit(1).alias("step"), F.col("ordinal").cast("string").alias("at"), F.lpad(F.col("ordinal").cast("string"), 12, "0").alias("order"), sanitize_warning(F.col("warning")).alias("text"))
    of_family = judged.groupBy("request_id", "family").agg(F.array_join(F.array_sort(F.collect_set("provider")), ", ").alias("providers"), F.bool_or(F.col("reason").eqNullSafe("source_unavailable") & ~F.col("admitted")).alias("failed"))
    wanted = requests.select("request_id", F.explode(F.array(*map(F.lit, expected))).alias("family"))
    missing = wanted.join(evidence.select("request_id", "family").distinct(), ["request_id", "family"], "left_anti").join(of_family, ["request_id", "family"], "left")
    lacks = F.when(
        F.col("providers").isNull(), F.concat("family", F.lit(" is unconfigured; expected "), mapped(F.col("family"), EXPECTED_PROVIDERS, "a configured provider"), F.lit(" and has no fresh evidence."))
    ).when(~F.col("failed"), F.concat("family", F.lit(" has no fresh evidence from "), "providers", F.lit(".")))
    row = lambda df, step, text: df.select("request_id", F.lit(step).alias("step"), F.lit("").alias("at"), F.col("family").alias("order"), text.alias("text"))
    low = F.col("confidence") < LOW_CONFIDENCE
    parts = [
        said,
        row(missing, 2, lacks).where("text is not null"),
        row(stale.select("request_id", "family").distinct(), 3, F.concat("family", F.lit(" contained evidence older than the lookback window."))),
        row(evidence.where(low).select("request_id", "family").distinct(), 4, F.concat("family", F.lit(" contains evidence with confidence below 0.50."))),
        row(confidence.where(low).withColumn("family", F.lit("")), 5, F.lit("Overall confidence is below 0.50.")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    listed = rows.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "order", "text"))), lambda w: w["text"]).alias("texts"))
    none = F.array().cast("array<string>")
    return requests.select("request_id").join(listed, "request_id", "left").select("request_id", warnings(F.coalesce("texts", none), CAVEATS, 20).alias("warnings"))


def attributions(used: DataFrame) -> DataFrame:
    """(request_id, source_id, name, url) of the sources used by each request that have to be named, each once; used: request_id, source_id."""
    named = F.col("source_id").isin(*ATTRIBUTIONS)
    name, url = (mapped(F.col("source_id"), {k: v[i] for k, v in ATTRIBUTIONS.items()}) for i in (0, 1))
    return used.where(named).select("request_id", "source_id").distinct().select("request_id", "source_id", name.alias("name"), url.alias("url"))


def scope_id(claim_id: Column, family: Column, signal: Column, ts: Column, record: Column) -> Column:
    """What a reason about an item points at: its claim, or a hash of the item where it has none."""
    return F.coalesce(claim_id, prefixed("candidate_", family, signal, iso_utc(ts), record))


def provider_of(source_id: Column, name: Column) -> Column:
    """The stable label of a source: its id, else by its public name."""
    plain = F.lower(name)
    by_name = (
        F.when(plain == "sec edgar", "sec").when(plain.startswith("fmp "), "fmp").when(plain.startswith("finnhub "), "finnhub")
        .when(plain.isin("flowalgo", "cheddarflow"), plain).when(plain == "yfinance chain snapshot", "yfinance")
    )
    return F.when(F.coalesce(source_id, F.lit("")) != "", source_id).otherwise(by_name)


def readiness(sources: DataFrame) -> DataFrame:
    """(request_id, sec_provenance, fresh_directional, directional_providers, ready) of requests with evidence.

    sources: a row for each source of each item: request_id, item, family, signal, direction, source_id, source_name, decision. An item counts as directional if
    it isn't neutral and is insider trading by the regulator, a material signal of the regulator or the issuer, or has an approved source other than
    discovery and attention. Ready: the regulator is among the sources, and some item is directional.
    """
    regulator = (F.col("source_id").eqNullSafe("sec")) | (F.lower(F.coalesce("source_name", F.lit(""))) == "sec edgar")
    primary = F.col("source_id").isin("sec", "issuer_feed") & (F.col("family") == "filings_news") & F.col("signal").isin(*MATERIAL)
    approved = (F.col("decision") == "approved") & ~F.col("source_id").isin("sec", "gdelt", "bluesky", "mastodon")
    qualifies = (F.col("direction") != "neutral") & (((F.col("family") == "insider_trading") & regulator) | F.coalesce(primary, F.lit(False)) | F.coalesce(approved, F.lit(False)))
    items = sources.groupBy("request_id", "item").agg(F.bool_or(regulator).alias("sec"), F.bool_or(qualifies).alias("directional"), F.collect_set(provider_of(F.col("source_id"), F.col("source_name"))).alias("providers"))
    found = items.groupBy("request_id").agg(
        F.bool_or("sec").alias("sec_provenance"), F.bool_or("directional").alias("fresh_directional"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("directional"), F.col("providers")))))).alias("directional_providers"),
    )
    return found.withColumn("ready", F.col("sec_provenance") & F.col("fresh_directional"))


def provider_status(configured: DataFrame, sources: DataFrame) -> DataFrame:
    """(request_id, provider, families, status, evidence_count) of each configured provider: configured (request_id, provider, family); an item counts once for a provider."""
    items = sources.select("request_id", "item", provider_of(F.col("source_id"), F.col("source_name")).alias("provider")).distinct().groupBy("request_id", "provider").agg(F.count("*").alias("n"))
    each = configured.groupBy("request_id", "provider").agg(F.array_sort(F.collect_set("family")).alias("families")).join(items, ["request_id", "provider"], "left")
    count = F.coalesce("n", F.lit(0))
    return each.select("request_id", "provider", "families", F.when(count > 0, "fresh_evidence").otherwise("no_fresh_evidence").alias("status"), count.alias("evidence_count"))


def amount(x: Column) -> Column:
    """Whole units with commas, halves to even."""
    return F.regexp_replace(F.format_number(x, 0), "^-0$", "-0")


def signed(x: Column, places: int = 3) -> Column:
    """With its sign and so many places, no commas."""
    return F.concat(F.when(x < 0, "-").otherwise("+"), F.replace(F.format_number(F.abs(x), places), F.lit(","), F.lit("")))
