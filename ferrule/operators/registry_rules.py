"""Reviewed registries as nested documents: strict keys, kinds, bounds and uniqueness, with every failure of a document at once."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.text import fold
from ferrule.operators.assembly import ticker as canonical

#: Bytes of a registry, entries of its lists, and the forms of identifiers.
MOST_BYTES, MOST_ISSUERS, MOST_FUNDS, MOST_DOMAINS, MOST_TICKERS, MOST_ALIASES, MOST_RULES, MOST_TERMS, MOST_VERSIONS = 256_000, 200, 100, 200, 10, 20, 40, 20, 20
CIK, RULE_ID, RULE_VERSION, SERIES, CLASS = "^CIK[0-9]{10}$", "^[a-z][a-z0-9_]{0,63}$", "^[A-Za-z0-9][A-Za-z0-9._-]{0,31}$", "^S[0-9]{9}$", "^C[0-9]{9}$"
HOST = "^[a-z0-9](?:[a-z0-9.-]{0,251}[a-z0-9])?$"
#: What enumerated fields may say.
KINDS, MODES, TIERS = ("legal_name", "former_name", "brand", "subsidiary", "product", "ticker"), ("phrase", "ticker_token"), ("wire_service", "financial_press", "release_distribution")
IDENTITIES, STATES = ("official_series_class", "unsupported_no_series_class", "unsupported_non_investment_company"), ("active", "inactive")
#: Keys of the objects.
ISSUER_KEYS = ("issuer_key", "issuer_name", "tickers", "reviewed_on", "social_aliases", "issuer_feed")
RULE_KEYS = ("rule_id", "version", "alias", "alias_kind", "match_mode", "required_context", "negative_context", "valid_from", "valid_to", "canonical_cik", "reviewed_on", "review_note")
FEED_KEYS = ("feed_url", "official_hosts", "refresh_seconds", "review_note")
DOMAIN_KEYS = ("domain", "tier", "quality", "reviewed_on", "review_note")
FUND_KEYS = ("fund_name", "registrant_cik", "series_id", "class_id", "identity_status", "ticker_versions", "sponsor_source", "reviewed_on", "review_note")
VERSION_KEYS, SPONSOR_KEYS = ("ticker", "valid_from", "valid_to", "status"), ("sponsor_name", "notice_url", "official_hosts", "reviewed_on", "review_note")

ERROR = "struct<path:string,rule:string>"


@dataclass(frozen=True)
class Registry:
    """errors: registry_id, path, rule, none for a registry that holds. issuers: registry_id, issuer, issuer_key, issuer_name, reviewed_on. tickers: registry_id, issuer_key, ticker. aliases: registry_id,
    kind, issuer_key, alias. rules: registry_id, issuer_key, rule_id, alias, required, negative, valid_from, valid_to, as match_rules takes them. funds: registry_id,
    fund_name, registrant_cik, series_id, class_id, identity_status. All but errors are of registries without errors."""

    errors: DataFrame
    issuers: DataFrame
    tickers: DataFrame
    aliases: DataFrame
    rules: DataFrame
    funds: DataFrame


def at(value: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def kind_of(value: Column, name: str) -> Column:
    """STRING, BIGINT, ARRAY<...>, OBJECT<...>, VOID for a null, and so on; null where the name is missing."""
    return F.schema_of_variant(at(value, name, "variant"))


def _error(path: Column, rule: str | Column) -> Column:
    return F.struct(path.alias("path"), (rule if isinstance(rule, Column) else F.lit(rule)).alias("rule"))


def _all(*errors: Column) -> Column:
    return F.array_compact(F.array(*errors)).cast(f"array<{ERROR}>")


def keys(value: Column, path: Column, required: Iterable[str], optional: Iterable[str] = ()) -> Column:
    """Missing and unknown keys of an object; a value that is none is not_object."""
    have = F.json_object_keys(F.to_json(value))
    need, may = F.array(*map(F.lit, required)), F.array(*map(F.lit, (*required, *optional)))
    missing = F.transform(F.array_sort(F.array_except(need, have)), lambda k: _error(F.concat(path, F.lit("."), k), "missing"))
    unknown = F.transform(F.array_sort(F.array_except(have, may)), lambda k: _error(F.concat(path, F.lit("."), k), "unknown"))
    return F.when(have.isNull(), _all(_error(path, "not_object"))).otherwise(F.concat(missing, unknown).cast(f"array<{ERROR}>"))


def plain(text: Column) -> Column:
    """What a text says, with white space collapsed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def text_fault(text: Column, most: int) -> Column:
    """What is wrong with a text, or null: control characters, quotes or backslashes, nothing but white space, too long."""
    size = F.length(plain(text))
    return F.when(text.rlike(r"[\x00-\x1f\x7f]"), "control_characters").when(text.rlike(r'["\\]'), "quotes").when((size == 0) | (size > most), "length")


def text(value: Column, path: Column, name: str, most: int, form: str | None = None, one_of: tuple[str, ...] = (), nullable: bool = False) -> Column:
    """The fault of a text field, which a missing key has already told of: not_text, those of text_fault(), or form."""
    kind, said = kind_of(value, name), at(value, name)
    right = plain(said).rlike(form) if form else plain(said).isin(*one_of) if one_of else F.lit(True)
    free = kind.isNull() | (kind == "VOID") if nullable else kind.isNull()
    fault = F.when(kind != "STRING", "not_text").otherwise(F.coalesce(text_fault(said, most), F.when(~right, "form")))
    return F.when(~free & fault.isNotNull(), _error(F.concat(path, F.lit(f".{name}")), fault))


def day(value: Column, path: Column, name: str, nullable: bool = False) -> Column:
    wrong = text(value, path, name, 10, nullable=nullable)
    said = at(value, name)
    lost = (kind_of(value, name) == "STRING") & (~said.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") | F.try_to_date(said, "yyyy-MM-dd").isNull())
    return F.coalesce(wrong, F.when(lost, _error(F.concat(path, F.lit(f".{name}")), "form")))


def url_fault(url: Column, hosts: Column, bare: bool) -> Column:
    """Whether a URL isn't absolute HTTPS without user, odd port and, if bare, query and fragment, on one of the hosts."""
    authority = F.regexp_extract(url, r"^https://([^/?#]*)", 1)
    name = F.lower(F.regexp_replace(F.regexp_replace(authority, ":443$", ""), r"\.$", ""))
    odd = authority.contains("@") | name.contains(":") | (name == "") | (url.rlike("[?#]") if bare else F.lit(False))
    return F.when(odd, "url").when(~F.coalesce(F.array_contains(F.transform(hosts, F.lower), name), F.lit(False)), "host")


def _entries(rows: DataFrame, value: str, name: str, label: str, most: int, least: int = 0) -> tuple[DataFrame, Column]:
    """Rows of a list's entries as variants, with their path; and the error of the list's size or kind."""
    kind, items = kind_of(F.col(value), name), F.try_variant_get(value, f"$.{name}", "array<variant>")
    wrong = F.when(kind.isNotNull() & ~kind.startswith("ARRAY"), "not_list").when(~F.size(items).between(least, most), "entries")
    error = F.when(wrong.isNotNull(), _error(F.concat(F.col("path"), F.lit(f".{name}")), wrong))
    each = rows.select(*(c for c in rows.columns if c not in ("path", value)), F.col("path").alias("_path"), F.posexplode(F.slice(items, 1, most)).alias("_at", label))
    return each.select(*(c for c in each.columns if c not in ("_path", "_at")), F.concat("_path", F.lit(f".{name}["), F.col("_at").cast("string"), F.lit("]")).alias("path"), F.col("_at").alias(f"{label}_at")), error


def _faults(rows: DataFrame, *errors: Column, arrays: tuple[Column, ...] = ()) -> DataFrame:
    return rows.select("registry_id", F.explode(F.concat(_all(*errors), *arrays)).alias("e")).select("registry_id", "e.*")


def _repeated(rows: DataFrame, by: list[str], rule: str, owner: str | None = None) -> DataFrame:
    """An error for each value of by that comes more than once, or with owner, that several owners have, at its first later path."""
    order = Window.partitionBy("registry_id", *by).orderBy("place")
    later = rows.withColumn("_n", F.row_number().over(order))
    if owner:
        later = rows.withColumn("_first", F.first(owner).over(order)).where(F.col("_first") != F.col(owner))
        later = later.withColumn("_n", F.row_number().over(order))
        return later.where("_n = 1").select("registry_id", "path", F.lit(rule).alias("rule"))
    return later.where("_n = 2").select("registry_id", "path", F.lit(rule).alias("rule"))


def load_registry(payloads: DataFrame, most_bytes: int = MOST_BYTES, most_issuers: int = MOST_ISSUERS) -> Registry:
    """payloads: registry_id, payload, the JSON text of a registry of version 1 or 2, of most_bytes and most_issuers at most.

    errors has every failure: of the document (too_large, invalid_json, not_object), of keys (missing, unknown), of values (not_text, not_list, entries, control_characters, quotes, length, form, value, url, host,
    reversed, overlap, canonical, owner), and of uniqueness (duplicate, shared). Paths are like $.issuers[0].tickers. A null payload is invalid_json. Bounds
    keep every document small, so its lists are exploded whole; uniqueness is by document.
    """
    whole = payloads.select("registry_id", F.when(F.octet_length("payload") <= most_bytes, F.try_parse_json("payload")).alias("root"), (F.octet_length("payload") > most_bytes).alias("_large"), F.lit("$").alias("path"))
    root, path = F.col("root"), F.col("path")
    broken = whole.select("registry_id", "path", F.when(F.col("_large"), "too_large").when(root.isNull(), "invalid_json").alias("rule")).where("rule is not null")
    documents = whole.where("root is not null").drop("_large")
    version = F.when(kind_of(root, "version") == "BIGINT", at(root, "version", "bigint"))
    documents = documents.withColumn("version", version)
    issuers, issuer_list = _entries(documents, "root", "issuers", "issuer", most_issuers, 1)
    funds, fund_list = _entries(documents, "root", "funds", "fund", MOST_FUNDS)
    domains, domain_list = _entries(documents, "root", "publisher_domains", "domain", MOST_DOMAINS)
    wrong_version = F.when(kind_of(root, "version").isNotNull() & ~F.coalesce(version.isin(1, 2), F.lit(False)), _error(F.lit("$.version"), "value"))
    found = [broken, _faults(documents, wrong_version, issuer_list, fund_list, domain_list, arrays=(keys(root, path, ("version", "issuers"), ("publisher_domains", "funds")),))]

    v = F.col("issuer")
    own = F.when(F.col("version") == 1, keys(v, path, (*ISSUER_KEYS, "discovery_aliases"))).otherwise(keys(v, path, (*ISSUER_KEYS, "discovery_rules")))
    tickers, _ = _entries(issuers.withColumn("issuer_key", plain(at(v, "issuer_key"))).withColumn("_v", v), "_v", "tickers", "ticker", MOST_TICKERS, 1)
    lists = {}
    for kind, name, most in (("discovery", "discovery_aliases", MOST_ALIASES), ("social", "social_aliases", MOST_ALIASES), ("rule", "discovery_rules", MOST_RULES)):
        lists[kind] = _entries(issuers.withColumn("issuer_key", plain(at(v, "issuer_key"))).withColumn("_v", v), "_v", name, kind, most)
    feed, fpath = F.try_variant_get("issuer", "$.issuer_feed", "variant"), F.concat(path, F.lit(".issuer_feed"))
    has_feed = kind_of(v, "issuer_feed").isNotNull() & (kind_of(v, "issuer_feed") != "VOID")
    hosts = F.try_variant_get(feed, "$.official_hosts", "array<string>")
    seconds = F.when(kind_of(feed, "refresh_seconds") == "BIGINT", at(feed, "refresh_seconds", "bigint"))
    idle = ~has_feed & (F.coalesce(F.size(at(v, "social_aliases", "array<variant>")), F.lit(0)) <= 0) & (F.coalesce(F.size(F.coalesce(at(v, "discovery_rules", "array<variant>"), at(v, "discovery_aliases", "array<variant>"))), F.lit(0)) <= 0)
    feed_errors = (
        text(feed, fpath, "feed_url", 500), text(feed, fpath, "review_note", 240),
        F.when(kind_of(feed, "feed_url") == "STRING", F.when(url_fault(at(feed, "feed_url"), hosts, True).isNotNull(), _error(F.concat(fpath, F.lit(".feed_url")), url_fault(at(feed, "feed_url"), hosts, True)))),
        F.when(kind_of(feed, "refresh_seconds").isNotNull() & ~F.coalesce(seconds.between(60, 86400), F.lit(False)), _error(F.concat(fpath, F.lit(".refresh_seconds")), "value")),
    )
    found.append(_faults(
        issuers, text(v, path, "issuer_key", 13, CIK), text(v, path, "issuer_name", 120), day(v, path, "reviewed_on"), F.when(idle, _error(path, "no_collector")), *(F.when(has_feed, e) for e in feed_errors),
        arrays=(own, F.when(has_feed, keys(feed, fpath, FEED_KEYS)).otherwise(_all())),
    ))
    listed = issuers.withColumn("issuer_key", F.lit("")).withColumn("_v", v)
    for name, most, least in (("tickers", MOST_TICKERS, 1), ("discovery_aliases", MOST_ALIASES, 0), ("social_aliases", MOST_ALIASES, 0), ("discovery_rules", MOST_RULES, 0)):
        found.append(_faults(listed, _entries(listed, "_v", name, "x", most, least)[1]))
    placed = issuers.select("registry_id", plain(at(v, "issuer_key")).alias("issuer_key"), F.concat(path, F.lit(".issuer_key")).alias("path"), F.col("issuer_at").alias("place"))
    found.append(_repeated(placed.where("issuer_key is not null"), ["issuer_key"], "duplicate"))

    said = F.col("ticker").try_cast("string")
    is_text = F.schema_of_variant("ticker") == "STRING"
    bad = ~F.coalesce(canonical(said).eqNullSafe(said) & ~said.contains("."), F.lit(False))
    found.append(_faults(tickers, F.when(~is_text, _error(path, "not_text")).when(bad, _error(path, "form"))))
    place = F.col("issuer_at") * 1000 + F.col("ticker_at")
    named = tickers.where(is_text).select("registry_id", "issuer_key", said.alias("ticker"), "path", place.alias("place"), F.col("issuer_at").cast("string").alias("of"))
    found += [_repeated(named, ["of", "ticker"], "duplicate"), _repeated(named, ["ticker"], "shared", "issuer_key")]

    aliases = []
    for kind in ("discovery", "social"):
        rows = lists[kind][0]
        said_alias = F.col(kind).cast("string")
        is_alias = F.schema_of_variant(kind) == "STRING"
        short = (F.length(plain(said_alias)) < 3) | ~said_alias.rlike(r"\p{L}")
        fault = F.when(~is_alias, "not_text").otherwise(F.coalesce(text_fault(said_alias, 80), F.when(short, "form")))
        found.append(_faults(rows, F.when(fault.isNotNull(), _error(path, fault))))
        kept = rows.where(is_alias).select("registry_id", F.lit(kind).alias("kind"), "issuer_key", plain(said_alias).alias("alias"), "path", (F.col("issuer_at") * 1000 + F.col(f"{kind}_at")).alias("place"), F.col("issuer_at").cast("string").alias("of"))
        found.append(_repeated(kept.withColumn("alias", fold(F.col("alias"))), ["of", "alias"], "duplicate"))
        aliases.append(kept)

    r, rows = F.col("rule"), lists["rule"][0]
    terms = lambda n: F.coalesce(at(r, n, "array<string>"), F.array().cast("array<string>"))
    folded = lambda n: F.transform(terms(n), lambda t: fold(plain(t)))

    def context(name: str) -> Column:
        where = F.concat(path, F.lit(f".{name}"))
        kind = kind_of(r, name)
        poor = F.exists(terms(name), lambda t: t.isNull() | text_fault(t, 80).isNotNull() | (F.length(plain(t)) < 2) | ~t.rlike(r"[\p{L}\p{N}]"))
        twice = F.size(F.array_distinct(folded(name))) < F.size(terms(name))
        fault = F.when(~kind.startswith("ARRAY"), "not_list").when(F.size(terms(name)) > MOST_TERMS, "entries").when(poor, "form").when(twice, "duplicate")
        return F.when(kind.isNotNull() & fault.isNotNull(), _error(where, fault))

    begin, end, alias = at(r, "valid_from"), at(r, "valid_to"), plain(at(r, "alias"))
    held = at(F.col("issuer"), "tickers", "array<string>")
    found.append(_faults(
        rows, text(r, path, "rule_id", 64, RULE_ID), text(r, path, "version", 32, RULE_VERSION), text(r, path, "alias", 80), text(r, path, "alias_kind", 20, one_of=KINDS), text(r, path, "match_mode", 20, one_of=MODES),
        text(r, path, "canonical_cik", 13), text(r, path, "review_note", 240), day(r, path, "reviewed_on"), day(r, path, "valid_from", True), day(r, path, "valid_to", True), context("required_context"), context("negative_context"),
        F.when((F.length(alias) < 2) | ~alias.rlike(r"[\p{L}\p{N}]"), _error(F.concat(path, F.lit(".alias")), "form")),
        F.when((at(r, "match_mode") == "ticker_token") & ~F.coalesce(F.array_contains(held, alias), F.lit(False)), _error(F.concat(path, F.lit(".alias")), "canonical")),
        F.when(F.arrays_overlap(folded("required_context"), folded("negative_context")), _error(path, "overlap")), F.when(begin > end, _error(path, "reversed")),
        F.when(plain(at(r, "canonical_cik")) != F.col("issuer_key"), _error(F.concat(path, F.lit(".canonical_cik")), "owner")), arrays=(keys(r, path, RULE_KEYS),),
    ))
    place = F.col("issuer_at") * 1000 + F.col("rule_at")
    ruled = rows.select("registry_id", "issuer_key", plain(at(r, "rule_id")).alias("rule_id"), alias.alias("alias"), terms("required_context").alias("required"), terms("negative_context").alias("negative"), begin.alias("valid_from"), end.alias("valid_to"), "path", place.alias("place"), F.col("issuer_at").cast("string").alias("of"))
    found.append(_repeated(ruled.where("rule_id is not null"), ["of", "rule_id"], "duplicate"))
    by_rule = ruled.where("alias is not null").select("registry_id", F.lit("discovery").alias("kind"), "issuer_key", "alias", "path", "place", "of")
    every = aliases[0].unionByName(by_rule).unionByName(aliases[1])
    found.append(_repeated(every.withColumn("alias", fold(F.col("alias"))), ["kind", "alias"], "shared", "issuer_key"))

    d = F.col("domain")
    name, quality = F.lower(F.regexp_replace(plain(at(d, "domain")), r"\.$", "")), at(d, "quality", "double")
    number = kind_of(d, "quality").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    found.append(_faults(
        domains, text(d, path, "domain", 253), text(d, path, "tier", 40, one_of=TIERS), day(d, path, "reviewed_on"), text(d, path, "review_note", 240),
        F.when(~name.rlike(HOST) | name.contains(".."), _error(F.concat(path, F.lit(".domain")), "host")),
        F.when(kind_of(d, "quality").isNotNull() & ~F.coalesce(number & quality.between(0.60, 0.70), F.lit(False)), _error(F.concat(path, F.lit(".quality")), "value")), arrays=(keys(d, path, DOMAIN_KEYS),),
    ))
    found.append(_repeated(domains.select("registry_id", name.alias("name"), F.concat(path, F.lit(".domain")).alias("path"), F.col("domain_at").alias("place")).where("name is not null"), ["name"], "duplicate"))

    f = F.col("fund")
    official = at(f, "identity_status") == "official_series_class"
    ids = F.array_compact(F.array(at(f, "series_id"), at(f, "class_id")))
    found.append(_faults(
        funds, text(f, path, "fund_name", 160), text(f, path, "registrant_cik", 13, CIK), text(f, path, "series_id", 10, SERIES, nullable=True), text(f, path, "class_id", 10, CLASS, nullable=True), text(f, path, "identity_status", 48, one_of=IDENTITIES),
        day(f, path, "reviewed_on"), text(f, path, "review_note", 240), F.when(official & (F.size(ids) < 2), _error(path, "identity_missing")), F.when(~official & (F.size(ids) > 0), _error(path, "identity_invented")), arrays=(keys(f, path, FUND_KEYS),),
    ))
    known = funds.select("registry_id", plain(at(f, "fund_name")).alias("fund_name"), plain(at(f, "registrant_cik")).alias("registrant_cik"), at(f, "series_id").alias("series_id"), at(f, "class_id").alias("class_id"), at(f, "identity_status").alias("identity_status"), "path", F.col("fund_at").alias("place"))
    found.append(_repeated(known.where("registrant_cik is not null"), ["registrant_cik", "series_id", "class_id"], "duplicate"))
    versions, _ = _entries(funds.withColumn("fund_name", plain(at(f, "fund_name"))).withColumn("_f", f), "_f", "ticker_versions", "held", MOST_VERSIONS, 1)
    found.append(_faults(funds.withColumn("_f", f), _entries(funds.withColumn("_f", f), "_f", "ticker_versions", "held", MOST_VERSIONS, 1)[1]))
    h = F.col("held")
    symbol, since, until = at(h, "ticker"), at(h, "valid_from"), at(h, "valid_to")
    odd = ~F.coalesce(canonical(symbol).eqNullSafe(symbol) & ~symbol.contains("."), F.lit(False))
    found.append(_faults(
        versions, F.when((kind_of(h, "ticker") == "STRING") & odd, _error(F.concat(path, F.lit(".ticker")), "form")), F.when(kind_of(h, "ticker") != "STRING", _error(F.concat(path, F.lit(".ticker")), "not_text")), text(h, path, "status", 16, one_of=STATES),
        day(h, path, "valid_from", True), day(h, path, "valid_to", True), F.when(since > until, _error(path, "reversed")), arrays=(keys(h, path, VERSION_KEYS),),
    ))
    traded = versions.select("registry_id", "fund_name", symbol.alias("ticker"), F.coalesce(since, F.lit("0000-01-01")).alias("begin"), F.coalesce(until, F.lit("9999-12-31")).alias("end"), "path", (F.col("fund_at") * 1000 + F.col("held_at")).alias("place"), F.col("fund_at").alias("of")).where("ticker is not null")
    found.append(_repeated(traded, ["ticker"], "shared", "fund_name"))
    taken = named.select("registry_id", "ticker").distinct()
    found.append(traded.join(taken, ["registry_id", "ticker"], "left_semi").select("registry_id", "path", F.lit("issuer_ticker").alias("rule")))
    order = Window.partitionBy("registry_id", "of", "ticker").orderBy("begin", "place")
    latest = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    found.append(traded.withColumn("_latest", latest).where("begin <= _latest").select("registry_id", "path", F.lit("overlap").alias("rule")))

    errors = found[0]
    for more in found[1:]:
        errors = errors.unionByName(more)
    errors = errors.distinct()
    failed = errors.select("registry_id").distinct()
    holds = lambda rows, *names: rows.join(failed, "registry_id", "left_anti").select("registry_id", *names)
    accepted = issuers.select("registry_id", F.col("issuer_at").alias("issuer"), plain(at(v, "issuer_key")).alias("issuer_key"), plain(at(v, "issuer_name")).alias("issuer_name"), at(v, "reviewed_on").alias("reviewed_on"))
    return Registry(
        errors, holds(accepted, "issuer", "issuer_key", "issuer_name", "reviewed_on"), holds(named, "issuer_key", "ticker"), holds(every, "kind", "issuer_key", "alias"),
        holds(ruled, "issuer_key", "rule_id", "alias", "required", "negative", "valid_from", "valid_to"), holds(known, "fund_name", "registrant_cik", "series_id", "class_id", "identity_status"),
    )
