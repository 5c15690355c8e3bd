"""Canonical source URLs and hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track.
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source")


def host(url: Column) -> Column:
    """The lower-case host without user, port and final dot; empty where there is none."""
    authority = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", "")), r"\.+$", "")


def canonical_url(url: Column) -> Column:
    """The https URL without fragment, tracking keys, doubled and final slashes, its query sorted; null for other URLs."""
    text = F.trim(url)
    port = F.regexp_extract(text, r"^[^:]*://[^/?#]*?:([0-9]+)(?:[/?#]|$)", 1)
    path = F.regexp_replace(F.regexp_extract(text, r"^[^:]*://[^/?#]*([^?#]*)", 1), "/{2,}", "/")
    path = F.when(path == "", "/").when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    pairs = F.filter(F.split(F.regexp_extract(text, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
    name = lambda p: F.lower(F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1))))
    kept = F.filter(pairs, lambda p: ~name(p).startswith("utm_") & ~name(p).isin(*TRACKING_KEYS))
    again = lambda p: F.url_encode(F.coalesce(F.try_url_decode(p), p))
    split = F.array_sort(F.transform(kept, lambda p: F.struct(again(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), again(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"))))
    query = F.array_join(F.transform(split, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    whole = F.concat(
        F.lit("https://"), host(text), F.when((port == "") | (port == "443"), "").otherwise(F.concat(F.lit(":"), port)), path,
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )
    return F.when(text.rlike("^(?i:https)://") & (host(text) != ""), whole)


def is_host_or_subdomain(name: Column, official: Column) -> Column:
    return (name == official) | name.endswith(F.concat(F.lit("."), official))


def host_suffixes(name: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
