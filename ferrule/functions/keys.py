"""Keys made of hashes, and times as the hashes spell them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def hash_key(*parts: Column | str) -> Column:
    """SHA-256 of the parts, a separator between them; null parts count as empty."""
    columns = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws(SEPARATOR, *columns), 256)


def iso_utc(ts: Column) -> Column:
    """ISO 8601 with +00:00, and microseconds only where there are some."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(part == "000000", "").otherwise(F.concat(F.lit("."), part)), F.lit("+00:00"))


def prefixed(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(prefix), hash_key(*parts))
