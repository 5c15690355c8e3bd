"""Raw signals without what looks secret, and bounded."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Parts of names whose values are dropped, and bounds.
SENSITIVE = ("secret", "token", "api_key", "apikey", "authorization", "cookie", "password", "email", "user_id", "userid", "account_id", "accountid")
MAX_DEPTH, MAX_ITEMS, MAX_TEXT, MAX_BYTES, PREVIEW_BYTES = 5, 50, 1000, 8192, 7500


def is_sensitive(name: Column) -> Column:
    plain = F.regexp_replace(F.replace(F.lower(name), F.lit("-"), F.lit("_")), "[^a-z0-9_]", "")
    return plain.rlike("|".join(SENSITIVE))


def redact_flat(raw: Column) -> Column:
    """A flat JSON object, as a map of strings, without sensitive names, at most MAX_ITEMS others, values cut to MAX_TEXT."""
    pairs = F.slice(F.map_entries(F.from_json(raw, "map<string,string>")), 1, MAX_ITEMS)
    kept = F.filter(pairs, lambda p: ~is_sensitive(p["key"]))
    return F.map_from_entries(F.transform(kept, lambda p: F.struct(F.left(p["key"], F.lit(MAX_TEXT)).alias("key"), F.left(p["value"], F.lit(MAX_TEXT)).alias("value"))))


#: Strings, punctuation, and numbers and names of a JSON text.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+')
CLOSES, TOO_DEEP = {"{": "}", "[": "]"}, '"[maximum depth reached]"'
HIDDEN_NAME = re.compile("|".join(SENSITIVE))


def rewritten(text: str) -> str:
    """JSON text in one pass over its tokens, written again without what is hidden: values of sensitive names, entries of an object or a list
    after the first MAX_ITEMS, characters of a string or a name after MAX_TEXT; what stands in MAX_DEPTH containers is named as too deep."""
    out: list[str] = []
    around: list[dict] = []  # the containers that are open
    passing = 0  # containers open within a value that isn't written
    for token in TOKEN.findall(text):
        if passing:
            passing += (token in CLOSES) - (token in "}]")
            continue
        if token in ":,":
            continue
        if token in "}]":
            around.pop()
            out.append(token)
            continue
        inside = around[-1] if around else {"close": "", "name": "", "seen": 0, "first": True}
        if inside["close"] == "}" and inside["name"] is None:
            inside["name"] = json.loads(token)
            continue
        name, inside["seen"] = inside["name"], inside["seen"] + 1
        inside["name"] = None
        plain = re.sub("[^a-z0-9_]", "", (name or "").lower().replace("-", "_"))
        if inside["seen"] > MAX_ITEMS or HIDDEN_NAME.search(plain):
            passing = int(token in CLOSES)
            continue
        out.append("" if inside["first"] else ",")
        inside["first"] = False
        if inside["close"] == "}":
            out.append(json.dumps(name[:MAX_TEXT], ensure_ascii=False) + ":")
        if len(around) >= MAX_DEPTH:
            out.append(TOO_DEEP)
            passing = int(token in CLOSES)
        elif token in CLOSES:
            out.append(token)
            around.append({"close": CLOSES[token], "name": None, "seen": 0, "first": True})
        else:
            out.append(json.dumps(json.loads(token)[:MAX_TEXT], ensure_ascii=False) if token[0] == '"' else token)
    return "".join(out)


@F.pandas_udf(StringType())
def _rewritten(raw):
    def one(text):
        try:
            json.loads(text)
        except (TypeError, ValueError):
            return None
        return rewritten(text)

    return raw.map(one)


def redact_nested(raw: Column | str) -> Column:
    """JSON text of any depth, redacted; longer than MAX_BYTES, an object with the first PREVIEW_BYTES of it, less a character that is cut. Null where it isn't JSON."""
    whole = _rewritten(F.col(raw) if isinstance(raw, str) else raw)
    head = F.make_valid_utf8(F.substring(F.encode(whole, "UTF-8"), 1, PREVIEW_BYTES).cast("string"))
    preview = F.when(head.endswith("\ufffd") & ~whole.contains("\ufffd"), F.regexp_replace(head, "\ufffd+$", "")).otherwise(head)
    short = F.to_json(F.struct(F.lit(True).alias("truncated"), preview.alias("preview")))
    return F.when(F.octet_length(whole) > MAX_BYTES, short).otherwise(whole)
