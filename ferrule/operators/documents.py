"""Primary documents and item codes of filings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.arrays import bound
from ferrule.operators.collectors import ITEM_PRIORITY

#: Characters around a match in which an exclusion counts.
NEAR = 240

#: The version of the rules, the bytes of a document that is read, and what each rule says of its event.
RULESET_VERSION, RULE_VERSION, MOST_DOCUMENT_BYTES = "sec-primary-document-v1", "1", 2_000_000
RULE_CONTEXT = {
    "equity_distribution_agreement": ("Equity distribution agreement", "An at-the-market or similar equity distribution program can change share count, financing capacity, and potential dilution.", "material"),
    "share_repurchase_activity": ("Share repurchase activity", "Actual or newly disclosed repurchase activity changes outstanding capital and the issuer's use of cash.", "material"),
    "completed_debt_offering": ("Debt offering", "A completed debt offering changes liquidity, leverage, interest expense, and future repayment obligations.", "material"),
    "filed_prospectus_supplement": ("Securities offering update", "A prospectus supplement can establish or update the terms and capacity for a securities offering.", "material"),
}
#: Rule, priority, event type, whether it is generic, patterns, exclusions.
DOCUMENT_RULES = (
    ("equity_distribution_agreement", 20, "equity_distribution", False,
     (r"\b(?:entered into|executed|established|amended(?: and restated)?).{0,100}\bequity distribution agreement\b",),
     (r"\b(?:terminated|cancelled|canceled|did not enter into|has not entered into).{0,120}\bequity distribution agreement\b",)),
    ("share_repurchase_activity", 30, "share_repurchase", False,
     (r"\b(?:commenced|began|continued|completed)\w*.{0,80}\brepurchas\w*.{0,80}\bshares\b", r"\brepurchased\b.{0,80}\bshares\b"),
     (r"\b(?:did not|does not|has not|have not|had not|will not).{0,80}\brepurchas\w*\b",
      r"\b(?:may|might|could|plans? to|intends? to|authorized to).{0,80}\brepurchas\w*\b", r"\bno shares\b.{0,80}\brepurchas\w*\b")),
    ("completed_debt_offering", 10, "debt_offering", False,
     (r"\bcompleted\b.{0,100}\boffering\b.{0,220}\b(?:senior|subordinated|convertible|secured|unsecured)?\s*notes\b",
      r"\b(?:issued|sold)\b.{0,220}\b(?:senior|subordinated|convertible|secured|unsecured)?\s*notes\b"),
     (r"\b(?:did not|has not|have not|had not|will not).{0,80}\b(?:issue|issued|sell|sold|complete|completed)\b",
      r"\b(?:proposes?|expects?|intends?|plans?|may|might|could)\b.{0,100}\b(?:issue|sell|offer|complete)\b")),
    ("filed_prospectus_supplement", 100, "securities_offering", True,
     (r"\b(?:filed|is filing|has filed)\b.{0,100}\bprospectus supplement\b",),
     (r"\b(?:did not|has not|have not|had not|will not)\b.{0,80}\bfil(?:e|ed|ing)\b.{0,100}\bprospectus supplement\b", r"\bpreviously filed\b.{0,100}\bprospectus supplement\b")),
)
#: Adverse item codes.
ADVERSE_ITEMS = {"1.03": "bankruptcy", "3.01": "delisting", "4.02": "restatement"}


def html_text(html: Column) -> Column:
    """Visible text of simple HTML: without comments, scripts, styles and tags, one space between words."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"[ \t\n\r\f]+", " "))


def _holds(text: Column, patterns: tuple[str, ...], exclusions: tuple[str, ...]) -> Column:
    """Whether a pattern matches without an exclusion within NEAR characters of that match.

    The text is split at the matches, so a match's surroundings are the ends of what lies between. Each match and what lies before it has a character
    at least, so NEAR of them on either side hold all that is near, and time grows with the matches.
    """
    found = []
    for pattern in patterns:
        whole = f"(?i){pattern}"

        def clean(pieces: Column) -> Column:
            matches, gaps = pieces["matches"], pieces["gaps"]
            before = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.concat(F.right(g, F.lit(NEAR)), m))
            after = F.zip_with(F.slice(gaps, F.lit(2), F.size(matches)), matches, lambda g, m: F.concat(m, F.left(g, F.lit(NEAR))))

            def surrounded(sides: Column) -> Column:
                left = lambda i: F.concat(F.array_join(F.slice(sides["before"], F.greatest(i + 1 - NEAR, F.lit(1)), F.least(i, F.lit(NEAR))), ""), F.right(F.get(gaps, i), F.lit(NEAR)))
                right = lambda i: F.concat(F.left(F.get(gaps, i + 1), F.lit(NEAR)), F.array_join(F.slice(sides["after"], i + 2, F.lit(NEAR)), ""))
                near = lambda m, i: F.concat(F.right(left(i), F.lit(NEAR)), m, F.left(right(i), F.lit(NEAR)))
                free = lambda near: ~reduce(lambda x, y: x | y, (near.rlike(f"(?i){e}") for e in exclusions))
                return F.exists(F.transform(matches, near), free)

            return bound(F.struct(before.alias("before"), after.alias("after")), surrounded)

        met = bound(F.regexp_extract_all(text, F.lit(whole), F.lit(0)), lambda m: F.when(F.size(m) > 0, F.struct(m.alias("matches"), F.split(text, whole, -1).alias("gaps"))))
        found.append(bound(met, lambda p: F.coalesce(clean(p), F.lit(False))))
    return reduce(lambda a, b: a | b, found)


def classify(filings: DataFrame) -> DataFrame:
    """(filing_id, status, rule_id, event_type, candidates) of the text of each filing.

    No rule: no_match. More than one specific rule: ambiguous. Else the specific rule, or the generic one, matched.
    """
    text = F.coalesce("text", F.lit(""))
    hits = [F.when(_holds(text, patterns, exclusions), F.struct(F.lit(generic).alias("generic"), F.lit(priority).alias("priority"), F.lit(rule).alias("rule_id"), F.lit(kind).alias("event_type"))) for rule, priority, kind, generic, patterns, exclusions in DOCUMENT_RULES]
    found = filings.select("filing_id", F.array_compact(F.array(*hits)).alias("hits")).withColumn("specific", F.size(F.filter("hits", lambda h: ~h["generic"])))
    status = F.when(F.size("hits") == 0, "no_match").when(F.col("specific") > 1, "ambiguous").otherwise("matched")
    best = F.when(status == "matched", F.array_min("hits"))
    return found.select("filing_id", status.alias("status"), best["rule_id"].alias("rule_id"), best["event_type"].alias("event_type"), F.transform("hits", lambda h: h["rule_id"]).alias("candidates"))


PHRASES = (
    "The company entered into an equity distribution agreement.", "It did not enter into an equity distribution agreement.", "We repurchased 5 shares.",
    "We may repurchase; in March we repurchased 5 shares.", "It completed an offering of senior notes and repurchased 9 shares.", "It filed a prospectus supplement.", "Nothing happened.",
)


def sample_filings(docs: DataFrame) -> DataFrame:
    """Filings with a phrase of the rules after a document's whole text."""
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % len(PHRASES) + 1).cast("int"))
    return docs.select(F.col("doc_id").alias("filing_id"), F.concat_ws(" ", "text", phrase).alias("text"))


def main_item(items: Column) -> Column:
    """The item code with the highest priority of an array of codes."""
    return F.element_at(F.filter(F.array(*map(F.lit, ITEM_PRIORITY)), lambda c: F.array_contains(items, c)), 1)


def adverse_signal(form: Column, items: Column) -> Column:
    """What makes an 8-K adverse, by its smallest adverse item; 3.01 isn't one beside a completed merger with a change of control."""
    merged = F.array_contains(items, "2.01") & F.array_contains(items, "5.01")
    codes = F.filter(F.array(*map(F.lit, sorted(ADVERSE_ITEMS))), lambda c: F.array_contains(items, c) & ~((c == "3.01") & merged))
    names = F.create_map(*(F.lit(x) for pair in ADVERSE_ITEMS.items() for x in pair))
    return F.when(form.startswith("8-K") & (F.size(codes) > 0), names[F.get(codes, F.lit(0))])
