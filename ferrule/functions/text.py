"""Text rules as column expressions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a dossier doesn't use, and names of values that a warning doesn't show.
RESTRICTED = r"(?i)\b(buy|sell|guaranteed|alpha|expected[ -]return|should purchase)\b"
SECRET_VALUE = r"(?i)\b(api[_-]?key|token|authorization|password|cookie)\s*[=:]\s*\S+"


@cache
def _folding() -> dict[str, str]:
    """What case folding makes of characters that lower case leaves alone, sharp s apart."""
    return {c: f for c in map(chr, range(0x80, 0x110000)) if c != "ß" and c == c.lower() and (f := c.casefold()) != c}


@cache
def _folded_apart() -> str:
    """A pattern of the characters of _folding(), as ranges, of which a character is tried against few."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, _folding())):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def fold(text: Column) -> Column:
    """Full case folding: lower case, sharp s as two letters, and where a text has one of the few other characters that fold to something else, each of these by itself."""
    lowered = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    table = _folding()
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    each = F.transform(F.split(lowered, ""), lambda c: F.coalesce(F.try_element_at(known, c), c))
    # nearly all texts are known by their first test not to have any
    return F.when(text.rlike(r"[\u00B5\u0130-\x{10FFFF}]") & lowered.rlike(_folded_apart()), F.array_join(each, "")).otherwise(lowered)


def normalize_title(text: Column) -> Column:
    """Folded words of letters, digits and percent signs, one space apart; & reads and."""
    return F.trim(F.regexp_replace(F.replace(fold(text), F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}%]+", " "))


def normalize_entity(text: Column) -> Column:
    """Folded words of letters, digits and underscores, one space apart."""
    return F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}_]+", " "))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether phrase stands in text as whole words; both are normalised. An empty phrase is nowhere."""
    return (phrase != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def safe_text(text: Column) -> Column:
    return F.left(F.regexp_replace(text, RESTRICTED, "restricted term"), F.lit(500))


def sanitize_warning(text: Column) -> Column:
    """Printable, without values of secrets, at most 240 characters."""
    printable = F.regexp_replace(text, r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]", "")
    return F.left(F.regexp_replace(printable, SECRET_VALUE, "$1=[redacted]"), F.lit(240))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def token_set_ratio(left: str, right: str, least: float = 0.0) -> float:
    """Similarity from 0 to 100 of two normalised titles as sets of words; one below least may come out lower.

    100 if one set holds the other and they meet. Else the best of three ratios: of the words in common with either side's
    common and other words, and of these two; a ratio is twice the longest common subsequence over both lengths. What two
    texts begin with alike is part of it, so only the other words are compared letter by letter, and no longer than least may still be reached.
    """
    a, b = set(left.split()), set(right.split())
    if not a or not b:
        return 0.0
    common = a & b
    if common and (common == a or common == b):
        return 100.0
    base, one, two = (" ".join(sorted(x)) for x in (common, a - common, b - common))
    shared = len(base) + 1 if base else 0
    first, second = shared + len(one), shared + len(two)
    best = max(200.0 * len(base) / (len(base) + n) for n in (first, second))
    needed = int(least * (first + second) / 200.0) - shared
    if min(len(one), len(two)) < needed:
        return best
    return max(best, 200.0 * (shared + _common_subsequence(one, two, needed)) / (first + second))


def _common_subsequence(x: str, y: str, needed: int = 0) -> int:
    """Length of the longest common subsequence, a bit for each character of x (Hyyrö, 2004); less once needed can't be reached."""
    places: dict[str, int] = {}
    for i, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << i
    rows, mask = (1 << len(x)) - 1, (1 << len(x)) - 1
    for i, c in enumerate(y):
        if i % 64 == 63 and len(x) - rows.bit_count() + len(y) - i < needed:
            break
        met = rows & places.get(c, 0)
        rows = (rows + met | rows - met) & mask
    return len(x) - rows.bit_count()
