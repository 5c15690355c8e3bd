"""Personal data: fixed formats, and further candidates chosen by boosted trees. All in DataFrame functions."""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import cut, unused
from ferrule.llm.spans import BLOCK, blocks, bound, clear_of, described, located

#: Fixed formats, in the order of their spans. Runs are possessive and begin at their first character
#: or where the last match ended, so that long runs without a match take linear time; matches are the same.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further candidates: written-out and dotless addresses, local numbers, identity numbers, accounts, IPv6.
PROPOSED = {
    "email_written": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(](?i:dot)[\])]\x20?[A-Za-z0-9-]++)++",
    "email_local": r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?![.@][A-Za-z0-9-])",
    "phone_local": r"(?<![0-9A-Za-z+.)-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z.-])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ipv6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
}
#: Figures that aren't personal, as background for training: plain numbers, then dates, times, amounts and ranges of years.
BACKGROUND = {
    "number": r"(?<![0-9+.,@-])[0-9]{2,12}(?![0-9@]|[.,-][0-9])",
    "figure": r"(?<![0-9.,:/+-])(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?|[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[12][0-9]{3}-[12][0-9]{3})(?![0-9.,:/-])",
}
#: Words before a value that speak of personal data.
CUES = r"(?i)(?:mail|e-mail|contact|call|phone|tel|mobile|fax|ssn|passport|card|iban|account|address|\bid|\bip)\W{0,4}$"
#: Characters before a candidate that are searched for cues.
CUE_WIDTH = 24

#: Features of a candidate: name and number of values. Their product bounds the table that is learned from.
FEATURES = (("digits", 8), ("separators", 4), ("left_kind", 4), ("right_kind", 4), ("cue", 2), ("width", 6), ("shape", 4), ("check", 3))
#: Trees, their shrinkage, smoothing of leaf values and of shares, and the least probability of a candidate that is taken.
ROUNDS, SHRINKAGE, SMOOTHING, LEAST_PROBABILITY = 24, 0.3, 4.0, 0.9


def _edge(text: Column, last: bool) -> Column:
    """0 nothing or white space, 1 other characters, 2 = : / or quotes, 3 letters or digits."""
    c = F.right(text, F.lit(1)) if last else F.left(text, F.lit(1))
    return F.when(c.rlike(r"^\s?$"), 0).when(c.rlike("[=:/\"']"), 2).when(c.rlike(r"[\p{L}\p{N}]"), 3).otherwise(1)


def _mod_97(value: Column) -> Column:
    """Whether an account number's check digits hold: its first four characters moved to its end, letters as 10 to 35, leave 1 modulo 97."""
    bare = F.upper(F.regexp_replace(value, r"\x20", ""))
    moved = F.concat(F.substring(bare, 5, 64), F.left(bare, F.lit(4)))
    digit = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: (acc * F.when(digit(c) > 9, 100).otherwise(10) + digit(c)) % 97
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c.rlike("[A-Z0-9]")), F.lit(0), step) == 1


def _features(m: Column, value: Column, check: Column) -> list[Column]:
    """Of the text around m and of value, which stands there or might. check: 0 nothing to check, 1 check digits fail, 2 they hold."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    separators = F.when(value.rlike(r"[\x20()-]"), F.when(value.rlike("[.]"), 3).otherwise(1)).when(value.rlike("[.]"), 2).otherwise(0)
    shape = F.when(value.contains("@"), 1).when(value.contains(":"), 2).when(value.rlike("[A-Za-z]"), 3).otherwise(0)
    found = (
        F.least(F.floor(digits / 2.5), F.lit(7)), separators, _edge(m["left"], True), _edge(m["right"], False),
        F.right(m["left"], F.lit(CUE_WIDTH)).rlike(CUES).cast("int"), F.least(F.floor(F.length(value) / 5), F.lit(5)), shape, check,
    )
    return [x.cast("int").alias(name) for (name, _), x in zip(FEATURES, found)]


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    doubled = lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), doubled)
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of a fixed format counts."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(digits.between(13, 19), _luhn(value)).otherwise(False)
    return digits.between(9, 15) if kind == "phone" else F.lit(True)


CANDIDATE = "struct<kind:string,start:bigint,end:bigint,holds:boolean,label:int," + ",".join(f"{n}:int" for n, _ in FEATURES) + ">"


def _candidates(kind: str, text: Column, pattern: str, cheap: Column) -> Column:
    """All matches of a generator as CANDIDATE. cheap is true wherever there is one.

    holds says whether a match of a fixed format counts; it is null for other generators. label is null for what may be
    chosen, and set for what is only learned from: background figures, 0, and disguises of fixed formats.
    """
    none = F.array().cast(f"array<{CANDIDATE}>")
    met = located(text, pattern)

    def one(m: Column, kind: str, holds: Column, label: Column, value: Column, check: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), holds.alias("holds"), label.alias("label"), *_features(m, value, check)).cast(CANDIDATE)

    null = F.lit(None)
    if kind in PROPOSED:
        check = (lambda m: F.when(_mod_97(m["match"]), 2).otherwise(1)) if kind == "iban" else (lambda m: F.lit(0))
        return F.when(cheap, F.transform(met, lambda m: one(m, kind, null, null, m["match"], check(m)))).otherwise(none)
    if kind in BASE:
        held = lambda m: _holds(kind, m["match"])
        check = (lambda m: F.when(held(m), 2).otherwise(1)) if kind == "card" else (lambda m: F.lit(0))
        real = F.transform(met, lambda m: one(m, kind, held(m), null, m["match"], check(m)))
        disguise = lambda value: lambda m: one(m, "disguise", null, held(m).cast("int"), value(m["match"]), check(m))
        shown = [F.transform(met, disguise(value)) for value in DISGUISES[kind]]
        if kind == "card":  # the same with a digit changed, so that its check fails
            shown.append(F.transform(F.filter(met, held), lambda m: one(m, "disguise", null, F.lit(0), DISGUISES[kind][0](m["match"]), F.lit(1))))
        return F.when(cheap, F.concat(real, *shown)).otherwise(none)
    plain = F.transform(met, lambda m: one(m, kind, null, F.lit(0), m["match"], F.lit(0)))
    if kind == "number":
        like_phone = lambda m: F.regexp_replace(m["match"], "^([0-9]{3})([0-9]{3})", "$1-$2-")
        long = F.filter(met, lambda m: F.length(m["match"]).between(9, 11))
        plain = F.concat(plain, F.transform(long, lambda m: one(m, "disguise", null, F.lit(0), like_phone(m), F.lit(0))))
    return F.when(cheap, plain).otherwise(none)


#: How matches of fixed formats would read in the formats of the further generators.
DISGUISES = {
    "email": (lambda v: F.replace(F.replace(v, F.lit("@"), F.lit(" (at) ")), F.lit("."), F.lit(" (dot) ")), lambda v: F.regexp_replace(v, r"(@[^.]*)\..*$", "$1")),
    "ip": (lambda v: F.replace(v, F.lit("."), F.lit(":")),),
    "card": (lambda v: F.concat(F.lit("XX"), v),),
    "phone": (lambda v: F.regexp_replace(v, r"^\+[0-9]{1,3}[\x20.-]?(?=.{7})", ""),),
}


def propose(docs: DataFrame, text: str = "text", found: str = "_found") -> DataFrame:
    """docs with the column found: all candidates of the whole text by kind, then start. Null counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    cheap = {
        "email": whole.contains("@"), "email_local": whole.contains("@"), "phone": whole.contains("+"), "email_written": whole.rlike(r"(?i)[\[(]at[\])]"),
        "ipv6": whole.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]"), "ip": whole.rlike(r"[0-9]\.[0-9]"), "iban": whole.rlike(r"[A-Z]{2}[0-9]{2}"), "figure": whole.rlike(r"[0-9][-/.,:][0-9]"),
        "national_id": whole.rlike(r"[0-9]-[0-9]{2}-[0-9]"), "phone_local": whole.rlike(r"[0-9]\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3}"),
    }
    patterns = BASE | PROPOSED | BACKGROUND
    parts = [_candidates(kind, whole, pattern, cheap.get(kind, whole.rlike("[0-9]{2}|[0-9][\x20-][0-9]"))) for kind, pattern in patterns.items()]
    return docs.withColumn(found, F.concat(*parts))


@dataclass(frozen=True)
class Model:
    """Boosted trees of depth two, and the score from which a candidate is taken.

    trees: (feature, at most, low side, high side), where a side is a number or such a tuple again.
    calibration: (least score, probability) of held-out candidates by rising score.
    """

    base: float
    trees: tuple
    threshold: float
    calibration: tuple = ()

    def score(self, values: dict[str, Column]) -> Column:
        def of(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            name, most, low, high = node
            return F.when(values[name] <= most, of(low)).otherwise(of(high))

        total = F.lit(self.base)
        for tree in self.trees:
            total = total + of(tree)
        return 1 / (1 + F.exp(-total))


def calibrated(ranked: list[tuple[float, int, int]], prior: float) -> list[tuple[float, float]]:
    """(least score, probability) by falling score from (score, label, count): neighbours are pooled until probabilities fall with scores,
    and each is its pool's share of label 1, smoothed towards prior by SMOOTHING candidates, or that of a lower pool if larger."""
    sums = defaultdict(lambda: [0, 0])
    for score, label, n in ranked:
        sums[score][0] += label * n
        sums[score][1] += n
    pools: list[tuple[float, int, int]] = []
    for score in sorted(sums, reverse=True):
        good, n = sums[score]
        while pools and pools[-1][1] * n < good * pools[-1][2]:
            _, g, m = pools.pop()
            good, n = good + g, n + m
        pools.append((score, good, n))
    shares = accumulate(((good + SMOOTHING * prior) / (n + SMOOTHING) for _, good, n in reversed(pools)), max)
    return list(zip((score for score, _, _ in pools), reversed(list(shares))))


def fit(found: DataFrame, column: str = "_found") -> Model:
    """Trees that tell personal data from other figures by format and context.

    Labels don't come from the formats that are to be chosen. A match of a fixed format teaches in disguise: as it would read
    as a written-out address, a local number, an account or an IPv6 address, in its own context; 1 if it holds, 0 if its check
    fails. Cards teach once more with a digit changed, as 0. Plain numbers, dates, times, amounts and ranges of years are 0, long numbers also as local numbers in their own contexts, so that format
    alone does not decide.

    All candidates of the table count. They are summed by their features, whose values bound the sums
    to a fixed number of rows, and these are what the driver sees. A third of the documents by the hash of the column row
    is held out: there scores become probabilities, and the threshold is the least score of probability LEAST_PROBABILITY.
    Shares are smoothed towards that of the training rows, so few held-out candidates prove little, whatever the table's size.
    """
    names = [n for n, _ in FEATURES]
    each = found.select((F.pmod(F.xxhash64("row"), F.lit(3)) == 0).alias("held"), F.explode(column).alias("c")).where("c.label is not null")
    table = each.groupBy("held", F.col("c.label").alias("label"), *(F.col(f"c.{n}").alias(n) for n in names)).agg(F.count("*").alias("n")).collect()
    rows = lambda held: [([r[n] for n in names], r["label"], r["n"]) for r in table if r["held"] == held]
    train, test = sorted(rows(False)), sorted(rows(True))
    good, bad = (sum(n for _, y, n in train if y == v) for v in (1, 0))
    base = math.log((good + 1) / (bad + 1))
    margin, trees = [base] * len(train), []

    def value(items) -> float:
        return SHRINKAGE * sum(g for _, g, _ in items) / (sum(h for _, _, h in items) + SMOOTHING)

    def split(items, depth):
        sums = [defaultdict(lambda: [0.0, 0.0]) for _ in names]
        for x, g, h in items:
            for s, v in zip(sums, x):
                s[v][0] += g
                s[v][1] += h
        gain = lambda g, h: g * g / (h + SMOOTHING)
        all_g, all_h = sum(g for _, g, _ in items), sum(h for _, _, h in items)
        best = (1e-6, None)
        for f, s in enumerate(sums):
            g = h = 0.0
            for v in sorted(s)[:-1]:
                g, h = g + s[v][0], h + s[v][1]
                best = max(best, (gain(g, h) + gain(all_g - g, all_h - h) - gain(all_g, all_h), (f, v)), key=lambda b: b[0])
        if not depth or best[1] is None:
            return value(items)
        f, v = best[1]
        return (names[f], v, split([i for i in items if i[0][f] <= v], depth - 1), split([i for i in items if i[0][f] > v], depth - 1))

    def walk(node, x) -> float:
        while not isinstance(node, float):
            node = node[2] if x[names.index(node[0])] <= node[1] else node[3]
        return node

    for _ in range(ROUNDS if good and bad else 0):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        tree = split([(x, n * (y - q), n * q * (1 - q)) for (x, y, n), q in zip(train, p)], 2)
        trees.append(tree)
        margin = [m + walk(tree, x) for m, (x, _, _) in zip(margin, train)]

    ranked = [(1 / (1 + math.exp(-base - sum(walk(t, x) for t in trees))), y, n) for x, y, n in test]
    curve = calibrated(ranked, (good + 1) / (good + bad + 2))
    return Model(base, tuple(trees), min((score for score, p in curve if p >= LEAST_PROBABILITY), default=2.0), tuple(reversed(curve)))


def chosen(found: Column, model: Model) -> tuple[Column, Column]:
    """Arrays of spans: those of the fixed formats that hold, and further ones that the trees choose, which overlap none of these."""
    base = F.filter(found, lambda c: F.coalesce(c["holds"], F.lit(False)))
    score = lambda c: model.score({n: c[n] for n, _ in FEATURES})
    more = F.filter(found, lambda c: c["holds"].isNull() & c["label"].isNull() & (score(c) >= model.threshold))
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return bare(base), clear_of(bare(more), bare(base))


def find_pii(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by kind, then start, comma-joined; base_sha256 is
    of those of the fixed formats alone, and counts are of these. Null texts count as empty and give
    no spans. Repeated rows come back repeated; an empty table gives none. Other columns aren't read. Which texts are held out
    while thresholds are set depends on the text alone.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("row"))
    found = cut(propose(rows).drop("text"))
    base, more = chosen(F.col("_found"), fit(found))
    spans = found.select("doc_id", base.alias("base"), more.alias("more"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *(count(k) for k in BASE), F.sha2(described(F.col("base")), 256).alias("base_sha256"), described(F.concat("base", "more")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets; overlapping spans are replaced as one, named after the first.

    Columns and their order stay, whatever their names; a null text stays null. Candidates are looked for once: docs is written
    with them, the trees learn from what is written, and redaction goes on from there.
    """
    name = unused(docs, "found")
    found = cut(propose(docs, text, name))
    base, more = chosen(F.col(name), fit(found.select(F.xxhash64(F.col(text)).alias("row"), F.col(name).alias("found")), "found"))
    spans = F.array_sort(F.transform(F.concat(base, more), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    marked = found.withColumn(name, _merged(spans))
    redacted = F.when(F.size(name) > 0, replaced(F.col(text), F.col(name))).otherwise(F.col(text))
    return marked.select(*(redacted.alias(c) if c == text else F.col(c) for c in docs.columns))


SPAN = "struct<start:bigint,end:bigint,kind:string>"
#: Spans that are replaced in one stretch of a text, so that no stretch is read from the text's beginning for each of them.
STRETCH = 64


def replaced(text: Column, spans: Column) -> Column:
    """text with each of these sorted spans, which don't overlap and are one or more, replaced by its kind in angle brackets."""
    last = lambda block: F.get(block, F.size(block) - 1)["end"]
    begins = lambda bs: F.slice(F.concat(F.array(F.lit(0).cast("bigint")), F.transform(bs, last)), F.lit(1), F.size(bs))
    stretch = lambda block, at: F.struct(block.alias("spans"), at.alias("at"), F.substring(text, at + 1, last(block) - at).alias("text"))
    stretches = bound(blocks(spans, STRETCH), lambda bs: F.zip_with(bs, begins(bs), stretch))

    def fill(stretch: Column) -> Column:
        before = lambda i: F.when(i == 0, stretch["at"]).otherwise(F.get(stretch["spans"], i - 1)["end"])
        piece = lambda s, i: F.concat(F.substring(stretch["text"], before(i) - stretch["at"] + 1, s["start"] - before(i)), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.array_join(F.transform(stretch["spans"], piece), "")

    return F.concat(F.array_join(F.transform(stretches, fill), ""), F.substring(text, last(spans) + 1, F.length(text)))


def _merged(spans: Column) -> Column:
    """Sorted spans with those that overlap joined. A block's spans are joined one after the other, the last of them staying open for the next block,
    so an array of them all is copied once a block rather than once a span."""
    none, null = F.array().cast(f"array<{SPAN}>"), F.lit(None).cast(SPAN)
    state = lambda done, last: F.struct(done.alias("done"), last.alias("last"))
    wider = lambda a, b: F.struct(a["start"].alias("start"), F.greatest(a["end"], b["end"]).alias("end"), a["kind"].alias("kind")).cast(SPAN)
    closed = lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["last"]))
    step = lambda acc, s: F.when(acc["last"]["end"] > s["start"], state(acc["done"], wider(acc["last"], s))).otherwise(state(closed(acc), s.cast(SPAN)))
    block = lambda acc, b: F.aggregate(b, state(none, acc["last"]), step, lambda x: state(F.concat(acc["done"], x["done"]), x["last"]))
    return F.aggregate(blocks(spans, BLOCK), state(none, null), block, closed)
