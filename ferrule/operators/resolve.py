"""Entities in texts by reviewed rules, closed where evidence is missing; publishers by their hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.joins import sized
from ferrule.functions.keys import hash_key
from ferrule.functions.text import has_phrase, normalize_entity
from ferrule.functions.urls import host, host_suffixes

#: Texts give a row for each run of words up to this; a longer alias is met by its first words, then whole.
ALIAS_WORDS = 4
#: Beginnings of aliases that each text meets as a set, without rows for its other words.
FEW_HEADS = 1000
#: Quality of a publisher that nobody has reviewed.
UNREVIEWED = 0.60


def prepared(rules: DataFrame) -> DataFrame:
    """rules (issuer, rule_id, alias, required, negative, valid_from, valid_to) with normalised aliases and terms; empty ones go."""
    terms = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), normalize_entity), lambda t: t != "")
    rows = rules.withColumn("alias_text", normalize_entity(F.col("alias")))
    found = rows.withColumn("required", terms(F.col("required"))).withColumn("negative", terms(F.col("negative")))
    return found.where("alias_text <> ''")


def match_rules(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """A row for each text and rule whose alias stands in it as whole words, with the required and negative terms it holds.

    texts: text_id, text and others. Runs of words of each text are joined with aliases by equality, so no
    pair of text and rule is formed but those that match, or hold the first ALIAS_WORDS words of a longer alias. Where aliases have at most FEW_HEADS
    beginnings, a text meets these as a set and only what it holds of them becomes rows. More are joined by equality with a row for each run, and bodies with
    the pairs that match; rules are measured, up to BROADCAST_BYTES they are broadcast, more are joined by a shuffle.
    """
    headed = prepared(rules).withColumn("_head", F.substring_index("alias_text", " ", ALIAS_WORDS))
    heads, longest = headed.agg(F.countDistinct("_head"), F.max(F.size(F.split("_head", " ")))).first()
    n, runs = F.size("_words"), [F.col("_words")]
    for k in range(2, min(ALIAS_WORDS, longest or 1) + 1):
        more = F.greatest(n - k + 1, F.lit(0))
        runs.append(F.zip_with(F.slice(runs[-1], F.lit(1), more), F.slice("_words", F.lit(k), more), lambda a, w: F.concat(a, F.lit(" "), w)))
    # no row has an empty head, so empty bodies need no filter, which would normalise texts twice
    # as a generator's output bodies are computed once; tests of them would move below a column, with a second copy of its work
    bodies = texts.select(*(c for c in texts.columns if c != "text"), F.explode_outer(F.array(normalize_entity(F.col("text")))).alias("body"))
    others = [c for c in bodies.columns if c != "_words"]
    worded = bodies.withColumn("_words", F.split("body", " "))
    if heads <= FEW_HEADS:
        every = F.broadcast(headed.agg(F.collect_set("_head").alias("_heads")))
        # a plain explode is given a condition that it has rows, with a second copy of all the work on texts; the join drops what has none
        named = worded.crossJoin(every).select(*others, F.explode_outer(F.array_intersect(F.concat(*runs), "_heads")).alias("_head"))
        met = named.join(F.broadcast(headed), "_head")
    else:
        keyed = worded.select("text_id", F.explode(F.array_distinct(F.concat(*runs))).alias("_head"))
        met = keyed.join(sized(headed), "_head").join(bodies, "text_id")
    matched = met.where((F.col("_head") == F.col("alias_text")) | has_phrase(F.col("body"), F.col("alias_text"))).drop("_head")
    held = lambda c: F.filter(c, lambda t: has_phrase(F.col("body"), t))
    return matched.withColumn("required_met", held(F.col("required"))).withColumn("negative_met", held(F.col("negative")))


def outside_validity(day: Column) -> Column:
    return (F.col("valid_from").isNotNull() & (day < F.col("valid_from"))) | (F.col("valid_to").isNotNull() & (day > F.col("valid_to")))


def aligned_titles(titles: DataFrame, rules: DataFrame, tickers: DataFrame) -> DataFrame:
    """(text_id, issuer), each once, of titles (text_id, title, day) that name an issuer.

    A title names it by one of its tickers (issuer, ticker) of two characters or more, or by an alias that is valid on
    the day and none of whose negative terms stands in the title. Without a day every alias is valid.
    """
    texts = titles.select("text_id", F.col("title").alias("text"), "day")
    valid = ~F.coalesce(outside_validity(F.col("day")), F.lit(False)) & (F.size("negative_met") == 0)
    by_alias = match_rules(texts, rules).where(valid).select("text_id", "issuer")
    none = lambda kind: F.lit(None).cast(kind)
    named = tickers.where(F.length(normalize_entity(F.col("ticker"))) >= 2).select(
        "issuer", F.col("ticker").alias("rule_id"), F.col("ticker").alias("alias"), none("array<string>").alias("required"),
        none("array<string>").alias("negative"), none("string").alias("valid_from"), none("string").alias("valid_to"),
    )
    return by_alias.unionByName(match_rules(texts, named).select("text_id", "issuer")).distinct()


def rule_status(day: Column) -> Column:
    """Validity first, then negative context, then required context."""
    outside = outside_validity(day)
    lacks = (F.size("required") > 0) & (F.size("required_met") == 0)
    return F.when(outside, "outside_validity").when(F.size("negative_met") > 0, "negative_context").when(lacks, "missing_required_context").otherwise("accepted")


def decide(matches: DataFrame, day: Column, aligned: Column) -> DataFrame:
    """(text_id, issuer, accepted, reason, rule_id, rule_ids, context_key): one decision for each text and issuer.

    The accepted match with the longest alias, then the smallest rule, wins over others' negatives, if the title is aligned.
    Else the reason is negative context wherever a match has it, or the status of the most specific match.
    """
    status = rule_status(day)
    order = F.struct(-F.length("alias_text"), F.col("rule_id"))
    graded = matches.withColumn("status", status).withColumn("aligned", aligned)
    found = graded.groupBy("text_id", "issuer").agg(
        F.min_by("rule_id", F.when(F.col("status") == "accepted", order)).alias("best"), F.min_by("status", order).alias("specific"),
        F.max((F.col("status") == "negative_context")).alias("negative"), F.max("aligned").alias("aligned"),
        F.array_sort(F.collect_set("rule_id")).alias("rule_ids"), F.array_sort(F.collect_set(F.sha2("body", 256))).alias("contexts"),
    )
    has = F.col("best").isNotNull()
    reason = F.when(has & ~F.col("aligned"), "title_not_aligned").when(has, "accepted").when(F.col("negative"), "negative_context").otherwise(F.col("specific"))
    return found.select("text_id", "issuer", (has & F.col("aligned")).alias("accepted"), reason.alias("reason"), F.when(has & F.col("aligned"), F.col("best")).alias("rule_id"), "rule_ids", F.sha2(F.array_join("contexts", "\x1f"), 256).alias("context_key"))


def rejections(decisions: DataFrame, by: list[str]) -> DataFrame:
    """Counts of decisions, and of the rejected by reason as a map in the order of reasons."""
    each = decisions.groupBy(*by, "reason").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"))
    reasons = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("n") > F.col("accepted"), F.struct("reason", F.col("n") - F.col("accepted"))))))
    return each.groupBy(*by).agg(F.sum("n").alias("candidates"), F.sum("accepted").alias("accepted"), (F.sum("n") - F.sum("accepted")).alias("rejected"), reasons.alias("reasons"))


def audit(decisions: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """decisions with a fingerprint, each once, without those whose fingerprint is in known."""
    found = decisions.withColumn("fingerprint", hash_key("text_id", "issuer", F.col("accepted").cast("int"), "reason", "rule_id", "context_key")).dropDuplicates(["fingerprint"])
    return found if known is None else found.join(known.select("fingerprint"), "fingerprint", "left_anti")


def publisher_quality(urls: DataFrame, publishers: DataFrame) -> DataFrame:
    """urls (url_id, url) with host, publisher_domain and quality of the longest reviewed domain the host belongs to.

    publishers: domain, quality. Hosts are joined with domains through their suffixes, by equality.
    """
    hosts = urls.select("url_id", host(F.coalesce("url", F.lit(""))).alias("host"))
    suffix = hosts.withColumn("domain", F.explode(host_suffixes(F.col("host")))).join(publishers, "domain")
    best = suffix.groupBy("url_id").agg(F.max_by(F.struct("domain", "quality"), F.length("domain")).alias("best"))
    found = hosts.join(best, "url_id", "left")
    return found.select("url_id", "host", F.coalesce("best.domain", F.lit("unreviewed")).alias("publisher_domain"), F.coalesce("best.quality", F.lit(UNREVIEWED)).alias("quality"))


def overlapping_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of rows of a key whose validity intervals meet, null ends being open: row_id, valid_from, valid_to.

    Rows are sorted by their begin; one overlaps an earlier row if it begins no later than the latest end so far.
    """
    begin, end = F.coalesce("valid_from", F.lit("0000-01-01")), F.coalesce("valid_to", F.lit("9999-12-31"))
    order = Window.partitionBy(*keys).orderBy("_begin", "row_id")
    seen = rows.withColumn("_begin", begin).withColumn("_end", end).withColumn("_latest", F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return seen.where("_begin <= _latest").select(*keys, "row_id")
