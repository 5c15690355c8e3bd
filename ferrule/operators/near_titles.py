"""Titles that may name one event: pairs of an issuer's titles whose words are alike, found without comparing all with all."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.durable import durable
from ferrule.functions.text import token_set_ratio

#: The hours between near events, and the least similarity of their titles.
NEAR_HOURS, NEAR_RATIO = 48, 92.0
#: Titles that announce a correction, and numbers in titles.
CORRECTION, NUMBER = r"\b(correction|corrected|revision|revised|update|updated)\b", r"\b\d+(?:[.,]\d+)*%?\b"
#: The longest piece of a word, and the most frequent grams whose counts are known when pieces are chosen.
PIECE, FREQUENT = 3, 10_000
#: Titles of an issuer's two spans in a row that are few enough to be compared with each other, as each alone has more grams than that.
FEW_TITLES = 100


@dataclass(frozen=True)
class Wording:
    """What a title says apart from its numbers, these in order, and whether it announces a correction."""

    words: str
    numbers: tuple[str, ...]
    announced: bool

    @staticmethod
    @lru_cache(maxsize=4096)
    def of(title: str) -> Wording:
        return Wording(re.sub(NUMBER, "", title), tuple(re.findall(NUMBER, title)), re.search(CORRECTION, title) is not None)

    def corrects(self, old: Wording) -> bool:
        return self.announced or (self.numbers != old.numbers and token_set_ratio(self.words, old.words, NEAR_RATIO) >= NEAR_RATIO)


def _words(title: str) -> Column:
    return F.array_distinct(F.split(title, " "))


def _pieces(title: str) -> Column:
    """Each distinct word of a title in as few equal parts as hold PIECE characters at most."""

    def parts(word: Column) -> Column:
        size = F.length(word)
        n = F.ceil(size / PIECE).cast("int")
        edge = lambda i: F.floor(i * size / n).cast("int")
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(word, edge(i - 1) + 1, edge(i) - edge(i - 1)))

    return F.flatten(F.transform(_words(title), parts))


def _grams(title: str) -> Column:
    """All runs of one to PIECE characters within words, once each."""
    runs = lambda word, k: F.transform(F.sequence(F.lit(1), F.length(word) - k + 1), lambda i: F.substr(word, i, F.lit(k)))
    of_word = lambda word: F.flatten(F.array(*(F.when(F.length(word) >= k, runs(word, k)).otherwise(F.array().cast("array<string>")) for k in range(1, PIECE + 1))))
    return F.array_distinct(F.flatten(F.transform(_words(title), of_word)))


def similar(pairs: DataFrame) -> DataFrame:
    """(a, b, ratio, b_corrects, a_corrects) of pairs (a, b, a_title, b_title) whose ratio is NEAR_RATIO or more; x_corrects: whether x, coming second, opens a version."""

    def run(batches) -> Iterator:
        import pandas as pd

        for batch in batches:
            found = []
            for a, b, one, two in zip(batch["a"], batch["b"], batch["a_title"], batch["b_title"]):
                if (ratio := token_set_ratio(one, two, NEAR_RATIO)) >= NEAR_RATIO:
                    found.append((a, b, ratio, Wording.of(two).corrects(Wording.of(one)), Wording.of(one).corrects(Wording.of(two))))
            yield pd.DataFrame(found, columns=["a", "b", "ratio", "b_corrects", "a_corrects"])

    return pairs.select("a", "b", "a_title", "b_title").mapInPandas(run, "a string, b string, ratio double, b_corrects boolean, a_corrects boolean")


def title_pairs(titles: DataFrame, few: int = FEW_TITLES) -> DataFrame:
    """(a, b, ratio, corrects) both ways of different titles of an issuer that come within two spans of time and are alike; corrects: b, coming after a, opens a version.

    titles: issuer, key (of issuer and title), title, span; distinct. No pair is lost. Where a span and the next have few titles, all these are compared; titles of
    fuller spans meet by what they have in common, see _sharing().
    """
    titles = durable(titles)
    counts = titles.groupBy("issuer", "span").agg(F.count("*").alias("n"))
    after = counts.select("issuer", (F.col("span") - 1).alias("span"), F.col("n").alias("more"))
    blocks = durable(counts.join(after, ["issuer", "span"], "left").select("issuer", "span", (F.col("n") + F.coalesce("more", F.lit(0)) > few).alias("full")))
    first = titles.join(blocks.where("not full"), ["issuer", "span"]).select("issuer", "span", F.col("key").alias("a"), F.col("title").alias("a_title"))
    again = F.explode(F.array(F.struct("span", F.lit(False).alias("later")), F.struct((F.col("span") - 1).alias("span"), F.lit(True).alias("later"))))
    second = titles.select("issuer", F.col("key").alias("b"), F.col("title").alias("b_title"), again.alias("s")).select("issuer", "s.*", "b", "b_title")
    found = similar(first.join(second, ["issuer", "span"]).where("a < b or (later and a <> b)"))
    full = blocks.where("full").select("issuer", F.explode(F.array(F.col("span"), F.col("span") + 1)).alias("span")).distinct()
    if not full.isEmpty():
        found = found.unionByName(similar(_sharing(titles.join(full, ["issuer", "span"], "left_semi"))))
    found = durable(found)
    back = found.select(F.col("b").alias("a"), F.col("a").alias("b"), "ratio", F.col("a_corrects").alias("b_corrects"), F.col("b_corrects").alias("a_corrects"))
    # titles that meet in several spans are told once
    return found.unionByName(back).select("a", "b", "ratio", F.col("b_corrects").alias("corrects")).distinct()


def _sharing(titles: DataFrame) -> DataFrame:
    """(a, b, a_title, b_title), each pair once, of titles within two spans of time that may be alike, without comparing all with all.

    With words sorted, a ratio of NEAR_RATIO leaves no more
    than a share of 1 - NEAR_RATIO / 100 of both titles' characters to delete and insert, 2 * (1 - NEAR_RATIO / 100) of the longer one's. Each of these damages one piece
    of the longer title at most, so of one piece more, any, at least one stands whole within a word of the other title. The rarest pieces of each title thus ask for
    titles that have them among their grams. A title that holds another, or nearly, as a set of words has all or nearly all of that one's pieces.
    """
    distinct = titles.select("key", "title").distinct()
    grams = durable(distinct.select("key", F.explode(_grams("title")).alias("gram")))
    frequent = grams.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "gram").limit(FREQUENT)
    length = F.length(F.array_join(_words("title"), " "))
    needed = (F.floor(length * F.lit(2 * (1 - NEAR_RATIO / 100) + 1e-9)) + 1).cast("int")
    pieces = distinct.select("key", needed.alias("needed"), F.explode(F.array_distinct(_pieces("title"))).alias("gram"))
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("gram")).alias("size"), "gram")
    # a piece that a title has twice stands for both, so as many distinct ones are enough, or all of them
    chosen = pieces.join(F.broadcast(frequent), "gram", "left").groupBy("key", "needed").agg(F.array_sort(F.collect_list(rarity)).alias("held"))
    asked = chosen.select("key", F.explode(F.slice("held", F.lit(1), F.col("needed"))).alias("p")).select("key", "p.gram")
    spans = titles.select("issuer", "key", "span")
    asking = asked.join(spans, "key").select("issuer", F.col("key").alias("a"), "gram", F.explode(F.array(F.col("span") - 1, F.col("span"), F.col("span") + 1)).alias("span"))
    held = grams.join(spans, "key").select("issuer", F.col("key").alias("b"), "gram", "span")
    met = asking.join(held, ["issuer", "span", "gram"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    name = lambda side: distinct.select(F.col("key").alias(side), F.col("title").alias(f"{side}_title"))
    return met.join(name("a"), "a").join(name("b"), "b")


def announced(title: str) -> Column:
    return F.col(title).rlike(CORRECTION)
