"""Matches of a pattern with their places, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are summed step by step; longer arrays are summed by blocks.
BLOCK = 512


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use has it, also within functions of array elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sums(lengths: Column) -> Column:
    """The sum of each element of an array of longs and all before it.

    An array that grows by an element is copied, so sums are taken within blocks and over the blocks' totals.
    """
    empty = F.array().cast("array<bigint>")
    grow = lambda acc, v: F.struct((acc["sum"] + v).alias("sum"), F.array_append(acc["sums"], acc["sum"] + v).alias("sums"))
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), empty.alias("sums"))
    tops = lambda bs: F.aggregate(bs, start, lambda acc, b: grow(acc, b["sum"]), lambda acc: acc["sums"])
    raised = lambda b, top: F.transform(b["sums"], lambda v: v + top - b["sum"])
    summed = lambda block: F.aggregate(block, start, grow)
    return bound(F.transform(blocks(lengths, BLOCK), summed), lambda bs: F.flatten(F.zip_with(bs, tops(bs), raised)))


def blocks(values: Column, size: int) -> Column:
    """Consecutive elements in arrays of size, one at least."""
    last = lambda v: F.greatest(F.floor((F.size(v) - 1) / size), F.lit(0)).cast("int")
    return bound(values, lambda v: F.transform(F.sequence(F.lit(0), last(v)), lambda b: F.slice(v, b * size + 1, F.lit(size))))


def running_greatest(values: Column) -> Column:
    """The greatest of each element of an array of longs and all before it, taken as running_sums() takes sums."""
    least = F.lit(-(1 << 62)).cast("bigint")
    start = F.struct(least.alias("top"), F.array().cast("array<bigint>").alias("tops"))
    grow = lambda acc, v: F.struct(F.greatest(acc["top"], v).alias("top"), F.array_append(acc["tops"], F.greatest(acc["top"], v)).alias("tops"))
    before = lambda bs: F.aggregate(bs, F.struct(least.alias("top"), F.array(least).alias("tops")), lambda acc, b: grow(acc, b["top"]), lambda acc: acc["tops"])
    raised = lambda b, top: F.transform(b["tops"], lambda v: F.greatest(v, top))
    topped = lambda block: F.aggregate(block, start, grow)
    return bound(F.transform(blocks(values, BLOCK), topped), lambda bs: F.flatten(F.zip_with(bs, F.slice(before(bs), F.lit(1), F.size(bs)), raised)))


def clear_of(spans: Column, base: Column, within: bool = False) -> Column:
    """The spans, in their order, that overlap none of base, or with within, that lie within none of it. Both are arrays of structs with start and end.

    Both are sorted together by start: what begins no later overlaps a span if the greatest end so far is behind its start, and
    what begins later does if the next start is before its end. So time grows with the numbers of both, not with their product.
    """
    far, least = F.lit(1 << 62).cast("bigint"), F.lit(-1).cast("bigint")
    entry = lambda s, own, n, held: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), n.alias("n"), s["end"].alias("end"), held.alias("span"))

    def sorted_together(own: Column, fixed: Column) -> Column:
        none = F.get(F.slice(own, F.lit(1), F.lit(0)), F.lit(0))
        return F.array_sort(F.concat(F.transform(fixed, lambda b: entry(b, 0, F.lit(-1), none)), F.transform(own, lambda s, n: entry(s, 1, n, s))))

    def free(events: Column) -> Column:
        ends = running_greatest(F.transform(events, lambda e: F.when(e["own"] == 0, e["end"]).otherwise(least)))
        starts = F.reverse(running_greatest(F.reverse(F.transform(events, lambda e: F.when(e["own"] == 0, -e["start"]).otherwise(-far)))))
        met = (lambda x: x["last"] >= x["e"]["end"]) if within else (lambda x: (x["last"] > x["e"]["start"]) | (-x["next"] < x["e"]["end"]))
        joined = F.zip_with(F.zip_with(events, ends, lambda e, last: F.struct(e.alias("e"), last.alias("last"))), starts, lambda x, next_: F.struct(x["e"].alias("e"), x["last"].alias("last"), next_.alias("next")))
        kept = F.transform(F.filter(joined, lambda x: (x["e"]["own"] == 1) & ~met(x)), lambda x: F.struct(x["e"]["n"].alias("n"), x["e"]["span"].alias("span")))
        return F.transform(F.array_sort(kept), lambda x: x["span"])

    apart = lambda own, fixed: F.when((F.size(own) == 0) | (F.size(fixed) == 0), own).otherwise(bound(sorted_together(own, fixed), free))
    return bound(spans, lambda own: bound(base, lambda fixed: apart(own, fixed)))


def located(text: Column, pattern: str) -> Column:
    """An array of (match, start, end, left, right): leftmost non-overlapping matches of a pattern that
    never matches nothing, in code points, and the text between them and their neighbours.
    """
    none = F.array().cast("array<struct<match:string,start:bigint,end:bigint,left:string,right:string>>")
    placed = lambda matches: F.when(F.size(matches) == 0, none).otherwise(_placed(matches, F.split(text, pattern, -1)))
    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _placed(matches: Column, gaps: Column) -> Column:
    between = lambda g: F.zip_with(F.slice(g, F.lit(1), F.size(g) - 1), F.slice(g, F.lit(2), F.size(g) - 1), lambda left, right: F.struct(left.alias("left"), right.alias("right")))
    pairs = F.zip_with(matches, bound(gaps, between), lambda m, g: F.struct(m.alias("match"), g["left"].alias("left"), g["right"].alias("right")))
    ends = lambda ps: running_sums(F.transform(ps, lambda p: F.length(p["match"]).cast("bigint") + F.length(p["left"])))
    place = lambda p, e: F.struct(p["match"].alias("match"), (e - F.length(p["match"])).alias("start"), e.alias("end"), p["left"].alias("left"), p["right"].alias("right"))
    return bound(pairs, lambda ps: F.zip_with(ps, ends(ps), place))


def described(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
