"""Conversation structure repair by error-correcting Earley parsing.

A weighted grammar of roles has, beside its own productions, some that delete, rerole or insert a turn. Chart items keep their least
(cost, audit), an audit being the initials of the edits in order. A conversation is parsed by segments of at most SEGMENT rows, from each item that
a chart can be entered with; the segments' charts are then chained, which gives the chart of the whole conversation, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import cut, join_groups, map_frames

#: Rows of a segment.
SEGMENT = 512
#: Productions of the grammar, by the number of the item that starts each: nothing, or a system turn if any, then pairs of user and assistant. Recursion is on the
#: left, so all items begin at the first turn and a chart's column has no more items than the grammar has places.
RULES = {"S": (("Q",), ()), "Q": (("u", "a"), ("s", "u", "a"), ("Q", "u", "a"))}
#: What edits cost, in order of their initials; an undeleted truncated turn costs more.
COSTS, TRUNCATED = {"D": 4, "I": 3, "K": 0, "R": 3}, 3
#: Roles that turns can be given, and pairs of initials that may follow each other.
ROLES, LEGAL = {"u": "user", "a": "assistant"}, ("su", "ua", "au")
#: Characters that leave a turn blank, and those that end a sentence.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"

#: Items of the chart between turns: (production, dot). START has predicted all and seen nothing, DONE is behind a whole Q.
START, DONE = ("S", 0, 0), ("Q", 2, 1)
ITEMS = (START, ("Q", 1, 1), ("Q", 0, 1), ("Q", 1, 2), ("Q", 2, 2), DONE)
#: Numbers of the items behind a user's turn, and the place of turns inserted at the end.
BEHIND_USER, BEHIND = (2, 3, 4), 1 << 30


def _better(column: dict, item: tuple, cost: int, audit: str) -> bool:
    """Keep the least (cost, audit) of an item; whether this one is it.

    Audits of equal cost for one item never start each other: letters set the cost, and what one had beyond the other would be inserts, at a price.
    So the least of them stays the least, whatever follows.
    """
    if item not in column or (cost, audit) < column[item]:
        column[item] = (cost, audit)
        return True
    return False


def _after(item: tuple, rule: int) -> tuple | None:
    """The item after one more symbol of a production; a complete Q is one that the left-recursive production goes on from."""
    left, _, dot = item
    whole = RULES[left][rule]
    return DONE if dot + 1 == len(whole) else (left, rule, dot + 1)


def _expected(item: tuple) -> list[tuple[str, tuple]]:
    """(terminal, item behind it) of what may come next; START predicts every production that begins with a terminal."""
    if item == START:
        return [(whole[0], _after(("Q", n, 0), n)) for n, whole in enumerate(RULES["Q"]) if whole[0] != "Q"]
    left, rule, dot = item
    return [(RULES[left][rule][dot], _after(item, rule))]


def _inserted(column: dict) -> dict:
    """The column with all that inserted turns reach from its items."""
    column, waiting = dict(column), list(column)
    while waiting:
        item = waiting.pop()
        cost, audit = column[item]
        for terminal, then in _expected(item):
            if terminal in ROLES and _better(column, then, cost + COSTS["I"], audit + "I"):
                waiting.append(then)
    return column


def _scanned(column: dict, initial: str, fault: str) -> dict:
    """The next column, behind a turn that is kept, reroled or deleted."""
    found: dict = {}
    more = TRUNCATED if fault == "t" else 0
    for item, (cost, audit) in column.items():
        _better(found, item, cost + COSTS["D"], audit + "D")
        if fault in ("b", "d"):
            continue
        if not initial:  # a role without an initial adds nothing
            _better(found, item, cost + COSTS["K"] + more, audit + "K")
        for terminal, then in _expected(item):
            if terminal == initial:
                _better(found, then, cost + COSTS["K"] + more, audit + "K")
            if terminal in ROLES:
                _better(found, then, cost + COSTS["R"] + more, audit + "R")
    return found


@lru_cache(maxsize=20_000)
def charts(turns: tuple[tuple[str, str], ...]) -> list[list]:
    """[entry, exit, cost, audit] for each number of an item that turns (initial, fault) are entered with and each that they are left with.

    Inserted turns stand before the next turn, so no audit of a segment ends in one, and audits of as many turns never start each other.
    """
    out = []
    for n, item in enumerate(ITEMS):
        column = {item: (0, "")}
        for initial, fault in turns:
            column = _scanned(_inserted(column), initial, fault)
        out += [[n, ITEMS.index(then), *least] for then, least in column.items()]
    return out


@lru_cache(maxsize=None)
def endings() -> tuple[tuple[int, int, str], ...]:
    """(item, cost, audit) of the inserted turns that complete the parse from each item."""
    out = []
    for n, item in enumerate(ITEMS):
        least = min(v for then, v in _inserted({item: (0, "")}).items() if then in (START, DONE))
        out.append((n, *least))
    return tuple(out)


class Chain:
    """The charts of a conversation's segments, one after another: of each item the least cost, and the order of the audits so far."""

    def __init__(self):
        self.column = {0: (0, 0)}  # item -> (cost, rank of its audit)
        self.back: list[dict[int, int]] = []

    def add(self, chart: list) -> None:
        found: dict = {}
        for entry, leave, cost, audit in chart:
            if entry in self.column:
                least, rank = self.column[entry]
                found[leave] = min(found.get(leave, (1 << 62,)), (least + int(cost), rank, audit, entry))
        ranks = {way: n for n, way in enumerate(sorted({v[1:3] for v in found.values()}))}
        self.column = {leave: (v[0], ranks[v[1:3]]) for leave, v in found.items()}
        self.back.append({leave: v[3] for leave, v in found.items()})

    def ways(self) -> tuple[int, str, list[tuple[int, int]]]:
        """Cost, inserted turns at the end, and (entry, exit) of each segment."""
        cost, _, tail, at = min((self.column[n][0] + c, self.column[n][1], tail, n) for n, c, tail in endings() if n in self.column)
        ways = []
        for back in reversed(self.back):
            ways.append((back[at], at))
            at = back[at]
        return cost, tail, ways[::-1]


def damaged(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with faults by the CRC-32 of conv_id:turn: a twentieth each is dropped, emptied, loses its ends of sentences, comes
    twice, or gets the role user. A null is one space, but a null turn stays one."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("kind"))
    kind = F.col("kind")
    copies = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return named.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _key(conv: str) -> Column:
    """A text for each conversation; null is one of its own."""
    return F.when(F.col(conv).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(conv).cast("string")))


def _placed(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(key, turn, role, text, digest, pos, seg): rows in order by conversation, turn, role and the digest of the text, nulls first; seg has at most
    SEGMENT rows of one conversation. A range sort deals even a single conversation to many tasks; pos and seg are numbers within a task behind the task's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    named = rows.select(_key(conv).alias("key"), F.col(turn).cast("long").alias("turn"), space(role), space(text)).toDF("key", "turn", "role", "text")
    order = ["key", "turn", "role", "digest"]
    named = named.withColumn("digest", F.sha2("text", 256))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def number(batches):
        import numpy as np
        from pyspark import TaskContext

        task, seen, last, held = TaskContext.get().partitionId(), 0, None, 0
        for batch in batches:
            keys = batch["key"].to_numpy()
            if not len(keys):
                continue
            first = np.r_[True, keys[1:] != keys[:-1]]
            begin = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
            local = np.arange(len(keys)) - begin
            if keys[0] == last:
                local[begin == 0] += held
            last, held = keys[-1], int(local[-1]) + 1
            yield batch.assign(pos=(task << 40) + seen + np.arange(len(keys)), seg=(task << 40) + local // SEGMENT)
            seen += len(keys)

    sorted_rows = named.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return map_frames(sorted_rows, number, "key string, turn long, role string, text string, digest string, pos long, seg long")


def _groups(batches, names: list[str], by: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Successive rows with the same values in the first columns, of sorted batches."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(batch[n].astype(object).where(batch[n].notna(), None).tolist() for n in names)):
            if row[:by] != now:
                if held:
                    yield now, held
                now, held = row[:by], []
            held.append(row)
    if held:
        yield now, held


SEGMENTS = (
    "key string, seg long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "low long, high long, turns long, chart string"
)


def _segments(facts: DataFrame) -> DataFrame:
    """A row of counts and charts for each segment."""

    def run(batches):
        import json

        import pandas as pd

        names, columns = ["key", "seg", "pos", "turn", "initial", "fault"], [f.split()[0] for f in SEGMENTS.split(",")]
        rows = []
        for (key, seg), turns in _groups(batches, names, 2):
            initials, faults = [t[4] for t in turns], [t[5] for t in turns]
            numbers = [t[3] for t in turns if t[3] is not None]
            chart = charts(tuple(zip(initials, faults)))
            rows.append(
                (key, seg, *(faults.count(f) for f in "bdt"), sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), initials[0], initials[-1],
                 min(numbers, default=None), max(numbers, default=None), len(set(numbers)), json.dumps(chart))
            )
            if len(rows) == 1000:
                yield pd.DataFrame(rows, columns=columns, dtype=object)
                rows = []
        yield pd.DataFrame(rows, columns=columns, dtype=object)

    dealt = facts.repartition("key", "seg").sortWithinPartitions("key", "seg", "pos")
    return map_frames(dealt, run, SEGMENTS)


WAYS = (
    "key string, seg long, entry int, leave int, tail string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
)


def _ways(segments: DataFrame) -> DataFrame:
    """The item that each segment of the cheapest parse is entered and left with. The last segment also has the turns inserted at the end and what the conversation counts."""

    def run(batches):
        import json

        import pandas as pd

        names, columns = [f.split()[0] for f in SEGMENTS.split(",")], [f.split()[0] for f in WAYS.split(",")]
        none = (None,) * 7

        def parsed(key, rows):
            chain, segs, counts, illegal, last = Chain(), [], [0, 0, 0], 0, None
            low = high = None
            turns = 0
            for _, seg, *found in rows:
                for n in range(3):
                    counts[n] += found[n]
                illegal += found[3] + (last is not None and last + found[4] not in LEGAL)
                last = found[5]
                if found[6] is not None:
                    turns += found[8] - (found[6] == high)
                    low, high = found[6] if low is None else low, found[7]
                chain.add(json.loads(found[9]))
                segs.append(seg)
            cost, tail, ways = chain.ways()
            gaps = 0 if low is None else high - low + 1 - turns
            for n, (seg, (entry, leave)) in enumerate(zip(segs, ways), 1):
                yield (key, seg, entry, leave, *((tail, gaps, *counts, illegal, cost) if n == len(segs) else none))

        rows = []
        for key, found in _streams(batches, names):
            for row in parsed(key, found):
                rows.append(row)
                if len(rows) == 1000:
                    yield pd.DataFrame(rows, columns=columns, dtype=object)
                    rows = []
        yield pd.DataFrame(rows, columns=columns, dtype=object)

    return map_frames(segments.repartition("key").sortWithinPartitions("key", "seg"), run, WAYS)


def _streams(batches, names: list[str]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(key, its rows) of sorted batches; rows are read as they are asked for and never held together."""
    from itertools import groupby

    def each():
        for batch in batches:
            yield from zip(*(batch[n].astype(object).where(batch[n].notna(), None).tolist() for n in names))

    return groupby(each(), key=lambda row: row[0])


EDITS = "key string, pos long, place int, edit string, role string, text string"


def _edits(rows: DataFrame, ways: DataFrame) -> DataFrame:
    """(key, pos, place, edit, role, text): what becomes of each turn, and the inserted turns around it by their place. Deleted turns have neither role nor text."""

    def run(batches):
        import pandas as pd

        names, columns = ["key", "seg", "pos", "role", "text", "entry", "audit", "tail"], [f.split()[0] for f in EDITS.split(",")]
        out, size = [], 0
        for (key, _), held in _groups(batches, names, 2):
            _, _, _, _, _, entry, audit, tail = held[0]
            letters, last = iter(audit), "u" if entry in BEHIND_USER else ""
            for _, _, pos, own, text, *_ in held[1:]:
                for place, letter in enumerate(letters):
                    role = None if letter == "D" else own if letter == "K" else ROLES["a" if last == "u" else "u"]
                    last = role[:1] if role else last
                    out.append((key, pos, place, letter, role, None if letter == "D" else "" if letter == "I" else text))
                    if letter != "I":
                        break
                size += len(text)
            for place, letter in enumerate(tail or ""):
                last = "a" if last == "u" else "u"
                out.append((key, held[-1][2], BEHIND + place, letter, ROLES[last], ""))
            if size > 1 << 22 or len(out) > 5000:
                yield pd.DataFrame(out, columns=columns, dtype=object)
                out, size = [], 0
        yield pd.DataFrame(out, columns=columns, dtype=object)

    turns = rows.select("key", "seg", "pos", "role", "text", *(F.lit(None).cast(t).alias(n) for n, t in (("entry", "int"), ("audit", "string"), ("tail", "string"))))
    heads = ways.select("key", "seg", F.lit(-1).cast("long").alias("pos"), *(F.lit(None).cast("string").alias(n) for n in ("role", "text")), "entry", "audit", "tail")
    dealt = turns.unionByName(heads).repartition("key", "seg").sortWithinPartitions("key", "seg", "pos")
    return map_frames(dealt, run, EDITS)


def _chart(placed: DataFrame) -> DataFrame:
    """A row for each segment of placed rows: entry, audit, tail, and for the last one of a conversation its counts."""
    trimmed = F.rtrim("text", F.lit(BLANKS))
    same = F.concat(F.md5("key"), F.md5("role"), F.col("digest"))
    facts = placed.select("key", "seg", "pos", "turn", F.substring("role", 1, 1).alias("initial"), same.alias("same"), trimmed.alias("trimmed"))
    facts = facts.select("key", "seg", "pos", "turn", "initial", "same", (F.col("trimmed") == "").alias("blank"), F.substring("trimmed", -1, 1).isin(*ENDS).alias("ended"))
    facts = cut(facts)
    firsts = cut(facts.groupBy("same").agg(F.min("pos").alias("earliest"), F.count("*").alias("copies")))
    fault = F.when(F.col("blank"), "b").when(F.col("pos") > F.col("earliest"), "d").when(~F.col("ended"), "t").otherwise("")
    judged = join_groups(facts, firsts, "same", "copies").select("key", "seg", "pos", "turn", "initial", fault.alias("fault"))
    segments = cut(_segments(judged))
    step = F.explode(F.from_json("chart", "array<array<string>>"))
    steps = segments.select("key", "seg", step.alias("s")).select("key", "seg", *(F.col("s")[n].cast("int").alias(c) for n, c in enumerate(("entry", "leave"))), F.col("s")[3].alias("audit"))
    return cut(_ways(segments).join(steps, ["key", "seg", "entry", "leave"]).drop("leave"))


def _parsed(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    placed = cut(_placed(rows, conv, turn, role, text))
    ways = _chart(placed)
    return _edits(placed, ways), ways


def _unkeyed(conv: str, kind: str) -> Column:
    return F.when(F.col("key") != "-", F.substr("key", F.lit(2))).cast(kind).alias(conv)


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns of the cheapest repair: the column conv, pos, place, edit, role, text, in order by pos and place, which are unique within a conversation.

    edit is K for a turn as it was, R for one with another role, I for an inserted one. Null roles and texts are one space, null conversations are one
    conversation; turns without a number come first, and turns of one number in order of role and the SHA-256 of the text. A role without characters adds nothing
    to the roles and may stay. conv is a number or a text. Repeated rows are duplicates and go; an empty table gives no rows. Only the columns named are read.
    """
    edits, _ = _parsed(rows, conv, turn, role, text)
    return edits.where("edit <> 'D'").select(_unkeyed(conv, rows.schema[conv].dataType.simpleString()), "pos", "place", "edit", "role", "text")


def _digests(edits: DataFrame) -> DataFrame:
    """(key, audit, repaired_sha256): a conversation's turns are read one after another, as its digest demands, and not kept."""

    def run(batches):
        import pandas as pd

        names, columns, out = ["key", "pos", "place", "edit", "role", "text"], ["key", "audit", "repaired_sha256"], []
        for key, found in _streams(batches, names):
            audit, digest, between = [], hashlib.sha256(), b""
            for _, _, _, edit, role, text in found:
                audit.append(edit)
                if edit != "D":
                    digest.update(between + f"{role}:{text}".encode())
                    between = b"\n"
            out.append((key, "".join(audit), digest.hexdigest()))
            if len(out) == 1000:
                yield pd.DataFrame(out, columns=columns, dtype=object)
                out = []
        yield pd.DataFrame(out, columns=columns, dtype=object)

    return map_frames(edits.repartition("key").sortWithinPartitions("key", "pos", "place"), run, "key string, audit string, repaired_sha256 string")


def audit_conversations(rows: DataFrame, every: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation of every (rows unless given): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    gaps are missing turn numbers between the least and the greatest; a turn counts as blank, else duplicate, else truncated; illegal are adjacent turns whose roles may not
    follow each other; audit has the initials of the cheapest edits in order, the least in ASCII among equals. A conversation without
    rows has zeros, an empty audit and the digest of an empty text. Nulls and ties are as for repair_conversations.
    """
    edits, ways = _parsed(rows, conv, turn, role, text)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    totals = ways.where("cost is not null").select("key", *counts).join(_digests(edits), "key")
    known = (rows if every is None else every).select(_key(conv).alias("key")).distinct()
    kind = rows.schema[conv].dataType.simpleString()
    return known.join(totals, "key", "left").select(
        _unkeyed("conv_id", kind), *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
