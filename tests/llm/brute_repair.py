"""Conversation repair by trying all edits in order of cost, for short conversations, and by a table of states for longer ones."""

import hashlib
import re
import zlib
from itertools import product


def damage(rows):
    """conv_id -> rows (turn, role, text) after damage, in order; every conversation is a key."""
    found = {}
    for conv, turn, role, text in rows:
        held = found.setdefault(conv, [])
        sp = lambda v: " " if v is None else str(v)
        kind, role, text = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20, sp(role), sp(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        held += [(turn, role, text)] * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest())
    return {conv: sorted(held, key=order) for conv, held in found.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best(rows, marks):
    """(cost, audit, lines) of the cheapest repair, the least audit among equals: all states by whole audits, the output's roles being the state."""
    cost = {"": (0, "", ())}  # roles so far, cut to what matters: "", "s", "u" or "a" last

    def put(to, state, value):
        if state not in to or value[:2] < to[state][:2]:
            to[state] = value
            return True

    def step(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial)) if initial else state

    def insert(now):
        now, work = dict(now), list(now)
        while work:
            state = work.pop()
            c, a, lines = now[state]
            for role in ("user", "assistant"):
                then = step(state, role[0])
                if then is not None and put(now, then, (c + 3, a + "I", (*lines, f"{role}:"))):
                    work.append(then)
        return now

    for (_, role, text), mark in zip(rows, marks):
        cost, now = {}, insert(cost)
        more = 3 if mark == "t" else 0
        for state, (c, a, lines) in now.items():
            put(cost, state, (c + 4, a + "D", lines))
            if mark in ("b", "d"):
                continue
            then = step(state, role[:1])
            if then is not None:
                put(cost, then, (c + more, a + "K", (*lines, f"{role}:{text}")))
            for other in ("user", "assistant"):
                then = step(state, other[0])
                if then is not None:
                    put(cost, then, (c + 3 + more, a + "R", (*lines, f"{other}:{text}")))
    now = insert(cost)
    return min(now[s] for s in ("", "a") if s in now)


def every_way(rows, marks):
    """The same (cost, audit) by trying every sequence of edits with at most two inserts at each place."""
    found = None
    choices = []
    for mark in marks:
        own = ["D"] if mark in ("b", "d") else ["D", "K", "Ru", "Ra"]
        choices += [["", "u", "a", "ua", "au", "uu", "aa"], own]
    choices.append(["", "u", "a", "ua", "au"])
    for way in product(*choices):
        cost, audit, roles = 0, "", ""
        for n, edit in enumerate(way):
            if n % 2 == 0:
                cost, audit, roles = cost + 3 * len(edit), audit + "I" * len(edit), roles + edit
            else:
                audit += edit[0]
                cost += {"D": 4, "K": 0, "R": 3}[edit[0]] + (3 if marks[n // 2] == "t" and edit != "D" else 0)
                roles += "" if edit == "D" else rows[n // 2][1][:1] if edit == "K" else edit[1]
        if re.fullmatch("(s?(ua)+)?", roles) and (found is None or (cost, audit) < found):
            found = (cost, audit)
    return found


def whole(rows):
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation."""
    for conv, held in damage(rows).items():
        marks = faults(held)
        turns = {t for t, _, _ in held if t is not None}
        initials = [r[:1] for _, r, _ in held]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = best(held, marks)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        yield (conv, gaps, *(marks.count(m) for m in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
