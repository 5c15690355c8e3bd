"""Spans beyond the fixed formats: all of them against plain Python, and precision and recall on planted rows."""

import math
import random
import re

from pyspark.sql import functions as F

from ferrule.llm import pii, secret_scan
from ferrule.llm.common import read_table
from test_spans import PII, luhn, parsed, plain


def card(rng):
    body = [rng.randrange(10) for _ in range(15)]
    return next(c for c in ("".join(map(str, [*body, k])) for k in range(10)) if luhn(c))


def iban(rng, right=True):
    body = "".join(str(rng.randrange(10)) for _ in range(18))
    check = 98 - int(body + "131400") % 97
    return f"DE{check if right else (check + 5) % 97 + 1:02d}{body}"


def planted(rng, n):
    """n texts of background figures and data in fixed formats, a few of them with personal data in other formats, whose places come too."""
    texts, truth = [], set()
    for i in range(n):
        cue, figure = rng.choice(("mail ", "call ", "contact: ", "account ")), rng.choice((f"in {rng.randrange(1900, 2030)}", f"page {rng.randrange(10**5)}", f"on 2024-0{rng.randrange(1, 9)}-1{rng.randrange(9)}", f"item {rng.randrange(10**8, 10**10)}", f"{rng.randrange(1, 9)},{rng.randrange(100, 999)}.50 paid"))
        fixed = rng.choice((f"joe{i}@mail{i % 7}.example.org", f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", card(rng)))
        text = f"some words {figure} and {cue}{fixed} thanks"
        if i % 5 == 0:
            value = (f"joe{i} (at) example (dot) org", f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", iban(rng), iban(rng, False))[i // 5 % 4]
            text += f" {cue}{value} end"
            if i // 5 % 4 < 3:
                truth.add((i, text.index(value), text.index(value) + len(value)))
        texts.append(text)
    return texts, truth


def test_added_personal_data(table):
    texts, truth = planted(random.Random(3), 900)
    rows = pii.find_pii(table(texts)).collect()
    added = {(r.doc_id, a, b) for r in rows for _, a, b in parsed(r.spans)[len(plain(PII, texts[r.doc_id])) :]}
    assert len(added & truth) >= 0.95 * len(added) and len(added & truth) >= 0.9 * len(truth)


def score(model, x):
    total = model.base
    for node in model.trees:
        while not isinstance(node, float):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        total += node
    return 1 / (1 + math.exp(-total))


def mod_97(value):
    bare = value.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def plain_features(kind, text, a, b):
    def edge(c):
        return 0 if not c or c.isspace() else 2 if c in "=:/\"'" else 3 if c.isalnum() else 1

    value, left, right = text[a:b], text[:a], text[b:]
    return {
        "digits": min(int(sum(c in "0123456789" for c in value) / 2.5), 7), "separators": (3 if "." in value else 1) if re.search(r"[ ()-]", value) else 2 if "." in value else 0,
        "left_kind": edge(left[-1:]), "right_kind": edge(right[:1]), "cue": int(bool(re.search(pii.CUES, left[-pii.CUE_WIDTH :]))), "width": min(len(value) // 5, 5),
        "shape": 1 if "@" in value else 2 if ":" in value else 3 if re.search("[A-Za-z]", value) else 0, "check": (2 if mod_97(value) else 1) if kind == "iban" else 0,
    }


def test_all_spans_by_plain_python(spark, data, table):
    """The model's choice, made again in plain Python from the texts, over a whole table with planted rows."""
    texts = [r.text for r in read_table(spark, data, "documents").orderBy("doc_id").collect()] + planted(random.Random(9), 400)[0]
    docs = table(texts)
    model = pii.fit(pii.propose(docs.select("text", F.xxhash64("text").alias("row"))).select("row", "_found"))
    assert model.threshold < 1 and all(p <= q for (_, p), (_, q) in zip(model.calibration, model.calibration[1:]))
    found = {r.doc_id: parsed(r.spans) for r in pii.find_pii(docs).collect()}
    for i, t in enumerate(texts):
        base = plain(PII, t)
        more = []
        for kind, pattern in pii.PROPOSED.items():
            for m in re.finditer(pattern, t or ""):
                span = (kind, m.start(), m.end())
                if score(model, plain_features(*span[:1], t, *span[1:])) >= model.threshold and not any(a < m.end() and m.start() < b for _, a, b in base):
                    more.append(span)
        assert found[i] == base + more, t[:80]


def test_calibration():
    assert pii.calibrated([], 0.5) == []
    curve = pii.calibrated([(0.9, 1, 40), (0.8, 0, 1), (0.8, 1, 30), (0.5, 1, 5), (0.5, 0, 60)], 0.5)
    assert [s for s, _ in curve] == [0.9, 0.8, 0.5] and curve[0][1] == (40 + 2) / 44 and all(p > q for (_, p), (_, q) in zip(curve, curve[1:]))


def test_many_spans_in_one_text(table):
    text = "write a@b.cd or +1 (234) 567-8901 now, " * 1500
    docs = table([text, "x a@b.cd"])
    assert pii.redact(docs).where("doc_id = 0").first().text == text.replace("a@b.cd", "<EMAIL>").replace("+1 (234) 567-8901", "<PHONE>")
    assert len(parsed(pii.find_pii(docs).where("doc_id = 0").first().spans)) == 3000


def test_overlapping_spans_are_one(spark):
    spans = [(0, 5, "a"), (3, 9, "b"), (8, 9, "c"), (9, 12, "d"), (20, 21, "e")]
    df = spark.createDataFrame([(spans * 1,), ([],)], "s array<struct<start:bigint,end:bigint,kind:string>>")
    got = [[tuple(x) for x in r.m] for r in df.select(pii._merged(F.col("s")).alias("m")).collect()]
    assert sorted(got) == [[], [(0, 9, "a"), (9, 12, "d"), (20, 21, "e")]]
    many = [(10 * i, 10 * i + (15 if i % 512 == 511 else 5), "k") for i in range(1300)]
    row = spark.createDataFrame([(many,)], "s array<struct<start:bigint,end:bigint,kind:string>>").select(pii._merged(F.col("s")).alias("m")).first()
    assert len(row.m) == 1300 - 2 and row.m[511].end == 10 * 512 + 5


def test_ownership_alone_decides(spark):
    """Values drawn alike, in the same places: those of one owner are added, those that owners share are not."""
    rng = random.Random(6)
    value = lambda: "ghp_" + "".join(rng.choice("abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(24))
    own, copied = [value() for _ in range(40)], [value() for _ in range(40)]
    rows, truth = [], set()
    for i in range(400):
        k = i % 40
        rows.append((2 * i, f"deploy with {own[k]} here", f"o{k}/r{i // 40}", f"o{k}"))
        rows.append((2 * i + 1, f"deploy with {copied[k]} here", f"o{i % 37}/r", f"o{i % 37}"))
        truth.add(2 * i)
    df = spark.createDataFrame(rows, "doc_id long, text string, repo string, who string")
    found = secret_scan.find_secrets(df, F.col("repo"), F.col("who")).collect()
    added = {r.doc_id for r in found if r.spans}
    judged = {r.doc_id for r in found if r.n_copied}
    live = {r.doc_id for r in found if any(c.isdigit() for c in r.spans)}
    assert added == live and len(added & truth) >= 0.9 * len(truth) and added <= truth and judged >= {i for i in range(1, 800, 2)}
    plain_verdicts = {}
    for i, text, repo, who in rows:
        plain_verdicts.setdefault(text.split()[2], {}).setdefault(who, set()).add(repo)
    for r in found:
        owners = plain_verdicts[rows[r.doc_id][1].split()[2]]
        share = max(map(len, owners.values())) / sum(map(len, owners.values()))
        want = "own" if share >= 0.75 else "copied" if share < 0.5 else "shared"
        assert {v.rsplit(":", 1)[1] for v in r.verdicts.split(",")} <= {want}
