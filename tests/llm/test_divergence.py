import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from ferrule.llm import divergence
from ferrule.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    """Every result row by plain integers."""
    count, documents = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = [w.translate(LOWER) for w in TERM.findall(text or "")]
        count[lang or "", source or ""].update(words)
        documents[lang or ""].update(set(words))
    for lang in {g[0] for g in count}:
        kept = sorted(t for t, n in documents[lang].items() if n >= divergence.LEAST_DOCUMENTS)
        groups = {g[1]: c for g, c in count.items() if g[0] == lang}

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in groups.items()}
        q = shares(sum(groups.values(), Counter()))
        for s, c in groups.items():
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 50)):
                for rank, (value, _, item) in enumerate(sorted(found)[:most], 1):
                    yield lang, s, part, item, -value, rank


def found(spark, rows, **more):
    table = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in divergence.source_divergence(table).select("lang", "source", "part", "item", "value", "rank").collect())


def rows():
    rng = np.random.default_rng(5)
    out = []
    for n in range(400):
        lang = "de" if n % 3 else "fr"
        words = [f"w{chr(97 + int(i) % 26)}{'é' * (int(i) // 26)}" for i in rng.zipf(1.5, rng.integers(0, 30)) if i < 200]
        out.append((" ".join(w.upper() if k % 5 == 0 else w for k, w in enumerate(words)) + "1,É.", lang, f"s{int(rng.integers(0, 6))}"))
    return out


def test_against_plain_integers(spark):
    assert found(spark, rows()) == sorted(brute(rows()))


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_CELLS", 20)
    monkeypatch.setattr(divergence, "PAIR_CELLS", 30)
    monkeypatch.setattr(divergence, "BATCH_BYTES", 100)
    assert found(spark, rows()) == sorted(brute(rows()))


def test_odd_rows(spark):
    odd = [(None, None, None), ("", "", "x"), ("a", "xx", "only"), ("Ünï A\x00b", None, "x"), ("words " * 20000, "de", "s0"), ("ß ẞ K", "de", None)]
    odd += [("same Same SAME", "de", f"s{n % 3}") for n in range(40)] + [("tie tue", "de", "s1")] * 30
    assert found(spark, odd) == sorted(brute(odd))


def test_empty_table(spark):
    assert found(spark, []) == []


def test_clashing_names(spark, clash):
    table = spark.createDataFrame([(n, *r) for n, r in enumerate(rows())], SCHEMA)
    more = clash(table).withColumns({c: table["doc_id"] for c in ("term", "n", "documents", "number", "block", "total")})
    assert sorted(map(tuple, divergence.source_divergence(more).collect())) == sorted(map(tuple, divergence.source_divergence(table).collect()))


def test_shares_are_exact_beyond_what_a_product_holds():
    total = np.array([9 * 10**14, 2**53 - 1, 7])[:, None]
    count = np.array([8 * 10**14 + 1, 2**53 - 1, 3])[:, None]
    assert divergence.shares(count, total).ravel().tolist() == [1 + 10**9 * c // t for c, t in zip(count.ravel().tolist(), total.ravel().tolist())]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, data, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    rows = QUERIES[name](spark, data).select(*names).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want.fetchall()))
