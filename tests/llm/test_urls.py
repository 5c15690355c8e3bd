"""URL verdicts against plain Python."""

import re
from collections import Counter, defaultdict

import pytest

from ferrule.llm import url_filter
from ferrule.llm.common import read_table
from ferrule.llm.queries import op1_url_filter

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fit = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fit, key=lambda r: len(r[0] + r[1]), default=None)


def plain_verdicts(rows):
    """(host, path, rule, verdict) of (url, html) rows."""
    cut = [parts(u) for u, _ in rows]
    fits = [rule(*c) for c in cut]
    edges = Counter()
    hosts = {h for h, _ in cut if h}
    for (host, _), (_, html) in zip(cut, rows):
        for to in re.findall(r"""(?i)(?:href|src)\s*=\s*["']?\s*([a-z][a-z0-9+.-]*://[^\s"'<>]+)""", html or ""):
            dst = parts(to)[0]
            if host and dst and dst != host:
                edges[host, dst] += 1
                hosts.add(dst)
    for h in list(hosts):
        while "." in h:
            up = h.split(".", 1)[1]
            if "." in up:
                for pair in ((h, up), (up, h)):
                    hosts.add(up)
                    edges[pair] += 0
            h = up
    tied = {(a, b) for a, b in edges if a.endswith("." + b) and a.split(".", 1)[1] == b}
    for a, b in tied:
        edges[a, b] += 1
        edges[b, a] += 1

    def rank(edges, seeds):
        total = sum(seeds.values())
        if not total:
            return {}
        start = {h: n / total for h, n in seeds.items() if n}
        out = defaultdict(float)
        for (a, _), w in edges.items():
            out[a] += w
        now = dict(start)
        for _ in range(url_filter.ROUNDS):
            new = defaultdict(float, {h: 0.15 * n for h, n in start.items()})
            for (a, b), w in edges.items():
                if w and a in now:
                    new[b] += 0.85 * now[a] * w / out[a]
            now = new
        return now

    trust = rank(edges, Counter(h for (h, _), f in zip(cut, fits) if f and f[2] == "allow"))
    distrust = rank({(b, a): w for (a, b), w in edges.items()}, Counter(h for (h, _), f in zip(cut, fits) if f and f[2] == "block"))
    out = []
    for (h, p), f in zip(cut, fits):
        t, d = trust.get(h, 0), distrust.get(h, 0)
        method = "block" if h and d > 0 and d >= 0.5 * (t + d) else "allow"
        out.append((h, p, f and f[0] + f[1], f[2] if f else method))
    return out


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/x", "http://example.net/en", "http://example.net/fr/1", "https://notexample.net?x=/en/",
    "http://a.example.com/de/1#t", "http://a.example.com/fr/1", "http://b.example.com/fr/1", "ftp://org/fr/", "http://x.org/fr/2?y", "http://x.org/de/2",
    "http://ÄB.org/fr/://z", "http://host?q=http://example.net/en/", "http://good.site/1", "http://bad.site/1",
]


def test_odd_urls(spark, clash):
    html = ['<a href="http://x.org/fr/">x</a>' if u and "good" in u else '<a HREF = \'http://a.example.com/de/9\'>' if u and "bad" in u else None for u in URLS]
    rows = [(i, u, h) for i, (u, h) in enumerate(zip(URLS, html))]
    rows.append(rows[4])
    found = url_filter.judge_urls(clash(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    want = plain_verdicts([(u, h) for _, u, h in rows])
    by = {i: w for (i, _, _), w in zip(rows, want)}
    assert len(found) == len(rows) and all((r.host, r.path, r.rule, r.verdict) == by[r.page_id] for r in found)
    assert {r.page_id: r.verdict for r in found}[17] == "block"


def test_whole_table(spark, data):
    pages = {r.page_id: (r.url, r.html) for r in read_table(spark, data, "pages").collect()}
    want = dict(zip(pages, plain_verdicts(list(pages.values()))))
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op1_url_filter(spark, data).collect()} == want


def test_no_pages(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("host", ["", "a", "a.b", "a.b.c.d"])
def test_edges_of_a_host(spark, host):
    pages = spark.createDataFrame([(host, None)], "host string, html string")
    up = host.split(".")
    want = {(".".join(up[i:]), ".".join(up[i + 1 :])) for i in range(len(up) - 2)}
    assert {(r.src, r.dst) for r in url_filter.host_edges(pages).collect()} == want | {(b, a) for a, b in want}
