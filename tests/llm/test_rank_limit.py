"""Trust and distrust at their limit, however far hosts are from a seed."""

from collections import defaultdict

import pytest

from ferrule.llm import url_filter


def limit(edges, seeds):
    """Plain PageRank with restarts, far beyond convergence."""
    total, out = sum(seeds.values()), defaultdict(float)
    for (a, _), w in edges.items():
        out[a] += w
    now = {}
    for _ in range(3000):
        new = defaultdict(float, {h: 0.15 * n / total for h, n in seeds.items()})
        for (a, b), w in edges.items():
            if a in now:
                new[b] += 0.85 * now[a] * w / out[a]
        now = new
    return now


@pytest.mark.parametrize("broadcast_hosts", [0, 100_000])
def test_rank_converges(spark, broadcast_hosts):
    chain = {(f"h{i}", f"h{i + 1}"): 1.0 for i in range(34)}
    star = {(a, b): 1.0 for i in range(5) for a, b in (("hub", f"s{i}"), (f"s{i}", "hub"))}
    edges, seeds = chain | star | {("s0", "h0"): 2.0}, {"hub": 3.0, "h2": 1.0}
    rank = url_filter.personalised_rank(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight double"), spark.createDataFrame([(h, n / 4) for h, n in seeds.items()], "host string, mass double"), broadcast_hosts=broadcast_hosts)
    got, want = {r.host: r["rank"] for r in rank.collect()}, limit(edges, seeds)
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) <= 1e-5 * want[h] for h in want)


def test_far_hosts_are_blocked(spark):
    pages = [(i, f"http://c{i}/", f'<a href="http://c{i + 1}/">' if i < 24 else '<a href="//bad.net/x">') for i in range(25)] + [(25, "http://bad.net/x", None)]
    rows = url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(rows) == 26 and all(r.verdict == "block" for r in rows)


@pytest.mark.parametrize("broadcast_hosts", [0, 100_000])
def test_blocks_agree(spark, broadcast_hosts):
    """Blocks of few edges, a domain that is dealt to several, links between domains, and hosts without links or block."""
    hub = {(a, b): 1.0 for i in range(6) for a, b in (("x.org", f"s{i}.x.org"), (f"s{i}.x.org", "x.org"))}
    far = {("s0.x.org", "a.net"): 2.0, ("a.net", "b.a.net"): 1.0, ("b.a.net", "a.net"): 1.0, ("b.a.net", "last.com"): 1.0}
    edges, seeds = hub | far, {"x.org": 3.0, "alone.de": 1.0}
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight double")
    share = frame.selectExpr("src", "dst", "1.0d as share")
    inner, outer = url_filter.blocks_of(share, 4)
    assert {(r.src, r.dst) for r in inner.unionByName(outer.selectExpr("0 as block", "*")).collect()} == edges.keys()
    assert inner.count() + outer.count() == len(edges) and inner.where("src like '%a.net'").count() >= 2 and outer.count() > 0
    rank = url_filter.personalised_rank(frame, spark.createDataFrame([(h, n / 4) for h, n in seeds.items()], "host string, mass double"), broadcast_hosts=broadcast_hosts, block_edges=4)
    got, want = {r.host: r["rank"] for r in rank.collect()}, limit(edges, seeds)
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) <= 1e-5 * want[h] for h in want)
