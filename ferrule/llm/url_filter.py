"""URL verdicts: fixed rules first, then trust and distrust propagated over a graph of hosts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import HOT_SHARE, cut, join_groups


@dataclass(frozen=True)
class Rule:
    """A host, with all its subdomains, and the start of a path that begins with a slash."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
#: PageRank's damping, the sweeps of a block between two tests of its growth, and the share of a host's trust and distrust from which it is blocked.
DAMPING, ROUNDS, BLOCK_FROM = 0.85, 10, 0.5
#: Share of itself to which a rank is known.
TOLERANCE = 1e-6
#: Edges of a block of hosts that one task sweeps; there are as many blocks as it takes.
BLOCK_EDGES = 250_000
#: Parts into which the links of a hub are dealt.
SALTS = 64
#: Ranks of up to so many hosts are sent to the links between blocks; those of more meet these in a shuffle.
BROADCAST_HOSTS = 100_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or where there is no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """(name, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): a host's absolute and protocol-relative links to other hosts, counted, and a link of weight 1 either way between a host
    and its parent domain, through which subdomains of one owner are joined. pages: columns host and html."""
    target = r"""(?i)(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"'<>]+)"""
    linked = (
        pages.where(F.col("html").contains("//"))
        .select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(target), F.lit(1))).alias("to"))
        .select("src", host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))).alias("dst"))
        .where("src <> dst and src <> '' and dst <> ''")
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("weight"))
    )
    hosts = pages.select("host").unionByName(linked.select(F.col("dst").alias("host"))).where("host <> ''").distinct()
    label = F.split("host", r"\.")
    up = hosts.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(label) - 1, F.lit(1))), lambda i: F.array_join(F.slice(label, i, F.size(label)), "."))).alias("src"))
    up = up.where(F.instr("src", ".") > 0).distinct()
    parent = up.select("src", F.regexp_extract("src", r"^[^.]*\.(.*)$", 1).alias("dst")).where(F.instr("dst", ".") > 0)
    tied = parent.unionByName(parent.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))
    return linked.unionByName(tied).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def blocks_of(share: DataFrame, block_edges: int, broadcast_rows: int = BROADCAST_HOSTS) -> tuple[DataFrame, DataFrame]:
    """(inner, outer) of share, columns src, dst and share: inner edges join hosts of one block, outer ones all others.

    A block holds whole domains, by the last two labels of a host, as most links of the web stay in their domain; a domain
    of over block_edges links, of which there are at most as many as blocks, is dealt to blocks by host, so that a hot one fills no
    task. Any cut is right: it only decides how many rounds there are. inner: block, src, dst, share; outer: src, dst, share.
    """
    domain = lambda c: F.regexp_extract(c, r"([^.]*\.)?[^.]*$", 0)
    blocks = share.count() // block_edges + 1
    dealt = lambda key: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    large = share.where(domain("src") == domain("dst")).groupBy(domain("src").alias("domain")).agg(F.count("*").alias("n"))
    large = cut(large.where(F.col("n") > block_edges).select("domain"))
    large = F.broadcast(large) if large.count() <= broadcast_rows else large
    for end in ("src", "dst"):
        share = share.withColumn("domain", domain(end)).join(large.withColumn("large", F.lit(True)), "domain", "left")
        share = share.withColumn(f"{end}_block", F.when(F.col("large"), dealt(end)).otherwise(dealt("domain"))).drop("domain", "large")
    share = cut(share)
    inner = share.where("src_block = dst_block").select(F.col("src_block").alias("block"), "src", "dst", "share")
    return inner, share.where("src_block <> dst_block").select("src", "dst", "share")


def settle(damping: float, growth: float):
    """A function over the inner edges and the hosts of one block, which gives these with ranks that agree, to within growth, with
    their restarts, what moved in from other blocks and the block's own edges; ranks start where they were and only grow."""

    def run(key, edges, hosts):
        import numpy as np
        import pandas as pd

        hosts = hosts.groupby("host", as_index=False, sort=True)[["restart", "moved", "rank"]].sum()
        at, base, rank = pd.Index(hosts["host"]), (hosts["restart"] + hosts["moved"]).to_numpy(), hosts["rank"].to_numpy()
        edges = edges.sort_values(["dst", "src"])
        src, dst, flow = at.get_indexer(edges["src"]), at.get_indexer(edges["dst"]), damping * edges["share"].to_numpy()
        while True:
            last = rank
            for _ in range(ROUNDS):
                rank = base + np.bincount(dst, weights=rank[src] * flow, minlength=len(at))
            if not (rank - last > growth * rank).any():
                return hosts.assign(block=key[0], rank=rank)[["host", "block", "restart", "rank"]]

    return run


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, broadcast_hosts: int = BROADCAST_HOSTS, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(host, rank): PageRank that restarts at the seeds, columns host and mass, by their mass.

    Rank of a host without outgoing edges is dropped rather than spread, so no round needs a global
    sum. Hosts are cut into blocks of some block_edges edges, whatever their number. A round moves rank along the edges between blocks, summed per
    target before the next, then each block sweeps its own edges until they agree (block Jacobi), so that the number of rounds depends on
    the links between blocks alone and there is one round where there are none.
    Ranks of at most broadcast_hosts hosts are broadcast to the edges between blocks; more meet them in a shuffle. Hubs, hosts with over one
    in HOT_SHARE of all outgoing edges and so fewer than HOT_SHARE, have their edges dealt to SALTS parts, each of which gets their rank.
    Ranks begin at nothing, so they only grow, each towards its limit. What is still to come is about damping / (1 - damping) times the
    growth of a round, so rounds go on until no rank grew by tolerance * (1 - damping)² of itself; a host first reached
    counts as grown: every host that a seed reaches has a rank, however far it is.
    """
    start, growth = cut(seeds.where("mass > 0")), tolerance * (1 - damping) ** 2
    out = cut(edges.groupBy("src").agg(F.sum("weight").alias("all"), F.count("*").alias("n")))
    share = cut(join_groups(edges, out, "src", "n").select("src", "dst", (F.col("weight") / F.col("all")).alias("share")))
    total = out.agg(F.sum("n").alias("n")).first()["n"] or 0
    inner, outer = blocks_of(share, block_edges)
    inner = cut(inner.repartition("block"))
    homes = inner.select(F.col("dst").alias("host"), "block").unionByName(inner.select(F.col("src").alias("host"), "block")).distinct()
    ends = share.select(F.col("src").alias("host")).unionByName(share.select(F.col("dst").alias("host"))).unionByName(start.select("host")).distinct()
    hubs = cut(out.where(F.col("n") * HOT_SHARE > total).select("src", F.sequence(F.lit(0), F.lit(SALTS - 1)).alias("salts")))
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.hash("dst"), F.lit(SALTS)))
    outer = cut(outer.join(F.broadcast(hubs), "src", "left").select("src", "dst", "share", salt.alias("salt")))
    restart = start.select("host", (F.col("mass") * (1 - damping)).alias("restart"))
    state = ends.join(homes, "host", "left").join(restart, "host", "left")
    state = cut(state.select("host", "block", F.coalesce("restart", F.lit(0.0)).alias("restart"), F.lit(0.0).alias("rank")))
    home = state.select("host", "block")
    few, alone, run = state.count() <= broadcast_hosts, outer.isEmpty(), settle(damping, growth)
    while True:
        rank = state.where("rank > 0").select(F.col("host").alias("src"), "rank")
        if few:
            met = outer.join(F.broadcast(rank), "src")
        else:
            dealt = rank.join(F.broadcast(hubs), "src", "left").select("src", "rank", F.explode(F.coalesce("salts", F.array(F.lit(0)))).alias("salt"))
            met = outer.join(dealt, ["src", "salt"])
        moved = met.groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share") * damping).alias("moved"))
        moved = moved.join(F.broadcast(home) if few else home, "host").select("block", "host", F.lit(0.0).alias("restart"), "moved", F.lit(0.0).alias("rank"))
        hosts = state.select("block", "host", "restart", F.lit(0.0).alias("moved"), "rank").unionByName(moved)
        found = inner.groupBy("block").cogroup(hosts.where("block is not null").groupBy("block")).applyInPandas(run, "host string, block int, restart double, rank double")
        # A host without an edge in a block has nothing to sweep.
        still = hosts.where("block is null").groupBy("host").agg(F.lit(None).cast("int").alias("block"), F.sum("restart").alias("restart"), F.sum(F.col("restart") + F.col("moved")).alias("rank"))
        last, state = state.select("host", F.col("rank").alias("last")), cut(found.unionByName(still))
        if alone:
            break
        grown = F.when(F.col("rank") > 0, (F.col("rank") - F.col("last")) / F.col("rank"))
        if (state.join(last, "host").agg(F.max(grown).alias("most")).first()["most"] or 0.0) <= growth:
            break
    return state.where("rank > 0").select("host", "rank")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of pages: key, host, path, rule, verdict, trust, distrust.

    A rule that fits decides. Else trust flows from hosts in proportion to their pages that rules allow,
    along edges; distrust from those with blocked pages, against edges. Both are personalised PageRank
    and sum to at most 1 over all hosts. A host whose distrust makes up BLOCK_FROM or more of both is
    blocked, any other, and one that neither reaches, allowed. Null urls, and such without ://, have an
    empty host and path and are allowed; null html has no links. Repeated rows come back repeated.
    """
    judged = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    judged = judged.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    seeds = judged.where("host <> ''").groupBy("host").agg(
        F.count_if(F.col("fit.verdict") == "allow").cast("double").alias("trusted"),
        F.count_if(F.col("fit.verdict") == "block").cast("double").alias("blocked"),
        F.count("*").alias("pages"),
    )
    seeds = cut(seeds)
    edges = cut(host_edges(pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))))
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    # Trust runs over hosts marked +, distrust over those marked -, so that both share the rounds.
    marked = lambda mark, *names: [F.concat(F.lit(mark), n).alias(n) for n in names]
    all_mass = seeds.agg(F.sum("trusted").alias("trusted"), F.sum("blocked").alias("blocked")).first()
    mass = lambda name: (F.col(name) / F.lit(all_mass[name] or 1.0)).alias("mass")
    ranks = personalised_rank(
        edges.select(*marked("+", "src", "dst"), "weight").unionByName(reverse.select(*marked("-", "src", "dst"), "weight")),
        seeds.select(*marked("+", "host"), mass("trusted")).unionByName(seeds.select(*marked("-", "host"), mass("blocked"))),
    )
    trust, distrust = (ranks.where(F.col("host").startswith(m)).select(F.expr("substr(host, 2)").alias("host"), "rank") for m in "+-")
    both = seeds.select("host", "pages")
    both = both.join(trust.withColumnRenamed("rank", "trust"), "host", "left").join(distrust.withColumnRenamed("rank", "distrust"), "host", "left")
    both = both.select("host", "pages", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    none = judged.where("host = ''").select("page_id", "host", "path", "fit", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"))
    scored = join_groups(judged.where("host <> ''"), cut(both), "host", "pages").drop("pages").unionByName(none)
    bad = (F.col("distrust") > 0) & (F.col("distrust") >= BLOCK_FROM * (F.col("trust") + F.col("distrust")))
    verdict = F.coalesce("fit.verdict", F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", F.col("fit.name").alias("rule"), verdict.alias("verdict"), "trust", "distrust")
