"""Secrets: fixed formats, and further candidates judged by how many owners of the corpus share them. All in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import cut, join_groups
from ferrule.llm.spans import clear_of, described, located

#: Fixed formats, in the order of their kinds. Runs that are too short to count are not matched at all, as a shorter run within one is
#: shorter still; the value of an assignment is checked after the match, as a short one hides what follows it.
BASE = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]++",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
#: The value of an assignment, and its least length.
VALUE, LEAST_VALUE = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)$", 6
#: Generators of further candidates: prefixed keys of services, bearer values, passwords in URLs, signed tokens, private keys, mixed runs.
PROPOSED = {
    "service_key": r"(?<![A-Za-z0-9_-])(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|rk_live_|sk-|npm_|AIza)[A-Za-z0-9_-]{16,}+",
    "bearer": r"(?<![A-Za-z])[Bb]earer\x20[A-Za-z0-9._~+/=-]{16,}+",
    "url_password": r"(?<=://)[A-Za-z0-9._-]{1,64}:[^\s/@:]{4,128}(?=@)",
    "signed_token": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}+-----END [A-Z ]{0,20}PRIVATE KEY-----",
    "mixed": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+",
}
#: Shares of a value's repositories that its largest owner has: from the first on it is that owner's own, below the second a copied example.
OWN_SHARE, COPIED_SHARE = 0.75, 0.5
#: Words of values that are placeholders.
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]?|x{6}|0{8}|123456|abcdef|\*{4}"


def _live(value: Column) -> Column:
    """Whether a value looks live: lower-case or upper-case letters with digits, many distinct characters, no placeholder."""
    kinds = value.rlike("[a-z]").cast("int") + value.rlike("[A-Z]").cast("int") + value.rlike("[0-9]").cast("int")
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (kinds >= 2) & value.rlike("[0-9]") & (distinct >= 10) & ~value.rlike(PLACEHOLDER)


def propose(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _base, spans of fixed formats by start, then kind, and _more, further candidates that lie within none of these, each with
    the hash of its value and whether that looks live. The value of an assignment is what is assigned. Null counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    cheap = {
        "assign": whole.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]"), "access": whole.contains("AKIA"),
        "bearer": whole.contains("earer "), "url_password": whole.contains("://"), "signed_token": whole.contains("eyJ"), "private_key": whole.contains("PRIVATE KEY-----"),
    }
    value = lambda kind, m: F.regexp_extract(m["match"], VALUE, 1) if kind == "assign" else m["match"]
    judged = lambda kind, m: (F.sha2(value(kind, m), 256).alias("hash"), _live(value(kind, m)).alias("live"))
    bare = lambda kind, n: lambda m: F.struct(m["start"].alias("start"), F.lit(n).alias("order"), F.lit(kind).alias("kind"), m["end"].alias("end"), *judged(kind, m))
    base = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        met = located(whole, pattern)
        if kind == "assign":
            met = F.filter(met, lambda m: F.length(F.regexp_extract(m["match"], VALUE, 1)) >= LEAST_VALUE)
        spans = F.transform(met, bare(kind, n))
        none = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint,hash:string,live:boolean>>")
        base.append(F.when(cheap[kind], spans).otherwise(none) if kind in cheap else spans)
    rows = docs.withColumn("_base", F.array_sort(F.concat(*base)))
    further = lambda kind: lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), *judged(kind, m))
    more = []
    for kind, pattern in PROPOSED.items():
        none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,hash:string,live:boolean>>")
        spans = F.transform(located(whole, pattern), further(kind))
        more.append(F.when(cheap[kind], spans).otherwise(none) if kind in cheap else spans)
    return rows.withColumn("_more", F.concat(*more)).withColumn("_more", clear_of(F.col("_more"), F.col("_base"), within=True))


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, rows, repositories, owners, largest, verdict) of each candidate hash, counted over the whole corpus.

    largest is the most repositories with it that one owner has. verdict: own if that is at least OWN_SHARE of its repositories,
    copied if it is less than COPIED_SHARE, so that no owner has half of them, else shared. Shares hold at any size of the
    corpus: a live key in all hundred repositories of one owner stays its own, and an example in three owners is copied. Rows are first counted by hash,
    repository and owner, before the shuffle, so a secret that a third of all rows carry leaves a few rows.
    """
    once = candidates.groupBy("hash", "repository", "owner").agg(F.count("*").alias("rows"))
    owners = once.groupBy("hash", "owner").agg(F.sum("rows").alias("rows"), F.count("*").alias("repositories"))
    found = owners.groupBy("hash").agg(
        F.sum("rows").alias("rows"), F.sum("repositories").alias("repositories"), F.count("*").alias("owners"), F.max("repositories").alias("largest")
    )
    share = F.col("largest") / F.col("repositories")
    return found.withColumn("verdict", F.when(share >= OWN_SHARE, "own").when(share < COPIED_SHARE, "copied").otherwise("shared"))


def find_secrets(docs: DataFrame, repository: Column, owner: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_own, n_copied, verdicts.

    Spans are kind:start:end in code points, end exclusive, comma-joined; those of the fixed formats come by start, then
    kind, and base_sha256 and n_assign to n_hex are of these alone. Then come further candidates that look live and are one
    owner's own, likewise ordered. Ownership is judged for both: n_own counts those that look live and are one owner's own,
    n_copied those that are copied examples, and verdicts has kind:start:end:verdict of each. Null texts
    count as empty; null repositories and owners as one of each. Repeated rows come back repeated; an empty
    table gives none. Only the columns named are read.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"), F.col(text).alias("text"), F.coalesce(repository, F.lit("")).alias("repository"),
        F.coalesce(owner, F.lit("")).alias("owner"), F.monotonically_increasing_id().alias("row"),
    )
    found = cut(propose(rows).drop("text"))
    fixed = F.transform("_base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"), b["hash"].alias("hash"), b["live"].alias("live"), F.lit(True).alias("fixed")))
    more = F.transform("_more", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["hash"].alias("hash"), c["live"].alias("live"), F.lit(False).alias("fixed")))
    each = found.select("row", "repository", "owner", F.explode(F.concat(fixed, more)).alias("c")).select("row", "repository", "owner", "c.*")
    judged = join_groups(each, cut(ownership(each)), "hash", "rows")
    span = F.struct("start", "kind", "end")
    taken = F.col("live") & (F.col("verdict") == "own")
    extra = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(taken & ~F.col("fixed"), span))).alias("extra"), F.count_if(taken).alias("n_own"),
        F.count_if(F.col("verdict") == "copied").alias("n_copied"), F.array_sort(F.collect_list(F.struct("start", "kind", "end", "verdict"))).alias("verdicts"),
    )
    kinds = "array<struct<start:bigint,kind:string,end:bigint>>"
    out = found.join(extra, "row", "left").withColumn("extra", F.coalesce("extra", F.array().cast(kinds)))
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base, more = described(F.col("_base")), described(F.col("extra"))
    return out.select(
        "doc_id", *(count(k) for k in BASE), F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.filter(F.array(base, more), lambda x: x != ""), ",").alias("spans"),
        F.coalesce("n_own", F.lit(0)).alias("n_own"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce(F.array_join(F.transform("verdicts", lambda v: F.concat_ws(":", v["kind"], v["start"].cast("string"), v["end"].cast("string"), v["verdict"])), ","), F.lit("")).alias("verdicts"),
    )
