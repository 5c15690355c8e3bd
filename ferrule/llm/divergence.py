"""Source divergence audit: how far the wording of each source is from that of the others of its language, in exact integers.

Occurrences are counted by language, source and term; the kept terms of a language are dealt to blocks, and each block
is a dense matrix of groups by terms. A block gives a partial matrix of distances between all pairs of groups and a heap of terms for each group;
partial matrices are summed and heaps merged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.common import cut

#: Documents of its language that a term must occur in, what is added to each count, the whole of a distribution, and terms reported for each group.
LEAST_DOCUMENTS, SMOOTHING, UNIT, MOST_TERMS = 30, 5, 1_000_000_000, 50
#: Cells of a block, groups times terms, and bytes of texts that are counted at a time.
BLOCK_CELLS, BATCH_BYTES = 1 << 16, 16 << 20
#: Cells of what is broadcast at a time within a block.
PAIR_CELLS = 1 << 22

COUNTED = "lang string, source string, term string, n long, documents long"
TILES = "lang string, part string, a int, b int, item string, value long"

#: Bytes of terms in lower case; all others become spaces. Bytes from 128 on are parts of characters that terms have whole.
_FOLDED = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _folded(texts):
    """An Arrow array of texts without nulls, with terms in lower case and spaces between them; no length changes."""
    import pyarrow as pa

    _, offsets, data = texts.buffers()
    folded = pa.py_buffer((data.to_pybytes() if data else b"").translate(_FOLDED))
    return pa.LargeStringArray.from_buffers(len(texts), offsets, folded, offset=texts.offset)


def _counted(texts, langs: np.ndarray, sources: np.ndarray):
    """A batch of (lang, source, term, n, documents) of folded texts."""
    import pandas as pd
    import pyarrow as pa
    import pyarrow.compute as pc

    words = pc.split_pattern(texts, " ")
    row = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    coded = words.flatten().dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy()
    full = code != pc.index(terms, "").as_py()
    width, (group, groups) = max(1, len(terms)), pd.factorize(pd.MultiIndex.from_arrays([langs, sources]))
    pair, n = np.unique(row[full] * width + code[full], return_counts=True)
    cell = group[pair // width] * width + pair % width
    order = np.argsort(cell, kind="stable")
    cell, n = cell[order], n[order]
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    at, term = np.divmod(cell[first], width)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(groups.get_level_values(0).to_numpy()[at], pa.string()), pa.array(groups.get_level_values(1).to_numpy()[at], pa.string()),
            terms.take(pa.array(term)).cast(pa.string()), pa.array(np.add.reduceat(n, first) if len(first) else n, pa.int64()),
            pa.array(np.diff(first, append=len(cell)), pa.int64()),
        ],
        names=["lang", "source", "term", "n", "documents"],
    )


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, documents): occurrences of each term, and rows it occurs in, by language and source.

    Terms are runs of letters A to Z and of characters outside ASCII, A-Z lower-cased. Null texts, languages and sources count as ''. Rows are counted
    by the batch before the shuffle, so a source or a term that all rows share leaves a row for each batch.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            texts = _folded(batch.column("text").cast(pa.large_string()))
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            langs, sources = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "source"))
            at = 0
            while at < len(texts):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES)))
                yield _counted(texts.slice(at, upto - at), langs[at:upto], sources[at:upto])
                at = upto

    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))
    # dealt by language and term, so that what follows by source, and by language alone, needs no other shuffle
    dealt = rows.mapInArrow(run, COUNTED).repartition("lang", "term")
    return dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * count / total) for 0 <= count <= total < 2**53, in three steps of a thousand each, so that no product overflows."""
    out, rest = np.zeros(np.broadcast_shapes(count.shape, total.shape), np.int64), count
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, np.maximum(total, 1))
        out = out * 1000 + digit
    return 1 + out


def _tile(cells, groups, whole: str):
    """The partial results of one block: cells (term, of, n) and groups (number, total, terms), of which the one numbered -1 is the language."""
    import pandas as pd

    groups = groups.sort_values("number", ignore_index=True)  # the language comes first
    terms = np.array(sorted(set(cells["term"]), key=str.encode), object)
    place = {t: i for i, t in enumerate(terms)}
    count = np.zeros((len(groups), len(terms)), np.int64)
    at = cells["term"].map(place).to_numpy(np.int64)
    np.add.at(count, (cells["of"].to_numpy(np.int64) + 1, at), cells["n"].to_numpy(np.int64))
    count[0] = count[1:].sum(axis=0)
    total = (groups["total"] + SMOOTHING * groups["terms"]).to_numpy(np.int64)[:, None]
    p = shares(count + SMOOTHING, total)
    sources, size = p[1:], len(groups) - 1
    step = max(1, PAIR_CELLS // max(1, p.size))
    for start in range(0, size, step):
        apart = np.abs(sources[start : start + step, None, :] - sources[None, :, :]).sum(axis=2)
        a, b = np.indices(apart.shape)
        other = (a + start).ravel() != b.ravel()
        yield pd.DataFrame({"lang": whole, "part": "pair", "a": (a.ravel() + start)[other], "b": b.ravel()[other], "item": None, "value": apart.ravel()[other]})
    for g in range(size):
        over = np.where(count[g + 1] > 0, p[g + 1] - p[0], 0)
        top = np.lexsort((np.arange(len(terms)), -over))[:MOST_TERMS]  # terms are in order of their bytes
        top = top[over[top] > 0]
        yield pd.DataFrame({"lang": whole, "part": "term", "a": g, "b": -1, "item": terms[top], "value": over[top]})


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language, its distance from each other source (part pair) and the terms that
    it uses more than its language does (part term), farthest first, items of one value by their bytes, ranks from 1.

    A language keeps terms that LEAST_DOCUMENTS of its rows have. A term's share of a group is 1 + floor(UNIT * (count + SMOOTHING) / (total + SMOOTHING * kept terms)).
    A pair's value sums what shares differ by over all kept terms; a term's is the source's share less the language's, only positive ones of terms that the source
    has, MOST_TERMS at most. A source without terms has pairs; a language of a single source has none; without kept terms pairs have value 0. Nulls count
    as ''. An empty table gives no rows. Repeated rows count as often as they come. Only the columns named are read.

    All groups of a language meet in a block, whose terms are so few that groups times terms stay within BLOCK_CELLS; a language's block
    gives one value for each pair of its groups, which the result has too.
    """
    counts = term_counts(docs, text, lang, source).withColumn("held", F.sum("documents").over(Window.partitionBy("lang", "term")))
    cells = cut(counts.where(F.col("held") >= LEAST_DOCUMENTS).select("lang", "source", "term", "n"))
    found = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = cut(found.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), numbered.alias("number")))
    terms = cells.groupBy("lang").agg(F.countDistinct("term").alias("terms"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.count("*").alias("sources")).join(terms, "lang", "left")
    # ceil(terms / terms that fit a block), 1 for a language without terms, which still has pairs
    room = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_CELLS) / (F.col("sources") + 1)))
    langs = cut(langs.select("lang", "total", F.coalesce("terms", F.lit(0)).alias("terms"), F.greatest(F.lit(1), F.ceil(F.coalesce("terms", F.lit(0)) / room)).cast("int").alias("blocks")))
    every = groups.select("lang", "number", "total").unionByName(langs.select("lang", F.lit(-1).alias("number"), "total"))
    every = every.join(langs.select("lang", "terms", "blocks"), "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    cells = cells.join(groups.select("lang", "source", F.col("number").alias("of")), ["lang", "source"]).join(langs.select("lang", "blocks"), "lang")
    cells = cells.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "term", "of", "n")

    def tile(key, cells, groups):
        import pandas as pd

        return pd.concat(_tile(cells, groups, key[0]), ignore_index=True)

    tiles = cut(cells.groupBy("lang", "block").cogroup(every.groupBy("lang", "block")).applyInPandas(tile, TILES))
    pairs = tiles.where("part = 'pair'").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    name = lambda number, alias: groups.select("lang", F.col("number").alias(number), F.col("source").alias(alias))
    pairs = pairs.join(name("b", "item"), ["lang", "b"]).select("lang", "a", F.lit("pair").alias("part"), "item", "value")
    both = pairs.unionByName(tiles.where("part = 'term'").select("lang", "a", "part", "item", "value"))
    order = Window.partitionBy("lang", "a", "part").orderBy(F.col("value").desc(), "item")
    ranked = both.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= MOST_TERMS))
    return ranked.join(name("a", "source"), ["lang", "a"]).select("lang", "source", "part", "item", "value", "rank")
