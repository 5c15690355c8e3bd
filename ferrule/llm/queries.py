"""The queries of the corpus operators, with production parameters, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.byte_bpe import token_digests
from ferrule.llm.common import read_table
from ferrule.llm.divergence import LEAST_DOCUMENTS, MOST_TERMS, SMOOTHING, UNIT, source_divergence
from ferrule.llm.exact_dedup import exact_groups
from ferrule.llm.flac import media_column, media_facts
from ferrule.llm.packing import pack_documents
from ferrule.llm.pieces import piece_digests
from ferrule.llm.pii import find_pii
from ferrule.llm.quality import score_quality
from ferrule.llm.repair import audit_conversations, damaged
from ferrule.llm.secret_scan import find_secrets
from ferrule.llm.sharding import extendible_shards
from ferrule.llm.simhash import near_groups
from ferrule.llm.url_filter import judge_urls

#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_table(spark, sf_dir, "documents")).drop("fp")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(read_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of a document is its owner; each language of a source stands for a repository."""
    docs = read_table(spark, sf_dir, "documents")
    return find_secrets(docs, F.concat_ws("/", "source", "lang"), F.col("source"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read_table(spark, sf_dir, "documents"))


def op10_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_facts(media_column(read_table(spark, sf_dir, "documents")))


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(read_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    return audit_conversations(damaged(conversations), conversations)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_simhash, op3_sharding, op4_exact_dedup, op5_pii,
        op6_packing, op7_quality, op8_secret_scan, op9_byte_bpe, op10_flac, op11_piece_bpe,
        op12_conversation_repair, op13_source_divergence,
    )
}

ORACLE_SQL = {
    "op3_sharding": f"""
        with rows as (
            select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes,
                ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
            from documents
        ), deep as (
            select doc_id, n_bytes, d::int as depth, h >> (60 - d) as prefix
            from rows, generate_series(0, 60) as s(d)
        ), sums as (
            select depth, prefix, sum(n_bytes)::bigint as shard_bytes from deep group by all
        )
        select doc_id, n_bytes, depth, prefix, 0 as part, shard_bytes, shard_bytes > {SHARD_BYTES} as oversized
        from deep join sums using (depth, prefix)
        where shard_bytes <= {SHARD_BYTES}
        qualify row_number() over (partition by doc_id order by depth) = 1
    """,
    "op4_exact_dedup": """
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
            doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
        from documents window same as (partition by coalesce(text, ''))
    """,
    "op13_source_divergence": rf"""
        with docs as (
            select row_number() over () as row, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents
        ), words as (
            select row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from docs
        ), kept as (
            select lang, term from words group by all having count(distinct row) >= {LEAST_DOCUMENTS}
        ), groups as (select distinct lang, source from docs), cells as (
            select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by all
        ), grid as (
            select g.lang, g.source, k.term, coalesce(c.n, 0)::hugeint as n
            from groups g join kept k using (lang) left join cells c on c.lang = g.lang and c.source = g.source and c.term = k.term
        ), whole as (select lang, term, sum(n)::hugeint as n from grid group by all), shares as (
            select *, 1 + {UNIT} * (n + {SMOOTHING}) // (sum(n) over (partition by lang, source) + {SMOOTHING} * count(*) over (partition by lang, source)) as p from grid
        ), of_lang as (
            select lang, term, 1 + {UNIT} * (n + {SMOOTHING}) // (sum(n) over (partition by lang) + {SMOOTHING} * count(*) over (partition by lang)) as q from whole
        ), pairs as (
            select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum(abs(s.p - t.p)), 0)::bigint as value
            from groups a join groups b on a.lang = b.lang and a.source <> b.source
            left join shares s on s.lang = a.lang and s.source = a.source left join shares t on t.lang = b.lang and t.source = b.source and t.term = s.term
            group by all
        ), terms as (
            select lang, source, 'term' as part, term as item, (p - q)::bigint as value from shares join of_lang using (lang, term) where n > 0 and p > q
        ), ranked as (
            select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (from pairs union all from terms)
        )
        select * from ranked where part = 'pair' or rank <= {MOST_TERMS}
    """,
}
