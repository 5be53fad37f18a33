"""Registered queries of the package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelspring.llm import (
    arrow_tokens,
    conversation_trie,
    decontaminate,
    digest_index,
    line_diff,
    packing,
    phrase_filters,
    pii_spans,
    prefix_tokens,
    setsketch,
    substrings,
    toxicity,
    warc_chunks,
)
from labelspring.llm.common import documents

def op1_cumulative_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document by a model fitted on the labels."""
    docs = documents(spark, sf_dir)
    return toxicity.scores(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact deduplication of all documents through a fresh digest index."""
    return digest_index.decisions(documents(spark, sf_dir))


def op3_induced_sorting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 400-byte strings cut out of all documents."""
    return substrings.remove_repeated(documents(spark, sf_dir)).drop("kept")


def op4_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, similarity 0.85."""
    return setsketch.near_duplicates(documents(spark, sf_dir), size=3, percent=85).drop("text_hash")


def op5_local_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.packed(documents(spark, sf_dir))


def op6_arrow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to Arrow files and read back."""
    return arrow_tokens.round_trip(documents(spark, sf_dir), spark)


def op7_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii_spans.personal_data(documents(spark, sf_dir))


def op8_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return prefix_tokens.token_counts(documents(spark, sf_dir))


def op9_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that earlier documents hold, removed from all documents."""
    return line_diff.deduplicated(documents(spark, sf_dir)).drop("text")


def op10_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(documents(spark, sf_dir), benchmark).drop("text_hash")


def op11_chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    return warc_chunks.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_quotient_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of each language of all documents."""
    return phrase_filters.phrases_by_score(documents(spark, sf_dir))


def op13_recursive_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations."""
    return conversation_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_cumulative_link, op2_digest_index, op3_induced_sorting, op4_setsketch, op5_local_search, op6_arrow_files,
        op7_semi_markov, op8_prefix_counts, op9_patience, op10_prefix_join, op11_chunk_records,
        op12_quotient_filters, op13_recursive_trie,
    )
}

SQL = {
    "op2_digest_index": r"""
        with d as (
            select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
            from documents
        )
        select doc_id, min(doc_id) over (partition by text_sha256) as keep_id,
               count(*) over (partition by text_sha256) as group_size,
               doc_id = min(doc_id) over (partition by text_sha256) as kept, text_sha256
        from d
    """,
    "op10_prefix_join": r"""
        with dw as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
        ), bw as (
            select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
        ), b as (
            select distinct item_id, len, array_to_string(w[s : s + len - 1], ' ') as win
            from (select item_id, w, least(10, len(w)) as len, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s
                  from bw where len(w) > 0)
        ), lens as (select distinct len from b), p as (
            select doc_id, lens.len as len, w, unnest(range(1, len(w) - lens.len + 2)) as s
            from dw, lens where len(w) >= lens.len
        ), m as (
            select doc_id, p.len as len, s, item_id from p join b on p.len = b.len and array_to_string(w[s : s + p.len - 1], ' ') = b.win
        ), hit as (
            select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(s, s + len)) as pos from m) group by doc_id
        ), it as (
            select doc_id, count(distinct item_id) as n_items,
                   sha256(string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar))) as items_sha256
            from m group by doc_id
        )
        select dw.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               coalesce(items_sha256, sha256('')) as items_sha256, n_hit is not null as contaminated
        from dw left join hit using (doc_id) left join it using (doc_id)
    """,
    "op11_chunk_records": r"""
        with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages), g as (
            select *, max(page_id) over (partition by html) as top from p
        )
        select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 +
                   ((cast('0x' || substr(h, cast(1 + 5 * (i // 4) as bigint), 5) as bigint) >> (15 - 5 * (i % 4))) & 31) as bigint), 1)), '')
                   as payload_digest,
               case when page_id = top then 'response' else 'revisit' end as record_type,
               case when page_id <> top then top end as refers_to,
               greatest(1, cast(ceil(octet_length(encode(html)) / 65536.0) as bigint)) as n_chunks
        from g
    """,
    "op12_quotient_filters": r"""
        with piece as (
            select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents
        ), w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from piece), n as (
            select lang, cast(sum(len(w)) as bigint) as n from w group by lang having sum(len(w)) > 0
        ), g as (
            select lang, w[s : s + m - 1] as p, count(*) as f
            from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as s from w, (values (1), (2), (3), (4)) v(m) where len(w) >= m)
            group by all having count(*) >= 30
        ), c as (select lang, p, f as a from g where len(p) > 1), cut as (
            select c.lang, c.p, a, k, x.f as l, y.f as r, cast(2000000 * cast(a as hugeint) // (x.f + y.f) as bigint) as score
            from (select *, unnest(range(1, len(p))) as k from c) c
            join g x on x.lang = c.lang and x.p = c.p[1 : k] join g y on y.lang = c.lang and y.p = c.p[k + 1 :]
        ), best as (
            select lang, p, a, min_by(l, (score, k)) as l, min_by(r, (score, k)) as r, min(score) as score from cut group by lang, p, a
        ), inner_p as (
            select lang, p[s : s + m - 1] as p, max(a) as longer
            from (select *, unnest(range(1, len(p) - m + 2)) as s from c, (values (2), (3)) v(m) where len(p) > m) group by all
        ), kept as (
            select best.* from best left join inner_p i on i.lang = best.lang and i.p = best.p
            where longer is null or 100 * longer < 80 * a
        ), placed as (
            select kept.lang, array_to_string(p, ' ') as phrase, a, l, r, n, score,
                   row_number() over (partition by kept.lang order by score desc, a desc, array_to_string(p, ' ')) as rank
            from kept join n on n.lang = kept.lang
        )
        select lang, rank, phrase, a, l, r, n, score from placed where rank <= 2000
    """,
    "op13_recursive_trie": r"""
        with t as (
            select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, length(coalesce(text, '')) as size,
                   row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''),
                       sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
            from conversations where conv_id is not null
        ), c as (
            -- CRC-32 of the decimal id, bit by bit
            select conv_id, count(*) as n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''),
                lambda s: unicode(s)::bigint)), lambda u, x: list_reduce(list_prepend(xor(u, x), list_value(0::bigint, 0::bigint,
                0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint)),
                lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::bigint) % 6 as h
            from t group by conv_id
        ), s as (
            select c.conv_id, 0 as part, t.pos, role, text, size from c join t on t.conv_id = c.conv_id - c.conv_id % 100 and t.pos <= h
            union all select conv_id, 1, pos, role, text, size from c join t using (conv_id) where pos > h
        ), seq as (
            select conv_id, row_number() over (partition by conv_id order by part, pos) as d, size,
                   sha256(length(role) || ':' || role || text) as sym from s
        ), pre as (
            select a.conv_id, a.d, any_value(a.size) as size, string_agg(b.sym, '' order by b.d) as prefix
            from seq a join seq b on b.conv_id = a.conv_id and b.d <= a.d group by a.conv_id, a.d
            union all select conv_id, 0, 0, '' from c
        ), node as (
            select prefix, d, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size from pre group by prefix, d
        ), last as (select conv_id, max(d) as d from pre group by conv_id), ends as (
            select prefix, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256
            from last join pre using (conv_id, d) group by prefix
        ), kids as (
            select prefix[: 64 * (d - 1)] as prefix, count(*) as n_children from node where d > 0 group by all
        ), own as (
            select node.*, coalesce(n_children, 0) as n_children from node left join kids using (prefix)
        ), up as (
            select prefix[: 64 * a] as prefix, cast(sum((n_children = 0)::bigint) as bigint) as n_leaves,
                   cast(sum((n_convs - 1) * size) as bigint) as saved_tokens
            from (select *, unnest(range(0, d + 1)) as a from own) group by all
        )
        select own.conv_id, own.d as depth, parent.conv_id as parent_conv_id, own.n_convs, n_children, n_leaves, saved_tokens,
               coalesce(ends_sha256, sha256('')) as ends_sha256
        from own join up using (prefix) left join ends using (prefix)
        left join node parent on own.d > 0 and parent.prefix = own.prefix[: 64 * (own.d - 1)]
    """,
}
