"""The registered query of each operator: production parameters over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roiscore.llm.common import read_table
from roiscore.llm.divergence import divergences
from roiscore.llm.jaccard import similar_documents
from roiscore.llm.neighbours import nearest
from roiscore.llm.packing import pack_documents
from roiscore.llm.pii import Policy, replace_entities
from roiscore.llm.pieces import encode_decode
from roiscore.llm.quality import quality
from roiscore.llm.repeats import remove_repeats
from roiscore.llm.secrets import find_secrets
from roiscore.llm.toxicity import fit, learnable, score_documents
from roiscore.llm.trie import prefix_trie, shared_openings
from roiscore.llm.warc import archive
from roiscore.llm.webpages import extract

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")

#: The key of the registered query; a real run brings its own.
SURROGATE_POLICY = Policy(b"roiscore registered query")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(read_table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels").where("quality = 1"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(read_table(spark, sf_dir, "documents"), SURROGATE_POLICY)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, read_table(spark, sf_dir, "labels").where(learnable())))
    return scored.select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read_table(spark, sf_dir, "documents"), F.col("source"))


def op7_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = archive(read_table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(read_table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(read_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(read_table(spark, sf_dir, "documents"), PIECE_TOKENIZER)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*shared_openings(read_table(spark, sf_dir, "conversations")))


def op13_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_quality": op2_quality,
    "op3_neighbours": op3_neighbours,
    "op4_surrogates": op4_surrogates,
    "op5_toxicity": op5_toxicity,
    "op6_secrets": op6_secrets,
    "op7_archives": op7_archives,
    "op8_jaccard": op8_jaccard,
    "op9_repeats": op9_repeats,
    "op10_pieces": op10_pieces,
    "op11_main_text": op11_main_text,
    "op12_prefixes": op12_prefixes,
    "op13_sources": op13_sources,
}
ORACLE_SQL: dict[str, str] = {
    "op7_archives": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        d as (select page_id, cast(strlen(html) as bigint) as payload_bytes, sha1(html) as payload_digest from p),
        r as (select *, max(case when payload_bytes >= 1000 then page_id end) over (partition by payload_digest) as first from d)
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 1000 and first <> page_id then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 1000 and first <> page_id then first end as refers_to
        from r
    """,
    "op8_jaccard": r"""
        with recursive t as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from t),
        n as (select doc_id, count(*) as n from s group by 1),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
        l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
        e as (select a, b from l union all select b, a from l),
        r as (select doc_id, doc_id as reached from documents union select r.doc_id, e.b from r join e on e.a = r.reached)
        select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.reached) as component_id
        from documents d join r using (doc_id) left join n using (doc_id) group by 1
    """,
    "op9_repeats": r"""
        with t as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
        w as (select doc_id, unnest(words) as word, unnest(range(len(words))) as pos from t),
        g as (select doc_id, pos, string_agg(word, ' ') over (partition by doc_id order by pos rows between current row and 19 following) as run,
                     count(*) over (partition by doc_id order by pos rows between current row and 19 following) as n from w),
        f as (select doc_id, pos, row_number() over (partition by run order by doc_id, pos) > 1 as late from g where n = 20),
        c as (select w.doc_id, w.pos, w.word,
                     coalesce(bool_or(f.late) over (partition by w.doc_id order by w.pos rows between 19 preceding and current row), false) as gone
              from w left join f using (doc_id, pos)),
        k as (select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed, coalesce(string_agg(word, ' ' order by pos) filter (where not gone), '') as kept from c group by doc_id)
        select t.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from t left join k using (doc_id)
    """,
    "op12_prefixes": r"""
        with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first) - 1 as pos, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
        c as (select conv_id, count(*) as n, conv_id - conv_id % 20 as base,
                     xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(conv_id as varchar), ''), lambda ch: cast(ord(ch) as bigint))),
                         lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 as h
              from t group by conv_id),
        l as (select c.*, least(h, coalesce(b.n, 0)) as opening from c left join (select conv_id as base, n from c) b using (base)),
        r as (select t.conv_id, pos - h + opening as pos, role, text from t join l using (conv_id) where pos >= h
              union all
              select l.conv_id, t.pos, role, text from l join t on t.conv_id = l.base where t.pos < l.opening),
        p as (select conv_id, pos + 1 as depth, md5(string_agg(md5(concat(length(role), ':', role, text)), ',') over (partition by conv_id order by pos)) as k,
                     len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from r
              union all select conv_id, 0, '', 0 from c),
        n as (select depth, k, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(words) as own from p group by 1, 2),
        u as (select n.depth, n.k, n.conv_id, p.k as up from n join p on p.conv_id = n.conv_id and p.depth = n.depth - 1),
        x as (select n.depth, n.k, count(u.k) as n_children from n left join u on u.depth = n.depth + 1 and u.up = n.k group by 1, 2),
        s as (select a.depth, a.k, sum(n.own) as saved_tokens, count(*) filter (where x.n_children = 0) as n_leaves
              from n join x on x.depth = n.depth and x.k = n.k join p a on a.conv_id = n.conv_id and a.depth <= n.depth group by 1, 2),
        e as (select q.depth, q.k, sha256(string_agg(cast(q.conv_id as varchar), ',' order by q.conv_id)) as ends
              from (select *, row_number() over (partition by conv_id order by depth desc) as back from p) q where back = 1 group by 1, 2)
        select n.conv_id, n.depth, case when n.depth > 0 then v.conv_id end as parent_conv_id, n.n_convs, x.n_children, s.n_leaves, cast(s.saved_tokens as bigint) as saved_tokens, coalesce(e.ends, sha256('')) as ends_sha256
        from n join x on x.depth = n.depth and x.k = n.k join s on s.depth = n.depth and s.k = n.k
        left join e on e.depth = n.depth and e.k = n.k
        left join u on u.depth = n.depth and u.k = n.k left join n v on v.depth = n.depth - 1 and v.k = u.up
    """,
    "op13_sources": r"""
        with d as (select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
        t as (select doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
        k as (select lang, term, count(*) as total from t group by 1, 2 having count(distinct doc) >= 3),
        c as (select t.lang, source, term, count(*) as n from t join k using (lang, term) group by 1, 2, 3),
        g as (select distinct lang, source from d),
        v as (select lang, count(*) as v, sum(total) as total from k group by 1),
        s as (select lang, source, sum(n) as own from c group by 1, 2),
        p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
                     1 + cast(1000000000 as hugeint) * (coalesce(c.n, 0) + 1) // cast(coalesce(s.own, 0) + v.v as hugeint) as p,
                     1 + cast(1000000000 as hugeint) * (k.total + 1) // cast(v.total + v.v as hugeint) as q
              from g join k on k.lang = g.lang join v on v.lang = g.lang
              left join s on s.lang = g.lang and s.source = g.source
              left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
        m as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
              from p a join p b on b.lang = a.lang and b.term = a.term and b.source <> a.source group by 1, 2, 3),
        r as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(m.value, 0) as bigint) as value
              from g a join g b on b.lang = a.lang and b.source <> a.source left join m on m.lang = a.lang and m.source = a.source and m.item = b.source
              union all
              select lang, source, 'term', term, cast((p - q) * (p - q) // q as bigint) from p where n > 0 and p > q),
        o as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from r)
        select lang, source, part, item, value, rank from o where part = 'pair' or rank <= 200
    """,
}
