"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.fmindex import substring_report
from lodestone.llm.jaccard import jaccard_classes
from lodestone.llm.mixing import mix_report
from lodestone.llm.neighbours import neighbours
from lodestone.llm.rules import quality_report
from lodestone.llm.scoring import score_documents
from lodestone.llm.sentencepieces import encode_documents
from lodestone.llm.shards import shard_by_bytes
from lodestone.llm.suffixes import repeat_report
from lodestone.llm.warc import round_trip


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer(name: str) -> str:
    """The path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(_docs(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(_docs(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(_docs(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_docs(spark, sf_dir), tokenizer("piece_bpe_32k.model"), digests=True)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_docs(spark, sf_dir))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_docs(spark, sf_dir)).drop("rejected_by")


def op8_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_docs(spark, sf_dir))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(_docs(spark, sf_dir))


LLM_QUERIES = {f.__name__: f for f in (op1_mixing, op2_suffix_dedup, op3_substring_dedup, op4_sentencepiece, op5_jaccard_join, op6_warc, op7_quality_rules, op8_scoring, op9_neighbours, op10_sharding)}

OP2_SQL = """
with t as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
w as (select r, i, b[i:i + 199] as g from (select r, b, unnest(range(1, octet_length(b) - 198)) as i from t where octet_length(b) >= 200)),
d as (select r, i from (select r, i, count(*) over (partition by g) as n from w) where n > 1),
s as (select r, i, sum(step) over (partition by r order by i) as run from (select r, i, case when i - lag(i) over (partition by r order by i) <= 200 then 0 else 1 end as step from d)),
u as (select r, min(i) as a, max(i) + 200 as z from s group by r, run),
k as (select r, coalesce(lag(z) over (partition by r order by a), 1) as a, a as z from u union all select r, max(z), null from u group by r),
p as (select k.r, string_agg(hex(b[k.a:coalesce(k.z - 1, octet_length(b))]), '' order by k.a, k.z nulls last) as kept from k join t on t.r = k.r group by k.r)
select doc_id, octet_length(b)::bigint as n_bytes, coalesce(n, 0)::bigint as n_removed, coalesce(m, 0)::bigint as n_spans,
    sha256(case when p.r is null then b else unhex(kept) end) as kept_sha256
from t left join (select r, sum(z - a) as n, count(*) as m from u group by r) x on x.r = t.r left join p on p.r = t.r
"""

OP3_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, unnest(range(1, len(ws) - 33)) as i, unnest(list_transform(range(1, len(ws) - 33), lambda i: array_to_string(ws[i:i + 34], ' '))) as g from w where len(ws) >= 35),
d as (select doc_id, i from (select doc_id, i, count(*) over (partition by g) as n from g) where n > 1),
r as (select distinct doc_id, i + k as i from d, range(35) t(k)),
p as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from w),
k as (select p.doc_id, p.i, p.ws[p.i] as word, r.i is null as stays from p left join r on r.doc_id = p.doc_id and r.i = p.i),
s as (select doc_id, count(*) filter (not stays) as n_removed, string_agg(word, ' ' order by i) filter (stays) as kept from k group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join s on s.doc_id = w.doc_id
"""

OP5_SQL = r"""
with recursive t as (select coalesce(text, '') as text, min(doc_id) as first, count(*) as n_copies from documents group by 1),
w as (select first, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from t),
s as (select distinct first, unnest(case when len(ws) between 1 and 4 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as g from w where len(ws) > 0),
n as (select first, count(*) as n from s group by first),
c as (select a.first as x, b.first as y, count(*) as both from s a join s b on a.g = b.g and a.first <> b.first group by 1, 2),
l as (select x, y from c join n a on a.first = x join n b on b.first = y where 10 * c.both >= 8 * (a.n + b.n - c.both)),
r as (select first as x, first as y from t union select r.x, l.y from r join l on l.x = r.y),
k as (select x, min(y) as class_id from r group by x),
m as (select x, count(*) as n_links from l group by x)
select doc_id, class_id, coalesce(n_links, 0)::bigint as n_links, n_copies
from documents d join t on t.text = coalesce(d.text, '') join k on k.x = t.first left join m on m.x = t.first
"""

OP6_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by payload_digest)
select d.*, case when first <> page_id then 'revisit' else 'response' end as record_type,
    case when first <> page_id then first end as refers_to
from d left join f using (payload_digest)
"""

OP7_SQL = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t),
g as (select doc_id, unnest(range(1, len(ws) - 1)) as i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) as g from w where len(ws) >= 3),
d as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from g) where n > 1),
r as (select doc_id, count(distinct i + k) as n from d, (values (0), (1), (2)) k(k) group by doc_id),
m as (select w.doc_id, len(ws)::bigint as n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words
    from w left join r on r.doc_id = w.doc_id)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > n_words
        or word_chars < 2 * n_words or word_chars > 16 * n_words or 10 * n_dup_lines > n_words) as kept
from m
"""

OP10_SQL = r"""
with recursive bits as (select n::ubigint as n, n::ubigint as c, 0 as k from range(256) t(n)
    union all select n, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1 from bits where k < 8),
tab as (select list(c order by n) as crc_of from bits where k = 8),
b as (select doc_id, octet_length(encode(coalesce(text, '')))::bigint + 16 as size,
    list_transform([coalesce(text, ''), coalesce(doc_id::varchar, '')], lambda s: list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: ('0x' || x)::ubigint)) as bs from documents),
c as (select doc_id, size, list_transform(bs, lambda s: xor(list_reduce(list_concat([4294967295::ubigint], s), lambda c, x: xor(c >> 8, crc_of[(xor(c, x) & 255)::int + 1])), 4294967295::ubigint)) as crc from b, tab),
o as (select doc_id, size, crc[1]::bigint as text_crc32, row_number() over w as nth, sum(size) over (w rows unbounded preceding) as upto, sum(size) over () as total
    from c window w as (order by crc[1], crc[2] >> 1, doc_id nulls first, size)),
s as (select *, least(39, ((2 * upto - size) * 40) // (2 * total))::int as shard from o)
select doc_id, size, text_crc32, 'bytes' as law, shard, (row_number() over (partition by shard order by nth) - 1)::bigint as slot, null::int as grown_shard from s
"""

LLM_SQL = {"op2_suffix_dedup": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op5_jaccard_join": OP5_SQL, "op6_warc": OP6_SQL, "op7_quality_rules": OP7_SQL, "op10_sharding": OP10_SQL}
