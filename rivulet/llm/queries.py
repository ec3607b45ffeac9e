"""The queries of this subpackage: each applies an operator to its whole table and returns the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .graph_search import nearest
from .kd_search import exact_top_k
from .licenses import scan_licenses
from .mixing import Mix
from .near_dedup import near_duplicates
from .packing import pack
from .prefix_trie import conversation_trie
from .quality import quality_scores
from .ranked_search import ranked_search
from .secrets import find_secrets
from .token_count import count_tokens
from .toxicity import toxicity_scores
from .word_bpe import round_trip_digests


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), query_every=20, k=20, beam=160)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), query_every=100, k=10, scale=1024)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: the source is the repository, the language a directory in it."""
    docs = table(spark, sf_dir, "documents")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    files = docs.select("doc_id", "text", F.concat_ws("/", part("source"), part("lang"), F.concat(part("doc_id"), F.lit(".txt"))).alias("path"))
    return scan_licenses(files)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), total_share=1.5, most_passes=2).taken()


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), family=100, shared=6)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_graph_neighbours": op1_graph_neighbours,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_token_counts": op3_token_counts,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_secrets": op6_secrets,
    "op7_licenses": op7_licenses,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_mix_sources": op10_mix_sources,
    "op11_ranked_search": op11_ranked_search,
    "op12_word_bpe": op12_word_bpe,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings),
s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select * from r where rank <= 10
""",
    "op4_near_duplicates": r"""
with recursive
w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents
),
s as (
  select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as sh
  from w
),
n as (select doc_id, len(sh) as n_shingles from s),
e as (select doc_id, unnest(sh) as h from s),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from e a join e b on a.h = b.h and a.doc_id <> b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n_shingles + b.n_shingles - c)),
r as (select doc_id, doc_id as c from n union select r.doc_id, l.y from r join l on l.x = r.c)
select n.doc_id, n_shingles, min(c) as component_id, n.doc_id = min(c) as kept
from n join r on r.doc_id = n.doc_id group by n.doc_id, n_shingles
""",
    "op11_ranked_search": r"""
with t as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws
  from documents
),
d as (select doc_id, len(ws)::bigint as n, ws from t where len(ws) > 0),
c as (select count(*)::bigint as docs, sum(n)::bigint as length from d),
q as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark
),
p as (select doc_id, n, term, count(*)::bigint as tf from (select doc_id, n, unnest(ws) as term from d) where term in (select term from q) group by all),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p cross join c group by term, docs),
s as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * docs) // length)))))::bigint as score
  from q join p using (term) join w using (term) cross join c group by item_id, doc_id
)
select * from (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from s where score > 0) where rank <= 50
""",
    "op13_prefix_trie": """
with o as (
  select conv_id, list(struct_pack(k := md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')), n := length(coalesce(text, '')))
    order by turn nulls first, coalesce(role, '')) as t from conversations where conv_id is not null group by conv_id
),
h as (
  select *, xor(list_reduce(flatten(list_transform(range(1, length(conv_id::varchar) + 1), lambda i: [ord(substr(conv_id::varchar, i::int, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda x, b: case when b >= 0 then xor(x, b) when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, 4294967295::bigint), 4294967295::bigint) % 6 as h from o
),
r as (select a.conv_id, list_concat(case when a.h > 0 then coalesce(b.t[1:a.h], []) else [] end, a.t[a.h + 1:]) as t from h a left join o b on b.conv_id = a.conv_id - a.conv_id % 100),
p as (select conv_id, t, d, array_to_string(list_transform(t[1:d], lambda x: x.k), '') as key from (select conv_id, t, unnest(range(0, len(t) + 1)) as d from r)),
n as (
  select key, d, min(conv_id) as conv_id, count(*) as n_convs, any_value(case when d > 0 then (t[d]).n else 0 end) as last,
    sha256(coalesce(string_agg(case when d = len(t) then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256 from p group by key, d
),
f as (select c.d - 1 as d, left(c.key, (32 * (c.d - 1))::int) as key, count(*) as n_children from n c where c.d > 0 group by all),
g as (select n.*, coalesce(n_children, 0) as n_children from n left join f using (key, d)),
s as (select p.key, p.d, sum((g.n_convs - 1) * g.last) as saved, count(*) filter (g.n_children = 0) as leaves from g join p on p.conv_id = g.conv_id and p.d <= g.d group by all)
select g.conv_id, g.d::bigint as depth, u.conv_id as parent_conv_id, g.n_convs::bigint as n_convs, g.n_children::bigint as n_children, s.leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, g.ends_sha256
from g join s using (key, d) left join n u on g.d > 0 and u.d = g.d - 1 and u.key = left(g.key, (32 * (g.d - 1))::int)
""",
}
