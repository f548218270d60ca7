"""Queries over the driver's tables: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import clustered, with_inertia
from .counts import token_counts
from .hamming import comparison_code, top_k
from .huffman import read_ids, tokenised, write_ids
from .langid import predict_languages, train_languages
from .neardup import near_duplicates
from .packing import pack
from .pieces import encode_nbest
from .quality import quality_rules, train_quality
from .secrets import find_secrets, train_secrets
from .shared import scratch_path
from .tokens import tokenizer_path
from .toxicity import score_toxicity, train_toxicity
from .trie import own_turns, prefix_trie, rebuilt
from .warc import read_warc, write_warc

#: Words and 5-word sets as the contracts define them, for the SQL forms.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"'[^\x20\x09-\x0D]+'"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_piece_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best segmentations of every document, and whether they decode to it."""
    return encode_nbest(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, _table(spark, sf_dir, "labels")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return predict_languages(docs, train_languages(docs))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    write_ids(tokenised(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), literal=False), path)
    return read_ids(spark, path, with_ids=False)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules(docs, train_quality(docs, _table(spark, sf_dir, "labels")))


def op6_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows nearest to each row whose id is divisible by 20, by 32-bit codes."""
    codes = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), comparison_code(F.col("embedding")).alias("code"))
    return top_k(codes, codes.where("id % 20 = 0"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), path, "2024-01-01T00:00:00Z")
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return find_secrets(docs, train_secrets(docs))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


OP9_SQL = f"""
with recursive
w as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) as ws from documents
),
s as materialized (
  select distinct doc_id, sh from (
    select doc_id, unnest(case when len(ws) >= 5
      then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
      when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh
    from w)
),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
l as materialized (
  select a.doc_id as a, b.doc_id as b from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id
  having 100 * count(*) >= 75 * ((select n from n where n.doc_id = a.doc_id) + (select n from n where n.doc_id = b.doc_id) - count(*))
),
e as materialized (select a as u, b as v from l union all select b, a from l),
r as (select doc_id as u, doc_id as v from w union select r.u, e.v from r join e on r.v = e.u),
c as (select u as doc_id, min(v) as component_id from r group by u)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, w.doc_id = c.component_id as kept
from w left join n on w.doc_id = n.doc_id join c on w.doc_id = c.doc_id
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), literal=False)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*clustered(_table(spark, sf_dir, "embeddings")))


def _op11_sql(k: int = 16, rounds: int = 3) -> str:
    """A group of common tables a round: nearest centroids n, means m, centroids c."""
    far = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
    near = f"select i, q, c, d from (select v.i, v.q, c.c, {far} as d from v, c{{r}} c) qualify row_number() over (partition by i order by d, c) = 1"
    text = f"""
with v as materialized (
  select row_number() over (order by vec_id, embedding) as i, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
),
c0 as materialized (
  select (row_number() over (order by sha256('1:' || vec_id), vec_id, q) - 1)::int as c, q from v where vec_id is not null qualify c < {k}
)"""
    for r in range(rounds):
        text += f""",
n{r} as materialized ({near.format(r=r)}),
m{r} as materialized (
  select c, list(case when s < 0 then -((n - 1 - s) // n) else s // n end order by j) as q from (
    select c, j, sum(q[j])::bigint as s, count(*) as n from n{r}, (select unnest(range(1, 65)) as j) group by c, j) group by c
),
c{r + 1} as materialized (select a.c, coalesce(m.q, a.q)::bigint[] as q from c{r} a left join m{r} m using (c))"""
    return text + f""",
a as materialized (select v.vec_id, f.c, f.d from ({near.format(r=rounds)}) f join v using (i)),
s as (select c, sum(d)::bigint as own from a group by c)
select vec_id, c as cluster, d as distance, own as cluster_inertia, (select sum(d)::bigint from a) as inertia, sha256(array_to_string(z.q, ',')) as centroid_sha256
from a join s using (c) join c{rounds} z using (c)
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(own_turns(_table(spark, sf_dir, "conversations"))))


_CRC = """xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, len(conv_id::varchar) + 1), lambda i: ord(substr(conv_id::varchar, i, 1))::bigint)),
    lambda a, x: list_reduce(list_concat([xor(a, x)], range(8)), lambda y, k: case when y % 2 = 1 then xor(y // 2, 3988292384) else y // 2 end)), 4294967295)"""
OP12_SQL = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
o as materialized (
  select conv_id, {_CRC} % 6 as h, list({{'role': role, 'text': text}} order by turn nulls first, sha256(length(role)::varchar || ':' || role || text)) as ts from t group by conv_id
),
r as materialized (select a.conv_id, list_concat(coalesce(b.ts[1:a.h], []), a.ts[a.h + 1:]) as ts from o a left join o b on b.conv_id = a.conv_id - a.conv_id % 100),
p as materialized (
  select conv_id, d, d = len(ts) as ends, case when d > 0 then length(ts[d].text) else 0 end as size, sha256(to_json(ts[1:d])::varchar) as key, case when d > 0 then sha256(to_json(ts[1:d - 1])::varchar) end as up
  from r, unnest(range(0, len(ts) + 1)) as u(d)
),
n as materialized (
  select key, any_value(d) as depth, any_value(up) as up, any_value(size) as size, min(conv_id) as conv_id, count(*) as n,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
  from p group by key
),
c as materialized (select up as key, count(*) as n_children from n where up is not null group by up),
s as materialized (
  select p.key, count(*) filter (c.key is null) as n_leaves, sum((n.n - 1) * n.size)::bigint as saved_tokens
  from n join p on p.conv_id = n.conv_id and p.d <= n.depth left join c on c.key = n.key group by p.key
)
select n.conv_id, n.depth, m.conv_id as parent_conv_id, n.n as n_convs, coalesce(c.n_children, 0) as n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
from n join s using (key) left join c using (key) left join n m on m.key = n.up
"""


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


OP6_SQL = """
with c as materialized (
  select vec_id as id, list_sum(list_transform(range(1, 33), lambda i: case when embedding[i] > embedding[i + 32] then 1::bigint << (i - 1)::int else 0 end))::bigint as code
  from embeddings where vec_id is not null and len(embedding) >= 64
),
d as (
  select q.id as query_id, c.id, bit_count(xor(q.code, c.code))::int as distance
  from c q cross join c where q.id % 20 = 0
),
r as (select *, row_number() over (partition by query_id order by distance, id)::int as rank from d)
select query_id, rank, id, distance from r where rank <= 10
"""

OP7_SQL = """
with p as (
  select page_id, url, coalesce(html, '') as body, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest
  from pages
),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest, case when first < page_id then 'revisit' else 'response' end as record_type,
  case when first < page_id then first end as refers_to, url
from p left join f using (payload_digest)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_piece_segmentation": op1_piece_segmentation,
        "op2_toxicity": op2_toxicity,
        "op3_language_id": op3_language_id,
        "op4_token_ids": op4_token_ids,
        "op5_quality_rules": op5_quality_rules,
        "op6_hamming_top_k": op6_hamming_top_k,
        "op7_warc": op7_warc,
        "op8_secrets": op8_secrets,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_packing": op10_packing,
        "op11_centroid_clusters": op11_centroid_clusters,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_token_counts": op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_hamming_top_k": OP6_SQL,
        "op7_warc": OP7_SQL,
        "op9_near_duplicates": OP9_SQL,
        "op11_centroid_clusters": _op11_sql(),
        "op12_prefix_trie": OP12_SQL,
    }
