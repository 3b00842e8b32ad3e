"""Registered queries of these operators, each over its whole table, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventspark.llm import (ball_tree, compression_quality, extendible_sharding, gray_simhash, multiprobe, ppm, prefix_trie, prefix_viterbi, pruned_graph,
                            pu_toxicity, source_mixing, spelling_variants, token_files)
from eventspark.llm.common import shipped, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@shipped
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@shipped
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pruned_graph.near_copies(table(spark, sf_dir, "embeddings"))


@shipped
def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@shipped
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_sharding.shard_table(table(spark, sf_dir, "documents"))


@shipped
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.plan(table(spark, sf_dir, "documents"))


@shipped
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@shipped
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gray_simhash.near_copies(table(spark, sf_dir, "documents"))


@shipped
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


@shipped
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_viterbi.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@shipped
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiprobe.search(table(spark, sf_dir, "embeddings"))


@shipped
def op11_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.search(table(spark, sf_dir, "embeddings"))


@shipped
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


@shipped
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


@shipped
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_classifier, op2_embedding_near_dedup, op3_token_ids, op4_sharding, op5_mixing, op6_toxicity, op7_simhash, op8_lm_scoring,
    op9_sentencepiece, op10_nearest_neighbours, op11_exact_search, op12_spelling_variants, op13_prefix_trie, pipeline)}

# crc32 (polynomial 0xEDB88320): the bytes' table, and the fold of a string's bytes with it
_CRC_TABLE = """crc as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t)"""


def _crc32(text: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen({text})),
    lambda i: cast('0x' || substr(hex(encode({text})), 2 * i + 1, 2) as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""


ORACLE: dict[str, str] = {
    "op2_embedding_near_dedup": """
with recursive pairs as (
  select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b
  on a.label = b.label and a.vec_id <> b.vec_id
    and list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) >= 0.93e0),
reach as (
  select vec_id as a, vec_id as b from embeddings union select r.a, p.b from reach r join pairs p on r.b = p.a),
least as (select a as vec_id, min(b) as component_id from reach group by a),
links as (select a as vec_id, count(*) as n_links from pairs group by a)
select l.vec_id, coalesce(k.n_links, 0) as n_links, l.component_id, l.vec_id = l.component_id as kept
from least l left join links k on l.vec_id = k.vec_id""",
    "op4_sharding": f"""
with hashed as (
  select doc_id, coalesce(strlen(text), 0) as bytes, md5(coalesce(cast(doc_id as varchar), '')) as h from documents),
bits as (
  select doc_id, bytes, array_to_string(list_transform(range(1, 33),
    lambda i: lpad(bin(cast('0x' || substr(h, i, 1) as bigint)), 4, '0')), '') as b from hashed),
levels as (
  select doc_id, bytes, d, substr(b, 1, d) as prefix, sum(bytes) over (partition by d, substr(b, 1, d)) as shard_bytes,
    count(*) over (partition by d, substr(b, 1, d)) as shard_rows
  from bits, (select cast(unnest(range(0, 129)) as integer) as d))
select doc_id, cast(bytes as bigint) as bytes, prefix as shard, cast(d as bigint) as depth, cast(shard_bytes as bigint) as shard_bytes, shard_rows
from levels where shard_bytes <= {extendible_sharding.LIMIT} or shard_rows = 1 or d = 128
qualify row_number() over (partition by doc_id order by d) = 1""",
    "op5_mixing": """
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
    strlen(text) as bytes, (cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) + 0.5e0)
      / 4503599627370496e0 as u from documents),
keyed as (
  select *, -ln(u) / case when size > 0 then greatest(0.05e0, 1e0 / (1e0 + abs(bytes / cast(size as double) - 6e0) / 6e0)) else 0.05e0 end as key
  from sized),
sources as (
  select source, cast(sum(size) as bigint) as source_size, 2e0 * sum(size) as cap,
    case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3e0 when 1 then 1e0 else 2e0 end as w
  from sized group by source),
levels as (
  select *, (1.5e0 * sum(source_size) over () - coalesce(sum(cap) over fills, 0)) / (sum(w) over () - coalesce(sum(w) over fills, 0)) as own
  from sources window fills as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
aims as (
  select source, source_size, coalesce(least(cap, w * (select own from levels where own * w < cap order by cap / w limit 1)), cap) as target
  from levels),
budgets as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as epochs from aims),
running as (
  select k.*, b.source_size, b.target, b.epochs, cast(round(b.target) as bigint) - b.epochs * b.source_size as budget,
    coalesce(sum(k.size) over (partition by k.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from keyed k join budgets b on k.source is not distinct from b.source)
select doc_id, size, source_size, target,
  cast(epochs * size + greatest(0, least(size, budget - before)) as bigint) as taken
from running""",
    "op11_exact_search": """
with usable as (
  select vec_id, list_transform(embedding, lambda x: floor(256e0 * cast(x as double))) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is not null and not isnan(x) and not isinf(x))) = len(embedding)),
one as (select vec_id, min(v) as v from usable group by vec_id),
scored as (
  select q.vec_id as query_id, x.vec_id, cast(list_dot_product(q.v, x.v) as bigint) as score
  from one q join one x on q.vec_id % 50 = 0 and q.vec_id <> x.vec_id and len(q.v) = len(x.v)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from scored)
select query_id, cast(r as integer) as rank, vec_id, score from ranked where r <= 5""",
    "op12_spelling_variants": f"""
with recursive {_CRC_TABLE},
runs as (
  select coalesce(cast(doc_id as varchar), '') as id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
counted as (select id, run, id || ':' || run as salted, count(*) as k from runs where length(run) >= 7 group by all),
hashed as (select run, k, {_crc32("salted")} as h from counted, crc),
damaged as (
  select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, k from hashed),
vocab as (select word, cast(sum(k) as bigint) as n from damaged where length(word) >= 7 group by word having sum(k) >= 2),
cut as (
  select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest
  from (select word, n, unnest(range(length(word))) as i from vocab)),
pairs as (
  select a.word, a.n, b.word as near, b.n as near_n from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select c.word, c.n, v.word, v.n from cut c join vocab v on c.rest = v.word
  union select v.word, v.n, c.word, c.n from cut c join vocab v on c.rest = v.word),
best as (
  select word, near, near_n, count(*) over (partition by word) as n_near from pairs
  qualify row_number() over (partition by word order by near_n desc, near) = 1),
forms as (
  select v.word, v.n, coalesce(b.n_near, 0) as n_near, case when b.near_n >= 10 * v.n then b.near end as form,
    case when b.near_n >= 10 * v.n then b.near_n end as form_n from vocab v left join best b on v.word = b.word),
follow as (
  select word, word as root, 0 as steps from forms
  union all select f.word, g.form, f.steps + 1 from follow f join forms g on f.root = g.word where g.form is not null),
last as (select word, max_by(root, steps) as root from follow group by word)
select f.word, f.form, l.root, f.n, f.n_near, f.form_n from forms f join last l on f.word = l.word""",
    "op13_prefix_trie": f"""
with {_CRC_TABLE},
turns as (
  select conv_id, turn, length(coalesce(text, '')) as chars,
    substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 30) as id
  from conversations where conv_id is not null),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, id) - 1 as i from turns),
ids as (select distinct conv_id, cast(conv_id as varchar) as c from turns),
convs as (select conv_id, conv_id - conv_id % 100 as base, {_crc32("c")} % 6 as h from ids, crc),
rebuilt as (
  select c.conv_id, p.i, 0 as own, p.id, p.chars from convs c join placed p on p.conv_id = c.base and p.i < c.h
  union all select c.conv_id, p.i, 1, p.id, p.chars from convs c join placed p on p.conv_id = c.conv_id and p.i >= c.h),
seqs as (
  select c.conv_id, coalesce(list(r.id order by r.own, r.i) filter (where r.id is not null), []) as s,
    coalesce(list(r.chars order by r.own, r.i) filter (where r.id is not null), []) as l
  from convs c left join rebuilt r on c.conv_id = r.conv_id group by c.conv_id),
steps as (select conv_id, s, l, unnest(range(len(s) + 1)) as depth from seqs),
members as (select conv_id, depth, array_to_string(s[1:depth], '') as path, case when depth > 0 then l[depth] else 0 end as chars, len(s) = depth as ends from steps),
nodes as (
  select depth, path, min(conv_id) as conv_id, count(*) as n_convs, any_value(chars) as chars,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from members group by depth, path),
kids as (select depth - 1 as depth, substr(path, 1, length(path) - 30) as path, count(*) as k from nodes where depth > 0 group by all),
full_nodes as (select n.*, coalesce(k.k, 0) as n_children from nodes n left join kids k on n.depth = k.depth and n.path = k.path),
sums as (
  select a.depth, a.path, count(*) filter (where b.n_children = 0) as n_leaves, sum((b.n_convs - 1) * b.chars) as saved
  from full_nodes a join full_nodes b on b.depth >= a.depth and substr(b.path, 1, 30 * a.depth) = a.path group by all)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
  cast(s.saved as bigint) as saved_tokens, n.ends_sha256
from full_nodes n join sums s on n.depth = s.depth and n.path = s.path
left join nodes p on p.depth = n.depth - 1 and p.path = substr(n.path, 1, greatest(0, length(n.path) - 30)) and n.depth > 0""",
}
