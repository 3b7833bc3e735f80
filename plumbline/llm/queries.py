"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, common, decontamination, hard_negatives, html_text, kneser_ney, language_id, prefix_trie, quality_rules, secret_scan, sentencepiece_bpe, shards, simhash_dedup, token_counts


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.round_trip(common.table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


#: A conversation whose texts look like a template's control strings.
TRICKY = "\\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return chat_format.digests(chat_format.examples(turns.unionByName(extra)))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(common.table(spark, sf_dir, "documents"))


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(common.table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(common.table(spark, sf_dir, "documents"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(common.table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(common.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_dedup.near_duplicates(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(common.table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(common.table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.relabelled(common.table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece_round_trip": op1_sentencepiece_round_trip,
    "op2_kneser_ney_quality": op2_kneser_ney_quality,
    "op3_chat_format": op3_chat_format,
    "op4_secret_scan": op4_secret_scan,
    "op5_html_main_text": op5_html_main_text,
    "op6_quality_rules": op6_quality_rules,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_shards": op9_shards,
    "op10_token_counts": op10_token_counts,
    "op11_language_id": op11_language_id,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": r"""
with t as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, r, x) k,
             count(*) over (partition by conv_id) n from t),
l as (select *, 14 + length(replace(replace(replace(replace(r, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c'))
               + length(replace(replace(replace(x, '\', '\b'), '###', '\h'), '</turn>', '\e')) c from o),
s as (select *, sum(c) over (partition by conv_id order by k) upto from l)
select conv_id, cast(count(*) as bigint) n_turns,
       sha256(string_agg(r || chr(10) || x || chr(10), '' order by k)) turns_sha256,
       cast(coalesce(sum(case when r = 'assistant' then length(x) end), 0) as bigint) loss_chars,
       sha256(coalesce(string_agg(case when r = 'assistant' then x end, '' order by k), '')) loss_sha256,
       cast(sum(case when r = 'assistant' or k = n then upto else 0 end) as bigint) formatted_chars
from s group by conv_id""",
    "op12_prefix_trie": r"""
with t as (select conv_id c, turn, coalesce(role, '') r, coalesce(text, '') x from conversations where conv_id is not null),
o as (select *, row_number() over (partition by c order by turn nulls first, r, x) k from t),
i as (select distinct c, xor(list_reduce(list_transform(list_concat(['~'], string_split(cast(c as varchar), '')), lambda y: case when y = '~' then 4294967295 else cast(ascii(y) as bigint) end),
        lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda y, z: case when y % 2 = 1 then xor(y >> 1, 3988292384) else y >> 1 end)), 4294967295) % 4 h from t),
b as (select i.c, o.k p, o.r, o.x from i join o on o.c = i.c - i.c % 20 and o.k <= i.h),
n as (select c, count(*) n from b group by c),
m as (select * from b union all select o.c, o.k - i.h + coalesce(n.n, 0), o.r, o.x from o join i on i.c = o.c and o.k > i.h left join n on n.c = o.c),
l as (select c, list(length(r) || ':' || r || x order by p) l, list(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) order by p) w from m group by c),
f as (select i.c, coalesce(l.l, []) l, coalesce(l.w, []) w from i left join l on l.c = i.c),
e as (select c, unnest(range(len(l) + 1)) d, l, w from f),
v as (select c, d, md5(cast(l[1:d] as varchar)) node, case when d > 0 then md5(cast(l[1:d-1] as varchar)) end up, case when d > 0 then w[d] else 0 end w, d = len(l) last from e),
g as (select node, any_value(d) d, any_value(up) up, any_value(w) w, min(c) c, count(*) n, sha256(coalesce(string_agg(case when last then cast(c as varchar) end, ',' order by c), '')) ends from v group by node),
k as (select up, count(*) n from g where up is not null group by up),
s as (select g.*, coalesce(k.n, 0) kids, (g.n - 1) * g.w own from g left join k on k.up = g.node),
z as (select v.node, sum(case when s.kids = 0 then 1 else 0 end) leaves, sum(s.own) saved from v join s on s.c = v.c and s.d >= v.d group by v.node)
select s.c conv_id, cast(s.d as bigint) depth, u.c parent_conv_id, s.n n_convs, s.kids n_children, cast(coalesce(z.leaves, 0) as bigint) n_leaves, cast(coalesce(z.saved, 0) as bigint) saved_tokens, s.ends ends_sha256
from s left join g u on u.node = s.up join z on z.node = s.node""",
    "op13_hard_negatives": r"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * cast(x as double))) q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id a, b.vec_id b, a.l = b.l same, cast(list_inner_product(a.q, b.q) as bigint) score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select a, b, score from s where same qualify row_number() over (partition by a order by score desc, b) <= 5),
n as (select p.a, p.b, p.score ps, s.b nb, s.score ns, row_number() over (partition by p.a, p.b order by s.score desc, s.b) r
      from p join s on s.a = p.a and not s.same where 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select a anchor_id, b positive_id, cast(r as integer) "rank", nb negative_id, ps positive_score, ns negative_score from n where r <= 10""",
}
