"""One query for each operator of the subpackage, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, hard_negatives, language_id, lm_scoring, media, near_dedup, packing, quality, simhash, substring_dedup, suffix_dedup, whitening
from .common import documents


def remainder(n: int):
    """crc32 of doc_id as text, modulo n; 1 for a null doc_id, which so is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(1))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(documents(spark, sf_dir), tokenizer_path())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("rid")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return lm_scoring.scores(documents(spark, sf_dir), held_out)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir)).drop("rid")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeated_bytes(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    names, prototypes = language_id.learn(docs.where(remainder(5) != 0))
    said = language_id.predict(docs, names, prototypes)
    return said.select("doc_id", (remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.encode(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated_words(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(hard_negatives.usable(F.col("embedding")))
    rows = own.select(F.col("vec_id").alias("id"), label.alias("label"), hard_negatives.whole(F.col("embedding"), 256).alias("x"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out = whitening.whiten(rows).withColumnRenamed("id", "vec_id")
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


QUERIES = {f.__name__: f for f in (op1_packing, op2_decontamination, op3_quality, op4_lm_scoring, op5_near_dedup, op6_suffix_dedup, op7_language_id, op8_media, op9_chat, op10_substring_dedup, op11_hard_negatives, op12_simhash, op13_whitening)}

ORACLE = {
    "op9_chat": """
with t as (
  select conv_id, coalesce(role, 'unknown') as role, coalesce(text, '') as text,
         coalesce(length(role) || ':' || role, '-') || coalesce(length(text) || ':' || text, '-') as said,
         row_number() over w as n, lead(1) over w is null as last
  from conversations window w as (partition by conv_id order by turn nulls first, role nulls first, text nulls first)),
h as (
  select *, md5(string_agg(said, '') over (partition by conv_id order by n)) as hash from t),
kept as (
  select n, hash, min(conv_id) as conv_id from h where last group by n, hash),
top as (
  select conv_id from kept k where not exists (select 1 from h where not h.last and h.n = k.n and h.hash = k.hash))
select t.conv_id, count(*) as n_turns, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' order by n) as chat
from t join top on t.conv_id is not distinct from top.conv_id group by t.conv_id""",
    "op11_hard_negatives": """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda c: floor(256 * c::double)) as x
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (
  select a.vec_id as anchor_id, r.vec_id, r.label = a.label as same, list_dot_product(a.x, r.x)::bigint as score
  from r a join r on r.vec_id <> a.vec_id where a.vec_id % 100 = 0),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id, row_number() over w as rank, s.vec_id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same
where 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
window w as (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)
qualify row_number() over w <= 10""",
}
