"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, importance, langid, quality_classifier, quality_rules, sharding, simhash, suffix_dedup, token_counts, vector_codes, word_bpe
from .tables import scope, spool, table

RANKS = "byte_bpe_multi_50k.tiktoken"
WORDS = "word_bpe_49k.json"


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def words_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORDS)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = sharding.pack(table(spark, sf_dir, "documents"), shards=8)
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scope(spark):
        found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
        return spool(found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), "op2")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), bpe.read_ranks(ranks_path()), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), bpe.read_ranks(ranks_path()))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), ("n_bytes", "n_removed", "n_spans", "kept_sha256"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    made = chat.format_conversations(turns.unionByName(own)).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode(table(spark, sf_dir, "documents"), word_bpe.read_tokenizer(words_path()), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_group_error(codes).select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_simhash, op3_language_id, op4_quality_rules, op5_byte_bpe, op6_token_counts, op7_suffix_dedup, op8_quality_classifier, op9_chat_format, op10_decontamination, op11_word_bpe, op12_importance, op13_vector_codes)}


def _codes_sql(rounds: int) -> str:
    """Lloyd's rounds one after another: a{k} holds each part's least distance and entry as one number."""
    steps = """
v as (select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: floor(x::double * 1024)::bigint) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
part as (select r, p, x[p * len(x) // 4 + 1 : (p + 1) * len(x) // 4]::double[] as x from v, (select unnest(range(4)) as p)),
b0 as (select p, e, part.x as c from part join (select r, row_number() over (order by vec_id) - 1 as e from v) using (r) where e < 256)"""
    for k in range(rounds + 1):
        steps += f""",
a{k} as (select r, p, min((list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::bigint * 256 + e) as d from part join b{k} using (p) group by r, p)"""
        if k < rounds:
            steps += f""",
m{k} as (select p, e, i, floor(sum(y) / count(*)) as y from (select p, d % 256 as e, unnest(x) as y, unnest(range(len(x))) as i from part join a{k} using (r, p)) group by p, e, i),
n{k} as (select p, e, list(y order by i) as c from m{k} group by p, e),
b{k + 1} as (select p, e, coalesce(n{k}.c, b{k}.c) as c from b{k} left join n{k} using (p, e))"""
    return f"""
with {steps.strip()},
codes as (select vec_id, label, string_agg(printf('%02x', d % 256), '' order by p) as code, sum(d // 256)::bigint as error from v join a{rounds} using (r) group by r, vec_id, label),
books as (select sha256(string_agg(y::bigint::varchar, ',' order by p, e, i)) as s from (select p, e, unnest(c) as y, unnest(range(len(c))) as i from b{rounds}))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, s as codebooks_sha256 from codes, books"""


ORACLE_SQL = {
    "op7_suffix_dedup": r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
n as (select *, length(h) // 2 as n from d),
w as (select doc_id, unnest(range(n - 49)) as p, h from n where n >= 50),
s as (select doc_id, p, substr(h, 2 * p + 1, 100) as s from w),
hit as (select doc_id, p from (select doc_id, p, min(doc_id) over (partition by s) as least from s) where least < doc_id),
ends as (select doc_id, p, lag(p) over (partition by doc_id order by p) as q from hit),
runs as (select doc_id, p, sum(case when q is null or p > q + 50 then 1 else 0 end) over (partition by doc_id order by p) as run from ends),
spans as (select doc_id, run, min(p) as a, max(p) + 50 as z from runs group by doc_id, run),
nexts as (select doc_id, a, z, lead(a) over (partition by doc_id order by a) as b, row_number() over (partition by doc_id order by a) as k from spans),
cut as (select doc_id, sum(z - a) as removed, count(*) as spans, string_agg(case when k = 1 then substr(h, 1, 2 * a) else '' end || substr(h, 2 * z + 1, 2 * (coalesce(b, n) - z)), '' order by a) as kept from nexts join n using (doc_id) group by doc_id)
select n.doc_id, n.n::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from n left join cut using (doc_id)""",
    "op9_chat_format": r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, replace(replace(role, '\', '\\'), '<|', '<\|') as r, replace(replace(text, '\', '\\'), '<|', '<\|') as x,
  lag(role) over (partition by conv_id order by turn, role, text) as before from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  (sum(length(x) + case when before is null then length('<|open|>' || r || '<|text|>') when before = role then length('<|next|>') else length('<|close|><|open|>' || r || '<|text|>') end) + length('<|close|>'))::bigint as formatted_chars
from e group by conv_id""",
    "op12_importance": r"""
with tab as (select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
texts as (select true as own, doc_id, text from documents union all select false, item_id, text from benchmark),
w as (select own, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
f as (select own, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from w),
bytes as (select f, hex(encode(f)) as h from (select distinct f from f)),
crc as (select f, xor(list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket from bytes, tab),
hits as (select own, doc_id, bucket from f join crc using (f)),
n as (select bucket, count(*) filter (where own) as s, count(*) filter (where not own) as t from hits group by bucket),
total as (select sum(s)::double as sa, sum(t)::double as ta from n),
gain as (select bucket, floor(1000 * ln(((t + 1)::double * (sa + 10000)) / ((s + 1)::double * (ta + 10000))))::bigint as gain from n, total),
weight as (select doc_id, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight from hits join gain using (bucket) where own group by doc_id),
noise as (select doc_id, len(w) >= 20 as eligible, floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as noise from w where own),
scored as (select n.doc_id, eligible, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight, coalesce(weight, 0)::bigint + noise as score from noise n left join weight using (doc_id)),
placed as (select *, row_number() over (partition by eligible order by score desc, doc_id) as place, count(*) filter (where eligible) over () as n from scored)
select doc_id, n_features, weight, score, case when eligible and place <= 25 * n // 100 then place end as rank from placed""",
    "op13_vector_codes": _codes_sql(4),
}
