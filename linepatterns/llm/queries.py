"""The queries opN_<name>, each one operator over its whole table, with the parameters of production, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linepatterns.llm import decontaminate, filter_audit, importance, language_id, mixing, packing, pii, quality_rules, simhash_dedup, substring_dedup, target_resampling, token_counts, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = token_counts.count_prefixes(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    total = F.get("prefix_counts", F.size("prefix_counts") - 1).cast("long")
    return out.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > 2048).alias("over_limit"))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as response records, each taken apart again and derived from: both records of it, bytes included."""
    records = warc.as_records(table(spark, sf_dir, "pages"), keep=("page_id",))
    found = warc.responses(records, keep=("page_id",), all_rows=True)
    return warc.derivatives(found, payload_digest="payload_digest", payload_length="payload_length", keep=("page_id",))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.personal_data(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *(pii.count_kind("base", i).alias(f"n_{pii.KINDS[i]}") for i in range(4)), F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))
    return out.select("doc_id", *quality_rules.OUTPUTS)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out("doc_id"))
    model = language_id.learn(docs.where("not held_out"))
    return language_id.identify(docs, model, keep=("doc_id", "held_out"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: Filters as bits of a mask; a document's mask has those it fails. Orders are all rows of five different letters.
_AUDIT = r"""with words as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
known as (select doc_id as id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by all),
judged as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g'))) > 2 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask
  from words left join known on doc_id = id),
held as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from judged group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as b),
orders as (select [x1.f, x2.f, x3.f, x4.f, x5.f] as fs, [x1.b, x2.b, x3.b, x4.b, x5.b] as bs from letters x1, letters x2, letters x3, letters x4, letters x5
  where len(list_distinct([x1.b, x2.b, x3.b, x4.b, x5.b])) = 5),
steps as (select array_to_string(fs, '') as filter_order, k::int as step, bs[k] as b, coalesce(list_sum(bs[1:k - 1]), 0)::int as before from orders, range(1, 6) r(k)),
counted as (select part, filter_order, step, b,
    sum(case when mask & (before | b) = 0 then n else 0 end)::bigint as kept, sum(case when mask & before = 0 and mask & b <> 0 then n else 0 end)::bigint as removed,
    sum(case when mask & before <> 0 and mask & b <> 0 then n else 0 end)::bigint as redundant, sum(case when mask = b then n else 0 end)::bigint as unique_fails,
    sum(case when mask & before = 0 and mask & b <> 0 then good else 0 end)::bigint as good_lost, sum(case when mask & before = 0 and mask & b <> 0 then toxic else 0 end)::bigint as toxic_lost
  from held, steps group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, b))::bigint as shapley from counted"""

_ALL = (
    op1_substring_dedup, op2_token_counts, op3_warc_derivatives, op4_pii, op5_decontaminate, op6_quality_rules, op7_mixing, op8_importance, op9_simhash, op10_language_id,
    op11_target_resampling, op12_filter_audit, op13_best_fit_packing, pipeline,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op12_filter_audit": _AUDIT}
