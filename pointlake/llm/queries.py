"""The registered queries of the operators, thin layers over them, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, line_dedup, lm_score, mixing, packing, pii, quality, sharding, simhash, warc
from .common import scratch, table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    got = warc.read_warc(spark, path).where(F.col("warc_type").isin("response", "revisit"))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:page:([0-9-]+)', 1) as bigint)")
    digest = F.when(F.col("warc_type") == "response", F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", ""))
    return got.select(number("record_id").alias("page_id"), F.col("http_length").alias("payload_bytes"), digest.alias("payload_digest"), F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("pii")
    found = pii.pii_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    count = lambda k: F.size(F.filter(spans, lambda c: c["base"] & (c["kind"] == k))).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)], F.sha2(pii.show(spans, lambda c: c["base"]).cast("binary"), 256).alias("base_sha256"), pii.show(spans, lambda c: F.lit(True)).alias("spans"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = sharding.shard_plan(table(spark, sf_dir, "documents"), 8)
    return plan.select("doc_id", F.col("sh_size").alias("size"), F.col("sh_crc32").alias("text_crc32"), F.lit("rows").alias("law"), F.col("sh_shard").alias("shard"), F.col("sh_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"), ["doc_id"])
    return plan.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import NULL_ID, materialise

    printed = materialise(simhash.with_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False), "op9")
    least = simhash.simhash_components(printed).withColumnRenamed("fp", "fp2")
    joined = printed.join(least, F.col("fp") == F.col("fp2"))
    component = F.when(F.col("least") == NULL_ID, F.col("doc_id")).otherwise(F.col("least"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_verdicts(table(spark, sf_dir, "documents"), carry=["doc_id"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("doc_id", *[F.col(f"q_{n}").alias(n) for n in names], F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_line_dedup, op2_warc, op3_multi_index, op4_lm_score, op5_pii, op6_pack, op7_shard, op8_mix, op9_simhash, op10_quality, pipeline)}


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)
