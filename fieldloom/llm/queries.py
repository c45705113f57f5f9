"""Queries of the numbered operators over their whole tables, with SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import chat, hardneg, lexical, mixing, neardup, oracles, packing, pii, quality, sharding, sketch, substring, url_filter, warc
from fieldloom.llm.common import table

#: The rules of the query, as text: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
SHARDS = 24


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from each speaker's perspective; the mask as text, "start-end start-end"."""
    out = chat.rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m.start.cast("string"), F.lit("-"), m.end.cast("string"))), " ")
    return out.select("conv_id", "speaker", "part", F.col("n_turns").cast("long").alias("n_turns"), F.col("n_target_turns").cast("long").alias("n_target_turns"), "rendered", spans.alias("mask"), F.col("n_chars").cast("long").alias("n_chars"), F.col("n_masked_chars").cast("long").alias("n_masked_chars"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op4_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    page = F.nullif(F.regexp_extract(F.col("metadata")[0]["fields"], r"page-id: (-?\d+)", 1), F.lit("")).cast("long")
    found = captures.select(page.alias("page_id"), "capture_id", F.coalesce("response.payload_bytes", "original.payload_bytes").alias("payload_bytes"), F.coalesce("response.payload_sha1", "original.payload_sha1").alias("payload_digest"), F.col("response.kind").alias("record_type"), F.col("original.record_id").alias("original_id"))
    names = found.where("record_type = 'response'").select(F.col("capture_id").alias("original_id"), F.col("page_id").alias("refers_to"))
    key = F.coalesce("original_id", F.concat(F.lit("none:"), "capture_id"))
    return found.join(names.withColumnRenamed("original_id", "of"), key == F.col("of"), "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    out = sharding.histogram_shards(docs, SHARDS, "text", size, [F.col("doc_id"), F.crc32(text.cast("binary")).alias("text_crc32")], ["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints_with_edits(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.deduplicate_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, n: x + n)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), "kept_sha256")



def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s.kind.isin(*kinds))
    n = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    base = F.sha2(pii.digest(of(*pii.BASE)).cast("binary"), 256)
    return found.select("doc_id", *n, base.alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hardneg.usable(table(spark, sf_dir, "embeddings"))
    mined = hardneg.mine_hard_negatives(rows, rows.where(F.pmod("vec_id", F.lit(50)) == 0))
    return mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


QUERIES = {f.__name__: f for f in (op1_chat_perspectives, op2_url_filter, op3_minhash_classes, op4_warc_transactions, op5_histogram_shards, op6_packed_sequences, op7_source_mix, op8_quality_rules, op9_fingerprints, op10_substring_dedup, op11_ranked_search, op12_personal_data, op13_hard_negatives)}
ORACLES = {"op1_chat_perspectives": oracles.OP1, "op2_url_filter": oracles.OP2, "op4_warc_transactions": oracles.OP4, "op8_quality_rules": oracles.OP8, "op11_ranked_search": oracles.OP11, "op13_hard_negatives": oracles.OP13}
