"""The registered corpus queries: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

import json

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, decontaminate, filter_audit, hostrules, language, mixing, pii, quality, shards, simhash, spelling, token_counts, warc
from paperloom.llm.tables import read, stored

#: The vocabulary file of the token operators.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict = {}
ORACLES: dict = {}


def op7_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.interleave(read(spark, sf_dir, "documents"), n_shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES["op7_interleaved_shards"] = op7_interleaved_shards


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES["op10_winnowing"] = op10_winnowing
ORACLES["op10_winnowing"] = decontaminate.ORACLE


def op4_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES["op4_pivot_simhash"] = op4_pivot_simhash


def op3_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES["op3_zip_warc"] = op3_zip_warc
ORACLES["op3_zip_warc"] = warc.ORACLE


def op1_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hostrules.judged(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES["op1_host_rules"] = op1_host_rules
ORACLES["op1_host_rules"] = hostrules.ORACLE


def op8_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(read(spark, sf_dir, "documents"), TOKENIZER)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


QUERIES["op8_chunked_bpe"] = op8_chunked_bpe


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.select(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).scores()


QUERIES["op2_importance_resampling"] = op2_importance_resampling


def op9_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = stored(token_counts.build(read(spark, sf_dir, "documents"), TOKENIZER), "trees")
    out = token_counts.apply_edits(state, TOKENIZER, token_counts.sample_edits())
    return out.select("doc_id", "n_tokens_before", "n_tokens", "reencoded_bytes", F.sha2(F.encode("text", "UTF-8"), 256).alias("edited_sha256"))


QUERIES["op9_edit_aware_counts"] = op9_edit_aware_counts


def op6_language_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language.Model(docs.filter(~held_out))
    out = language.identify(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES["op6_language_mixtures"] = op6_language_mixtures


def op5_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.detect(read(spark, sf_dir, "documents"))
    counts = [pii.counted("base", rank).alias(f"n_{kind}") for rank, kind in enumerate(pii.KINDS)]
    return out.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


QUERIES["op5_bootstrapped_pii"] = op5_bootstrapped_pii


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES["op13_filter_audit"] = op13_filter_audit
ORACLES["op13_filter_audit"] = filter_audit.ORACLE


def op12_flow_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), F.array("source"), weights=(3, 1, 2))
    by_name = {s["source"]: s for s in mixed.sources}
    own = [(p["pattern"], by_name[json.loads(p["pattern"])[0]]) for p in mixed.patterns]
    sources = [(pattern, s["source_size"], s["target"]) for pattern, s in own]
    told = F.broadcast(spark.createDataFrame(sources, "pattern string, source_size bigint, target double"))  # as many as mixing.MAX_PATTERNS
    return mixed.documents.join(told, "pattern").select("doc_id", "size", "source_size", "target", "taken")


QUERIES["op12_flow_mixture"] = op12_flow_mixture
ORACLES["op12_flow_mixture"] = mixing.ORACLE


def op11_errata_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES["op11_errata_tries"] = op11_errata_tries
