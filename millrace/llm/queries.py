"""The queries ``opN_*`` over the standard tables, and their SQL where SQL can say the same."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chatformat, decontam, langid, licenses, packing, quality, records, sharding, simhash, urlfilter
from .common import shared_dir
from .oracles import ORACLES  # noqa: F401

PACK_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RECORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CONTROL_CASE = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), PACK_TOKENIZER)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = langid.fit(docs.filter(~F.coalesce(held_out, F.lit(False))))
    found = langid.predict_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "_lang.lang_pred", "_lang.score")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    case = spark.createDataFrame([(-7, 0, "user", CONTROL_CASE), (-7, 1, "assistant", CONTROL_CASE)], "conv_id long, turn long, role string, text string")
    return chatformat.read_back(chatformat.format_chats(rows.unionByName(case)))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.mark_contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "_leak.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.log_ratios(docs, table(spark, sf_dir, "labels"))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return quality.judge_quality(docs, weights).select("doc_id", *(f"_quality.{c}" for c in columns))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).select("doc_id", "_license.*")


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-records-{uuid.uuid4().hex}"
    records.write_records(table(spark, sf_dir, "documents"), f"{path}/records", RECORD_TOKENIZER)
    return records.write_index(spark, f"{path}/records", f"{path}/index").select("doc_id", "start", "n_tokens", "ids_crc32")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_url_filter": op4_url_filter,
    "op5_language_id": op5_language_id,
    "op6_chat_format": op6_chat_format,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_licenses": op9_licenses,
    "op10_token_records": op10_token_records,
    "pipeline": pipeline,
}
