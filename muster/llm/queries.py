"""The registered queries of the corpus operators: thin, over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from muster.llm import (
    additive, benchmark, chosen_path, licences, main_text, manifest, pieces, quality_rules, repeats, shards,
    simhash, urls, whitening)
from muster.llm.common import table


#: Passages of more than 50 words go where they repeat, and strings of 400 bytes whatever their words.
PASSAGE_WORDS = 51
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pieces.tokenize(docs, PIECE_MODEL, with_ids=False)


def op2_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shards.shard_by_bytes(table(spark, folder, "documents"), 40)


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return benchmark.mark(docs, table(spark, folder, "benchmark")).select("doc_id", *benchmark.RESULTS)


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, folder, "documents"), passages=PASSAGE_WORDS)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "text")


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


#: (host, path, verdict); a rule's name is the two laid end to end.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, folder, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract_text(table(spark, folder, "pages"))


def op9_quality_score(spark: SparkSession, folder: str) -> DataFrame:
    return additive.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, folder, "documents"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.manifest(table(spark, folder, "documents"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op13_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, folder, "documents"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_shards": op2_shards,
    "op3_decontaminate": op3_decontaminate,
    "op4_simhash": op4_simhash,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_url_filter": op7_url_filter,
    "op8_html_text": op8_html_text,
    "op9_quality_score": op9_quality_score,
    "op10_quality_rules": op10_quality_rules,
    "op11_manifest": op11_manifest,
    "op12_whitening": op12_whitening,
    "op13_minhash": op13_minhash,
}
