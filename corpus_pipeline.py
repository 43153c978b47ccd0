"""From raw documents to token ids: quality rules, near-dedup, repeated passages, benchmark, tokens.

Every stage takes what its predecessor kept and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm import benchmark, pieces, quality_rules, repeats, simhash
from muster.llm.common import table
from muster.llm.queries import PASSAGE_WORDS, PIECE_MODEL
from muster.session import work_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated strings; a document of which nothing is left stays, empty."""
    found = repeats.remove_repeats(docs, words=PASSAGE_WORDS)
    texts = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*[texts.get(c, F.col(c)).alias(c) for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return benchmark.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.tokenize(docs.select("doc_id", "text"), PIECE_MODEL).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", good_quality),
    ("simhash_near_dedup", one_of_near_duplicates),
    ("suffix_array_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("sentencepiece", tokens),
]

#: The stages on repeated passages and tokens are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
