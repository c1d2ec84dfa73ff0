"""The corpus pipeline: quality, toxicity, exact copies, near copies, packing.

Each stage works on all that its predecessor kept and is written and read again before the
next one starts; what earlier stages of the same run wrote on the way is deleted then. SQL cannot express the
trained stages, so there is no ORACLE_SQL; the tests hold the result against a brute-force
version, also with null and repeated doc_ids, repeated rows and empty texts. A table without
rows gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvale.llm import exact_dedup, packing, quality, simhash, toxicity
from corvale.llm.bpe import default_tokenizer
from corvale.llm.common import forget, made, table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_best(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, default_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("toxicity", keep_clean),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("best_fit_packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, older = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        forget(spark, keep=docs, older=older)
    return docs
