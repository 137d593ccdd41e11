"""The queries over the driver's tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import contaminations
from .html import extract
from .licenses import license_report
from .mixing import schedule
from .oracle import ORACLES
from .ordermin import edit_fingerprints
from .simhash import near_duplicates
from .substrings import digest, remove_repeats
from .tokens import token_files
from .toxicity import toxicity
from .urls import url_verdicts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = token_files(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), END_ID)
    return held.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprints(_table(spark, sf_dir, "documents"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(remove_repeats(_table(spark, sf_dir, "documents")))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: The id that ends a document.
END_ID = 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_urls": op3_urls,
    "op4_html": op4_html,
    "op5_tokens": op5_tokens,
    "op6_fingerprints": op6_fingerprints,
    "op7_substrings": op7_substrings,
    "op8_licenses": op8_licenses,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
}
