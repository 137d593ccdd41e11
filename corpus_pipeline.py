"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, and no others that docs may have.  Rows are told
apart as rows: ids may be null or stand on several, texts may be null, empty or
of any length, and equal rows are rows of their own, but for near_dedup, which is
there to drop them.  Without rows each stage has none.  The mix is in the order of the rows: the files
that mixing writes, and the rows within them, are in the order of the schedule,
and the last stage writes the tokens in that order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm import queries as q
from kmerloom.llm.decontaminate import decontaminated
from kmerloom.llm.mixing import mixed
from kmerloom.llm.resemblance import one_of_each
from kmerloom.llm.shared import written
from kmerloom.llm.tokens import token_files
from kmerloom.llm.toxicity import THRESHOLD, fit_labels, scored

#: Pieces that a worker's encoder keeps: its process serves the other stages too.
REMEMBERED = 100_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; null and empty texts have the score of no windows, ties with the threshold go."""
    model = fit_labels(docs, _table(spark, sf_dir, "labels"))
    return scored(docs.select(*COLUMNS), model, score_col="_score").where(F.col("_score") < THRESHOLD).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, five-word shingles at similarity 0.8 or more: the one with the smallest doc_id.

    SimHash anchors propose the nearest pairs, bands of minima the others, and all
    are verified on the shingles.  Null ids come last; texts without words are one
    group.
    """
    return one_of_each(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return decontaminated(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their rows in the order of the mix; a null source is a source of its own."""
    placed = mixed(docs.select(*COLUMNS))
    return placed.repartitionByRange("_slot", "_place").sortWithinPartitions("_slot", "_place").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(position, doc_id, start, n_tokens, ids_crc32) of each document, from token files in the order of the mix.

    That is the order of docs' files, by their numbers, and of the rows in them;
    docs that do not come from files are mixed again.
    """
    if _from_files(docs):
        number = lambda name: F.coalesce(F.regexp_extract("_metadata.file_name", f"{name}(\\d+)", 1).try_cast("long"), F.lit(0))
        order = [number("part-"), number("-c"), F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    else:
        docs = mixed(docs.select(*COLUMNS))
        order = [F.col("_slot"), F.col("_place")]
    return token_files(docs, q.tokenizer_path("byte_bpe_50k.json"), q.END_ID, order=order, remembered=REMEMBERED)


def _from_files(docs: DataFrame) -> bool:
    """Whether docs has files' hidden columns, as what comes straight from files does."""
    try:
        return bool(docs.select("_metadata.file_name", "_metadata.row_index").columns)
    except AnalysisException:
        return False


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: Neither the toxicity model nor the tokenizer can be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written as Parquet to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
