"""K-mer coverage of a stream of reads: an addition, the batch graph has no counterpart of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import contigs
from ..operators.graph import _counted, nodes_type


def running_coverage(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, colour, covg) so far, for outputMode complete or update."""
    found = contigs(reads, k).select(F.col("sample").alias("colour"), "seq").mapInArrow(_counted(k), nodes_type(k))
    return found.groupBy("kmer", "colour").agg(F.sum("covg").alias("covg"))
