"""What of a read is used: contigs between bad bases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contigs(reads: DataFrame, k: int, quality: int | None = None, offset: int = 33, homopolymer: int = 0) -> DataFrame:
    """(sample, read_id, mate, contig_no, seq): stretches of at least k good bases.

    Letters other than ACGT, in either case, break a read.  With a quality
    threshold so does a base whose quality is at most threshold + offset, if the
    read has qualities.  With a homopolymer limit, a run of so many equal bases
    ends a contig before its last allowed base and the next starts after the run.
    """
    seq = F.regexp_replace(F.upper("seq"), "[^ACGT]", "N")
    if quality is not None:
        low = F.transform(F.sequence(F.lit(1), F.length(seq)), lambda i: F.when(F.ascii(F.substring(F.col("qual"), i, F.lit(1))) <= quality + offset, "N").otherwise(F.substring(seq, i, F.lit(1))))
        seq = F.when(F.col("qual").isNotNull() & (F.length(seq) > 0), F.array_join(low, "")).otherwise(seq)
    if homopolymer:
        for base in "ACGT":
            seq = F.regexp_replace(seq, f"{base}{{{homopolymer},}}", base * (homopolymer - 1) + "N")
    parts = reads.select("sample", "read_id", "mate", F.posexplode(F.split(seq, "N+")).alias("contig_no", "seq"))
    return parts.where(F.length("seq") >= k)


def read_length_distribution(found: DataFrame) -> DataFrame:
    """(sample, length, n) of the contigs that are used."""
    return found.groupBy("sample", F.length("seq").alias("length")).agg(F.count("*").alias("n"))


def sample_metadata(found: DataFrame) -> DataFrame:
    """(sample, total_seq, mean_read_len): bases used and their integer mean length."""
    sums = found.groupBy("sample").agg(F.sum(F.length("seq")).alias("total_seq"), F.count("*").alias("n"))
    return sums.select("sample", "total_seq", F.expr("total_seq div n").alias("mean_read_len"))


def merge_metadata(samples: DataFrame) -> DataFrame:
    """One row of (total_seq, mean_read_len) of several, lengths weighted by bases, integer division."""
    sums = samples.agg(F.sum("total_seq").alias("total_seq"), F.sum(F.col("mean_read_len") * F.col("total_seq")).alias("w"))
    return sums.select("total_seq", F.expr("w div total_seq").alias("mean_read_len"))


def drop_duplicate_starts(found: DataFrame, k: int) -> DataFrame:
    """Of single reads that start with one k-mer on one strand, the first."""
    from pyspark.sql import Window

    order = Window.partitionBy("sample", F.substring("seq", 1, k)).orderBy("read_id", "contig_no")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def drop_duplicate_pairs(found: DataFrame, k: int) -> DataFrame:
    """Contigs of pairs (sample, read_id, mate, contig_no, seq) without those of duplicate pairs.

    A mate starts at its first contig's first k-mer and strand.  A pair is a
    duplicate if each mate that has a contig starts where a mate of an earlier
    pair (a lesser read_id) did.  A duplicate's starts are all marked already,
    so what is marked before a pair is the starts of all pairs before it: the
    first pair of each start decides, and no pair waits for another.
    """
    starts = found.groupBy("sample", "read_id", "mate").agg(F.min_by(F.substring("seq", 1, k), "contig_no").alias("start"))
    first = starts.groupBy("sample", "start").agg(F.min("read_id").alias("first"))
    fresh = starts.join(first, ["sample", "start"]).where("first = read_id").select("sample", "read_id").distinct()
    return found.join(fresh, ["sample", "read_id"], "left_semi")
