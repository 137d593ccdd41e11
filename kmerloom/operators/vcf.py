"""Algebra of call sets: rows (chrom, pos, id, ref, alt, qual, filter, info map)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import reverse_complement

_SITE = ["chrom", "pos", "ref", "alt"]


def svtype(ref: Column, alt: Column) -> Column:
    """SNP, PH_SNPS, INV, INS, DEL, INDEL or COMPLEX of two alleles without padding."""
    n, m = F.length(ref), F.length(alt)
    return (
        F.when((n == 1) & (m == 1), "SNP").when((n == m) & (ref == reverse_complement(alt)), "INV").when(n == m, "PH_SNPS").when(n == 0, "INS").when(m == 0, "DEL")
        .when((n == 1) & (F.substring(alt, 1, 1) == ref), "INS").when((m == 1) & (F.substring(ref, 1, 1) == alt), "DEL").when((n < m) & (F.startswith(alt, ref) | F.endswith(alt, ref)), "INDEL")
        .when((m < n) & (F.startswith(ref, alt) | F.endswith(ref, alt)), "INDEL").otherwise("COMPLEX")
    )


def is_transition(ref: Column, alt: Column) -> Column:
    return F.concat(ref, alt).isin("AG", "GA", "CT", "TC")


def combine_filters(*named: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order, by commas; PASS if none does."""
    joined = F.concat_ws(",", *[F.when(c, F.lit(n)) for c, n in named])
    return F.when(joined == "", "PASS").otherwise(joined)


def drop_duplicates(calls: DataFrame, by: str | None = None, keep: str = "first", seed: int = 0) -> DataFrame:
    """One call of each (chrom, pos, ref, alt): the first or last by a column, one at random, or none of those that repeat."""
    if keep == "none":
        return calls.withColumn("_n", F.count("*").over(Window.partitionBy(*_SITE))).where("_n = 1").drop("_n")
    order = F.xxhash64(F.lit(seed), F.col(by or "id")) if keep == "random" else F.col(by or "id")
    return calls.withColumn("_n", F.row_number().over(Window.partitionBy(*_SITE).orderBy(order.desc() if keep == "last" else order.asc()))).where("_n = 1").drop("_n")


def combine_alleles(calls: DataFrame) -> DataFrame:
    """(chrom, pos, ref, alts): the alleles at one site in one row."""
    return calls.groupBy("chrom", "pos", "ref").agg(F.array_sort(F.collect_set("alt")).alias("alts"))


def remove_overlaps(calls: DataFrame, padding: int = 0, width: int = 1 << 16) -> DataFrame:
    """Calls whose reference span, widened by padding, meets no other's.

    Calls are sorted within windows of positions; two that meet have a window in
    common, so no task sorts a chromosome.
    """
    stop = F.col("pos") + F.greatest(F.length("ref"), F.lit(1)) - 1 + padding
    spans = calls.select(*_SITE, stop.alias("_end"))
    each = spans.withColumn("_w", F.explode(F.sequence(F.floor(F.col("pos") / width), F.floor(F.col("_end") / width))))
    order = Window.partitionBy("chrom", "_w").orderBy("pos", "ref", "alt")
    marked = each.withColumns({"_before": F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1)), "_after": F.lead("pos").over(order)})
    return calls.join(marked.where("_before >= pos OR _after <= _end").select(*_SITE).distinct(), _SITE, "left_anti")


def filter_regions(calls: DataFrame, regions: DataFrame) -> DataFrame:
    """Calls that start within a region (chrom, start, stop), by windows of positions rather than all pairs."""
    width = 1 << 14
    wide = regions.select("chrom", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))).alias("_w"))
    keyed = calls.withColumn("_w", F.floor(F.col("pos") / width))
    hit = (keyed["chrom"] == wide["chrom"]) & (keyed["_w"] == wide["_w"]) & (keyed["pos"] >= wide["start"]) & (keyed["pos"] <= wide["stop"])
    return keyed.join(wide, hit, "left_semi").drop("_w")


def ts_tv(calls: DataFrame) -> DataFrame:
    """(transitions, transversions) of the SNPs."""
    snps = calls.where((F.length("ref") == 1) & (F.length("alt") == 1))
    yes = is_transition(F.col("ref"), F.col("alt"))
    return snps.agg(F.count(F.when(yes, 1)).alias("transitions"), F.count(F.when(~yes, 1)).alias("transversions"))


def summary(calls: DataFrame) -> DataFrame:
    """(svtype, svlen, n): kinds and lengths of change."""
    return calls.groupBy(svtype(F.col("ref"), F.col("alt")).alias("svtype"), (F.length("alt") - F.length("ref")).alias("svlen")).agg(F.count("*").alias("n"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*_SITE).distinct(), _SITE, "left_semi")


def complement(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*_SITE).distinct(), _SITE, "left_anti")


def lines(calls: DataFrame, samples: list[str] | None = None, fields: str = "GT:COV:GT_CONF") -> DataFrame:
    """Text lines of a VCF body, tab separated; empty fields are dots.  samples: columns with a sample's cell each."""
    info = F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    cells = [F.when(F.coalesce(c.cast("string"), F.lit("")) == "", ".").otherwise(c.cast("string")) for c in (F.col("chrom"), F.col("pos"), F.col("id"), F.col("ref"), F.col("alt"), F.col("qual"), F.col("filter"), info)]
    if samples:
        cells += [F.lit(fields), *[F.coalesce(F.col(f"`{x}`"), F.lit(".")) for x in samples]]
    return calls.select(F.concat_ws("\t", *cells).alias("value"))


def csv(calls: DataFrame, tags: list[str]) -> DataFrame:
    """(chrom, pos, id, ref, alt, qual, filter, one column for each INFO tag), to be written as CSV."""
    return calls.select("chrom", "pos", "id", "ref", "alt", "qual", "filter", *[F.col("info")[t].alias(t) for t in tags])


def breakpoints(calls: DataFrame) -> DataFrame:
    """(id, chrom, start, stop): the first and last reference base that a change touches; of an insertion, those beside it."""
    gap = (F.length("ref") != F.length("alt")) & (F.substring("ref", 1, 1) == F.substring("alt", 1, 1))
    start = F.when(gap, F.col("pos") + 1).otherwise(F.col("pos"))
    stop = F.col("pos") + F.length("ref") - 1
    return calls.select("id", "chrom", F.least(start, stop).alias("start"), F.greatest(start, stop).alias("stop"))


def sampled(calls: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Each call with a probability, the same ones whenever it runs."""
    return calls.where(F.pmod(F.xxhash64(F.lit(seed), *_SITE), F.lit(1_000_000)) < int(share * 1_000_000))
