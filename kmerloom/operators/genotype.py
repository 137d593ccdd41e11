"""Reads on alleles and genotypes of variants, from coverage along their branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import genotype, genotype_confidence, log_likelihoods


def reads_on_allele(covgs: Column) -> Column:
    """Reads on a branch, from the coverages of its inner nodes: the first and every later rise."""
    rises = F.aggregate(F.sequence(F.lit(2), F.size(covgs)), F.lit(0).cast("long"), lambda a, i: a + F.greatest(F.lit(0).cast("long"), F.element_at(covgs, i) - F.element_at(covgs, i - 1)))
    return F.when(F.size(covgs) < 1, F.lit(0).cast("long")).when(F.size(covgs) < 2, covgs[0]).otherwise(covgs[0] + rises)


def median_covg(covgs: Column) -> Column:
    """The middle coverage; of two middle ones the floor of their mean."""
    s, n = F.array_sort(covgs), F.size(covgs)
    low = F.element_at(s, F.floor((n + 1) / 2).cast("int"))
    high = F.element_at(s, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n < 1, F.lit(0).cast("long")).otherwise(F.floor((low + high) / 2))


def min_covg(covgs: Column) -> Column:
    """The least coverage of a branch's inner nodes; 0 without any."""
    return F.coalesce(F.array_min(covgs), F.lit(0).cast("long"))


def constrained_median(covgs: Column, own: Column, limit: Column, extra_zero: bool = False) -> Column:
    """The median coverage of the nodes that only this branch has (own: an array of booleans) and whose coverage is below a limit.

    extra_zero: a 0 is sorted in with them, as where one slot too many is sorted.
    """
    kept = F.transform(F.filter(F.arrays_zip(covgs.alias("c"), own.alias("o")), lambda x: x["o"] & (x["c"] < limit)), lambda x: x["c"])
    return median_covg(F.concat(kept, F.array(F.lit(0).cast("long"))) if extra_zero else kept)


def effective_reads(covgs: Column, use_median: bool = False) -> Column:
    """Reads on a branch, by the rises of its coverage or by its median."""
    return median_covg(covgs) if use_median else reads_on_allele(covgs)


def effective_reads_on_own(covgs: Column, own: Column, read_length: Column, total_seq: Column, k: int, extra_zero: bool = False) -> Column:
    """Reads on the nodes that only this branch has, from their median; more where the branch is longer than a read holds k-mers.

    Nodes of twice the expected depth or more are taken for repeats.  Where the
    length or the bases of a colour's reads are not known, nothing is below the
    limit.
    """
    known = (F.coalesce(read_length, F.lit(0)) > 0) & (F.coalesce(total_seq, F.lit(0)) > 0)
    reach = F.when(known, read_length - k + 1).otherwise(100)
    depth = F.when(known, reach * F.floor(total_seq / F.when(known, read_length).otherwise(1))).otherwise(0)
    median = constrained_median(covgs, own, 2 * depth, extra_zero)
    n = F.size(covgs) + 1
    return F.when(F.size(covgs) < 1, F.lit(0).cast("long")).when(n > reach, F.floor((n + 0.5 * reach) / reach * median)).otherwise(median).cast("long")


def call(sites: DataFrame, theta1: Column, theta2: Column, error: float = 0.01, ploidy: int = 2, halved_twice: bool = False) -> DataFrame:
    """sites (c1, c2: reads on two branches) with three log-likelihoods, genotype and confidence; see log_likelihoods."""
    llk = {f"llk_{k}": F.round(v, 6) for k, v in log_likelihoods(F.col("c1"), F.col("c2"), theta1, theta2, error, ploidy, halved_twice).items()}
    out = sites.withColumns(llk)
    three = [F.col(c) for c in ("llk_hom1", "llk_het", "llk_hom2")]
    return out.withColumns({"gt": genotype(*three, F.col("c1") + F.col("c2")), "gt_conf": genotype_confidence(*three)})


BUBBLE, DIVERGENCE = "bubble", "divergence"


def regenotyped(variants: DataFrame, nodes: DataFrame, samples: DataFrame, k: int, genome_size: int, kind: str = BUBBLE, ploidy: int = 2, halved_twice: bool = False) -> DataFrame:
    """Variants of a call file in each colour: (var_id, colour, c1, c2, median1, median2, min1, min2, llk_hom1, llk_het, llk_hom2, gt, gt_conf).

    samples: (colour, mean_read_len, total_seq, error_rate) of the colours to
    genotype.  The k-mers of both branches are looked up in the graph, reads on
    either counted from their coverage, and the likelihoods taken at the colour's
    own depth and error rate.  halved_twice: heterozygous bubbles at a quarter of
    the depth; divergences never are.  A colour without bases has no depth and
    no call.
    """
    from .discovery import allele_coverages

    colours = sorted(r["colour"] for r in samples.select("colour").collect())  # a row for each colour
    held = allele_coverages(variants, nodes, k, colours, closed=kind == BUBBLE)
    counted = held.select("var_id", "colour", *[f(F.col(f"covgs{i}")).alias(f"{name}{i}") for name, f in (("c", reads_on_allele), ("median", median_covg), ("min", min_covg)) for i in (1, 2)])
    length = F.expr("nullif(mean_read_len, 0)")
    theta = F.col("total_seq") / float(genome_size) * (length - k + 1) / length
    rows = counted.join(F.broadcast(samples.select("colour", theta.alias("theta"), F.coalesce("error_rate", F.lit(0.01)).alias("error_rate"))), "colour")
    found = rows.where("theta > 0")
    llk = {}
    for name in ("hom1", "het", "hom2"):
        llk[f"llk_{name}"] = F.round(log_likelihoods(F.col("c1"), F.col("c2"), F.col("theta"), F.col("theta"), F.col("error_rate"), ploidy, halved_twice and kind == BUBBLE)[name], 6)
    found = found.withColumns(llk)
    three = [F.col(c) for c in llk]
    found = found.withColumns({"gt": genotype(*three, F.col("c1") + F.col("c2")), "gt_conf": genotype_confidence(*three)})
    none = rows.where("theta IS NULL OR theta <= 0").withColumns({c: F.lit(None).cast("double") for c in (*llk, "gt_conf")}).withColumn("gt", F.lit("NO_CALL"))
    return found.unionByName(none).drop("theta", "error_rate")


def sample_columns(calls: DataFrame, colours: list[str]) -> DataFrame:
    """(var_id, one column for each colour: GT:COV:GT_CONF) of regenotyped variants, as a VCF's sample cells."""
    gt = F.when(F.col("gt") == "HOM1", "0/0").when(F.col("gt") == "HET", "0/1").when(F.col("gt") == "HOM2", "1/1").otherwise("./.")
    cell = F.concat_ws(":", gt, F.concat_ws(",", F.col("c1").cast("string"), F.col("c2").cast("string")), F.when(F.col("gt_conf").isNull(), ".").otherwise(F.format_string("%.2f", F.col("gt_conf"))))
    return calls.withColumn("_c", cell).groupBy("var_id").pivot("colour", colours).agg(F.first("_c"))


def error_rate(alleles: DataFrame, default: float = 0.01) -> DataFrame:
    """(colour, seq_err): of alleles that are known to be absent, those seen once over those seen at most once."""
    n = lambda r: F.count(F.when(F.col("reads") == r, 1))
    return alleles.groupBy("colour").agg(F.when(n(0) + n(1) > 0, n(1) / (n(0) + n(1))).otherwise(F.lit(default)).alias("seq_err"))


def cleaning_threshold(hist: DataFrame, depth: float) -> int:
    """The coverage below which k-mers are errors, from (covg, n): where the counts stop falling, by ratios of neighbours."""
    rows = {r["covg"]: r["n"] for r in hist.groupBy("covg").agg(F.sum("n").alias("n")).where(F.col("covg") <= 10_001).collect()}  # at most 10,001 bins
    ratio = {c: rows[c] / rows[c + 1] for c in sorted(rows) if rows.get(c + 1)}
    first = next((c for c in sorted(ratio) if ratio[c] < 1), None)
    if first is not None and first < 0.75 * depth:
        return first
    second = {c: ratio[c] / ratio[c + 1] for c in sorted(ratio) if ratio.get(c + 1)}
    found = next((c for c in sorted(second) if second[c] <= 1), None)
    return found if found is not None else max(1, -(-int(depth) // 2))
