"""Whether a bubble is a variant, an error or a repeat, from its coverage over samples; sites of several alleles.

Column expressions over arrays: no Python in the rows' path.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COPIES = range(1, 11)
#: Lanczos coefficients for g = 7 (fixed values).
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of a number of 0.5 or more; smaller ones by one step of the recurrence."""
    z = F.when(x < 0.5, x).otherwise(x - 1)
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + i)
    t = z + 7.5
    whole = F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(series)
    return F.when(x < 0.5, whole - F.log(x)).otherwise(whole)


def log_beta(a: Column, b: Column) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def coverage_llk(total: Column, n: Column, mean: Column, copies: int, spread: float = 2.0) -> Column:
    """The log-likelihood, up to a constant, of the reads at a site of so many copies; the variance is spread times the mean."""
    a = mean * (2 * copies / (spread - 1))
    return total * math.log(copies) + a * F.log(a) - log_gamma(a) + log_gamma(a + total) - (a + total) * F.log(a + mean * n * (2 * copies))


def classify(sites: DataFrame, ploidy: int = 2, error: float = 0.01, balance: float = 2.0, err_scale: float = 100.0) -> DataFrame:
    """sites (c1, c2: arrays of reads on either branch, one for each sample; mean: expected reads on a copy) with llk_variant, llk_error, llk_repeat, model and confidence.

    Coverage is overdispersed over copy numbers 1 to 10.  A variant's balance
    integrates allele frequencies on a grid under Hardy-Weinberg shares; an
    error's and a repeat's are beta-binomial.  Sites without samples or without
    reads have no model.  Ties: variant, error, repeat.
    """
    if ploidy not in (1, 2):
        raise ValueError("ploidy is 1 or 2")
    n, s1, s2 = F.size("c1"), _sum(F.transform("c1", lambda x: x.cast("double"))), _sum(F.transform("c2", lambda x: x.cast("double")))
    usable = F.coalesce((n > 0) & (F.size("c2") == n) & (F.col("mean") > 0), F.lit(False))
    rows = sites.withColumns({"_n": n, "_s1": s1, "_s2": s2})
    total = F.col("_s1") + F.col("_s2")
    raw = rows.withColumn("_cov", F.array(*[coverage_llk(total, F.col("_n"), F.col("mean"), g) for g in COPIES]))
    raw = raw.withColumn("_one", F.col("_cov")[0] - F.array_max("_cov"))
    low, high = F.least("_s1", "_s2"), F.greatest("_s1", "_s2")
    bal_err = log_beta(err_scale * error + low, err_scale + high) - log_beta(F.lit(err_scale * error), F.lit(err_scale))
    bal_rep = log_beta(balance + F.col("_s1"), balance + F.col("_s2")) - log_beta(F.lit(balance), F.lit(balance))
    # log-likelihood of each sample's reads under each genotype: the share of the first branch
    shares = [(g * (1 - error) + (2 - g) * error) / 2 for g in ((2, 1, 0) if ploidy == 2 else (2, 0))]
    per = F.zip_with("c1", "c2", lambda a, b: F.array(*[a * math.log(e) + b * math.log(1 - e) for e in shares]))
    step = 1 / (2 * F.col("_n"))
    grid = F.transform(F.sequence(F.lit(1), 2 * F.col("_n") - 1), lambda i: i * step)

    def at(f: Column) -> Column:
        weights = [(1 - f) * (1 - f), 2 * f * (1 - f), f * f] if ploidy == 2 else [1 - f, f]

        def one(x: Column) -> Column:
            top = F.array_max(x)
            mixed = weights[0] * F.exp(x[0] - top)
            for i, w in enumerate(weights[1:], 1):
                mixed = mixed + w * F.exp(x[i] - top)
            return F.log(mixed) + top

        return F.aggregate(F.col("_per"), F.lit(0.0), lambda acc, x: acc + one(x))

    raw = raw.withColumn("_per", per)
    raw = raw.withColumn("_f", F.when(usable, grid))
    raw = raw.withColumn("_lf", F.transform("_f", at)).withColumn("_prior", F.transform("_f", lambda f: 1 / (f * (1 - f))))
    top = F.array_max("_lf")
    mass = _sum(F.zip_with("_lf", "_prior", lambda x, p: p * F.exp(x - top)))
    bal_var = top + F.log(mass / _sum(F.col("_prior")))
    out = raw.withColumns({"llk_variant": F.when(usable, F.col("_one") + bal_var), "llk_error": F.when(usable, F.col("_one") + bal_err), "llk_repeat": F.when(usable, bal_rep)})
    three = [F.col(c) for c in ("llk_variant", "llk_error", "llk_repeat")]
    best = F.greatest(*three)
    model = F.when(~usable | (total <= 0), F.lit(None)).when(three[0] == best, "variant").when(three[1] == best, "error").otherwise("repeat")
    ranked = F.sort_array(F.array(*three), asc=False)
    return out.withColumns({"model": model, "confidence": ranked[0] - ranked[1]}).drop("_n", "_s1", "_s2", "_cov", "_one", "_per", "_f", "_lf", "_prior")


def net_llk(counts: list[Column], rate: Column, total_length: Column, cleaned: bool = False) -> Column:
    """The log-likelihood of errors one, two and three changes away from a genotype's alleles: Poisson, each only where there are some.

    rate: of errors a base.  In a cleaned graph an error must have been made twice, so the rates are squared.
    """
    out = F.lit(0.0)
    for power, count in enumerate(counts, 1):
        mean = F.pow(rate, F.lit(float(power * (2 if cleaned else 1)))) * total_length
        out = out + F.when(count > 0, -mean + count * F.log(mean) - log_gamma(count + 1)).otherwise(0.0)
    return out


def site_genotypes(alleles: DataFrame, depth: float, read_length: int, error: float = 0.01, nets: DataFrame | None = None, total_length: int = 0, cleaned: bool = False, trailing_doubled: bool = False) -> DataFrame:
    """(site, first, second, llk): each genotype first <= second of each site, from alleles (site, allele, reads: on what it has of its own, nodes: their number, shared: reads on the part all alleles share, shared_nodes).

    Poisson on the part of each allele of the genotype, at its number of copies.
    Reads on other alleles are errors, at a flat rate; or, with nets (site, first,
    second, n1_net, n2_net, n3_net: errors one to three changes away), by net_llk.  The shared
    part is at two copies; trailing_doubled: at one, as where only a trailing
    shared part is at two.
    """
    rate = depth / read_length / 2
    both = alleles.select("site", F.col("allele").alias("second"), F.col("reads").alias("r2"), F.col("nodes").alias("n2"))
    totals = alleles.groupBy("site").agg(F.sum("reads").alias("all"), F.max("shared").alias("shared"), F.max("shared_nodes").alias("shared_nodes"))
    pairs = alleles.select("site", F.col("allele").alias("first"), F.col("reads").alias("r1"), F.col("nodes").alias("n1")).join(both, "site").where("first <= second").join(totals, "site")

    def chunk(c: Column, n: Column, copies: int) -> Column:
        return F.when(n > 0, c * F.log(F.greatest(n, F.lit(1)) * (rate * copies)) - n * (rate * copies) - log_gamma(c + 1)).otherwise(0.0)

    same = F.col("first") == F.col("second")
    own = F.when(same, chunk(F.col("r1"), F.col("n1"), 2)).otherwise(chunk(F.col("r1"), F.col("n1"), 1) + chunk(F.col("r2"), F.col("n2"), 1))
    shared = chunk(F.col("shared"), F.col("shared_nodes"), 1 if trailing_doubled else 2)
    if nets is None:
        wrong = (F.col("all") - F.when(same, F.col("r1")).otherwise(F.col("r1") + F.col("r2"))) * math.log(error)
    else:
        pairs = pairs.join(nets, ["site", "first", "second"], "left").fillna(0, ["n1_net", "n2_net", "n3_net"] if "n1_net" in nets.columns else [])
        wrong = net_llk([F.col("n1_net"), F.col("n2_net"), F.col("n3_net")], F.lit(error), F.lit(float(total_length)), cleaned)
    return pairs.select("site", "first", "second", (own + shared + wrong).alias("llk"))


def best_genotypes(genotypes: DataFrame) -> DataFrame:
    """(site, first, second, llk, confidence): the likeliest genotype of each site and its lead on the next; of equal ones the first in order."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("llk")).alias("worse"), "first", "second")))
    one = genotypes.groupBy("site").agg(ranked.alias("g"))
    return one.select("site", F.col("g")[0]["first"].alias("first"), F.col("g")[0]["second"].alias("second"), (-F.col("g")[0]["worse"]).alias("llk"), F.when(F.size("g") > 1, F.col("g")[1]["worse"] - F.col("g")[0]["worse"]).alias("confidence"))
