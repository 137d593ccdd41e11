"""Genome complexity, random walks, strands, simulated chromosomes; error nets; conversions of call sets."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kmerloom.operators import complexity, filters, graph, population, vcf

_C = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(_C)[::-1]


def bases(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def union(spark, seqs, k):
    rows = [("s", i, 0, s, None) for i, s in enumerate(seqs)]
    return graph.union_of_colours(graph.build(filters.contigs(spark.createDataFrame(rows, "sample string, read_id long, mate int, seq string, qual string"), k), k)).cache()


def test_genome_complexity(spark):
    k = 11
    genome = bases(400, 1) + bases(60, 2) * 2  # a repeat
    other = "".join({"A": "C", "C": "G", "G": "T", "T": "A"}[c] if i % 90 == 45 else c for i, c in enumerate(genome))
    nodes = union(spark, [genome, other], k)
    words, steps = set(), {}
    for g in (genome, other):
        words |= {min(g[i : i + k], rc(g[i : i + k])) for i in range(len(g) - k + 1)}
        for i in range(len(g) - k):
            for w, b in ((g[i : i + k], g[i + k]), (rc(g[i + 1 : i + k + 1]), rc(g[i])[0])):
                steps.setdefault(w, set()).add(b)
    reads = [genome[i : i + 40] for i in range(0, len(genome) - 40, 7)] + [bases(40, 9), "ACGT", "N" * 40]
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    two = {r["id"]: (r["ref"], r["alt"]) for r in complexity.changed_in_the_middle(df, k, 3).collect()}
    assert all(len(a) == 2 * k + 1 and [i for i in range(len(a)) if a[i] != b[i]] == [k] for a, b in two.values())
    used = clean = 0
    for _, (ref, alt) in sorted(two.items()):
        if any(min(ref[i : i + k], rc(ref[i : i + k])) not in words for i in range(k + 2)):
            continue
        used += 1
        clean += all(len(steps.get(s[i : i + k], ())) == 1 for s in (ref, alt) for i in range(k + 1) if min(s[i : i + k], rc(s[i : i + k])) in words)
    assert tuple(complexity.genome_complexity(df, nodes, k, 3).first()) == (used, clean, clean / used) and 0 < clean < used
    assert tuple(complexity.genome_complexity(df.where("read_id < 0"), nodes, k).first()) == (0, 0, None)
    assert complexity.genome_complexity(df, nodes, k, 3, most=5).first()["used"] == 5


@pytest.mark.parametrize("k", [9, 33])
def test_padding_walks_along_the_graph(spark, k):
    genome = bases(120, 4)
    nodes = union(spark, [genome], k)
    reads = spark.createDataFrame([(1, genome[:60], "x"), (2, rc(genome)[:50], "y"), (3, bases(50, 8), "z"), (4, genome[70:], "end")], "id long, seq string, name string")
    got = {r["id"]: r["seq"] for r in complexity.padded(reads, nodes, k, 5).collect()}
    assert got == {1: genome[:65], 2: rc(genome)[:55], 3: bases(50, 8) + "AAAAA", 4: genome[70:] + "AAAAA"}
    assert complexity.padded(reads, nodes, k, 0) is reads


def test_strands(spark):
    k, ref = 9, bases(100, 5)
    refs = spark.createDataFrame([("c", ref)], "chrom string, seq string")
    reads = spark.createDataFrame([(1, ref[10:40], "ab"), (2, rc(ref[10:40]), "ab"), (3, bases(30, 77), "ab"), (4, "AC", None)], "id long, seq string, qual string")
    got = {r["id"]: (r["seq"], r["qual"], r["turned"]) for r in complexity.on_reference_strand(reads, refs, k).collect()}
    assert got == {1: (ref[10:40], "ab", False), 2: (ref[10:40], "ba", True), 3: (bases(30, 77), "ab", False), 4: ("AC", None, False)}


def test_simulated_chromosomes(spark):
    made = complexity.random_chromosome(spark, "c", 40_000, 1).first()
    assert len(made["seq"]) == 40_000 and set(made["seq"]) == set("ACGT") and made == complexity.random_chromosome(spark, "c", 40_000, 1).first()
    refs = spark.createDataFrame([("c", made["seq"][:5000] + "N"), ("d", "")], "chrom string, seq string")
    new, truth = complexity.simulated_chromosomes(refs, 0.01, 2)
    seq = list(made["seq"][:5000] + "N")
    calls = truth.collect()
    assert 20 < len(calls) < 90
    for r in calls:
        assert seq[r["pos"] - 1] == r["ref"] != r["alt"]
        seq[r["pos"] - 1] = r["alt"]
    assert {r["chrom"]: r["seq"] for r in new.collect()} == {"c": "".join(seq)}


@pytest.mark.parametrize("cleaned", [False, True])
def test_nets(spark, cleaned):
    df = spark.createDataFrame([(2, 0, 1), (0, 0, 0)], "a int, b int, c int")
    got = [r[0] for r in df.select(population.net_llk([F.col("a"), F.col("b"), F.col("c")], F.lit(0.01), F.lit(100.0), cleaned)).collect()]
    p = 2 if cleaned else 1
    one, three = 0.01**p * 100, 0.01 ** (3 * p) * 100
    assert got == pytest.approx([-one + 2 * math.log(one) - math.log(2) - three + math.log(three), 0.0])
    alleles = spark.createDataFrame([("s", "a", 20, 10, 5, 4), ("s", "b", 1, 10, 5, 4)], "site string, allele string, reads long, nodes long, shared long, shared_nodes long")
    nets = spark.createDataFrame([("s", "a", "a", 1, 0, 0), ("s", "a", "b", 0, 0, 0), ("s", "b", "b", 9, 9, 2)], "site string, first string, second string, n1_net int, n2_net int, n3_net int")
    best = population.best_genotypes(population.site_genotypes(alleles, 40.0, 20, nets=nets, total_length=50, cleaned=cleaned)).first()
    assert (best["first"], best["second"]) == ("a", "a")


def test_conversions(spark):
    rows = [("1", 10, "a", "A", "G", ".", "PASS", {"K": "1"}), ("1", 10, "b", "A", "G", ".", "PASS", {}), ("1", 30, "d", "ACC", "A", ".", "PASS", {"K": "2"}), ("1", 40, "e", "A", "ACC", ".", "PASS", {})]
    calls = spark.createDataFrame(rows, "chrom string, pos long, id string, ref string, alt string, qual string, filter string, info map<string,string>")
    assert [r["K"] for r in vcf.csv(calls, ["K"]).orderBy("id").collect()] == ["1", None, "2", None]
    assert {r["id"]: (r["start"], r["stop"]) for r in vcf.breakpoints(calls).collect()} == {"a": (10, 10), "b": (10, 10), "d": (31, 32), "e": (40, 41)}
    kept = vcf.drop_duplicates(calls, keep="random", seed=1)
    assert kept.count() == 3 and kept.collect() == vcf.drop_duplicates(calls, keep="random", seed=1).collect()
    wide = calls.withColumn("s1", F.lit("0/1:1,2:3.00")).withColumn("s2", F.lit(None).cast("string"))
    line = vcf.lines(wide, ["s1", "s2"]).first()[0].split("\t")
    assert line[8:] == ["GT:COV:GT_CONF", "0/1:1,2:3.00", "."]
    assert vcf.sampled(calls, 1.0).count() == 4 and vcf.sampled(calls, 0.0).count() == 0
    site = vcf.intersect(calls, calls.where("id = 'd'"))
    assert [r["id"] for r in site.collect()] == ["d"] and vcf.complement(calls, calls.where("id = 'd'")).count() == 3
