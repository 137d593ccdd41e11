"""The graph engine against brute force over small reads."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import dna
from kmerloom.operators import filters, genotype, graph, unitigs, vcf
from kmerloom.sources import reads as sources

READS = "sample string, read_id long, mate int, seq string, qual string"
_C = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(_C)[::-1]


def contigs_of(spark, seqs, k, sample="s"):
    return filters.contigs(spark.createDataFrame([(sample, i, 0, s, None) for i, s in enumerate(seqs)], READS), k)


def brute(seqs, k):
    covg, edges = Counter(), defaultdict(int)
    for seq in seqs:
        for part in seq.upper().replace("N", " ").split():
            for i in range(len(part) - k + 1):
                w = part[i : i + k]
                u = min(w, rc(w))
                covg[u] += 1
                edges[u] |= 0
                if i + k < len(part):
                    edges[u] |= 1 << "ACGT".index(part[i + k]) + (0 if u == w else 4)
                if i:
                    edges[u] |= 1 << "ACGT".index(rc(part[i - 1])) + (4 if u == w else 0)
    return {u: (covg[u], edges[u]) for u in covg}


def random_dna(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def as_dict(nodes, k):
    return {r["w"]: (r["covg"], r["edges"]) for r in nodes.select(dna.unpacked(F.col("kmer"), k).alias("w"), "covg", "edges").collect()}


@pytest.mark.parametrize("k", [3, 11, 31])
def test_build_counts_kmers_and_edges(spark, k):
    seqs = [random_dna(200, 1), random_dna(90, 2) + "N" + random_dna(50, 3), random_dna(200, 1)[50:120].lower(), "", "A" * 40, "ACG"]
    assert as_dict(graph.build(contigs_of(spark, seqs, k), k), k) == brute(seqs, k)


def test_even_k_is_refused(spark):
    with pytest.raises(ValueError):
        graph.build(contigs_of(spark, ["ACGT"], 3), 4)


def test_packed_reverse_complement(spark):
    k, s = 7, "ACCGTTA"
    codes = int("".join(format("ACGT".index(c), "02b") for c in s), 2)
    got = spark.createDataFrame([(codes,)], "x long").select(dna.unpacked(dna.packed_reverse_complement(F.col("x"), k), k)).first()[0]
    assert got == rc(s)


def test_quality_and_homopolymer_breaks(spark):
    df = spark.createDataFrame([("s", 0, 0, "ACGTACGTAC", "IIIII!IIII"), ("s", 1, 0, "ACAAAAATCGG", None)], READS)
    got = sorted((r["read_id"], r["seq"]) for r in filters.contigs(df, 3, quality=5, homopolymer=4).collect())
    assert got == [(0, "ACGTA"), (0, "GTAC"), (1, "ACAAA"), (1, "TCGG")]


def union(spark, seqs, k):
    return graph.union_of_colours(graph.build(contigs_of(spark, seqs, k), k))


def test_one_read_is_one_supernode(spark):
    seq = random_dna(300, 7)
    got = unitigs.once(unitigs.unitigs(union(spark, [seq, seq], 15), 15)).collect()
    assert [(r["seq"], r["n_edges"], r["min_covg"]) for r in got] == [(min(seq, rc(seq)), 285, 2)]


def test_loop_is_cut(spark):
    ring = random_dna(60, 9)
    got = unitigs.once(unitigs.unitigs(union(spark, [ring + ring[:15]], 15), 15)).collect()
    assert len(got) == 1 and got[0]["is_cycle"] and got[0]["n_edges"] == 60


def test_supernodes_hold_every_edge(spark):
    """An edge is a (k+1)-mer in either direction; one that is its own reverse complement is stored once."""
    seqs = [random_dna(400, 4), random_dna(200, 5) + random_dna(400, 4)[100:180] + random_dna(100, 6)]
    edges = {min(s[i : i + 12], rc(s[i : i + 12])) for s in seqs for i in range(len(s) - 11)}
    found = [r["seq"] for r in unitigs.once(unitigs.unitigs(union(spark, seqs, 11), 11)).collect()]
    held = Counter(min(s[i : i + 12], rc(s[i : i + 12])) for s in found for i in range(len(s) - 11))
    assert set(held) == edges
    assert all(n == 1 for e, n in held.items() if not any(s == rc(s) and (e in s or rc(e) in s) for s in found))


def test_snp_is_a_bubble_and_low_coverage_goes(spark):
    a = random_dna(200, 11)
    b = a[:100] + ("A" if a[100] != "A" else "C") + a[101:]
    nodes = union(spark, [a, a, a, b], 15)
    found = unitigs.bubbles(nodes, 15).collect()
    assert len(found) == 1 and {len(found[0]["branch1"]), len(found[0]["branch2"])} == {16}
    cleaned = as_dict(unitigs.remove_low_coverage_supernodes(nodes, 15, 1), 15)
    assert set(cleaned) == set(brute([a], 15))


def test_tip_is_clipped(spark):
    a = random_dna(200, 12)
    tip = random_dna(4, 13) + a[80:120]
    if tip[3] == a[79]:
        tip = tip[:3] + rc(a[79]) + tip[4:]
    assert set(as_dict(unitigs.clip_tips(union(spark, [a, tip], 15), 15), 15)) == set(brute([a], 15))


def test_colours(spark):
    a, b = random_dna(100, 21), random_dna(100, 22)
    nodes = graph.merge(graph.build(contigs_of(spark, [a], 11, "x"), 11).unionByName(graph.build(contigs_of(spark, [a, b], 11, "y"), 11)))
    assert {(r["a"], r["b"]): r["n"] for r in graph.colour_overlaps(nodes).collect()} == {("x", "x"): 90, ("x", "y"): 90, ("y", "x"): 90, ("y", "y"): 180}
    assert {r["n_colours"]: r["n"] for r in graph.sharing(nodes).collect()} == {1: 90, 2: 90}
    mosaic = a[:50] + b[:30]
    gene = spark.createDataFrame([("g", mosaic)], "id string, seq string")
    held = [[min(s[i : i + 11], rc(s[i : i + 11])) for i in range(len(s) - 10)] for s in (mosaic, a, b)]
    in_x, in_y = sum(w in held[1] for w in held[0]), sum(w in held[1] + held[2] for w in held[0])
    got = {r["colour"]: r["fraction"] for r in graph.pan_genome_matrix(gene, nodes, 11, "id").collect()}
    assert got["x"] == round(in_x / 70, 2) and got["y"] == round(in_y / 70, 2)
    wide = graph.align(gene, nodes, 11, "id", ["x", "y"]).orderBy("pos").collect()
    assert len(wide) == 70 and wide[0]["y"] == 1 and wide[69]["x"] == 0
    assert graph.health_check(graph.union_of_colours(nodes), 11).count() == 0
    assert graph.overlap_with_clean(nodes, graph.union_of_colours(nodes, ["x"])).where("colour = 'y'").count() == 90
    novel = unitigs.novel_contigs(graph.union_of_colours(nodes), nodes.where("colour = 'x'"), 11, 50, 100).collect()
    assert [r["seq"] for r in novel] == [min(b, rc(b))]


def test_genotypes_and_reads(spark):
    df = spark.createDataFrame([(20, 0), (10, 10), (0, 20), (0, 0)], "c1 long, c2 long")
    got = {(r["c1"], r["c2"]): r["gt"] for r in genotype.call(df, F.lit(20.0), F.lit(20.0)).collect()}
    assert got == {(20, 0): "HOM1", (10, 10): "HET", (0, 20): "HOM2", (0, 0): "NO_CALL"}
    c = spark.createDataFrame([([3, 5, 4, 6],), ([],), ([2],)], "c array<long>")
    assert [(r[0], r[1]) for r in c.select(genotype.reads_on_allele(F.col("c")), genotype.median_covg(F.col("c"))).collect()] == [(7, 4), (0, 0), (2, 2)]


def test_call_sets(spark):
    rows = [("1", 10, "a", "A", "G"), ("1", 10, "b", "A", "G"), ("1", 10, "c", "A", "T"), ("1", 30, "d", "ACC", "A"), ("1", 31, "e", "C", "T"), ("2", 5, "f", "C", "G")]
    calls = spark.createDataFrame(rows, "chrom string, pos long, id string, ref string, alt string")
    assert sorted(r["id"] for r in vcf.drop_duplicates(calls).collect()) == ["a", "c", "d", "e", "f"]
    assert sorted(r["id"] for r in vcf.drop_duplicates(calls, keep="none").collect()) == ["c", "d", "e", "f"]
    assert [r["id"] for r in vcf.remove_overlaps(calls).collect()] == ["f"]
    assert vcf.ts_tv(calls).first() == (3, 2)
    regions = spark.createDataFrame([("1", 9, 12), ("1", 11, 20000)], "chrom string, start long, stop long")
    assert sorted(r["id"] for r in vcf.filter_regions(calls, regions).collect()) == ["a", "b", "c", "d", "e"]
    assert {tuple(r["alts"]) for r in vcf.combine_alleles(calls).where("pos = 10").collect()} == {("G", "T")}


def test_sources(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 x\nACGT\nacg\n>r2\nNNA\n")
    (tmp_path / "b.fq").write_text("@q1\nACG\n+\nIII\n@q2\nACGT\n+\nII\n")
    (tmp_path / "c.sam").write_text("@HD\tVN:1\nr\t16\tc\t1\t9\t3M\t*\t0\t0\tAAC\tABC\n")
    (tmp_path / "l.falist").write_text("a.fa\tme\n")
    assert [(r["name"], r["seq"]) for r in sources.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("read_id").collect()] == [("r1 x", "ACGTacg"), ("r2", "NNA")]
    assert [(r["name"], r["qual"]) for r in sources.read_fastq(spark, str(tmp_path / "b.fq")).collect()] == [("q1", "III")]
    assert [(r["seq"], r["qual"]) for r in sources.read_sam(spark, str(tmp_path / "c.sam")).collect()] == [("GTT", "CBA")]
    assert {r["sample"] for r in sources.read_list(spark, str(tmp_path / "l.falist")).collect()} == {"me"}


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
