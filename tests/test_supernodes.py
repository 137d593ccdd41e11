"""Supernode questions, cleaning, coverage of sequences and re-genotyping, against brute force over small graphs; both ways of ranking paths, packed and string k-mers."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import dna
from kmerloom.operators import coverage, discovery, filters, genotype, graph, supernodes, unitigs

READS = "sample string, read_id long, mate int, seq string, qual string"
_C = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(_C)[::-1]


def bases(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def build(spark, seqs, k):
    rows = [(c, i, 0, s, None) for i, (c, s) in enumerate(seqs)]
    return unitigs.written(graph.build(filters.contigs(spark.createDataFrame(rows, READS), k), k))


def union(nodes):
    return unitigs.written(graph.union_of_colours(nodes))


def words(df, k):
    return {r[0] for r in df.select(dna.kmer_text(F.col("kmer"), k)).collect()}


def canon(s, k):
    return {min(s[i : i + k], rc(s[i : i + k])) for i in range(len(s) - k + 1)}


@pytest.mark.parametrize(("k", "small"), [(15, 1 << 20), (15, 0), (33, 1 << 20), (33, 0)])
def test_paths_both_ways(spark, monkeypatch, k, small):
    monkeypatch.setattr(unitigs, "SMALL", small)
    a = bases(300, 1)
    b = a[:150] + ("A" if a[150] != "A" else "C") + a[151:]
    ring = bases(70, 9)
    nodes = union(build(spark, [("s", a)] * 3 + [("s", b), ("s", ring + ring[:k])], k))
    paths = unitigs.written(unitigs.unitigs(nodes, k))
    found = [r["seq"] for r in unitigs.once(paths).collect()]
    edges = {min(s[i : i + k + 1], rc(s[i : i + k + 1])) for s in (a, b, ring + ring[:k]) for i in range(len(s) - k)}
    held = Counter(min(s[i : i + k + 1], rc(s[i : i + k + 1])) for s in found for i in range(len(s) - k))
    assert set(held) == edges and set(held.values()) == {1}
    assert [r["n_edges"] for r in paths.where("is_cycle").collect()] == [70, 70]
    bubble = unitigs.bubbles(nodes, k).collect()
    assert len(bubble) == 1 and {len(bubble[0][c]) for c in ("branch1", "branch2")} == {k + 1}
    assert words(unitigs.smooth_bubbles(nodes, k, 1), k) == canon(a, k) | canon(ring + ring[:k], k)
    poor = unitigs.remove_poor_supernodes(nodes, k, 2)
    assert canon(a, k) <= words(poor, k) | canon(ring + ring[:k], k) and not (canon(b, k) - canon(a, k)) & words(poor, k)
    likely = unitigs.remove_likely_errors(nodes, k, 1)
    assert words(likely, k) == canon(a, k) | canon(ring + ring[:k], k)
    assert words(unitigs.prune(nodes, nodes.where("covg = 1"), k), k) == {w for w in words(nodes.where("covg > 1"), k)}
    assert unitigs.n50(unitigs.once(paths), k).first()["supernodes"] == len(found)
    assert {r["length"]: r["n"] for r in unitigs.length_distribution(unitigs.once(paths)).collect()} == Counter(map(len, found))


def by_kmer(df, k):
    return {r["w"]: r for r in df.withColumn("w", dna.kmer_text(F.col("kmer"), k)).collect()}


@pytest.mark.parametrize("k", [11, 33])
def test_supernode_questions(spark, k):
    a, b = bases(200, 21), bases(90, 22)
    fork = a[:100] + {"A": "C", "C": "G", "G": "T", "T": "A"}[a[100]] + b  # leaves a after 100 bases
    nodes = build(spark, [("x", a), ("y", fork), ("y", fork)], k)
    whole = union(nodes)
    paths = unitigs.written(supernodes.named(unitigs.once(unitigs.unitigs(whole, k))))
    seqs = {r["supernode"]: r["seq"] for r in paths.collect()}
    asked = whole.where("covg >= 0")
    places = supernodes.supernodes_of(asked, paths, k).withColumn("w", dna.kmer_text(F.col("kmer"), k)).collect()
    for r in places:
        word = r["seq"][r["pos"] : r["pos"] + k]
        assert seqs[r["supernode"]] == r["seq"] and word == (r["w"] if r["fw"] else rc(r["w"]))
    assert {r["w"] for r in places} == canon(a, k) | canon(fork, k)
    steps = supernodes.steps_of(paths).where("next IS NOT NULL").count()
    assert steps == sum(len(s) - k for s in seqs.values())
    ends = by_kmer(supernodes.is_end(whole, k).where("fw = true"), k)
    turned = by_kmer(supernodes.is_end(whole, k).where("fw = false"), k)
    last = a[100 - k : 100]  # where the two part
    assert (ends if last < rc(last) else turned)[min(last, rc(last))]["ends"]
    inner = a[20 : 20 + k]
    assert not ends[min(inner, rc(inner))]["ends"] and not turned[min(inner, rc(inner))]["ends"]
    in_y = nodes.where("colour = 'y'")
    n = lambda which, fitting: {r["seq"] for r in supernodes.where_nodes(paths, fitting, k, which).collect()}
    y_words = canon(fork, k)
    nodes_in = {s: [min(s[i : i + k], rc(s[i : i + k])) in y_words for i in range(len(s) - k + 1)] for s in seqs.values()}
    assert n(supernodes.ALL, in_y) == {s for s, v in nodes_in.items() if all(v)}
    assert n(supernodes.ANY, in_y) == {s for s, v in nodes_in.items() if any(v)}
    assert n(supernodes.ENDS, in_y) == {s for s, v in nodes_in.items() if v[0] and v[-1] and not all(v)}
    covered = {(seqs[r["supernode"]], r["colour"]): r["covgs"] for r in supernodes.coverage_by_colour(paths, nodes, k, ["x", "y"]).collect()}
    for s in seqs.values():
        own = [min(s[i : i + k], rc(s[i : i + k])) for i in range(len(s) - k + 1)]
        assert covered[s, "x"] == [int(w in canon(a, k)) for w in own] and covered[s, "y"] == [2 * (w in y_words) for w in own]
    best = {r["seq"] for r in supernodes.consensus(paths, nodes, k, 1, 2).collect()}
    shared = min(a[:100], rc(a[:100]))
    assert shared in best
    assert sum(r["share"] for r in supernodes.coverage_shares(paths, nodes, k).where("colour = 'x'").collect()) >= 0.99
    joined = supernodes.named(unitigs.once(unitigs.unitigs(union(build(spark, [("x", a[:120]), ("y", a[80:])], k)), k)))
    split = supernodes.splitting(joined, build(spark, [("x", a[:120]), ("y", a[80:])], k), k, "x", "y").collect()
    assert [(r["only_first"], r["only_second"], r["both"]) for r in split] == [(80, 80, 120 - 80 - k + 1)]
    assert supernodes.error_supernodes(paths, 1).first()["errors"] == 1
    assert sum(r["n"] for r in supernodes.junctions(paths).collect()) == len(seqs) and sum(r["n"] for r in supernodes.frequencies(paths).collect()) == len(seqs)
    assert supernodes.lines(paths).first()[0].startswith(">node_")


def test_sequences_in_a_graph(spark):
    k, rnd = 9, random.Random(3)
    a = bases(150, 31)
    nodes = build(spark, [("x", a), ("y", a[:60]), ("y", a[60 - k + 2 :])], k)  # y has all k-mers of a but one, and not all steps
    x, y = union(nodes.where("colour = 'x'")), union(nodes.where("colour = 'y'"))
    reads = []
    for _ in range(30):
        at = rnd.randrange(120)
        s = list(a[at : at + 30])
        for _ in range(rnd.randrange(3)):
            s[rnd.randrange(len(s))] = rnd.choice("ACGTN")
        reads.append("".join(s))
    reads += ["", "ACG", a[:k], rc(a), bases(40, 77)]
    seqs = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    for g, parts in ((x, [a]), (y, [a[:60], a[60 - k + 2 :]])):
        own = {w for p in parts for w in canon(p, k)}
        steps = {w for p in parts for w in canon(p, k + 1)}
        for edges in (False, True):
            want = set()
            for i, s in enumerate(reads):
                there = [min(s[j : j + k], rc(s[j : j + k])) in own for j in range(len(s) - k + 1)]
                start = None
                for j in range(len(there) + 1):
                    step = j < len(there) and there[j] and (not edges or start is None or min(s[j - 1 : j + k], rc(s[j - 1 : j + k])) in steps)
                    if start is not None and not step:
                        want.add((i, start, s[start : j - 1 + k]))
                        start = None
                    if j < len(there) and there[j] and start is None:
                        start = j
            got = {(r["id"], r["start"], r["seq"]) for r in coverage.broken_at_graph(seqs, g, k, "read_id", edges).collect()}
            assert got == want
            lying = {r["read_id"] for r in coverage.lying_in_graph(seqs, g, k, "read_id", edges).collect()}
            assert lying == {i for i, start, s in want if s == reads[i]}
    present = {r["id"] for r in coverage.paths_in_colour(seqs, nodes, k, "read_id", "y").where("present").collect()}
    assert present == {r["read_id"] for r in coverage.lying_in_graph(seqs, y, k, "read_id", True).collect()}
    some = spark.createDataFrame([(0, a[:40])], "read_id long, seq string")
    part = coverage.touched(some, nodes, k, "read_id")
    assert words(part, k) == canon(a[:40], k) and graph.health_check(union(part), k).count() == 0
    times = Counter(min(a[i : i + k], rc(a[i : i + k])) for i in range(len(a) - k + 1))
    got = {r["pos"]: r["times"] for r in coverage.uniqueness(spark.createDataFrame([("c", a)], "chrom string, seq string"), k, "chrom").collect()}
    assert got == {i: times[min(a[i : i + k], rc(a[i : i + k]))] for i in range(len(a) - k + 1)}
    refs = spark.createDataFrame([("c", a + "N" + a[20:60])], "chrom string, seq string")
    alleles = spark.createDataFrame([("twice", a[25:50]), ("once", a[70:100]), ("short", "AC")], "var_id string, seq string")
    assert {r["id"]: r["multicopy"] for r in coverage.multicopy(alleles, refs, k).collect()} == {"twice": True, "once": False, "short": False}
    two = [("v", 1, i, w) for i, w in enumerate(canon(a[:30], k))] + [("v", 2, i, w) for i, w in enumerate(canon(a[10:40], k))]
    code = lambda w: int("".join(format("ACGT".index(c), "02b") for c in w), 2)
    places = spark.createDataFrame([(i, w, p, code(x)) for i, w, p, x in two], "id string, which int, pos int, kmer long")
    got = {r["which"]: len(r["covgs"]) for r in coverage.unshared_coverage(places, nodes, "x").collect()}
    assert got == {1: len(canon(a[:30], k) - canon(a[10:40], k)), 2: len(canon(a[10:40], k) - canon(a[:30], k))}


def test_coverage_stats(spark):
    rows = spark.createDataFrame([([3, 1, 3, 0, 9],), ([2, 1],), ([],)], "c array<long>")
    got = [tuple(r[0]) for r in rows.select(coverage.covg_stats(F.col("c"))).collect()]
    assert got == [(0, 9, 3.2, 3, 40, 20), (1, 2, 1.5, 1, 50, 0), (None,) * 6]


def test_reads_on_branches(spark):
    rows = spark.createDataFrame([([4, 9, 2, 7], [True, True, False, True], 20, 400), ([4, 9, 2, 7], [True, True, False, True], None, None), ([], [], 20, 400), ([5] * 30, [True] * 30, 20, 4000)], "c array<long>, own array<boolean>, r long, t long")
    got = rows.select(genotype.min_covg(F.col("c")), genotype.constrained_median(F.col("c"), F.col("own"), F.lit(9)), genotype.constrained_median(F.col("c"), F.col("own"), F.lit(9), True), genotype.effective_reads_on_own(F.col("c"), F.col("own"), F.col("r"), F.col("t"), 11)).collect()
    # own nodes under 9: 4 and 7; with a zero more: 0, 4, 7
    assert [tuple(r) for r in got[:1]] == [(2, 5, 4, 7)]
    assert got[1][3] == 0 and tuple(got[2]) == (0, 0, 0, 0)
    assert got[3][3] == math.floor((31 + 0.5 * 10) / 10 * 5)


@pytest.mark.parametrize(("ploidy", "halved"), [(2, False), (2, True), (1, False)])
def test_regenotyping_end_to_end(spark, ploidy, halved):
    k, depth = 11, 10
    a = bases(200, 41)
    b = a[:100] + ("A" if a[100] != "A" else "C") + a[101:]
    reads = [("hom", a)] * depth + [("het", a)] * (depth // 2) + [("het", b)] * (depth // 2) + [("alt", b)] * depth
    nodes = build(spark, reads, k)
    found = discovery.numbered(discovery.call_bubbles(nodes, k, ["hom", "het", "alt"], ["hom", "het", "alt"]))
    call = found.first()
    one_is_a = call["branch1"] in a or call["branch1"] in rc(a)
    samples = spark.createDataFrame([(c, 200, 200 * depth, 0.01) for c in ("hom", "het", "alt")] + [("none", 0, 0, None)], "colour string, mean_read_len long, total_seq long, error_rate double")
    got = {r["colour"]: r for r in genotype.regenotyped(unitigs.written(found.select("var_id", "flank5p", "branch1", "branch2", "flank3p")), nodes, samples, k, 200, ploidy=ploidy, halved_twice=halved).collect()}
    theta = depth * (200 - k + 1) / 200
    lf = lambda n: sum(math.log(i) for i in range(2, n + 1))
    for colour, r in got.items():
        if colour == "none":
            assert r["gt"] == "NO_CALL" and r["gt_conf"] is None
            continue
        c1, c2 = r["c1"], r["c2"]
        h1 = c1 * math.log(theta) - theta - lf(c1) + max(0, c2 - 0.01 * theta) * math.log(0.01)
        h2 = c2 * math.log(theta) - theta - lf(c2) + max(0, c1 - 0.01 * theta) * math.log(0.01)
        part = theta / (4 if halved else 2)
        het = c1 * math.log(part) - part - lf(c1) + c2 * math.log(part) - part - lf(c2) if ploidy == 2 else h1 + h2 - 99999
        assert [r["llk_hom1"], r["llk_het"], r["llk_hom2"]] == pytest.approx([h1, het, h2], abs=1e-5)
        assert r["gt"] == max((h1, 2, "HOM1"), (het, 1, "HET"), (h2, 0, "HOM2"))[2]
        assert (r["median1"], r["median2"]) == (c1, c2) == (r["min1"], r["min2"])
    assert got["hom"]["gt"] == ("HOM1" if one_is_a else "HOM2") and got["alt"]["gt"] == ("HOM2" if one_is_a else "HOM1")
    if ploidy == 2:
        assert got["het"]["gt"] == "HET" and (got["het"]["c1"], got["het"]["c2"]) == (5, 5)
    cells = genotype.sample_columns(spark.createDataFrame([("v", "x", 3, 0, "HOM1", 12.3), ("v", "y", 0, 0, "NO_CALL", None)], "var_id string, colour string, c1 long, c2 long, gt string, gt_conf double"), ["x", "y"]).first()
    assert (cells["x"], cells["y"]) == ("0/0:3,0:12.30", "./.:0,0:.")


def test_thresholds_and_rates(spark):
    alleles = spark.createDataFrame([("x", 0)] * 3 + [("x", 1), ("x", 5), ("y", 7)], "colour string, reads long")
    assert {r["colour"]: r["seq_err"] for r in genotype.error_rate(alleles).collect()} == {"x": 0.25, "y": 0.01}
    hist = lambda *n: spark.createDataFrame(list(enumerate(n, 1)), "covg long, n long")
    assert genotype.cleaning_threshold(hist(1000, 200, 50, 40, 60, 90), 20.0) == 4
    assert genotype.cleaning_threshold(hist(100, 50, 40), 7.0) >= 1
    df = spark.createDataFrame([(400, 20, 5)], "t long, g long, r long")
    assert df.select(dna.expected_depth(F.col("t"), F.col("g"), F.col("r"), 3)).first()[0] == 400 / 20 * 3 / 5
    shares = spark.createDataFrame([("v", "x", 10, 0), ("v", "y", 0, 10), ("w", "x", 5, 5), ("w", "y", 5, 5), ("u", "x", 0, 0)], "var_id string, colour string, c1 long, c2 long")
    assert [tuple(r) for r in discovery.high_difference(shares).collect()] == [("v", 1.0)]
