"""Discovery, correction, classification and the call-set tools against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kmerloom.operators import callset, correction, discovery, fastn, filters, graph, population, vcf

CALL = "chrom string, pos long, id string, ref string, alt string, qual string, filter string, info map<string,string>"
READS = "sample string, read_id long, mate int, seq string, qual string"
_C = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(_C)[::-1]


def dna(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def calls_of(spark, rows):
    return spark.createDataFrame([(c, p, f"c{i}", r, a, "9", "PASS", {"N": str(i)}) for i, (c, p, r, a) in enumerate(rows)], CALL)


def nodes_of(spark, seqs, k):
    reads = spark.createDataFrame([(c, i, 0, s, None) for i, (c, s) in enumerate(seqs)], READS)
    return graph.build(filters.contigs(reads, k), k)


def test_pair_duplicates_against_running_history(spark):
    rng = random.Random(4)
    starts = [dna(9, s) for s in range(4)]
    pairs = [(i, rng.choice([*starts, None]), rng.choice([*starts, None])) for i in range(60)]
    rows = [("s", i, m, 0, x + "ACGT") for i, a, b in pairs for m, x in ((1, a), (2, b)) if x]
    found = spark.createDataFrame(rows, "sample string, read_id long, mate int, contig_no int, seq string")
    marked, kept = set(), set()
    for i, a, b in pairs:
        own = {x for x in (a, b) if x}
        if own and not own <= marked:
            kept.add(i)
            marked |= own
    assert {r[0] for r in filters.drop_duplicate_pairs(found, 9).select("read_id").collect()} == kept


def brute_correct(seq, qual, k, cutoff, policy, words):
    """Written out by itself: from the first k-mer in the graph to the right end, then to the left."""
    there = lambda w: not set(w) - set("ACGT") and min(w, rc(w)) in words
    poor = [i for i, q in enumerate(qual) if ord(q) < cutoff]
    if not poor:
        return ("uncorrected", [], seq, qual)
    starts = [i for i in range(len(seq) - k + 1) if there(seq[i : i + k])]
    if not starts:
        return ("discard" if policy == correction.DISCARD else "uncorrected", [], seq, qual)
    places = []
    todo = [(i, i + k - 1) for i in range(starts[0] + 1, len(seq) - k + 1)] + [(i, i) for i in reversed(range(starts[0]))]
    for start, at in todo:
        if at not in poor or there(seq[start : start + k]):
            continue
        changed = [seq[:at] + b + seq[at + 1 :] for b in "ACGT" if b != seq[at]]
        ways = [s for s in changed if there(s[start : start + k])]
        if len(ways) == 1:
            seq, qual = ways[0], qual[:at] + chr(cutoff + 1) + qual[at + 1 :]
            places.append(at)
        elif policy == correction.DISCARD:
            return ("discard", places, seq, qual)
    return ("corrected", places, seq, qual)


@pytest.mark.parametrize("policy", [correction.KEEP, correction.DISCARD])
def test_correction_in_rounds_equals_one_pass(spark, policy):
    k, rng = 9, random.Random(7)
    genome = dna(400, 8)
    words = {min(w, rc(w)) for i in range(len(genome) - k + 1) for w in [genome[i : i + k]]}
    rows = []
    for i in range(40):
        at = rng.randrange(340)
        seq, qual = list(genome[at : at + 50]), ["I"] * 50
        for _ in range(rng.randrange(5)):
            j = rng.randrange(50)
            seq[j], qual[j] = rng.choice("ACGTN"), "#"
        seq = "".join(seq)
        rows.append((i, f"r{i}", rc(seq.replace("N", "A")) if i % 2 else seq, "".join(reversed(qual)) if i % 2 else "".join(qual)))
    rows += [(90, "none", dna(40, 99), "#" * 40), (91, "short", "ACG", "###"), (92, "bare", "ACGTACGTACGT", None), (93, "empty", "", "")]
    found = {r["id"]: (r["decision"], r["places"], r["seq"], r["qual"]) for r in correction.correct(spark.createDataFrame(rows, "read_id long, name string, seq string, qual string"), nodes_of(spark, [("g", genome)], k), k, 10, policy).collect()}
    assert len(found) == len(rows)
    for i, _, seq, qual in rows:
        if qual:
            assert found[i] == brute_correct(seq, qual, k, 43, policy, words), i
        else:
            assert found[i] == ("uncorrected", [], seq, qual)
    assert any(f[1] for f in found.values())


def test_correction_puts_an_error_right(spark):
    genome = dna(200, 3)
    bad = genome[:30] + ("A" if genome[30] != "A" else "C") + genome[31:60]
    reads = spark.createDataFrame([(1, "r", bad, "I" * 30 + "#" + "I" * 29)], "read_id long, name string, seq string, qual string")
    out = correction.correct(reads, nodes_of(spark, [("g", genome)], 15), 15, 10)
    assert out.first()["seq"] == genome[:60]
    assert correction.correction_stats(out).first().asDict() == {"original": 1, "final": 1, "corrected": 1, "discarded": 0}
    assert [tuple(r) for r in correction.fixes_by_place(out).collect()] == [(30, 1)]


def test_bubbles_by_colour(spark):
    k = 11
    left, right = dna(60, 21), dna(60, 22)
    a, b = left + "A" + right, left + "C" + right
    nodes = nodes_of(spark, [("a", a), ("b", b)], k).cache()
    every = discovery.call_bubbles(nodes, k, ["a", "b"], ["a", "b"]).collect()
    assert len(every) == 1
    alleles = {every[0][f"flank5p"] + every[0][x] + every[0]["flank3p"] for x in ("branch1", "branch2")}
    assert alleles in ({a, b}, {rc(a), rc(b)})
    assert all(len(every[0][x]) == k + 1 for x in ("branch1", "branch2"))
    assert discovery.call_bubbles(nodes, k, ["a"], ["b"]).count() == 1
    both = graph.merge(nodes.unionByName(nodes_of(spark, [("c", a), ("c", b)], k)))
    assert discovery.call_bubbles(both, k, ["a"], ["c"]).count() == 0
    assert discovery.call_bubbles(both, k, ["a", "b"], ["a", "b"], excluded="c").count() == 0
    named = discovery.numbered(discovery.call_bubbles(nodes, k, ["a"], ["b"]))
    assert discovery.union_of_calls([named, named], k).count() == 1
    lines = discovery.callfile(named).first()[0].split("\n")
    assert [x.split()[0] for x in lines[::2]] == [">var_1_5p_flank", ">var_1_branch_1", ">var_1_branch_2", ">var_1_3p_flank"]


def test_callfile_round_trip(spark, tmp_path):
    rows = [("var_1", "ACGTACGT", "A", "CC", "GGT"), ("var_2", "TTT", "G", "T", "")]
    known = spark.createDataFrame(rows, "var_id string, flank5p string, branch1 string, branch2 string, flank3p string")
    discovery.callfile(known).write.text(str(tmp_path / "calls"))
    back = discovery.read_callfile(spark, str(tmp_path / "calls")).select("var_id", "flank5p", "branch1", "branch2", "flank3p")
    assert sorted(map(tuple, back.collect())) == rows


@pytest.mark.parametrize(("ref_part", "alt_part"), [("A", "C"), ("ACGGTCATTG", ""), ("", "TTGACCATGCA"), ("ACCT", "GTTACG")])
def test_path_divergence(spark, ref_part, alt_part):
    k = 11
    left, right = dna(80, 31), dna(80, 32)
    ref, alt = left + ref_part + right, left + alt_part + right
    refs = spark.createDataFrame([("c", ref)], "chrom string, seq string")
    sample = graph.union_of_colours(nodes_of(spark, [("s", alt)], k))
    rows = discovery.path_divergences(refs, sample, k, 200).collect()
    assert len(rows) == 1
    r = rows[0]
    at = r["pos"] - 1
    assert ref[:at] + r["branch1"] + ref[at + len(r["branch1"]) :] == ref
    assert ref[:at] + r["branch2"] + ref[at + len(r["branch1"]) :] == alt
    assert ref[:at].endswith(r["flank5p"]) and ref[at + len(r["branch1"]) :].startswith(r["flank3p"])


def test_path_divergence_on_the_other_strand_and_none(spark):
    ref = dna(150, 41)
    refs = spark.createDataFrame([("c", ref)], "chrom string, seq string")
    assert discovery.path_divergences(refs, graph.union_of_colours(nodes_of(spark, [("s", ref)], 11)), 11, 100).count() == 0
    alt = ref[:70] + ("A" if ref[70] != "A" else "G") + ref[71:]
    assert discovery.path_divergences(refs, graph.union_of_colours(nodes_of(spark, [("s", rc(alt))], 11)), 11, 100).count() == 1


def test_allele_coverages(spark):
    k, left, right = 11, dna(40, 51), dna(40, 52)
    var = spark.createDataFrame([("v", left, "A", "C", right)], "var_id string, flank5p string, branch1 string, branch2 string, flank3p string")
    r = discovery.allele_coverages(var, nodes_of(spark, [("a", left + "A" + right)] * 2, k), k, ["a", "b"]).orderBy("colour").collect()
    assert r[0]["covgs1"][:k] == [2] * k and r[0]["covgs2"][:k] == [0] * k and set(r[1]["covgs1"][:k]) == {0}


def test_log_gamma(spark):
    xs = [0.01, 0.3, 0.5, 1.0, 1.5, 2.0, 7.25, 100.0, 12345.6]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(population.log_gamma(F.col("x"))).collect()
    for x, (g,) in zip(xs, got, strict=True):
        assert g == pytest.approx(math.lgamma(x), rel=1e-10, abs=1e-9)


def brute_models(c1, c2, mean, ploidy, err=0.01):
    lb = lambda a, b: math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    n, s1, s2 = len(c1), sum(c1), sum(c2)
    cov = []
    for g in range(1, 11):
        al = 2 * g * mean
        cov.append((s1 + s2) * math.log(g) + al * math.log(al) - math.lgamma(al) + math.lgamma(al + s1 + s2) - (al + s1 + s2) * math.log(al + 2 * g * mean * n))
    one = cov[0] - max(cov)
    lo, hi = sorted((s1, s2))
    gs = (2, 1, 0) if ploidy == 2 else (2, 0)
    es = [(g * (1 - err) + (2 - g) * err) / 2 for g in gs]
    grid = [i / (2 * n) for i in range(1, 2 * n)]
    total = num = 0.0
    for f in grid:
        w = [(1 - f) ** 2, 2 * f * (1 - f), f * f] if ploidy == 2 else [1 - f, f]
        prior = 1 / (f * (1 - f))
        like = math.prod(sum(wi * e**a * (1 - e) ** b for wi, e in zip(w, es, strict=True)) for a, b in zip(c1, c2, strict=True))
        total, num = total + prior, num + prior * like
    return one + math.log(num / total), one + lb(100 * err + lo, 100 + hi) - lb(100 * err, 100), lb(2 + s1, 2 + s2) - lb(2, 2)


@pytest.mark.parametrize("ploidy", [1, 2])
def test_classify(spark, ploidy):
    rng = random.Random(5)
    sites = [([rng.randrange(6) for _ in range(n)], [rng.randrange(6) for _ in range(n)], 2.5) for n in (1, 3, 5, 8)]
    sites += [([10, 0, 10, 0], [0, 10, 0, 10], 5.0), ([20] * 4, [0, 1, 0, 0], 10.0)]
    rows = [*sites, ([], [], 1.0), ([0], [0], 1.0)]
    got = population.classify(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c1 array<int>, c2 array<int>, mean double"), ploidy).orderBy("i").collect()
    for r, site in zip(got, sites, strict=False):
        assert [r["llk_variant"], r["llk_error"], r["llk_repeat"]] == pytest.approx(brute_models(*site, ploidy), rel=1e-8)
    assert got[4]["model"] == "variant" and got[5]["model"] == "error" and got[6]["model"] is None and got[7]["model"] is None


def test_site_genotypes(spark):
    rows = [("s", "A", 40, 10, 5, 5), ("s", "B", 38, 10, 5, 5), ("s", "C", 1, 10, 5, 5), ("t", "A", 80, 10, 5, 5), ("t", "B", 0, 10, 5, 5)]
    alleles = spark.createDataFrame(rows, "site string, allele string, reads long, nodes long, shared long, shared_nodes long")
    genotypes = population.site_genotypes(alleles, 800.0, 100)
    assert genotypes.where("site = 's'").count() == 6
    best = {r["site"]: (r["first"], r["second"], r["confidence"] > 0) for r in population.best_genotypes(genotypes).collect()}
    assert best == {"s": ("A", "B", True), "t": ("A", "A", True)}


def test_flanks_reference_and_strand(spark):
    seq = dna(300, 61)
    windows = callset.reference_windows(spark.createDataFrame([("c", seq)], "chrom string, seq string"), 50, 20)
    rows = [("c", p, seq[p - 1 : p + 1], "T") for p in (1, 2, 49, 50, 51, 99, 100, 101, 250, 299)] + [("d", 5, "A", "C")]
    calls = calls_of(spark, rows)
    for r in callset.add_flanks(calls, windows, 15, 50).collect():
        if r["chrom"] == "c":
            p = r["pos"]
            assert (r["left_flank"], r["right_flank"]) == (seq[max(0, p - 16) : p - 1], seq[p + 1 : p + 16])
    assert callset.filter_reference(calls, windows, 50).count() == 10
    assert callset.filter_reference(calls, windows, 50, invert=True).count() == 1
    p = next(i for i in range(1, 290) if seq[i] != rc(seq[i]))
    turned = callset.correct_strand(calls_of(spark, [("c", p + 1, rc(seq[p]), "A")]), windows, 50).first()
    assert (turned["ref"], turned["alt"], turned["strand"]) == (seq[p], "T", -1)
    assert callset.ancestral(calls, windows, 50).where("aa = '.'").count() == 1


@pytest.mark.parametrize("left", [True, False])
def test_aligned_keeps_the_haplotype(spark, left):
    seq = "GATTACAGGGGGGCACACACACATTTGCAACGTACGATCCATTTTTTTACG"
    windows = callset.reference_windows(spark.createDataFrame([("c", seq)], "chrom string, seq string"), 1000, 100)
    rows = []
    for p in range(3, 40):
        rows += [("c", p, seq[p - 1 : p + n], seq[p - 1]) for n in (1, 2, 3)] + [("c", p, seq[p - 1], seq[p - 1] + x) for x in ("G", "CA", "TTT")] + [("c", p, seq[p - 1], "N")]
    calls = calls_of(spark, rows)
    moved = {r["id"]: r for r in callset.aligned(calls, windows, left, 1000).collect()}
    made: dict = {}
    for i, (_, p, r, a) in enumerate(rows):
        m = moved[f"c{i}"]
        assert seq[m["pos"] - 1 : m["pos"] - 1 + len(m["ref"])] == m["ref"]
        own = seq[: p - 1] + a + seq[p - 1 + len(r) :]
        assert seq[: m["pos"] - 1] + m["alt"] + seq[m["pos"] - 1 + len(m["ref"]) :] == own
        if len(r) != len(a):
            made.setdefault(own, set()).add((m["pos"], m["ref"], m["alt"]))
    assert all(len(v) == 1 for v in made.values())


def test_features(spark):
    rng = random.Random(9)
    calls = sorted({("c", rng.randrange(1, 5000), "A" * rng.randrange(1, 30), "C") for _ in range(80)})
    feats = [("c", s, s + rng.randrange(300), f"f{i}") for i, s in enumerate(rng.sample(range(5000), 15))]
    features = spark.createDataFrame(feats, "chrom string, start long, stop long, name string")
    got = {(r["pos"], r["ref"]): r["features"] for r in callset.overlapping_features(calls_of(spark, calls), features, 64).collect()}
    want = {(p, r): ",".join(sorted(n for _, s, e, n in feats if p <= e and p + len(r) - 1 >= s)) for _, p, r, _ in calls}
    assert got == {k: v for k, v in want.items() if v}
    near = {(r["pos"], r["ref"]): r["distance"] for r in callset.nearest_feature(calls_of(spark, [*calls, ("d", 1, "A", "C")]), features).collect()}
    assert near.pop((1, "A")) is None or ("c", 1, "A", "C") in calls
    assert near == {(p, r): min(max(0, s - p, p - e) for _, s, e, _ in feats) for _, p, r, _ in calls if (p, r) in near}


def test_info_filters(spark):
    calls = calls_of(spark, [("c", i, "A", "C") for i in range(1, 13)])
    for text, n in (("N >= 10", 2), ("N == 3", 1), ("N != 3", 11), ("N =~ ^1", 3), ("N !~ ^1", 9), ("N eq 10", 1), ("N gt 2", 7), ("M > 1", 0)):
        assert callset.filter_info(calls, text).count() == n, text
    with pytest.raises(ValueError):
        callset.filter_info(calls, "N")


def test_other_call_tools(spark, tmp_path):
    calls = calls_of(spark, [("c", 1, "A", "G"), ("c", 10, "A", "C"), ("c", 12, "AT", "A"), ("d", 3, "A", "AGG")])
    assert callset.sv_length_sums(calls).first().asDict() == {"inserted": 2, "deleted": 1}
    assert {(r[0], r[1], r[2]) for r in callset.chromosome_bins(calls, 10).collect()} == {("c", 0, 2), ("c", 1, 1), ("d", 0, 1)}
    assert callset.filter_sizes(calls, 2, 9).count() == 1
    assert callset.filter_kinds(calls, ["SNP"]).count() == 2
    gts = spark.createDataFrame([("c", 1, "A", "G", "x", "0/1"), ("c", 1, "A", "G", "y", "1|1"), ("c", 1, "A", "G", "z", "./.")], "chrom string, pos long, ref string, alt string, sample string, gt string")
    r = callset.allele_frequency(calls, gts).where("pos = 1").first()
    assert (r["n_alleles"], r["n_alt"], r["af"]) == (4, 3, 0.75)
    assert callset.merged_samples(gts, ["x", "y", "w"]).first()[4:] == ("0/1", "1|1", ".")
    vcf.lines(calls).write.text(str(tmp_path / "v"))
    back = callset.read_vcf(spark, str(tmp_path / "v"))
    key = ["chrom", "pos", "id", "ref", "alt", "qual", "filter"]
    assert sorted(map(tuple, back.select(*key).collect())) == sorted(map(tuple, calls.select(*key).collect()))
    assert {r["info"]["N"] for r in back.collect()} == {"0", "1", "2", "3"}
    kept = calls_of(spark, [("c", 10, "AAAA", "A")])
    out = callset.restore_consistent(kept, calls_of(spark, [("c", 12, "A", "C"), ("c", 20, "AAA", "C"), ("c", 21, "A", "C"), ("c", 23, "A", "C")]))
    assert sorted(r["pos"] for r in out.collect()) == [10, 20, 23]


def test_homopolymers_slippage_and_microhomology(spark):
    windows = callset.reference_windows(spark.createDataFrame([("c", "GCAAAAATCGTCGT")], "chrom string, seq string"))
    calls = calls_of(spark, [("c", 2, "CA", "C"), ("c", 8, "TC", "T"), ("c", 2, "C", "G")])
    assert sorted(r["pos"] for r in callset.in_homopolymer(calls, windows, 4).collect()) == [2, 8]
    rows = spark.createDataFrame([("ACGT", "A", "GG", "CGTTT"), ("ACGT", "A", "TGT", "AAA"), ("A", "C", "G", "G")], "ref string, alt string, left_flank string, right_flank string")
    assert [r[0] for r in rows.select(callset.is_slippage(F.col("ref"), F.col("alt"), F.col("right_flank"), F.col("left_flank"))).collect()] == [True, False, False]
    assert [r["mmej"] for r in callset.microhomology(rows).collect()] == [3, 2, 0]


def test_fastn(spark):
    rows = spark.createDataFrame([("a", "ACGTNNacgt"), ("b", ""), ("c", "GGGCC")], "name string, seq string")
    got = {r["name"]: (r["a"], r["g"], r["other"], r["gc"]) for r in fastn.base_counts(rows).collect()}
    assert got == {"a": (2, 2, 2, 0.5), "b": (0, 0, 0, None), "c": (0, 3, 0, 1.0)}
    assert fastn.total_length(rows).first().asDict() == {"entries": 3, "bases": 15, "shortest": 0, "longest": 10}
    assert [r["seq"] for r in fastn.split_entries(rows.where("name = 'a'"), 4, 1).orderBy("part").collect()] == ["ACGT", "TNNa", "acgt"]
    want = spark.createDataFrame([("c", 2, 3), ("c", 1, -5)], "name string, start int, length int")
    assert {r["seq"] for r in fastn.substrings(rows, want).collect()} == {"GGC", "GGCCC"}
    names = spark.createDataFrame([("a",)], "name string")
    assert fastn.select_names(rows, names).count() == 1 and fastn.select_names(rows, names, invert=True).count() == 2
    assert rows.select(fastn.wrapped(F.col("seq"), 5), fastn.cleaned(F.lit("ac-gx\n"))).first()[:] == ("ACGTN\nNacgt", "ACNGN")
    assert sorted(r["name"] for r in fastn.shuffled(rows, 3).collect()) == ["a", "b", "c"]
    quals = spark.createDataFrame([("s", "I#"), ("s", "##"), ("s", None)], "sample string, qual string")
    assert sorted(map(tuple, fastn.quality_summary(quals).collect())) == [("s", 0, 2, 21.0, 2, 40), ("s", 1, 2, 2.0, 2, 2)]


def test_simulated_reads(spark):
    seq = dna(500, 71)
    refs = spark.createDataFrame([("c", seq), ("short", "ACG")], "name string, seq string")
    exact = fastn.simulated_reads(refs, 50, 3.0, seed=1).collect()
    assert len(exact) == 30 and all(r["seq"] in seq or rc(r["seq"]) in seq for r in exact)
    noisy = fastn.simulated_reads(refs, 50, 3.0, error=0.1, seed=1).collect()
    diffs = [sum(a != b for a, b in zip(x["seq"], y["seq"], strict=True)) for x, y in zip(sorted(exact, key=lambda r: r["name"]), sorted(noisy, key=lambda r: r["name"]), strict=True)]
    assert 60 < sum(diffs) < 260


def test_correction_statistics(spark):
    rows = [(1, "corrected", 2, [3, 5]), (2, "corrected", 0, []), (3, "discard", 1, [3]), (4, "uncorrected", 0, [])]
    found = spark.createDataFrame(rows, "id long, decision string, n_fixed int, places array<int>")
    assert tuple(correction.correction_stats(found).first()) == (4, 3, 1, 1)
    assert {r["n_fixed"]: r["n"] for r in correction.fixes_per_read(found).collect()} == {2: 1, 0: 2}
    assert {r["place"]: r["n"] for r in correction.fixes_by_place(found).collect()} == {3: 2, 5: 1}


def test_confusion_branches_header_and_filters(spark):
    calls = spark.createDataFrame([("1/1", "1/1", 5.0), ("0/1", "1/1", 15.0), ("0/1", "1/1", 19.9), ("0/0", "0/0", 500.0), ("0/0", "0/1", -1.0)], "truth string, gt string, gt_conf double")
    assert {(r["bin"], r["truth"], r["gt"]): r["n"] for r in callset.confusion(calls).collect()} == {(1, "1/1", "1/1"): 1, (2, "0/1", "1/1"): 2, (11, "0/0", "0/0"): 1, (0, "0/0", "0/1"): 1}
    flanked = spark.createDataFrame([("v", "A", "GT", "CC", "TT")], "id string, ref string, alt string, left_flank string, right_flank string")
    assert {r["name"]: r["seq"] for r in callset.allele_branches(flanked).collect()} == {"v_ref": "CCATT", "v_alt": "CCGTTT"}
    assert callset.header(["s"])[-1].split("\t")[-2:] == ["FORMAT", "s"] and len(callset.header()[-1].split("\t")) == 8
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 0)], "a int, b int")
    assert [r[0] for r in rows.select(vcf.combine_filters((F.col("a") == 1, "MAPQ"), (F.col("b") == 1, "REP"))).collect()] == ["MAPQ,REP", "MAPQ", "PASS"]
    kinds = [("A", "G", "SNP"), ("AC", "GT", "INV"), ("AC", "GG", "PH_SNPS"), ("", "A", "INS"), ("A", "", "DEL"), ("A", "AC", "INS"), ("AC", "A", "DEL"), ("AC", "ACG", "INDEL"), ("ACG", "CG", "INDEL"), ("AC", "GGG", "COMPLEX")]
    got = spark.createDataFrame(kinds, "ref string, alt string, kind string").select("kind", vcf.svtype(F.col("ref"), F.col("alt"))).collect()
    assert all(r[0] == r[1] for r in got)


def test_running_coverage_of_a_stream(spark, tmp_path):
    from kmerloom.streaming.kmers import running_coverage

    schema = "sample string, read_id long, mate int, seq string, qual string"
    parts = [[("s", 1, 0, "ACGTACGTAC", None)], [("s", 2, 0, "ACGTACG", None), ("t", 3, 0, "GGGGG", None)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}"))
    reads = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
    query = running_coverage(reads, 5).writeStream.outputMode("complete").format("memory").queryName("covg").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    whole = graph.build(filters.contigs(spark.createDataFrame([r for p in parts for r in p], schema), 5), 5)
    assert sorted(map(tuple, spark.table("covg").collect())) == sorted((r["kmer"], r["colour"], r["covg"]) for r in whole.collect())
