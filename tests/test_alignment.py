"""Alleles aligned and split into changes; call files turned into call sets."""

import random

import pytest

from kmerloom.operators import alignment

_C = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(_C)[::-1]


def bases(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def score(a, b):
    total, gap = 0, None
    for p, q in zip(a, b, strict=True):
        kind = 0 if p == "-" else 1 if q == "-" else None
        total += (alignment.MATCH if p == q else alignment.MISMATCH) if kind is None else alignment.EXTEND + (alignment.OPEN if kind != gap else 0)
        gap = kind
    return total


def best_score(a, b):
    """By plain recursion over all ways."""
    from functools import cache

    @cache
    def go(i, j, gap):
        if i == len(a) and j == len(b):
            return 0
        ways = []
        if i < len(a) and j < len(b):
            ways.append((alignment.MATCH if a[i] == b[j] else alignment.MISMATCH) + go(i + 1, j + 1, None))
        if i < len(a):
            ways.append(alignment.EXTEND + (alignment.OPEN if gap != 1 else 0) + go(i + 1, j, 1))
        if j < len(b):
            ways.append(alignment.EXTEND + (alignment.OPEN if gap != 0 else 0) + go(i, j + 1, 0))
        return max(ways)

    return go(0, 0, None)


def test_alignments_are_best(spark):
    rnd = random.Random(2)
    for _ in range(150):
        a = "".join(rnd.choices("AC", k=rnd.randrange(0, 9)))
        b = "".join(rnd.choices("ACG", k=rnd.randrange(0, 9)))
        x, y = alignment.align(a, b)
        assert x.replace("-", "") == a and y.replace("-", "") == b and score(x, y) == best_score(a, b), (a, b, x, y)


def applied(a, found):
    for at, ref, alt in sorted(found, reverse=True):
        assert a[at : at + len(ref)] == ref
        a = a[:at] + alt + a[at + len(ref) :]
    return a


def test_changes_turn_one_allele_into_the_other(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(60):
        a = bases(rnd.randrange(0, 40), i)
        b = list(a)
        for _ in range(rnd.randrange(4)):
            if b:
                at = rnd.randrange(len(b))
                b[at : at + rnd.randrange(3)] = rnd.choice(["", "A", "GT"])
        rows.append((f"v{i}", a, "".join(b)))
    rows += [("same", "ACGT", "ACGT"), ("null", None, "AC"), ("snp", "ACGTACGT", "ACGAACGT"), ("two", "ACGTACGT", "CCGTACGA"), ("turned", "AAACG", rc("AAACG"))]
    got = {}
    for r in alignment.split_alleles(spark.createDataFrame(rows, "var_id string, branch1 string, branch2 string")).collect():
        got.setdefault(r["id"], []).append((r["offset"], r["ref"], r["alt"]))
    for name, a, b in rows:
        assert applied(a or "", got.get(name, [])) == (b or "")
    assert "same" not in got and got["snp"] == [(3, "T", "A")] and got["two"] == [(0, "A", "C"), (7, "T", "A")] and got["turned"] == [(0, "AAACG", "CGTTT")]


@pytest.mark.parametrize("strand", [1, -1])
def test_calls_of_mapped_variants(spark, strand):
    ref = bases(300, 7)
    k = 11
    edits = {"snp": (100, "X"), "ins": (140, "+GATT"), "del": (180, "-3"), "both": (220, "two")}
    rows, mapped, want = [], [], {}
    for name, (at, what) in edits.items():
        a = ref[at : at + 12]
        x = {"A": "C", "C": "G", "G": "T", "T": "A"}
        b = x[a[0]] + a[1:] if what == "X" else a[:4] + what[1:] + a[4:] if what[0] == "+" else a[:2] + a[5:] if what[0] == "-" else x[a[0]] + a[1:8] + x[a[8]] + a[9:]
        left, right = ref[at - 30 : at], ref[at + 12 : at + 42]
        if strand < 0:
            left, a, b, right = rc(right), rc(a), rc(b), rc(left)
        rows.append((name, left, a, b, right))
        mapped.append((name, "c", at - 30 + 1 if strand > 0 else at + 12 + 1, strand, 60, "30M"))
        want[name] = ref[: at] + (b if strand > 0 else rc(b)) + ref[at + 12 :]
    rows += [("poor", ref[10:40], "A", "C", ref[41:60]), ("lost", ref[10:40], "A", "C", ref[41:60])]
    mapped += [("poor", "c", 11, 1, 10, "30M")]
    variants = spark.createDataFrame(rows, "var_id string, flank5p string, branch1 string, branch2 string, flank3p string")
    places = spark.createDataFrame(mapped, "var_id string, chrom string, start long, strand int, mapq int, cigar string")
    refs = spark.createDataFrame([("c", ref)], "chrom string, seq string")
    models = spark.createDataFrame([("snp", "repeat"), ("ins", "variant")], "var_id string, model string")
    calls = alignment.calls_of(variants, places, refs, k, models=models).collect()
    per = {}
    for r in calls:
        assert r["id"].startswith("poor") or ref[r["pos"] - 1 : r["pos"] - 1 + len(r["ref"])] == r["ref"], r
        per.setdefault(r["id"].rsplit("_", 1)[0], []).append((r["pos"] - 1, r["ref"], r["alt"]))
    assert {n: applied(ref, per[n]) for n in edits} == want and "lost" not in per and len(per["both"]) == 2
    filters = {r["id"].rsplit("_", 1)[0]: r["filter"] for r in calls}
    assert filters == {"snp": "PF_FAIL_REPEAT", "ins": "PASS", "del": "PASS", "both": "PASS", "poor": "MAPQ"}
    assert {r["info"]["SVTYPE"] for r in calls if r["id"].startswith("ins")} == {"INS"}
    again = alignment.branch_sequences(variants, k).where("name = 'snp_branch_2'").first()["seq"]
    assert again == (rows[0][1][-k:] + rows[0][3] + rows[0][4][:k])


def test_paralogs(spark):
    ref = bases(100, 9)
    variants = spark.createDataFrame([("p", ref[10:40], ref[40:60], "A", "")], "var_id string, flank5p string, branch1 string, branch2 string, flank3p string")
    places = spark.createDataFrame([("p", "c", 11, 1, 60, "30M")], "var_id string, chrom string, start long, strand int, mapq int, cigar string")
    refs = spark.createDataFrame([("c", ref), ("d", ref[20:70])], "chrom string, seq string")
    assert {r["filter"] for r in alignment.calls_of(variants, places, refs, 11).collect()} == {"PF_FAIL_PD_PARALOG"}
