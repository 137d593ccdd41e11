"""Bubbles of reads against a graph of strings and against the operator on graphs."""

import os
import random
from collections import defaultdict

import pytest

from kmerloom.functions.dna import text_to_dna
from kmerloom.operators import filters, graph, stretches, unitigs
from kmerloom.plans import queries


def rc(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def brute(reads, k):
    """(start, branch1, branch2) by walking from every node that does not just go on."""
    out, into = defaultdict(set), defaultdict(set)
    for read in reads:
        for part in read.split("N"):
            for i in range(len(part) - k):
                for u, v in ((part[i : i + k], part[i + 1 : i + k + 1]), (rc(part[i + 1 : i + k + 1]), rc(part[i : i + k]))):
                    out[u].add(v)
                    into[v].add(u)
    inner = lambda v: len(out[v]) == 1 and len(into[v]) == 1
    pairs = defaultdict(list)
    for u in list(out):
        if not inner(u):
            for v in out[u]:
                bases = v[-1]
                while inner(v):
                    (v,) = out[v]
                    bases += v[-1]
                pairs[u, v].append(bases)
    found = {}
    for (u, v), paths in pairs.items():
        if len(paths) > 1:
            found[u] = min(found.get(u, ("~",)), (*sorted(paths)[:2], v))
    return sorted((u, a, b) for u, (a, b, v) in found.items() if min(u, rc(u)) <= min(v, rc(v)))


def several(seed, k):
    """Reads with copies of one text that differ by bases, gaps and repeats, cut anywhere, on either strand."""
    r = random.Random(seed)
    text = "".join(r.choices("ACGT", [5, 1, 1, 3] if seed % 2 else None, k=r.choice((60, 300, 900))))
    reads = []
    for _ in range(r.randint(1, 12)):
        one = list(text[r.randint(0, 40) :])
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(one))
            one[at] = r.choice(["", "A", "C", "G", "T", one[at] * r.randint(2, k), "ACACACAC"])
        one = "".join(one)
        cuts = sorted(r.choices(range(len(one)), k=r.randint(0, 6)))
        parts = [one[a : b + r.choice((0, k - 1, k, 2 * k))] for a, b in zip([0, *cuts], [*cuts, len(one)], strict=True)]
        reads += [r.choice((p, rc(p), p[: len(p) // 2] + "N" + p[len(p) // 2 :])) for p in parts]
    return [x for x in reads if x] + ["A" * 150] * r.randint(0, 1)


@pytest.mark.parametrize(("seed", "k"), [(1, 5), (2, 5), (3, 7), (4, 7), (5, 3), (6, 9), (7, 15), (8, 17), (9, 31), (10, 7), (11, 15), (12, 9)])
def test_bubbles_of_reads_are_those_of_a_graph_of_strings(spark, seed, k):
    reads = several(seed, k)
    want = brute(reads, k)
    rows = spark.createDataFrame([(x,) for x in reads], "seq string")
    for more in ({}, {"sent": -1, "piece": 40}):
        got = stretches.bubbles_of_reads(rows, k, **more).collect()
        text = lambda node: unpacked(node >> 1, k) if node & 1 else rc(unpacked(node >> 1, k))
        assert sorted((text(r["start"]), r["branch1"], r["branch2"]) for r in got) == want, more


def unpacked(kmer, k):
    return "".join("ACGT"[kmer >> 2 * (k - 1 - i) & 3] for i in range(k))


def test_the_query_finds_what_the_graph_does_and_writes_less_than_a_row_an_edge(spark, tmp_path):
    r = random.Random(5)
    base = " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(3000))
    texts = [None, "", "\u00e9\u00e8 1", base, base[:900] + "Q" + base[901:2000], base[5000:5400] + "zz 7 " + base[5400:6000].upper(), base[400:9000:1] + "\u00df"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    contigs = filters.contigs(queries.reads_of_prose(docs.selectExpr("doc_id", "text", "'all' AS one"), "one"), 15)
    want = unitigs.bubbles(unitigs.written(graph.union_of_colours(graph.build(contigs, 15))), 15).select("branch1", "branch2").collect()
    edges = sum(max(0, len(x["d"] or "") - 15) for x in docs.select(text_to_dna(docs["text"]).alias("d")).collect())
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    held = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(shared) for f in names)
    before = held()
    assert sorted(queries.bubbles(spark, str(tmp_path)).collect()) == sorted(want) and want
    assert held() - before < 2 * edges + 200_000
