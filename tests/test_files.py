"""Sequence files split at any place, BAM, format sniffing, graph files and lists."""

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from kmerloom.operators import filters, graph
from kmerloom.sources import graphs
from kmerloom.sources import reads as sources


def dna(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def rows_of(df):
    return [(r["name"], r["seq"], r["qual"]) for r in df.orderBy("file", "read_id").collect()]


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_split_files(spark, tmp_path, small_splits):
    rnd = random.Random(3)
    fasta = [(f"e{i} x", dna(rnd.randrange(0, 70), i)) for i in range(40)]
    (tmp_path / "a.fa").write_text("".join(f">{n}\n" + "".join(s[j : j + 20] + "\n" for j in range(0, len(s), 20)) for n, s in fasta))
    (tmp_path / "w.fa").write_text("".join(f">{n}\r\n{s}\r\n" for n, s in fasta[:5]))
    fastq = [(f"q{i}", dna(30, i), "".join(rnd.choices("@>+I", k=30))) for i in range(60)]
    (tmp_path / "b.fq").write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in fastq) + "@bad\nACG\n+\nII\n")
    got = sources.read_fasta(spark, str(tmp_path / "a.fa"))
    assert got.rdd.getNumPartitions() > 5 and rows_of(got) == [(n, s, None) for n, s in fasta]
    assert rows_of(sources.read_fasta(spark, str(tmp_path / "w.fa"))) == [(n, s, None) for n, s in fasta[:5]]
    assert rows_of(sources.read_fastq(spark, str(tmp_path / "b.fq"))) == fastq
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in fastq))
    assert rows_of(sources.read_any(spark, str(tmp_path / "b.fq.gz"))) == fastq
    (tmp_path / "p.txt").write_text("ACGT\n\nGGG\n")
    assert rows_of(sources.read_any(spark, str(tmp_path / "p.txt"))) == [("", "ACGT", None), ("", "GGG", None)]
    both = sources.pairs(sources.read_fastq(spark, str(tmp_path / "b.fq")), sources.read_fasta(spark, str(tmp_path / "a.fa")))
    with pytest.raises(Exception, match="unequal"):
        both.collect()
    half = sources.subsample(got, 0.5, 1)
    assert 5 < half.count() < 35 and half.collect() == sources.subsample(got, 0.5, 1).collect()


def bam(rows):
    out = b"BAM\1" + struct.pack("<i", 5) + b"@HD\n\0" + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 9)
    for name, flag, seq, qual in rows:
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
        body = struct.pack("<iiBBHHHiiii", 0, 0, len(name) + 1, 9, 0, 1, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", len(seq) << 4) + packed + (bytes(ord(q) - 33 for q in qual) if qual else b"\xff" * len(seq))
        out += struct.pack("<i", len(body)) + body
    return gzip.compress(out[:50]) + gzip.compress(out[50:])  # several blocks


def test_bam_is_read_like_sam(spark, tmp_path):
    rows = [("r1", 0, "ACGTN", "IIIII"), ("r2", 16, "AAC", "ABC"), ("r3", 256, "ACG", "III"), ("r4", 4, "ACGT", None), ("r5", 0, "", "")]
    (tmp_path / "a.bam").write_bytes(bam(rows))
    (tmp_path / "a.sam").write_text("@HD\tVN:1\n" + "".join(f"{n}\t{f}\tc\t1\t9\t3M\t*\t0\t0\t{s}\t{q or '*'}\n" for n, f, s, q in rows))
    got = sources.read_bam(spark, str(tmp_path / "a.bam"))
    assert [(r["name"], r["seq"], r["qual"]) for r in got.orderBy("read_id").collect()] == [("r1", "ACGTN", "IIIII"), ("r2", "GTT", "CBA"), ("r4", "ACGT", None), ("r5", "", None)]
    assert rows_of(sources.read_any(spark, str(tmp_path / "a.bam"))) == rows_of(sources.read_any(spark, str(tmp_path / "a.sam")))
    assert [sources.sniffed(spark, str(tmp_path / x)) for x in ("a.bam", "a.sam")] == ["bam", "sam"]


def graph_of(spark, seqs, k, colour="0"):
    reads = spark.createDataFrame([(colour, i, 0, s, None) for i, s in enumerate(seqs)], "sample string, read_id long, mate int, seq string, qual string")
    return graph.build(filters.contigs(reads, k), k)


def held(nodes):
    return sorted(map(tuple, nodes.select("kmer", "colour", "covg", "edges").collect()))


@pytest.mark.parametrize("k", [9, 33])
def test_graph_files(spark, tmp_path, k):
    a, b, c = dna(90, 1), dna(90, 2), dna(90, 1)[:60] + dna(30, 3)
    made = {}
    for name, seqs in (("a", [a, a]), ("b", [b]), ("c", [c])):
        made[name] = graph_of(spark, seqs, k)
        meta = spark.createDataFrame([("0", 90, 45)], "sample string, total_seq long, mean_read_len long")
        graphs.save(made[name], graphs.header_of(spark, k, ["0"], meta, tips_clipped=name == "a"), str(tmp_path / name), by_colour=name == "b")
    for name, nodes in made.items():
        got, header = graphs.load(spark, str(tmp_path / name), k)
        assert held(got) == held(nodes) and header.first()["total_seq"] == 90
    assert graphs.load_summary(graphs.load(spark, str(tmp_path / "a"), k)[1]).first()["cleaning"] == "tips clipped"
    with pytest.raises(ValueError, match="k = "):
        graphs.load(spark, str(tmp_path / "a"), k + 2)
    graphs.header_of(spark, k, ["0"], version=7).write.parquet(str(tmp_path / "old" / "header"))
    with pytest.raises(ValueError, match="version 7"):
        graphs.load(spark, str(tmp_path / "old"), k)
    (tmp_path / "first.list").write_text("a\nc\n")
    (tmp_path / "second.list").write_text("b\n")
    (tmp_path / "all.colours").write_text("first.list\tme\nsecond.list\n")
    nodes, samples = graphs.load_colours(spark, str(tmp_path / "all.colours"), k)
    both = graph_of(spark, [a, a, c], k, "0").unionByName(graph_of(spark, [b], k, "1"))
    assert held(nodes) == held(both) and sorted(map(tuple, samples.collect())) == [("0", "me"), ("1", "sample_1")]
    # union: coverage of the first graph that has a k-mer
    of = {r["kmer"]: r["covg"] for r in graphs.load_colours(spark, str(tmp_path / "all.colours"), k, union=True)[0].where("colour = '0'").collect()}
    first = {r["kmer"]: r["covg"] for r in made["a"].collect()}
    assert all(of[x] == n for x, n in first.items()) and {of[x] for x in of.keys() - first.keys()} == {1}
    clean = graph.union_of_colours(graph_of(spark, [a[:70]], k))
    over, _ = graphs.load_colours(spark, str(tmp_path / "all.colours"), k, clean=clean)
    words = {r["kmer"]: r["edges"] for r in clean.collect()}
    assert held(over) == sorted((x, s, n, e & words[x]) for x, s, n, e in held(both) if x in words)
    written = graphs.dump_cleaned_colours(spark, str(tmp_path / "all.colours"), k, clean, str(tmp_path), "clean")
    assert [p.rsplit("/", 1)[1] for p in written] == ["me_clean", "sample_1_clean"]
    assert held(graphs.load(spark, written[0], k)[0]) == held(over.where("colour = '0'"))
    more = graphs.load_multicolour_then(spark, str(tmp_path / "a"), k, str(tmp_path / "all.colours"))
    assert {r[0] for r in more.select("colour").distinct().collect()} == {"0", "1", "2"}
    assert graph.wipe(more, ["0"]).where("colour = '0'").count() == 0
    assert held(graph.merge(more.withColumn("colour", F.lit("x"))))[0][1] == "x"


def test_metadata_of_several_samples(spark):
    rows = spark.createDataFrame([("a", 100, 10), ("b", 300, 31)], "sample string, total_seq long, mean_read_len long")
    assert tuple(filters.merge_metadata(rows).first()) == (400, (100 * 10 + 300 * 31) // 400)
    contigs = spark.createDataFrame([("s", 0, 0, 0, "ACGTAC"), ("s", 1, 0, 0, "ACGTTT"), ("s", 2, 0, 0, "TCGTAC")], "sample string, read_id long, mate int, contig_no int, seq string")
    assert sorted(r["read_id"] for r in filters.drop_duplicate_starts(contigs, 3).collect()) == [0, 2]
