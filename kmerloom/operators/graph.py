"""The coloured graph: one row for each canonical k-mer and colour, and what is asked of it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import PACKED, check_k, exits, kmer_type, packed_reverse_complement, reverse_complement

MOST = 4294967295  # coverage saturates
_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _i


def pack(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(canonical k-mer, whether it stands as it is) at each place of an array of codes; those over a 4 mean nothing."""
    c = codes.astype(np.uint64) & np.uint64(3)
    n = len(c) - k + 1
    fw, rc = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(k):
        part = c[j : j + n]
        fw = (fw << np.uint64(2)) | part
        rc |= (np.uint64(3) - part) << np.uint64(2 * j)
    return np.minimum(fw, rc).view(np.int64), fw < rc


_TURN = np.zeros(256, np.uint8)
for _a, _b in zip(b"ACGTN", b"TGCAN", strict=True):
    _TURN[_a] = _b


def nodes_type(k: int) -> str:
    return f"kmer {kmer_type(k)}, colour string, covg long, edges int"


def canonical_kmers(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(canonical k-mer, whether it stands as it is) at each place of an array of codes: packed, or as bytes where k is too long for that."""
    if k <= PACKED:
        return pack(codes, k)
    letters = np.frombuffer(b"ACGTN", np.uint8)[codes]
    view = np.lib.stride_tricks.sliding_window_view
    fw = np.ascontiguousarray(view(letters, k)).view(f"S{k}").ravel()
    rc = np.ascontiguousarray(view(_TURN[letters[::-1]], k)[::-1]).view(f"S{k}").ravel()
    as_is = fw < rc
    return np.where(as_is, fw, rc), as_is


def _column(kmers: np.ndarray) -> pa.Array:
    return pa.array(kmers) if kmers.dtype.kind == "i" else pa.array(kmers.tolist(), pa.binary()).cast(pa.string())


def _counted(k: int):
    piece = (1 << 22) if k <= PACKED else (1 << 17)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            colours, seqs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for colour in dict.fromkeys(colours):
                data = "N".join(s for s, c in zip(seqs, colours, strict=True) if c == colour and s)
                for at in range(0, max(1, len(data)), piece):  # pieces overlap by k + 1, which the middle of each leaves out
                    yield from one(colour, data, at, min(len(data), at + piece))

    def one(colour: str, data: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
        left, right = max(0, start - 1), min(len(data), end + k)
        codes = _CODE[np.frombuffer(data[left:right].encode(), np.uint8)]
        if len(codes) < k:
            return
        kmer, fw = canonical_kmers(codes, k)
        bad = np.concatenate(([0], np.cumsum(codes == 4)))
        good = bad[k:] == bad[:-k]
        follows, leads = np.zeros(len(kmer), bool), np.zeros(len(kmer), bool)
        follows[:-1] = good[1:]
        leads[1:] = good[:-1]
        after = np.where(follows, 1 << np.append(codes[k:], 0).astype(np.int64) % 4, 0)
        before = np.where(leads, 1 << (3 - np.concatenate(([0], codes[: len(kmer) - 1])).astype(np.int64) % 4), 0)
        edges = np.where(fw, after | (before << 4), (after << 4) | before)
        place = np.arange(left, left + len(kmer))
        own = good & (place >= start) & (place < end)
        kmer, edges = kmer[own], edges[own]
        order = np.argsort(kmer, kind="stable")
        kmer, edges = kmer[order], edges[order]
        at = np.flatnonzero(np.concatenate(([True], kmer[1:] != kmer[:-1]))) if len(kmer) else np.empty(0, np.int64)
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [_column(kmer[at]), pa.repeat(pa.scalar(colour, pa.string()), len(at)), pa.array(np.diff(np.append(at, len(kmer)))), pa.array(np.bitwise_or.reduceat(edges, at).astype(np.int32))],
                ["kmer", "colour", "covg", "edges"],
            )

    return run


def build(contigs: DataFrame, k: int, colour: str = "sample") -> DataFrame:
    """nodes (kmer, colour, covg, edges) of contigs.

    K-mers are packed and counted by batch before they are shuffled, so a k-mer
    that is everywhere costs one row a batch.  A table of fewer partitions than
    there are cores is dealt out first.
    """
    check_k(k)
    rows = contigs.select(F.col(colour).cast("string").alias("colour"), "seq")
    cores = contigs.sparkSession.sparkContext.defaultParallelism
    if not contigs.isStreaming and rows.rdd.getNumPartitions() < cores * 2:
        rows = rows.repartition(cores * 2)
    return merge(rows.mapInArrow(_counted(k), nodes_type(k)))


def merge(nodes: DataFrame) -> DataFrame:
    """Graphs of the same k laid together: coverage added up to its limit, edges or-ed."""
    return nodes.groupBy("kmer", "colour").agg(F.least(F.sum("covg"), F.lit(MOST)).alias("covg"), F.bit_or("edges").alias("edges"))


def union_of_colours(nodes: DataFrame, colours: list[str] | None = None) -> DataFrame:
    """(kmer, covg, edges) of some colours as one graph."""
    some = nodes if colours is None else nodes.where(F.col("colour").isin(colours))
    return some.groupBy("kmer").agg(F.sum("covg").alias("covg"), F.bit_or("edges").alias("edges"))


def new_only(first: DataFrame, more: DataFrame) -> DataFrame:
    """Merge in which the coverage of a k-mer that the first graph has stays as it is."""
    both = first.withColumn("_o", F.lit(0)).unionByName(more.withColumn("_o", F.lit(1)))
    return both.groupBy("kmer", "colour").agg(F.min_by("covg", "_o").alias("covg"), F.bit_or("edges").alias("edges"))


def overlap_with_clean(nodes: DataFrame, clean: DataFrame) -> DataFrame:
    """The k-mers of nodes that a clean graph (kmer, edges) has, with the edges that both have."""
    keep = clean.select("kmer", F.col("edges").alias("_e"))
    return nodes.join(keep, "kmer").withColumn("edges", F.col("edges").bitwiseAND(F.col("_e"))).drop("_e")


def wipe(nodes: DataFrame, colours: list[str]) -> DataFrame:
    return nodes.where(~F.col("colour").isin(colours))


def oriented_edges(graph: DataFrame, k: int) -> DataFrame:
    """(src, src_fw, base, dst, dst_fw, edge_in): each edge of a one-colour graph from either end.

    edge_in: the bit of dst's edges that leads back.
    """
    sides = graph.select("kmer", "edges", F.explode(F.array(F.lit(True), F.lit(False))).alias("src_fw"))
    bits = sides.select("kmer", "src_fw", exits(F.col("edges"), F.col("src_fw")).alias("bits")).where("bits <> 0")
    if k <= PACKED:
        bits = bits.withColumn("_o", packed_reverse_complement(F.col("kmer"), k))
        each = bits.select(F.col("kmer").alias("src"), "src_fw", F.when(F.col("src_fw"), F.col("kmer")).otherwise(F.col("_o")).alias("_q"), "bits", F.explode(F.array(*[F.lit(b) for b in range(4)])).alias("base")).where(F.expr("(bits >> base) & 1 = 1"))
        step = F.shiftleft("_q", 2).bitwiseAND(F.lit((1 << 2 * k) - 1)).bitwiseOR(F.col("base").cast("long"))
        moved = each.select("src", "src_fw", "base", step.alias("_s"), F.shiftrightunsigned("_q", 2 * k - 2).cast("int").alias("_first"))
        moved = moved.withColumn("_r", packed_reverse_complement(F.col("_s"), k))
    else:
        bits = bits.withColumn("_q", F.when(F.col("src_fw"), F.col("kmer")).otherwise(reverse_complement(F.col("kmer"))))
        each = bits.select(F.col("kmer").alias("src"), "src_fw", "_q", "bits", F.explode(F.array(*[F.lit(b) for b in range(4)])).alias("base")).where(F.expr("(bits >> base) & 1 = 1"))
        moved = each.select("src", "src_fw", "base", F.expr("concat(substring(_q, 2), substring('ACGT', base + 1, 1))").alias("_s"), F.expr("instr('ACGT', left(_q, 1)) - 1").alias("_first"))
        moved = moved.withColumn("_r", reverse_complement(F.col("_s")))
    fw = F.col("_s") < F.col("_r")
    back = F.expr("shiftleft(1, 3 - _first + CASE WHEN _s < _r THEN 4 ELSE 0 END)")
    return moved.select("src", "src_fw", "base", F.least("_s", "_r").alias("dst"), fw.alias("dst_fw"), back.alias("edge_in"))


def health_check(graph: DataFrame, k: int) -> DataFrame:
    """(src, src_fw, base, problem): edges to no node, and edges with none back."""
    found = oriented_edges(graph, k).join(graph.select(F.col("kmer").alias("dst"), F.col("edges").alias("_e")), "dst", "left")
    problem = F.when(F.col("_e").isNull(), "missing node").when(F.col("_e").bitwiseAND(F.col("edge_in")) == 0, "missing return edge")
    return found.select("src", "src_fw", "base", problem.alias("problem")).where("problem IS NOT NULL")


def clean_orphan_edges(graph: DataFrame, k: int) -> DataFrame:
    """The graph without edges to k-mers that it does not hold."""
    bad = health_check(graph, k).where("problem = 'missing node'")
    bits = bad.groupBy(F.col("src").alias("kmer")).agg(F.bit_or(F.expr("shiftleft(1, base + CASE WHEN src_fw THEN 0 ELSE 4 END)")).alias("_b"))
    return graph.join(bits, "kmer", "left").withColumn("edges", F.col("edges").bitwiseAND(F.bitwise_not(F.coalesce("_b", F.lit(0))))).drop("_b")


def remove_low_coverage(nodes: DataFrame, threshold: int, k: int) -> DataFrame:
    """Nodes whose coverage over all colours is above a threshold, without edges to the others.

    Colours are gathered by k-mer once; only k-mers that have an edge to one that went are looked at again.
    """
    one = nodes.groupBy("kmer").agg(F.sum("covg").alias("_c"), F.bit_or("edges").alias("edges"), F.collect_list(F.struct("colour", "covg", "edges")).alias("_each"))
    kept = one.where(F.col("_c") > threshold)
    gone = one.where(F.col("_c") <= threshold).select("kmer", "edges")
    # seen from the k-mers that went: the bit of the neighbour's edges that leads to them
    bits = oriented_edges(gone, k).groupBy(F.col("dst").alias("kmer")).agg(F.bit_or("edge_in").alias("_b"))
    cut = F.bitwise_not(F.coalesce("_b", F.lit(0)))
    left = kept.join(bits, "kmer", "left").select("kmer", cut.alias("_m"), F.explode("_each").alias("x"))
    return left.select("kmer", "x.colour", "x.covg", F.col("x.edges").bitwiseAND(F.col("_m")).alias("edges"))


def degree(edges: Column, fw: Column) -> Column:
    return F.bit_count(exits(edges, fw))


def covg_distribution(nodes: DataFrame, most: int = 10000) -> DataFrame:
    """(colour, covg, n): k-mers of each coverage above 0; the last bin takes those above."""
    return nodes.where("covg > 0").groupBy("colour", F.least(F.col("covg"), F.lit(most)).alias("covg")).agg(F.count("*").alias("n"))


def degree_distribution(nodes: DataFrame) -> DataFrame:
    """(colour, out_fw, out_rc, n) of nodes by their exits on either strand."""
    return nodes.groupBy("colour", degree(F.col("edges"), F.lit(True)).alias("out_fw"), degree(F.col("edges"), F.lit(False)).alias("out_rc")).agg(F.count("*").alias("n"))


def sharing(nodes: DataFrame) -> DataFrame:
    """(n_colours, n): in how many colours nodes are; a node is in a colour if it has an edge there."""
    return nodes.where("edges <> 0").groupBy("kmer").agg(F.count("*").alias("n_colours")).groupBy("n_colours").agg(F.count("*").alias("n"))


def colour_overlaps(nodes: DataFrame) -> DataFrame:
    """(a, b, n): nodes in both of two colours, each with itself too.

    Pairs are made within a k-mer's set of colours, which there are few of, and
    counted by set first.
    """
    sets = nodes.where("edges <> 0").groupBy("kmer").agg(F.array_sort(F.collect_set("colour")).alias("cs")).groupBy("cs").agg(F.count("*").alias("n"))
    return sets.select(F.explode("cs").alias("a"), "cs", "n").select("a", F.explode("cs").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n"))


def kmers_of(seqs: DataFrame, k: int, id_col: str) -> DataFrame:
    """(id, pos, kmer, fw) of every k-mer of sequences without other letters than ACGT, a piece of a long sequence at a time."""
    piece = (1 << 20) if k <= PACKED else (1 << 17)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(0).type
            for one, seq in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                whole = _CODE[np.frombuffer((seq or "").upper().encode(), np.uint8)]
                for start in range(0, len(whole) - k + 1, piece):
                    codes = whole[start : start + piece + k - 1]
                    kmer, fw = canonical_kmers(codes, k)
                    bad = np.concatenate(([0], np.cumsum(codes == 4)))
                    good = np.flatnonzero(bad[k:] == bad[:-k])
                    yield pa.RecordBatch.from_arrays([pa.repeat(one, len(good)).cast(kind), pa.array((good + start).astype(np.int32)), _column(kmer[good]), pa.array(fw[good])], ["id", "pos", "kmer", "fw"])

    kind = dict(seqs.dtypes)[id_col]
    return seqs.select(id_col, "seq").mapInArrow(run, f"id {kind}, pos int, kmer {kmer_type(k)}, fw boolean")


def align(seqs: DataFrame, nodes: DataFrame, k: int, id_col: str, colours: list[str]) -> DataFrame:
    """(id, pos, one column of coverage for each colour): each k-mer of a sequence, 0 where a colour has none."""
    wide = nodes.where(F.col("colour").isin(colours)).groupBy("kmer").pivot("colour", colours).agg(F.first("covg"))
    joined = kmers_of(seqs, k, id_col).join(wide, "kmer", "left")
    return joined.select("id", "pos", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in colours])


def pan_genome_matrix(genes: DataFrame, nodes: DataFrame, k: int, id_col: str) -> DataFrame:
    """(id, colour, fraction, least): share of a gene's k-mers with coverage in a colour, to two places, and the least coverage among those found.

    Every gene with a k-mer has a row for every colour of the graph: 0 and null where none is found.
    """
    places = kmers_of(genes, k, id_col)
    sizes = places.groupBy("id").agg(F.count("*").alias("size"))
    colours = nodes.select("colour").distinct().agg(F.array_sort(F.collect_list("colour")).alias("colours"))  # one row
    every = sizes.crossJoin(F.broadcast(colours)).select("id", "size", F.explode("colours").alias("colour"))
    hits = places.join(nodes.where("covg > 0"), "kmer").groupBy("id", "colour").agg(F.count("*").alias("hits"), F.min("covg").alias("least"))
    return every.join(hits, ["id", "colour"], "left").select("id", "colour", F.round(F.coalesce("hits", F.lit(0)) / F.col("size"), 2).alias("fraction"), "least")
