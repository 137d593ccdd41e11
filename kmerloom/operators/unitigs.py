"""Supernodes: maximal paths whose inner nodes have one entry and one exit.

A path is a chain of oriented edges; an edge goes on to the next where the node
between them has one entry and one exit.  Chains are ranked by pointer jumping,
so a path of n edges takes log2 n joins, each of which ends in a written table.
A loop without an end is cut at its least edge.  Every path is found from either
end; of the two the one with the lesser sequence is kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import PACKED, node, node_kmer, node_text, reverse_complement
from ..tables import written as _written
from .graph import clean_orphan_edges, degree, oriented_edges


def written(df: DataFrame) -> DataFrame:
    return _written(df, "graph")


#: Edges up to which paths are ranked in one task.
SMALL = 1 << 20


def paths(graph: DataFrame, k: int) -> DataFrame:
    """(path, edge_no, src, dst, base, src_in, dst_in, dst_out, covg) of every edge of every path from either end.

    src and dst are oriented nodes, 2 * kmer + strand; src_in and dst_in, dst_out
    count their entries and exits; covg is that of dst.  graph has (kmer, covg,
    edges) of one colour or of a union.
    """
    nodes = graph.select("kmer", "covg", degree(F.col("edges"), F.lit(True)).alias("a"), degree(F.col("edges"), F.lit(False)).alias("b"))
    side = lambda fw, x, y: F.when(F.col(fw), F.col(x)).otherwise(F.col(y))
    edges = oriented_edges(graph, k)
    edges = edges.join(nodes.select(F.col("kmer").alias("src"), F.col("a").alias("sa"), F.col("b").alias("sb")), "src")
    edges = edges.join(nodes.select(F.col("kmer").alias("dst"), "covg", "a", "b"), "dst")
    edges = written(
        edges.select(
            node(F.col("src"), F.col("src_fw"), k).alias("src"), node(F.col("dst"), F.col("dst_fw"), k).alias("dst"), "base", "covg",
            side("src_fw", "sa", "sb").alias("src_out"), side("src_fw", "sb", "sa").alias("src_in"), side("dst_fw", "a", "b").alias("dst_out"), side("dst_fw", "b", "a").alias("dst_in"),
        )
    )
    return ranked(edges)


def ranked(edges: DataFrame) -> DataFrame:
    """edges with (path, edge_no): the first edge of each one's chain and the steps to it.

    edges is a table with at least (src, dst, base, dst_in, dst_out); an edge goes
    on where the last two are 1.
    """
    if edges.count() <= SMALL:
        kind = dict(edges.dtypes)["src"]
        schema = ", ".join(f"{c} {t}" for c, t in edges.dtypes)
        return edges.coalesce(1).mapInArrow(_ranked_here, f"{schema}, path struct<src: {kind}, base: int>, edge_no long")
    # an edge is named by its node and base; the one before it, if any, ends where it starts
    named = edges.withColumn("edge", F.struct("src", "base"))
    before = edges.where("dst_in = 1 AND dst_out = 1").select(F.col("dst").alias("src"), F.struct("src", "base").alias("up"))
    jump = written(named.join(before, "src", "left").select("edge", F.coalesce("up", "edge").alias("up"), F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("rank"), F.least("edge", F.coalesce("up", "edge")).alias("least")))
    jump = _ranked(jump)
    loops = jump.where("open")
    if not loops.isEmpty():
        cut = loops.where("edge = least").select("edge", F.col("edge").alias("up"), F.lit(0).cast("long").alias("rank"), "least")
        first = written(named.join(before, "src", "left").select("edge", "up"))
        rest = first.join(loops.where("edge <> least").select("edge"), "edge", "left_semi").select("edge", "up", F.lit(1).cast("long").alias("rank"), F.col("edge").alias("least"))
        jump = jump.where("NOT open").unionByName(_ranked(written(cut.unionByName(rest))))
    return named.join(jump.select("edge", F.col("up").alias("path"), F.col("rank").alias("edge_no")), "edge").drop("edge")


def _ranked_here(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a small graph with their path and place in it, by pointer jumping in memory."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).sort_by([("src", "ascending"), ("base", "ascending")])
    names = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("src", "dst")]), return_inverse=True)[1]
    n = table.num_rows
    src, dst = names[:n], names[n:]
    inner = np.flatnonzero((table.column("dst_in").to_numpy() == 1) & (table.column("dst_out").to_numpy() == 1))
    into = np.full(names.max() + 1, -1)
    into[dst[inner]] = inner
    before = into[src]
    up = np.where(before >= 0, before, np.arange(n))

    def jumped(up: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rank, least = (up != np.arange(n)).astype(np.int64), np.minimum(up, np.arange(n))
        for _ in range(max(1, n).bit_length()):
            rank, least, up = rank + rank[up], np.minimum(least, least[up]), up[up]
        return up, rank, least

    head, rank, least = jumped(up)
    loops = up[head] != head
    if loops.any():  # cut at the least edge
        up = np.where(loops & (least == np.arange(n)), np.arange(n), up)
        head, rank, least = jumped(up)
    path = pa.StructArray.from_arrays([table.column("src").combine_chunks().take(pa.array(head)), table.column("base").combine_chunks().take(pa.array(head))], ["src", "base"])
    out = table.append_column("path", path).append_column("edge_no", pa.array(rank))
    yield from out.to_batches(max_chunksize=1 << 14)


def _ranked(jump: DataFrame) -> DataFrame:
    """The first edge of each edge's chain and the steps to it; open: the chain has none."""
    count = jump.count()
    turns = 0
    while True:
        to = jump.select(F.col("edge").alias("up"), F.col("up").alias("up2"), F.col("rank").alias("rank2"), F.col("least").alias("least2"))
        jump = written(jump.join(to, "up").select("edge", F.col("up2").alias("up"), (F.col("rank") + F.col("rank2")).alias("rank"), F.least("least", "least2").alias("least")))
        turns += 1
        ends = jump.select(F.col("edge").alias("up"), (F.col("up") != F.col("edge")).alias("open"))
        marked = jump.join(ends, "up").select("edge", "up", "rank", "least", "open")
        if 2**turns > count or marked.where("open").isEmpty():
            return written(marked)


def unitigs(graph: DataFrame, k: int) -> DataFrame:
    """(seq, n_edges, avg_covg, min_covg, max_covg, is_cycle, kmers, src_in, dst_in): each path once.

    Coverage is that of inner nodes, null without any; kmers are the oriented
    nodes in order, the first's entries and the last's entries stand beside.
    """
    rows = paths(graph, k)
    whole = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("edge_no", "base", "src", "dst", "covg", "src_in", "dst_in", "dst_out"))).alias("e"))
    inner = F.expr("transform(slice(e, 1, size(e) - 1), x -> x.covg)")
    start = F.col("e")[0]["src"]
    first = node_text(start, k)
    out = whole.select(
        F.concat(first, F.expr("array_join(transform(e, x -> substring('ACGT', x.base + 1, 1)), '')")).alias("seq"), F.size("e").alias("n_edges"),
        F.when(F.size("e") > 1, F.expr("aggregate(slice(e, 1, size(e) - 1), 0L, (a, x) -> a + x.covg)") / (F.size("e") - 1)).alias("avg_covg"), F.array_min(inner).alias("min_covg"), F.array_max(inner).alias("max_covg"),
        (start == F.element_at("e", -1)["dst"]).alias("is_cycle"), F.concat(F.array(start), F.expr("transform(e, x -> x.dst)")).alias("kmers"), F.col("e")[0]["src_in"].alias("src_in"), F.element_at("e", -1)["dst_in"].alias("dst_in"), F.element_at("e", -1)["dst_out"].alias("dst_out"),
    )
    return out


def once(found: DataFrame) -> DataFrame:
    """Of the two directions of each path, the lesser sequence.  A loop's two directions are cut at different places; its least k-mer tells that they are one."""
    lines = found.where(~F.col("is_cycle") & (F.col("seq") <= reverse_complement(F.col("seq")))).dropDuplicates(["seq"])
    k = PACKED if dict(found.dtypes)["kmers"] == "array<bigint>" else PACKED + 1
    loops = found.where("is_cycle").withColumn("_least", F.array_min(F.transform("kmers", lambda x: node_kmer(x, k))))
    first = loops.groupBy("_least").agg(F.min("seq").alias("seq"))
    return lines.unionByName(loops.join(first, ["_least", "seq"], "left_semi").dropDuplicates(["_least"]).drop("_least"))


def n50(found: DataFrame, k: int) -> DataFrame:
    """One row: the length that half of all bases are in supernodes of at least, and their number."""
    sizes = found.groupBy(F.length("seq").cast("long").alias("length")).agg(F.count("*").alias("n"))
    run = sizes.withColumn("run", F.sum(F.col("length") * F.col("n")).over(Window.orderBy(F.desc("length")))).crossJoin(sizes.agg(F.sum(F.col("length") * F.col("n")).alias("total"), F.sum("n").alias("supernodes")))
    return run.where("2 * run >= total").agg(F.max("length").alias("n50"), F.max("supernodes").alias("supernodes"))


def length_distribution(found: DataFrame) -> DataFrame:
    return found.groupBy(F.length("seq").cast("long").alias("length")).agg(F.count("*").alias("n"))


def _without(graph: DataFrame, gone: DataFrame, k: int) -> DataFrame:
    kept = graph.join(gone.select(F.explode("kmers").alias("_n")).select(node_kmer(F.col("_n"), k).alias("kmer")).distinct(), "kmer", "left_anti")
    return clean_orphan_edges(kept, k)


def clip_tips(graph: DataFrame, k: int) -> DataFrame:
    """The graph without paths of at most k + 1 nodes from a blunt end to a node with several entries, found in one pass."""
    tips = unitigs(graph, k).where((F.col("src_in") == 0) & (F.col("dst_in") > 1) & (F.col("n_edges") <= k + 1))
    return _without(graph, tips.select(F.expr("slice(kmers, 1, size(kmers) - 1)").alias("kmers")), k)


def remove_low_coverage_supernodes(graph: DataFrame, k: int, threshold: int) -> DataFrame:
    """Tips clipped, then the inner nodes of paths on which none has more than the threshold removed."""
    clipped = written(clip_tips(graph, k))
    poor = unitigs(clipped, k).where(F.col("max_covg") <= threshold)
    return _without(clipped, poor.select(F.expr("slice(kmers, 2, size(kmers) - 2)").alias("kmers")), k)


def prune(graph: DataFrame, gone: DataFrame, k: int) -> DataFrame:
    """The graph without some k-mers and without edges to them, whatever their coverage."""
    return clean_orphan_edges(graph.join(gone.select("kmer").distinct(), "kmer", "left_anti"), k)


def _without_inner(graph: DataFrame, found: DataFrame, k: int, most: int | None) -> DataFrame:
    """The graph without the inner nodes of paths, those of at most so much coverage if that is said."""
    inner = found.select(F.explode(F.expr("slice(kmers, 2, size(kmers) - 2)")).alias("_n")).select(node_kmer(F.col("_n"), k).alias("kmer")).distinct()
    gone = inner if most is None else inner.join(graph.where(F.col("covg") <= most).select("kmer"), "kmer", "left_semi")
    return prune(graph, gone, k)


def remove_poor_supernodes(graph: DataFrame, k: int, threshold: int) -> DataFrame:
    """Tips clipped, then of paths whose inner nodes have a mean coverage below the threshold the inner nodes of at most that coverage removed."""
    clipped = written(clip_tips(graph, k))
    return _without_inner(clipped, unitigs(clipped, k).where(F.col("avg_covg") < threshold), k, threshold)


def remove_likely_errors(graph: DataFrame, k: int, threshold: int) -> DataFrame:
    """The graph without the inner nodes of paths that look more like errors than like poor sampling.

    Those are paths of at most k + 1 inner nodes with coverage up to the threshold
    on all, and of at most 2 (k + 1) with up to one more.
    """
    n = F.size("kmers") - 2
    short, longer = (n <= k + 1) & (F.col("max_covg") <= threshold), (n <= 2 * (k + 1)) & (F.col("max_covg") <= threshold + 1)
    return _without_inner(graph, unitigs(graph, k).where(short | longer), k, None)


def smooth_bubbles(graph: DataFrame, k: int, threshold: int) -> DataFrame:
    """The graph with one branch of each bubble: a branch whose nodes have at most the threshold's coverage goes if the other's have more.

    Of two poor branches the one with less coverage at its best node goes, of
    equal ones the second.
    """
    found = bubbles(graph, k).withColumn("_b", F.monotonically_increasing_id())
    found = written(found.select("_b", "inner1", "inner2"))
    sides = found.select("_b", F.posexplode(F.array("inner1", "inner2")).alias("which", "inner")).select("_b", "which", F.explode("inner").alias("kmer"))
    best = sides.join(graph.select("kmer", "covg"), "kmer").groupBy("_b", "which").agg(F.max("covg").alias("best"))
    worse = best.groupBy("_b").agg(F.min(F.struct("best", (-F.col("which")).alias("w"))).alias("m"), F.count("*").alias("n")).where((F.col("n") == 2) & (F.col("m.best") <= threshold))
    gone = sides.join(worse.select("_b", (-F.col("m.w")).alias("which")), ["_b", "which"], "left_semi")
    return prune(graph, gone, k)


def novel_contigs(graph: DataFrame, others: DataFrame, k: int, least_length: int, least_percent: int) -> DataFrame:
    """(seq, percent): paths of at least so many bases whose inner nodes are absent from others (kmer) in at least so many integer percent."""
    found = once(unitigs(graph, k)).where(F.length("seq") >= least_length).select("seq", F.expr("explode_outer(slice(kmers, 2, size(kmers) - 2))").alias("_n"))
    held = found.withColumn("kmer", node_kmer(F.col("_n"), k)).join(others.select("kmer", F.lit(1).alias("_h")).distinct(), "kmer", "left")
    counted = held.groupBy("seq").agg(F.count("_n").alias("n"), F.count(F.when(F.col("_n").isNotNull() & F.col("_h").isNull(), 1)).alias("new"))
    return counted.where("n > 0").select("seq", F.expr("cast(100 * new div n AS int)").alias("percent")).where(F.col("percent") >= least_percent)


def bubbles(graph: DataFrame, k: int) -> DataFrame:
    """(start, branch1, branch2, stop, inner1, inner2): two paths that leave a node and meet at one, by first base; one pair for a start.

    Of a bubble seen from its two ends the one from the lesser node is kept.
    Branches are the bases after the start's k-mer, inner1 and inner2 the k-mers
    between start and stop.
    """
    return bubbles_of(unitigs(graph, k), k)


def bubbles_of(paths_: DataFrame, k: int) -> DataFrame:
    """The bubbles among paths that unitigs() gave."""
    inner = F.transform(F.expr("slice(kmers, 2, size(kmers) - 2)"), lambda x: node_kmer(x, k))
    rows = paths_.select(F.col("kmers")[0].alias("start"), F.element_at("kmers", -1).alias("stop"), F.struct(F.expr(f"substring(seq, {k + 1})").alias("branch"), inner.alias("inner")).alias("b"))
    pair = rows.groupBy("start", "stop").agg(F.array_sort(F.collect_list("b")).alias("b")).where("size(b) > 1")
    one = Window.partitionBy("start").orderBy("branch1", "branch2")
    cell = lambda i, f: F.col("b")[i][f].alias(f"{f}{i + 1}")
    found = pair.select("start", cell(0, "branch"), cell(1, "branch"), "stop", cell(0, "inner"), cell(1, "inner")).withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    return found.where(node_kmer(F.col("start"), k) <= node_kmer(F.col("stop"), k))
