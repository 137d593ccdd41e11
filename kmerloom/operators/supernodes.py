"""Questions about supernodes: of a node, by a condition on their nodes, by colour.

Supernodes are rows of unitigs(), from either end or once; kmers are their
oriented nodes in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import node, node_kmer, node_text
from .graph import degree, oriented_edges

ALL, ANY, ENDS = "all", "any", "ends"


def named(found: DataFrame) -> DataFrame:
    """Supernodes with an id made of their sequence."""
    return found.withColumn("supernode", F.xxhash64("seq"))


def nodes_of(found: DataFrame, k: int) -> DataFrame:
    """(supernode, pos, node, kmer, n) of every node of named supernodes; n: how many there are."""
    rows = found.select("supernode", F.size("kmers").alias("n"), F.posexplode("kmers").alias("pos", "node"))
    return rows.withColumn("kmer", node_kmer(F.col("node"), k))


def supernodes_of(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(kmer, supernode, seq, pos, fw) of each k-mer asked for: the supernodes it is in, and where and on which strand.

    A k-mer that forks is an end of several.  One without edges is a supernode by
    itself, at 0.
    """
    places = nodes_of(found, k).select("kmer", "supernode", "pos", "node").join(found.select("supernode", "seq"), "supernode")
    held = queries.select("kmer").distinct().join(places, "kmer", "left")
    alone = node(F.col("kmer"), F.lit(True), k)
    seq = F.coalesce("seq", node_text(alone, k))
    return held.select("kmer", F.coalesce("supernode", F.xxhash64(seq)).alias("supernode"), seq.alias("seq"), F.coalesce("pos", F.lit(0)).alias("pos"), (F.coalesce("node", alone) == alone).alias("fw"))


def steps_of(found: DataFrame) -> DataFrame:
    """(supernode, pos, node, next) along each supernode, from its first node on; the last has no next."""
    rows = found.select("supernode", "kmers", F.posexplode("kmers").alias("pos", "node"))
    return rows.select("supernode", "pos", "node", F.expr("get(kmers, pos + 1)").alias("next"))


def is_end(graph: DataFrame, k: int) -> DataFrame:
    """(kmer, fw, ends): whether a supernode ends at a node on either strand: not one exit, or one into a node of several entries."""
    out = degree(F.col("edges"), F.col("fw"))
    sides = graph.select("kmer", "edges", F.explode(F.array(F.lit(True), F.lit(False))).alias("fw")).select("kmer", "fw", out.alias("n_out"))
    into = graph.select(F.col("kmer").alias("dst"), F.col("edges").alias("_e"))
    entries = degree(F.col("_e"), ~F.col("dst_fw"))
    steps = oriented_edges(graph, k).join(into, "dst", "left").select(F.col("src").alias("kmer"), F.col("src_fw").alias("fw"), F.coalesce(entries, F.lit(0)).alias("entries"))
    one = steps.groupBy("kmer", "fw").agg(F.max("entries").alias("entries"))
    return sides.join(one, ["kmer", "fw"], "left").select("kmer", "fw", ((F.col("n_out") != 1) | (F.coalesce("entries", F.lit(0)) > 1)).alias("ends"))


def section(seq: Column, first: Column, last: Column, k: int) -> Column:
    """The bases from one node of a supernode to another."""
    return F.substring(seq, first + 1, last - first + k)


def best_section(found: DataFrame, covered: DataFrame, k: int, least: int = 1) -> DataFrame:
    """(supernode, first, last, seq): of each supernode the longest stretch of nodes that are all in covered (kmer), at least so many; of equal ones the first."""
    held = nodes_of(found, k).join(covered.select("kmer").distinct(), "kmer", "left_semi")
    listed = held.groupBy("supernode").agg(F.array_sort(F.collect_list("pos")).alias("p"))
    # a stretch: places less their rank are equal
    runs = listed.select("supernode", F.explode(F.expr("transform(p, (x, i) -> struct(x - i AS run, x AS pos))")).alias("x")).groupBy("supernode", "x.run").agg(F.min("x.pos").alias("first"), F.max("x.pos").alias("last"))
    best = runs.where(F.col("last") - F.col("first") + 1 >= least).groupBy("supernode").agg(F.max(F.struct((F.col("last") - F.col("first")).alias("n"), (-F.col("first")).alias("early"), "last")).alias("m"))
    return best.join(found, "supernode").select("supernode", (-F.col("m.early")).alias("first"), F.col("m.last").alias("last"), section(F.col("seq"), -F.col("m.early"), F.col("m.last"), k).alias("seq"))


def consensus(found: DataFrame, nodes: DataFrame, k: int, least_covg: int, least_colours: int, least: int = 1) -> DataFrame:
    """The best section of each supernode whose nodes at least so many colours cover at least so often."""
    covered = nodes.where(F.col("covg") >= least_covg).groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") >= least_colours)
    return best_section(found, covered, k, least)


def where_nodes(found: DataFrame, fitting: DataFrame, k: int, which: str) -> DataFrame:
    """Supernodes all of whose nodes are in fitting (kmer), any of them, or both ends but not all between."""
    marked = nodes_of(found, k).join(fitting.select("kmer", F.lit(1).alias("_f")).distinct(), "kmer", "left")
    fits = F.col("_f").isNotNull()
    counted = marked.groupBy("supernode").agg(F.bool_and(fits).alias("a"), F.bool_or(fits).alias("o"), F.bool_and(fits | ((F.col("pos") > 0) & (F.col("pos") < F.col("n") - 1))).alias("e"))
    test = {ALL: F.col("a"), ANY: F.col("o"), ENDS: F.col("e") & ~F.col("a")}[which]
    return found.join(counted.where(test).select("supernode"), "supernode", "left_semi")


def coverage_by_colour(found: DataFrame, nodes: DataFrame, k: int, colours: list[str]) -> DataFrame:
    """(supernode, colour, covgs): the coverage of each node in order, 0 where a colour has none."""
    asked = nodes_of(found, k).select("supernode", "pos", "kmer", F.explode(F.array(*[F.lit(c) for c in colours])).alias("colour"))
    own = asked.join(nodes.select("kmer", "colour", "covg"), ["kmer", "colour"], "left")
    return own.groupBy("supernode", "colour").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("covg", F.lit(0)).cast("long").alias("covg")))), lambda x: x["covg"]).alias("covgs"))


def coverage_shares(found: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(colour, supernode, share): the part of a colour's coverage that is on each supernode; a node in several counts in each."""
    per = nodes_of(found, k).select("supernode", "kmer").distinct().join(nodes.select("kmer", "colour", "covg"), "kmer").groupBy("colour", "supernode").agg(F.sum("covg").alias("own"))
    whole = nodes.groupBy("colour").agg(F.sum("covg").alias("whole"))
    return per.join(whole, "colour").select("colour", "supernode", F.round(F.col("own") / F.col("whole"), 6).alias("share"))


def splitting(found: DataFrame, nodes: DataFrame, k: int, first: str, second: str) -> DataFrame:
    """(supernode, n, only_first, only_second, both) of supernodes with nodes that only one of two colours has, for either."""
    marked = nodes.where(F.col("colour").isin(first, second) & (F.col("edges") != 0)).groupBy("kmer").agg(F.bool_or(F.col("colour") == first).alias("x"), F.bool_or(F.col("colour") == second).alias("y"))
    held = nodes_of(found, k).join(marked, "kmer")
    n = lambda c: F.count(F.when(c, 1))
    counted = held.groupBy("supernode", "n").agg(n(F.col("x") & ~F.col("y")).alias("only_first"), n(F.col("y") & ~F.col("x")).alias("only_second"), n(F.col("x") & F.col("y")).alias("both"))
    return counted.where("only_first > 0 AND only_second > 0")


def error_supernodes(found: DataFrame, threshold: int) -> DataFrame:
    """One row (errors, others): supernodes with inner nodes, by whether none has more coverage than a threshold."""
    inner = found.where("max_covg IS NOT NULL")
    return inner.agg(F.count(F.when(F.col("max_covg") <= threshold, 1)).alias("errors"), F.count(F.when(F.col("max_covg") > threshold, 1)).alias("others"))


def junctions(found: DataFrame) -> DataFrame:
    """(entries, exits, n) of supernodes by the ways into their start and on from their end."""
    return found.groupBy(F.col("src_in").alias("entries"), F.col("dst_out").alias("exits")).agg(F.count("*").alias("n"))


def frequencies(found: DataFrame) -> DataFrame:
    """(avg_covg, n) of supernodes with inner nodes, by their rounded average coverage."""
    return found.where("avg_covg IS NOT NULL").groupBy(F.round("avg_covg").cast("long").alias("avg_covg")).agg(F.count("*").alias("n"))


def lines(found: DataFrame) -> DataFrame:
    """FASTA lines of supernodes with their measures in the name, to be written as text."""
    name = F.concat_ws(" ", F.concat(F.lit("node_"), F.col("supernode").cast("string")), *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col(c).cast("string"), F.lit("NA"))) for c in ("n_edges", "avg_covg", "min_covg", "max_covg")])
    return found.select(F.concat(F.lit(">"), name, F.lit("\n"), "seq").alias("value"))
