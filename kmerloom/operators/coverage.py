"""Sequences against a graph: where they lie in it, and measures of their coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import exits
from .graph import clean_orphan_edges, kmers_of


def covg_stats(covgs: Column) -> Column:
    """(least, most, average, mode, percent_at_mode, percent_absent) of an array of coverages; of equally frequent ones the mode is the least.

    Nulls if the array is empty.
    """
    n = F.size(covgs)
    kinds = F.array_sort(F.array_distinct(covgs))
    counted = F.transform(kinds, lambda x: F.struct(F.size(F.filter(covgs, lambda y: y == x)).alias("n"), (-x).alias("v")))
    top = F.array_max(counted)
    share = lambda m: F.when(n > 0, (100 * m / n).cast("int"))
    return F.struct(
        F.array_min(covgs).alias("least"), F.array_max(covgs).alias("most"), F.when(n > 0, F.aggregate(covgs, F.lit(0).cast("long"), lambda a, x: a + x) / n).alias("average"),
        (-top["v"]).alias("mode"), share(top["n"]).alias("percent_at_mode"), share(F.size(F.filter(covgs, lambda x: x == 0))).alias("percent_absent"),
    )


def unshared_coverage(places: DataFrame, nodes: DataFrame, colour: str) -> DataFrame:
    """(id, which, covgs): the coverage in a colour of the k-mers of either of two sequences that the other has not, in order, from (id, which, pos, kmer)."""
    sides = places.groupBy("id", "kmer").agg(F.count_distinct("which").alias("_n"))
    own = places.join(sides.where("_n = 1").select("id", "kmer"), ["id", "kmer"], "left_semi")
    found = own.join(nodes.where(F.col("colour") == colour).select("kmer", "covg"), "kmer", "left")
    return found.groupBy("id", "which").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("covg", F.lit(0)).cast("long").alias("covg")))), lambda x: x["covg"]).alias("covgs"))


def marked_steps(seqs: DataFrame, graph: DataFrame, k: int, id_col: str) -> DataFrame:
    """(id, pos, there, edge): whether each k-mer of a sequence is in a graph (kmer, edges), and the edge on from it along the sequence.

    K-mers with other letters than ACGT are left out.  The base after a k-mer is
    the last of the one that follows it.
    """
    places = kmers_of(seqs, k, id_col)
    held = places.join(graph.select("kmer", "edges"), "kmer", "left")
    bases = seqs.select(F.col(id_col).alias("id"), F.upper("seq").alias("_s"))
    on = held.join(bases, "id").withColumn("_b", F.expr(f"instr('ACGT', substring(_s, pos + {k} + 1, 1)) - 1")).drop("_s")
    edge = (F.col("_b") >= 0) & (F.expr("shiftright(_x, _b) & 1") == 1)
    return on.withColumn("_x", exits(F.col("edges"), F.col("fw"))).select("id", "pos", F.col("edges").isNotNull().alias("there"), F.coalesce(F.when(F.col("_b") >= 0, edge), F.lit(False)).alias("edge"))


def broken_at_graph(seqs: DataFrame, graph: DataFrame, k: int, id_col: str, edges: bool = False) -> DataFrame:
    """(id, part, start, seq): the stretches of sequences whose k-mers are all in a graph, and with edges those between neighbours too; start from 0."""
    steps = marked_steps(seqs, graph, k, id_col).where("there")
    order = Window.partitionBy("id").orderBy("pos")
    joined = (F.lag("pos").over(order) == F.col("pos") - 1) & (F.lag("edge").over(order) if edges else F.lit(True))
    parts = steps.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("part", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    spans = parts.groupBy("id", "part").agg(F.min("pos").alias("start"), F.max("pos").alias("last"))
    texts = seqs.select(F.col(id_col).alias("id"), F.upper("seq").alias("_s"))
    return spans.join(texts, "id").select("id", F.col("part").cast("int").alias("part"), "start", F.substring(F.col("_s"), F.col("start") + 1, F.col("last") - F.col("start") + k).alias("seq"))


def lying_in_graph(seqs: DataFrame, graph: DataFrame, k: int, id_col: str, edges: bool = False) -> DataFrame:
    """The sequences of at least k bases all of whose k-mers are in a graph, and with edges all steps between them."""
    whole = broken_at_graph(seqs, graph, k, id_col, edges).where("start = 0").select(F.col("id").alias("_i"), F.length("seq").alias("_n"))
    return seqs.join(whole, (seqs[id_col] == whole["_i"]) & (F.length(seqs["seq"]) == whole["_n"]), "left_semi")


def paths_in_colour(seqs: DataFrame, nodes: DataFrame, k: int, id_col: str, colour: str) -> DataFrame:
    """(id, present): whether each sequence is a path of one colour, edge by edge; a sequence of one k-mer is if that is a node.

    Sequences without a k-mer are not.
    """
    graph = nodes.where(F.col("colour") == colour).select("kmer", "edges")
    found = lying_in_graph(seqs, graph, k, id_col, True).select(F.col(id_col).alias("id"), F.lit(True).alias("_p")).distinct()
    return seqs.select(F.col(id_col).alias("id")).distinct().join(found, "id", "left").select("id", F.coalesce("_p", F.lit(False)).alias("present"))


def touched(seqs: DataFrame, nodes: DataFrame, k: int, id_col: str) -> DataFrame:
    """The part of a graph whose k-mers sequences hold, without edges that leave it."""
    kept = nodes.join(kmers_of(seqs, k, id_col).select("kmer").distinct(), "kmer", "left_semi")
    whole = clean_orphan_edges(kept.groupBy("kmer").agg(F.bit_or("edges").alias("edges")), k).select("kmer", F.col("edges").alias("_e"))
    return kept.join(whole, "kmer").withColumn("edges", F.col("edges").bitwiseAND(F.col("_e"))).drop("_e")


def uniqueness(refs: DataFrame, k: int, id_col: str) -> DataFrame:
    """(id, pos, times): how often each k-mer of reference sequences stands in all of them, on either strand."""
    places = kmers_of(refs, k, id_col).select("id", "pos", "kmer")
    return places.join(places.groupBy("kmer").agg(F.count("*").alias("times")), "kmer").select("id", "pos", "times")


def multicopy(alleles: DataFrame, refs: DataFrame, k: int, id_col: str = "var_id", ref_id: str = "chrom") -> DataFrame:
    """(id, multicopy): whether every k-mer of an allele (id, seq) stands more than once in reference sequences; without a k-mer it does not."""
    times = kmers_of(refs, k, ref_id).groupBy("kmer").agg(F.count("*").alias("times"))
    asked = kmers_of(alleles, k, id_col).join(times, "kmer", "left").groupBy("id").agg(F.min(F.coalesce("times", F.lit(0))).alias("least"))
    return alleles.select(F.col(id_col).alias("id")).distinct().join(asked, "id", "left").select("id", F.coalesce(F.col("least") > 1, F.lit(False)).alias("multicopy"))
