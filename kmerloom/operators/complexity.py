"""How often a change to a read would be found: genome complexity; random walks and strands of corrected reads.

All draws are hashes of a seed and of what is drawn for, so a lost task draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import exits, kmer_text, reverse_complement
from .graph import degree, kmers_of
from .unitigs import written

#: Usable reads that the estimate looks at.
READS = 10_000


def _draw(n: Column | int, *of: Column) -> Column:
    return F.pmod(F.xxhash64(*of), n if isinstance(n, Column) else F.lit(n))


def changed_in_the_middle(reads: DataFrame, k: int, seed: int = 0, id_col: str = "read_id") -> DataFrame:
    """(id, ref, alt): the first 2 k + 1 bases of reads that have as many and only ACGT, and the same with another base in the middle."""
    ref = F.upper(F.substring("seq", 1, 2 * k + 1))
    rows = reads.select(F.col(id_col).alias("id"), ref.alias("ref")).where((F.length("ref") == 2 * k + 1) & ~F.col("ref").rlike("[^ACGT]"))
    code = F.expr(f"instr('ACGT', substring(ref, {k + 1}, 1)) - 1")
    other = rows.withColumn("_b", ((code + 1 + _draw(3, F.lit(seed), F.col("id"))) % 4).cast("int"))
    return other.select("id", "ref", F.concat(F.expr(f"left(ref, {k})"), F.expr("substring('ACGT', _b + 1, 1)"), F.expr(f"substring(ref, {k + 2})")).alias("alt"))


def genome_complexity(reads: DataFrame, graph: DataFrame, k: int, seed: int = 0, most: int = READS, id_col: str = "read_id") -> DataFrame:
    """One row (used, clean, share): of the first usable reads, those whose change in the middle would make a clean bubble.

    A read is usable if the stretch around its middle lies in the graph (kmer,
    edges).  Its bubble is clean if, on both alleles, every one of the first k + 1
    k-mers that the graph has goes on in one way only.  share is null without
    usable reads.
    """
    first = changed_in_the_middle(reads, k, seed, id_col)
    two = first.select(F.concat_ws(":", F.col("id").cast("string"), F.lit("r")).alias("id"), F.col("ref").alias("seq")).unionByName(first.select(F.concat_ws(":", F.col("id").cast("string"), F.lit("a")).alias("id"), F.col("alt").alias("seq")))
    held = kmers_of(two, k, "id").join(graph.select("kmer", "edges"), "kmer", "left")
    there = F.col("edges").isNotNull()
    forks = there & (F.col("pos") <= k) & (degree(F.col("edges"), F.col("fw")) != 1)
    per = held.groupBy(F.regexp_extract("id", "^(.*):.$", 1).cast("long").alias("id")).agg(F.bool_and(there | F.endswith("id", F.lit(":a"))).alias("usable"), (~F.bool_or(forks)).alias("clean"))
    used = per.where("usable").orderBy("id").limit(most)
    return used.agg(F.count("*").alias("used"), F.count(F.when(F.col("clean"), 1)).alias("clean")).withColumn("share", F.when(F.col("used") > 0, F.col("clean") / F.col("used")))


def padded(reads: DataFrame, graph: DataFrame, k: int, steps: int, seed: int = 0, id_col: str = "id") -> DataFrame:
    """reads (id, seq, ...) with seq made longer by so many bases: a random walk along the graph (kmer, edges) from the last k-mer, then A where it has no way on.

    A step is a join; of the edges out of a node each is as likely.
    """
    if steps <= 0:
        return reads
    words = written(graph.select(kmer_text(F.col("kmer"), k).alias("_w"), "edges"))
    others = [c for c in reads.columns if c not in (id_col, "seq")]
    state = reads.withColumn("_tail", F.upper(F.expr(f"right(seq, {k})"))).withColumn("_pad", F.lit(""))
    for step in range(steps):
        fw = F.col("_tail") < reverse_complement(F.col("_tail"))
        keyed = state.withColumns({"_w": F.least("_tail", reverse_complement(F.col("_tail"))), "_fw": fw})
        met = keyed.join(words, "_w", "left").withColumn("_x", F.coalesce(exits(F.col("edges"), F.col("_fw")), F.lit(0)))
        ways = F.filter(F.array(*[F.lit(b) for b in "ACGT"]), lambda b: F.col("_x").bitwiseAND(F.when(b == "A", 1).when(b == "C", 2).when(b == "G", 4).otherwise(8)) != 0)
        chosen = met.withColumn("_ways", ways).withColumn("_b", F.when(F.size("_ways") > 0, F.get("_ways", _draw(F.greatest(F.size("_ways"), F.lit(1)), F.lit(seed), F.lit(step), F.col(id_col)).cast("int"))))
        state = written(chosen.select(id_col, "seq", *others, F.when(F.col("_b").isNotNull(), F.concat(F.expr("substring(_tail, 2)"), "_b")).otherwise("").alias("_tail"), F.concat("_pad", F.coalesce("_b", F.lit(""))).alias("_pad")))
    return state.select(*[F.concat("seq", F.rpad("_pad", steps, "A")).alias("seq") if c == "seq" else F.col(c) for c in reads.columns])


def on_reference_strand(reads: DataFrame, refs: DataFrame, k: int, id_col: str = "id", ref_id: str = "chrom") -> DataFrame:
    """reads with seq and qual (if there) turned where the first of their k-mers that a reference (chrom, seq) holds lies on its other strand; turned says so.

    A k-mer that stands in the reference on both strands counts as where it stands first.
    """
    first = kmers_of(refs, k, ref_id).groupBy("kmer").agg(F.min(F.struct("id", "pos", "fw")).alias("m")).select("kmer", F.col("m.fw").alias("ref_fw"))
    met = kmers_of(reads, k, id_col).join(first, "kmer").groupBy("id").agg(F.min(F.struct("pos", (F.col("fw") != F.col("ref_fw")).alias("t"))).alias("m")).select(F.col("id").alias("_i"), F.col("m.t").alias("_t"))
    out = reads.join(met, reads[id_col] == met["_i"], "left").withColumn("turned", F.coalesce("_t", F.lit(False))).drop("_i", "_t")
    out = out.withColumn("seq", F.when(F.col("turned"), reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    return out.withColumn("qual", F.when(F.col("turned"), F.reverse("qual")).otherwise(F.col("qual"))) if "qual" in reads.columns else out


def simulated_chromosomes(refs: DataFrame, rate: float, seed: int = 0, name: str = "chrom") -> tuple[DataFrame, DataFrame]:
    """(chromosomes, truth): sequences with single bases changed at a rate, and the changes as (chrom, pos, ref, alt).

    Long sequences are better cut into windows of their own before.
    """
    base = F.expr("substring(seq, p, 1)")
    places = refs.select(F.col(name).alias("chrom"), "seq", F.explode(F.expr("CASE WHEN length(seq) > 0 THEN sequence(1, length(seq)) ELSE array() END")).alias("p")).select("chrom", "p", F.upper(base).alias("ref"))
    draw = _draw(1 << 30, F.lit(seed), F.col("chrom"), F.col("p")) / float(1 << 30)
    code = F.expr("instr('ACGT', ref) - 1")
    new = F.substring(F.lit("ACGT"), ((code + 1 + _draw(3, F.lit(seed), F.lit("which"), F.col("chrom"), F.col("p"))) % 4).cast("int") + 1, F.lit(1))
    marked = places.withColumn("alt", F.when((draw < rate) & F.col("ref").isin(*"ACGT"), new).otherwise(F.col("ref")))
    truth = marked.where("ref <> alt").select("chrom", F.col("p").cast("long").alias("pos"), "ref", "alt")
    made = marked.groupBy("chrom").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "alt"))), lambda x: x["alt"]), "").alias("seq"))
    return made, truth


def random_chromosome(spark, name: str, length: int, seed: int = 0) -> DataFrame:
    """(chrom, seq): one row of so many bases, drawn in windows by all tasks."""
    size = 1 << 14
    windows = spark.range(0, max(1, -(-length // size))).select(F.col("id").alias("w"), F.expr(f"cast(least({size}, {length} - id * {size}) AS int)").alias("n")).where("n > 0")
    letters = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.substring(F.lit("ACGT"), _draw(4, F.lit(seed), F.col("w"), i).cast("int") + 1, F.lit(1)))
    parts = windows.select("w", F.array_join(letters, "").alias("s"))
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w", "s"))), lambda x: x["s"]), "").alias("seq")).select(F.lit(name).alias("chrom"), "seq")
