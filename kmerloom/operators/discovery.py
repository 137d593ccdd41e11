"""Variants: bubbles by colour, and paths of a sample that leave a reference and return to it.

Variants are rows (var_id, flank5p, branch1, branch2, flank3p); a 5' flank ends
with the k-mer that both branches leave from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dna import node, node_text, reverse_complement
from .graph import kmers_of, union_of_colours
from .unitigs import bubbles, bubbles_of, unitigs, written

FLANK = 1000


def with_flanks(found: DataFrame, paths: DataFrame, k: int, longest: int = FLANK) -> DataFrame:
    """Bubbles with flank5p and flank3p: the one path into the start, the one path on from the stop, at most longest bases beside the k-mer."""
    into = paths.where("dst_in = 1").select(F.element_at("kmers", -1).alias("start"), F.expr(f"right(seq, {longest + k})").alias("_5"))
    onward = paths.groupBy(F.col("kmers")[0].alias("stop")).agg(F.count("*").alias("_n"), F.min("seq").alias("_3")).where("_n = 1").select("stop", F.expr(f"substring(_3, {k + 1}, {longest})").alias("_3"))
    joined = found.join(into, "start", "left").join(onward, "stop", "left")
    return joined.withColumns({"flank5p": F.coalesce("_5", node_text(F.col("start"), k)), "flank3p": F.coalesce("_3", F.lit(""))}).drop("_5", "_3")


def numbered(variants: DataFrame) -> DataFrame:
    """var_id by the order of the sequences: ranges of them are sorted apart, and a variant's number is those of the ranges before and its row in its own."""
    order = ["flank5p", "branch1", "branch2", "flank3p"]
    rows = written(variants.repartitionByRange(*order).sortWithinPartitions(*order)).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    part = F.regexp_extract("_file", "part-(\\d+)", 1).cast("long")
    before = F.sum("_n").over(Window.orderBy(part, "_file")) - F.col("_n")  # a row for each file
    whole = rows.join(files.select("_file", before.alias("_before")), "_file")
    return whole.withColumn("var_id", F.concat(F.lit("var_"), (F.col("_before") + F.col("_row") + 1).cast("string"))).drop("_file", "_row", "_before")


def call_bubbles(nodes: DataFrame, k: int, first: list[str], second: list[str], excluded: str | None = None) -> DataFrame:
    """(start, stop, flank5p, branch1, branch2, flank3p, inner1, inner2) of the bubbles in the union of colours.

    With first the same as second, all of them.  Else those of which one branch
    is wholly in first and absent from second and the other the reverse; absent
    is at most one inner k-mer with coverage.  excluded: a colour whose own
    bubbles' inner k-mers may not be in a branch.
    """
    every = sorted({*first, *second})
    paths = written(unitigs(written(union_of_colours(nodes, every)), k))
    found = bubbles_of(paths, k)
    both = F.posexplode(F.array("inner1", "inner2")).alias("which", "inner")
    if sorted(set(first)) != sorted(set(second)):
        steps = found.select("start", "stop", both).select("start", "stop", "which", F.size("inner").alias("n"), F.explode_outer("inner").alias("kmer"))
        covered = nodes.where("covg > 0").groupBy("kmer").agg(F.bool_or(F.col("colour").isin(first)).alias("s"), F.bool_or(F.col("colour").isin(second)).alias("t"))
        seen = steps.join(covered, "kmer", "left").groupBy("start", "stop", "which", "n").agg(F.count(F.when(F.col("s"), 1)).alias("s"), F.count(F.when(F.col("t"), 1)).alias("t"))
        kind = F.struct(((F.col("s") == F.col("n")) & (F.col("t") <= 1)).alias("a"), ((F.col("t") == F.col("n")) & (F.col("s") <= 1)).alias("b"))
        sides = seen.groupBy("start", "stop").agg(F.max(F.when(F.col("which") == 0, kind)).alias("x"), F.max(F.when(F.col("which") == 1, kind)).alias("y"))
        found = found.join(sides.where("(x.a AND y.b) OR (x.b AND y.a)").select("start", "stop"), ["start", "stop"], "left_semi")
    if excluded is not None:
        own = bubbles(written(union_of_colours(nodes, [excluded])), k)
        bad = own.select(F.explode(F.concat("inner1", "inner2")).alias("kmer")).distinct()
        hit = found.select("start", "stop", F.explode(F.concat("inner1", "inner2")).alias("kmer")).join(bad, "kmer", "left_semi").select("start", "stop").distinct()
        found = found.join(hit, ["start", "stop"], "left_anti")
    return with_flanks(found, paths, k)


def callfile(variants: DataFrame) -> DataFrame:
    """FASTA lines of numbered variants, to be written as text: four entries each."""
    parts = [("5p_flank", "flank5p"), ("branch_1", "branch1"), ("branch_2", "branch2"), ("3p_flank", "flank3p")]
    entries = [F.concat(F.lit(">"), "var_id", F.lit(f"_{name} length:"), F.length(c).cast("string"), F.lit("\n"), F.col(c)) for name, c in parts]
    return variants.select(F.concat_ws("\n", *entries).alias("value"))


def read_callfile(spark: SparkSession, path: str) -> DataFrame:
    """Variants of a call file as callfile writes it."""
    from ..sources.reads import read_fasta

    names = {"flank5p": "5p_flank", "branch1": "branch_1", "branch2": "branch_2", "flank3p": "3p_flank"}
    rows = read_fasta(spark, path).select(F.regexp_extract("name", "^(.*?)_(5p_flank|branch_1|branch_2|3p_flank)\\b", 1).alias("var_id"), F.regexp_extract("name", "_(5p_flank|branch_1|branch_2|3p_flank)\\b", 1).alias("part"), "seq")
    return rows.where("var_id <> ''").groupBy("var_id").agg(*[F.max(F.when(F.col("part") == p, F.col("seq"))).alias(c) for c, p in names.items()])


def allele_coverages(variants: DataFrame, nodes: DataFrame, k: int, colours: list[str], closed: bool = False) -> DataFrame:
    """(var_id, colour, covgs1, covgs2): coverage of each inner k-mer of either branch, in order, 0 where a colour has none.

    A branch's inner k-mers are those with a base of it that do not lie wholly in
    a flank; those of closed branches, which end with the k-mer they meet at, all
    but that.
    """
    after = F.lit("") if closed else F.expr(f"left(flank3p, {k})")
    whole = lambda b: F.concat(F.expr(f"right(flank5p, {k})"), F.expr(f"left({b}, length({b}) - 1)") if closed else F.col(b), after)
    two = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), whole(f"branch{i}").alias("seq"), F.length(f"branch{i}").alias("n")) for i in (1, 2)])).alias("x")
    seqs = variants.select("var_id", two).select(F.struct("var_id", F.col("x.which").alias("which")).alias("key"), F.col("x.seq").alias("seq"))
    flat = seqs.select(F.to_json("key").alias("id"), "seq")
    places = kmers_of(flat, k, "id").where("pos > 0")
    wanted = F.explode(F.array(*[F.lit(c) for c in colours])).alias("colour")
    asked = places.select("id", "pos", "kmer", wanted)
    own = asked.join(nodes.select("kmer", "colour", "covg"), ["kmer", "colour"], "left")
    listed = own.groupBy("id", "colour").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("covg", F.lit(0)).cast("long").alias("covg")))), lambda x: x["covg"]).alias("covgs"))
    key = F.from_json("id", "var_id string, which int")
    named = listed.select(key["var_id"].alias("var_id"), key["which"].alias("which"), "colour", "covgs")
    side = lambda i: F.coalesce(F.max(F.when(F.col("which") == i, F.col("covgs"))), F.array().cast("array<long>")).alias(f"covgs{i}")
    return named.groupBy("var_id", "colour").agg(side(1), side(2))


def path_divergences(refs: DataFrame, sample: DataFrame, k: int, longest: int, anchor5: int = 2, anchor3: int | None = None) -> DataFrame:
    """(chrom, pos, flank5p, branch1, branch2, flank3p): where a sample's paths leave a reference (chrom, seq) and return.

    sample is a graph of one colour or a union (kmer, covg, edges).  A path must
    hold anchor5 k-mers of the reference in a row, and its last anchor3 (k, if
    not said) k-mers must be in the reference in a row, further on by at most
    longest; of several such places the nearest.  branch1 is the reference's,
    branch2 the sample's, pos that of the first base where they part, from 1.
    Paths are found from either end, so those against the reference's strand
    are met too.  All paths are looked at at once.
    """
    anchor3 = k if anchor3 is None else anchor3
    rows = written(unitigs(sample, k).select(F.xxhash64("seq", F.col("kmers")[0]).alias("path"), "seq", "kmers"))
    steps = rows.select("path", F.size("kmers").alias("n"), F.posexplode("kmers").alias("j", "node"))
    places = kmers_of(refs.select("chrom", "seq"), k, "chrom").select(F.col("id").alias("chrom"), "pos", node(F.col("kmer"), F.col("fw"), k).alias("node"))
    met = steps.join(places, "node").withColumn("diagonal", F.col("pos") - F.col("j"))
    order = Window.partitionBy("path", "chrom", "diagonal").orderBy("j")
    runs = met.withColumn("run", F.col("j") - F.row_number().over(order)).groupBy("path", "chrom", "diagonal", "run", "n")
    runs = written(runs.agg(F.min("j").alias("j0"), F.max("j").alias("j1"), F.min("pos").alias("p0"), F.max("pos").alias("p1")))
    left = runs.where((F.col("j1") - F.col("j0") + 1 >= anchor5) & (F.col("j1") < F.col("n") - 1)).select("path", "chrom", F.col("j1").alias("j"), F.col("p0").alias("from"), F.col("p1").alias("p"))
    right = runs.where((F.col("j1") == F.col("n") - 1) & (F.col("j1") - F.col("j0") + 1 >= anchor3)).select("path", "chrom", F.col("j0").alias("back"), F.col("p0").alias("home"), F.col("p1").alias("to"))
    # windows of positions keep a repeat's places from meeting all others
    window = lambda c: F.floor(c / longest)
    near = left.withColumn("w", F.explode(F.array(window(F.col("p")), window(F.col("p")) + 1))).join(right.withColumn("w", window(F.col("home"))), ["path", "chrom", "w"])
    near = near.where((F.col("home") > F.col("p")) & (F.col("back") > F.col("j")) & (F.col("home") - F.col("p") <= longest))
    nearest = near.groupBy("path", "chrom", "j", "p", "from").agg(F.min(F.struct("home", "back", "to")).alias("m")).select("path", "chrom", "j", "p", "from", "m.*")
    # of one path and return, the departure closest to it
    last = nearest.groupBy("path", "chrom", "home", "back", "to").agg(F.max(F.struct("j", "p", "from")).alias("m")).select("path", "chrom", "home", "back", "to", "m.*")
    texts = last.join(rows.select("path", "seq"), "path").join(refs.select("chrom", F.col("seq").alias("ref")), "chrom")
    pad = F.greatest(F.lit(0), F.col("p") + k - F.col("home"), F.col("j") + k - F.col("back"))
    cut = lambda text, a, b: F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))
    start, end = F.col("p") + k, F.col("home") + pad
    out = texts.select(
        "chrom", (start + 1).cast("long").alias("pos"), cut(F.col("ref"), F.greatest(F.col("from"), start - FLANK), start).alias("flank5p"), cut(F.col("ref"), start, end).alias("branch1"),
        cut(F.col("seq"), F.col("j") + k, F.col("back") + pad).alias("branch2"), cut(F.col("ref"), end, F.least(F.col("to") + k, end + FLANK)).alias("flank3p"),
    )
    return out.where("branch1 <> branch2").dropDuplicates(["chrom", "pos", "branch1", "branch2"])


def high_difference(coverages: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(var_id, spread) of variants whose share of reads on branch 1 differs between colours by at least a threshold, from (var_id, colour, c1, c2)."""
    share = F.when(F.col("c1") + F.col("c2") > 0, F.col("c1") / (F.col("c1") + F.col("c2")))
    return coverages.groupBy("var_id").agg((F.max(share) - F.min(share)).alias("spread")).where(F.col("spread") >= threshold)


def union_of_calls(sets: list[DataFrame], k: int, closed: bool = True) -> DataFrame:
    """Variants of several call sets, each once whichever strand it was called on and whichever branch comes first.

    Two are the same if their alleles are, with the k bases before them and, where
    branches are not closed by the k-mer they meet at, the k after.
    """
    whole = sets[0]
    for one in sets[1:]:
        whole = whole.unionByName(one)
    after = F.lit("") if closed else F.expr(f"left(flank3p, {k})")
    a, b = (F.concat(F.expr(f"right(flank5p, {k})"), F.col(c), after) for c in ("branch1", "branch2"))
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    return whole.withColumn("_key", F.least(pair(a, b), pair(reverse_complement(a), reverse_complement(b)))).dropDuplicates(["_key"]).drop("_key")
