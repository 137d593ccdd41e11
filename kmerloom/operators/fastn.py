"""Tools over sequences: rows (name, seq) or reads with qual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import reverse_complement


def cleaned(seq: Column) -> Column:
    """Upper case, other letters than ACGTN as N, blanks away."""
    return F.regexp_replace(F.upper(F.regexp_replace(seq, "\\s", "")), "[^ACGTN]", "N")


def base_counts(rows: DataFrame, name: str = "name") -> DataFrame:
    """(name, a, c, g, t, other, gc): bases of each sequence, and the share of G and C among ACGT, null without any."""
    count = lambda letters: F.length("seq") - F.length(F.regexp_replace("seq", f"[{letters}]", ""))
    out = rows.select(F.col(name).alias("name"), *[count(b + b.lower()).cast("long").alias(b.lower()) for b in "ACGT"], count("^ACGTacgt").cast("long").alias("other"))
    return out.withColumn("gc", F.round((F.col("g") + F.col("c")) / F.expr("nullif(a + c + g + t, 0)"), 4))


def length_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.length("seq").cast("long").alias("length")).agg(F.count("*").alias("n"))


def total_length(rows: DataFrame) -> DataFrame:
    """One row (entries, bases, shortest, longest)."""
    size = F.length("seq").cast("long")
    return rows.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("bases"), F.min(size).alias("shortest"), F.max(size).alias("longest"))


def select_names(rows: DataFrame, names: DataFrame, name: str = "name", invert: bool = False) -> DataFrame:
    """The sequences that names (name) lists, or the others."""
    return rows.join(names.select(F.col("name").alias(name)).distinct(), name, "left_anti" if invert else "left_semi")


def substrings(rows: DataFrame, wanted: DataFrame, name: str = "name") -> DataFrame:
    """(name, start, length, seq) of the stretches in wanted (name, start from 1, length); a negative length reads the other strand."""
    ask = wanted.select(F.col("name").alias(name), F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length"))
    cut = F.substring(F.col("seq"), F.col("start"), F.abs("length"))
    return rows.select(name, "seq").join(ask, name).select(F.col(name).alias("name"), "start", "length", F.when(F.col("length") < 0, reverse_complement(cut)).otherwise(cut).alias("seq"))


def split_entries(rows: DataFrame, size: int, overlap: int = 0, name: str = "name") -> DataFrame:
    """(name, part, start, seq): each sequence in parts of at most size bases, neighbours sharing overlap."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("seq") - overlap, F.lit(1)), F.lit(size - overlap))
    return rows.select(F.col(name).alias("name"), "seq", F.posexplode(starts).alias("part", "start")).select("name", "part", "start", F.substring(F.col("seq"), F.col("start"), F.lit(size)).alias("seq"))


def wrapped(seq: Column, width: int = 80) -> Column:
    """The sequence in lines of so many letters."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def quality_summary(reads: DataFrame, offset: int = 33) -> DataFrame:
    """(sample, pos, n, mean_quality, least, most) of the qualities at each place of reads."""
    places = reads.where("qual IS NOT NULL AND qual <> ''").select("sample", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("qual")), lambda i: F.substring(F.col("qual"), i, F.lit(1)))).alias("pos", "q"))
    value = F.ascii("q") - offset
    return places.groupBy("sample", "pos").agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean_quality"), F.min(value).alias("least"), F.max(value).alias("most"))


def shuffled(rows: DataFrame, seed: int = 0, name: str = "name") -> DataFrame:
    """The entries in an order that depends on the seed alone."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(name), F.col("seq")))


def fastq(reads: DataFrame) -> DataFrame:
    """Lines of a FASTQ file, to be written as text."""
    return reads.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))


def simulated_reads(refs: DataFrame, length: int, depth: float, error: float = 0.0, seed: int = 0, name: str = "name") -> DataFrame:
    """(sample, read_id, mate, name, seq, qual): reads of either strand from uniform places, substitutions at the error rate.

    All draws are hashes of the seed, the sequence's name, the read's number and the place, so a lost task draws the same.
    """
    n = F.when(F.length("seq") >= length, F.ceil(F.length("seq") * depth / length)).otherwise(0).cast("int")
    draw = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 30)) / float(1 << 30)
    rows = refs.select(F.col(name).alias("name"), "seq", n.alias("n")).where("n > 0").select("name", "seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    start = F.floor(draw(F.col("name"), F.col("i"), F.lit("start")) * (F.length("seq") - length + 1)).cast("int") + 1
    cut = rows.select("name", "i", F.substring(F.col("seq"), start, F.lit(length)).alias("seq"))
    cut = cut.withColumn("seq", F.when(draw(F.col("name"), F.col("i"), F.lit("strand")) < 0.5, F.col("seq")).otherwise(reverse_complement(F.col("seq"))))
    if error:
        code = lambda b: F.translate(b, "ACGT", "0123").try_cast("int")
        step = lambda i: 1 + F.floor(draw(F.col("name"), F.col("i"), i, F.lit("which")) * 3).cast("int")
        base = lambda i: F.substring(F.col("seq"), i + 1, F.lit(1))
        moved = lambda i: F.substring(F.lit("ACGT"), F.pmod(code(base(i)) + step(i), F.lit(4)) + 1, F.lit(1))
        letters = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.when((draw(F.col("name"), F.col("i"), i, F.lit("error")) < error) & base(i).rlike("[ACGT]"), moved(i)).otherwise(base(i)))
        cut = cut.withColumn("seq", F.array_join(letters, ""))
    return cut.select(F.lit("sim").alias("sample"), F.xxhash64("name", "i").alias("read_id"), F.lit(0).alias("mate"), F.concat_ws("_", "name", "i").alias("name"), "seq", F.lit("I" * length).alias("qual"))
