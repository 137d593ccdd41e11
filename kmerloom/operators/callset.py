"""More of the call-set tools: annotation, normalisation, filters, summaries and conversion.

Calls are rows (chrom, pos, id, ref, alt, qual, filter, info map), pos from 1.
Sequences that calls are looked up in are cut into windows, so a call meets one
short row of a chromosome and not the whole of it.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import reverse_complement
from .vcf import is_transition, svtype

_SITE = ["chrom", "pos", "ref", "alt"]
WIDTH, MARGIN = 1 << 14, 1 << 10


def reference_windows(chroms: DataFrame, width: int = WIDTH, margin: int = MARGIN) -> DataFrame:
    """(chrom, w, offset, around): windows of chromosomes (chrom, seq), with a margin on either side; offset: bases before around."""
    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.length("seq"), F.lit(1)) - 1) / width).cast("int"))
    rows = chroms.select("chrom", "seq", F.explode(F.transform(starts, lambda w: w.cast("long"))).alias("w"))
    offset = F.greatest(F.col("w") * width - margin, F.lit(0)).cast("int")
    return rows.select("chrom", "w", offset.alias("offset"), F.substring(F.col("seq"), offset + 1, F.lit(width + 2 * margin)).alias("around"))


def with_reference(calls: DataFrame, windows: DataFrame, width: int = WIDTH) -> DataFrame:
    """calls with _around and _at: the sequence around a call and where in it the call starts, from 1; null where there is none."""
    keyed = calls.withColumn("w", F.expr(f"(pos - 1) div {width}"))
    return keyed.join(windows, ["chrom", "w"], "left").withColumn("_at", (F.col("pos") - F.col("offset")).cast("int")).withColumnRenamed("around", "_around").drop("w", "offset")


def add_flanks(calls: DataFrame, windows: DataFrame, length: int, width: int = WIDTH) -> DataFrame:
    """calls with left_flank and right_flank: the bases beside the reference allele, fewer at a chromosome's end. length is at most the windows' margin."""
    found = with_reference(calls, windows, width)
    left = F.substring(F.col("_around"), F.greatest(F.col("_at") - length, F.lit(1)), F.least(F.lit(length), F.col("_at") - 1))
    right = F.substring(F.col("_around"), F.col("_at") + F.length("ref"), F.lit(length))
    return found.withColumns({"left_flank": left, "right_flank": right}).drop("_around", "_at")


def filter_reference(calls: DataFrame, windows: DataFrame, width: int = WIDTH, invert: bool = False) -> DataFrame:
    """Calls whose reference allele is what the sequence holds, or the others."""
    found = with_reference(calls, windows, width)
    fits = F.coalesce(F.substring(F.col("_around"), F.col("_at"), F.length("ref")) == F.upper("ref"), F.lit(False))
    return found.where(~fits if invert else fits).drop("_around", "_at")


def correct_strand(calls: DataFrame, windows: DataFrame, width: int = WIDTH) -> DataFrame:
    """Calls with both alleles complemented where only that fits the sequence; strand: 1, -1, or 0 where neither fits."""
    found = with_reference(calls, windows, width)
    there = F.substring(F.col("_around"), F.col("_at"), F.length("ref"))
    strand = F.when(there == F.col("ref"), 1).when(there == reverse_complement(F.col("ref")), -1).otherwise(0)
    out = found.withColumn("strand", strand)
    turn = {c: F.when(F.col("strand") == -1, reverse_complement(F.col(c))).otherwise(F.col(c)) for c in ("ref", "alt")}
    return out.withColumns(turn).drop("_around", "_at")


def _shift(pos: int, ref: str, alt: str, around: str, at: int, left: bool) -> tuple[int, str, str]:
    """An insertion or deletion, anchored on the base before, moved as far as it goes within the sequence around it."""
    if len(ref) == len(alt) or not ref or not alt or ref[0] != alt[0] or min(len(ref), len(alt)) != 1:
        return pos, ref, alt
    change, gone = (ref[1:], True) if len(ref) > 1 else (alt[1:], False)
    start = at  # index in around, from 0, of the first base after the anchor
    if left:
        while start > 1 and around[start - 1] == change[-1]:
            change = change[-1] + change[:-1]
            start -= 1
    else:
        step = len(change) if gone else 0
        while start + step < len(around) and around[start + step] == change[0]:
            change = change[1:] + change[0]
            start += 1
    anchor = around[start - 1]
    moved = pos + start - at
    return (moved, anchor + change, anchor) if gone else (moved, anchor, anchor + change)


def aligned(calls: DataFrame, windows: DataFrame, left: bool = True, width: int = WIDTH) -> DataFrame:
    """Calls with insertions and deletions moved to the left (or right) as far as the sequence lets them, at most a margin."""
    found = with_reference(calls.withColumn("_row", F.struct("pos", "ref", "alt")), windows, width)

    @F.pandas_udf("pos long, ref string, alt string")
    def move(row: pd.DataFrame, around: pd.Series, at: pd.Series) -> pd.DataFrame:
        out = []
        for pos, ref, alt, seq, start in zip(row["pos"], row["ref"], row["alt"], around, at, strict=True):
            fits = isinstance(seq, str) and seq[int(start) - 1 : int(start) - 1 + len(ref)] == ref
            out.append(_shift(pos, ref, alt, seq, int(start), left) if fits else (pos, ref, alt))
        return pd.DataFrame(out, columns=["pos", "ref", "alt"])

    done = found.withColumn("_new", move("_row", "_around", "_at"))
    return done.withColumns({c: F.col(f"_new.{c}") for c in ("pos", "ref", "alt")}).select(*calls.columns)


def in_homopolymer(calls: DataFrame, windows: DataFrame, longest: int, width: int = WIDTH) -> DataFrame:
    """Calls of insertions and deletions that do not stand at a run of more than longest equal bases; others all stay."""
    found = with_reference(calls, windows, width)
    after = F.substring(F.col("_around"), F.col("_at") + 1, F.lit(longest + 1))
    run = F.coalesce((F.length(after) > longest) & (F.length(F.regexp_replace(after, "^(.)\\1*$", "")) == 0), F.lit(False))
    return found.where((F.length("ref") == F.length("alt")) | ~run).drop("_around", "_at")


def is_slippage(ref: Column, alt: Column, right_flank: Column, left_flank: Column) -> Column:
    """Whether an anchored insertion or deletion repeats the bases right after or before it."""
    change = F.when(F.length(ref) > F.length(alt), F.substring(ref, F.lit(2), F.length(ref))).otherwise(F.substring(alt, F.lit(2), F.length(alt)))
    return (F.length(ref) != F.length(alt)) & (F.startswith(right_flank, change) | F.endswith(left_flank, change))


_TESTS = {"=~": "rlike", "!~": "not rlike", "==": "=", "!=": "<>", ">": ">", ">=": ">=", "<": "<", "<=": "<=", "eq": "=", "ne": "<>", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}


def filter_info(calls: DataFrame, expression: str) -> DataFrame:
    """Calls whose INFO field fits "NAME op value"; == != > >= < <= compare numbers, eq ne gt ge lt le text, =~ !~ patterns. Calls without the field go."""
    m = re.fullmatch(r"\s*(\S+?)\s*(=~|!~|==|!=|>=|<=|>|<|\b(?:eq|ne|gt|ge|lt|le)\b)\s*(.*?)\s*", expression)
    if not m:
        raise ValueError(f"not NAME op value: {expression}")
    cell, op, value = F.col("info")[m[1]], m[2], m[3]
    if op in ("=~", "!~"):
        fits = cell.rlike(value)
        return calls.where(fits if op == "=~" else ~fits)
    a, b = (cell.try_cast("double"), F.lit(float(value))) if op[0] in "=!<>" else (cell, F.lit(value))
    tests = {"=": a == b, "<>": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}
    return calls.where(tests[_TESTS[op]])


def filter_kinds(calls: DataFrame, kinds: list[str]) -> DataFrame:
    return calls.where(svtype(F.col("ref"), F.col("alt")).isin(kinds))


def filter_sizes(calls: DataFrame, least: int, most: int) -> DataFrame:
    """Insertions and deletions of least to most bases."""
    size = F.abs(F.length("alt") - F.length("ref"))
    return calls.where((size > 0) & size.between(least, most))


def allele_frequency(calls: DataFrame, genotypes: DataFrame) -> DataFrame:
    """calls with n_alleles, n_alt and af, from genotypes (chrom, pos, ref, alt, sample, gt) like 0/1; dots are not counted."""
    alleles = F.filter(F.split("gt", "[/|]"), lambda x: x != ".")
    counts = genotypes.groupBy(*_SITE).agg(F.sum(F.size(alleles)).alias("n_alleles"), F.sum(F.size(F.filter(alleles, lambda x: x != "0"))).alias("n_alt"))
    return calls.join(counts, _SITE, "left").withColumn("af", F.round(F.col("n_alt") / F.expr("nullif(n_alleles, 0)"), 6))


def ancestral(calls: DataFrame, windows: DataFrame, width: int = WIDTH) -> DataFrame:
    """calls with aa: 0 if the ancestral sequence has the reference allele, 1 if the other, else a dot."""
    found = with_reference(calls, windows, width)
    there = lambda c: F.substring(F.col("_around"), F.col("_at"), F.length(c)) == F.col(c)
    has_ref, has_alt = F.coalesce(there("ref"), F.lit(False)), F.coalesce(there("alt"), F.lit(False))
    longer = F.length("ref") >= F.length("alt")
    aa = F.when(has_ref & has_alt, F.when(longer, "0").otherwise("1")).when(has_ref, "0").when(has_alt, "1").otherwise(".")
    return found.withColumn("aa", aa).drop("_around", "_at")


def overlapping_features(calls: DataFrame, features: DataFrame, width: int = WIDTH) -> DataFrame:
    """(chrom, pos, ref, alt, features): the sorted names of the features (chrom, start, stop, name) that a call's span meets, calls without any left out.

    Both sides are keyed by windows of positions: no pair meets outside one.
    """
    windows = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width))).alias("w")
    stop = F.col("pos") + F.greatest(F.length("ref"), F.lit(1)) - 1
    left = calls.select(*_SITE, stop.alias("end"), windows(F.col("pos"), stop))
    right = features.select("chrom", "start", "stop", "name", windows(F.col("start"), F.col("stop")))
    met = left.join(right, ["chrom", "w"]).where("pos <= stop AND end >= start")
    return met.groupBy(*_SITE).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("features"))


def nearest_feature(calls: DataFrame, features: DataFrame, width: int = WIDTH) -> DataFrame:
    """(chrom, pos, ref, alt, distance): bases from a call's start to the nearest feature's span, 0 inside, null on a chromosome without any.

    Calls and features are sorted together within windows of positions: the
    furthest stop before and the next start after.  What lies in other windows
    comes from one row for each of them.
    """
    points = features.select("chrom", F.col("start").alias("at"), F.lit(0).alias("kind"), F.col("start").alias("from"), F.col("stop").alias("to"), *[F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("alt", "string"))])
    rows = points.unionByName(calls.select("chrom", F.col("pos").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("from"), F.lit(None).cast("long").alias("to"), "ref", "alt"))
    rows = rows.withColumn("w", F.floor(F.col("at") / width))
    whole = Window.partitionBy("chrom").orderBy("w")
    others = rows.groupBy("chrom", "w").agg(F.max("to").alias("t"), F.min("from").alias("f"))
    others = others.select("chrom", "w", F.max("t").over(whole.rowsBetween(Window.unboundedPreceding, -1)).alias("t"), F.min("f").over(whole.rowsBetween(1, Window.unboundedFollowing)).alias("f"))
    before = Window.partitionBy("chrom", "w").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("chrom", "w").orderBy(F.desc("at"), F.asc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({"_to": F.max("to").over(before), "_from": F.min("from").over(after)}).where("kind = 1")
    near = own.join(others, ["chrom", "w"])
    behind, ahead = F.greatest("_to", "t"), F.least("_from", "f")
    distance = F.least(F.when(behind.isNotNull(), F.greatest(F.col("at") - behind, F.lit(0))), ahead - F.col("at"))
    return near.select("chrom", F.col("at").alias("pos"), "ref", "alt", distance.alias("distance"))


def sv_lengths(calls: DataFrame) -> DataFrame:
    """(svlen, n): lengths of change, of which deletions have negative ones."""
    return calls.groupBy((F.length("alt") - F.length("ref")).cast("int").alias("svlen")).agg(F.count("*").alias("n"))


def sv_length_sums(calls: DataFrame) -> DataFrame:
    """One row (inserted, deleted): bases."""
    d = (F.length("alt") - F.length("ref")).cast("long")
    return calls.agg(F.coalesce(F.sum(F.when(d > 0, d)), F.lit(0)).alias("inserted"), F.coalesce(F.sum(F.when(d < 0, -d)), F.lit(0)).alias("deleted"))


def chromosome_bins(calls: DataFrame, size: int) -> DataFrame:
    """(chrom, bin, n) of calls by windows of so many bases."""
    return calls.groupBy("chrom", F.expr(f"(pos - 1) div {size}").alias("bin")).agg(F.count("*").alias("n"))


def info_tags(calls: DataFrame) -> DataFrame:
    """(tag, value, n) of the INFO fields."""
    return calls.select(F.explode("info").alias("tag", "value")).groupBy("tag", "value").agg(F.count("*").alias("n"))


def transitions_by(calls: DataFrame, *by: str) -> DataFrame:
    """Transitions and transversions of single bases within each group."""
    snps = calls.where((F.length("ref") == 1) & (F.length("alt") == 1) & (F.col("ref") != F.col("alt")))
    yes = is_transition(F.col("ref"), F.col("alt"))
    return snps.groupBy(*by).agg(F.count(F.when(yes, 1)).alias("transitions"), F.count(F.when(~yes, 1)).alias("transversions"))


def allele_branches(calls: DataFrame) -> DataFrame:
    """(id, name, seq): either allele with its flanks, from calls with left_flank and right_flank."""
    two = F.explode(F.array(F.struct(F.lit("ref").alias("name"), F.col("ref").alias("a")), F.struct(F.lit("alt").alias("name"), F.col("alt").alias("a")))).alias("x")
    return calls.select("id", "left_flank", "right_flank", two).select("id", F.concat_ws("_", "id", "x.name").alias("name"), F.concat("left_flank", "x.a", "right_flank").alias("seq"))


def microhomology(calls: DataFrame) -> DataFrame:
    """calls (with flanks) and mmej: the most bases that the start of a deletion shares with what follows it, or its end with what is before."""
    gone = F.when(F.length("ref") > F.length("alt"), F.substring(F.col("ref"), F.length("alt") + 1, F.length("ref"))).otherwise("")

    def shared(a: Column, b: Column, n: Column) -> Column:
        fits = lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)
        return F.when(n > 0, F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), fits)), F.lit(0))).otherwise(0)

    n = lambda flank: F.least(F.length(gone), F.length(flank))
    right, left = F.col("right_flank"), F.col("left_flank")
    return calls.withColumn("mmej", F.greatest(shared(gone, right, n(right)), shared(F.reverse(gone), F.reverse(left), n(left))))


def confusion(calls: DataFrame, bins: int = 10, most: float = 100.0) -> DataFrame:
    """(bin, truth, gt, n) of calls (truth, gt, gt_conf) by confidence; those above most are in bin bins + 1."""
    where = F.when(F.col("gt_conf") >= most, bins + 1).when(F.col("gt_conf") < 0, 0).otherwise(F.floor(F.col("gt_conf") * bins / most) + 1)
    return calls.groupBy(where.cast("int").alias("bin"), "truth", "gt").agg(F.count("*").alias("n"))


def restore_consistent(kept: DataFrame, dropped: DataFrame) -> DataFrame:
    """Calls kept, and of those dropped for an overlap the ones that no kept call's span meets, the first of each cluster."""
    end = lambda: F.col("pos") + F.greatest(F.length("ref"), F.lit(1)) - 1
    spans = kept.select("chrom", F.col("pos").alias("start"), end().alias("stop"), F.lit("k").alias("name"))
    free = dropped.join(overlapping_features(dropped, spans).select(*_SITE), _SITE, "left_anti")
    order = Window.partitionBy("chrom").orderBy("pos", "ref", "alt")
    reach = F.max(end()).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = free.withColumn("_reach", reach).where("_reach IS NULL OR _reach < pos").drop("_reach")
    return kept.unionByName(first)


def merged_samples(calls: DataFrame, samples: list[str]) -> DataFrame:
    """(chrom, pos, ref, alt, one column of genotypes for each sample): call sets of samples side by side; a dot where one has no call."""
    wide = calls.groupBy(*_SITE).pivot("sample", samples).agg(F.min("gt"))
    return wide.select(*_SITE, *[F.coalesce(F.col(f"`{s}`"), F.lit(".")).alias(s) for s in samples])


def read_vcf(spark, path: str) -> DataFrame:
    """Calls of VCF files; a call with several other alleles is a row for each."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> '' AND value NOT LIKE '#%'").select(*[cells[i].alias(n) for i, n in enumerate(("chrom", "pos", "id", "ref", "alts", "qual", "filter", "fields"))])
    pairs = F.transform(F.filter(F.split("fields", ";"), lambda x: ~x.isin("", ".")), lambda x: F.struct(F.substring_index(x, "=", 1), F.when(F.instr(x, "=") > 0, F.regexp_replace(x, "^[^=]*=", "")).otherwise("")))
    return rows.select("chrom", F.col("pos").cast("long").alias("pos"), "id", "ref", F.explode(F.split("alts", ",")).alias("alt"), "qual", "filter", F.map_from_entries(F.array_distinct(pairs)).alias("info"))


def header(samples: list[str] | None = None) -> list[str]:
    """The lines before a VCF body."""
    columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])]
    return ["##fileformat=VCFv4.2", "\t".join(columns)]
