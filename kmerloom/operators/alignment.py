"""From call files to call sets: alleles aligned and split into changes, placed by their mapped flanks.

Alleles are aligned by Needleman-Wunsch row by row; the rest is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import reverse_complement
from .coverage import multicopy
from .vcf import combine_filters, svtype

MATCH, MISMATCH, OPEN, EXTEND = 1, -2, -4, -1
#: Cells of a table of scores; pairs of alleles that need more are not aligned and stay one change.
CELLS = 1 << 24


def align(a: str, b: str) -> tuple[str, str]:
    """Two sequences with gaps where they differ in length, by affine gap costs; of equally good ways, gaps as far left as can be."""
    if not a or not b:
        return a + "-" * len(b), "-" * len(a) + b
    x, y = (np.frombuffer(s.encode(), np.uint8) for s in (a, b))
    n, m = len(x), len(y)
    low = -(1 << 28)
    best = np.full((3, n + 1, m + 1), low, np.int32)  # ends in a pair, a gap in b, a gap in a
    best[0, 0, 0] = 0
    best[1, 1:, 0] = OPEN + EXTEND * np.arange(1, n + 1)
    best[2, 0, 1:] = OPEN + EXTEND * np.arange(1, m + 1)
    at = np.arange(1, m + 1)
    for i in range(1, n + 1):
        before = best[:, i - 1].max(axis=0)
        best[0, i, 1:] = before[:-1] + np.where(x[i - 1] == y, MATCH, MISMATCH)
        best[1, i, 1:] = np.maximum(best[0, i - 1, 1:] + OPEN + EXTEND, np.maximum(best[1, i - 1, 1:], best[2, i - 1, 1:] + OPEN) + EXTEND)
        # a gap in a runs along the row: the best start of one, less what each step costs
        start = np.maximum(best[0, i, :-1], best[1, i, :-1]) + OPEN - EXTEND * np.arange(m)
        best[2, i, 1:] = np.maximum.accumulate(start) + EXTEND * at
    out_a, out_b, i, j = [], [], n, m
    kind = int(best[:, n, m].argmax())
    while i or j:
        here = best[kind, i, j]
        if kind == 0:
            out_a.append(a[i - 1])
            out_b.append(b[j - 1])
            i, j = i - 1, j - 1
            kind = int(best[:, i, j].argmax())
        elif kind == 1:
            out_a.append(a[i - 1])
            out_b.append("-")
            i -= 1
            kind = 1 if best[1, i, j] + EXTEND == here and i else 0 if best[0, i, j] + OPEN + EXTEND == here else 2
        else:
            out_a.append("-")
            out_b.append(b[j - 1])
            j -= 1
            kind = 2 if best[2, i, j] + EXTEND == here and j else 0 if best[0, i, j] + OPEN + EXTEND == here else 1
    return "".join(reversed(out_a)), "".join(reversed(out_b))


def changes(a: str, b: str) -> list[tuple[int, str, str]]:
    """(place in a, from 0, its bases, b's bases) of each stretch in which two aligned sequences differ."""
    out, at, i = [], 0, 0
    while i < len(a):
        if a[i] == b[i]:
            at, i = at + 1, i + 1
            continue
        j = i
        # single bases next to each other are changes of their own, gaps are whole
        if a[i] != "-" and b[i] != "-":
            j = i + 1
        else:
            gap = 0 if a[i] == "-" else 1
            while j < len(a) and (a, b)[gap][j] == "-":
                j += 1
        ref, alt = a[i:j].replace("-", ""), b[i:j].replace("-", "")
        out.append((at, ref, alt))
        at, i = at + len(ref), j
    return out


def split_alleles(variants: DataFrame, id_col: str = "var_id") -> DataFrame:
    """(id, part, offset, ref, alt): the changes between branch1 and branch2 of variants; offset: bases of branch1 before, from 0.

    Branches that begin or end alike are cut to what differs before they are
    aligned.  A null branch is empty.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                lead = next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
                tail = next((i for i, (p, q) in enumerate(zip(a[lead:][::-1], b[lead:][::-1], strict=False)) if p != q), min(len(a), len(b)) - lead)
                x, y = a[lead : len(a) - tail], b[lead : len(b) - tail]
                found = [(0, x, y)] if len(x) * len(y) > CELLS or (len(x) == len(y) and len(x) > 1 and x == y.translate(_TURN)[::-1]) else changes(*align(x, y))
                rows += [(name, part, lead + at, ref, alt) for part, (at, ref, alt) in enumerate(found) if ref or alt]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["id", "part", "offset", "ref", "alt"])

    kind = dict(variants.dtypes)[id_col]
    wanted = variants.select(id_col, F.coalesce("branch1", F.lit("")).alias("a"), F.coalesce("branch2", F.lit("")).alias("b"))
    return wanted.mapInArrow(run, f"id {kind}, part int, offset int, ref string, alt string")


_TURN = str.maketrans("ACGT", "TGCA")


def _kind(ref: Column, alt: Column) -> Column:
    return svtype(ref, alt)


def calls_of(variants: DataFrame, mapped: DataFrame, refs: DataFrame | None = None, k: int | None = None, least_quality: int = 40, models: DataFrame | None = None) -> DataFrame:
    """Calls (chrom, pos, id, ref, alt, qual, filter, info) of variants whose 5' flanks are mapped.

    mapped: (var_id, chrom, start from 1, strand 1 or -1, mapq, cigar) of the
    flanks, by a mapper of the user's.  A flank that is not mapped with at least
    this quality and all its bases has the filter MAPQ, a variant whose reference
    allele stands more than once all along in refs (chrom, seq), if given, has
    PF_FAIL_PD_PARALOG, and one whose model in models (var_id, model) is not
    variant PF_FAIL_ and that model's name.  branch1 is the reference allele.
    Insertions and deletions have the base before them.  A variant whose flank
    is nowhere is left out; one on the other strand is turned.
    """
    flank = mapped.select("var_id", "chrom", F.col("start").cast("long").alias("start"), "strand", "mapq", "cigar")
    parts = split_alleles(variants).withColumnRenamed("id", "var_id")
    rows = parts.join(variants.select("var_id", "flank5p", "branch1"), "var_id").join(flank, "var_id")
    whole = rows["cigar"] == F.concat(F.length("flank5p").cast("string"), F.lit("M"))
    poor = ~F.coalesce(whole & (F.col("mapq") >= least_quality), F.lit(False))
    n, size = F.length("flank5p"), F.length("ref")
    on = F.col("strand") >= 0
    # on the other strand the flank lies after the change
    pos = F.when(on, F.col("start") + n + F.col("offset")).otherwise(F.col("start") - F.col("offset") - size)
    turn = lambda c: F.when(on, F.col(c)).otherwise(reverse_complement(F.col(c)))
    line = F.concat("flank5p", "branch1")
    # the base before the change on the reference's strand
    before = F.when(on, F.substring(line, n + F.col("offset"), F.lit(1))).otherwise(reverse_complement(F.substring(line, n + F.col("offset") + size + 1, F.lit(1))))
    placed = rows.withColumns({"_pos": pos, "_ref": turn("ref"), "_alt": turn("alt"), "_before": before, "_poor": poor})
    gap = (F.length("_ref") == 0) | (F.length("_alt") == 0)
    bad = [(F.col("_poor"), "MAPQ")]
    if refs is not None:
        alleles = variants.select("var_id", F.concat(F.expr(f"right(flank5p, {k})"), F.col("branch1")).alias("seq"))
        copies = multicopy(alleles, refs, k).select(F.col("id").alias("var_id"), "multicopy")
        placed = placed.join(copies, "var_id", "left")
        bad.append((F.coalesce("multicopy", F.lit(False)), "PF_FAIL_PD_PARALOG"))
    if models is not None:
        placed = placed.join(models.select("var_id", F.col("model").alias("_model")), "var_id", "left")
        bad += [(F.col("_model") == m, f"PF_FAIL_{m.upper()}") for m in ("error", "repeat")]
    info = F.map_from_arrays(F.array(F.lit("SVTYPE"), F.lit("SVLEN")), F.array(_kind(F.col("_ref"), F.col("_alt")), (F.length("_alt") - F.length("_ref")).cast("string")))
    return placed.select(
        "chrom", F.when(gap, F.col("_pos") - 1).otherwise(F.col("_pos")).alias("pos"), F.concat_ws("_", "var_id", F.col("part").cast("string")).alias("id"),
        F.when(gap, F.concat("_before", "_ref")).otherwise(F.col("_ref")).alias("ref"), F.when(gap, F.concat("_before", "_alt")).otherwise(F.col("_alt")).alias("alt"),
        F.lit(".").alias("qual"), combine_filters(*bad).alias("filter"), info.alias("info"),
    )


def pseudo_variants(calls: DataFrame) -> DataFrame:
    """Variants (var_id, flank5p, branch1, branch2, flank3p) of calls with left_flank and right_flank, so that call sets can be genotyped like call files."""
    return calls.select(F.col("id").alias("var_id"), F.col("left_flank").alias("flank5p"), F.col("ref").alias("branch1"), F.col("alt").alias("branch2"), F.col("right_flank").alias("flank3p"))


def branch_sequences(variants: DataFrame, k: int) -> DataFrame:
    """(name, seq) of both alleles with k bases of either flank: what a graph of bubbles' branches is built from."""
    two = F.explode(F.array(F.struct(F.lit("branch_1").alias("n"), F.col("branch1").alias("s")), F.struct(F.lit("branch_2").alias("n"), F.col("branch2").alias("s")))).alias("x")
    rows = variants.select("var_id", "flank5p", "flank3p", two)
    return rows.select(F.concat_ws("_", "var_id", "x.n").alias("name"), F.concat(F.expr(f"right(flank5p, {k})"), "x.s", F.expr(f"left(flank3p, {k})")).alias("seq"))
