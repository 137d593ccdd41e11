"""Read correction against a graph, without holding the graph in any task.

A base is put right if its quality is below the cutoff, the k-mer that ends (or,
leftwards, starts) with it is not in the graph, and exactly one other base makes
it so.  Work goes from the read's first k-mer in the graph to the right end, then
to the left.  What to ask next depends on earlier answers, so reads go in rounds:
each runs its read as far as the answers reach and names the k-mers it asks for
next; a join answers them.  Reads that are done leave.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import check_k
from .unitigs import written

_CODE = {"A": 0, "C": 1, "G": 2, "T": 3}
DISCARD, KEEP = "discard", "keep"
_STATE = "id long, name string, seq string, qual string, wanted array<long>, asked array<long>, done boolean, decision string, n_fixed int, places array<int>, out_seq string, out_qual string"


class Unknown(Exception):
    """An answer that is not there yet."""


def canonical_code(word: str) -> int | None:
    """A k-mer packed, the lesser of its two strands; None with other letters than ACGT."""
    fw = rc = 0
    for i, base in enumerate(word):
        code = _CODE.get(base)
        if code is None:
            return None
        fw = fw << 2 | code
        rc |= (3 - code) << 2 * i
    return min(fw, rc)


def corrected(seq: str, qual: str, k: int, cutoff: int, policy: str, known) -> tuple[str, list[int], str, str]:
    """(decision, places put right, seq, qual); known(word) says if the graph has a k-mer, or raises Unknown."""
    n = len(seq) - k + 1
    good = [ord(q) >= cutoff for q in qual]
    if all(good):
        return "uncorrected", [], seq, qual
    first = next((i for i in range(n) if known(seq[i : i + k])), None)
    if first is None:
        return ("discard" if policy == DISCARD else "uncorrected"), [], seq, qual
    bases, quals, places = list(seq), list(qual), []
    for order, end in ((range(first + 1, n), k - 1), (range(first - 1, -1, -1), 0)):
        for pos in order:
            at = pos + end
            word = "".join(bases[pos : pos + k])
            if good[at] or known(word):
                continue
            ways = [b for b in "ACGT" if b != word[end] and known(word[:end] + b + word[end + 1 :])]
            if len(ways) == 1:
                bases[at], quals[at] = ways[0], chr(cutoff + 1)
                places.append(at)
            elif policy == DISCARD:
                return "discard", places, "".join(bases), "".join(quals)
    return "corrected", places, "".join(bases), "".join(quals)


def _run(k: int, cutoff: int, policy: str):
    def one(row: dict) -> dict:
        found, asked = set(row["found"] or ()), set(row["asked"] or ())
        wanted: set[int] = set()

        def known(word: str) -> bool:
            code = canonical_code(word)
            if code is None:
                return False
            if code not in asked:
                wanted.add(code)
                raise Unknown(word)
            return code in found

        seq, qual = row["seq"], row["qual"]
        try:
            if not asked:  # the read's own k-mers come first, all at once
                if all(ord(q) >= cutoff for q in qual):
                    decision, places, out_seq, out_qual = "uncorrected", [], seq, qual
                else:
                    wanted.update(c for i in range(len(seq) - k + 1) if (c := canonical_code(seq[i : i + k])) is not None)
                    if wanted:
                        raise Unknown
                    decision, places, out_seq, out_qual = corrected(seq, qual, k, cutoff, policy, lambda word: False)
            else:
                decision, places, out_seq, out_qual = corrected(seq, qual, k, cutoff, policy, known)
        except Unknown as e:
            if e.args:  # the other bases at either end come along
                word = e.args[0]
                for end in (0, k - 1):
                    wanted.update(c for b in "ACGT" if (c := canonical_code(word[:end] + b + word[end + 1 :])) is not None)
            return {"wanted": sorted(wanted - asked), "asked": sorted(asked | wanted), "done": False}
        return {"wanted": [], "asked": [], "done": True, "decision": decision, "n_fixed": len(places), "places": places, "out_seq": out_seq, "out_qual": out_qual}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"decision": None, "n_fixed": None, "places": None, "out_seq": None, "out_qual": None} | {c: r[c] for c in ("id", "name", "seq", "qual")} | one(r) for r in batch.to_pylist()]
            types = {"id": pa.int64(), "wanted": pa.list_(pa.int64()), "asked": pa.list_(pa.int64()), "done": pa.bool_(), "n_fixed": pa.int32(), "places": pa.list_(pa.int32())}
            names = [f.split()[0] for f in _STATE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in names], names)

    return run


def correct(reads: DataFrame, graph: DataFrame, k: int, quality: int, policy: str = KEEP, offset: int = 33, id_col: str = "read_id") -> DataFrame:
    """(id, name, decision, n_fixed, places, seq, qual) of each read (a unique id, name, seq, qual), by graph (kmer).

    decision: uncorrected (all qualities good, or no k-mer in the graph under
    policy keep), corrected (tried, perhaps without a change) or discard (under
    policy discard: no k-mer in the graph, or a poor base that cannot be put
    right).  Reads shorter than k have no k-mer.  Without qualities a read is
    left as it is; so is one whose two strings differ in length.
    """
    check_k(k)
    words = graph.select("kmer").distinct()
    own = reads.select(F.col(id_col).cast("long").alias("id"), "name", F.upper("seq").alias("seq"), "qual")
    usable = F.coalesce((F.length("seq") == F.length("qual")) & (F.length("seq") > 0), F.lit(False))
    plain = own.where(~usable).select("id", "name", F.lit("uncorrected").alias("decision"), F.lit(0).alias("n_fixed"), F.array().cast("array<int>").alias("places"), "seq", "qual")
    turn = _run(k, quality + offset, policy)
    empty = F.array().cast("array<long>")
    state = written(own.where(usable).withColumns({"asked": empty, "found": empty}).mapInArrow(turn, _STATE))
    known = None
    done = [state.where("done")]
    while True:
        left = state.where("NOT done")
        if left.isEmpty():
            break
        asks = left.select("id", F.explode("wanted").alias("kmer"))
        hits = asks.join(words, "kmer").select("id", "kmer")
        known = written(hits if known is None else known.join(left.select("id"), "id", "left_semi").unionByName(hits))
        per = known.groupBy("id").agg(F.collect_list("kmer").alias("found"))
        again = left.select("id", "name", "seq", "qual", "asked").join(per, "id", "left")
        state = written(again.mapInArrow(turn, _STATE))
        done.append(state.where("done"))
    out = plain
    for part in done:
        out = out.unionByName(part.select("id", "name", "decision", "n_fixed", "places", F.col("out_seq").alias("seq"), F.col("out_qual").alias("qual")))
    return out


def correction_stats(found: DataFrame) -> DataFrame:
    """One row (original, final, corrected, discarded) of reads."""
    n = lambda c: F.count(F.when(c, 1))
    gone = F.col("decision") == "discard"
    return found.agg(F.count("*").alias("original"), n(~gone).alias("final"), n(~gone & (F.col("n_fixed") > 0)).alias("corrected"), n(gone).alias("discarded"))


def fixes_per_read(found: DataFrame) -> DataFrame:
    """(n_fixed, n) of the reads kept."""
    return found.where("decision <> 'discard'").groupBy("n_fixed").agg(F.count("*").alias("n"))


def fixes_by_place(found: DataFrame) -> DataFrame:
    """(place, n): how often each place of reads was put right, those of discarded reads too."""
    return found.select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("n"))
