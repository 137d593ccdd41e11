"""Bubbles straight from reads, without a row for each k-mer or edge.

Reads are laid by in batches.  Each batch's k-mers go to buckets by their least
m-mer, neighbours in one piece at two bits a base; a bucket has all occurrences
of its k-mers, so it knows their entries and exits, and sends four bits for each
occurrence back to the batch.  There a path is what lies between two breaks: a
node with one entry and one exit goes on only where every read goes on.  A break
is any other node, and each end of a read; paths broken by reads' ends alone are
few and are put together by ranks.

A path is told by its first node and first base.  Of two paths from a node to
another the longer one, if it has fewer than k + 1 edges, must overlap itself, so
a first pass lists the ends of paths that could be the longer one, and a second
one takes up the paths between ends that have, or may have, two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import _LETTERS, PACKED, check_k, packed_reverse_complement, reverse_complement, unpacked
from ..tables import batches_of, dropped
from .graph import pack
from .unitigs import bubbles_of, ranked, written

#: Bases of a batch; k-mers of a bucket; ends whose hashes are sent to all tasks; edges by which a path must be shorter than k to be looked for only between known ends.
PIECE, BUCKET, SENT, SHORTER = 1 << 22, 1 << 20, 1 << 20, 3
#: What flags of an occurrence say: several exits, several entries, a break, one that only reads' ends make.
OUT, IN, BREAK, END = 1, 2, 4, 8
_ACGT = np.frombuffer(b"ACGT", np.uint8)
_FOUR = (np.arange(256, dtype=np.uint8)[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3


def _table(letters: str, to: str) -> bytes:
    """A byte for each byte: the code of a base, or 4."""
    out = bytearray([4]) * 256
    for a, b in zip(letters, to, strict=True):
        out[ord(a)] = "ACGT".index(b)
    return bytes(out)


#: How bytes are read, and those that are left out: of DNA, and of prose as functions.dna.text_to_dna has it.
DNA = (_table("ACGTacgt", "ACGTACGT"), b"")
PROSE = (_table(_LETTERS + _LETTERS.lower(), ("ACGT" * 7)[:26] * 2), bytes(c for c in range(256) if not (chr(c).isascii() and chr(c).isalnum())))


def _packed(codes: np.ndarray) -> bytes:
    c = np.concatenate((codes, np.zeros(-len(codes) % 4, np.uint8))).reshape(-1, 4)
    return (c[:, 0] << 6 | c[:, 1] << 4 | c[:, 2] << 2 | c[:, 3]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return _FOUR[np.frombuffer(data, np.uint8)].ravel()


def words(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-mer at each place and its reverse complement, packed, by halves."""
    kind = np.uint32 if k <= 16 else np.uint64
    f = codes.astype(kind)
    r = f ^ kind(3)
    out, have, size = None, 0, 1
    while True:
        if k & size:
            if out is None:
                out = (f, r)
            else:  # what is there, then the next size bases
                n = len(f) - have
                out = (out[0][:n] << kind(2 * size) | f[have:], r[have:] << kind(2 * have) | out[1][:n])
            have += size
        if have == k:
            return out[0][: len(codes) - k + 1], out[1][: len(codes) - k + 1]
        f, r = f[:-size] << kind(2 * size) | f[size:], r[size:] << kind(2 * size) | r[:-size]
        size *= 2


def _laid_by(how: tuple[bytes, bytes], k: int, piece: int) -> Callable:
    """(batch, n, codes, ends) of texts: stretches of more than k bases, cut where they are longer than a batch."""

    def batch(parts: list[np.ndarray], no: int) -> pa.RecordBatch:
        codes = np.concatenate(parts)
        bad = np.concatenate(([True], codes == 4, [True]))
        starts, stops = np.flatnonzero(bad[:-1] & ~bad[1:]), np.flatnonzero(~bad[:-1] & bad[1:])
        long = stops - starts > k
        starts, stops = starts[long], stops[long]
        sizes = stops - starts
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum()) if len(sizes) else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array([no]), pa.array([len(at)], pa.int64()), pa.array([_packed(codes[at])], pa.binary()), pa.array([np.cumsum(sizes).astype(np.int32).tobytes()], pa.binary())], ["batch", "n", "codes", "ends"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, held, size = TaskContext.get().partitionId() << 32, [], 0
        gap = np.array([4], np.uint8)
        for rows in batches:
            for text in rows.column(0).to_pylist():
                codes = np.frombuffer((text or b"").translate(how[0], how[1]), np.uint8)
                for at in range(0, max(1, len(codes) - k), piece):  # a piece's last k-mer is the next one's first
                    part = codes[at : at + piece + k]
                    held += [part, gap]
                    size += len(part) + 1
                    if size >= piece:
                        yield batch(held, no)
                        no, held, size = no + 1, [], 0
        if held:
            yield batch(held, no)

    return run


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., so many of each."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())


def _runs(codes: np.ndarray, ends: np.ndarray, k: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, k-mers, bounds, bucket) of stretches of k-mers of one bucket, by bucket; bounds: 1 if a base stands before it, 2 if one after."""
    m = min(max(3, k // 2 + 1), 9)
    h = np.minimum(*words(codes, m)).astype(np.uint32) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(13)
    least, have = h, 1
    while have < k - m + 1:
        step = min(have, k - m + 1 - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    bucket = (least % np.uint32(buckets)).astype(np.uint16)
    n = len(bucket)
    valid = np.ones(len(codes), bool)
    valid[(ends[:, None] - np.arange(1, k)).ravel()] = False
    valid = valid[:n]
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[np.concatenate(([0], ends[:-1]))] = True
    last[ends - k] = True
    begins = valid.copy()
    begins[1:] &= first[1:] | (bucket[1:] != bucket[:-1])
    place = np.arange(n, dtype=np.int32)
    begins |= valid & ((place - np.maximum.accumulate(np.where(begins, place, 0))) % 64 == 0)
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(valid & np.concatenate((begins[1:] | ~valid[1:], [True])))
    order = np.argsort(bucket[starts], kind="stable")
    starts, stops = starts[order], stops[order]
    return starts, stops - starts + 1, np.where(first[starts], 0, 1) | np.where(last[stops], 0, 2), bucket[starts]


def _batch(row_codes: bytes, row_ends: bytes) -> tuple[np.ndarray, np.ndarray]:
    ends = np.frombuffer(row_ends, np.int32).astype(np.int64)
    return _unpacked(row_codes)[: ends[-1] if len(ends) else 0], ends


def _dealt(k: int, buckets: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for no, packed, row_ends in zip(*(rows.column(c).to_pylist() for c in ("batch", "codes", "ends")), strict=True):
                codes, ends = _batch(packed, row_ends)
                if not len(ends):
                    continue
                starts, sizes, bounds, bucket = _runs(codes, ends, k, buckets)
                bases = codes[np.clip(_spread(starts - 1, sizes + k + 1), 0, len(codes) - 1)]
                says = (sizes - 1 | bounds << 6).astype(np.uint8)
                cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                at = np.concatenate(([0], np.cumsum(sizes + k + 1)))
                to = np.append(cuts[1:], len(bucket))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cuts].astype(np.int32)), pa.repeat(no, len(cuts)), pa.array([says[a:b].tobytes() for a, b in zip(cuts, to, strict=True)], pa.binary()), pa.array([_packed(bases[at[a] : at[b]]) for a, b in zip(cuts, to, strict=True)], pa.binary())],
                    ["bucket", "batch", "says", "bases"],
                )

    return run


_E = np.arange(512)
_FW, _RC = np.bitwise_count(_E & 15), np.bitwise_count(_E >> 4 & 15)


def _said(out: np.ndarray, into: np.ndarray) -> np.ndarray:
    one = (out == 1) & (into == 1)
    return (np.where(out > 1, OUT, 0) | np.where(into > 1, IN, 0) | np.where(~one | (_E > 255), BREAK, 0) | np.where(one & (_E > 255), END, 0)).astype(np.uint8)


#: Flags by edges and an end's bit, for k-mers as they stand in a read or turned.
_FLAGS = np.stack((_said(_RC, _FW), _said(_FW, _RC)), 1).ravel()


def _flagged(k: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        says, blobs = ([np.frombuffer(x, np.uint8) for x in table.column("says").to_pylist()], table.column("bases").to_pylist())
        codes = _unpacked(b"".join(blobs))
        each = [len(x) for x in says]
        says = np.concatenate(says)
        sizes, bounds = (says & 63).astype(np.int64) + 1, says >> 6
        whole = np.concatenate(([0], np.cumsum(sizes + k + 1)))
        runs = np.concatenate(([0], np.cumsum(each)))
        shift = np.concatenate(([0], np.cumsum([4 * len(x) for x in blobs])[:-1])) - whole[runs[:-1]]
        starts = whole[:-1] + np.repeat(shift, each) + 1
        at = _spread(starts, sizes)
        fw, rc = words(codes, k)
        fw, rc = fw[at], rc[at]
        as_is = fw < rc
        before, after = np.uint16(8) >> codes[at - 1].astype(np.uint16), np.uint16(1) << codes[at + k].astype(np.uint16)
        lasts = np.cumsum(sizes) - 1
        no_left, no_right = (lasts - sizes + 1)[bounds & 1 == 0], lasts[bounds & 2 == 0]
        before[no_left], after[no_right] = 0, 0
        edges = np.where(as_is, after | before << np.uint16(4), after << np.uint16(4) | before)
        edges[no_left] |= 256
        edges[no_right] |= 256
        kmer = np.minimum(fw, rc)
        order = np.argsort(kmer)
        kmer = kmer[order]
        new = np.concatenate(([True], kmer[1:] != kmer[:-1]))
        merged = np.bitwise_or.reduceat(edges[order], np.flatnonzero(new))
        every = np.empty(len(kmer), np.uint16)
        every[order] = merged[np.cumsum(new) - 1]
        flags = _FLAGS[every.astype(np.int32) * 2 + as_is]
        ends = np.cumsum(sizes)[runs[1:] - 1]
        out = []
        for a, b in zip(np.concatenate(([0], ends[:-1])), ends, strict=True):
            x = np.append(flags[a:b], np.zeros((b - a) % 2, np.uint8))
            out.append((x[::2] | x[1::2] << 4).tobytes())
        return pa.table([table.column("batch"), table.column("bucket"), pa.array(out, pa.binary())], ["batch", "bucket", "flags"])

    return run


def _hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two k-mers, in either order."""
    src, dst = np.minimum(a, b), np.maximum(a, b)
    x = src.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ dst.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ x >> np.uint64(29)


def _text(codes: np.ndarray, start: np.ndarray, sizes: np.ndarray, back: np.ndarray) -> pa.Array:
    """Bases from start on, or complemented from start backwards."""
    within = _spread(np.zeros(len(sizes), np.int64), sizes)
    flat = np.repeat(back, sizes)
    c = codes[np.repeat(start, sizes) + np.where(flat, -within, within)]
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(_ACGT[np.where(flat, 3 - c, c)].tobytes()))


PATHS = "src long, dst long, base int, may boolean, src_end boolean, dst_end boolean, bases string"


def _overlaps(s: np.ndarray, t: np.ndarray, size: np.ndarray, k: int, below: int) -> np.ndarray:
    """Whether a path of fewer edges, and fewer than below, could lead from s to t as well."""
    out = np.zeros(len(s), bool)
    for n in range(1, below):
        left = s.dtype.type((1 << 2 * (k - n)) - 1)
        out |= (size > n) & (s & left == t >> s.dtype.type(2 * n))
    return out


def _paths(k: int, buckets: int, ends_known: np.ndarray | None = None, whole: bool = False) -> Callable:
    """The paths of a batch.

    First pass: the ends of those that could be the longer of two, may: with a
    partner that is not listed; and paths broken by reads' ends with their bases.
    With whole or known ends: the bases of all paths, or of those between such ends.
    """
    first = ends_known is None and not whole
    none = pa.Table.from_batches([], pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("base", pa.int32()), ("may", pa.bool_()), ("src_end", pa.bool_()), ("dst_end", pa.bool_()), ("bases", pa.string())]))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return none
        codes, ends = _batch(left.column("codes")[0].as_py(), left.column("ends")[0].as_py())
        starts, sizes, _, bucket = _runs(codes, ends, k, buckets)
        right = right.sort_by("bucket")
        flags = np.zeros(len(codes), np.uint8)
        per = np.bincount(bucket, weights=sizes, minlength=buckets).astype(np.int64)
        said = []
        for b, x in zip(right.column("bucket").to_pylist(), right.column("flags").to_pylist(), strict=True):
            x = np.frombuffer(x, np.uint8)
            said.append(np.stack((x & 15, x >> 4), 1).ravel()[: per[b]])
        flags[_spread(starts, sizes)] = np.concatenate(said)
        stops = np.flatnonzero(flags & BREAK)
        last = np.zeros(len(codes), bool)
        last[ends - k] = True
        i, j = stops[:-1], stops[1:]
        own = ~last[i] & (flags[i] & (OUT | END) > 0) & (flags[j] & (IN | END) > 0)
        i, j = i[own], j[own]
        broken = (flags[i] | flags[j]) & END > 0
        fw, rc = words(codes, k)
        least = max(1, k - SHORTER)

        def rows(i: np.ndarray, j: np.ndarray, may: np.ndarray, bases: bool, both: bool) -> pa.Table:
            s, t, s2, t2 = fw[i], fw[j], rc[j], rc[i]
            same = (s == s2) & (t == t2)
            ahead, back = (s < s2) | (s == s2) & (t <= t2) | both, (s > s2) | (s == s2) & (t >= t2) | both
            ahead, back = np.flatnonzero(ahead | same), np.flatnonzero(back | same)
            src, dst = np.concatenate((s[ahead], s2[back])).astype(np.int64), np.concatenate((t[ahead], t2[back])).astype(np.int64)
            base = np.concatenate((codes[i[ahead] + k], 3 - codes[j[back] - 1])).astype(np.int64)
            one = np.unique(src << 2 | base, return_index=True)[1]
            turned = (np.arange(len(src)) >= len(ahead))[one]
            of = np.concatenate((ahead, back))[one]
            end = flags & END > 0
            size = (j - i)[of]
            cut = lambda x, y: pa.array(np.where(turned, end[y[of]], end[x[of]]))
            text = _text(codes, np.where(turned, j[of] - 1, i[of] + k), size, turned) if bases else pa.nulls(len(one), pa.string())
            return pa.table([pa.array(src[one]), pa.array(dst[one]), pa.array(base[one].astype(np.int32)), pa.array(may[of]), cut(i, j), cut(j, i), text], none.schema.names)

        if first:
            a, b = i[~broken], j[~broken]
            size = b - a
            longer = (size >= least) | _overlaps(fw[a], fw[b], size, k, least)
            a, b = a[longer], b[longer]
            may = _overlaps(fw[a], fw[b], b - a, k, least)
            return pa.concat_tables([rows(a, b, may, False, False), rows(i[broken], j[broken], np.ones(broken.sum(), bool), True, True)])
        i, j = i[~broken], j[~broken]
        if not whole:
            mask = np.uint64((1 << 22) - 1)
            there = np.zeros(1 << 22, bool)  # most are not, which a look here tells
            there[ends_known & mask] = True
            ends_here = _hash(np.minimum(fw[i], rc[i]), np.minimum(fw[j], rc[j]))
            known = np.flatnonzero(there[ends_here & mask])
            known = known[np.isin(ends_here[known], ends_known)]
            i, j = i[known], j[known]
        return rows(i, j, np.zeros(len(i), bool), True, False)

    return run


def _walked(k: int) -> Callable:
    """seq and the oriented nodes on it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            seqs = rows.column(0).to_pylist()
            kmers = []
            for seq in seqs:
                kmer, fw = pack(np.searchsorted(_ACGT, np.frombuffer(seq.encode(), np.uint8)), k)
                kmers.append(kmer * 2 + fw)
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.string()), pa.array(kmers, pa.list_(pa.int64()))], ["seq", "kmers"])

    return run


def _reverse(x: str, k: int) -> Column:
    return packed_reverse_complement(F.col(x), k)


def bubbles_of_reads(texts: DataFrame, k: int, text_col: str = "seq", how: tuple[bytes, bytes] = DNA, sent: int = SENT, piece: int = PIECE) -> DataFrame:
    """The bubbles of the graph of reads, as unitigs.bubbles() has them; how: DNA or PROSE.  k is at most 31."""
    if check_k(k) > PACKED:
        raise ValueError(f"k is at most {PACKED} here, not {k}")
    spark = texts.sparkSession
    rows = texts.select(F.col(text_col).cast("binary").alias("text"))
    if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        rows = rows.repartition(spark.sparkContext.defaultParallelism)
    with batches_of(spark, 1000):
        reads = written(rows.mapInArrow(_laid_by(how, k, piece), "batch long, n long, codes binary, ends binary"))
    buckets = int(min(65535, max(16, (reads.agg(F.sum("n")).first()[0] or 0) // BUCKET)))
    with batches_of(spark, 1):
        dealt = reads.mapInArrow(_dealt(k, buckets), "bucket int, batch long, says binary, bases binary")
        flags = written(dealt.groupBy("bucket").applyInArrow(_flagged(k), "batch long, bucket int, flags binary"))
    pairs = reads.groupBy("batch").cogroup(flags.groupBy("batch"))
    listed = written(pairs.applyInArrow(_paths(k, buckets), PATHS))

    # paths that reads' ends break; a k-mer at one has one entry and one exit
    broken = listed.where("bases IS NOT NULL").dropDuplicates(["src", "base"])
    inner = lambda c: F.when(F.col(c), 1).otherwise(2)
    chains = ranked(written(broken.select("src", "dst", "base", "src_end", "dst_end", "bases", inner("dst_end").alias("dst_in"), inner("dst_end").alias("dst_out"))))
    parts = F.array_sort(F.collect_list(F.struct("edge_no", "src", "dst", "base", "src_end", "dst_end", "bases")))
    glued = chains.groupBy("path").agg(parts.alias("e")).where(~F.col("e")[0]["src_end"] & ~F.element_at("e", -1)["dst_end"])
    glued = glued.select(F.col("e")[0]["src"].alias("src"), F.element_at("e", -1)["dst"].alias("dst"), F.col("e")[0]["base"].alias("base"), F.array_join(F.col("e")["bases"], "").alias("bases"))
    glued = glued.withColumn("_s", _reverse("dst", k)).withColumn("_t", _reverse("src", k))
    glued = written(glued.where("src < _s OR src = _s AND dst <= _t").drop("_s", "_t"))

    ends = listed.where("bases IS NULL").select("src", "dst", "base", "may").unionByName(glued.select("src", "dst", "base", F.lit(True).alias("may")))
    wanted = written(ends.groupBy("src", "dst").agg(F.max("may").alias("may"), F.min("base").alias("a"), F.max("base").alias("b")).where("may OR a < b").select("src", "dst"))
    if wanted.count() <= sent:
        at = wanted.select(F.least("src", _reverse("src", k)).alias("a"), F.least("dst", _reverse("dst", k)).alias("b")).toArrow()
        known = np.unique(_hash(at.column("a").to_numpy(), at.column("b").to_numpy()))
        second = pairs.applyInArrow(_paths(k, buckets, known), PATHS)
    else:
        second = pairs.applyInArrow(_paths(k, buckets, whole=True), PATHS)
    found = second.select("src", "dst", "bases").unionByName(glued.select("src", "dst", "bases")).join(wanted, ["src", "dst"], "left_semi")
    two = written(found.groupBy("src", "dst").agg(F.collect_set("bases").alias("b")).where("size(b) > 1"))
    for table in (reads, flags, listed):
        dropped(table)
    seq = two.select("src", "dst", F.explode("b").alias("b")).select("src", "dst", F.concat(unpacked(F.col("src"), k), "b").alias("seq"))
    own = F.col("src") == _reverse("dst", k)  # then the other strand's paths are among them
    seq = seq.select("seq").unionByName(seq.where(~own).select(reverse_complement(F.col("seq")).alias("seq")))
    return bubbles_of(seq.mapInArrow(_walked(k), "seq string, kmers array<long>"), k)
