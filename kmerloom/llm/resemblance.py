"""Near-duplicates by the Jaccard similarity of five-word shingles.

A text is the set of its shingles, and equal sets are one class.  Pairs of
classes are proposed in three ways and verified on the sets:

* SimHash fingerprints of the shingles that link by anchor-point covering;
* classes that agree in all minima of a band: in some bands with the two that come
  first and last, in all with one that shares most of its shingles;
* pairs of classes in a band that these links have not joined, if they can be
  alike: shingles that no other class in such a band has are in no intersection,
  so a class with many of them is like few others, or none.

A pair of similarity 0.8 differs in about ten bits of a fingerprint, so a covering
of three bits proposes few of them.  BANDS bands of ROWS minima lose such a pair
with probability (1 - 0.8^ROWS)^BANDS, 2 in a million, and those more alike less
often.  In a group of many near copies each is compared with a few others, and no
group is held in one place.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import batches_of, lean, written
from .simhash import BITS, near_links
from .text import BLANK, Words, grams, mix, pieces

SHINGLE, LEAST, BANDS, ROWS = 5, 0.8, 25, 4
#: Bands by which classes are compared with the first and last of a band.
FIRST = 4
#: Rows that Python is sent at a time: texts, or pairs of sets.
TOGETHER = 1000
#: Longs of a signature, and the equal minima that a pair must have: five deviations below what similarity LEAST leads to expect.
LONGS = -(-BANDS * ROWS // 16)
_EXPECTED = LEAST + (1 - LEAST) / 16
EQUAL = int(BANDS * ROWS * _EXPECTED - 5 * (BANDS * ROWS * _EXPECTED * (1 - _EXPECTED)) ** 0.5)
_U = np.uint64
_ODD = mix(np.arange(1, BANDS * ROWS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_BAND = mix(np.arange(1, BANDS + 1, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))


def shingle_sets(texts: list) -> Iterator[np.ndarray]:
    """The shingles of each text, hashed and sorted: five lower-cased words; fewer words are one shingle."""
    for _, part in pieces(texts):
        words = Words(part, BLANK, lower=True)
        h = words.hashes()
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            yield np.unique(grams(h[a:b], min(SHINGLE, b - a))) if b > a else np.empty(0, _U)


def _node(shingles: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(shingles.tobytes())], _U).view(np.int64)[0])


def minima(shingles: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, ~_U(0), _U)
    for at in range(0, len(shingles), 2048):
        x = shingles[at : at + 2048, None] * _ODD
        least = np.minimum(least, (x ^ (x >> _U(29))).min(axis=0))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS)
    key = _BAND.copy()
    for k in range(ROWS):
        key = mix(key * _U(0xD6E8FEB86659FD93) + rows[:, k])
    return key.view(np.int64)


def signature(least: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, sixteen to a long."""
    short = np.zeros(16 * LONGS, _U)
    short[: len(least)] = mix(least) >> _U(60)
    return (short.reshape(LONGS, 16) << (_U(4) * np.arange(16, dtype=_U))).sum(axis=1, dtype=_U).view(np.int64)


def _fingerprint(shingles: np.ndarray) -> int:
    """The SimHash of a set of shingles as a signed integer."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), 1 << 14):
        ones += np.unpackbits(mix(shingles[at : at + (1 << 14)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view(np.int64)[0])


_CLASSES = "hash long, node long, fp long, bands array<long>, sig array<long>"


def _classes_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column(2).cast(pa.large_binary()).to_pylist()))
        least = [minima(s) if len(s) else None for s in sets]
        longs = lambda f: pa.array([np.empty(0, np.int64) if x is None else f(x) for x in least], pa.list_(pa.int64()))
        columns = [pa.array([_node(s) for s in sets], pa.int64()), pa.array([_fingerprint(s) for s in sets], pa.int64()), longs(bands), longs(signature)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "hash", "node", "fp", "bands", "sig"])


def _sets_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column(0).cast(pa.large_binary()).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])


def _alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= LEAST * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) of classes whose sets are at least LEAST alike."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return written(both.select("a", "b", "x", "y").mapInArrow(lean(_alike), "a long, b long"), "links")


def _of_fingerprints(classes: DataFrame) -> DataFrame:
    """Pairs of classes whose fingerprints link; those with one fingerprint are compared with the first of them."""
    own = classes.where("size(bands) > 0").groupBy("fp").agg(F.min("node").alias("first"))
    linked = near_links(own).join(own.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(own.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    equal = classes.where("size(bands) > 0").join(own, "fp").where("node <> first")
    return linked.select("x", "y").unionByName(equal.select(F.col("first").alias("x"), F.col("node").alias("y")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _held(met: DataFrame, links: DataFrame) -> DataFrame:
    """(band, k, node, root) of each class in each of its bands, in bands that hold several components."""
    roots = written(connected_components(links), "roots")
    held = met.join(roots, "node", "left").select("band", "k", "node", F.coalesce("root", "node").alias("root"))
    several = held.groupBy("band").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b").select("band")
    return held.join(several, "band", "left_semi")


def _with_ends(held: DataFrame) -> DataFrame:
    """Pairs of each class with the first and the last of its band, by an order of the band's own."""
    one = F.struct(F.xxhash64("band", "node").alias("h"), "node", "root")
    ends = held.groupBy("band").agg(F.min(one).alias("first"), F.max(one).alias("last"))
    both = held.join(ends, "band").select("node", "root", F.explode(F.array("first", "last")).alias("end")).where("end.root <> root")
    return both.select(F.col("node").alias("x"), F.col("end.node").alias("y"))


def _shingles_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingle) of each set; half a shingle's hash is enough, as shingles that meet by chance only count as shared."""
    for batch in batches:
        for node, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = (np.frombuffer(data, _U) >> _U(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(node, pa.int64()), len(h)), pa.array(h)], ["node", "shingle"])


def _measures(held: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, n, shared): the shingles of each class in held, and those that another class there has too; classes that nothing can be like are left out."""
    own = sets.join(held.select("node").distinct(), "node", "left_semi")
    sizes = own.select("node", F.expr("length(shingles) div 8").alias("n"))
    alone = own.select("node", "shingles").mapInArrow(lean(_shingles_of), "node long, shingle int").groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    unique = alone.groupBy("node").agg(F.count("*").alias("u"))
    measures = sizes.join(unique, "node", "left").select("node", F.col("n").cast("int").alias("n"), (F.col("n") - F.coalesce("u", F.lit(0))).cast("int").alias("shared"))
    return measures.where(F.col("shared") >= LEAST * F.col("n"))


def _can_be_alike(n: Column, m: Column, s: Column, t: Column) -> Column:
    """Whether sets of n and m shingles, of which s and t are shared with anyone, can be at least LEAST alike."""
    both = F.least(s, t)
    return both >= LEAST * (n + m - both)


def _with_hub(held: DataFrame) -> DataFrame:
    """Pairs of each class with a hub of its band: one of those that share most of their shingles, so that most are like it."""
    hub = F.struct(F.round(F.col("shared") / F.col("n"), 2).alias("r"), F.xxhash64("node").alias("h"), "node", "root", "n", "shared")
    hubs = held.groupBy("band").agg(F.max(hub).alias("hub"))
    both = held.join(hubs, "band").where((F.col("hub.root") != F.col("root")) & _can_be_alike(F.col("n"), F.col("hub.n"), F.col("shared"), F.col("hub.shared")))
    return both.select(F.col("node").alias("x"), F.col("hub.node").alias("y"))


def _agree(a: Column, b: Column) -> Column:
    """How many of the minima two signatures agree in."""
    differ = F.lit(0)
    for i in range(LONGS):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111)))
    return BANDS * ROWS - differ


def _across(held: DataFrame) -> DataFrame:
    """Pairs of a band's classes that are of two components and can be alike, in the first band that they share.

    Classes that are not of a band's largest component are compared with it and
    with each other, so none of that component's own pairs is looked at.
    """
    counts = held.groupBy("band", "root").agg(F.count("*").alias("c")).groupBy("band").agg(F.max(F.struct("c", "root")).alias("m"))
    marked = held.join(counts.select("band", F.col("m.root").alias("main")), "band")
    side = lambda df, name: df.select("band", F.struct("node", "root", "main", "n", "shared", "sig", "bands", "k").alias(name))
    both = side(marked.where("root <> main"), "x").join(side(marked, "y"), "band")
    fits = _can_be_alike(F.col("x.n"), F.col("y.n"), F.col("x.shared"), F.col("y.shared")) & (_agree(F.col("x.sig"), F.col("y.sig")) >= EQUAL)
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.root") < F.col("y.root"))
    before = F.expr("exists(sequence(0, x.k), i -> i < x.k AND x.bands[i] = y.bands[i])")
    return both.where(once & fits & ~before).select(F.col("x.node").alias("x"), F.col("y.node").alias("y"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of texts at least LEAST alike: the one with the smallest id.

    A null id comes last; among rows with an equal id a hash of the text decides,
    so ids need not be unique.  Of rows equal in both, one stays.  Texts without
    words, null ones among them, are one class.  Without documents: no rows.
    Other columns come through as they are.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = F.xxhash64(text)
    with batches_of(docs.sparkSession, TOGETHER):
        kind = dict(docs.dtypes)[id_col]
        rows = docs.select(F.col(id_col).alias("doc_id"), hashed.alias("hash"), text.alias("text")).mapInArrow(lean(_classes_of), f"doc_id {kind}, {_CLASSES}")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("hash").alias("hash"))).alias("least")
        classes = written(rows.groupBy("node").agg(least, F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
        every = classes.select("node", F.posexplode("bands").alias("k", "band"))
        shared = every.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
        met = written(every.join(shared, "band", "left_semi"), "met")
        near = written(_ordered(_of_fingerprints(classes)), "near")
        wanted = met.select("node").union(near.select("a")).union(near.select("b")).distinct()
        # one row of each class, by its id and its hash: copies stay where they are
        of = classes.join(wanted, "node", "left_semi").select(F.col("least.doc_id").alias("_id"), F.col("least.hash").alias("_of"))
        texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), hashed.alias("hash"))
        one = texts.join(of, texts["doc_id"].eqNullSafe(of["_id"]) & (texts["hash"] == of["_of"]), "left_semi").dropDuplicates(["doc_id", "hash"])
        sets = written(one.select("text").mapInArrow(lean(_sets_of), "node long, shingles binary"), "sets")
        links = _verified(near, sets)
        links = links.unionByName(_verified(_ordered(_with_ends(_held(met.where(f"k < {FIRST}"), links))), sets))
        held = written(_held(met, links), "held")
        measures = written(_measures(held, sets), "measures")
        links = links.unionByName(_verified(_ordered(_with_hub(held.join(measures, "node"))), sets))
        left = _held(met, links).join(measures, "node").join(classes.select("node", "bands", "sig"), "node")
        links = links.unionByName(_verified(_ordered(_across(written(left, "held"))), sets))
        grouped = classes.join(connected_components(links), "node", "left").select(F.coalesce("root", "node").alias("root"), "least")
        kept = grouped.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("_id"), F.col("least.hash").alias("_of"))
    one = docs.withColumn("_hash_of_text", hashed)
    one = one.join(kept, one[id_col].eqNullSafe(kept["_id"]) & (one["_hash_of_text"] == kept["_of"]), "left_semi")
    return one.dropDuplicates([id_col, "_hash_of_text"]).drop("_hash_of_text")
