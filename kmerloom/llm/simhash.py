"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits; two link if at most three differ.  Bits 0-30 and
31-61 are two segments.  Of three differing bits at most one lies in one of the
segments, so linked fingerprints are within distance 1 in a segment.

The anchors of a segment are the 2^26 words of the Hamming code of length 31.
It covers with radius 1: each segment value lies within 1 of exactly one
anchor, its home.  A fingerprint is sent to its home and to every other anchor
within covering radius plus threshold, 1 + 1 = 2, of its segment: 16 anchors at
most.  If x and y are within 1 in a segment, y is within 2 of the home of x, so
they meet there.  No pair is missed, and an anchor holds few fingerprints that
are not near each other.

Where an anchor meets more than HOT_ANCHOR fingerprints, they are dealt out by the
bits outside its segment: 33 bits in four blocks, one of which is equal if at most
three bits differ.

Equal fingerprints are one class before any of this, so a group of copies of any
size costs one row.  Within an anchor only a spanning forest of the links is
passed on, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import written
from .text import mix, whole_groups

BITS, NEAR, SEED, SHINGLE = 64, 3, 42, 3
SEGMENT = 31  # 2^5 - 1: the length of a perfect Hamming code
#: Members of an anchor up to which all its pairs are compared at once.
SMALL = 64
#: Pairs that are compared at once.
PAIRS = 1 << 18
#: Members of an anchor above which they are dealt out by the other bits, in so many blocks.
HOT_ANCHOR, BLOCKS = 50_000, NEAR + 1
#: A class is hot if it holds more rows than both HOT_ROWS and this share of all: there are fewer than HOT_SHARE.
HOT_ROWS, HOT_SHARE = 1000, 10_000
_U = np.uint64


def fingerprint(text: str | bytes | None) -> int:
    """The SimHash of a text as an unsigned integer; a text without words has 0.

    A-Z are lower-cased; words are [^\\x20\\x09-\\x0D]+; shingles are three
    consecutive words joined by a space, repeats included; fewer words are one
    shingle.  A bit is 1 if more than half the shingles' XXH64 have it.
    """
    if not text:
        return 0
    words = (text.encode() if isinstance(text, str) else text).lower().split()  # bytes.split() knows these six blanks only
    if not words:
        return 0
    data = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    n = max(1, len(words) - SHINGLE + 1)
    last = end[-n:]
    one = xxhash.xxh64_intdigest
    h = np.array([one(data[a:b], SEED) for a, b in zip(start[:n].tolist(), last.tolist(), strict=True)], _U)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 14):
        part = h[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > n, bitorder="little").view(_U)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp: the fingerprint as a signed long), a row for each row of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column(1).cast(pa.large_binary()).to_pylist()], _U).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _syndromes(bits: int, offset: int) -> np.ndarray:
    """Of each value of so many bits, the exclusive or of the places (from 1) of its ones."""
    out = np.zeros(1 << bits, np.int64)
    for j in range(bits):
        out[1 << j : 2 << j] = out[: 1 << j] ^ (j + 1 + offset)
    return out


_LOW, _HIGH = _syndromes(16, 0), _syndromes(SEGMENT - 16, 16)
#: FLIPS[s]: what to flip in a segment with syndrome s to reach the anchors within 2; unused places are 0.
_FLIPS = np.zeros((SEGMENT + 1, 16), np.int64)
_N_FLIPS = np.ones(SEGMENT + 1, np.int64)
for _s in range(1, SEGMENT + 1):
    _pairs = [(1 << (i - 1)) | (1 << ((i ^ _s) - 1)) for i in range(1, SEGMENT + 1) if i < i ^ _s]
    _FLIPS[_s, : 1 + len(_pairs)] = [1 << (_s - 1), *_pairs]
    _N_FLIPS[_s] = 1 + len(_pairs)


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index into fp) for every anchor that these fingerprints are sent to."""
    out, of = [], []
    for k in (0, 1):
        segment = ((fp.view(_U) >> _U(SEGMENT * k)) & _U((1 << SEGMENT) - 1)).astype(np.int64)
        s = _LOW[segment & 0xFFFF] ^ _HIGH[segment >> 16]
        n = _N_FLIPS[s]
        used = np.arange(16) < n[:, None]
        out.append((((segment[:, None] ^ _FLIPS[s]) | (k << SEGMENT)))[used])
        of.append(np.repeat(np.arange(len(fp)), n))
    return np.concatenate(out), np.concatenate(of)


def _home(anchor: np.ndarray, fp: np.ndarray) -> np.ndarray:
    segment = (fp.view(_U) >> ((anchor >> SEGMENT) * SEGMENT).astype(_U)) & _U((1 << SEGMENT) - 1)
    return np.bitwise_count(segment ^ (anchor & ((1 << SEGMENT) - 1)).astype(_U)) <= 1


def _dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member of a hot anchor once for each block of the bits outside the anchor's segment; anchors below 0 are made of the three."""
    for batch in batches:
        anchor, fp, home = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        bits = fp.view(_U)
        low, high = bits & _U((1 << SEGMENT) - 1), bits >> _U(2 * SEGMENT)
        other = np.where(anchor >> SEGMENT == 0, (bits >> _U(SEGMENT)) & _U((1 << SEGMENT) - 1), low) | (high << _U(SEGMENT))
        width = -(-(BITS - SEGMENT) // BLOCKS)
        for k in range(BLOCKS):
            value = (other >> _U(width * k)) & _U((1 << width) - 1)
            key = mix(mix(anchor.view(_U) * _U(BLOCKS) + _U(k + 1)) + value) | _U(1 << 63)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(1), home], ["anchor", "fp", "home"])


class _Forest:
    """Union-find over values; links: the near pairs that joined two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))


def _spread(group: np.ndarray, forest: _Forest) -> None:
    """Links within one anchor's many members: from each reached member to those not reached yet."""
    rest = group
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest.view(_U) ^ x.view(_U)) <= NEAR
            for y in rest[near].tolist():
                forest.join(int(x), y)
            todo.extend(rest[near])
            rest = rest[~near]


def linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links (a, b) among the fingerprints that meet at an anchor, from rows sorted by anchor."""
    for table in whole_groups(batches, "anchor", 200_000):
        anchor, fp, at_home = table.column("anchor").to_numpy(), table.column("fp").to_numpy(), table.column("home").to_numpy(zero_copy_only=False)
        start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        size = np.diff(np.append(start, len(anchor)))
        forest = _Forest()
        for at, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            _spread(fp[at : at + n], forest)
        group = np.repeat(np.arange(len(start)), size)
        home = np.flatnonzero(at_home & (size[group] <= SMALL) & (size[group] > 1))
        many = np.cumsum(size[group[home]])
        begin = 0
        while begin < len(home):  # so many pairs at a time
            end = max(begin + 1, int(np.searchsorted(many, (many[begin - 1] if begin else 0) + PAIRS, "right")))
            own, begin = home[begin:end], end
            n = size[group[own]]
            left = np.repeat(own, n)
            right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[group[own]], n)
            near = ((left < right) | ~at_home[right]) & (np.bitwise_count(fp[left].view(_U) ^ fp[right].view(_U)) <= NEAR)
            for x, y in zip(fp[left[near]].tolist(), fp[right[near]].tolist(), strict=True):
                forest.join(x, y)
        links = forest.links
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])


def near_links(classes: DataFrame) -> DataFrame:
    """(a, b): pairs of fp within NEAR bits whose components are those of all such pairs; classes has each fp once."""

    def sent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), 1 << 14):
                part = fp[at : at + (1 << 14)]
                anchor, of = anchors(part)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[of]), pa.array(_home(anchor, part[of]))], ["anchor", "fp", "home"])

    schema = "anchor long, fp long, home boolean"
    met = classes.select("fp").mapInArrow(sent, schema)
    hot = written(met.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ANCHOR).select("anchor"), "hot")
    if not hot.isEmpty():
        met = met.join(hot, "anchor", "left_anti").unionByName(met.join(hot, "anchor", "left_semi").mapInArrow(_dealt, schema))
    return met.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(linked, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint: 16 hex digits, component_id: the smallest doc_id reachable over links).

    A row for each row of docs.  Null, empty and blank texts have fingerprint 0
    and are linked like any other.  Rows with the same doc_id are rows of their
    own; a null doc_id is never a component's id unless it has no other.  Other
    columns are not looked at.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    roots = connected_components(near_links(classes))
    grouped = roots.join(classes, roots["node"] == classes["fp"]).select("root", "fp", "least")
    whole = grouped.groupBy("root").agg(F.min("least").alias("whole"))
    own = grouped.join(whole, "root").select("fp", "whole")
    of = written(classes.join(own, "fp", "left").select("fp", "n", F.coalesce("whole", "least").alias("component_id")), "components")
    # rows of hot classes stay where they are; the others go by their fingerprint
    total = of.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(of.where(F.col("n") > max(HOT_ROWS, total // HOT_SHARE)).select("fp", "component_id"))
    spread = rows.join(hot.drop("component_id"), "fp", "left_anti").join(of.drop("n"), "fp").unionByName(rows.join(hot, "fp"))
    return spread.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
