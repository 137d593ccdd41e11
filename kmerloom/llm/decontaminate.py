"""Benchmark decontamination by size-partitioned MinHash containment.

A document is contaminated by a test item if it holds at least 0.8 of the item's
distinct five-word shingles.  A sketch of a long document says next to nothing
about a short item in it, so the sketches are the items' own: items are
partitioned by size, and those of a partition have bottom-k MinHash sketches of
one k, large enough that whoever holds 0.8 of any of its items' shingles holds
one of the k least.  With at most u shingles in the partition, floor(0.2 u) may
be missing, so k = floor(0.2 u) + 1 finds every contaminated document.  Each
shingle hash of each document is looked up among the sketches, whatever the
document's length; the few that hit are verified on the shingles' words.

Items are the stated query set.  They are worked through in blocks of bounded
text, each sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean
from .text import SYMBOL, Words, grams, pieces

SHINGLE, SHARE = 5, Fraction(4, 5)
#: Bytes of items' text in a block.
BLOCK_BYTES = 8 << 20
#: Rows that are searched, and handed back, at a time.
TOGETHER = 1000
_FOUND = "array<struct<item_id: bigint, n_shared: bigint, n_shingles: bigint>>"
_U = np.uint64


def _shingles(words: Words, at: Iterable[int]) -> set[bytes]:
    start, end, data = words.start, words.end, words.data
    return {b" ".join(data[start[j] : end[j]] for j in range(i, i + SHINGLE)) for i in at}


class Sketches:
    """The sketches of a block of items, (item_id, text) each."""

    def __init__(self, items: list[tuple]):
        self.items: list[tuple[int | None, set[bytes], np.ndarray]] = []
        hashes, owners = [], []
        for item_id, text in items:
            words = Words([(text or "").encode()], SYMBOL, lower=True)
            if len(words) < SHINGLE:
                continue
            h = np.unique(grams(words.hashes(), SHINGLE))
            most = 1 << len(h).bit_length()  # items of [2^j, 2^(j+1)) shingles are one partition
            least = h[: int((1 - SHARE) * (most - 1)) + 1]
            hashes.append(least)
            owners.append(np.full(len(least), len(self.items)))
            self.items.append((item_id, _shingles(words, range(len(words) - SHINGLE + 1)), h))
        found = np.concatenate(hashes) if hashes else np.empty(0, _U)
        order = np.argsort(found)
        self.hash = found[order]
        self.owner = np.concatenate(owners)[order] if owners else np.empty(0, np.int64)
        self.mask = _U((1 << max(16, (64 * len(found)).bit_length())) - 1)
        self.seen = np.zeros(int(self.mask) + 1, bool)
        self.seen[(self.hash & self.mask).astype(np.int64)] = True

    def search(self, texts: list) -> Iterator[tuple[int, int | None, int, int]]:
        """(index of the text, item_id, shingles shared, shingles of the item) of each contamination."""
        if not self.items:
            return
        for base, part in pieces(texts):
            words = Words(part, SYMBOL, lower=True)
            h = grams(words.hashes(), SHINGLE)
            of = words.text_of()
            hit = np.flatnonzero(self.seen[(h & self.mask).astype(np.int64)])
            hit = hit[of[hit] == of[hit + SHINGLE - 1]]
            low, high = np.searchsorted(self.hash, h[hit], "left"), np.searchsorted(self.hash, h[hit], "right")
            met: dict[int, set[int]] = {}
            for p, a, b in zip(hit.tolist(), low.tolist(), high.tolist(), strict=True):
                if a < b:
                    met.setdefault(int(of[p]), set()).update(self.owner[a:b].tolist())
            for t, owners in met.items():
                first, last = int(words.first[t]), int(words.first[t + 1]) - SHINGLE + 1
                own = h[first:last]
                for owner in sorted(owners):
                    item_id, shingles, wanted = self.items[owner]
                    near = np.flatnonzero(np.isin(own, wanted)) + first
                    shared = len(_shingles(words, near.tolist()) & shingles)
                    if shared >= SHARE * len(shingles):
                        yield base + t, item_id, shared, len(shingles)


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    rows = items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).distinct()
    held, size = [], 0
    for item_id, text in rows.toLocalIterator():
        held.append((item_id, text))
        size += len(text or "")
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminations(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of each contaminated row of docs and item.

    A-Z are lower-cased; words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+.  A text
    of fewer than five words, an empty one or a null has no shingles: such an
    item contaminates nothing.  Repeated rows of docs each have their rows;
    repeated items count once.  Other columns are not looked at.
    """
    found = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_shingles", pa.int64())]))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.expr(f"cast(array() AS {_FOUND})").alias("found"))

    def search(block: list[tuple]) -> Callable:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sketches = Sketches(block)
            for batch in batches:
                met = batch.column(2).to_pylist()
                for t, item, shared, n in sketches.search(batch.column(1).cast(pa.large_binary()).to_pylist()):
                    met[t] = [*met[t], {"item_id": item, "n_shared": shared, "n_shingles": n}]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(met, found)], ["doc_id", "text", "found"])

        return run

    # block after block within each task: the documents are read once
    for block in _blocks(items, item_col, item_text_col):
        rows = rows.mapInArrow(search(block), f"doc_id long, text string, found {_FOUND}")
    return rows.select("doc_id", F.inline("found")).withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns; see contaminations."""

    def search(block: list[tuple]) -> Callable:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sketches = Sketches(block)
            for batch in batches:
                at = batch.schema.get_field_index(text_col)
                for start in range(0, batch.num_rows, TOGETHER):
                    part = batch.slice(start, TOGETHER)
                    stays = np.ones(part.num_rows, bool)
                    for t, *_ in sketches.search(part.column(at).cast(pa.large_binary()).to_pylist()):
                        stays[t] = False
                    yield part.filter(pa.array(stays))

        return lean(run)

    for block in _blocks(items, item_col, item_text_col):
        docs = docs.mapInArrow(search(block), docs.schema)
    return docs
