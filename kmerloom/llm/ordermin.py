"""Order MinHash fingerprints: sketches of texts that feel edit distance.

The k-mers of a text are its runs of K code points, each numbered by how often
it came before.  Numbered k-mers are hashed; the top bits of the hash say in
which of BINS bins one falls.  Of each bin the L least are taken, put back in
the order they have in the text, and hashed to 16 bits.  Two texts agree in a
bin if they share its least k-mers in the same order, so moving text counts as
well as changing it.  One hash with bins takes one pass where a hash function
for each place of the fingerprint would take BINS.

Likeness is the share of bins that agree among those either text fills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .text import grams, mix

K, L, BINS = 8, 2, 64
_BITS = BINS.bit_length() - 1
_U = np.uint64
_SHORT = 20  # texts of fewer than 2^20 code points: position and hash in one word


def _ordered(value: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """value (44 bits) in ascending order, ties by place, and the places."""
    if length < 1 << _SHORT:
        both = np.sort((value << _U(_SHORT)) | at)
        return both >> _U(_SHORT), both & _U((1 << _SHORT) - 1)
    order = np.lexsort((at, value))
    return value[order], at[order]


def sketch(text: str) -> np.ndarray:
    """BINS 16-bit values; 0: nothing fell in the bin.  The empty text has zeros alone."""
    if not text:
        return np.zeros(BINS, np.uint16)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    h = grams(points, min(K, len(points))) >> _U(64 - 44)
    kmer, at = _ordered(h, np.arange(len(h), dtype=_U), len(h))
    index = np.arange(len(h))
    new = np.ones(len(h), bool)
    new[1:] = kmer[1:] != kmer[:-1]
    number = (index - np.maximum.accumulate(np.where(new, index, 0))).astype(_U)
    value, at = _ordered(mix(kmer * _U(0x9E3779B97F4A7C15) + number * _U(0xC2B2AE3D27D4EB4F) + _U(1)) >> _U(64 - 44), at, len(h))
    first = np.searchsorted(value, np.arange(BINS + 1, dtype=_U) << _U(44 - _BITS))
    pick = first[:-1, None] + np.arange(L)
    there = pick < first[1:, None]
    pick = np.minimum(pick, len(value) - 1)
    place = np.where(there, at[pick], _U(1 << 63))
    order = np.argsort(place, axis=1, kind="stable")
    taken = np.where(np.take_along_axis(there, order, 1), np.take_along_axis(value[pick], order, 1) + _U(1), _U(0))
    out = np.zeros(BINS, _U)
    for j in range(L):
        out = mix(out * _U(0x9E3779B97F4A7C15) + taken[:, j])
    short = (out >> _U(48)).astype(np.uint16)
    return np.where(there[:, 0], np.maximum(short, 1), 0).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for two empty texts."""
    filled = (a != 0) | (b != 0)
    n = int(filled.sum())
    return float(((a == b) & filled).sum() / n) if n else 1.0


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by as much of the following text's beginning, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_ROW = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _row(doc_id: int | None, text: str, own: np.ndarray, following: str, next_own: np.ndarray) -> tuple:
    changed = edited(text, following)
    other = own if changed == text else sketch(changed)
    return (doc_id, len(text), hashlib.sha256(changed.encode()).digest(), own.astype(">u2").tobytes(), other.astype(">u2").tobytes(), likeness(own, other), likeness(own, next_own))


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_ARROW = pa.schema(list(zip(_COLUMNS, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()], strict=True)))
_EDGE = pa.schema([*_ARROW, ("part", pa.int32()), ("kind", pa.int32()), ("text", pa.string())])


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the next text's.

    The next document is the one after in ascending doc_id, after the last the
    first; rows of one doc_id follow each other by their text's hash, null ids
    come first.  A null text is empty.  A document alone follows itself.  A row
    for each row of docs; other columns are not looked at.

    Documents are dealt out by ranges of doc_id, so that a task meets the next
    document after each but its last.  Only that one and the first of a range
    cross between tasks.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before = None
        out: list[tuple] = []
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = value.as_py()
                now = (doc_id, value, sketch(value))
                if before is None:
                    out.append((doc_id, None, None, now[2].astype(">u2").tobytes(), None, None, None, part, 1, value))
                else:
                    out.append((*_row(*before, value, now[2]), part, 0, None))
                before = now
                if len(out) == 4096:
                    yield _columns(out, _EDGE)
                    out = []
        if before is not None:
            out.append((before[0], None, None, before[2].astype(">u2").tobytes(), None, None, None, part, 2, before[1]))
            yield _columns(out, _EDGE)

    # rows that are equal in both are told apart by where they are read, so no document fills a task
    order = ["doc_id", "_hash", "_read"]
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumns({"_hash": F.xxhash64("text"), "_read": F.monotonically_increasing_id()})
    dealt = read.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows = written(dealt.mapInArrow(run, f"{_ROW}, part int, kind int, text string"), "fingerprints")

    parts = sorted(r[0] for r in rows.where("kind = 1").select("part").collect())
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    firsts = rows.where("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    lasts = rows.where("kind = 2").select("part", "doc_id", "text", "fingerprint").join(follows, "part").join(firsts, "next_part")

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                _row(r["doc_id"], r["text"], np.frombuffer(r["fingerprint"], ">u2").astype(np.uint16), r["next_text"], np.frombuffer(r["next_fingerprint"], ">u2").astype(np.uint16))
                for r in batch.to_pylist()
            ]
            yield _columns(found, _ARROW)

    ends = lasts.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(close, _ROW)
    whole = rows.where("kind = 0").select(*_COLUMNS).unionByName(ends)
    return whole.select("doc_id", "n_chars", *[F.lower(F.hex(c)).alias(c) for c in _COLUMNS[2:5]], "near_edited", "near_next")
