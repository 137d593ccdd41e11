"""Exact removal of repeated word runs by super-k-mer partitioning.

A window is 35 consecutive words of one document.  The minimiser of a window is
the least hash among its 5-word grams.  Consecutive windows that share it travel
as one packed string, a super-k-mer, to the bucket of that minimiser; equal
windows have equal minimisers, so they meet in one bucket, where sorting the
windows' hashes counts them.  A super-k-mer holds about 17 windows in 50 words,
so a word is sent about three times rather than 35.

Packed strings for one bucket are sent in compressed blocks.  Sorting finds the
windows whose hashes agree, and those are compared word by word.

Before that, one pass counts the words that each minimiser would bring.  Those
that would fill a bucket by themselves are hot: their windows travel singly as
128-bit hashes, counted with a map-side sum and spread over all tasks by that
hash, so a passage in a third of all documents loads no bucket.  The two halves
of such a hash come from independent hashes of the words; windows count as equal
there if both agree.  Hot minimisers are told to all tasks as a bitmap of bounded
size, in which another one may be taken for hot: it travels the other way, with
the same result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .text import BLANK, Words, grams, mix, pieces, runs, window_min

WINDOW, GRAM = 35, 5
#: A minimiser is hot if it brings more words than both of these; bits of the map of the hot ones.
HOT_WORDS, HOT_SHARE, HOT_BITS = 1 << 21, 1 << 24, 1 << 27
#: Packed bytes that a bucket should hold, and a mapper collects before it sends.
BUCKET_BYTES, SEND_BYTES = 12 << 20, 48 << 20
_U = np.uint64
_DOCS = "doc_id long, mark long, text string"
_RANGES = "doc_id long, mark long, first long, last long"


def _super_kmers(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, windows) of each super-k-mer; a window goes by its first word."""
    low = window_min(grams(words.hashes(), GRAM), WINDOW - GRAM + 1)
    text = words.text_of()
    real = np.flatnonzero(text[: len(low)] == text[WINDOW - 1 : WINDOW - 1 + len(low)])
    if not len(real):
        return np.empty(0, _U), real, real
    new = np.concatenate(([True], (np.diff(real) > 1) | (low[real[1:]] != low[real[:-1]]) | (text[real[1:]] != text[real[:-1]])))
    start = np.flatnonzero(new)
    return low[real[start]], real[start], np.diff(np.append(start, len(real)))


def _window_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window, from independent hashes of the words."""
    return grams(words.hashes(), WINDOW), grams(words.hashes(1), WINDOW, seed=WINDOW)


def _place(key: np.ndarray) -> np.ndarray:
    """A minimiser's place in the map of hot ones."""
    return (mix(key ^ _U(0xA0761D6478BD642F)) & _U(HOT_BITS - 1)).astype(np.int64)


def _equal_neighbours(data: bytes, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which windows, in the order of key, have the words of another with the same key; data has one space between words."""
    again = np.zeros(len(key), bool)
    same = np.flatnonzero(key[1:] == key[:-1])
    text = lambda i: data[start[i] : end[i]]
    alike = np.fromiter((text(i) == text(i + 1) for i in same.tolist()), bool, len(same))
    again[same[alike]] = again[same[alike] + 1] = True
    for i in same[~alike].tolist():  # different words with one hash: each of the key's windows is compared with all
        a, b = int(np.searchsorted(key, key[i], "left")), int(np.searchsorted(key, key[i], "right"))
        count = Counter(map(text, range(a, b)))
        again[a:b] = [count[text(j)] > 1 for j in range(a, b)]
    return again


def _batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list]:
    return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2).cast(pa.large_binary()).to_pylist()


def _loads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(minimiser, words) of every super-k-mer."""
    for batch in batches:
        for _, texts in pieces(batch.column(0).cast(pa.large_binary()).to_pylist()):
            key, _, n = _super_kmers(Words(texts, BLANK))
            order = np.argsort(key)
            at, size = runs(key[order])
            if len(at):
                load = np.add.reduceat(n[order], at) + size * (WINDOW - 1)
                yield pa.RecordBatch.from_arrays([pa.array(key[order][at].view(np.int64)), pa.array(load)], ["minimiser", "words"])


def _joined_ranges(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into doc, first, last) of runs of consecutive windows of a document; both inputs in that order."""
    if not len(at):
        return at, at, at
    start = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (np.diff(at) > 1))))
    return start, at[start], at[np.append(start[1:], len(at)) - 1] + WINDOW - 1


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, first, last): word ranges covered by repeated windows, from docs (doc_id, mark, text)."""
    spark = docs.sparkSession
    loads = docs.select("text").mapInArrow(_loads, "minimiser long, words long").groupBy("minimiser").agg(F.sum("words").alias("words"))
    loads = written(loads, "loads")
    total = loads.agg(F.sum("words")).first()[0] or 0
    # fewer than HOT_SHARE of them, 8 bytes each
    hot = loads.where(F.col("words") > max(HOT_WORDS, total // HOT_SHARE)).select("minimiser").toArrow().column(0).to_numpy().view(_U)
    buckets = max(1, total * 7 // BUCKET_BYTES)
    if len(hot) <= 1 << 16:
        hot = np.sort(hot)
        is_hot = (lambda key: np.isin(key, hot)) if len(hot) else (lambda key: np.zeros(len(key), bool))
    else:
        marks = np.zeros(HOT_BITS, bool)
        marks[_place(hot)] = True
        sent_marks = spark.sparkContext.broadcast(np.packbits(marks))  # HOT_BITS / 8 bytes

        def is_hot(key: np.ndarray) -> np.ndarray:
            at = _place(key)
            return (sent_marks.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            ids, marks, values = _batch(batch)
            for first, texts in pieces(values):
                words = Words(texts, BLANK)
                key, at, n = _super_kmers(words)
                cold = ~is_hot(key)
                key, at, n = key[cold], at[cold], n[cold]
                a, b = words.start[at], words.end[at + n + WINDOW - 2]
                row = np.searchsorted(words.first, at, "right") - 1
                bucket = (mix(key) % _U(buckets)).astype(np.int64)
                data = words.data
                packed = [data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                held.append((bucket, packed, ids[first + row], marks[first + row], at - words.first[row], n))
                size += int((b - a).sum())
                if size >= SEND_BYTES:
                    yield from blocks(held)
                    held, size = [], 0
        yield from blocks(held)

    def blocks(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        bucket, ids, marks, at, n_windows = (np.concatenate([x[k] for x in held]) for k in (0, 2, 3, 4, 5))
        packed = [p for x in held for p in x[1]]
        squeeze = zstandard.ZstdCompressor(level=1).compress
        order = np.argsort(bucket, kind="stable")
        out = []
        for s, n in zip(*(x.tolist() for x in runs(bucket[order])), strict=True):
            own = order[s : s + n]
            where = np.concatenate([ids[own], marks[own], at[own], n_windows[own]]).astype(np.int64)
            out.append((int(bucket[own[0]]), squeeze(b"\n".join([packed[i] for i in own.tolist()])), squeeze(where.tobytes())))
            if len(out) == 64:
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["bucket", "packed", "place"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["bucket", "packed", "place"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        for batch in batches:
            for bucket, packed, place in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if bucket != now and held:
                    yield from counted(held)
                    held = []
                now = bucket
                held.append((packed, place))
        if held:
            yield from counted(held)

    def counted(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The repeated windows of one bucket."""
        loose = zstandard.ZstdDecompressor().decompress
        key, of, pos, where, start, end, data = [], [], [], [], [], [], []
        n_rows = n_bytes = 0
        for packed, place in held:
            place = np.frombuffer(loose(place), np.int64).reshape(4, -1)
            line = b" ".join(loose(packed).split())
            words = Words([line], BLANK)
            x = grams(words.hashes(), WINDOW)
            n_words = place[3] + (WINDOW - 1)
            first = np.cumsum(n_words) - n_words
            row = np.repeat(np.arange(len(n_words)), n_words)
            real = np.flatnonzero(row[: len(x)] == row[WINDOW - 1 : WINDOW - 1 + len(x)])
            key.append(x[real])
            start.append(words.start[real] + n_bytes)
            end.append(words.end[real + WINDOW - 1] + n_bytes)
            data.append(line)
            n_bytes += len(line)
            of.append(row[real] + n_rows)
            pos.append(real - first[row[real]] + place[2][row[real]])
            where.append(place)
            n_rows += len(n_words)
        key, of, pos, where, start, end = np.concatenate(key), np.concatenate(of), np.concatenate(pos), np.concatenate(where, axis=1), np.concatenate(start), np.concatenate(end)
        order = np.argsort(key, kind="stable")
        again = _equal_neighbours(b"".join(data), start[order], end[order], key[order])
        got = np.sort(order[again])  # in the order of the super-k-mers and their windows
        at, first, last = _joined_ranges(of[got], pos[got])
        row = of[got][at]
        for k in range(0, len(row), 1 << 16):
            r = row[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (where[0][r], where[1][r], first[k : k + (1 << 16)], last[k : k + (1 << 16)])], ["doc_id", "mark", "first", "last"])

    cold = docs.mapInArrow(send, "bucket long, packed binary, place binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, _RANGES)
    if not len(hot):
        return cold

    def single(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, values = _batch(batch)
            for first, texts in pieces(values):
                words = Words(texts, BLANK)
                key, at, n = _super_kmers(words)
                own = is_hot(key)
                if not own.any():
                    continue
                at, n = at[own], n[own]
                w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at, n)
                x, y = _window_hashes(words)
                row = np.searchsorted(words.first, w, "right") - 1
                for k in range(0, len(w), 1 << 16):
                    p, r = w[k : k + (1 << 16)], row[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x[p].view(np.int64)), pa.array(y[p].view(np.int64)), pa.array(ids[first + r].astype(np.int64)), pa.array(marks[first + r]), pa.array(p - words.first[r])],
                        ["x", "y", "doc_id", "mark", "at"],
                    )

    windows = written(docs.mapInArrow(single, "x long, y long, doc_id long, mark long, at long"), "windows")
    again = windows.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y")
    covered = windows.join(again, ["x", "y"], "left_semi")
    step = F.col("at") - F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy("at"))
    islands = covered.select("doc_id", "mark", "at").distinct().withColumn("island", step)
    ranges = islands.groupBy("doc_id", "mark", "island").agg(F.min("at").alias("first"), (F.max("at") + (WINDOW - 1)).alias("last"))
    return cold.unionByName(ranges.select("doc_id", "mark", "first", "last"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept: the kept words joined by one space), a row for each row of docs.

    Words are [^\\x20\\x09-\\x0D]+, unchanged.  A word goes if a window that
    covers it has the same words as one that starts anywhere else, the same
    document included; all windows are judged on the input.  A null or blank
    text has no words and keeps "".  Repeated rows are places of their own, so
    their windows are repeats of each other.  Rows with the same doc_id and
    different texts are told apart by the text's hash.  Other columns are not
    looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"), F.col(text_col).cast("string").alias("text"))
    # a null doc_id has its own mark, and 0 in the arrays
    keyed = rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.when(F.col("doc_id").isNull(), F.xxhash64("mark")).otherwise(F.col("mark")).alias("mark"), "text", F.col("doc_id").isNull().alias("nameless"))
    ranges = repeated_ranges(keyed.select("doc_id", "mark", "text"))
    covers = ranges.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "last")).alias("covers"))
    joined = keyed.join(covers, ["doc_id", "mark"], "left")
    firsts, lasts = F.coalesce(F.col("covers.first"), F.array().cast("array<long>")), F.coalesce(F.col("covers.last"), F.array().cast("array<long>"))

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, first, last in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                words = (text or "").encode().split()
                gone = 0
                if first:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, np.array(first), 1)
                    np.add.at(edge, np.array(last) + 1, -1)
                    stays = np.cumsum(edge)[:-1] == 0
                    gone = len(words) - int(stays.sum())
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                n_words.append(len(words) + gone)
                n_removed.append(gone)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    named = joined.select(F.when(~F.col("nameless"), F.col("doc_id")).alias("doc_id"), "text", firsts.alias("firsts"), lasts.alias("lasts"))
    return named.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))

