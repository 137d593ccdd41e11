"""Token ids as flat binary files with 64-bit document offsets.

A set of files for each partition p, in the order of the documents:

    part-p-*.bin   all token ids, end ids included, as little-endian unsigned
                   integers: 16 bits if the vocabulary's ids fit, else 32
    part-p-*.idx   offsets of the documents within it, unsigned 64-bit: one for
                   each document and one at the end
    part-p-*.doc   the documents' ids, signed 64-bit, then a byte for each
                   document that is 1 if its id is null

The manifest has a row for each partition.  The number of ids before a
partition is the prefix sum over the manifest, so no task waits for another.
A task that runs twice writes two sets of files; the manifest names the one that
counts.  Local files are memory-mapped.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, written

#: Pieces that an encoder learns before it forgets those it has not met again since the last such time.
REMEMBERED = 600_000
#: Pieces that go to the library in one call.
TOGETHER = 64
_MARKS = ".,;:!?"
_MANIFEST = "part int, bin string, idx string, doc string, n_docs long, n_ids long, width int"


class Encoder:
    """A tokenizer of the tokenizers library that remembers the ids of pieces of text.

    Byte-level tokenizers cut a text before each blank that follows something
    else and is followed by something else, whatever stands around it.  So a
    text whose blanks are single spaces and line ends is encoded piece by piece,
    each piece by the library once.  Any other text, and any other kind of
    tokenizer, goes to the library whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
        )
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        top = max([*self.tokenizer.get_vocab(with_added_tokens=True).values(), 0])
        self.dtype = np.dtype("<u2") if top < 1 << 16 else np.dtype("<u4")
        self.line_end = self._encode(["\n"])[0]
        self.line_id = int(np.frombuffer(self.line_end, self.dtype)[0])
        self.by_piece &= len(self.line_end) == self.dtype.itemsize
        self.tails: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        # a piece without the space before it, or with the line end before it -> ids of it all; None: it cannot stand alone
        self.before: dict = getattr(self, "known", {})
        self.known: dict = {"": None, "\n": None}

    def _encode(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.dtype.itemsize == 2 else "I"
        return [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        known, before = self.known, self.before
        if met := pieces & before.keys():
            known.update((p, before[p]) for p in met)
            pieces = pieces - met
        todo, marked = [], []
        for p in pieces:
            w = p.rstrip(_MARKS)
            # letters and the marks after them are encoded apart
            if w is not p and (w if w[:1] != "\n" else w[1:]).isalpha():
                marked.append((p, w))
                if w not in known:
                    todo.append(w)
            elif (core := p.removeprefix("\n")).strip() == core:
                todo.append(p)
            else:
                known[p] = None
        for at in range(0, len(todo), TOGETHER):
            part = todo[at : at + TOGETHER]
            # line ends part the pieces, and their ids; no piece has another within it
            ids = self._encode(["".join([p if p[0] == "\n" else "\n " + p for p in part])])[0]
            size = self.dtype.itemsize
            cut = (np.flatnonzero(np.frombuffer(ids, self.dtype) == self.line_id) * size).tolist()
            known.update((p, ids[a:b] if p[0] == "\n" else ids[a + size : b]) for p, a, b in zip(part, cut, [*cut[1:], len(ids)], strict=True))
        for p, w in marked:
            tail = p[len(w) :]
            if tail not in self.tails:
                self.tails[tail] = self._encode([tail])[0]
            known[p] = known[w] + self.tails[tail]

    def encode(self, text: str) -> bytes:
        """The ids of a text, as bytes of self.dtype."""
        if not text:
            return b""
        if not self.by_piece or any(s in text for s in self.special):
            return self._encode([text])[0]
        if len(self.known) > self.remembered:
            self._forget()
        # as if the text began a line
        pieces = ("\n" + text.replace("\n", " \n")).split(" ")
        if missing := set(pieces).difference(self.known):
            self._learn(missing)
        try:
            return b"".join(map(self.known.__getitem__, pieces))[len(self.line_end) :]
        except TypeError:  # blanks that stand together
            return self._encode([text])[0]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder_of(path: str, remembered: int = REMEMBERED) -> Encoder:
    """This process's encoder of a tokenizer file; a worker keeps it from task to task."""
    if (path, remembered) not in _ENCODERS:
        _ENCODERS.clear()  # one at a time
        _ENCODERS[path, remembered] = Encoder(path, remembered)
    return _ENCODERS[path, remembered]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, order: list[Column] | None = None, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Write the ids of every text, each with end_id appended, and return the manifest.

    order: what the documents are sorted by; doc_id, and texts of one doc_id by
    their hash, unless given.  remembered: pieces a worker's encoder keeps, about
    250 bytes each and twice as many at most.  A null text is empty: it has the end id alone.  No
    documents: no files.  Other columns are not looked at.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, remembered)
        end = np.array([end_id], encoder.dtype).tobytes()
        part = TaskContext.get().partitionId()
        base = f"part-{part:05d}-{uuid.uuid4().hex}"
        names = [f"{base}.{x}" for x in ("bin", "idx", "doc")]
        store, folder = fs.FileSystem.from_uri(path)
        sizes, ids, nulls, out = [0], [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(f"{folder}/{names[0]}")
            ids.append(batch.column(0).fill_null(0).to_numpy())
            nulls.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
            for text in batch.column(1).to_pylist():
                data = encoder.encode(text or "")
                sizes.append(len(data) // encoder.dtype.itemsize + 1)
                out.write(data + end)
        if out is None:
            return
        out.close()
        offsets = np.cumsum(np.array(sizes, "<u8"))
        for name, data in ((names[1], offsets.tobytes()), (names[2], np.concatenate(ids).astype("<i8").tobytes() + np.concatenate(nulls).astype("u1").tobytes())):
            with store.open_output_stream(f"{folder}/{name}") as f:
                f.write(data)
        row = {"part": part, "bin": names[0], "idx": names[1], "doc": names[2], "n_docs": len(offsets) - 1, "n_ids": int(offsets[-1]), "width": encoder.dtype.itemsize}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("bin", pa.string()), ("idx", pa.string()), ("doc", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32())]))

    text = F.col(text_col).cast("string")
    keys = order or [F.col(id_col).cast("long"), F.xxhash64(text)]
    sort = [f"_sort{i}" for i in range(len(keys))]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *[k.alias(s) for k, s in zip(keys, sort, strict=True)])
    # rows that are equal in all keys are told apart by where they are read, so no key fills a task
    sort.append("_read")
    dealt = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort).select("doc_id", "text")
    return written(dealt.mapInArrow(run, _MANIFEST), "manifest")


def _mapped(path: str, name: str, dtype: np.dtype | str) -> np.ndarray:
    store, folder = fs.FileSystem.from_uri(path)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(f"{folder}/{name}", dtype, "r")
    with store.open_input_file(f"{folder}/{name}") as f:
        return np.frombuffer(f.read_buffer(), dtype)


def read_tokens(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(position, doc_id, start, n_tokens, ids_crc32) of each document, from the files.

    start: ids of all documents before it; ids_crc32: unsigned CRC-32 of its ids
    as little-endian unsigned 32-bit integers.
    """
    parts = manifest.orderBy("part").collect()  # a row for each partition
    docs = [0, *accumulate(p["n_docs"] for p in parts)]
    bases = [0, *accumulate(p["n_ids"] for p in parts)]
    rows = [(p["bin"], p["idx"], p["doc"], p["width"], d, b) for p, d, b in zip(parts, docs, bases, strict=False)]
    files = spark.createDataFrame(rows, "bin string, idx string, doc string, width int, docs long, base long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _mapped(path, row["bin"], f"<u{row['width']}")
                offsets = _mapped(path, row["idx"], "<u8").astype(np.int64)
                doc = _mapped(path, row["doc"], "u1")
                n = len(offsets) - 1
                names, null = doc[: 8 * n].view("<i8"), doc[8 * n :].astype(bool)
                for at in range(0, n, 1 << 12):
                    to = min(n, at + (1 << 12))
                    cut = offsets[at : to + 1].tolist()
                    wide = memoryview(ids[cut[0] : cut[-1]].astype("<u4")).cast("B")
                    crc = [zlib.crc32(wide[4 * (a - cut[0]) : 4 * (b - cut[0])]) for a, b in zip(cut, cut[1:], strict=False)]
                    own = offsets[at : to + 1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(at, to) + row["docs"]), pa.array(np.array(names[at:to]), mask=null[at:to]), pa.array(own[:-1] + row["base"]), pa.array(np.diff(own)), pa.array(crc, pa.int64())],
                        ["position", "doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return files.repartition(max(1, len(rows))).mapInArrow(run, "position long, doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int, **kw) -> DataFrame:
    """Write token files to the shared folder and return what they hold; see write_tokens and read_tokens."""
    path = new_path(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, path, write_tokens(docs, path, tokenizer, end_id, **kw))
