"""Words of whole texts as NumPy arrays.

Texts are handled as UTF-8 bytes.  A batch of texts is laid end to end with a
separator after each, so that one pass over the bytes finds and hashes every
word of the batch; no work is done per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a piece by itself.
PIECE_BYTES = 2 << 20

_U = np.uint64


def _table(separators: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(separators)] = True
    return table


#: Separators of the word class [^\x20\x09-\x0D]+.
BLANK = _table([0x20, *range(0x09, 0x0E)])
#: Separators of the word class [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (on lower-cased text).
SYMBOL = _table([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def _places(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0xC2B2AE3D27D4EB4F)) | _U(1)


#: By seed: a number for each byte value, and for each place in a word.
_BYTES = [_BYTE, mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95) + _U(0x632BE59BD9B4E019))]
_PLACES = [_places(256), mix(_places(256)) | _U(1)]


def pieces(texts: list, limit: int = PIECE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) of runs of texts of about limit bytes; null is empty."""
    first, size, held = 0, 0, []
    for i, t in enumerate(texts):
        t = b"" if t is None else t.encode() if isinstance(t, str) else t
        if held and size + len(t) > limit:
            yield first, held
            first, size, held = i, 0, []
        held.append(t)
        size += len(t)
    if held:
        yield first, held


class Words:
    """The words of some texts: byte spans, the text of each, and 64-bit hashes."""

    def __init__(self, texts: list[bytes], separators: np.ndarray, lower: bool = False):
        data = b"\n".join(texts) + b"\n"
        self.data = data.lower() if lower else data
        self.bytes = np.frombuffer(self.data, np.uint8)
        inside = np.empty(len(self.bytes) + 1, bool)
        inside[0] = False
        np.logical_not(separators[self.bytes], out=inside[1:])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        #: first[i]: the first word of text i; one more at the end.
        self.first = np.concatenate(([0], np.searchsorted(self.start, ends)))
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A hash of each word's bytes, the same wherever the word stands; those of the two seeds, 0 and 1, are independent."""
        if not len(self):
            return np.empty(0, _U)
        length = self.end - self.start
        if (longest := int(length.max())) > len(_PLACES[seed]):
            _PLACES[seed] = _places(2 * longest) if seed == 0 else mix(_places(2 * longest)) | _U(1)
        total = np.cumsum(length)
        place = np.arange(total[-1]) - np.repeat(total - length, length)
        at = place + np.repeat(self.start, length)
        value = _BYTES[seed][self.bytes[at]] * _PLACES[seed][place]
        return mix(np.add.reduceat(value, total - length) + length.astype(_U))


def grams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each n consecutive hashes; those across texts are the caller's to drop."""
    if len(h) < n:
        return np.empty(0, _U)
    odd = _places(n + seed)[seed:]
    out = h[: len(h) - n + 1] * odd[0]
    for j in range(1, n):
        out += h[j : len(h) - n + 1 + j] * odd[j]
    return mix(out)


def window_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values, by doubling."""
    if len(x) < n:
        return x[:0]
    width, low = 1, x
    while 2 * width <= n:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return low if width == n else np.minimum(low[: len(x) - n + 1], low[n - width :])


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal neighbours."""
    if not len(sorted_values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return start, np.diff(np.append(start, len(sorted_values)))


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of about so many rows from batches sorted by key; no key is in two tables."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        if n >= rows and (cut := int(np.searchsorted(keys, keys[-1], "left"))) + (keys[0] != last) > 0:
            # the key that this batch ends with begins in it
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, n, batch = [], 0, batch.slice(cut)
        held.append(batch)
        n += batch.num_rows
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)
