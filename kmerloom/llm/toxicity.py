"""Toxicity by compression distance: one zstandard dictionary for toxic text, one for ordinary text.

A window is a word.  It is compressed with either dictionary, and the bytes that
the toxic one saves against the ordinary one are the window's distance.  A word
is too short for a match in a dictionary to save whole bytes, so it is first
spread: each byte becomes three that depend on it and all bytes before it in the
word.  Spread words share a beginning as long as the words do, and nothing else.

A dictionary for toxic text must hold what is particular to it.  Beginnings of
words are counted in both classes by the number of different words before them,
so that copies of a document count once; those several times as frequent in
toxic text are what the toxic dictionary is trained on.

The distances of a document's windows, each different word once, give a few
figures; a logistic curve over these, fitted on the same labelled rows, sets the
thresholds.  The fit uses at most TOXIC_ROWS and ORDINARY_ROWS labelled rows of
at most LONGEST characters each; scoring reads every whole text.  Labels,
language, source and id are no inputs.

Dictionaries trained on the whole text of either class, with windows of several
words, were tried and tell much less: a toxic document is ordinary text but for a
few words, and the trainer spends its bytes on that.  The README has figures.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean
from .text import SYMBOL

#: Labelled rows of each class that the fit uses at most, and the characters that such a row has at most.
TOXIC_ROWS, ORDINARY_ROWS, LONGEST = 1500, 3000, 50_000
#: Bytes of the dictionaries; words of the samples that ordinary text is cut into.
TOXIC_BYTES, ORDINARY_BYTES, SAMPLE_WORDS = 16 << 10, 64 << 10, 30
#: A beginning is particular if it has so many bytes and places, is so many times as frequent in toxic
#: text, and not rarer there than the most frequent such one by more than FLOOR.
BEGINNING, PLACES, TIMES, FLOOR = 4, 3, 8, 100
THRESHOLD = 0.3
REMEMBERED = 150_000
#: Texts that are scored together.
TOGETHER = 1000
_CLEAN = bytes(0x20 if SYMBOL[b] and not 0x41 <= b <= 0x5A else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words(text: str | bytes | None) -> list[bytes]:
    """[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    if not text:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_CLEAN).split()


def spread(word: bytes) -> bytes:
    out, h = bytearray(), 0x9E3779B9
    for b in word:
        h = (h * 0x01000193 ^ (b + 1) * 0x85EBCA6B) & 0xFFFFFFFF
        x = (h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF
        out += ((x ^ (x >> 12)) & 0xFFFFFF).to_bytes(3, "little")
    return bytes(out)


def _beginnings(texts: list) -> tuple[Counter, int]:
    """How many different words stand before words with each beginning."""
    pairs = {(hash(a), b) for t in texts for w in [words(t)] for a, b in zip([b"", *w], w, strict=False)}
    count: Counter = Counter()
    for word, n in Counter(b for _, b in pairs).items():
        for k in range(min(BEGINNING, len(word)), len(word) + 1):
            count[word[:k]] += n
    return count, len(pairs)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: they are the dictionary
        return b"".join(samples)[-size:]


@dataclass
class Model:
    """Two dictionaries and the curve over the figures of a document."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def __post_init__(self) -> None:
        self._known: dict[bytes, int] = {}
        self._before: dict[bytes, int] = {}
        self._pair: tuple | None = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def distance(self, word: bytes) -> int:
        """Bytes that the toxic dictionary saves on a window against the ordinary one."""
        if self._pair is None:
            own = [zstandard.ZstdCompressionDict(d) for d in (self.toxic, self.ordinary)]
            self._pair = tuple(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_dict_id=False).compress for d in own)
        data = spread(word)
        return len(self._pair[1](data)) - len(self._pair[0](data))

    def figures(self, text: str | bytes | None) -> list[float]:
        if len(self._known) > REMEMBERED:
            self._before, self._known = self._known, {}
        own, known = set(words(text)), self._known
        for w in own.difference(known):
            known[w] = self._before[w] if w in self._before else self.distance(w)
        d = np.sort(np.fromiter((known[w] for w in own), np.int64, len(own)))[::-1]
        if not len(d):
            return [0.0] * 5
        return [float(d[0]), float(d[:3].mean()), float((d >= 5).mean()), float(np.log1p((d >= 5).sum())), float(np.log1p((d >= 8).sum()))]

    def score(self, figures: np.ndarray) -> np.ndarray:
        """0 to 1 for each row of figures."""
        z = (figures - self.centre) / self.scale @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list, toxic: list) -> Model | None:
    """A model of labelled texts; None without texts of both classes."""
    rows = list({t: int(y) for t, y in zip(texts, toxic, strict=True) if t}.items())
    bad, good = [t for t, y in rows if y], [t for t, y in rows if not y]
    if not bad or not good:
        return None
    in_bad, n_bad = _beginnings(bad)
    in_good, n_good = _beginnings(good)
    more = {p: n for p, n in in_bad.items() if n >= min(PLACES, len(bad)) and n / max(n_bad, 1) > TIMES * (in_good[p] + 1) / max(n_good, 1)}
    top = max(more.values(), default=0)
    own = {p for p, n in more.items() if FLOOR * n >= top}

    def particular(word: bytes) -> bytes:
        return next((spread(word[:k]) for k in range(len(word), 0, -1) if word[:k] in own), b"")

    samples = [s for t in bad if (s := b"".join(map(particular, words(t))))]
    every = [w for t in good for w in words(t)]
    shape = {w: spread(w) for w in set(every)}
    plain = [b"".join(map(shape.__getitem__, every[i : i + SAMPLE_WORDS])) for i in range(0, len(every), SAMPLE_WORDS)]
    model = Model(_dictionary(samples or [b"\0" * 8], TOXIC_BYTES), _dictionary(plain or [b"\0" * 8], ORDINARY_BYTES), np.zeros(6), np.zeros(5), np.ones(5))
    x = np.array([model.figures(t) for t, _ in rows])
    y = np.array([y for _, y in rows], float)
    model.centre, model.scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - model.centre) / model.scale])
    w = np.zeros(6)
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step_ = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(6), z.T @ (p - y) + 0.5 * w)
        w -= step_
        if np.abs(step_).max() < 1e-8:
            break
    # the sample may hold more toxic rows than their share; fit_labels puts that right
    model.weights = w
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """A model of the labelled documents that are not held out.

    Of each class, the rows that come first by the hash of their id, as many as
    the parameters say; of rows with one id the text that comes first by its
    hash; none longer than LONGEST.  So what the driver collects is bounded.  An
    id with several labels is toxic if one says so; null ids and labels are left
    out.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r["toxic"] > 0: r["n"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    picked = [known.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in ((F.col("toxic") > 0, TOXIC_ROWS), (F.col("toxic") <= 0, ORDINARY_ROWS))]
    chosen = picked[0].unionAll(picked[1])  # of bounded size
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") <= LONGEST)
    of = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t"), F.first("toxic").alias("toxic"))
    rows = of.select("doc_id", F.col("t.text").alias("text"), "toxic").collect()
    rows.sort(key=lambda r: r["doc_id"])
    model = fit([r["text"] for r in rows], [r["toxic"] > 0 for r in rows])
    if model is not None:
        used = [max(1, sum((r["toxic"] > 0) == kind for r in rows)) for kind in (True, False)]
        model.weights[0] += np.log(max(total.get(True, 0), 1) / max(total.get(False, 0), 1)) - np.log(used[0] / used[1])
    return model


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score, 0 to 1, from whole texts; without a model all have 0.  A column of that name is replaced."""
    out = docs.drop(score_col)
    if model is None:
        return out.withColumn(score_col, F.lit(0.0))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                figures = np.array([model.figures(t) for t in part.column(at).cast(pa.large_binary()).to_pylist()]).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(figures))], [*batch.schema.names, score_col])

    fields = out.schema
    return out.mapInArrow(lean(run), type(fields)([*fields.fields]).add(score_col, "double"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs.

    A null text is empty; an empty text has the score of figures that are all
    zero.  A null doc_id is not held out.  Other columns are not looked at.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scored(own, fit_labels(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
