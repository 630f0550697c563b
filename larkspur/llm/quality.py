"""Quality classifier: which of two zstandard dictionaries, of good or of bad text, compresses a text better.

The dictionaries are trained on a bounded sample of whole labelled texts: zstandard picks the segments
that save most, wherever in a text they stand. The compressed sizes with either are normalised by the
size of the text, and a logistic curve, fitted to labelled text that is in neither dictionary, turns the
difference into a probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import batch, held_out, map_rows

#: Labelled documents learnt from, half of each label at most, and the longest that is; they are used whole. The fit is bounded, the scoring is not.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 32 << 10
#: The most bytes of a dictionary, and of a segment that it is made of.
DICTIONARY_BYTES, SEGMENT = 512 << 10, 256
LEVEL = 9
#: Long texts are compressed in pieces, so that the dictionary weighs the same throughout.
PIECE = 512
THRESHOLD = 0.7

_ROWS = "doc_id long,score double"


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float  # the score of a text without bytes

    def scorer(self) -> Callable[[list[bytes]], np.ndarray]:
        measure = _measure(self.good, self.bad)
        return lambda texts: np.where([not t for t in texts], self.prior, 1 / (1 + np.exp(-np.clip(_features([measure(t) for t in texts]) @ np.array(self.weights), -500, 500))))


def _measure(good: bytes, bad: bytes) -> Callable[[bytes], tuple[int, int, int]]:
    tools = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (good, bad)]

    def sizes(text: bytes) -> tuple[int, int, int]:
        return len(text), *(sum(len(tool.compress(text[k : k + PIECE])) for k in range(0, len(text), PIECE)) for tool in tools)

    return sizes


def _features(sizes: list[tuple[int, int, int]]) -> np.ndarray:
    """A constant, the normalised difference of the compressed sizes, and its weight in short texts."""
    n, good, bad = np.array(sizes, float).reshape(-1, 3).T
    n = np.maximum(n, 1)
    difference = (bad - good) / n
    return np.stack([np.ones_like(n), difference, (bad - good) / np.maximum(good, bad).clip(1), 1 / np.sqrt(n)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def dictionary(texts: list[bytes], most: int = DICTIONARY_BYTES) -> bytes:
    """Trained on whole texts; of texts too few or too short for that, the texts themselves as far as they fit."""
    total = sum(map(len, texts))
    try:
        return zstandard.train_dictionary(min(most, max(256, total // 4)), texts, k=SEGMENT, d=8).as_bytes()
    except zstandard.ZstdError:
        out, room = [b" " * 8], most
        for t in texts:
            if len(t) < room:
                out.append(t)
                room -= len(t) + 1
        return b"\n".join(reversed(out))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labelled rows that are not held out, at most SAMPLE_ROWS of them, spread by a hash of the id.

    Ids with both labels, texts of more than SAMPLE_BYTES, and empty texts are not learnt from; of several texts of
    an id the least is. Labels other than 0 and 1, null ids and labels of unknown documents don't count. Without a
    label the model scores all texts 0.5.
    """
    marked = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).filter("y IN (0, 1) AND doc_id IS NOT NULL")
    marked = marked.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").select("doc_id", "y")
    total = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    by = F.xxhash64("doc_id")
    picked = None
    for y in (0, 1):
        some = marked.filter(F.col("y") == y).orderBy(by, "doc_id").limit(SAMPLE_ROWS // 2)
        picked = some if picked is None else picked.union(some)
    text = docs.select(F.col("doc_id").cast("long"), F.encode(F.col("text").cast("string"), "UTF-8").alias("t")).filter(f"length(t) BETWEEN 1 AND {SAMPLE_BYTES}")
    found = text.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("t").alias("t")).collect()  # SAMPLE_ROWS of SAMPLE_BYTES at most
    rows = sorted((zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.y, bytes(r.t)) for r in found)
    if not rows:
        return Model(b" " * 8, b" " * 8, (0.0,) * 4, 0.5)
    prior = (total.get(1, 0) + 1) / (sum(total.values()) + 2)
    halves = [[(y, t) for k, (_, _, y, t) in enumerate(rows) if k % 2 == h] for h in (0, 1)]
    of = lambda some, y: dictionary([t for label, t in some if label == y])

    # Each half is measured with the dictionaries of the other; the curve is fitted to both.
    sizes, y = [], []
    for h in (0, 1):
        measure = _measure(*(of(halves[1 - h], k) for k in (1, 0)))
        sizes += [measure(t) for _, t in halves[h]]
        y += [k for k, _ in halves[h]]
    weights = _logistic(_features(sizes), np.array(y, float))
    # The sample holds as many of either label as it can; the constant moves to the share among all labels.
    good = (sum(y) + 1) / (len(y) + 2)
    weights[0] += np.log(prior / (1 - prior)) - np.log(good / (1 - good))
    return Model(of(halves[0] + halves[1], 1), of(halves[0] + halves[1], 0), tuple(weights.tolist()), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    Whole texts are compressed, very long ones like any other, in pieces of PIECE bytes. Null and empty texts get the
    share of good labels as their score. A score at the threshold is accepted. A repeated row gives a repeated result;
    a null doc_id stays null and is not held out; other columns are ignored; an empty table gives no row; without any
    label every score is 0.5.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                yield batch(_ROWS, doc_id=some.column(0), score=of([x or b"" for x in some.column(1).cast(pa.large_binary()).to_pylist()]))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _ROWS)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the classifier accepts, with all their columns, of any type and name.

    Null and empty texts stay if the share of good labels is at least the threshold; repeated rows stay or go together.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                yield some.filter(pa.array(of([x or b"" for x in some.column(at).cast(pa.large_binary()).to_pylist()]) >= THRESHOLD))

    return map_rows(docs, run, docs.schema)
