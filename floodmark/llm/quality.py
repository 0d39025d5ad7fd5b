"""Document quality from a linear-chain conditional random field over lines.

Every line gets measures of its signs and words and those of the lines beside it.
Labels are given for documents: lines start with the label of their document, and
lines of bad documents that look good to a first fit are then relabelled. A
document's score comes from the marginals of its lines, weighted by their length.

Defined results: a text without words (null, empty, blanks) has the score of a
text whose lines all are bad; where either label is missing in the sample all
scores are the share of label 1 (0 without labels). Null labels are left out.
Repeated rows are scored alike. Extra columns pass through; the output replaces
a column of its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import crf
from .common import slices, small_batches

#: Labelled rows of each label to learn from, and characters of such a row at most (longer rows are not taken).
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 50_000
CHUNK_CHARS = 2_000_000
#: A line with more words than this is measured in pieces of so many words, as if they were lines.
LINE_WORDS = 200

_CLASS = np.full(256, 4, np.uint8)  # 0 lower or beyond ASCII, 1 upper, 2 digit, 3 blank, 4 sign
_CLASS[[*range(97, 123), *range(128, 256)]] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_MIX = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64)


def lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of each line that holds a word, its length in bytes, and the text it is in."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    kind = _CLASS[data]
    solid = np.concatenate(([0], (kind != 3).view(np.int8), [0]))
    edge = np.flatnonzero(np.diff(solid))
    ws, we = edge[0::2], edge[1::2]  # words: runs without blanks
    if not len(ws):
        return np.zeros((0, N_FEATURES)), np.zeros(0), np.zeros(0, np.int64)
    breaks = np.flatnonzero(data == 10)
    line_of = np.searchsorted(breaks, ws)
    first = np.concatenate(([True], line_of[1:] != line_of[:-1]))
    nth = np.arange(len(ws)) - np.maximum.accumulate(np.where(first, np.arange(len(ws)), 0))
    first |= nth % LINE_WORDS == 0
    w0 = np.flatnonzero(first)
    words = np.diff(np.append(w0, len(ws)))
    begin, end = ws[w0], we[np.append(w0[1:], len(ws)) - 1]
    length = (end - begin).astype(float)
    share = []
    for k in (1, 2, 4):
        total = np.concatenate(([0], np.cumsum(kind == k)))
        share.append((total[end] - total[begin]) / length)
    letters = np.concatenate(([0], np.cumsum(kind <= 1)))
    upper = share[0] * length / np.maximum(1, letters[end] - letters[begin])
    # words by hash: equal to the one before, or to one of the few before that
    total = np.concatenate(([np.uint64(0)], np.cumsum(_MIX[data])))
    h = total[we] - total[ws]
    back = np.zeros((2, len(ws)), bool)
    if len(ws) > 1:
        back[0, 1:] = (h[1:] == h[:-1]) & ~first[1:]
    for d in range(2, 9):
        if len(ws) > d:
            back[1, d:] |= (h[d:] == h[:-d]) & (we[d:] - ws[d:] > 4)
    ends_in = data[we - 1]
    sign_end = (_CLASS[ends_in] == 4) & ~np.isin(ends_in, np.frombuffer(b".,;:?\"')", np.uint8))
    alone = (we - ws == 1) & (_CLASS[data[ws]] == 4)
    per = lambda x: np.add.reduceat(x.astype(float), w0) / words
    stop = np.isin(data[end - 1], np.frombuffer(b".!?", np.uint8)).astype(float)
    own = np.column_stack([
        upper, share[1], share[2], per(sign_end), per(alone), per(back[0]), per(back[1]), stop,
        (kind[begin] == 1).astype(float), np.minimum(length / words, 20) / 10, np.log1p(words) / 4, (words <= 2).astype(float),
    ])
    owner = np.searchsorted(np.cumsum([len(x) + 1 for x in raw]), begin, side="right")
    same = owner[1:] == owner[:-1]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    return np.column_stack([own, np.sqrt(own[:, :7]), before[:, :7], after[:, :7], np.ones(len(own))]), length, owner


N_FEATURES = 12 + 7 * 3 + 1


class QualityModel:
    def __init__(self, weights: np.ndarray, trans: np.ndarray, start: np.ndarray, head: np.ndarray | None, base: float):
        self.weights, self.trans, self.start, self.head, self.base = weights, trans, start, head, base

    def marginals(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        begins = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, bool)
        return crf.marginals(x @ self.weights, begins, self.trans, self.start)

    @staticmethod
    def summary(p: np.ndarray, length: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Log-odds of the mean marginal by length, and the share of the length in lines that look bad."""
        total = np.bincount(owner, length, minlength=n)
        mean = np.bincount(owner, p * length, minlength=n) / np.maximum(total, 1)
        bad = np.where(total > 0, np.bincount(owner, (p < 0.5) * length, minlength=n) / np.maximum(total, 1), 1.0)
        q = np.clip(mean, 1e-4, 1 - 1e-4)
        return np.column_stack([np.log(q / (1 - q)), bad])

    def score(self, texts: list[str | None]) -> list[float]:
        scores: list[float] = []
        for a, b in slices(texts, CHUNK_CHARS):
            if self.head is None:
                scores += [self.base] * (b - a)
                continue
            x, length, owner = lines(texts[a:b])
            scores += crf.logistic(self.summary(self.marginals(x, owner), length, owner, b - a), self.head).tolist()
        return scores

    def line_marginals(self, text: str | None) -> list[float]:
        """P(good) of each line that holds a word."""
        x, _, owner = lines([text or ""])
        return self.marginals(x, owner).tolist()


def fit_quality(train: DataFrame, *, text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> QualityModel:
    """Fits on a bounded sample of labelled rows, the first of each label in the order of their hash."""
    rows = train.select(F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & (F.length("t") <= sample_chars))
    got = []
    for y in (0, 1):
        got += rows.filter(F.col("y") == y).orderBy(F.xxhash64("t"), "t").limit(sample_rows).collect()
    return _fit([r["t"] for r in got], [r["y"] for r in got])


def _fit(texts: list[str], labels: list[int]) -> QualityModel:
    base = sum(labels) / len(labels) if labels else 0.0
    nothing = QualityModel(np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(2), None, base)
    if not 0 < base < 1:
        return nothing
    y = np.array(labels)
    x, length, owner = lines(texts)
    if not len(x):
        return nothing
    begins = np.concatenate(([True], owner[1:] != owner[:-1]))
    tags = y[owner]
    place, feature = np.nonzero(x)
    value = x[place, feature]
    for _ in range(3):
        w, trans, start = crf.fit_chain(feature, place, value, N_FEATURES, tags, begins, steps=60)
        model = QualityModel(w, trans, start, None, base)
        p = model.marginals(x, owner)
        # a bad document keeps one bad line at least: its least likely good one
        least = np.full(len(y), 2.0)
        np.minimum.at(least, owner, p)
        tags = np.where(y[owner] == 1, 1, ((p > 0.8) & (p > least[owner])).astype(int))
    model.head = crf.fit_logistic(model.summary(p, length, owner, len(y)), y.astype(float))
    return model


def score_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text") -> DataFrame:
    """docs with score. Row by row, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            scores = shared.value.score(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(scores, pa.float64())], names=[*(f.name for f in kept), "score"])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType())]))
