"""Toxic spans and document scores from a linear-chain conditional random field over words.

Labels are given for documents. Words that stand in many different places of toxic
documents and hardly ever in others (whole, or by their first letters) are the
labelled tokens; the field learns them together with their neighbours and then
tags every word of a text. A document's score comes from its words' marginals.

Defined results: a null or empty text has the score of a text without toxic words
and no spans; labels that are null are left out; where either label is missing in
the sample all scores are the share of label 1 (0 without labels). Repeated rows
are scored alike. Extra columns pass through; output names replace columns.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import crf
from .common import column_of, small_batches
from .pieces import Known, chunks, strings

#: Labelled rows of each label to learn from, and characters of such a row at most (longer rows are not taken).
SAMPLE_ROWS, SAMPLE_CHARS = 1200, 50_000
#: Words around a labelled one, and windows of so many words, that the field is fitted on.
NEAR, WINDOWS = 8, 4000
CHUNK_BYTES = 2_000_000
CACHE_BYTES = 24_000_000
_word = re.compile(r"[^ \t\n\v\f\r]+")
#: Signs that are taken off both ends of a word.
EDGE = ".,;:!?\"'`()[]{}<>*&%$#@|/\\-_=+~^"


def plain(word: str) -> str:
    return word.lower().strip(EDGE)


def _keys(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in (4, 5, 6) if len(word) >= n)] if len(word) >= 3 else []


def toxic_keys(texts: list[list[str]], labels: list[int], support: int = 5, strength: float = 25.0) -> set[str]:
    """Words and beginnings of words that mark toxic documents: counted once for each pair of neighbours, tested by likelihood ratio."""
    places: dict[str, set[int]] = defaultdict(set)
    others: Counter[str] = Counter()
    total = [0, 0]
    for words, label in zip(texts, labels, strict=True):
        total[label] += len(words)
        if not label:
            others.update(words)
            continue
        for i, w in enumerate(words):
            around = zlib.crc32(f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}".encode("utf-8", "replace"))
            for k in _keys(w):
                places[k].add(around)
    spread: Counter[str] = Counter()
    for w, n in others.items():
        for k in _keys(w):
            spread[k] += n
    share = total[1] / sum(total)
    out = set()
    for k, around in places.items():
        a, b = len(around), spread[k]
        if a < support or a / total[1] < 20 * (b + 0.1) / total[0]:
            continue
        q = a / (a + b)
        g2 = 2 * (a * math.log(q / share) + (b * math.log((1 - q) / (1 - share)) if b else 0))
        if g2 >= strength:
            out.add(k)
    return out


#: Kinds of features: the word, its first 4, 5 and 6 letters, its length, the word before, the word after.
KINDS = 7


def _features(word: str) -> tuple:
    """Of each kind, the feature of a word (None: too short)."""
    n = len(word)
    return word, word[:4] if n >= 4 else None, word[:5] if n >= 5 else None, word[:6] if n >= 6 else None, min(n, 12), word, word


class ToxicityModel:
    """weights: for each kind of feature those that the sample held; others count nothing."""

    def __init__(self, weights: list[dict], trans: np.ndarray, start: np.ndarray, head: np.ndarray | None, base: float):
        self.weights, self.trans, self.start, self.head, self.base = weights, trans, start, head, base
        self._forget()

    def __getstate__(self):
        return {**self.__dict__, "known": None}

    def _forget(self) -> None:
        self.known: Known | None = None

    def _parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """What each word adds at its place, at the place after it and at the place before it."""
        out = np.zeros((len(words), 3))
        for k, word in enumerate(strings(words)):
            own = [d.get(f, 0.0) for d, f in zip(self.weights, _features(plain(word)), strict=True)]
            out[k] = sum(own[:5]), own[5], own[6]
        return out, np.ones(len(words), np.int64)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The marginal of each word, and the number of words of each text (no nulls)."""
        if self.known is None:
            self.known = Known(CACHE_BYTES)
        split = pc.ascii_split_whitespace(texts)
        size = pc.list_value_length(split).to_numpy().astype(np.int64)
        column = split.flatten().dictionary_encode()
        code = column.indices.to_numpy()
        at = self.known.numbers(column.dictionary, self._parts)
        parts = self.known.ids[self.known.starts[at]].reshape(-1, 3)
        word = pc.binary_length(column.dictionary).to_numpy()[code] > 0  # blanks at an end of a text leave empty strings
        owner = np.repeat(np.arange(len(size)), size)[word]
        size = np.bincount(owner, minlength=len(size))
        begins = np.zeros(len(owner), bool)
        begins[(np.cumsum(size) - size)[size > 0]] = True
        own, before, after = parts[code[word]].T
        e = own.copy()
        e[1:] += np.where(begins[1:], 0, before[:-1])
        e[:-1] += np.where(begins[1:], 0, after[1:])
        return crf.marginals(e, begins, self.trans, self.start), size

    @staticmethod
    def summary(p: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each text the log-odds of its likeliest toxic word."""
        out = np.full((len(size), 1), -12.0)
        q = np.clip(p, 6e-6, 1 - 6e-6)
        np.maximum.at(out[:, 0], np.repeat(np.arange(len(size)), size), np.log(q / (1 - q)))
        return out

    def score(self, texts: pa.Array, spans: bool = False) -> tuple[list[float], list[list[tuple[int, int, float]]]]:
        scores: list[float] = []
        found: list[list[tuple[int, int, float]]] = []
        for _, own in chunks(texts, CHUNK_BYTES):
            if self.head is None:
                scores += [self.base] * len(own)
                found += [[] for _ in own]
                continue
            p, size = self.words(own)
            scores += crf.logistic(self.summary(p, size), self.head).tolist()
            if spans:
                hot = p >= 0.5
                many = np.bincount(np.repeat(np.arange(len(size)), size)[hot], minlength=len(size))
                begin = np.cumsum(size) - size
                found += [self._spans(own[i].as_py(), p[begin[i] : begin[i] + size[i]]) if many[i] else [] for i in range(len(size))]
        return scores, found

    @staticmethod
    def _spans(text: str, p: np.ndarray) -> list[tuple[int, int, float]]:
        """Stretches of toxic words: start, end (in characters), the highest probability."""
        where = [m.span() for m in _word.finditer(text)]
        run: list[list] = []
        for k in np.flatnonzero(p >= 0.5).tolist():
            if run and k == run[-1][3] + 1:
                run[-1][1:] = [where[k][1], max(run[-1][2], float(p[k])), k]
            else:
                run.append([*where[k], float(p[k]), k])
        return [(x[0], x[1], x[2]) for x in run]


def fit_toxicity(train: DataFrame, *, text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> ToxicityModel:
    """Fits on a bounded sample of labelled rows, the first of each label in the order of their hash."""
    rows = train.select(F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & (F.length("t") <= sample_chars))
    got = []
    for y in (0, 1):
        got += rows.filter(F.col("y") == y).orderBy(F.xxhash64("t"), "t").limit(sample_rows).collect()
    return _fit([r["t"] for r in got], [r["y"] for r in got])


def _fit(texts: list[str], labels: list[int]) -> ToxicityModel:
    base = sum(labels) / len(labels) if labels else 0.0
    nothing = ToxicityModel([{} for _ in range(KINDS)], np.zeros((2, 2)), np.zeros(2), None, base)
    if not 0 < base < 1:
        return nothing
    split = [_word.findall(t) for t in texts]
    bare = [[plain(w) for w in x] for x in split]
    keys = toxic_keys(bare, labels)
    chains: list[tuple[list[str], list[int]]] = []
    quiet = [i for i, y in enumerate(labels) if not y and split[i]]
    for i, y in enumerate(labels):
        tag = [int(bool(y) and not keys.isdisjoint(_keys(w))) for w in bare[i]]
        at, last = [k for k, v in enumerate(tag) if v], -1
        for k in at:  # stretches around labelled words
            if k >= last:
                a, b = max(last, k - NEAR, 0), k + NEAR + 1
                while any(tag[b : b + NEAR]) and b < len(tag):
                    b += NEAR
                chains.append((split[i][a:b], tag[a:b]))
                last = b
    if not chains:
        return nothing
    for k in range(WINDOWS if quiet else 0):  # and stretches of other documents, dealt evenly
        x = split[quiet[k % len(quiet)]]
        a = zlib.crc32(f"{k}".encode()) % max(1, len(x) - 2 * NEAR)
        chains.append((x[a : a + 2 * NEAR], [0] * len(x[a : a + 2 * NEAR])))
    known: list[dict] = [{} for _ in range(KINDS)]
    feature, place = array("i"), array("i")
    tags, begins = [], []
    count = n = 0
    for words, tag in chains:
        feats = [_features(plain(w)) for w in words]
        for k, f in enumerate(feats):
            here = [*f[:5], feats[k - 1][5] if k else None, feats[k + 1][6] if k + 1 < len(feats) else None]
            for kind, x in enumerate(here):
                if x is not None:
                    at = known[kind].setdefault(x, count)
                    count += at == count
                    feature.append(at)
                    place.append(n)
            begins.append(k == 0)
            n += 1
        tags += tag
    w, trans, start = crf.fit_chain(np.frombuffer(feature, np.int32), np.frombuffer(place, np.int32), None, count, np.array(tags), np.array(begins))
    # the word before is a feature of the place after it, and the other way round
    model = ToxicityModel([{x: float(w[at]) for x, at in d.items() if abs(w[at]) > 1e-3} for d in known], trans, start, None, base)
    stats = [model.summary(*model.words(own)) for _, own in chunks(pa.array(texts, pa.string()), CHUNK_BYTES)]
    model.head = crf.fit_logistic(np.concatenate(stats), np.array(labels, float))
    model._forget()
    return model


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", spans: bool = True) -> DataFrame:
    """docs with score and, if spans, toxic_spans (start, end in characters, probability). Row by row, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name not in ("score", "toxic_spans")]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            scores, found = shared.value.score(column_of(batch, text_col), spans)
            cols = {f.name: batch.column(batch.schema.get_field_index(f.name)) for f in kept} | {"score": pa.array(scores, pa.float64())}
            if spans:
                cols["toxic_spans"] = pa.array([[{"start": a, "end": b, "p": p} for a, b, p in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType()), *([T.StructField("toxic_spans", _SPANS)] if spans else [])]))
