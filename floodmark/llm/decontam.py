"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents become words: A-Z is lowered and a word is a run of ASCII
letters, digits and characters beyond ASCII. The automaton accepts every run of
words that occurs inside an item. Document words stream through it, which gives
for each word the longest run ending there that some item contains; a run of at
least ``window`` words marks its words as hit, and so does the whole of an item
that is shorter than ``window``.

Defined results: a null or empty text has no words, no hits and no items; a null
item text or one without words matches nothing; an empty benchmark hits nothing;
repeated items share their runs and each of their ids is listed; a null item id
is listed as ``null``. Extra columns pass through; an output name that a
document column has already replaces that column.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_of, slices, small_batches

#: Words of test items in one automaton; a larger benchmark has several, and a task holds one at a time.
SHARD_WORDS = 100_000
#: An item with more words than this is cut into pieces that overlap by window - 1 words.
PIECE_WORDS = 20_000
#: Characters of documents that are held as arrays at a time.
CHUNK_CHARS = 2_000_000
#: Bytes of texts, about, that all automata walk over in turn where there are several.
GROUP_BYTES = 16_000_000
#: A word of an item, in any case.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(m - 1, p, np.uint64)))) for p in (_P, _P_INV)]
    return _powers[0], _powers[1]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words of UTF-8 text."""
    mask = np.zeros(len(data) + 2, bool)
    mask[1:-1] = _WORD_BYTE[data]
    edge = np.flatnonzero(mask[1:] != mask[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, letters lowered."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, inv = _power(len(data))
    with np.errstate(over="ignore"):
        total = np.concatenate(([np.uint64(0)], np.cumsum(_MIX[_LOWER[data]] * p[: len(data)])))
        h = (total[ends] - total[starts]) * inv[starts]
        h ^= (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


class ItemAutomaton:
    """Generalised suffix automaton of word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, str]], window: int, piece_words: int = PIECE_WORDS):
        self.window = window
        seqs: list[tuple[str, np.ndarray]] = []
        for item, text in items:
            data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            words = word_hashes(data, *word_spans(data))
            if len(words):
                for at in range(0, max(1, len(words) - window + 1), piece_words):
                    seqs.append((item, words[at : at + piece_words + window - 1]))
        self.names = [item for item, _ in seqs]
        all_words = np.concatenate([w for _, w in seqs]) if seqs else np.zeros(0, np.uint64)
        self.vocabulary = np.unique(all_words)
        ids = [np.searchsorted(self.vocabulary, w).tolist() for _, w in seqs]
        self.shortest = min((min(len(x), window) for x in ids), default=0)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for seq in ids:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        self.anchor = [-1] * len(self.length)  # the ancestor that holds the suffix of window words
        for s in order:
            if self.length[s] >= window:
                up = self.link[s]
                self.anchor[s] = s if self.length[up] < window else self.anchor[up]
        self.items: dict[int, set[int]] = {}
        whole: dict[int, list[tuple[int, int]]] = {}
        for k, seq in enumerate(ids):
            s, n = 0, 0
            for c in seq:
                s, n = self.next[s][c], n + 1
                while n > self.length[s]:
                    raise AssertionError("an item left its own automaton")
                if n >= window:
                    self.items.setdefault(self._holding(s, window), set()).add(k)
            if n < window:
                whole.setdefault(s, []).append((n, k))
        #: For each state the short items that end in it or above it: (words, sequence).
        self.short: dict[int, list[tuple[int, int]]] = {}
        if whole:
            for s in order:
                found = whole.get(s, []) + self.short.get(self.link[s], [])
                if found:
                    self.short[s] = found
        self._triples(ids)

    def _holding(self, s: int, n: int) -> int:
        while self.length[self.link[s]] >= n:
            s = self.link[s]
        return s

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = len(length)
        length.append(length[last] + 1)
        nxt.append({})
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(length)
        length.append(length[p] + 1)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def _triples(self, ids: list[list[int]]) -> None:
        """Three words in a row, as one number: runs without them need not be streamed."""
        size = len(self.vocabulary) + 1
        self.packed = size < 2_000_000
        seen = {(a * size + b) * size + c for x in ids for a, b, c in zip(x, x[1:], x[2:], strict=False)} if self.packed and self.shortest >= 3 else set()
        self.triples = np.array(sorted(seen), np.int64)

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def runs(self, ids: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words that could hold a window: known words whose triples all occur."""
        n = len(ids)
        if n == 0 or not self.shortest:
            return []
        fits = ids >= 0
        breaks = np.zeros(n + 1, bool)
        breaks[bounds] = True
        if self.packed and self.shortest >= 3 and n >= 3:
            size = len(self.vocabulary) + 1
            good = fits[:-2] & fits[1:-1] & fits[2:] & ~breaks[1 : n - 1] & ~breaks[2:n]
            at = np.flatnonzero(good)
            code = (ids[at] * size + ids[at + 1]) * size + ids[at + 2]
            if len(self.triples):
                k = np.minimum(np.searchsorted(self.triples, code), len(self.triples) - 1)
                at = at[self.triples[k] == code]
            else:
                at = at[:0]
            starts = np.zeros(n, bool)
            starts[at] = True
            edge = np.flatnonzero(np.diff(np.concatenate(([0], starts.view(np.int8), [0]))))
            begin, end = edge[0::2], edge[1::2] + 2
        else:
            cut = np.concatenate(([0], fits.view(np.int8), [0]))
            edge = np.flatnonzero(np.diff(cut))
            begin, end = [], []
            for a, b in zip(edge[0::2], edge[1::2], strict=True):
                inner = np.flatnonzero(breaks[a + 1 : b]) + a + 1
                begin += [a, *inner]
                end += [*inner, b]
            begin, end = np.array(begin, int), np.array(end, int)
        long = (end - begin) >= self.shortest
        return list(zip(begin[long].tolist(), end[long].tolist(), strict=True))

    def stream(self, ids: list[int], at: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        """Longest matching lengths over ids, whose first word is word number at."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        s, n = 0, 0
        for i, c in enumerate(ids, at + 1):
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            if c in nxt[s]:
                s, n = nxt[s][c], n + 1
            else:
                s, n = 0, 0
            if n >= window:
                spans.append((i - n, i))
                # n may be below length[s]; a suffix of window words is in s or above it
                found |= self.items.get(self.anchor[s], set())
            for m, k in self.short.get(s, ()):
                if m <= n:
                    spans.append((i - m, i))
                    found.add(k)

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int]], list[str], list[tuple[int, int]]]]:
        """For each text: words, hit ranges of words, item names, the same ranges in characters."""
        for a, b in slices(texts, CHUNK_CHARS):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts[a:b]]
            data = np.frombuffer(b"\n".join(raw), np.uint8)
            begins = np.cumsum([0] + [len(x) + 1 for x in raw])[:-1]
            starts, ends = word_spans(data)
            ids = self.word_ids(word_hashes(data, starts, ends))
            bounds = np.append(np.searchsorted(starts, begins), len(starts))
            hits: dict[int, tuple[list, set]] = {}
            for x, y in self.runs(ids, bounds):
                doc = int(np.searchsorted(bounds, x, side="right")) - 1
                spans, found = hits.setdefault(doc, ([], set()))
                self.stream(ids[x:y].tolist(), x - int(bounds[doc]), spans, found)
            for k in range(b - a):
                n = int(bounds[k + 1] - bounds[k])
                spans, found = hits.get(k, ((), ()))
                hit = merged(spans)
                where = []
                for x, y in hit:
                    p, q = (int(v - begins[k]) for v in (starts[bounds[k] + x], ends[bounds[k] + y - 1]))
                    p, q = (len(raw[k][:v].decode("utf-8", "surrogatepass")) for v in (p, q))
                    where.append((p, q))
                yield n, hit, sorted({self.names[i] for i in found}), where


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_OUT = [T.StructField("n_words", T.LongType()), T.StructField("hit_words", _SPAN), T.StructField("hit_chars", _SPAN), T.StructField("hit_items", T.ArrayType(T.StringType()))]


def _pieces(benchmark: DataFrame, item_col: str, text_col: str, window: int, words: int) -> DataFrame:
    """i, at, t and n: the words of items, long ones cut into pieces that overlap by window - 1 words."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0)).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window), F.lit(words))
    cut = items.filter(F.size("w") > 0).select("i", "w", F.explode(starts).alias("at"))
    part = F.slice("w", F.col("at") + 1, F.lit(words + window - 1))
    return cut.select("i", "at", F.array_join(part, " ").alias("t"), F.size(part).alias("n"))


def _shards(benchmark: DataFrame, item_col: str, text_col: str, window: int, shard_words: int) -> Iterator[list[tuple[str, str]]]:
    """Items in groups of about shard_words words; a group is what one automaton holds. One sorted stream through the driver, which holds a group at a time."""
    pieces = _pieces(benchmark, item_col, text_col, window, max(window, min(PIECE_WORDS, shard_words)))
    n = -(-(pieces.agg(F.sum("n")).first()[0] or 0) // shard_words) or 1
    rows = pieces.select(F.pmod(F.xxhash64("i", "at"), F.lit(n)).alias("k"), "i", "t").sort("k", "i", "t").toLocalIterator()
    return ([(r["i"], r["t"]) for r in group] for _, group in groupby(rows, key=lambda r: r["k"]))


def _opened(shared: Broadcast) -> ItemAutomaton:
    """The value of a broadcast, read from its file for this use only, so that a task that walks many holds one."""
    path = getattr(shared, "_path", None)
    return shared.load_from_path(path) if path is not None else shared.value


def _grouped(batches: Iterator[pa.RecordBatch], text_col: str, limit: int) -> Iterator[list[pa.RecordBatch]]:
    group, size = [], 0
    for batch in batches:
        group.append(batch)
        size += column_of(batch, text_col).nbytes
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs with n_words, hit_words and hit_chars (ranges, end exclusive) and hit_items (sorted).

    One pass over docs in one Python stage, whatever the size of the benchmark; no
    shuffle. Each group of about GROUP_BYTES of texts meets one automaton after the
    other. Automata of shard_words words (at most about twice as many states) are
    broadcast one by one; with several, a task reads each from its file when its turn comes.
    """
    spark = docs.sparkSession
    names = {f.name for f in _OUT}
    kept = [f for f in docs.schema.fields if f.name not in names]
    shards = [spark.sparkContext.broadcast(ItemAutomaton(items, window)) for items in _shards(benchmark, item_col, item_text_col, window, shard_words)]
    shards = shards or [spark.sparkContext.broadcast(ItemAutomaton([], window))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several = len(shards) > 1
        for group in _grouped(small_batches(batches), text_col, GROUP_BYTES if several else 0):
            texts = [t for batch in group for t in column_of(batch, text_col).to_pylist()]
            rows = None
            for shared in shards:
                found = (_opened(shared) if several else shared.value).scan(texts)
                if rows is None:
                    rows = list(found)
                else:
                    rows = [(n, [*w, *w2], [*i, *i2], [*c, *c2]) if w2 else (n, w, i, c) for (n, w, i, c), (_, w2, i2, c2) in zip(rows, found, strict=True)]
            if several:
                rows = [(n, merged(w), sorted(set(i)), merged(c)) for n, w, i, c in rows]
            at = 0
            for batch in group:
                part, at = rows[at : at + batch.num_rows], at + batch.num_rows
                as_dicts = lambda xs: [[{"start": a, "end": b} for a, b in x] for x in xs]
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                cols = {f.name: batch.column(batch.schema.get_field_index(f.name)) for f in kept}
                cols |= {"n_words": pa.array([r[0] for r in part], pa.int64()), "hit_words": pa.array(as_dicts(r[1] for r in part), span)}
                cols |= {"hit_chars": pa.array(as_dicts(r[3] for r in part), span), "hit_items": pa.array([r[2] for r in part], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.drop(*(c for c in docs.columns if c in names)).mapInArrow(scan, T.StructType([*kept, *_OUT]))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted union of ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def n_hit() -> F.Column:
    return F.aggregate("hit_words", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = 10, max_coverage: float = 0.5, max_span: int | None = None, **options) -> DataFrame:
    """docs without contamination; the columns stay.

    Hit ranges are cut out of the text. A document goes altogether where more than
    max_coverage of its words are hit, or one range has more than max_span words.
    """
    text = f"__row.{text_col}"
    found = find_contamination(docs.select(F.struct(*docs.columns).alias("__row")), benchmark, text_col=text, window=window, **options)
    bad = n_hit() > F.lit(max_coverage) * F.col("n_words")
    if max_span is not None:
        bad = bad | F.exists("hit_words", lambda x: x["end"] - x["start"] > max_span)
    size = F.length(text)
    edges = F.concat(F.array(F.lit(0).cast("long")), F.transform("hit_chars", lambda x: x["end"]))
    stops = F.concat(F.transform("hit_chars", lambda x: x["start"]), F.array(size.cast("long")))
    parts = F.zip_with(edges, stops, lambda a, b: F.substring(F.col(text), (a + 1).cast("int"), (b - a).cast("int")))
    cut = F.when(F.size("hit_chars") > 0, F.array_join(parts, "")).otherwise(F.col(text))
    return found.filter(~bad).withColumn("__cut", cut).select(*[F.col("__cut").alias(c) if c == text_col else F.col(f"__row.`{c}`") for c in docs.columns])
