"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is parsed
greedily into the longest phrases that occur in that language's text; the
language that needs the fewest phrases for the same letters wins. Texts are
lowered, and whatever is not a letter counts as one blank. Long texts are parsed
in blocks side by side, each as if a phrase began with it; where one did not, the
phrase before it is followed into the block up to the first place at which both
ways of parsing begin a phrase. The phrases are those of one parse of the text.

Defined results: a null text and one without letters are ``und`` with score 0;
ties go to the language that sorts first; where nothing was learnt every text is
``und``. Extra columns pass through, and output names replace columns of that name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, small_batches
from .numbers import Numbers

#: Characters of labelled text for each language, and rows they come from at most.
SAMPLE_CHARS, SAMPLE_ROWS = 30_000, 400
#: The most frequent symbols, whose steps stand in a full table; those of others are looked up by state and symbol.
FREQUENT = 95
BLOCK = 400
CHUNK_CHARS = 1_500_000
_is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, lowered, blanks as 32 and never twice in a row; the text of each. Texts hold no blank at their ends."""
    low = [t.lower() for t in texts]
    code = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])[: len(code)]
    letter = _is_letter[code]
    code = np.where(letter, code, 32)
    same = np.empty(len(code), bool)  # what stands before belongs to the same text and is a letter
    if len(code):
        same[0] = False
        same[1:] = letter[:-1] & (owner[1:] == owner[:-1])
    after = np.append(same[1:], False)
    last = np.zeros(len(code), bool)
    if len(code):  # a blank stays only between letters of one text
        nxt = np.full(len(code), -1)
        at = np.flatnonzero(letter)
        k = np.searchsorted(at, np.arange(len(code)))
        ok = k < len(at)
        nxt[ok] = owner[at[k[ok]]]
        last = nxt == owner
    keep = letter | (same & last)
    del after
    return code[keep], owner[keep]


class Automaton:
    """Suffix automaton of a text over integers, as a table of transitions for the symbols below frequent.

    An entry is the next row times 2; the lowest bit says that a phrase ended
    before this symbol, which then starts the next one. The last row stands for a
    symbol that the text lacks: a phrase of its own. Symbol 0 is lacked by all texts.
    """

    def __init__(self, text: list[int], frequent: int):
        nxt: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
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
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    new = len(length)
                    length.append(length[p] + 1)
                    nxt.append(dict(nxt[q]))
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = new
                        p = link[p]
                    link[q] = link[cur] = new
            last = cur
        table = np.full((len(nxt) + 1, frequent), -1, np.int64)
        rare: dict[int, int] = {}
        for s, d in enumerate(nxt):
            for c, to in d.items():
                if c < frequent:
                    table[s, c] = to
                else:
                    rare[s << 32 | c] = to
        root = np.where(table[0] >= 0, table[0], len(nxt))
        self.frequent, self.lacking = frequent, len(nxt)
        self.table = np.where(table >= 0, table * 2, root[None, :] * 2 + 1).astype(np.int32).ravel()
        self.steps, self.to = Numbers(), np.array([*rare.values(), -1], np.int64)  # -1: no such step
        self.steps.add(np.fromiter(rare, np.uint64, len(rare)))

    def walk(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The entries for states and symbols."""
        out = self.table[state * self.frequent + np.where(symbol < self.frequent, symbol, 0)]
        other = np.flatnonzero(symbol >= self.frequent)
        if len(other):
            c = symbol[other].astype(np.uint64)
            to = self.to[self.steps.find(state[other].astype(np.uint64) << np.uint64(32) | c)]
            start = self.to[self.steps.find(c)]
            out[other] = np.where(to >= 0, to * 2, np.where(start >= 0, start, self.lacking) * 2 + 1)
        return out


class CrossParser:
    """Automata of all languages over one alphabet."""

    def __init__(self, samples: dict[str, str], frequent: int = FREQUENT):
        self.langs = sorted(samples)
        codes = {k: normalised([samples[k]])[0] for k in self.langs}
        counts = sorted(Counter(np.concatenate([*codes.values(), np.zeros(0, np.uint32)]).tolist()).items(), key=lambda x: (-x[1], x[0]))
        self.alphabet = np.array(sorted(c for c, _ in counts), np.uint32)
        #: Numbers of the alphabet's symbols by frequency, from 1 on; 0 is any other.
        rank = {c: i for i, (c, _) in enumerate(counts, 1)}
        self.rank = np.array([rank[c] for c in self.alphabet.tolist()], np.int32)
        self.automata = [Automaton(self.encode(codes[k]).tolist(), min(frequent, len(counts)) + 1) for k in self.langs]

    def encode(self, code: np.ndarray) -> np.ndarray:
        if not len(self.alphabet):
            return np.zeros(len(code), np.int32)
        at = np.minimum(np.searchsorted(self.alphabet, code), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == code, self.rank[at], 0)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and the symbols of each text."""
        code, owner = normalised(texts)
        sym = self.encode(code)
        size = np.bincount(owner, minlength=len(texts))
        begin = np.cumsum(size) - size
        blocks = -(-size // BLOCK)
        lane_of = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(lane_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = begin[lane_of] + nth * BLOCK
        n = np.minimum(size[lane_of] - nth * BLOCK, BLOCK)
        order = np.argsort(-n, kind="stable")
        at, n = at[order], n[order]
        alive = np.searchsorted(-n, -np.arange(BLOCK), side="left")  # lanes with more than t symbols
        place = np.empty(len(order), np.int64)  # of the blocks as they stand in the texts
        place[order] = np.arange(len(order))
        follows = np.where(nth > 0, place[np.arange(len(nth)) - 1], -1)[order]  # the lane of the block before
        out = np.zeros((len(texts), len(self.langs)))
        for k, automaton in enumerate(self.automata):
            begins = np.zeros((BLOCK, len(at)), bool)  # whether a phrase begins at a symbol
            state = np.zeros(len(at), np.int32)
            for t in range(int(n[0]) if len(n) else 0):
                m = int(alive[t])
                v = automaton.walk(state[:m], sym[at[:m] + t])
                begins[t, :m] = v & 1 if t else True
                state[:m] = v >> 1
            self._join(automaton, sym, at, n, follows, begins, state)
            out[:, k] = np.bincount(lane_of[order], weights=begins.sum(axis=0), minlength=len(texts))
        return out, size

    @staticmethod
    def _join(automaton: Automaton, sym: np.ndarray, at: np.ndarray, n: np.ndarray, follows: np.ndarray, begins: np.ndarray, state: np.ndarray) -> None:
        """Follows phrases over the borders of blocks; changes begins and the states at the ends of blocks."""
        after = np.full(len(at) + 1, -1)
        after[follows] = np.arange(len(at))
        after = after[:-1]
        lanes = np.flatnonzero(follows >= 0)
        while len(lanes):
            own, now, t = lanes, state[follows[lanes]], 0
            changed: list[np.ndarray] = []
            while len(own):
                v = automaton.walk(now, sym[at[own] + t])
                both = (v & 1).astype(bool) & begins[t, own]
                begins[t, own] = v & 1
                on = ~both
                own, now, t = own[on], v[on] >> 1, t + 1
                over = n[own] == t
                if over.any():
                    ended = own[over]
                    changed.append(ended[state[ended] != now[over]])
                    state[ended] = now[over]
                    own, now = own[~over], now[~over]
            lanes = after[np.concatenate([*changed, np.zeros(0, np.int64)])]
            lanes = lanes[lanes >= 0]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs: list[str] = []
        scores: list[float] = []
        for a, b in slices(texts, CHUNK_CHARS):
            count, size = self.phrases([t or "" for t in texts[a:b]])
            if not self.langs:
                langs += ["und"] * (b - a)
                scores += [0.0] * (b - a)
                continue
            best = count.argmin(axis=1)
            first = count[np.arange(len(count)), best]
            rest = np.where(np.arange(count.shape[1])[None, :] == best[:, None], np.inf, count).min(axis=1)
            margin = np.where(np.isinf(rest), 1.0, 1 - first / np.maximum(rest, 1))
            langs += [self.langs[k] if s else "und" for k, s in zip(best, size, strict=True)]
            scores += np.where(size > 0, margin, 0.0).tolist()
        return langs, scores


def fit_cross_parser(train: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample_chars: int = SAMPLE_CHARS, sample_rows: int = SAMPLE_ROWS) -> CrossParser:
    """Learns from a bounded sample: for each language sample_rows pieces of texts in the order of their hash, sample_chars characters in all. A piece begins at a hashed place anywhere in its text and has 8 * sample_chars / sample_rows characters, or is the whole of a shorter text."""
    part = -(-sample_chars // sample_rows) * 8
    text = F.col(text_col)
    place = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - part + 1, F.lit(1))).cast("int") + 1
    rows = train.filter(F.col(lang_col).isNotNull() & text.isNotNull()).select(F.col(lang_col).alias("l"), F.substring(text, place, F.lit(part)).alias("t"))
    # the window keeps only sample_rows rows for each task and language before it sorts them together
    w = Window.partitionBy("l").orderBy(F.xxhash64("t"), "t")
    rows = rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= sample_rows).collect()
    samples: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["l"], r["n"])):
        have = samples.get(r["l"], "")
        if len(have) < sample_chars:
            samples[r["l"]] = (have + " " + r["t"])[:sample_chars]
    return CrossParser(samples)


def identify_language(docs: DataFrame, parser: CrossParser, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; row by row, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            langs, scores = shared.value.predict(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*(f.name for f in kept), "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
