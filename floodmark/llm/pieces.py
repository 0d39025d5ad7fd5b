"""Texts as the pieces that byte-level merges never cross, column-wise.

A single blank between two characters that are no white space always begins a
piece, and what stands before it has no part in how the rest is cut. So the texts
of a chunk are split at blanks and each distinct word is cut and encoded once; only
words and pieces that were not seen lately reach the encoder. A text in which a
blank stands before other white space takes the pattern as a whole. The ids of a
text are then gathered by position: no Python object is made for a word's place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .numbers import Numbers

#: White space as the pattern means it (the Unicode property).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_pattern = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
#: A word that is empty or begins with white space: blanks stand beside other white space.
_ODD = "^(?:$|[" + "".join(f"\\x{{{ord(c):x}}}" for c in SPACE) + "])"
CHUNK_BYTES = 4_000_000
#: Bytes of words, and twice those of pieces, that are remembered with their ids; then those that did not come again are forgotten, which changes no result.
CACHE_BYTES = 32_000_000

_MIX = np.random.default_rng(41).integers(1, 2**63, 256, dtype=np.uint64)
_powers = np.ones(1, np.uint64)
Coder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def split_pieces(text: str) -> list[str]:
    return _pattern.findall(text)


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[s : s + n] for each start s and size n, one after the other."""
    sizes = sizes.astype(np.int32, copy=False)
    ends = np.cumsum(sizes, dtype=np.int32)
    at = np.repeat(starts.astype(np.int32, copy=False) - (ends - sizes), sizes)
    at += np.arange(len(at), dtype=np.int32)
    return values[at]


def cut_rows(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about limit; one row is never cut."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield a, b
        a = b


def _hashes(data: np.ndarray, at: np.ndarray, long: np.ndarray) -> np.ndarray:
    """64-bit hashes of strings, by the place of each byte in its string."""
    global _powers
    most = int(long.max(initial=0))
    if len(_powers) < most:
        _powers = np.cumprod(np.append(np.uint64(1), np.full(2 * most, 0x9E3779B97F4A7C15, np.uint64)))
    ends = np.cumsum(long, dtype=np.int64)
    place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - long, long)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_MIX[gather(data, at, long)] * _powers[place], dtype=np.uint64)])
    h = total[ends] - total[ends - long] + long.astype(np.uint64)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of strings without nulls, where each begins, and its size."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8), at[:-1], np.diff(at)


class Known:
    """Ids of strings seen lately, in flat arrays. Strings are found by hash and compared in full."""

    def __init__(self, limit: int):
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.slots = Numbers()
        self.text, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint16)
        self.at, self.long = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.used = np.zeros(0, bool)

    def _shrink(self) -> None:
        """Forgets what was not found again since the last time, half of all at least."""
        keep = np.flatnonzero(self.used)[-(len(self.used) // 2) :]
        keys = self.slots.keys[keep]
        self.slots = Numbers()
        self.slots.add(keys)
        self.text, self.ids = gather(self.text, self.at[keep], self.long[keep]), gather(self.ids, self.starts[keep], self.sizes[keep])
        self.long, self.sizes = self.long[keep], self.sizes[keep]
        self.at, self.starts = (np.cumsum(self.long) - self.long).astype(np.int32), (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        self.used = np.zeros(len(keep), bool)

    def _find(self, key: np.ndarray, data: np.ndarray, at: np.ndarray, long: np.ndarray) -> np.ndarray:
        found = self.slots.find(key)
        some = np.flatnonzero(found >= 0)
        own = found[some]
        same = self.long[own] == long[some]
        some, own = some[same], own[same]
        ends = np.concatenate([[0], np.cumsum(long[some], dtype=np.int64)])
        differ = np.concatenate([[0], np.cumsum(gather(data, at[some], long[some]) != gather(self.text, self.at[own], self.long[own]))])
        same = differ[ends[1:]] == differ[ends[:-1]]
        out = np.full(len(key), -1, np.int64)
        out[some[same]] = own[same]
        return out

    def numbers(self, column: pa.Array, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The numbers of different strings; new ones are encoded first."""
        if self.slots.nbytes + self.text.nbytes + self.ids.nbytes + 16 * len(self.at) > self.limit:
            self._shrink()
        data, at, long = _bytes(column)
        key = _hashes(data, at, long)
        out = self._find(key, data, at, long)
        new = np.flatnonzero(out < 0)
        self.used[out[out >= 0]] = True
        if len(new):
            ids, sizes = encode(column.take(pa.array(new)))
            self.slots.add(key[new])  # of different strings of one hash one is found again
            out[new] = len(self.at) + np.arange(len(new))
            starts = np.cumsum(sizes) - sizes + len(self.ids)
            self.used = np.concatenate([self.used, np.zeros(len(new), bool)])
            self.at = np.concatenate([self.at, (len(self.text) + np.cumsum(long[new]) - long[new]).astype(np.int32)])
            self.long = np.concatenate([self.long, long[new]])
            self.text = np.concatenate([self.text, gather(data, at[new], long[new])])
            self.starts = np.concatenate([self.starts, starts.astype(np.int32)])
            self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])
            self.ids = np.concatenate([self.ids.astype(ids.dtype, copy=False), ids]) if len(self.ids) else ids
        return out


class TextCoder:
    """Ids of whole texts. encode: the ids of pieces, one after the other, and how many each has."""

    def __init__(self, encode: Coder, limit: int = CACHE_BYTES):
        self.encode_new = encode
        self.words, self.pieces = Known(limit), Known(limit // 2)

    def _of_pieces(self, pieces: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of pieces; ends: the place in pieces where each unit is over."""
        column = pa.array(pieces, pa.string()).dictionary_encode()
        at = self.pieces.numbers(column.dictionary, lambda new: self.encode_new(strings(new)))[column.indices.to_numpy()]
        sizes = self.pieces.sizes[at]
        total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        return gather(self.pieces.ids, self.pieces.starts[at], sizes), np.diff(total[np.concatenate([[0], ends])])

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that each stand behind a blank; none is empty or begins with white space."""
        found = split_pieces(" " + " ".join(strings(words)))
        opens = np.flatnonzero([p[0] == " " for p in found])
        return self._of_pieces(found, np.append(opens[1:], len(found)))

    def encode(self, texts: pa.Array, given: dict[int, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (no nulls), one after the other, and the place where each text is over. given: ids of some of the texts, taken as they are."""
        given = given or {}
        if not len(texts):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        split = pc.split_pattern(texts, " ")
        per_text = pc.list_value_length(split).to_numpy().astype(np.int64)
        column = split.flatten().dictionary_encode()
        words, code = column.dictionary, column.indices.to_numpy().astype(np.int64)
        begin = np.cumsum(per_text) - per_text
        owner = np.repeat(np.arange(len(texts)), per_text)
        odd = pc.match_substring_regex(words, _ODD).to_numpy(zero_copy_only=False)[code]
        odd[begin] = False  # nothing stands before the first word
        alone = np.bincount(owner[odd], minlength=len(texts)) > 0
        alone[list(given)] = True
        keep = ~alone[owner]
        # units: words behind blanks, first words, texts as a whole
        n = len(words)
        code[begin] += n
        keep[begin] = True
        whole = np.flatnonzero(alone)
        code[begin[whole]] = 2 * n + np.arange(len(whole))
        code = code[keep]
        used = np.zeros(2 * n + len(whole), bool)
        used[code] = True
        behind, first = np.flatnonzero(used[:n]), np.flatnonzero(used[n : 2 * n])
        at = self.words.numbers(words.take(pa.array(behind)), self._of_words) if len(behind) else np.zeros(0, np.int64)
        rest: list[str] = []
        ends: list[int] = []
        for t in [*strings(words.take(pa.array(first))), *("" if i in given else texts[i].as_py() for i in whole.tolist())]:
            rest += split_pieces(t)
            ends.append(len(rest))
        own, own_sizes = self._of_pieces(rest, np.array(ends, np.int64))
        own_starts = np.cumsum(own_sizes) - own_sizes
        pool = [self.words.ids, own]
        base = len(self.words.ids) + len(own)
        starts, sizes = np.zeros(len(used), np.int64), np.zeros(len(used), np.int64)
        starts[behind], sizes[behind] = self.words.starts[at], self.words.sizes[at]
        others = np.concatenate([n + first, 2 * n + np.arange(len(whole))])
        starts[others], sizes[others] = len(self.words.ids) + own_starts, own_sizes
        for k, i in enumerate(whole.tolist()):
            if i in given:
                starts[2 * n + k], sizes[2 * n + k] = base, len(given[i])
                pool.append(given[i])
                base += len(given[i])
        pool = [x for x in pool if len(x)] or [np.zeros(0, np.uint16)]
        size = sizes[code]
        total = np.concatenate([[0], np.cumsum(size)])
        last = np.cumsum(np.bincount(owner[keep], minlength=len(texts)))
        return gather(np.concatenate(pool), starts[code], size), total[last]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of texts of about limit bytes with their first rows; nulls become empty."""
    texts = pc.fill_null(texts, "")
    for a, b in cut_rows(pc.binary_length(texts).to_numpy().astype(np.int64), limit):
        yield a, texts.slice(a, b - a)


def binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The stretches of values up to each of ends as binary values."""
    offsets = np.concatenate([[0], ends * values.itemsize])
    if offsets[-1] < 2**31 - 1:
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])
    return pa.array([values[a:b].tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)], pa.binary())
