"""Byte-level BPE by a finite-state transducer that is determinised as texts need it.

A token may end the encoding of a prefix only where the token before it and it
stay two tokens when merged alone; of all tokens that end at a place exactly one
fits. The transducer therefore keeps, for each open beginning of a token, the
place in the trie of tokens and the token before it. A set of open beginnings is
one state; it is made when a text first needs it, and its steps are kept in a
table. A step names the token that would end here. Tokens leave when no older
beginning is open: after a lookahead of a few tokens at most. All new pieces of a
chunk of texts go through the transducer side by side, one byte at a time; where few
pieces are left, as with one very long word, each goes on alone.

Decoding is streamed: bytes of tokens leave as text as soon as the state machine
of UTF-8 has seen whole characters.

Defined results: a null text is encoded as an empty one, without ids. Repeated
rows get the same ids. Extra columns pass through; outputs replace columns.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches
from .numbers import Numbers
from .pieces import TextCoder, chunks, gather

CHUNK_BYTES = 2_000_000
#: Ids that are decoded at once.
PART = 512
#: Where fewer pieces than this are left, each is walked alone.
LANES = 256
#: States that are kept; beyond it the table is begun anew, which changes no result.
STATES = 60_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.size = np.zeros(max(ranks.values(), default=-1) + 1, np.int32)
        self.size[list(self.bytes_of)] = [len(k) for k in self.bytes_of.values()]
        #: The trie: the node that follows node and byte (node << 8 | byte), the token that ends at a node, whether a node has any below.
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for word, rank in ranks.items():
            at = 0
            for c in word:
                nxt = self.child.get(at << 8 | c)
                if nxt is None:
                    nxt = self.child[at << 8 | c] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.inner[at] = True
                at = nxt
            self.token[at] = rank
        self.fits: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self._forget()

    def _forget(self) -> None:
        start = ((0, -1),)
        self.states = [start]
        self.number = {start: 0}
        #: Steps by state and byte: the next state, the token that ends here, whether all before is settled.
        self.steps = Numbers()
        self.to, self.ends, self.settles = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(1024, bool)
        #: The same for pieces that are walked alone.
        self.alone: dict[int, tuple[int, int, bool]] = {}

    def merge(self, text: bytes, until: int = 1) -> list[bytes]:
        """Merges alone, lowest rank first, down to until parts."""
        parts = [text[i : i + 1] for i in range(len(text))]
        ranks = self.ranks
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _split(self, t: int) -> tuple[int, int] | None:
        """The two tokens that were merged last into t; None for a byte and for tokens that merges never make."""
        if t not in self.halves:
            word = self.bytes_of[t]
            parts = self.merge(word, 2)
            self.halves[t] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[t]

    def _pair(self, a: int, b: int) -> bool:
        """Whether the merges of a's bytes followed by b's leave just a and b.

        Goes back through the merges of both, latest first: a merge across the
        border must not come before those that made the parts beside it.
        """
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > 3 * STATES:
                self.fits.clear()
            got = self.fits[a, b] = self._apart(a, b)
        return got

    def _apart(self, a: int, b: int) -> bool:
        if any(len(self.bytes_of[t]) > 1 and self._split(t) is None for t in (a, b) if t >= 0):
            return False
        if a < 0:
            return True
        ranks, of, bound = self.ranks, self.bytes_of, 1 << 60
        while True:
            r = ranks.get(of[a] + of[b])
            if r is not None and r < bound:
                return False
            left, right = self._split(a) if len(of[a]) > 1 else None, self._split(b) if len(of[b]) > 1 else None
            if left is None and right is None:
                return True
            # of equal ranks the merge further left comes first
            if right is None or (left is not None and a > b):
                bound, a = a, left[1]
            else:
                bound, b = b + 1, right[0]

    def _step(self, number: int, c: int) -> tuple[int, int, bool]:
        nxt, ended = [], -1
        for node, last in self.states[number]:
            to = self.child.get(node << 8 | c)
            if to is not None:
                t = self.token[to]
                if ended < 0 <= t and self._pair(last, t):
                    ended = t
                if self.inner[to]:
                    nxt.append((to, last))
        if ended < 0:
            raise ValueError("these ranks lack a token for a byte")
        nxt.append((0, ended))
        state = tuple(nxt)
        to = self.number.get(state)
        if to is None:
            to = self.number[state] = len(self.states)
            self.states.append(state)
        return to, ended, len(state) == 1

    def _walk(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The numbers of the steps from many states at once; steps that no text has needed yet are made."""
        key = state.astype(np.uint64) << np.uint64(8) | c
        out = self.steps.find(key)
        if (out < 0).any():
            new = np.unique(key[out < 0])
            made = [self._step(k >> 8, k & 255) for k in new.tolist()]
            at = self.steps.add(new)
            if len(self.steps) > len(self.to):
                size = max(len(self.steps), 2 * len(self.to))
                self.to, self.ends, self.settles = (np.resize(x, size) for x in (self.to, self.ends, self.settles))
            self.to[at], self.ends[at], self.settles[at] = zip(*made, strict=True)
            out = self.steps.find(key)
        return out

    def _go_alone(self, state: tuple, data: bytes) -> tuple[list[int], list[bool]]:
        """The tokens that end at each byte of one piece from a state on, and where all before is settled."""
        number, ended, settled = self._known(state), [], []
        for c in data:
            key = number << 8 | c
            step = self.alone.get(key)
            if step is None:
                if len(self.states) > 2 * STATES or len(self.alone) > 3 * STATES:
                    state = self.states[number]
                    self._forget()
                    number = self._known(state)
                    key = number << 8 | c
                step = self.alone[key] = self._step(number, c)
            number, end, over = step
            ended.append(end)
            settled.append(over)
        return ended, settled

    def _known(self, state: tuple) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
        return self.number[state]

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one piece after the other, and how many each has. All pieces are walked side by side."""
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        rest = np.flatnonzero(whole < 0)
        ids, sizes = self._ids([pieces[i] for i in rest.tolist()])
        count = np.ones(len(pieces), np.int64)
        count[rest] = sizes
        out = np.repeat(whole, count)
        out[out < 0] = ids
        return out, count

    def _ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.states) > STATES:
            self._forget()
        data = np.frombuffer(b"".join(pieces), np.uint8)
        long = np.array([len(p) for p in pieces], np.int64)
        begin = np.cumsum(long) - long
        order = np.argsort(-long, kind="stable")
        first, by_size = begin[order], -long[order]
        state = np.zeros(len(pieces), np.int32)
        ended, border = np.full(len(data), -1, np.int32), np.zeros(len(data), bool)
        t, m = 0, int(np.searchsorted(by_size, 0))
        while m > LANES:
            at = first[:m] + t
            step = self._walk(state[:m], data[at])
            ended[at], border[at], state[:m] = self.ends[step], self.settles[step], self.to[step]
            t += 1
            m = int(np.searchsorted(by_size, -t))  # pieces of more than t bytes
        states = [self.states[k] for k in state[:m].tolist()]
        for open_, a, b in zip(states, (first[:m] + t).tolist(), (first - by_size)[:m].tolist(), strict=True):
            ended[a:b], border[a:b] = self._go_alone(open_, data[a:b].tobytes())
        # tokens leave where no older beginning is open, and at the end of a piece: back from there to the place that was settled before
        border[(begin + long - 1)[long > 0]] = True
        at = np.flatnonzero(border)
        until = np.append(-1, at[:-1])
        last = np.zeros(len(data), bool)
        while len(at):
            last[at] = True
            at = at - self.size[ended[at]]
            on = at > until
            at, until = at[on], until[on]
        total = np.concatenate([[0], np.cumsum(last)])
        return ended[last], total[begin + long] - total[begin]


class Encoder:
    """Texts to ids, as the pattern and the ranks say."""

    def __init__(self, path: str):
        self.path = path
        self._ready = False

    def __getstate__(self):
        return {"path": self.path, "_ready": False}

    def _prepare(self) -> None:
        self.transducer = Transducer(read_ranks(self.path))
        width = np.dtype("<u2") if len(self.transducer.size) <= 1 << 16 else np.dtype("<u4")

        def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids, sizes = self.transducer.encode([p.encode() for p in pieces])
            return ids.astype(width), sizes

        self.coder = TextCoder(encode)
        self._ready = True

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each chunk of texts their ids, one text after the other, and where each is over."""
        if not self._ready:
            self._prepare()
        for _, part in chunks(texts, CHUNK_BYTES):
            ids, ends = self.coder.encode(part)
            yield ids.astype("<u4"), ends


class Decoder:
    """Ids to bytes, and to text by a state machine over the bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            tokens[v] = k
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int32)
        self.at = np.cumsum(self.size, dtype=np.int32) - self.size

    def to_bytes(self, ids: np.ndarray) -> bytes:
        return gather(self.data, self.at[ids], self.size[ids]).tobytes()

    def stream(self, parts: Iterable[np.ndarray]) -> Iterator[str]:
        """Text of each part of a stream of ids; an unfinished character waits for the next part."""
        machine = Utf8Machine()
        for ids in parts:
            yield machine.feed(self.to_bytes(ids))
        yield machine.finish()

    def text(self, ids: np.ndarray, part: int) -> str:
        return "".join(self.stream(ids[i : i + part] for i in range(0, len(ids), part)))


#: Added to a state that is entered over a character that was cut short.
WRONG = 16


def _utf8_table() -> np.ndarray:
    """The next state by state and byte.

    State 0 is between characters, 1 to 3 wait for so many bytes of any kind of
    continuation; 4 to 7 follow the first bytes E0, ED, F0 and F4, which narrow the
    second byte; 8 is a wrong byte. A first byte that comes too early begins anew:
    WRONG is added to its state.
    """
    first = np.full(256, 8, np.uint8)
    first[:0x80] = 0
    first[0xC2:0xE0], first[0xE0:0xF0], first[0xF0:0xF5] = 1, 2, 3
    first[[0xE0, 0xED, 0xF0, 0xF4]] = 4, 5, 6, 7
    out = np.tile(first, (9, 1))
    out[1:8] += WRONG  # the character before it is cut short
    for state, low, high, to in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        out[state, low : high + 1] = to
    return out


class Utf8Machine:
    """Incremental UTF-8 by a table of states and bytes; it carries its state and the bytes of an open character from part to part.

    States hang on the three bytes before at most, so those of all bytes of a part
    are found at once: first bytes fix theirs, then bytes of continuation take one
    step of the table at a time from the byte before. Wrong bytes become U+FFFD, one
    for each longest beginning of a character.
    """

    TABLE = _utf8_table()

    def __init__(self) -> None:
        self.state, self.rest = 0, b""

    def states(self, data: np.ndarray) -> np.ndarray:
        """The state after each byte (WRONG added where a character is cut short)."""
        tail = (data & 0xC0) == 0x80
        before = np.zeros(len(data), np.uint8)
        before[0] = self.state
        out = self.TABLE[0][data]
        at = np.flatnonzero(tail)
        for _ in range(3):
            before[1:] = out[:-1] & (WRONG - 1)
            out[at] = self.TABLE[before[at], data[at]]
        before[1:] = out[:-1] & (WRONG - 1)
        return self.TABLE[before, data]

    def feed(self, data: bytes) -> str:
        if not data:
            return ""
        if self.state == 0 and data.isascii():
            return data.decode("ascii")
        states = self.states(np.frombuffer(data, np.uint8))
        last = int(states[-1]) & (WRONG - 1)
        self.state = 0 if last == 8 else last
        data = self.rest + data
        states = np.append(np.full(len(self.rest), 1, np.uint8), states)
        wrong = bool((states >= 8).any())
        n = len(data)
        if self.state:  # the open character began at its last first byte
            n = max(i for i in range(max(0, n - 3), n) if data[i] >= 0xC0)
        self.rest = data[n:]
        return data[:n].decode("utf-8", "replace" if wrong else "strict")

    def finish(self) -> str:
        out, self.state, self.rest = "\ufffd" if self.rest else "", 0, b""
        return out


def encode_texts(docs: DataFrame, path: str, *, text_col: str = "text", digests: bool = False) -> DataFrame:
    """docs with token_ids (array of int) and n_tokens; with digests, instead of the ids, ids_sha256 and decoded_sha256 of a streamed decoding. Row by row, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(path))
    own = [T.StructField("n_tokens", T.LongType())]
    own += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digests else [T.StructField("token_ids", T.ArrayType(T.IntegerType()))]
    kept = [f for f in docs.schema.fields if f.name not in {x.name for x in own}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = shared.value, None
        for batch in small_batches(batches, 10_000):
            at = 0
            for ids, ends in encoder.encode(batch.column(batch.schema.get_field_index(text_col))):
                part = batch.slice(at, len(ends))
                at += len(ends)
                begins = np.concatenate([[0], ends[:-1]])
                cols = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                cols.append(pa.array(ends - begins, pa.int64()))
                if digests:
                    decoder = decoder or Decoder(encoder.transducer.ranks)
                    each = [ids[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                    cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in each], pa.string()))
                    cols.append(pa.array([hashlib.sha256(decoder.text(x, PART).encode()).hexdigest() for x in each], pa.string()))
                else:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.view(np.int32), pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[*(f.name for f in kept), *(f.name for f in own)])

    return docs.mapInArrow(run, T.StructType([*kept, *own]))


def decode_ids(df: DataFrame, path: str, *, ids_col: str = "token_ids", out_col: str = "text", part: int = PART) -> DataFrame:
    """df with the text of its ids, decoded as a stream in parts; a null array gives null."""
    shared = df.sparkSession.sparkContext.broadcast(path)
    kept = [f for f in df.schema.fields if f.name != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(read_ranks(shared.value))
        for batch in small_batches(batches, 10_000):
            column = batch.column(batch.schema.get_field_index(ids_col))
            texts = [decoder.text(x.values.to_numpy(), part) if x.is_valid else None for x in column]
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())], names=[*(f.name for f in kept), out_col])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out_col, T.StringType())]))
