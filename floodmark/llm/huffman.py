"""Canonical Huffman coding of token ids with a bound on the length of codes.

The code follows from global counts. Codes of one length are consecutive numbers
in the order of ids, so the lengths alone describe the code. Decoding looks up
the next ``limit`` bits in a table; many stretches of a block are decoded side by
side, from checkpoints that name the bit at which each stretch begins.
"""

from __future__ import annotations

import numpy as np

#: Ids between two checkpoints.
STRETCH = 128


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal lengths of at most limit bits (package-merge); 0 for ids without a count."""
    used = np.flatnonzero(counts > 0)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    leaves: list[np.ndarray] = []
    items = weight
    leaves.append(np.ones(len(weight), bool))
    for _ in range(limit - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        rank = np.argsort(both, kind="stable")
        items = both[rank]
        leaves.append(rank < len(weight))
    lengths = np.zeros(len(weight), np.int64)
    take = 2 * len(weight) - 2
    for is_leaf in reversed(leaves):
        n = int(is_leaf[:take].sum())  # leaves come in the order of weight
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


class Code:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.limit = int(lengths.max()) if len(lengths) else 0
        self.values = np.zeros(len(lengths), np.uint32)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        size = self.lengths[order]
        # the first code of each length is (first of the one before + its number) * 2
        number = np.bincount(size, minlength=self.limit + 1) if len(size) else np.zeros(1, np.int64)
        first = np.zeros(self.limit + 2, np.int64)
        for k in range(1, self.limit + 1):
            first[k] = (first[k - 1] + (number[k - 1] if k > 1 else 0)) << 1
        nth = np.arange(len(size)) - np.concatenate(([0], np.cumsum(number)))[size]
        self.values[order] = first[size] + nth
        self.order, self.size = order, size
        self._table = None

    def __getstate__(self):
        return {**self.__dict__, "_table": None}

    def table(self) -> np.ndarray:
        """For each limit bits: the id whose code they begin with, times 32, and that code's length."""
        if self._table is None:
            width = 1 << (self.limit - self.size)
            both = np.repeat(self.order << 5 | self.size, width)
            self._table = np.append(both, np.ones((1 << self.limit) - len(both), np.int64))
        return self._table

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits of ids, and the bit at which every STRETCH-th of them begins."""
        size = self.lengths[ids]
        if len(size) and not size.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(size)
        begin = ends - size
        if not len(ids):
            return b"", begin
        # a code stands in one 64-bit word or runs over into the next one
        at, room = begin >> 6, 64 - (begin & 63) - size
        value = self.values[ids].astype(np.uint64)
        head = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(at, prepend=-1))
        out = np.zeros(int(at[-1]) + 2, np.uint64)
        out[at[first]] = np.bitwise_or.reduceat(head, first)
        over = np.flatnonzero(room < 0)
        out[at[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)
        return out.astype(">u8").tobytes()[: -(-int(ends[-1]) // 8)], begin[::STRETCH].astype(np.int64)

    def decode(self, bits: bytes, n: int, checkpoints: np.ndarray) -> np.ndarray:
        """The n ids of a block."""
        if not n:
            return np.zeros(0, np.int32)
        table = self.table()
        data = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint64)
        # 40 bits from each byte on
        window = (data[:-4] << np.uint64(32)) | (data[1:-3] << np.uint64(24)) | (data[2:-2] << np.uint64(16)) | (data[3:-1] << np.uint64(8)) | data[4:]
        at = checkpoints.astype(np.int64).copy()
        lanes = len(at)
        out = np.zeros((STRETCH, lanes), np.int64)
        last = n - (lanes - 1) * STRETCH
        shift, mask = 40 - self.limit, (1 << self.limit) - 1
        for t in range(STRETCH):
            m = lanes if t < last else lanes - 1  # only the last stretch may be short
            p = at[:m]
            got = table[(window[p >> 3] >> (shift - (p & 7)).astype(np.uint64)).astype(np.int64) & mask]
            out[t, :m] = got
            at[:m] += got & 31
        return (out.T.ravel()[:n] >> 5).astype(np.int32)
