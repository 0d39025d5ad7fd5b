"""Counts of values in stretches of a sequence, many at a time."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np


class RangeCounts:
    """How many codes of a stretch are below a bound, for many stretches at once."""

    def __init__(self, codes: np.ndarray) -> None:
        self.bits = max(1, int(codes.max(initial=0)).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in reversed(range(self.bits)):
            one = (codes >> bit) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - one)]))
            codes = np.concatenate([codes[one == 0], codes[one == 1]])

    def below(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """For each i the codes of left[i] .. right[i] - 1 that are less than bound[i]."""
        count = np.zeros(len(bound), np.int64)
        whole, above = right - left, bound >> self.bits > 0
        for zeros, bit in zip(self.zeros, reversed(range(self.bits)), strict=True):
            a, b = zeros[left], zeros[right]
            one = (bound >> bit) & 1 == 1
            count += np.where(one, b - a, 0)
            left, right = np.where(one, zeros[-1] + left - a, a), np.where(one, zeros[-1] + right - b, b)
        return np.where(above, whole, count)


def window_shares(v: np.ndarray, windows: Mapping[str, tuple[int, bool]], least: int) -> dict[str, np.ndarray]:
    """For each place and each window (size, inclusive) the share of its values that do not exceed the place's own; NaN is no value.

    A window holds the size places before, and no value where the place has none; inclusive: the size
    places that end with it, held against the last value among them.
    """
    there = ~np.isnan(v)
    before = np.concatenate([[0], np.cumsum(there)])  # values before each place
    _, codes = np.unique(v[there], return_inverse=True)
    counts, at = RangeCounts(codes), np.arange(len(v))
    out = {}
    for name, (size, inclusive) in windows.items():
        left = before[np.maximum(at - size + inclusive, 0)]
        right = before[at + inclusive]
        n = right - left
        own = right - 1 if inclusive else before[at]
        use = (n >= max(least, 1)) & (True if inclusive else there)
        bound = np.zeros(len(v), np.int64)
        bound[use] = codes[own[use]] + 1
        found = counts.below(left, right, bound)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[name] = np.where(use, found / n, np.nan)
    return out
