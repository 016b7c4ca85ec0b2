"""Distinct strings of a table and their similarities, many pairs at a time; the same results as the scalar functions of :mod:`text`.

A string's letters are numbers, and for each letter a word of 64 bits says where it stands, so a step of a comparison is a few
operations on whole columns, of 32 bits where both strings are that short. Strings of more than WIDE letters, or with letters beyond the
LETTERS most frequent, are compared singly.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa

from goldenloom.functions.text import jaro_winkler_of

WIDE, LETTERS = 64, 127
#: Pairs that are compared at a time.
STEP = 1 << 13
#: The lowest n bits, for n from 0 to 64.
LOW = np.array([(1 << n) - 1 for n in range(WIDE + 1)], np.uint64)


def coded(column: pa.Array, form: Callable[[str], str | None]) -> tuple[np.ndarray, list[str]]:
    """Numbers of the values after ``form``, and the distinct ones; -1 for null and empty values, -2 where ``form`` gives None."""
    d = column.dictionary_encode()
    known: dict[str, int] = {}
    number = []
    for v in d.dictionary.to_pylist():
        w = form(v) if v else None
        number.append(-1 if not v else -2 if w is None else known.setdefault(w, len(known)))
    at = np.asarray(d.indices.fill_null(len(number)))
    return np.array([*number, -1], np.int64)[at], list(known)


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Half up by the shortest decimal form, as Spark rounds."""
    scale = 10.0**places
    y = x * scale
    k = np.floor(y + 0.5)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6):
        k[i] = float(Decimal(repr(float(x[i]))).scaleb(places).quantize(Decimal(1), ROUND_HALF_UP))
    return k / scale


class Strings:
    def __init__(self, texts: list[str]):
        self.texts = texts
        self.size = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.bincount(codes)
        most = np.argsort(-seen, kind="stable")[:LETTERS]
        most = most[seen[most] > 0]
        number = np.zeros(len(seen), np.uint8)
        number[most] = np.arange(1, len(most) + 1)
        letter, row = number[codes], np.repeat(np.arange(len(texts)), self.size)
        self.plain = self.size <= WIDE
        self.plain[row[letter == 0]] = False
        wide = int(self.size[self.plain].max()) if self.plain.any() else 0
        self.letters = np.zeros((max(wide, 4), len(texts)), np.uint8)
        place, own = np.arange(len(codes)) - np.repeat(np.cumsum(self.size) - self.size, self.size), self.plain[row]
        self.letters[place[own], row[own]] = letter[own]
        # By letter first: the many strings that one is compared with are looked up in one stretch.
        where = np.zeros((len(most) + 1, len(texts)), np.uint64)
        for k in range(wide):
            own = np.flatnonzero(self.letters[k])
            where[self.letters[k, own], own] |= np.uint64(1 << k)
        self.start = self.letters.astype(np.int64) * len(texts)
        self.where = {np.uint64: where.ravel(), np.uint32: where.astype(np.uint32).ravel()}
        self.singly: dict[tuple[int, int], float] = {}

    def jaro_winkler(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Similarities of the strings with numbers ``a`` to those with numbers ``b``; equal pairs are compared once."""
        if not len(a):
            return np.zeros(0)
        key = a * len(self.texts) + b
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        out = np.empty(len(key))
        out[order] = np.repeat(self._each(*np.divmod(key[first], len(self.texts))), np.diff(first, append=len(key)))
        return out

    def _each(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = (self.size[a] > 0).astype(np.float64)
        ask = np.flatnonzero(a != b)
        out[ask] = 0.0
        ask = ask[(self.size[a[ask]] > 0) & (self.size[b[ask]] > 0)]
        plain = self.plain[a[ask]] & self.plain[b[ask]]
        for k in ask[~plain]:
            key = int(a[k]), int(b[k])
            if key not in self.singly:
                self.singly[key] = jaro_winkler_of(self.texts[key[0]], self.texts[key[1]])
            out[k] = self.singly[key]
        ask = ask[plain]
        short = np.maximum(self.size[a[ask]], self.size[b[ask]]) <= 32
        for kind, own in ((np.uint32, ask[short]), (np.uint64, ask[~short])):
            own = own[np.argsort(self.size[a[own]].astype(np.uint8), kind="stable")]
            for at in range(0, len(own), STEP):
                k = own[at : at + STEP]
                out[k] = self._plain(a[k], b[k], kind)
        return out

    def _plain(self, a: np.ndarray, b: np.ndarray, kind: type) -> np.ndarray:
        la, lb, where, one = self.size[a], self.size[b], self.where[kind], kind(1)
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        window, used = LOW[reach + 1].astype(kind), np.zeros(len(a), kind)
        spots, hits = [], []
        for i in range(int(la.max(initial=0))):
            spots.append(where[self.start[i, a] + b])
            m = spots[i] & window
            m &= ~used
            used |= m & np.negative(m)
            hits.append(m != 0)
            window <<= one
            window |= reach > i
        left, moved = used.copy(), np.zeros(len(a), np.uint8)
        for spot, hit in zip(spots, hits):
            low = left & np.negative(left)
            spot &= low
            moved += hit & (spot == 0)
            left ^= low * hit
        m, t = np.bitwise_count(used).astype(np.float64), moved // 2
        jaro = np.where(m > 0, (m / la + m / lb + (m - t) / np.maximum(m, 1)) / 3, 0.0)
        same, on = np.zeros(len(a)), np.ones(len(a), bool)
        for i in range(4):
            x = self.letters[i, a]
            on &= (x == self.letters[i, b]) & (x > 0)
            same += on
        return np.where(jaro > 0.7, jaro + same * 0.1 * (1 - jaro), jaro)
