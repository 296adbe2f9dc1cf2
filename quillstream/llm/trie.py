"""A bigram trie in Elias-Fano coded levels, laid out in one buffer that can be mapped from a file.

Levels: the contexts (sorted 64-bit hashes), monotone pointers to their successors, the dictionary of successors (sorted
48-bit hashes), and the successors themselves. Those of one context rise by their place in the dictionary; the last value of
the context before is added to them, so the whole level rises and stays dense. A query finds its context, reads the
range of its successors from two pointers and the value that the range starts from, and searches its word, relative to that, within the range. Smoothed log probabilities and
back-off weights are two bytes each, with a codebook; exact context counts are the steps of a coded running sum.
"""

from __future__ import annotations

import json

import numpy as np

W48 = np.uint64((1 << 48) - 1)
#: Entries that are coded or looked up at a time, so that temporary arrays stay small.
SLICE = 1 << 16
#: Place of the k-th set bit of a byte.
_IN_BYTE = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _at = [i for i in range(8) if _b >> i & 1]
    _IN_BYTE[_b, : len(_at)] = _at


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit; before: set bits ahead of each word, and the total."""
    w = np.searchsorted(before, k, side="right") - 1
    rest = k - before[w]
    byte = words[w].astype("<u8").view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(np.bitwise_count(byte), 1, dtype=np.int64)
    b = (upto <= rest[:, None]).sum(1)
    rows = np.arange(len(w))
    rest = rest - np.where(b > 0, upto[rows, np.maximum(b - 1, 0)], 0)
    return w * 64 + b * 8 + _IN_BYTE[byte[rows, b], rest]


class EliasFano:
    """A rising sequence of 64-bit words, in about 2 + log2(universe / n) bits each."""

    FIELDS = ("low", "high")

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones
        self.mask = np.uint64((1 << bits) - 1)

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, ((top + 1) // max(1, n)).bit_length() - 1)
        words = np.zeros(-(-((top >> bits) + n + 2) // 64), np.uint64)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        for first in range(0, n, SLICE):
            part = v[first : first + SLICE]
            place = np.arange(first, first + len(part), dtype=np.int64)
            high = (part >> np.uint64(bits)).astype(np.int64) + place if bits < 64 else place
            np.bitwise_or.at(words, high >> 6, np.uint64(1) << (high & 63).astype(np.uint64))
            if bits:
                part = part & np.uint64((1 << bits) - 1)
                w, s = place * bits >> 6, (place * bits & 63).astype(np.uint64)
                np.bitwise_or.at(low, w, part << s)
                over = s.astype(np.int64) + bits > 64
                np.bitwise_or.at(low, w[over] + 1, part[over] >> (np.uint64(64) - s[over]))
        return cls(n, bits, low, words)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.bits
        w, s = at >> 6, (at & 63).astype(np.uint64)
        up = np.where(s > 0, self.low[w + 1] << (np.uint64(64) - np.maximum(s, np.uint64(1))), np.uint64(0))
        return (self.low[w] >> s | up) & self.mask

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if len(i) > SLICE:
            return np.concatenate([self[i[k : k + SLICE]] for k in range(0, len(i), SLICE)])
        return (_select(self.high, self.ones, i) - i).astype(np.uint64) << np.uint64(self.bits) | self._low(i)

    def index(self, v: np.ndarray, first: np.ndarray | None = None, behind: np.ndarray | None = None) -> np.ndarray:
        """Place of each value, or -1; with first and behind, only within that range of places. The zeros of the high
        bits bound a bucket, whose low bits are searched."""
        cut = lambda x, i: None if x is None else x[i : i + SLICE]
        if len(v) <= SLICE:
            return self._index(v, first, behind)
        return np.concatenate([self._index(v[i : i + SLICE], cut(first, i), cut(behind, i)) for i in range(0, len(v), SLICE)])

    def _index(self, v: np.ndarray, first: np.ndarray | None, behind: np.ndarray | None) -> np.ndarray:
        out = np.full(len(v), -1, np.int64)
        if not self.n or not len(v):
            return out
        v = v.astype(np.uint64)
        hi = (v >> np.uint64(self.bits)).astype(np.int64)
        ok = hi < self.zeros[-1]
        hi = np.where(ok, hi, 0)
        not_high = ~self.high
        end = _select(not_high, self.zeros, hi) - hi
        start = np.where(hi > 0, _select(not_high, self.zeros, np.maximum(hi - 1, 0)) - np.maximum(hi - 1, 0), 0)
        end = np.minimum(end, self.n)
        if first is not None:
            start, end = np.maximum(start, first), np.minimum(end, behind)
        low = v & self.mask
        live = np.flatnonzero(ok & (start < end))
        while len(live):
            mid = (start[live] + end[live]) // 2
            got = self._low(mid)
            out[live[got == low[live]]] = mid[got == low[live]]
            less = got < low[live]
            start[live] = np.where(less, mid + 1, start[live])
            end[live] = np.where(less, end[live], mid)
            live = live[(out[live] < 0) & (start[live] < end[live])]
        return out


def quantise(x: np.ndarray, bins: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Codes of two bytes and their codebook: exact up to ``bins`` distinct values, else the means of equal steps, so that
    no value is off by more than a step."""
    book = np.unique(x)
    if len(book) > bins:
        step = np.minimum(((x - book[0]) * (bins / (book[-1] - book[0]))).astype(np.int64), bins - 1)
        used, code, often = np.unique(step, return_inverse=True, return_counts=True)
        return code.astype(np.uint16), np.bincount(code, x, minlength=len(used)) / often
    return np.searchsorted(book, x).astype(np.uint16), book.astype(np.float64)


class Trie:
    LEVELS = ("contexts", "pointers", "words", "successors", "counts")

    def __init__(self, levels: dict[str, EliasFano], codes: dict[str, np.ndarray]):
        self.l, self.c = levels, codes

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, count: np.ndarray, discount: float) -> Trie:
        """context, word, count: distinct bigrams with counts of 1 or more, sorted by context and word."""
        contexts, first = np.unique(context, return_index=True)
        ends = np.append(first[1:], len(context))
        words = np.unique(word)
        place = np.searchsorted(contexts, context)
        total = np.add.reduceat(count, first) if len(first) else np.zeros(0, np.int64)
        kinds = ends - first
        p, p_book = quantise(np.log10((count - discount) / total[place]) if len(context) else np.zeros(0))
        b, b_book = quantise(np.log10(discount * kinds / total) if len(first) else np.zeros(0))
        successors = np.searchsorted(words, word).astype(np.int64)
        last = successors[ends - 1] + 1 if len(first) else np.zeros(0, np.int64)
        successors = (successors + (np.cumsum(last) - last)[place]).astype(np.uint64)
        levels = {
            "contexts": EliasFano.build(contexts),
            "pointers": EliasFano.build(np.append(0, ends) if len(first) else np.zeros(1, np.int64)),
            "words": EliasFano.build(words),
            "successors": EliasFano.build(successors),
            "counts": EliasFano.build(np.append(0, np.cumsum(total))),
        }
        return cls(levels, {"p": p, "p_book": p_book, "b": b, "b_book": b_book})

    def context(self, h: np.ndarray) -> np.ndarray:
        return self.l["contexts"].index(h)

    def count(self, c: np.ndarray) -> np.ndarray:
        """Counts of contexts by place, 0 for place -1."""
        at = np.maximum(c, 0)
        if not self.l["contexts"].n:
            return np.zeros(len(c), np.int64)
        n = (self.l["counts"][at + 1] - self.l["counts"][at]).astype(np.int64)
        return np.where(c >= 0, n, 0)

    def kinds(self, c: np.ndarray) -> np.ndarray:
        at = np.maximum(c, 0)
        if not self.l["contexts"].n:
            return np.zeros(len(c), np.int64)
        n = (self.l["pointers"][at + 1] - self.l["pointers"][at]).astype(np.int64)
        return np.where(c >= 0, n, 0)

    def successor(self, c: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 probability of each bigram (context place, word), NaN where it is not in the trie."""
        out = np.full(len(c), np.nan)
        w = self.l["words"].index(word)
        ask = np.flatnonzero((c >= 0) & (w >= 0))
        if len(ask):
            own = c[ask]
            new = np.concatenate([[True], own[1:] != own[:-1]])  # queries of one context mostly come together
            known, place = own[new], np.cumsum(new) - 1
            first, behind = (self.l["pointers"][known + k].astype(np.int64) for k in (0, 1))
            base = np.where(first > 0, self.l["successors"][np.maximum(first - 1, 0)] + np.uint64(1), np.uint64(0))
            at = self.l["successors"].index(base[place] + w[ask].astype(np.uint64), first[place], behind[place])
            hit = at >= 0
            out[ask[hit]] = self.c["p_book"][self.c["p"][at[hit]]]
        return out

    def backoff(self, c: np.ndarray) -> np.ndarray:
        """log10 weight of the unseen successors of each context; 0 for place -1."""
        if not self.l["contexts"].n:
            return np.zeros(len(c))
        return np.where(c >= 0, self.c["b_book"][self.c["b"][np.maximum(c, 0)]], 0.0)

    def dump(self) -> bytes:
        """One buffer: a header line, then the arrays, each at a multiple of 8."""
        parts = [(f"{k}.{f}", getattr(self.l[k], f)) for k in self.LEVELS for f in EliasFano.FIELDS] + list(self.c.items())
        head = {"levels": {k: [self.l[k].n, self.l[k].bits] for k in self.LEVELS}, "arrays": []}
        at, body = 0, []
        for name, x in parts:
            raw = x.tobytes()
            head["arrays"].append([name, x.dtype.str, len(x), at])
            body.append(raw + b"\0" * (-len(raw) % 8))
            at += len(body[-1])
        line = json.dumps(head).encode()
        line += b" " * (-(len(line) + 1) % 8) + b"\n"
        return line + b"".join(body)

    @classmethod
    def open(cls, buffer) -> Trie:
        """From what dump() made: bytes, or a map of a file. Nothing is copied."""
        view = memoryview(buffer)
        line = next(n for n in range(64, len(view) + 1, 8) if view[n - 1] == 10)
        head = json.loads(bytes(view[:line]))
        got = {name: np.frombuffer(view, np.dtype(kind), n, line + at) for name, kind, n, at in head["arrays"]}
        return cls({k: EliasFano(n, bits, got[f"{k}.low"], got[f"{k}.high"]) for k, (n, bits) in head["levels"].items()}, {k: got[k] for k in ("p", "p_book", "b", "b_book")})
