"""Words of a batch of texts as numpy arrays.

A word is a maximal run of characters outside space and U+0009..U+000D.  In UTF-8 these six characters are single
bytes that occur in no other character, so the words of a whole batch are found on its bytes, without a Python object
for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
#: Bytes of which several 8-byte numbers each are held at once.
PIECE = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the result (splitmix64's finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse, for each place of a piece."""
    out = []
    for base in (_ODD, _INVERSE):
        x = np.full(PIECE + 1, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


class Words:
    """The words of several texts.

    data: bytes of all texts, each followed by a line feed; text_end: the end of each text in them; start, end: of
    each word; doc: the text of each word; first: the first word of each text (one entry more than texts).
    """

    def __init__(self, texts: list[str | None], lower: bool = False):
        raw = "\n".join("" if t is None else t for t in texts).encode("utf-8", "surrogatepass") if texts else b""
        self.data = np.frombuffer(raw + b"\n", np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        sizes = np.fromiter((0 if t is None else len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
        self.text_end = np.cumsum(sizes + 1) - 1
        self.text_start = self.text_end - sizes
        word = ~_SPACE[self.data]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if len(word) and word[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.word = word
        self.n_texts = len(texts)
        self.first = np.searchsorted(self.start, np.concatenate([self.text_start, [len(self.data)]]))
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial in its bytes, mixed with its length."""
        return self.span_hashes(self.start, self.end)

    def span_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes from each start to its end; spans are in order, not empty, and apart.

        The bytes are taken piece by piece, and a span that lies in several pieces is summed up from them.
        """
        up, down = _powers()
        h, total = np.zeros(len(start), np.uint64), np.zeros(PIECE + 1, np.uint64)
        for at in range(0, len(self.data), PIECE):
            piece = self.data[at : at + PIECE]
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=total[1 : len(piece) + 1])
            i, j = np.searchsorted(end, at, side="right"), np.searchsorted(start, at + len(piece))
            begin = np.maximum(start[i:j] - at, 0)
            found = (total[np.minimum(end[i:j] - at, len(piece))] - total[begin]) * down[begin]
            if i < j and start[i] < at:
                found[:1] *= np.uint64(pow(int(_ODD), int(at - start[i]), 1 << 64))
            h[i:j] += found
        return mixed(h ^ ((end - start).astype(np.uint64) * _ODD))

    def per_text(self, of_bytes: np.ndarray) -> np.ndarray:
        """The number of bytes of each text for which of_bytes is true."""
        if not self.n_texts:
            return np.zeros(0, np.int64)
        return np.add.reduceat(of_bytes, self.text_start, dtype=np.int64) - of_bytes[self.text_end]

    def some_byte(self, of_bytes: np.ndarray) -> np.ndarray:
        """Whether each word has a byte for which of_bytes is true."""
        return np.logical_or.reduceat(of_bytes, np.column_stack([self.start, self.end]).ravel())[::2] if len(self.start) else np.zeros(0, bool)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each line (cut at line feeds) that has a word."""
        end = np.flatnonzero(self.data == 10)
        start = np.concatenate([[0], end[:-1] + 1])
        some = np.searchsorted(self.start, end) > np.searchsorted(self.start, start)
        start, end = start[some], end[some]
        return start, end, np.searchsorted(self.text_end, start)

    def bytes_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the given words one after the other, and which of them each byte is of."""
        size = self.end[words] - self.start[words]
        of = np.repeat(np.arange(len(words)), size)
        at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[words], size)
        return self.data[at], of

    def windows(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each run of k words within one text."""
        h = self.hashes() if hashes is None else hashes
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return run_hash(h, at, k), at


def run_hash(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of h[i], ..., h[i + k - 1] for each i of at."""
    out = h[at].copy()
    for j in range(1, k):
        out = mixed(out * _ODD + h[at + j])
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """For each key: 0 if it occurs once, 1 if it is the first of several, 2 if a later one."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    out = np.zeros(len(k), np.int8)
    out[order] = np.where(same[:-1], 2, np.where(same[1:], 1, 0))
    return out


def chunks(values: pa.Array, most_bytes: int = 500_000) -> Iterator[tuple[int, list[str | None]]]:
    """Texts in runs of a bounded number of bytes (at least one text each), with the place of the first.

    Only the texts of one run are Python strings at a time.
    """
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    begin = 0
    while begin < len(sizes):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + most_bytes, side="right")))
        yield begin, values.slice(begin, end - begin).to_pylist()
        begin = end
