"""Additive quantisation of vectors: full-dimensional codebooks of residuals, beam-search encoding, look-up scoring."""

from __future__ import annotations

import numpy as np


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def _centres(x: np.ndarray, k: int, turns: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm; a centre without rows moves to one of the rows."""
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(turns):
        of = _nearest(x, centres)
        n = np.bincount(of, minlength=k)
        order = np.argsort(of, kind="stable")
        some = np.flatnonzero(n)
        centres[some] = np.add.reduceat(x[order], (np.cumsum(n) - n)[some], axis=0) / n[some][:, None]
        centres[n == 0] = x[rng.integers(len(x), size=int((n == 0).sum()))]
    return centres


def train(x: np.ndarray, books: int, size: int, turns: int = 6, seed: int = 1) -> np.ndarray:
    """Codebooks (books, size, dimension) for rows like those of x, each of what the earlier ones leave."""
    rng, rest, out = np.random.default_rng(seed), x.astype(np.float32), []
    for _ in range(books):
        out.append(_centres(rest, min(size, len(rest)), turns, rng))
        rest = rest - out[-1][_nearest(rest, out[-1])]
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = 4, rows: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Codes (len(x), books) and the squared norm of the sum of codewords of each row of x, by beam search."""
    codes, norms = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.float32)
    for at in range(0, len(x), rows):
        part = x[at : at + rows].astype(np.float32)
        n = len(part)
        rest, path = part[:, None, :], np.zeros((n, 1, 0), np.uint8)
        for book in books:
            cost = (rest * rest).sum(axis=2)[:, :, None] - 2 * (rest @ book.T) + (book * book).sum(axis=1)
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            source, word = best // len(book), best % len(book)
            rest = np.take_along_axis(rest, source[:, :, None], axis=1) - book[word]
            path = np.concatenate([np.take_along_axis(path, source[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
        last = (rest * rest).sum(axis=2).argmin(axis=1)
        codes[at : at + n] = path[np.arange(n), last]
        whole = part - rest[np.arange(n), last]
        norms[at : at + n] = (whole * whole).sum(axis=1)
    return codes, norms


def scores(queries: np.ndarray, books: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """(queries, codes): squared distance to each coded vector, less the query's own squared norm."""
    out = np.repeat(norms[None, :], len(queries), axis=0)
    for m, book in enumerate(books):
        out += (-2 * (queries @ book.T))[:, codes[:, m]]
    return out


def smallest(values: np.ndarray, n: int) -> np.ndarray:
    """(rows, n): places of the n smallest of each row, ties to the earlier place, in ascending order."""
    if values.shape[1] <= 8 * n:
        return np.argsort(values, axis=1, kind="stable")[:, :n]
    out = np.zeros((len(values), n), np.int64)
    for row, limit, v in zip(out, np.partition(values, n - 1, axis=1)[:, n - 1], values, strict=True):
        at = np.flatnonzero(v <= limit)
        row[:] = at[np.argsort(v[at], kind="stable")[:n]]
    return out
