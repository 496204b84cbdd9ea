"""Stacks in kernels against plain versions of one image, and what configurations share."""

from itertools import product

import numpy as np
import pytest

from tessera.functions import kernels
from tessera.operators.scores import _NAMES

SHAPES = [(20, 8, 8, 3), (3, 9, 11, 1), (2, 40, 33, 1), (1, 5, 4, 3)]


def stacks(shape):
    r = np.random.default_rng(3)
    return [r.random(shape), np.round(r.random(shape) * 4) / 4, np.full(shape, 0.5)]


def plain_equalised(plane, tiles=8):
    """By a table of 256 levels for each tile."""
    h, w = plane.shape
    ph, pw = -h % tiles, -w % tiles
    padded = np.pad(plane, ((0, ph), (0, pw)), mode="reflect" if min(h, w) > max(ph, pw) else "edge")
    th, tw = padded.shape[0] // tiles, padded.shape[1] // tiles
    table = np.zeros((tiles, tiles, 256))
    for y, x in product(range(tiles), range(tiles)):
        hist = np.bincount(padded[y * th : (y + 1) * th, x * tw : (x + 1) * tw].ravel(), minlength=256)
        limit = max(int(2 * th * tw / 256), 1)
        excess = int(np.maximum(hist - limit, 0).sum())
        hist = np.minimum(hist, limit) + excess // 256
        if excess % 256:
            hist[:: max(256 // (excess % 256), 1)][: excess % 256] += 1
        table[y, x] = np.clip(np.round(np.cumsum(hist) * 255 / (th * tw)), 0, 255)
    out = np.empty((h, w), np.uint8)
    for y, x in product(range(h), range(w)):
        fy, fx = y / th - 0.5, x / tw - 0.5
        ends = lambda f: [min(max(int(np.floor(f)) + i, 0), tiles - 1) for i in (0, 1)]
        (y0, y1), (x0, x1), v, dy, dx = ends(fy), ends(fx), plane[y, x], fy - np.floor(fy), fx - np.floor(fx)
        rows = [table[k, x0, v] * (1 - dx) + table[k, x1, v] * dx for k in (y0, y1)]
        out[y, x] = np.round(rows[0] * (1 - dy) + rows[1] * dy)
    return out


@pytest.mark.parametrize("shape", SHAPES)
def test_stacks_are_their_images(shape):
    for x, y in product(stacks(shape), stacks(shape)[1:]):
        planes = (x[..., 0] * 255).astype(np.uint8)
        assert np.array_equal(kernels.equalise_tiles(planes), [plain_equalised(p) for p in planes])
        found = kernels.match_histogram(x, y)
        for i, c in product(range(shape[0]), range(shape[-1])):
            _, of, n = np.unique(x[i, ..., c], return_inverse=True, return_counts=True)
            values, m = np.unique(y[i, ..., c], return_counts=True)
            assert np.array_equal(found[i, ..., c].ravel(), np.interp(np.cumsum(n) / n.sum(), np.cumsum(m) / m.sum(), values)[of].ravel())
        x = x.copy()
        x[0, 2, 2, 0] = np.nan
        padded = np.pad(x, ((0, 0), (2, 2), (2, 2), (0, 0)), mode="edge")
        moved = [padded[:, i : i + shape[1], j : j + shape[2]] for i in range(5) for j in range(5)]
        assert np.array_equal(kernels.median_smooth(x), np.sort(moved, axis=0)[12], equal_nan=True)


def test_steps_that_configurations_share_are_done_once(monkeypatch):
    done = dict.fromkeys(("hematoxylin", "match_histogram", "clahe", "median_smooth"), 0)

    def counted(name, f):
        def run(*stacks):
            done[name] += 1
            return f(*stacks)

        return run

    for name in done:
        monkeypatch.setattr(kernels, name, counted(name, getattr(kernels, name)))
    x, y = np.random.default_rng(0).random((2, 4, 8, 8, 3))
    configs = [dict(zip(_NAMES, v, strict=True)) for v in product((False, True), ("gray", "hed"), *[(False, True)] * 4)]
    found = list(kernels.preprocessed(x, y, configs))
    # Of 8 beginnings: a histogram, three states of both sides with CLAHE, six with a median; each set anew takes 32, 64 and 64.
    assert done == {"hematoxylin": 8, "match_histogram": 8, "clahe": 24, "median_smooth": 48}
    for config, pair in zip(configs, found, strict=True):
        assert all(np.array_equal(a, b) for a, b in zip(pair, kernels.preprocess(x, y, config), strict=True))


def test_kernels_score_what_they_have_anyway(spark):
    from tessera.operators.registry import Registry
    from tessera.operators.scores import score_pairs

    pairs = spark.createDataFrame([(0, 8, 8, 1, [i / 64 for i in range(64)], [(i * 7 % 64) / 64 for i in range(64)])], "sample_idx long, height int, width int, channels int, src array<double>, trg array<double>")
    plan = score_pairs(pairs, Registry().chosen(["ncc", "psnr", "mi"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan
