"""Filters on pixel rows against the same filters on stacks of arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import filters, kernels

PAIRS = "sample_idx long, height int, width int, channels int, src array<double>, trg array<double>, mask array<int>"


@pytest.fixture(scope="module")
def stacks():
    r = np.random.default_rng(0)
    out = []
    for n, (h, w, c) in enumerate([(8, 8, 1), (13, 21, 1), (40, 35, 3), (9, 64, 2)]):
        src, trg = r.random((h, w, c)), r.random((h, w, c)) ** 2
        out.append((np.round(src, 1) if n % 2 else src, np.round(trg, 1) if n == 1 else trg, r.integers(0, 2, (h, w))))
    return out


@pytest.fixture(scope="module")
def pairs(spark, stacks):
    return spark.createDataFrame([(i, *s.shape, s.ravel().tolist(), t.ravel().tolist(), None if i == 3 else m.ravel().tolist()) for i, (s, t, m) in enumerate(stacks)], PAIRS)


def images(df, value, stacks):
    out = [np.full(s.shape, np.nan) for s, _, _ in stacks]
    for r in df.select("sample_idx", "c", "y", "x", value).collect():
        assert np.isnan(out[r[0]][r[2], r[3], r[1]])
        out[r[0]][r[2], r[3], r[1]] = r[4]
    return out


CASES = {
    "median": (lambda px: filters.median_smoothed(px, ["sample_idx", "c"], ["src"]), kernels.median_smooth),
    "gaussian": (lambda px: filters.gaussian_smoothed(px, ["sample_idx", "c"], ["src"]), kernels.gaussian_smooth),
    "gaussian3": (lambda px: filters.gaussian_smoothed(px, ["sample_idx", "c"], ["src"], 3), lambda x: kernels.gaussian_smooth(x, 3)),
    "clahe": (lambda px: filters.clahe(px, ["sample_idx", "c"], "src"), lambda x: np.concatenate([kernels.clahe(x[..., [c]]) for c in range(x.shape[-1])], axis=-1)),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_filters(pairs, stacks, name):
    rows, plain = CASES[name]
    for found, (src, _, _) in zip(images(rows(filters.pixel_rows(pairs)), "src", stacks), stacks, strict=True):
        np.testing.assert_allclose(found, plain(src[None])[0], atol=1e-9)


def test_matched(pairs, stacks):
    found = images(filters.matched(filters.pixel_rows(pairs), ["sample_idx", "c"]), "src", stacks)
    for f, (src, trg, _) in zip(found, stacks, strict=True):
        np.testing.assert_allclose(f, kernels.match_histogram(src[None], trg[None])[0], atol=1e-9)


@pytest.mark.parametrize("win", [3, 7])
def test_ssim_with_and_without_masks(pairs, stacks, win):
    for mask in (None, "mask"):
        found = dict(filters.ssim(filters.pixel_rows(pairs, mask=mask), ["sample_idx"], win).collect())
        for i, (src, trg, m) in enumerate(stacks):
            own = m[None] if mask and i != 3 else None
            assert abs(found[i] - kernels.ssim(src[None], trg[None], win, own)[0]) < 1e-9


def test_windows_that_exceed_an_image_fail(pairs):
    with pytest.raises(Exception, match="exceeds"):
        filters.ssim(filters.pixel_rows(pairs), ["sample_idx"], 31).collect()
    with pytest.raises(Exception, match="too small"):
        filters.ms_ssim(filters.pixel_rows(pairs), ["sample_idx"]).collect()


def test_ms_ssim_of_odd_sizes(spark):
    r = np.random.default_rng(1)
    src = r.random((1, 163, 177, 1))
    trg = np.clip(src + 0.2 * r.random(src.shape), 0, 1)
    one = spark.createDataFrame([(0, 163, 177, 1, src.ravel().tolist(), trg.ravel().tolist(), None)], PAIRS)
    assert abs(filters.ms_ssim(filters.pixel_rows(one), ["sample_idx"]).first()["score"] - kernels.ms_ssim(src, trg)[0]) < 1e-9


def test_colours(spark):
    rgb = np.random.default_rng(2).random((1, 17, 24, 3))
    rgb[0, :3] = 0
    rows = [(0, 17, 24, y, x, *map(float, rgb[0, y, x])) for y in range(17) for x in range(24)]
    px = spark.createDataFrame(rows, "sample_idx long, height int, width int, y int, x int, r double, g double, b double")
    stain = filters.hematoxylin(px, ["sample_idx"], F.col("r"), F.col("g"), F.col("b"))
    light = filters.clahe_rgb(px, ["sample_idx"], "r", "g", "b")
    assert set(light.columns) == set(px.columns)
    for df, names, plain in ((stain, ["stain"], kernels.hematoxylin(rgb)[0]), (light, ["r", "g", "b"], kernels.clahe(rgb)[0])):
        for row in df.collect():
            np.testing.assert_allclose([row[n] for n in names], plain[row["y"], row["x"]], atol=1e-6)


def test_masks_by_threshold(pairs, stacks):
    px = filters.pixel_rows(pairs).where("c = 0").withColumn("v", F.col("src") * 255)
    for threshold in (None, 100.0):
        for r in filters.below_threshold(px, ["sample_idx"], "v", threshold).collect():
            plain = kernels.non_white(stacks[r["sample_idx"]][0][None, ..., :1] * 255, threshold)[0]
            assert r["mask"] == plain[r["y"], r["x"]]
