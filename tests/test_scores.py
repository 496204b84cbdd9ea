"""The score table by column expressions, by kernels, and by expressions on preprocessed arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels, pixels
from tessera.operators.registry import BUILT_IN, Measure, Registry, config_grid, grid_of, identities, identity_groups
from tessera.operators.scores import score_pairs

PAIRS = "sample_idx long, height int, width int, channels int, src array<float>, trg array<float>, mask array<int>"
PLAIN = {"normalization": (False, True), "flip_intensity": (False, True), "match_histogram": (False,), "clahe": (False,), "smoothing": (False,)}


@pytest.fixture(scope="module")
def pairs(spark):
    r, rows = np.random.default_rng(0), []
    for i in range(24):
        h, w, c = [(8, 8, 1), (9, 11, 3), (10, 8, 3)][i % 3]
        src, trg = r.random((2, h * w * c)) * (255 if i % 4 == 0 else 1)
        rows.append((i, h, w, c, src.tolist(), (src if i == 5 else trg).tolist(), None if i % 2 else r.integers(0, 2, h * w).tolist()))
    rows.append((99, 8, 8, 1, [0.5] * 64, [0.5] * 64, None))
    return spark.createDataFrame(rows, PAIRS)


def table(df):
    return {tuple(r)[:3]: r["score"] for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys() and a
    for k in a:
        assert (a[k] is None) == (b[k] is None) and (a[k] is None or abs(a[k] - b[k]) < 1e-6), (k, a[k], b[k])


@pytest.mark.parametrize("with_masks", [False, True])
def test_columns_give_what_kernels_give(pairs, with_masks):
    df = pairs if with_masks else pairs.drop("mask")
    both = [m for m in BUILT_IN if m.column is not None]
    columns = [Measure(m.name, None, ("gray", "rgb"), column=m.column) for m in both]
    arrays = [Measure(m.name, m.kernel, ("gray", "rgb"), takes_mask=True) for m in both]
    found = score_pairs(df, columns, PLAIN)
    assert "Python" not in found._jdf.queryExecution().toString() and "InArrow" not in found._jdf.queryExecution().toString()
    same(table(found), table(score_pairs(df, arrays, PLAIN)))


def test_columns_on_preprocessed_arrays(pairs):
    search = PLAIN | {"match_histogram": (False, True), "smoothing": (False, True), "flip_intensity": (True,)}
    columns = [Measure("ncc", None, ("gray", "hed"), column=pixels.ncc), Measure("far", None, ("rgb",), {"p": (1, 2)}, False, column=lambda x, y, p: F.aggregate(F.zip_with(x, y, lambda a, b: F.pow(F.abs(a - b), F.lit(p))), F.lit(0.0), lambda t, v: t + v) / F.size(x))]
    arrays = [Measure("ncc", kernels.ncc, ("gray", "hed"), takes_mask=True), Measure("far", kernels.where_masked(lambda x, y, p: (np.abs(x - y) ** p).reshape(len(x), -1).mean(axis=1)), ("rgb",), {"p": (1, 2)}, False, takes_mask=True)]
    same(table(score_pairs(pairs, columns, search)), table(score_pairs(pairs, arrays, search)))


def test_no_pairs_and_no_measure(pairs):
    assert score_pairs(pairs.limit(0), Registry().chosen(["ncc", "ssim"])).collect() == []
    assert score_pairs(pairs, []).collect() == []
    with pytest.raises(ValueError):
        Registry().register("nothing")


def test_the_grid_of_a_table_is_that_of_measures(spark):
    measures = Registry().chosen()
    flags = ["metric", "cfg_ordinal", "normalization", "channel_mode", "flip_intensity", "match_histogram", "clahe", "smoothing", "params"]
    key = lambda r: (*r[:8], sorted(r["params"].items()))
    found, wanted = (sorted(map(key, df.select(*flags).collect())) for df in (grid_of(identities(spark, measures)), config_grid(spark, measures)))
    assert found == wanted
    groups = {tuple(r["metrics"]) for r in identity_groups(spark, measures).collect()}
    assert groups == {("ncc", "psnr", "mi", "ms-ssim", "fsim"), ("ssim",), ("fsimc",), ("lpips_alex", "lpips_vgg", "lpips_squeeze"), ("dists",)}


def test_the_default_search_gives_the_scores_of_what_it_chose(spark):
    from tessera import catalogue
    from tessera.operators.scores import _NAMES
    from tessera.plans.fixtures import colour_search_pairs

    oof, meta, samples = catalogue._colour_cv(spark, "/root/testdata/sf0.001")
    chosen = {(r["fold"], r["metric"]): r for r in meta.collect()}
    found = {(r["metric"], r["sample_idx"]): r for r in oof.collect()}
    n = samples.count()
    assert len(found) == 4 * n and set(chosen) == {(f, m) for f in range(5) for m in ("ncc", "psnr", "mi", "ssim")}
    own = Registry()
    for p in colour_search_pairs(spark, "/root/testdata/sf0.001").where("sample_idx % 97 = 3").collect():
        src, trg = (np.array(p[c]).reshape(1, 8, 8, 3) for c in ("src", "trg"))
        for metric in ("ncc", "psnr", "mi", "ssim"):
            r = found[metric, p["sample_idx"]]
            c = chosen[r["fold"], metric]
            a, b = kernels.preprocess(src, trg, {f: c[f] for f in _NAMES})
            value = own[metric](a, b, **{k: int(v) for k, v in c["params"].items()})[0]
            assert r["cfg_ordinal"] == c["cfg_ordinal"] and abs(r["similarity_score"] - value) < 1e-6
