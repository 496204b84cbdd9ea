import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import catalogue
from tessera.functions import kernels, ranks, scalars
from tessera.operators import bootstrap, folds, nested_cv, registry
from tessera.plans import nested
from tessera.plans.fixtures import order_samples, order_scores, vector_pairs
from tessera.operators.scores import score_pairs
from tessera.sources import annotations
from tessera.sources.annotations import read_annotations, with_ordinal
from tessera.sources.artifact import load_artifact, save_artifact

SF = "/root/testdata/sf0.001"


def evaluated(spark, rows, **more):
    df = spark.createDataFrame(rows, "g string, score double, class3 int, expert_score double, w long")
    return {r["g"]: r for r in ranks.evaluate(df, ["g"], **more).collect()}


def test_statistics_of_edge_groups(spark):
    rows = [("one_class", float(i), 0, float(i), 1) for i in range(4)] + [("constant", 1.0, i % 3, float(i), 1) for i in range(6)]
    rows += [("null", None if i == 0 else float(i), i % 3, 1.0, 1) for i in range(6)] + [("nan", float("nan") if i == 0 else float(i), i % 3, 1.0, 1) for i in range(6)]
    rows += [("single", 1.0, 0, 1.0, 1), ("perfect", 3.0, 0, 5.0, 1), ("perfect", 2.0, 1, 3.0, 1), ("perfect", 1.0, 2, 1.0, 1)]
    out = evaluated(spark, rows)
    assert out["one_class"]["auc_bad_vs_rest"] is None and out["one_class"]["auc_3class_ovo"] is None and out["one_class"]["spearman_class3"] is None
    assert out["constant"]["spearman_class3"] is None and out["constant"]["auc_bad_vs_rest"] == 0.5
    for g in ("null", "nan"):
        assert all(out[g][s] is None for s in ranks.STATISTICS)
    assert out["single"]["spearman_raw_1_5"] is None
    assert [round(out["perfect"][s], 9) for s in ranks.STATISTICS] == [1, 1, 1, 1, 1]


def test_weights_equal_repeated_rows(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(rng.integers(8)), int(rng.integers(3)), float(rng.integers(1, 6)), int(rng.integers(0, 4))) for _ in range(60)]
    weighted = evaluated(spark, rows, weight="w")["a"]
    repeated = evaluated(spark, [r for r in rows for _ in range(r[4])])["a"]
    assert weighted["n"] == repeated["n"]
    assert np.allclose([weighted[s] for s in ranks.STATISTICS], [repeated[s] for s in ranks.STATISTICS], rtol=1e-12)


def test_statistics_in_parts_are_those_of_whole_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(rng.integers(50)) / 7, int(rng.integers(3)), float(rng.integers(1, 6)), int(rng.integers(0, 4))) for g in ("a", "b", None) for _ in range(200)]
    rows += [("constant", 1.0, i % 3, float(i), 1) for i in range(6)] + [("nulls", None, i % 3, 1.0, 1) for i in range(3)] + [("null", None if i == 0 else float(i), i % 3, 1.0, 1) for i in range(6)]
    df = ranks.with_parts(spark.createDataFrame(rows, "g string, score double, class3 int, expert_score double, w long"), ["g"], "score", 3)
    bounds = df.where("g = 'a'").groupBy("part").agg(F.min("score").alias("low"), F.max("score").alias("high")).orderBy("part").collect()
    assert len(bounds) == 8 and all(x["high"] < y["low"] for x, y in zip(bounds, bounds[1:]))
    parts = {r["g"]: r for r in ranks.evaluate(df, ["g"], weight="w", part="part").collect()}
    whole = evaluated(spark, rows, weight="w")
    assert parts.keys() == whole.keys()
    for g, row in whole.items():
        assert [x is None or round(x, 9) for x in row[1:]] == [x is None or round(x, 9) for x in parts[g][1:]]


def test_numbers_in_texts(spark):
    texts = ["0.5", "1e-05", "tensor(0.25)", "nan", "", "a -3 b", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.extract_number(F.col("t")).alias("n"))
    assert [r[0] for r in df.collect()] == [0.5, 1e-05, 0.25, None, None, -3.0, None]


def test_kernels():
    rng = np.random.default_rng(0)
    x = rng.random((3, 40, 40, 1))
    assert np.allclose(kernels.ncc(x, x), 1, atol=1e-6) and np.allclose(kernels.ncc(x, 1 - x), -1, atol=1e-6)
    assert (kernels.psnr(x, x) == 33).all()
    assert np.allclose(kernels.ssim(x, x, 7), 1) and kernels.ssim(x, rng.random(x.shape), 31).max() < 0.5
    y = rng.random(x.shape)
    assert np.allclose(kernels.mutual_information(x, y), kernels.mutual_information(y, x))
    assert np.isfinite(kernels.mutual_information(x * 0, y)).all()
    assert np.allclose(kernels.fsim(x, x), 1)
    big = rng.random((1, 168, 168, 3))
    assert np.allclose(kernels.ms_ssim(big, big), 1) and np.allclose(kernels.fsim(big, big, chromatic=True), 1)
    with pytest.raises(ValueError):
        kernels.ms_ssim(x, x)
    with pytest.raises(ValueError):
        kernels.ssim(x, x, 41)
    with pytest.raises(ValueError):
        kernels.smooth(x, "box")
    assert np.allclose(kernels.match_histogram(x, x), x)
    assert kernels.clahe(x).shape == x.shape and kernels.clahe(big).max() <= 1
    assert np.allclose(kernels.median_smooth(np.ones((1, 9, 9, 3))), 1)
    hed = kernels.hematoxylin(big)
    assert hed.shape == (1, 168, 168, 1) and hed.min() >= 0 and hed.max() <= 1
    src, trg = kernels.preprocess(big * 255, big, {"normalization": True, "channel_mode": "gray", "flip_intensity": True, "match_histogram": True, "clahe": True, "smoothing": True})
    assert src.shape == trg.shape == (1, 168, 168, 1)


def test_registry(spark):
    sizes = {m.name: len(registry.config_rows([m])) for m in registry.Registry().chosen()}
    assert sizes == {"ncc": 64, "psnr": 64, "mi": 64, "ssim": 128, "ms-ssim": 64, "fsim": 64, "fsimc": 32, "lpips_alex": 192, "lpips_vgg": 192, "lpips_squeeze": 192, "dists": 96}
    with pytest.raises(KeyError):
        registry.Registry().chosen(["none"])
    with pytest.raises(NotImplementedError):
        registry.Registry()["dists"](np.ones((1, 4, 4, 3)), np.ones((1, 4, 4, 3)))
    assert registry.Registry().learned(["ncc", "dists"]) == ["dists"]


def test_folds(spark):
    samples = order_samples(spark, SF)
    outer, inner = folds.nested_folds(samples)
    groups = {r[0] for r in samples.select("pname").distinct().collect()}
    of = {r["pname"]: r["fold"] for r in outer.collect()}
    assert set(of) == groups and set(of.values()) == set(range(5))
    for k in range(5):
        own = [r["pname"] for r in inner.where(f"outer_fold = {k}").collect()]
        assert sorted(own) == sorted(g for g in groups if of[g] != k)
    sizes = [r["n_rows"] for r in folds.fold_report(samples, outer).collect()]
    assert max(sizes) < 2 * min(sizes)
    assert outer.collect() == folds.nested_folds(samples)[0].collect()


def test_ties_choose_the_first_configuration(spark):
    df = spark.createDataFrame([(0, "m", 2, 0.5, 0.1), (0, "m", 1, 0.5, 0.1), (0, "m", 0, None, 0.9), (0, "m", 3, 0.5, None)], "outer_fold int, metric string, cfg_ordinal int, inner_sp_mean double, inner_auc_bad_mean double")
    assert [r["cfg_ordinal"] for r in nested_cv.select_best(df).collect()] == [1]


def test_evaluation_needs_every_sample(spark):
    samples = order_samples(spark, SF)
    oof = order_scores(samples).where("cfg_ordinal = 0 and sample_idx <> 5").withColumnRenamed("score", "similarity_score")
    with pytest.raises(Exception, match="cover every sample"):
        nested_cv.evaluate_oof(oof, samples).collect()


def test_rank_normalisation(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 1.0), ("a", 5.0), ("b", 7.0)], "g string, similarity_score double")
    assert sorted((r[0], r[1]) for r in ranks.rank_normalised(df, ["g"]).collect()) == [("a", 0.0), ("a", 0.75), ("a", 0.75), ("b", 7.0)]


def test_draws_have_as_many_groups_as_there_are(spark):
    samples = order_samples(spark, SF)
    n = samples.select("pname").distinct().count()
    assert {r[0] for r in bootstrap.group_draws(samples, 7).groupBy("boot").agg(F.sum("times").alias("t")).select("t").collect()} == {n}


def test_whole_bootstrap_against_repeated_rows(spark):
    queries = catalogue.queries()
    found = {r["metric"]: r for r in queries["bootstrap_oof"](spark, SF).collect()}
    assert {r["n_boot"] for r in found.values()} == {1000}
    draws = queries["bootstrap_oof_draws"](spark, SF).toPandas()
    assert set(draws["boot"]) == set(range(1000))
    rows = queries["oof_predictions"](spark, SF).join(order_samples(spark, SF), "sample_idx").select("metric", "pname", "class3", "similarity_score").toPandas()
    rows = rows[rows["metric"] == "price"]
    of = {p: g for p, g in rows.groupby("pname")}
    values = []
    for _, d in draws.groupby("boot"):
        drawn = pd.concat([of[p] for p, n in zip(d["pname"], d["times"], strict=True) for _ in range(n)])
        values.append(np.corrcoef(drawn["similarity_score"].rank(), -drawn["class3"].rank())[0, 1])
    r = found["price"]
    assert np.allclose([r["bs_sp_mean"], r["bs_sp_std"]], [np.mean(values), np.std(values, ddof=1)], atol=2e-6)
    assert np.allclose([r["bs_sp_lo"], r["bs_sp_hi"]], np.percentile(values, [2.5, 97.5]), atol=6e-4)


def test_run_and_artifact(spark, tmp_path):
    pairs = vector_pairs(spark, SF)
    samples = pairs.drop("src", "trg")
    search = {f: (False, True) if f == "smoothing" else (False,) for f in registry.SEARCH}
    oof, meta = nested.nested_cv(pairs, samples, [registry.Measure("ncc", kernels.ncc, ("gray",))], search=search)
    assert oof.count() == samples.count() and meta.count() == 5
    save_artifact(f"file://{tmp_path}/a", oof, meta, samples, 155, ["ncc"])
    back = load_artifact(spark, f"file://{tmp_path}/a")
    assert back[0].count() == oof.count() and back[3].first()["identities"] == ["ncc"]


def test_annotations(spark, tmp_path):
    (tmp_path / "a.csv").write_text("fixed_path,warped_path,Similarity_Score,class3,pname,patch_id\nb.png,/w.png,4.5,0,p2,1\na.png,c.png,,2,p1,9\n")
    rows = read_annotations(spark, str(tmp_path / "a.csv"), "/base").orderBy("sample_idx").collect()
    assert [(r["sample_idx"], r["pname"], r["fixed_path"], r["warped_path"], r["Similarity_Score"]) for r in rows] == [(0, "p1", "/base/a.png", "/base/c.png", None), (1, "p2", "/base/b.png", "/w.png", 4.5)]
    assert [r["sample_idx"] for r in with_ordinal(spark.range(100).repartition(7), "id").orderBy("id").collect()] == list(range(100))


def png(x):
    """A PNG file of an array (height, width, 1, 3 or 4) of bytes."""
    h, w, c = x.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + row.tobytes() for row in x)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


@pytest.fixture
def image_folder(tmp_path):
    rng = np.random.default_rng(2)
    rows, images = ["class3,patch_id,more,fixed_path,warped_path,pname,Similarity_Score"], {}
    for i in range(24):
        names = f"a b/{i}/fixed.png", f"w/{i}.png"
        base = rng.integers(0, 256, (9, 8, (3, 1, 4)[i % 3]), np.uint8)
        for name, x in zip(names, (base, np.clip(base + rng.integers(0, 40 * (i % 3) + 2, base.shape), 0, 255).astype(np.uint8)), strict=True):
            (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / "in" / name).write_bytes(png(x))
            images[name] = x
        rows.append(f"{i % 3},p{i},x,{names[0]},{names[1]},g{i % 12},{5 - i % 3}")
    (tmp_path / "table.csv").write_text("\n".join(rows) + "\n")
    return tmp_path, images


def test_images_of_subfolders(spark, image_folder):
    folder, images = image_folder
    out = {r["path"]: r for r in annotations.read_images(spark, str(folder / "in")).collect()}
    assert set(out) == {f"{folder}/in/{name}" for name in images}
    for name, x in images.items():
        r = out[f"{folder}/in/{name}"]
        rgb = np.repeat(x, 3, axis=2) if x.shape[2] == 1 else x[..., :3]
        assert (r["height"], r["width"], r["channels"]) == (9, 8, 3) and np.allclose(r["data"], rgb.ravel() / 255)


def test_command_line_scores_every_pair(spark, image_folder):
    from tessera.jobs import run

    folder, _ = image_folder
    command = ["--csv", f"{folder}/table.csv", "--images", f"{folder}/in", "--output", f"file://{folder}/out", "--identities", "ncc,psnr", "--n-jobs", "2"]
    run.main(command)
    oof, meta, samples, info = load_artifact(spark, f"file://{folder}/out")
    assert samples.count() == 24 and sorted((r["metric"], r["sample_idx"]) for r in oof.collect()) == [(m, i) for m in ("ncc", "psnr") for i in range(24)]
    assert oof.where("similarity_score is null").count() == 0 and meta.count() == 10
    assert "smoothing:[False, True]" in info.first()["configs"]
    table = annotations.read_annotations(spark, f"{folder}/table.csv", f"{folder}/in")
    pairs = annotations.image_pairs(table, annotations.read_images(spark, str(folder / "in")))
    grid = registry.Registry().chosen(["ncc"])
    assert score_pairs(pairs, grid).count() == 24 * len(registry.config_rows(grid))
    (folder / "in" / "w" / "3.png").unlink()
    with pytest.raises(Exception, match=r"an image is missing: .*w/3.png"):
        annotations.image_pairs(table, annotations.read_images(spark, str(folder / "in"))).collect()


def test_annotations_without_a_column_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("fixed_path,warped_path,class3\na,b,1\n")
    with pytest.raises(ValueError, match="Similarity_Score"):
        annotations.read_annotations(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text("fixed_path,warped_path,Similarity_Score,class3\na,b,nan,1\n")
    assert annotations.read_annotations(spark, str(tmp_path / "b.csv")).collect()[0].asDict() == {"fixed_path": "a", "warped_path": "b", "Similarity_Score": None, "class3": 1, "pname": None, "patch_id": None, "sample_idx": 0}


def test_masks_background_and_channels(spark):
    rng = np.random.default_rng(7)
    x, y = rng.random((2, 6, 6, 1)), rng.random((2, 6, 6, 1))
    mask = (rng.random((2, 6, 6)) > 0.4).astype(float)
    own = registry.Registry(())
    for name, kernel in (("ncc", kernels.ncc), ("psnr", kernels.psnr), ("mi", kernels.mutual_information), ("ssim", lambda a, b, mask=None: kernels.ssim(a, b, 3, mask))):
        own.register(name, kernel, ("gray",), takes_mask=True)
    own.register("all", lambda i: i.background + 10 * (i.mask is not None) + 100 * np.ones(len(i.src)) * i.src.shape[-1], ("gray",), takes_inputs=True, three_channels=True)
    search = {f: (False, True) if f == "flip_intensity" else (False,) for f in registry.SEARCH}
    rows = [(i, 6, 6, 1, x[k].ravel().tolist(), y[k].ravel().tolist(), m) for i, (k, m) in enumerate(((0, mask[0].ravel().tolist()), (1, mask[1].ravel().tolist()), (0, None)))]
    df = spark.createDataFrame(rows, "sample_idx long, height int, width int, channels int, src array<double>, trg array<double>, mask array<double>")
    out = {(r["metric"], r["sample_idx"], r["cfg_ordinal"]): r["score"] for r in score_pairs(df, own.chosen(), search).collect()}
    assert len(out) == 5 * 3 * 2
    for k in range(2):
        a, b = x[k][mask[k] == 1][:, 0], y[k][mask[k] == 1][:, 0]
        assert out["psnr", k, 0] == pytest.approx(-10 * np.log10(((a - b) ** 2).mean())) and out["ncc", k, 0] == pytest.approx(np.corrcoef(a, b)[0, 1])
        assert out["all", k, 0] == 311 and out["all", k, 1] == 310
    assert out["psnr", 2, 0] == pytest.approx(-10 * np.log10(((x[0] - y[0]) ** 2).mean())) and out["all", 2, 0] == 301
    assert np.allclose(kernels.filled(x, mask, 0.5)[mask == 0], 0.5)


def test_stains_leave_one_channel_as_it_is():
    x = np.random.default_rng(1).random((2, 5, 5, 1))
    assert (kernels.preprocess(x, x, {"channel_mode": "hed"})[0] == x).all()
