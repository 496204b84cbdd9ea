"""Committed artifacts, kept scores, images as bytes, and draws as numpy makes them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import kernels, pixels
from tessera.operators import bootstrap, registry, scores
from tessera.plans.fixtures import vector_pairs
from tessera.sources import annotations
from tessera.sources.artifact import PARTS, load_artifact, save_artifact

from .test_engine import SF, image_folder  # noqa: F401


@pytest.mark.parametrize(("n", "n_boot"), [(25, 1000), (7, 3), (1, 5), (3000, 1500)])
def test_draws_of_numpy(spark, n, n_boot):
    want = np.random.default_rng(143).integers(0, n, size=(n_boot, n), endpoint=False)
    counts = np.zeros((n_boot, n), int)
    for boot, row in enumerate(want):
        np.add.at(counts[boot], row, 1)
    found = np.zeros((n_boot, n), int)
    table = bootstrap.parity_draws(spark, n, n_boot, 143).toPandas()
    found[table["boot"], table["place"]] = table["times"]
    assert (found == counts).all() and len(table) == (counts > 0).sum()


def test_parity_bootstrap_by_hand(spark):
    r = np.random.default_rng(0)
    rows = [(i, "m", float(r.random()), f"g{i % 6}", int(r.integers(0, 3)), float(r.integers(1, 6))) for i in range(120)]
    df = spark.createDataFrame(rows, "sample_idx long, metric string, similarity_score double, pname string, class3 int, expert_score double")
    out = bootstrap.bootstrap(df.select("sample_idx", "metric", "similarity_score"), df.drop("metric", "similarity_score"), 50, 143, parity=True).first()
    values = []
    for draw in np.random.default_rng(143).integers(0, 6, size=(50, 6)):
        own = [x for g in draw for x in rows if x[3] == f"g{g}"]
        good, rest = [x[2] for x in own if x[4] == 0], [x[2] for x in own if x[4] != 0]
        values.append(np.mean([(a > b) + (a == b) / 2 for a in good for b in rest]))
    assert out["bs_auc_good_mean"] == pytest.approx(np.mean(values), abs=1e-9)


def test_a_broken_run_leaves_the_last_one(spark, tmp_path):
    path, one = f"file://{tmp_path}/a", spark.range(3)
    first = save_artifact(path, one, one, one, 1)
    broken = spark.range(5).select(F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        save_artifact(path, spark.range(4), broken, one, 2)
    assert [t.count() for t in load_artifact(spark, path)] == [3, 3, 3, 1]
    save_artifact(path, spark.range(4), one, one, 3)
    assert load_artifact(spark, path)[0].count() == 4 and load_artifact(spark, path, first)[0].count() == 3
    assert len(PARTS) == len(load_artifact(spark, path))


def test_kept_scores(spark, tmp_path, monkeypatch):
    path, pairs = f"file://{tmp_path}/scores", vector_pairs(spark, SF).select(*scores.PAIR_COLUMNS, F.concat(F.lit("p"), "sample_idx").alias("name"))
    own = registry.Registry(())
    own.register("ncc", channel_modes=("gray",), column=pixels.ncc)
    own.register("ssim", kernels.ssim, ("gray",), {"win_size": (3, 5)})
    search = {f: (False, True) if f == "flip_intensity" else (False,) for f in registry.SEARCH}
    asked = []
    plain = scores.score_pairs
    monkeypatch.setattr(scores, "score_pairs", lambda df, some, search=None: asked.append((df.count(), [m.name for m in some])) or plain(df, some, search))
    table = lambda df: {tuple(r)[:3]: r[3] for r in df.collect()}
    few = pairs.where("sample_idx < 40")
    assert table(scores.kept_scores(path, few, own.chosen(["ncc"]), search, "name")) == table(plain(few, own.chosen(["ncc"]), search))
    assert table(scores.kept_scores(path, pairs, own.chosen(), search, "name")) == table(plain(pairs, own.chosen(), search))
    n = pairs.count()
    assert asked == [(40, ["ncc"]), (n - 40, ["ncc"]), (n, ["ssim"])]
    assert len(table(scores.kept_scores(path, pairs, own.chosen(), search, "name"))) == n * 6 and len(asked) == 3


def test_ordinals_of_a_csv_in_ranges(spark, tmp_path):
    rows = spark.range(200000).select(F.col("id").alias("patch_id"), (F.col("id") % 7).alias("pname"), F.rand(1).alias("Similarity_Score"), (F.col("id") % 3).alias("class3"), *(F.concat(F.lit(f"{c}/"), "id").alias(c) for c in ("fixed_path", "warped_path")))
    rows.repartition(6).write.option("header", True).csv(f"file://{tmp_path}/a")
    found = sorted((r["sample_idx"], r["pname"], r["patch_id"], r["class3"]) for r in annotations.read_annotations(spark, f"file://{tmp_path}/a").collect())
    assert found == [(n, p, i, int(i) % 3) for n, (p, i) in enumerate(sorted((str(i % 7), str(i)) for i in range(200000)))]


def test_ordinals_of_wide_rows(spark):
    """Ranges of whole rows and of their keys alone are not the same size."""
    rows = spark.range(30000).select((F.col("id") * 7919 % 30000).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("wide"))
    found = annotations.with_ordinal(rows.repartition(6), "key").collect()
    assert len(found) == 30000 and all(r["sample_idx"] == r["key"] for r in found)


def test_images_as_bytes(spark, image_folder):  # noqa: F811
    folder, _ = image_folder
    table = annotations.read_annotations(spark, f"{folder}/table.csv", f"{folder}/in")
    wide = annotations.image_pairs(table, annotations.read_images(spark, str(folder / "in")))
    packed = annotations.image_pairs(table, annotations.read_images(spark, str(folder / "in"), as_bytes=True))
    own = registry.Registry().chosen(["ncc", "psnr"])
    scored = lambda df: {tuple(r)[:3]: r[3] and round(r[3], 9) for r in scores.score_pairs(df, own).collect()}
    found, wanted = scored(packed), scored(wide)
    assert found.keys() == wanted.keys() and all(abs((found[k] or 0) - (wanted[k] or 0)) < 1e-6 for k in found)
    packed.collect()
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(sample_idx") >= 1 and "Exchange hashpartitioning(path" not in plan.split("MapInArrow")[0]


def test_an_image_of_very_many_pairs(spark, monkeypatch):
    monkeypatch.setattr(annotations, "PAIRS_OF_COPY", 10)
    images = spark.createDataFrame([(f"/{i}", 1, 1, 3, bytes([i] * 3)) for i in range(30)], annotations.IMAGE_BYTES)
    table = spark.createDataFrame([(i, "/0", f"/{i % 30}") for i in range(300)], "sample_idx long, warped_path string, fixed_path string")
    rows = annotations.image_pairs(table, images).collect()
    assert sorted((r["sample_idx"], r["src"][0], r["trg"][0]) for r in rows) == [(i, 0, i % 30) for i in range(300)]


def test_warning_for_learned_measures(spark, tmp_path):
    from tessera.jobs import run

    with pytest.warns(UserWarning, match="dists"), pytest.raises(Exception):  # noqa: B017
        run.main(["--csv", f"{tmp_path}/none.csv", "--images", f"{tmp_path}", "--output", f"{tmp_path}/o", "--identities", "ncc,dists", "--n-jobs", "2"])
