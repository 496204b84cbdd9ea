"""python -m tessera.jobs.run --csv FILE --images FOLDER --output FOLDER: nested cross-validation of a table of image pairs."""

from __future__ import annotations

import argparse
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import config_key
from ..operators.registry import Registry
from ..plans.nested import nested_cv
from ..sources.annotations import image_pairs, read_annotations, read_images
from ..sources.artifact import save_artifact
from ..sources.tables import saved


def config_value_counts(fold_meta: DataFrame) -> DataFrame:
    """How many outer folds of each measure chose each configuration, most first."""
    keyed = fold_meta.select("metric", config_key(F.col("params")).alias("preproc_cfg"))
    return keyed.groupBy("metric", "preproc_cfg").agg(F.count("*").alias("n")).orderBy("metric", F.desc("n"), "preproc_cfg")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--identities", default="ncc,psnr,mi,ssim")
    p.add_argument("--csv", required=True)
    p.add_argument("--images", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--outer-seed", type=int, default=155)
    p.add_argument("--n-jobs", type=int, default=1, help="not needed: all folds are evaluated in one Spark job")
    p.add_argument("--scores", help="a folder that keeps scores from run to run; only those that it lacks are worked out")
    a = p.parse_args(args)
    learned = [] if a.n_jobs < 2 else Registry().learned(a.identities.split(","))
    if learned:
        warnings.warn(f"learned measures may slow each other down on one accelerator: {', '.join(learned)}; take --n-jobs 1 or 2", stacklevel=2)
    names = a.identities.split(",")
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    annotations = saved(read_annotations(spark, a.csv, a.images), "annotations")
    samples = annotations.withColumnRenamed("Similarity_Score", "expert_score")
    measures = Registry().chosen(names)
    pairs = image_pairs(annotations, read_images(spark, a.images, as_bytes=True))
    if a.scores:  # pairs are known by their paths from run to run
        key = F.concat_ws("|", "warped_path", "fixed_path").alias("pair_key")
        pairs = pairs.join(annotations.select("sample_idx", key), "sample_idx")
    oof, fold_meta = nested_cv(pairs, samples, measures, a.outer_seed, scores_path=a.scores, key="pair_key" if a.scores else "sample_idx")
    save_artifact(a.output, oof, fold_meta, annotations, a.outer_seed, names)
    config_value_counts(fold_meta).show(truncate=False)


if __name__ == "__main__":
    main()
