"""Nested cross-validation over the score table, as joins, windows and aggregates.

Outer and inner folds are columns, so all folds of all configurations are evaluated in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rank_sets import evaluate_sets
from ..sources.tables import saved

KEYS = ["outer_fold", "metric", "cfg_ordinal"]
#: An inner fold's number is below this.
MOST_FOLDS = 1 << 12


def inner_results(scores: DataFrame, samples: DataFrame, inner: DataFrame) -> DataFrame:
    """Means and deviations over the inner folds of the class correlation and the AUC of class 2, by configuration.

    scores: sample_idx, metric, cfg_ordinal, score; samples: sample_idx, pname, class3, expert_score; inner: outer_fold,
    pname, fold.  A statistic that a fold lacks is left out; the deviation of one fold is null.
    """
    # A sample lies in one inner fold of each outer fold but its own: sets of one sort of each configuration's scores.
    groups = inner.groupBy("pname").agg(F.collect_list((F.col("outer_fold") * MOST_FOLDS + F.col("fold")).cast("int")).alias("sets"))
    rows = samples.withColumn("pname", F.col("pname").cast("string")).join(groups, "pname")
    rows = rows.select("sample_idx", "class3", "expert_score", "sets").join(scores, "sample_idx")
    stats = evaluate_sets(rows, ["metric", "cfg_ordinal"], "sets").withColumn("outer_fold", F.expr(f"`set` div {MOST_FOLDS}").cast("int"))
    return stats.groupBy(*KEYS).agg(
        F.avg("spearman_class3").alias("inner_sp_mean"),
        F.stddev_samp("spearman_class3").alias("inner_sp_std"),
        F.avg("auc_bad_vs_rest").alias("inner_auc_bad_mean"),
        F.stddev_samp("auc_bad_vs_rest").alias("inner_auc_bad_std"),
    )


def select_best(results: DataFrame) -> DataFrame:
    """The configuration of each outer fold and measure with the largest correlation, then AUC (both to 9 places), then the first."""
    order = Window.partitionBy("outer_fold", "metric").orderBy(*(F.round(c, 9).desc_nulls_last() for c in ("inner_sp_mean", "inner_auc_bad_mean")), "cfg_ordinal")
    return results.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def out_of_fold(scores: DataFrame, samples: DataFrame, outer: DataFrame, best: DataFrame) -> DataFrame:
    """sample_idx, metric, fold, cfg_ordinal and similarity_score: each sample by its outer fold's configuration."""
    # One row for each fold and measure.
    rows = samples.withColumn("pname", F.col("pname").cast("string")).join(outer, "pname").select("sample_idx", "fold")
    chosen = best.select(F.col("outer_fold").alias("fold"), "metric", "cfg_ordinal")
    return scores.join(F.broadcast(chosen.select("metric", "cfg_ordinal").distinct()), ["metric", "cfg_ordinal"], "left_semi").join(rows, "sample_idx").join(F.broadcast(chosen), ["fold", "metric", "cfg_ordinal"]).select(
        "sample_idx", "metric", "fold", "cfg_ordinal", F.col("score").alias("similarity_score")
    )


def evaluate_oof(oof: DataFrame, samples: DataFrame) -> DataFrame:
    """metric, n and the five statistics on all samples.  Fails if a measure lacks a sample or has one twice.

    A measure's samples are one set of a sort in ranges, as they are too many for one task.
    """
    n, oof = samples.count(), saved(oof, "oof")  # read three times
    rows = oof.join(samples.select("sample_idx", "class3", "expert_score"), "sample_idx").withColumn("sets", F.array(F.lit(0)))
    found = evaluate_sets(rows, ["metric"], "sets", "similarity_score").drop("set")
    counts = oof.groupBy("metric").agg(F.count("*").alias("rows"), F.countDistinct("sample_idx").alias("different"))
    return found.join(counts, "metric").where(F.assert_true((F.col("rows") == n) & (F.col("different") == n), F.lit("a measure does not cover every sample once")).isNull()).drop("rows", "different")
