"""The whole of a nested cross-validation, from pairs to out-of-fold predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.folds import nested_folds
from ..operators.nested_cv import inner_results, out_of_fold, select_best
from ..operators.registry import Measure, config_grid
from ..operators.scores import kept_scores, score_pairs
from ..sources.tables import saved


def nested_cv(pairs: DataFrame, samples: DataFrame, measures: list[Measure], seed: int = 155, search: dict[str, tuple] | None = None, outer: int = 5, inner: int = 4, scores_path: str | None = None, key: str = "sample_idx") -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions, and the chosen configuration of each outer fold and measure with its inner statistics.

    scores_path: a folder in which scores are kept from run to run, of pairs that the column key names (see kept_scores).
    """
    scores = saved(score_pairs(pairs, measures, search) if scores_path is None else kept_scores(scores_path, pairs, measures, search, key), "scores")
    outer_folds, inner_folds = nested_folds(samples, seed, outer, inner)
    best = saved(select_best(inner_results(scores, samples, inner_folds)), "best")
    grid = config_grid(samples.sparkSession, measures, search)
    fold_meta = best.join(F.broadcast(grid), ["metric", "cfg_ordinal"]).withColumnRenamed("outer_fold", "fold")
    return out_of_fold(scores, samples, outer_folds, best), fold_meta
