"""Bootstrap of whole groups: confidence intervals of the statistics of out-of-fold predictions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rank_forms import evaluate_draws, rank_forms
from ..functions.ranks import STATISTICS
from ..sources.tables import new_folder, saved


def numbered_groups(samples: DataFrame) -> DataFrame:
    """pname and place, from 0 in the order of names: one row for each group, far fewer than samples."""
    names = samples.select(F.col("pname").cast("string").alias("pname")).distinct()
    return names.withColumn("place", (F.row_number().over(Window.orderBy("pname")) - 1).cast("long"))


def _drawn(spark: SparkSession, n: int, n_boot: int, seed: int) -> DataFrame:
    """boot, place and times of the n groups that each replicate draws."""
    draws = spark.range(n_boot * n).select((F.expr(f"id div {max(n, 1)}")).cast("int").alias("boot"), (F.col("id") % max(n, 1)).alias("j"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("boot").cast("string"), F.col("j").cast("string")))
    return draws.withColumn("place", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % max(n, 1)).groupBy("boot", "place").agg(F.count("*").alias("times"))


#: Draws that the driver holds at once.
_DRAWS_AT_ONCE = 1 << 21


def parity_draws(spark: SparkSession, n: int, n_boot: int = 1000, seed: int = 143) -> DataFrame:
    """boot, place and times as numpy's default generator draws them: integers(0, n, size=(n_boot, n)) by its PCG64 stream.

    The stream is one sequence, so the driver makes it, some replicates at once, and writes their counts.
    """
    rng, path, step = np.random.default_rng(seed), new_folder(spark, "draws"), max(1, _DRAWS_AT_ONCE // max(n, 1))
    schema = "boot int, place long, times long"
    spark.createDataFrame([], schema).write.parquet(path)
    for first in range(0, n_boot, step):
        size = min(step, n_boot - first)
        keys, times = np.unique(np.arange(size)[:, None] * n + rng.integers(0, n, size=(size, n)), return_counts=True) if n else (np.zeros(0, np.int64),) * 2
        table = pa.table({"boot": (keys // max(n, 1) + first).astype(np.int32), "place": keys % max(n, 1), "times": times.astype(np.int64)})
        spark.createDataFrame(table).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def group_draws(samples: DataFrame, n_boot: int = 1000, seed: int = 143) -> DataFrame:
    """boot, pname and times: how often each replicate draws each group.

    A replicate draws as many groups as there are, with replacement; draw j of replicate b is the group of the place
    md5(seed:b:j) in the order of names.  The draws are the same for all measures.
    """
    placed = numbered_groups(samples)
    return _drawn(samples.sparkSession, placed.count(), n_boot, seed).join(placed, "place").select("boot", "pname", "times")


def bootstrap(oof: DataFrame, samples: DataFrame, n_boot: int = 1000, seed: int = 143, parity: bool = False) -> DataFrame:
    """The statistics on all samples, and means, deviations and 95 % intervals over the replicates, for each measure.

    Rows are read once, for forms in the counts of groups (see functions.rank_forms); a replicate is a product of these with
    its draws, and that in which each group counts once gives the statistics on all samples.  The measure with the largest
    correlation on all samples comes first.  parity: draws as numpy makes them, in place of those by md5.
    """
    rows = oof.join(samples.select("sample_idx", F.col("pname").cast("string").alias("pname"), "class3", "expert_score"), "sample_idx")
    placed = saved(numbered_groups(samples), "groups")
    n = placed.count()
    forms = saved(rank_forms(rows, placed), "forms")
    once = samples.sparkSession.range(n).select(F.lit(-1).alias("boot"), F.col("id").alias("place"), F.lit(1).cast("long").alias("times"))
    draws = (parity_draws if parity else _drawn)(samples.sparkSession, n, n_boot, seed)
    stats = saved(evaluate_draws(forms, draws.union(once)), "replicates")
    full = stats.where("boot < 0").select("metric", *(F.col(s).alias(f"full_{s}") for s in STATISTICS))
    stats = stats.where("boot >= 0")
    short = {"sp": "spearman_class3", "auc_bad": "auc_bad_vs_rest", "auc_good": "auc_good_vs_rest", "auc_ovo": "auc_3class_ovo"}
    aggs = []
    for name, column in short.items():
        aggs.append(F.avg(column).alias(f"bs_{name}_mean"))
        if name in ("sp", "auc_bad"):
            aggs.append(F.stddev_samp(column).alias(f"bs_{name}_std"))
        ends = F.percentile(column, F.array(F.lit(0.025), F.lit(0.975)))
        aggs.append(F.struct(F.round(ends[0], 3).alias("lo"), F.round(ends[1], 3).alias("hi")).alias(f"bs_{name}_ci"))
    out = stats.groupBy("metric").agg(*aggs).join(full, "metric")
    out = out.withColumns({"n_boot": F.lit(n_boot), "seed": F.lit(seed).cast("long")})
    return out.orderBy(F.desc_nulls_last("full_spearman_class3"), "metric")  # one row for each measure
