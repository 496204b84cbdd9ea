"""Stratified group folds.

Groups are taken in the order of how unevenly they are spread over the classes, and each goes to the fold that then keeps
the classes' shares of all folds most even.  This needs only the counts of each class in each group.  Each choice depends on
all before it, so one task makes them; Spark sorts the groups for it, and it holds a batch of them and the folds' counts.
"""

from __future__ import annotations

from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Dealer:
    """Deals groups to folds, one after the other; total: the rows of each class in all groups.

    Shares of a class spread by the root of n * (sum of squares) - (sum) ** 2 of the folds' counts, which are whole numbers.
    """

    def __init__(self, total: list[int], n_folds: int):
        self.n, self.parts = n_folds, [3 * n_folds * max(t, 1) for t in total]
        self.folds = [[0] * n_folds for _ in total]
        self.squares, self.sums, self.held = [0] * len(total), [0] * len(total), [0] * n_folds

    def fold(self, counts: list[int]) -> int:
        """The fold of the next group, whose counts are by class."""
        even, moving = 0.0, []
        for c, k in enumerate(counts):
            if k:
                moving.append((self.folds[c], k, self.n * self.squares[c] - (self.sums[c] + k) ** 2, self.parts[c]))
            else:
                even += sqrt(self.n * self.squares[c] - self.sums[c] ** 2) / self.parts[c]
        best = None
        for f in range(self.n):
            uneven = even
            for own, k, rest, part in moving:
                uneven += sqrt(self.n * k * (2 * own[f] + k) + rest) / part
            key = (round(uneven, 9), self.held[f])
            if best is None or key < best:
                best, chosen = key, f
        for c, k in enumerate(counts):
            if k:
                self.squares[c] += k * (2 * self.folds[c][chosen] + k)
                self.sums[c] += k
                self.folds[c][chosen] += k
                self.held[chosen] += k
        return chosen


def _histogram(samples: DataFrame, group: str, cls: str, *more: str) -> DataFrame:
    return samples.groupBy(*more, F.col(group).cast("string").alias("pname")).agg(*(F.sum((F.col(cls) == c).cast("long")).alias(f"c{c}") for c in (0, 1, 2)))


def stratified_folds(samples: DataFrame, n_folds: int, seed: int, group: str = "pname", cls: str = "class3", by: str | None = None, seed_by: bool = False) -> DataFrame:
    """(by,) pname and fold of every group of samples; no group is in two folds.

    Groups are shuffled by md5(seed:group).  by: a column; each of its values has folds of its own, and with seed_by its
    value is added to the seed.
    """
    hist = _histogram(samples, group, cls, *([by] if by else []))
    key, classes = by or "one", ("c0", "c1", "c2")
    hist = hist.withColumn(key, F.col(by).cast("int") if by else F.lit(0))
    totals = hist.groupBy(F.col(key).alias("of")).agg(*(F.sum(c).alias(f"t{c}") for c in classes))
    own = F.lit(seed) + (F.col(key) if by and seed_by else F.lit(0))
    mean = sum((F.col(c) for c in classes), F.lit(0)) / 3
    spread = F.round(F.sqrt(sum(((F.col(c) - mean) * (F.col(c) - mean) for c in classes), F.lit(0.0)) / 3), 9)
    rows = hist.join(totals, F.col(key).eqNullSafe(F.col("of"))).withColumns({"spread": spread, "shuffle": F.md5(F.concat_ws(":", own.cast("string"), "pname"))})
    ordered = rows.repartition(key).sortWithinPartitions(key, F.desc("spread"), "shuffle", "pname").select(key, "pname", *classes, *(f"t{c}" for c in classes))

    def run(batches):
        dealer = now = None
        for batch in batches:
            folds, keys = [], batch.column(0).to_pylist()
            columns = [batch.column(i).to_pylist() for i in range(2, 8)]
            for i, (of, *counts) in enumerate(zip(keys, *columns[:3], strict=True)):
                if dealer is None or of != now:
                    dealer, now = Dealer([c[i] for c in columns[3:]], n_folds), of
                folds.append(dealer.fold(counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(folds, pa.int32())], [key, "pname", "fold"])

    out = ordered.mapInArrow(run, f"`{key}` int, pname string, fold int")
    return out if by else out.drop("one")


def hashed_folds(samples: DataFrame, n_folds: int, seed: int, group: str = "pname") -> DataFrame:
    """pname and fold of every group, by md5(seed:group) only: needs no counts, but does not even out the classes."""
    return samples.select(F.col(group).cast("string").alias("pname")).distinct().withColumn("fold", (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "pname")), 1, 8), 16, 10).cast("long") % n_folds).cast("int"))


def nested_folds(samples: DataFrame, seed: int = 155, outer: int = 5, inner: int = 4) -> tuple[DataFrame, DataFrame]:
    """Outer folds (pname, fold), and inner ones (outer_fold, pname, fold) of the groups outside each outer fold."""
    outside = stratified_folds(samples, outer, seed)
    named = samples.withColumn("pname", F.col("pname").cast("string")).join(outside, "pname")
    training = named.withColumn("outer_fold", F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(outer - 1)), F.col("fold")))).drop("fold")
    return outside, stratified_folds(training, inner, seed, by="outer_fold", seed_by=True)


def fold_report(samples: DataFrame, folds: DataFrame) -> DataFrame:
    """fold, n_rows and n_groups of the samples in each fold."""
    named = samples.withColumn("pname", F.col("pname").cast("string")).join(folds, "pname")
    return named.groupBy("fold").agg(F.count("*").alias("n_rows"), F.countDistinct("pname").alias("n_groups"))
