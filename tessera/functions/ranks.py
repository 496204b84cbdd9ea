"""Rank statistics of scored samples: Spearman correlations and areas under ROC curves, for each group.

Rows may carry a weight, the number of times that a sample counts.  Rows equal in score, class and expert score are
added up before any window, so ties and bootstrap duplicates cost nothing.  A statistic of a group is null if its score
has a null or NaN, if an input is constant, or if a class that it needs is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSES = (0, 1, 2)
PAIRS = ((0, 1), (0, 2), (1, 2))
STATISTICS = ("spearman_class3", "auc_bad_vs_rest", "auc_good_vs_rest", "auc_3class_ovo", "spearman_raw_1_5")


def not_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def average_rank(value: str, by: list[str]) -> Column:
    """Rank of a row's value in its group from 1; equal values share the mean of their places."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0


def _weighted_rank(weight: Column, value: str, by: list[str]) -> Column:
    up_to = F.sum(weight).over(Window.partitionBy(*by).orderBy(value))
    return up_to - F.sum(weight).over(Window.partitionBy(*by, value)) / 2.0 + 0.5


def _below(cells: DataFrame, by: list[str], weights: dict[str, Column], part: str | None) -> DataFrame:
    """cells with, under each name, the weight of the rows with a smaller s in its group, and half of that with an equal one.

    part: a column that never falls as s rises (see with_parts).  Each part is then summed up by itself and what lies below
    it is added, so no task holds a whole group.
    """
    inside = [*by, part] if part else by
    sums = {k: F.sum(w).over(Window.partitionBy(*inside).orderBy("s")) - F.sum(w).over(Window.partitionBy(*inside, "s")) / 2.0 for k, w in weights.items()}
    found = cells.withColumns(sums)
    if not part:
        return found
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = cells.groupBy(*inside).agg(*(F.sum(w).alias(f"part_{k}") for k, w in weights.items()))
    before = totals.select(*(F.col(c).alias(f"of_{c}") for c in inside), *(F.coalesce(F.sum(f"part_{k}").over(earlier), F.lit(0.0)).alias(f"before_{k}") for k in weights))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in inside]
    return found.join(before, same).select(*cells.columns, *((F.col(k) + F.col(f"before_{k}")).alias(k) for k in weights))


def with_parts(df: DataFrame, by: list[str], value: str, levels: int = 8, name: str = "part") -> DataFrame:
    """df with a part of 0 to 2 ** levels - 1 of each row, by quantiles of the value in its group: never falls as the value rises.

    The quantiles need not be exact, as equal values are in one part wherever the cuts lie.  A null or NaN is in part 0.
    """
    number, parts = not_nan(F.col(value).cast("double")), 1 << levels
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(levels))))
    cuts = df.groupBy(*(F.col(c).alias(f"of_{c}") for c in by)).agg(F.percentile_approx(number, F.array(*(F.lit(i / parts) for i in range(1, parts))), 20 * parts).alias("cuts"))
    placed = df.join(cuts, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by])
    # The number of smaller cuts, by halving: each step is taken if the cut before its end is smaller.
    below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get("cuts", at + step - 1) < number, step).otherwise(0))
    return placed.withColumn(name, below).drop("cuts", *(f"of_{c}" for c in by))


def evaluate(df: DataFrame, by: list[str], score: str = "score", cls: str = "class3", raw: str = "expert_score", weight: str | None = None, part: str | None = None) -> DataFrame:
    """by, n (sum of weights) and the five statistics, one row for each group.

    spearman_class3 is negated, as a higher class is worse; spearman_raw_1_5 is not.  auc_bad_vs_rest ranks class 2 by the
    negated score, auc_good_vs_rest class 0 by the score.  auc_3class_ovo is the mean over pairs of classes that are both
    there, of the AUC of the worse one by the negated score among the rows of the pair.

    Scores are ranked once; what follows needs one row for each class and expert score of a group.  part: a column from
    with_parts, for groups too large for one task.
    """
    given = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    parts = [F.col(part).alias("part")] if part else []
    rows = df.select(*by, *parts, not_nan(F.col(score).cast("double")).alias("s"), F.col(cls).cast("int").alias("c"), F.col(raw).cast("double").alias("e"), given.alias("w"))
    cells = rows.groupBy(*by, *(["part"] if part else []), "s", "c", "e").agg(F.sum("w").alias("w")).where("w > 0")
    w = F.col("w")
    below = _below(cells, by, {"h": w} | {f"h{k}": F.when(F.col("c") == k, w).otherwise(0.0) for k in CLASSES}, "part" if part else None)
    rank = F.col("h") + 0.5
    reduced = below.groupBy(*by, "c", "e").agg(
        F.sum("w").alias("w"),
        F.sum(w * rank).alias("ws"),
        F.sum(w * rank * rank).alias("wss"),
        F.max(F.col("s").isNull() | F.col("c").isNull()).alias("lacks"),
        *(F.sum(w * F.col(h)).alias(f"w{h}") for h in ("h", *(f"h{k}" for k in CLASSES))),
    )
    return statistics_of(reduced, by, F.sum("wss") - _level(F.sum("w")))


def _level(n: Column) -> Column:
    """The sum of squares of ranks that are all the mean rank."""
    return n * (n + 1) * (n + 1) / 4.0


def statistics_of(reduced: DataFrame, by: list[str], squares: Column) -> DataFrame:
    """by, n and the five statistics from one row for each class c and expert score e of a group.

    reduced has w, the weight; ws, its product with ranks by the score; wh, wh0, wh1 and wh2, its product with the weight
    below each row (of all classes and of each), half of what is equal included; lacks, whether a score or class is
    missing.  squares: an aggregate, the sum of squares of the ranks' distances from their mean.
    """
    w = F.col("w")
    ranked = reduced.withColumns({"rank_c": _weighted_rank(w, "c", by), "rank_e": _weighted_rank(w, "e", by)})
    n = F.sum("w")
    level = _level(n)
    among = lambda k, value: F.sum(F.when(F.col("c") == k, value).otherwise(0.0))

    def spearman(other: str) -> Column:
        spread = squares * (F.sum(w * F.col(other) * F.col(other)) - level)
        return F.when(spread > 0, (F.sum(F.col("ws") * F.col(other)) - level) / F.sqrt(spread))

    def auc(above: Column, positive: Column, negative: Column) -> Column:
        return F.when((positive > 0) & (negative > 0), above / (positive * negative))

    out = ranked.groupBy(*by).agg(
        n.alias("n"),
        (~F.max("lacks")).alias("whole"),
        spearman("rank_c").alias("by_class"),
        spearman("rank_e").alias("by_expert"),
        *(auc(among(k, F.col("wh") - F.col(f"wh{k}")), among(k, w), n - among(k, w)).alias(name) for k, name in ((2, "bad_up"), (0, "good"))),
        *(auc(among(b, F.col(f"wh{a}")), among(b, w), among(a, w)).alias(f"auc_{a}{b}") for a, b in PAIRS),
    )
    pairs = F.filter(F.array(*(1 - F.col(f"auc_{a}{b}") for a, b in PAIRS)), lambda x: x.isNotNull())
    ovo = F.when(F.size(pairs) > 0, F.aggregate(pairs, F.lit(0.0), lambda t, x: t + x) / F.size(pairs))
    values = (-F.col("by_class"), 1 - F.col("bad_up"), F.col("good"), ovo, F.col("by_expert"))
    return out.select(*by, "n", *(F.when(F.col("whole"), v).alias(name) for v, name in zip(values, STATISTICS, strict=True)))


def directed_auc(df: DataFrame, by: list[str], score: str = "score", cls: str = "class3") -> DataFrame:
    """by and auc: the one-against-one AUC by the score, negated where it falls with the class."""
    found = evaluate(df.withColumn("expert_score", F.lit(0.0)), by, score, cls)
    # spearman_class3 is negated, so it is positive where the score falls with the class.
    return found.select(*by, F.when(F.col("spearman_class3") > 0, F.col("auc_3class_ovo")).otherwise(1 - F.col("auc_3class_ovo")).alias("auc"))


def rank_normalised(df: DataFrame, by: list[str], score: str = "similarity_score") -> DataFrame:
    """df with its score replaced by (average rank - 1) / (n - 1) within its group; the score of a single row stays."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return df.withColumn(score, F.when(n > 1, (average_rank(score, by) - 1) / (n - 1)).otherwise(F.col(score)))
