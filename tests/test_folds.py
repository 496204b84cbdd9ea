"""Stratified folds against the rule as written with arrays, and of very many groups."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from tessera.operators.folds import Dealer, stratified_folds


def by_arrays(counts, n_folds):
    """The rule: counts are groups x classes, in the order in which they are dealt."""
    total = np.maximum(counts.sum(axis=0), 1)
    folds, out = np.zeros((n_folds, counts.shape[1])), []
    for row in counts:
        tried = folds[None] + np.eye(n_folds)[:, :, None] * row
        uneven = np.round((tried / total).std(axis=1).mean(axis=1), 9)
        best = int(np.lexsort((np.arange(n_folds), folds.sum(axis=1), uneven))[0])
        folds[best] += row
        out.append(best)
    return out


def test_dealing_is_the_rule():
    r = np.random.default_rng(3)
    for n, k, most in ((400, 5, 2), (300, 4, 50), (200, 3, 1000), (50, 7, 1), (5, 5, 3)):
        counts = r.integers(0, most + 1, (n, 3)) * r.integers(0, 2, (n, 3))
        dealer = Dealer(counts.sum(axis=0).tolist(), k)
        assert [dealer.fold(row) for row in counts.tolist()] == by_arrays(counts, k)


def test_folds_of_a_million_groups(spark):
    began = time.time()
    rows = spark.range(3_000_000).select((F.col("id") % 1_000_000).cast("string").alias("pname"), F.pmod(F.xxhash64("id"), F.lit(3)).alias("class3"))
    folds = stratified_folds(rows, 5, 155)
    counts = rows.join(folds, "pname").groupBy("fold", "class3").count().collect()
    assert len(counts) == 15 and max(r["count"] for r in counts) - min(r["count"] for r in counts) < 3000
    assert time.time() - began < 120


def test_folds_by_a_column_with_nulls(spark):
    r = random.Random(1)
    rows = [(r.choice([0, 1, None]), f"g{r.randrange(40)}", r.randrange(3)) for _ in range(500)]
    df = spark.createDataFrame(rows, "part int, pname string, class3 int")
    found = stratified_folds(df, 4, 1, by="part").collect()
    assert {(x["part"], x["pname"]) for x in found} == {(p, g) for p, g, _ in rows} and len(found) == len({(x["part"], x["pname"]) for x in found})
    assert {x["fold"] for x in found} == set(range(4)) and stratified_folds(df.limit(0), 4, 1).collect() == []
