"""Statistics of sets and of multiplicities of groups, each from one sort, against ranks.evaluate on the rows themselves."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.rank_forms import evaluate_draws, rank_forms
from tessera.functions.rank_sets import evaluate_sets
from tessera.functions.ranks import STATISTICS, evaluate
from tessera.operators.bootstrap import group_draws, numbered_groups

ROWS = "metric string, pname string, similarity_score double, class3 int, expert_score double, sets array<int>"


def rows_of(seed, n, groups, scores=None, odd=True):
    r = random.Random(seed)
    value = lambda: r.choice(scores) if scores else r.random()
    out = []
    for _ in range(n):
        sets = sorted({r.randrange(6) for _ in range(r.randrange(4))})
        out.append((r.choice(["a", "b", None]), f"g{r.randrange(groups)}", value(), r.choice([0, 0, 1, 2, 2, 3 if odd else 1]), r.choice([1.0, 2.5, 4.0, 5.0]), sets or None))
    return out


def close(found, wanted, keys):
    found = {tuple(r[k] for k in keys): r for r in found.collect()}
    wanted = {tuple(r[k] for k in keys): r for r in wanted.collect()}
    assert found.keys() == wanted.keys() and wanted
    for key, w in wanted.items():
        for name in ("n", *STATISTICS):
            x, y = found[key][name], w[name]
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9), (key, name, x, y)


@pytest.mark.parametrize("scores", [None, [0.0, -0.0, 0.5, 1.0, 2.0]])
def test_statistics_of_sets(spark, scores):
    rows = rows_of(1, 2000, 9, scores)
    rows += [("c", "g", None, 1, 2.0, [0, 1]), ("c", "g", float("nan"), 1, 2.0, [2]), ("c", "g", 1.0, 0, 2.0, [1, 3]), ("c", "g", 2.0, None, None, [4]), ("c", "g", 2.0, 2, None, [3]), ("c", "g", 3.0, 1, 1.0, [3])]
    df = spark.createDataFrame(rows, ROWS)
    found = evaluate_sets(df, ["metric"], "sets", "similarity_score")
    wanted = evaluate(df.withColumn("set", F.explode("sets")), ["metric", "set"], "similarity_score")
    close(found, wanted, ["metric", "set"])
    assert evaluate_sets(df.limit(0), ["metric"], "sets", "similarity_score").collect() == []


def test_one_score_of_most_rows(spark):
    rows = [("a", "g", 1.0 if i % 3 else float(i), i % 3, float(i % 5), [i % 2, 2]) for i in range(30_000)]
    df = spark.createDataFrame(rows, ROWS)
    close(evaluate_sets(df, ["metric"], "sets", "similarity_score"), evaluate(df.withColumn("set", F.explode("sets")), ["metric", "set"], "similarity_score"), ["metric", "set"])


@pytest.mark.parametrize(("n", "groups", "scores"), [(1500, 7, None), (1500, 7, [0.0, 0.5, 1.0, 2.0]), (3000, 600, None), (900, 300, [float(i) for i in range(250)])])
def test_statistics_of_draws(spark, n, groups, scores):
    rows = [(m or "none", *r) for m, *r in rows_of(n + groups, n, groups, scores)]
    rows += [("none", "g1", None, 1, 2.0, None), ("b", "g2", 1.0, None, 2.0, None), ("a", "g3", 1.0, 1, None, None)]
    df = spark.createDataFrame(rows, ROWS)
    draws, placed = group_draws(df, 30, 7), numbered_groups(df)
    found = evaluate_draws(rank_forms(df, placed), draws.join(placed, "pname").select("boot", "place", "times"))
    wanted = evaluate(df.join(draws, "pname"), ["metric", "boot"], "similarity_score", weight="times")
    whole = wanted.where(F.coalesce(*(F.col(s) for s in STATISTICS)).isNotNull())
    assert found.where(F.coalesce(*(F.col(s) for s in STATISTICS)).isNotNull()).count() == whole.count() > 30
    # n of the forms leaves out rows without a score or class, whose replicates have no statistics.
    close(found.join(whole.select("metric", "boot"), ["metric", "boot"]), whole, ["metric", "boot"])
