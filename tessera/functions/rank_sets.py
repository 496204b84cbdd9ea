"""Rank statistics of many overlapping sets of rows from one sort.

Rows lie in any number of sets: the folds of all outer folds, say.  Scores are sorted once, in ranges.  A task walks
through its range and counts, for each set and class, the weight below each row; what lies in earlier ranges is added
afterwards from the ranges' totals.  So no row is copied for its sets, and no task holds a whole group or set.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from .ranks import CLASSES, not_nan, statistics_of


def sorted_ranges(cells: DataFrame, by: list[str]) -> DataFrame:
    """cells in ranges of (by, s), sorted; equal scores of a group lie in one range."""
    return cells.repartitionByRange(*by, "s").sortWithinPartitions(*by, "s")


def walked(batches: Iterator[pa.RecordBatch], n_keys: int, score: int) -> Iterator[tuple[tuple, pa.Table, bool]]:
    """(key, rows, whether the key ends here) of a sorted range: rows of one key, never cut between equal scores.

    The first n_keys columns are the key.
    """
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        edges = [0, *_changes(table, range(n_keys)), len(table)]
        for a, b in zip(edges[:-2], edges[1:-1], strict=True):
            yield _key(table, a, n_keys), table.slice(a, b - a), True
        a = edges[-2]
        last = table.slice(a)
        cut = _changes(last, [score])[-1:]
        if cut:
            yield _key(table, a, n_keys), last.slice(0, cut[0]), False
        held = last.slice(cut[0] if cut else 0)
    if held is not None and len(held):
        yield _key(held, 0, n_keys), held, True


def _key(table: pa.Table, at: int, n_keys: int) -> tuple:
    return tuple(table.column(i)[at].as_py() for i in range(n_keys))


def _changes(table: pa.Table, columns) -> list[int]:
    """The rows in which one of the columns differs from the row before."""
    if len(table) < 2:
        return []
    found = np.zeros(len(table) - 1, bool)
    for i in columns:
        codes = table.column(i).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        found |= codes[1:] != codes[:-1]
    return (np.flatnonzero(found) + 1).tolist()


def _coded(values: pa.Array) -> tuple[list, np.ndarray]:
    """The different values, and the place of each value among them."""
    coded = values.dictionary_encode(null_encoding="encode")
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


class _Group:
    """Sums of one group's rows in one range."""

    def __init__(self):
        self.below = defaultdict(lambda: np.zeros(4))  # by set: weight of each class, and of all, so far
        self.cubes = defaultdict(float)  # by set: cubes of the weights of equal scores
        self.sums = defaultdict(lambda: np.zeros(5))  # by set, class and expert score: weight, and weight times what is below
        self.lacking = defaultdict(float)  # the same without a score or class: weight

    def add(self, table: pa.Table, first: int) -> None:
        s, c, e, w, sets = (table.column(first + i).combine_chunks() for i in range(5))
        size = pc.fill_null(pc.list_value_length(sets), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(table)), size)
        names, of = _coded(sets.flatten())
        classes, cls = _coded(c)
        experts, expert = _coded(e)
        w = w.to_numpy(zero_copy_only=False)
        none = pc.or_(s.is_null(), c.is_null()).to_numpy(zero_copy_only=False)
        if none.any():
            for i in np.flatnonzero(none[row]):
                self.lacking[names[of[i]], classes[cls[row[i]]], experts[expert[row[i]]]] += w[row[i]]
            some = ~none[row]
            row, of = row[some], of[some]
        if not len(row):
            return
        order = np.argsort(of.astype(np.uint16) if len(names) < 1 << 16 else of, kind="stable")  # short numbers are sorted by their digits
        row, of = row[order], of[order]
        score, cls, expert, w = (v[row] for v in (s.to_numpy(zero_copy_only=False), cls, expert, w))
        weight = np.zeros((len(row), 4))
        weight[:, 3] = w
        for k in CLASSES:
            if k in classes:
                weight[:, k] = np.where(cls == classes.index(k), w, 0)
        new_set = np.append(True, of[1:] != of[:-1])
        new = new_set | np.append(True, score[1:] != score[:-1])
        start = np.flatnonzero(new)
        tied = np.add.reduceat(weight, start, axis=0)
        total = np.cumsum(tied, axis=0)
        first_tie = np.flatnonzero(new_set[start])
        of_tie = [names[x] for x in of[start[first_tie]].tolist()]
        base = np.array([self.below[x] for x in of_tie]) - np.where(first_tie[:, None] > 0, total[first_tie - 1], 0)
        level = total - tied / 2 + np.repeat(base, np.diff(np.append(first_tie, len(start))), axis=0)
        ends = np.append(first_tie[1:], len(start)) - 1
        for x, end, cube in zip(of_tie, total[ends] + base, np.add.reduceat(tied[:, 3] ** 3, first_tie), strict=True):
            self.below[x] = end
            self.cubes[x] += cube
        key = (of.astype(np.int64) * len(classes) + cls) * len(experts) + expert
        found, where = np.unique(key, return_inverse=True) if len(names) * len(classes) * len(experts) > len(key) else (np.arange(len(names) * len(classes) * len(experts)), key)
        level = level[np.cumsum(new) - 1] * w[:, None]
        sums = np.column_stack([np.bincount(where, v, len(found)) for v in (w, *level.T)])
        for at in np.flatnonzero(sums[:, 0]):
            rest, j = divmod(int(found[at]), len(experts))
            x, k = divmod(rest, len(classes))
            self.sums[names[x], classes[k], experts[j]] += sums[at]

    def rows(self) -> Iterator[tuple]:
        cubes = dict(self.cubes)
        for (x, k, e), v in self.sums.items():
            yield (x, k, e, *v.tolist(), cubes.pop(x, 0.0), False)
        for (x, k, e), v in self.lacking.items():
            yield (x, k, e, v, 0.0, 0.0, 0.0, 0.0, 0.0, True)


_SUMS = ("n", "h0", "h1", "h2", "h", "cubes")


def evaluate_sets(df: DataFrame, by: list[str], sets: str, score: str = "score", cls: str = "class3", raw: str = "expert_score", weight: str | None = None, name: str = "set") -> DataFrame:
    """by, set, n and the statistics of ranks.evaluate for each set of each group's rows.

    sets: an array of int, the sets that a row lies in; none for null.  A set with a null or NaN score, or a null class, has null
    statistics.  Rows equal in everything are added up before they are sorted, so one score may be that of most rows.
    """
    given = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(*by, (not_nan(F.col(score).cast("double")) + 0.0).alias("s"), F.col(cls).cast("int").alias("c"), F.col(raw).cast("double").alias("e"), given.alias("w"), F.sort_array(sets).alias("sets"))
    cells = rows.groupBy(*by, "s", "c", "e", "sets").agg(F.sum("w").alias("w")).where("w > 0").select(*by, "s", "c", "e", "w", "sets")
    keys, n_keys = cells.select(*by).schema.fields, len(by)
    fields = [*keys, StructField("part", IntegerType()), StructField(name, IntegerType()), StructField("c", IntegerType()), StructField("e", DoubleType())]
    schema = StructType([*fields, *(StructField(x, DoubleType()) for x in _SUMS), StructField("lacks", BooleanType())])

    def run(batches):
        group, part = _Group(), TaskContext.get().partitionId()
        arrow = None
        for batch_key, table, ends in walked(batches, n_keys, n_keys):
            arrow = arrow or [table.schema.field(i).type for i in range(n_keys)] + [pa.int32()] * 3 + [pa.float64()] * 7 + [pa.bool_()]
            group.add(table, n_keys)
            if ends:
                out = [(*batch_key, part, *r) for r in group.rows()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), arrow, strict=True)], names=schema.names)
                group = _Group()

    found = sorted_ranges(cells, by).mapInArrow(run, schema)
    # A row for each range, set, class and expert score: what lies in earlier ranges comes from these.
    earlier = Window.partitionBy(*by, name).orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    before = {f"b{k}": F.sum(F.when(F.col("c") == k, F.col("n"))).over(earlier) for k in CLASSES} | {"b": F.sum("n").over(earlier)}
    whole = found.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in before.items()})
    reduced = whole.groupBy(*by, name, "c", "e").agg(
        F.sum("n").alias("w"),
        F.sum("cubes").alias("cubes"),
        F.max("lacks").alias("lacks"),
        *(F.sum(F.col(f"h{k}") + F.col("n") * F.col(f"b{k}")).alias(f"wh{k}") for k in ("", *CLASSES)),
    )
    n = F.sum("w")
    return statistics_of(reduced.withColumn("ws", F.col("wh") + F.col("w") / 2), [*by, name], (n * n * n - F.sum("cubes")) / 12)
