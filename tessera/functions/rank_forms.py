"""Rank statistics of any multiplicities of groups as forms in them, from one sort.

If every row of group g counts t[g] times, the weight below a row is linear in t, so what the statistics need of ranks is

    U[g, c, h, b]  pairs of a row of class c in group g and a row of class b in h with a smaller score (half of equal ones)
    V[g, e, h]     the same for rows of expert score e in g and any row of h
    T[g, h, k]     products of the weights of equal scores, which give the sum of squared ranks
    C[g, c, e]     weights, and L[g], whether the group has a row without a score or class

A bootstrap replicate is then a product with its counts, whatever the number of rows.  Scores are sorted once, in ranges;
pairs within a range are counted in its task, pairs across ranges follow from the ranges' totals.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import saved
from .rank_sets import sorted_ranges, walked
from .ranks import PAIRS, STATISTICS, not_nan

#: Groups h are taken so many at once: rows are read once for each block of them, and a task's tables have this width.
BLOCK = 256
#: Replicates of a task.
REPLICATES = 128
#: Numbers of a table of weights below rows that a task makes at once.
_AT_ONCE = 1 << 21
#: Classes other than 0, 1 and 2 count together where rows are below others.
_OTHER = 3
_FORM = "kind string, part int, g int, x double, h int, y double, k int, u double"
_NAMES = [f.split()[0] for f in _FORM.split(", ")]
_ENTRY = [n for n in _NAMES if n != "part"]


def _sums(keys: list[np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of keys, and the sum of values of each."""
    found, where = np.unique(np.column_stack(keys), axis=0, return_inverse=True)
    return found, np.bincount(where.ravel(), values, len(found))


class _Range:
    """Forms of the pairs within one range of one measure's scores, for one block of groups h."""

    def __init__(self, block: int, width: int):
        self.first, self.width = block * BLOCK, width
        self.below = np.zeros((width, 4))
        self.u = defaultdict(lambda: np.zeros((width, 4)))
        self.v = defaultdict(lambda: np.zeros(width))
        self.c, self.t, self.lacking = defaultdict(float), defaultdict(float), set()

    def add(self, s: np.ndarray, g: np.ndarray, c: np.ndarray, e: np.ndarray, w: np.ndarray) -> None:
        """Rows in the order of s, a null being NaN; a null class is below 0."""
        none = np.isnan(s) | (c < 0)
        self.lacking.update(g[none].tolist())
        s, g, c, e, w = (v[~none] for v in (s, g, c, e, w))
        if not len(s):
            return
        start = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        step = max(1, _AT_ONCE // (4 * self.width))
        for a in range(0, len(start), step):
            end = start[a + step] if a + step < len(start) else len(s)
            tie = np.searchsorted(start, np.arange(start[a], end), side="right") - 1 - a
            self._pairs(tie, *(v[start[a] : end] for v in (g, c, e, w)))
            if self.first == 0:
                self._ties(tie, g[start[a] : end], w[start[a] : end])
        for key, value in zip(*(x.tolist() for x in _sums([g, c, e], w)), strict=True):
            self.c[tuple(key)] += value

    def _pairs(self, tie: np.ndarray, g: np.ndarray, c: np.ndarray, e: np.ndarray, w: np.ndarray) -> None:
        level = np.zeros((int(tie[-1]) + 1, self.width, 4))
        own = (g >= self.first) & (g < self.first + self.width)
        np.add.at(level, (tie[own], g[own] - self.first, np.minimum(c[own], _OTHER)), w[own])
        half = level / 2
        np.cumsum(level, axis=0, out=level)
        level += self.below
        self.below = level[-1].copy()
        level -= half
        total = level.sum(axis=2)
        for forms, of, table in ((self.u, c, level), (self.v, e, total)):
            order = np.lexsort((of, g))
            edge = np.flatnonzero(np.append(True, (g[order][1:] != g[order][:-1]) | (of[order][1:] != of[order][:-1])))
            for rows in np.split(order, edge[1:]):
                forms[int(g[rows[0]]), float(of[rows[0]])] += np.tensordot(w[rows], table[tie[rows]], axes=1)

    def _ties(self, tie: np.ndarray, g: np.ndarray, w: np.ndarray) -> None:
        """Products of the weights that groups have in equal scores, once for each three groups in ascending order."""
        cells, weight = _sums([tie, g], w)
        start = np.flatnonzero(np.append(True, cells[1:, 0] != cells[:-1, 0]))
        size = np.diff(np.append(start, len(cells)))
        for m in np.unique(size).tolist():  # scores that m groups have
            at = start[size == m][:, None] + np.arange(m)
            groups, weights = cells[at, 1], weight[at]
            for i, j, k in combinations_with_replacement(range(m), 3):
                ways = {1: 1, 2: 3, 3: 6}[len({i, j, k})]
                for key, value in zip(*(x.tolist() for x in _sums([groups[:, i], groups[:, j], groups[:, k]], ways * weights[:, i] * weights[:, j] * weights[:, k])), strict=True):
                    self.t[tuple(key)] += value

    def rows(self, part: int) -> Iterator[tuple]:
        for (g, c), table in self.u.items():
            for h, b in zip(*np.nonzero(table), strict=True):
                yield ("U", -1, g, c, self.first + int(h), float(b), -1, float(table[h, b]))
        for (g, e), table in self.v.items():
            for h in np.flatnonzero(table):
                yield ("V", -1, g, e, self.first + int(h), -1.0, -1, float(table[h]))
        for (g, c, e), n in self.c.items():
            yield ("C", part, int(g), c, -1, e, -1, n)
        if self.first == 0:
            for (g, h, k), x in self.t.items():
                yield ("T", -1, g, -1.0, h, -1.0, k, x)
            for g in self.lacking:
                yield ("L", -1, g, -1.0, -1, -1.0, -1, 1.0)


def _across(key: tuple, pdf: pd.DataFrame, n_groups: int) -> pd.DataFrame:
    """Forms of the pairs whose smaller score lies in an earlier range, from the ranges' weights."""
    block = int(key[1])
    first, width = block * BLOCK, min(BLOCK, n_groups - block * BLOCK)
    part = np.unique(pdf["part"], return_inverse=True)[1]
    g, c, e, n = pdf["g"].to_numpy(np.int64), pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["u"].to_numpy()
    own = (g >= first) & (g < first + width)
    total = np.zeros((part.max() + 1, width, 4))
    np.add.at(total, (part[own], g[own] - first, np.minimum(c[own].astype(int), _OTHER)), n[own])
    below = np.cumsum(total, axis=0) - total
    rows = []
    for kind, of, table in (("U", c, below), ("V", e, below.sum(axis=2)[..., None])):
        cells, where = np.unique(np.column_stack([g, of]), axis=0, return_inverse=True)
        weight = np.zeros((len(cells), len(total)))
        np.add.at(weight, (where.ravel(), part), n)
        forms = np.tensordot(weight, table, axes=1)
        at, h, b = np.nonzero(forms)
        rows.append(pd.DataFrame({"kind": kind, "g": cells[at, 0].astype(np.int32), "x": cells[at, 1], "h": (h + first).astype(np.int32), "y": b.astype(float) if kind == "U" else -1.0, "k": -1, "u": forms[at, h, b]}))
    return pd.concat(rows, ignore_index=True).assign(metric=key[0])[["metric", *_ENTRY]]


def rank_forms(rows: DataFrame, groups: DataFrame, metric: str = "metric", score: str = "similarity_score", cls: str = "class3", raw: str = "expert_score") -> DataFrame:
    """metric, kind, g, x, h, y, k, u: the forms of each measure's rows; unused columns are -1.

    groups: pname and place, the number of each group from 0.  rows have pname as text.  A null expert score ranks below all
    others.  Rows equal in everything are added up before they are sorted.  Tables grow with the square of the number of
    groups, and with the cube of the number of groups that share one score.
    """
    n_groups = groups.count()
    blocks = max(1, -(-n_groups // BLOCK))
    own = rows.select(F.col(metric).alias("metric"), F.col("pname"), (not_nan(F.col(score).cast("double")) + 0.0).alias("s"), F.coalesce(F.col(cls).cast("int"), F.lit(-1)).alias("c"), F.coalesce(F.col(raw).cast("double"), F.lit(float("-inf"))).alias("e"))
    cells = own.groupBy("metric", "pname", "s", "c", "e").agg(F.count("*").cast("double").alias("w")).join(groups, "pname")
    cells = cells.select("metric", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "s", F.col("place").cast("int").alias("g"), "c", "e", "w")

    def run(batches):
        part, now, of = TaskContext.get().partitionId(), None, None
        for key, table, ends in walked(batches, 2, 2):
            if now is None:
                now, of = _Range(key[1], min(BLOCK, n_groups - key[1] * BLOCK)), key
            s, g, c, e, w = (table.column(i).to_numpy() for i in range(2, 7))
            now.add(s.astype(float), g, c, e, w)
            if ends:
                out = list(zip(*now.rows(part), strict=True)) or [()] * 8
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.float64()]
                n = len(out[0])
                yield pa.RecordBatch.from_arrays([pa.array([of[0]] * n, pa.string()), pa.array([of[1]] * n, pa.int32()), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], names=["metric", "block", *_NAMES])
                now = None

    inside = saved(sorted_ranges(cells, ["metric", "block"]).mapInArrow(run, f"metric string, block int, {_FORM}"), "rank-forms")

    def across(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _across(key, pdf, n_groups)

    # One row for each range, group, class and expert score.
    weights = inside.where("kind = 'C'")
    outside = weights.groupBy("metric", "block").applyInPandas(across, "metric string, " + _FORM.replace("part int, ", ""))
    every = inside.where("kind <> 'C'").select("metric", *_ENTRY).union(outside).union(weights.where("block = 0").select("metric", *_ENTRY))
    return every.groupBy("metric", *_ENTRY[:-1]).agg(F.sum("u").alias("u"))


def _statistics(forms: pd.DataFrame, boots: np.ndarray, times: np.ndarray) -> pd.DataFrame:
    """The statistics of each replicate; times: replicates x groups."""
    parts = dict(tuple(forms.groupby("kind")))
    some = lambda kind: parts.get(kind, forms.iloc[:0])
    size = times.shape[1]

    def pairs(f: pd.DataFrame) -> np.ndarray:
        table = np.zeros((size, size))
        np.add.at(table, (f["g"].to_numpy(), f["h"].to_numpy()), f["u"].to_numpy())
        return ((times @ table) * times).sum(axis=1)

    def weights(by: str) -> dict[float, np.ndarray]:
        out = {}
        for level, f in some("C").groupby(by):
            table = np.zeros(size)
            np.add.at(table, f["g"].to_numpy(), f["u"].to_numpy())
            out[level] = times @ table
        return out

    none = np.zeros(len(times))
    above = {key: pairs(f) for key, f in some("U").groupby(["x", "y"])}  # by class, and class below
    u = lambda c, b: above.get((float(c), float(b)), none)
    n_class, n_level = weights("x"), weights("y")
    n = sum(n_class.values(), none)
    cubes = none.copy()
    t = some("T")
    for a in range(0, len(t), 4096):
        f = t.iloc[a : a + 4096]
        cubes += (times[:, f["g"]] * times[:, f["h"]] * times[:, f["k"]]) @ f["u"].to_numpy()

    def spearman(n_of: dict[float, np.ndarray], below: dict[float, np.ndarray]) -> np.ndarray:
        """From the weight of each level, in ascending order, and what is below its rows by score."""
        before, shared, squares = none, none, n**3
        for level, own in n_of.items():
            centred = before + own / 2 - n / 2
            shared, before, squares = shared + (below.get(level, none) - own * n / 2) * centred, before + own, squares - own**3
        spread = (n**3 - cubes) / 12 * (squares / 12)
        return np.divide(shared, np.sqrt(spread, where=spread > 0, out=np.ones_like(spread)), where=spread > 0, out=np.full(len(n), np.nan))

    def auc(pairs_: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
        return np.divide(pairs_, positive * negative, where=(positive > 0) & (negative > 0), out=np.full(len(n), np.nan))

    of = lambda c: n_class.get(float(c), none)
    by_class = {c: sum((u(c, b) for b in range(4)), none) for c in n_class}
    by_level = {e: pairs(f) for e, f in some("V").groupby("x")}
    rest = lambda c: sum((u(c, b) for b in range(4) if b != c), none)
    ovo = np.array([1 - auc(u(b, a), of(b), of(a)) for a, b in PAIRS])
    both = ~np.isnan(ovo)
    mean = np.divide(np.where(both, ovo, 0).sum(axis=0), both.sum(axis=0), where=both.any(axis=0), out=np.full(len(n), np.nan))
    values = (-spearman(n_class, by_class), 1 - auc(rest(2), of(2), n - of(2)), auc(rest(0), of(0), n - of(0)), mean, spearman(n_level, by_level))
    lacks = (times[:, some("L")["g"].to_numpy(int)] > 0).any(axis=1)
    return pd.DataFrame({"boot": boots, "n": n} | {name: np.where(lacks, np.nan, v) for name, v in zip(STATISTICS, values, strict=True)})


def evaluate_draws(forms: DataFrame, draws: DataFrame) -> DataFrame:
    """metric, boot, n and the statistics of ranks.evaluate of each replicate; draws: boot, place, times.

    A task holds one measure's forms and REPLICATES replicates.
    """
    batch = F.expr(f"boot div {REPLICATES}").cast("int")
    last = draws.agg(F.max(batch)).first()[0] or 0
    metrics = [r[0] for r in forms.select("metric").distinct().collect()]  # one for each measure
    # Forms are few: one copy for each batch of replicates.
    left = forms.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(last))))
    right = draws.select("boot", "place", "times", batch.alias("drawn"), F.explode(F.array(*map(F.lit, metrics)).cast("array<string>")).alias("of"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["metric", "boot", "n", *STATISTICS])
        groups = np.unique(np.concatenate([right["place"], *(left[c] for c in ("g", "h", "k"))]))
        groups = groups[groups >= 0]
        boots, row = np.unique(right["boot"], return_inverse=True)
        times = np.zeros((len(boots), len(groups)))
        times[row, np.searchsorted(groups, right["place"])] = right["times"]
        left = left.assign(**{c: np.searchsorted(groups, left[c]) for c in ("g", "h", "k")})
        return _statistics(left, boots, times).assign(metric=left["metric"].iloc[0])[["metric", "boot", "n", *STATISTICS]]

    schema = "metric string, boot int, n double, " + ", ".join(f"{s} double" for s in STATISTICS)
    out = left.groupBy("metric", "batch").cogroup(right.groupBy("of", "drawn")).applyInPandas(run, schema)
    return out.select("metric", "boot", "n", *(not_nan(F.col(s)).alias(s) for s in STATISTICS))
