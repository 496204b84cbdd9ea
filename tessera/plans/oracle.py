"""SQL for rank statistics and folds, written independently of the DataFrame forms: raw rows, rank() and corr()."""

from __future__ import annotations


def average_rank(value: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0)::DOUBLE"


def auc(rank: str, positive: str) -> str:
    p, n = f"count(*) FILTER (WHERE {positive})::DOUBLE", f"count(*) FILTER (WHERE NOT ({positive}))::DOUBLE"
    return f"(sum({rank}) FILTER (WHERE {positive}) - {p} * ({p} + 1) / 2) / nullif({p} * {n}, 0)"


def statistics(source: str, by: str, name: str = "st", score: str = "score") -> str:
    """CTEs that end in one named `name`: by, n and the five statistics; source has by, class3, expert_score and score."""
    return f"""{name}_r AS (SELECT {by}, class3, {average_rank(score, by)} AS rs, {average_rank(f'-{score}', by)} AS rb, {average_rank('class3', by)} AS rc, {average_rank('expert_score', by)} AS re FROM {source}),
{name}_m AS (SELECT {by}, count(*)::DOUBLE AS n, -nullif(corr(rs, rc), 'nan') AS spearman_class3, {auc('rb', 'class3 = 2')} AS auc_bad_vs_rest, {auc('rs', 'class3 = 0')} AS auc_good_vs_rest,
  nullif(corr(rs, re), 'nan') AS spearman_raw_1_5 FROM {name}_r GROUP BY {by}),
{name}_p AS (SELECT {by}, lo, hi, class3, {average_rank(f'-{score}', f'{by}, lo, hi')} AS r FROM {source} JOIN (VALUES (0, 1), (0, 2), (1, 2)) q(lo, hi) ON class3 IN (lo, hi)),
{name}_a AS (SELECT {by}, lo, hi, {auc('r', 'class3 = hi')} AS v FROM {name}_p GROUP BY {by}, lo, hi),
{name}_o AS (SELECT {by}, avg(v) AS auc_3class_ovo FROM {name}_a GROUP BY {by}),
{name} AS (SELECT * FROM {name}_m JOIN {name}_o USING ({by}))"""


def hashed_fold(seed: str, n: int) -> str:
    return f"(('0x' || substr(md5({seed} || ':' || pname), 1, 8))::BIGINT % {n})::INT"


def stratified_folds(source: str, by: str, seed: str, n_folds: int, name: str) -> str:
    """CTEs of a recursive WITH that end in one named `name`: by, pname and fold by the greedy rule, a group at each step; source has by, pname and class3."""
    count = ", ".join(f"count(*) FILTER (WHERE class3 = {k})::DOUBLE AS c{k}" for k in range(3))
    shares = " + ".join(f"list_aggregate([x / t{k} FOR x IN f{k}], 'stddev_pop')" for k in range(3))
    empty, places = "[" + ", ".join(["0.0::DOUBLE"] * n_folds) + "]", ", ".join(f"({i})" for i in range(n_folds))
    tried = ", ".join(f"[f{k}[x + 1] + CASE WHEN x = p.fold THEN g.c{k} ELSE 0 END FOR x IN range({n_folds})] AS f{k}" for k in range(3))
    return f"""{name}_h AS (SELECT {by}, pname, {count} FROM {source} GROUP BY {by}, pname),
{name}_g AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(list_aggregate([c0, c1, c2], 'stddev_pop'), 9) DESC, md5({seed} || ':' || pname), pname) AS step FROM {name}_h),
{name}_t AS (SELECT {by}, greatest(sum(c0), 1) AS t0, greatest(sum(c1), 1) AS t1, greatest(sum(c2), 1) AS t2 FROM {name}_h GROUP BY {by}),
{name}_s AS (SELECT {by}, 0::BIGINT AS step, NULL::VARCHAR AS pname, NULL::INT AS fold, {empty} AS f0, {empty} AS f1, {empty} AS f2 FROM {name}_t
  UNION ALL SELECT {by}, step, pname, fold, f0, f1, f2 FROM (
    SELECT {by}, g.step, g.pname, p.fold::INT AS fold, f0[p.fold + 1] + f1[p.fold + 1] + f2[p.fold + 1] AS held, t0, t1, t2, {tried}
    FROM {name}_s s JOIN {name}_g g USING ({by}) JOIN {name}_t t USING ({by}), (VALUES {places}) p(fold) WHERE g.step = s.step + 1)
  QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY round(({shares}) / 3, 9), held, fold) = 1),
{name} AS (SELECT {by}, pname, fold FROM {name}_s WHERE step > 0)"""
