"""The library's own queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import filters, kernels, pixels, ranks, scalars
from .functions.rank_forms import rank_forms
from .jobs.run import config_value_counts
from .operators import bootstrap, folds, nested_cv, registry, scores
from .plans import nested, oracle
from .plans.fixtures import LABELLED_DOCUMENTS, ORDER_SAMPLES, VECTOR_LABELS, VECTOR_PIXELS, colour_pairs, colour_search_pairs, labelled_documents, mosaic_pixels, mosaics, order_samples, order_scores, table, vector_pairs
from .sources.annotations import read_annotations, with_ordinal
from .sources.artifact import load_artifact, save_artifact
from .sources.tables import new_folder, saved

QUERIES: dict = {}
SQL: dict[str, str] = {}
SEED = 155


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


def sql_rounded(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in columns)


# Sources.
_SCAN = f"WITH {LABELLED_DOCUMENTS} SELECT row_number() OVER (ORDER BY sample_idx) - 1 AS sample_idx, sample_idx AS key, pname, class3, expert_score FROM a"


@query("annotation_scan", _SCAN)
def annotation_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ordinal(labelled_documents(spark, sf_dir).withColumnRenamed("sample_idx", "key"), "key").select("sample_idx", "key", "pname", "class3", "expert_score")


_CSV = """WITH r AS (SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id))
SELECT row_number() OVER (ORDER BY source NULLS FIRST, doc_id::VARCHAR) - 1 AS sample_idx, source AS pname, doc_id::VARCHAR AS patch_id, quality::INT AS class3, CASE WHEN quality = 1 THEN 4.5 END::DOUBLE AS score,
  '/data/f/' || doc_id AS fixed_path, '/w/' || doc_id AS warped_path FROM r"""


@query("annotation_csv", _CSV)
def annotation_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    rows = rows.select(
        F.lit("x").alias("unread"), F.col("quality").alias("class3"), F.col("source").alias("pname"), F.col("doc_id").alias("patch_id"), F.when(F.col("quality") == 1, 4.5).otherwise(float("nan")).alias("Similarity_Score"),
        F.concat(F.lit("/w/"), "doc_id").alias("warped_path"), F.concat(F.lit("f/"), "doc_id").alias("fixed_path"),
    )
    path = new_folder(spark, "annotations")
    rows.write.option("header", True).csv(path)
    return read_annotations(spark, path, "/data").withColumnRenamed("Similarity_Score", "score")


@query("annotation_counts", f"WITH {LABELLED_DOCUMENTS} SELECT count(*) AS n_rows, count(DISTINCT pname) AS n_groups FROM a")
def annotation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_documents(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.countDistinct("pname").alias("n_groups"))


_PATH = "regexp_replace(url, '^https?://[^/]*', CASE WHEN page_id % 2 = 0 THEN '' ELSE 'base' END)"


@query("path_resolve", f"SELECT page_id, CASE WHEN starts_with({_PATH}, '/') THEN {_PATH} ELSE '/data/' || {_PATH} END AS path FROM pages")
def path_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", F.lit("^https?://[^/]*"), F.when(F.col("page_id") % 2 == 0, "").otherwise("base"))
    return table(spark, sf_dir, "pages").select("page_id", scalars.resolved_path("/data/", path).alias("path"))


@query("extract_number", f"SELECT event_id, coalesce(try_cast(props AS DOUBLE), try_cast(nullif(regexp_extract(props, '{scalars.NUMBER}'), '') AS DOUBLE)) AS number FROM events")
def extract_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", scalars.extract_number(F.col("props")).alias("number"))


# The grid, of identities that a table names: brands as measures, with the channel modes and window sizes of their parts.
_IDENTITIES = """n AS (SELECT p_brand AS metric, list_sort(list_distinct(list(lower(p_type)))) AS modes, list_sort(list_distinct(list(2 * (p_size // 10) + 3))) AS wins FROM part GROUP BY p_brand),
m AS (SELECT *, row_number() OVER (ORDER BY metric) - 1 AS ord FROM n)"""
_GRID = f"""WITH {_IDENTITIES}, b(v) AS (VALUES (0), (1)),
g AS (SELECT metric, n.v AS n, modes[k + 1] AS mode, f.v AS f, h.v AS h, c.v AS c, s.v AS s, wins[p + 1] AS win, ((((((n.v * len(modes) + k) * 2 + f.v) * 2 + h.v) * 2 + c.v) * 2 + s.v) * len(wins) + p)::INT AS cfg_ordinal
  FROM m, b n, b f, b h, b c, b s, (SELECT unnest(range(20)) AS k) i, (SELECT unnest(range(20)) AS p) j WHERE k < len(modes) AND p < len(wins))
"""


def _part_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    wins = F.transform(F.array_sort(F.collect_set(2 * F.floor(F.col("p_size") / 10) + 3)), lambda w: w.cast("string"))
    found = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("metric")).agg(F.array_sort(F.collect_set(F.lower("p_type"))).alias("channel_modes"), F.array(F.struct(F.lit("win_size").alias("name"), wins.alias("values"))).alias("params"))
    return found.withColumn("ord", F.row_number().over(Window.orderBy("metric")) - 1)  # one row for each brand


@query("config_grid", _GRID + "SELECT metric, cfg_ordinal, (dense_rank() OVER (ORDER BY n, mode, f, h, c, s) - 1)::INT AS preproc_id, n = 1 AS normalization, mode AS channel_mode, f = 1 AS flip_intensity, h = 1 AS match_histogram, c = 1 AS clahe, s = 1 AS smoothing, win::VARCHAR AS win_size FROM g")
def config_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.grid_of(_part_identities(spark, sf_dir)).select("metric", "cfg_ordinal", "preproc_id", *scalars.FLAGS, F.col("params")["win_size"].alias("win_size"))


@query("config_key", _GRID + "SELECT metric, cfg_ordinal, concat_ws(' | ', n, mode, f, h, c, s, win) AS preproc_cfg FROM g")
def config_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.grid_of(_part_identities(spark, sf_dir)).select("metric", "cfg_ordinal", scalars.config_key(F.col("params")).alias("preproc_cfg"))


@query("identity_groups", f"WITH {_IDENTITIES} SELECT min(ord)::INT AS group_id, array_to_string(modes, ',') AS modes, array_to_string(wins, ',') AS wins, string_agg(metric, ',' ORDER BY ord) AS metrics FROM m GROUP BY modes, m.wins")
def identity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _part_identities(spark, sf_dir)
    wins = own.select("ord", F.array_join(F.col("params")[0]["values"], ",").alias("wins"))
    groups = registry.groups_of(own).join(wins, F.col("group_id") == F.col("ord"))
    return groups.select("group_id", F.array_join("channel_modes", ",").alias("modes"), "wins", F.array_join("metrics", ",").alias("metrics"))


@query("metric_kwargs", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'win_size=' || (p_size::INT) ELSE '' END AS kwargs FROM (SELECT p_partkey, p_partkey % 31 AS p_size FROM part)")
def metric_kwargs(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = F.create_map(F.lit("win_size"), (F.col("p_partkey") % 31).cast("string"), F.lit("bins"), F.lit("32"))
    keys = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("win_size"))).otherwise(F.array(F.lit("none")))
    own = F.map_entries(scalars.only_keys(params, keys))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(own, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("kwargs"))


# Labels and ranks.
@query("labels_binarised", f"WITH {LABELLED_DOCUMENTS} SELECT sample_idx, (class3 = 2)::INT AS y_bad, (class3 = 0)::INT AS y_good, round(-score, 6) AS badness FROM a")
def labels_binarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda c: (F.col("class3") == c).cast("int")
    return labelled_documents(spark, sf_dir).select("sample_idx", flag(2).alias("y_bad"), flag(0).alias("y_good"), F.round(-F.col("score"), 6).alias("badness"))


@query("class_pairs", f"WITH {LABELLED_DOCUMENTS} SELECT lo, hi, count(*) AS n, sum((class3 = hi)::INT)::BIGINT AS n_higher FROM a JOIN (SELECT DISTINCT x.class3 AS lo, y.class3 AS hi FROM a x JOIN a y ON x.class3 < y.class3) p ON class3 IN (lo, hi) GROUP BY lo, hi")
def class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_documents(spark, sf_dir).select("class3")
    classes = rows.distinct()  # three at most
    pairs = classes.withColumnRenamed("class3", "lo").join(classes.withColumnRenamed("class3", "hi"), F.col("lo") < F.col("hi"))
    counts = rows.groupBy("class3").agg(F.count("*").alias("k"))
    both = pairs.join(counts, F.col("class3").isin(F.col("lo"), F.col("hi")))
    return both.groupBy("lo", "hi").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("class3") == F.col("hi"), F.col("k")).otherwise(0)).alias("n_higher"))


@query("avg_rank", f"WITH {ORDER_SAMPLES} SELECT sample_idx, {oracle.average_rank('expert_score', 'pname')} AS expert_rank, {oracle.average_rank('price', 'pname')} AS price_rank FROM c")
def avg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_samples(spark, sf_dir).select("sample_idx", ranks.average_rank("expert_score", ["pname"]).alias("expert_rank"), ranks.average_rank("price", ["pname"]).alias("price_rank"))


_BY_SOURCE = f"WITH {LABELLED_DOCUMENTS}, {oracle.statistics('a', 'pname')} SELECT pname, "
_BY_NATION = f"WITH {ORDER_SAMPLES}, sc AS (SELECT *, price AS score FROM c), {oracle.statistics('sc', 'pname')} SELECT pname, "


@query("spearman", _BY_NATION + sql_rounded("spearman_class3", "spearman_raw_1_5") + " FROM st")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.evaluate(order_samples(spark, sf_dir), ["pname"], "price").select("pname", "spearman_class3", "spearman_raw_1_5"), "spearman_class3", "spearman_raw_1_5")


@query("auc_binary", _BY_SOURCE + sql_rounded("auc_bad_vs_rest", "auc_good_vs_rest") + " FROM st")
def auc_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.evaluate(labelled_documents(spark, sf_dir), ["pname"]).select("pname", "auc_bad_vs_rest", "auc_good_vs_rest"), "auc_bad_vs_rest", "auc_good_vs_rest")


@query("auc_ovo", _BY_SOURCE + sql_rounded("auc_3class_ovo") + " FROM st")
def auc_ovo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.evaluate(labelled_documents(spark, sf_dir), ["pname"]).select("pname", "auc_3class_ovo"), "auc_3class_ovo")


@query("auc_directed", _BY_NATION + "round(CASE WHEN spearman_class3 > 0 THEN auc_3class_ovo ELSE 1 - auc_3class_ovo END, 6) + 0.0::DOUBLE AS auc FROM st")
def auc_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.directed_auc(order_samples(spark, sf_dir), ["pname"], "price"), "auc")


@query("rank_statistics", _BY_SOURCE + "n, " + sql_rounded(*ranks.STATISTICS) + " FROM st")
def rank_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.evaluate(labelled_documents(spark, sf_dir), ["pname"]), *ranks.STATISTICS)


# Pixels.
@query("pixel_scaling", f"WITH {VECTOR_PIXELS} SELECT sample_idx, i::INT AS i, round(x / (1 + 1e-8), 6) AS min_max, round(1 - x, 6) AS flipped, round(least(greatest(x * 2 - 0.5, 0), 1), 6) AS clipped, round(x * 255 / 255, 6) AS scaled FROM px")
def pixel_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("src")
    columns = {"min_max": pixels.min_max(x), "flipped": pixels.flipped(x), "clipped": pixels.clipped(F.transform(x, lambda v: v * 2 - 0.5)), "scaled": pixels.scaled(F.transform(x, lambda v: v * 255))}
    wide = vector_pairs(spark, sf_dir).select("sample_idx", F.arrays_zip(*(c.alias(n) for n, c in columns.items())).alias("z"))
    return wide.select("sample_idx", F.posexplode("z").alias("i", "p")).select("sample_idx", "i", *(F.round(F.col(f"p.{n}"), 6).alias(n) for n in columns))


@query("rgb_gray", f"WITH {VECTOR_PIXELS} SELECT a.sample_idx, a.i::INT AS i, round(0.299 * a.x + 0.587 * a.y + 0.114 * b.y, 6) AS gray FROM px a JOIN px b ON b.i = a.i AND b.sample_idx = (a.sample_idx + 1) % (SELECT count(*) FROM embeddings)")
def rgb_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    gray = pixels.gray(F.col("src_r"), F.col("src_g"), F.col("src_b"))
    return colour_pairs(spark, sf_dir).select("sample_idx", F.posexplode(gray).alias("i", "gray")).withColumn("gray", F.round("gray", 6))


_MOMENTS = """g AS (SELECT sample_idx, count(*) AS n, avg(x) AS mx, avg(y) AS my, stddev_samp(x) + 1e-8 AS dx, stddev_samp(y) + 1e-8 AS dy FROM px {where} GROUP BY sample_idx)"""
_NCC = "sum((x - mx) * (y - my)) / any_value(dx * dy * (n - 1))"


@query("measure_ncc", f"WITH {VECTOR_PIXELS}, {_MOMENTS.format(where='')} SELECT sample_idx, round({_NCC}, 6) + 0.0::DOUBLE AS score FROM px JOIN g USING (sample_idx) GROUP BY sample_idx")
def measure_ncc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vector_pairs(spark, sf_dir).select("sample_idx", pixels.ncc(F.col("src"), F.col("trg")).alias("score")), "score")


@query("measure_psnr", f"WITH {VECTOR_PIXELS} SELECT sample_idx, round(CASE avg((x - y) ** 2) WHEN 0 THEN 33.0 ELSE -10 * log10(avg((x - y) ** 2)) END, 6) + 0.0::DOUBLE AS score FROM px GROUP BY sample_idx")
def measure_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vector_pairs(spark, sf_dir).select("sample_idx", pixels.psnr(F.col("src"), F.col("trg")).alias("score")), "score")


_MI = f"""WITH {VECTOR_PIXELS}, b AS (SELECT sample_idx, least(floor(x * 32), 31) AS bx, least(floor(y * 32), 31) AS b2 FROM px),
j AS (SELECT sample_idx, bx, b2, count(*) / 64.0 AS p FROM b GROUP BY ALL),
q AS (SELECT *, sum(p) OVER (PARTITION BY sample_idx, bx) AS p1, sum(p) OVER (PARTITION BY sample_idx, b2) AS p2 FROM j)
SELECT sample_idx, round(sum(p * ln(p / (p1 * p2))), 6) + 0.0::DOUBLE AS score FROM q GROUP BY sample_idx"""


@query("measure_mi", _MI)
def measure_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vector_pairs(spark, sf_dir).select("sample_idx", pixels.mutual_information(F.col("src"), F.col("trg")).alias("score")), "score")


def _kernel_scores(spark: SparkSession, sf_dir: str, name: str, kernel, **params) -> DataFrame:
    """One measure, without preprocessing, through the score table."""
    own = registry.Registry(())
    own.register(name, lambda x, y: kernel(x, y, **params), ("gray",))
    plain = {f: (False,) for f in registry.SEARCH}
    return rounded(scores.score_pairs(vector_pairs(spark, sf_dir), own.chosen(), plain).select("sample_idx", "score"), "score")


_SSIM = f"""WITH {VECTOR_PIXELS}, o(d) AS (VALUES (-1), (0), (1)),
m AS (SELECT p.sample_idx, p.i, avg(q.x) AS ux, avg(q.y) AS uy, avg(q.x * q.x) AS xx, avg(q.y * q.y) AS yy, avg(q.x * q.y) AS xy
  FROM px p, o r, o c, px q WHERE q.sample_idx = p.sample_idx AND q.i = least(greatest(p.i // 8 + r.d, 0), 7) * 8 + least(greatest(p.i % 8 + c.d, 0), 7) GROUP BY ALL)
SELECT sample_idx, round(avg((2 * ux * uy + 0.0001) * (2 * 9 / 8 * (xy - ux * uy) + 0.0009) / ((ux * ux + uy * uy + 0.0001) * (9 / 8 * (xx - ux * ux + yy - uy * uy) + 0.0009))), 6) + 0.0::DOUBLE AS score
FROM m GROUP BY sample_idx"""


@query("measure_ssim", _SSIM)
def measure_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(filters.ssim(filters.pixel_rows(vector_pairs(spark, sf_dir)), ["sample_idx"], 3), "score")


_SIDE = 40
_MOSAIC = f"WITH {VECTOR_PIXELS}, {mosaic_pixels(_SIDE // 8)}"
_MIRROR = "CASE WHEN {a} < 0 THEN -1 - ({a}) WHEN {a} >= %d THEN %d - ({a}) ELSE {a} END" % (_SIDE, 2 * _SIDE - 1)


def _sql_ssim(win: int) -> str:
    """By sums of rows and then of columns, whose mirrored places are joined to."""
    r, unbiased = win // 2, win * win / (win * win - 1)
    mean = lambda of: ", ".join(f"sum({c}) / {win} AS {c}" for c in ("a", "b", "aa", "bb", "ab"))
    near = lambda axis: _MIRROR.format(a=f"{axis} + d")
    return f"""o{win}(d) AS (SELECT unnest(range({-r}, {r + 1}))),
r{win} AS (SELECT p.sample_idx, p.y, p.x, {mean("q")} FROM (SELECT sample_idx, y, x, {near("y")} AS at FROM mo, o{win}) p JOIN m q ON q.sample_idx = p.sample_idx AND q.x = p.x AND q.y = p.at GROUP BY ALL),
c{win} AS (SELECT p.sample_idx, p.y, p.x, {mean("q")} FROM (SELECT sample_idx, y, x, {near("x")} AS at FROM mo, o{win}) p JOIN r{win} q ON q.sample_idx = p.sample_idx AND q.y = p.y AND q.x = p.at GROUP BY ALL),
s{win} AS (SELECT sample_idx, {win}::INT AS win, round(avg((2 * a * b + 0.0001) * (2 * {unbiased} * (ab - a * b) + 0.0009) / ((a * a + b * b + 0.0001) * ({unbiased} * (aa - a * a + bb - b * b) + 0.0009))), 6) + 0.0::DOUBLE AS score FROM c{win} GROUP BY sample_idx)"""


_WINDOWS = (7, 31)


@query("measure_ssim_windows", f"{_MOSAIC}, m AS (SELECT sample_idx, y, x, src AS a, trg AS b, src * src AS aa, trg * trg AS bb, src * trg AS ab FROM mo), {', '.join(map(_sql_ssim, _WINDOWS))} " + " UNION ALL ".join(f"SELECT * FROM s{w}" for w in _WINDOWS))
def measure_ssim_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search's windows, on images of 25 vectors each."""
    px = mosaics(spark, sf_dir, _SIDE // 8)
    found = [filters.ssim(px, ["sample_idx"], w).select("sample_idx", F.lit(w).alias("win"), "score") for w in _WINDOWS]
    return rounded(found[0].union(found[1]), "score")


_MASKED = f"WITH {VECTOR_PIXELS}, {_MOMENTS.format(where='WHERE (i + sample_idx) % 3 > 0')} SELECT sample_idx, round({_NCC}, 6) + 0.0::DOUBLE AS score FROM px JOIN g USING (sample_idx) WHERE (i + sample_idx) % 3 > 0 GROUP BY sample_idx"


@query("measure_masked", _MASKED)
def measure_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((i + F.col("sample_idx")) % 3 > 0).cast("int"))
    pairs = vector_pairs(spark, sf_dir).withColumn("mask", mask)
    return rounded(pairs.select("sample_idx", pixels.ncc(pixels.masked(F.col("src"), F.col("mask")), pixels.masked(F.col("trg"), F.col("mask"))).alias("score")), "score")


@query("mask_fill", f"WITH {VECTOR_PIXELS} SELECT sample_idx, round(sum(CASE WHEN (i + sample_idx) % 3 > 0 THEN x ELSE 0.5 END), 6) AS total FROM px GROUP BY sample_idx")
def mask_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((i + F.col("sample_idx")) % 3 > 0).cast("int"))
    filled = pixels.mask_filled(F.col("src"), mask, 0.5)
    return vector_pairs(spark, sf_dir).select("sample_idx", F.round(F.aggregate(filled, F.lit(0.0), lambda t, v: t + v), 6).alias("total"))


@query("measure_custom_distance", f"WITH {VECTOR_PIXELS} SELECT sample_idx, round(-avg(abs(x - y)), 6) + 0.0::DOUBLE AS score FROM px GROUP BY sample_idx")
def measure_custom_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = registry.Registry(())
    difference = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda t, v: t + v) / F.size(x)
    own.register("mean_difference", channel_modes=("gray",), column=difference, higher_is_better=False)
    return rounded(scores.score_pairs(vector_pairs(spark, sf_dir), own.chosen(), {f: (False,) for f in registry.SEARCH}).select("sample_idx", "score"), "score")


@query("measure_fsim")
def measure_fsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kernel_scores(spark, sf_dir, "fsim", kernels.fsim)


@query("measure_fsimc")
def measure_fsimc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kernel_scores(spark, sf_dir, "fsimc", kernels.fsim, chromatic=True)


_LARGE = 21
_KERNEL = filters.gaussian_weights(11, 1.5)


def _sql_ms_ssim() -> str:
    """Levels of means of 2 x 2 pixels; sums by weights over the places whose whole window is inside."""
    weights = ", ".join(f"({d}, {w!r}::DOUBLE)" for d, w in zip(range(-5, 6), _KERNEL, strict=True))
    sums = ", ".join(f"sum({c} * w) AS {c}" for c in ("a", "b", "aa", "bb", "ab"))
    ctes, side = [f"k(d, w) AS (VALUES {weights})", "l0 AS (SELECT sample_idx, y, x, src AS a, trg AS b FROM mo)"], 8 * _LARGE
    for n, weight in enumerate(kernels.SCALES):
        if n:
            ctes.append(f"l{n} AS (SELECT sample_idx, y // 2 AS y, x // 2 AS x, avg(a) AS a, avg(b) AS b FROM l{n - 1} GROUP BY ALL)")
            side = -(-side // 2)
        ctes.append(f"m{n} AS (SELECT *, a * a AS aa, b * b AS bb, a * b AS ab FROM l{n})")
        ctes.append(f"r{n} AS (SELECT sample_idx, q.y - d AS y, x, {sums} FROM m{n} q, k WHERE q.y - d BETWEEN 5 AND {side - 6} GROUP BY ALL)")
        ctes.append(f"c{n} AS (SELECT sample_idx, y, q.x - d AS x, {sums} FROM r{n} q, k WHERE q.x - d BETWEEN 5 AND {side - 6} GROUP BY ALL)")
        near = "(2 * a * b + 0.0001) / (a * a + b * b + 0.0001) * " if n == len(kernels.SCALES) - 1 else ""
        ctes.append(f"p{n} AS (SELECT sample_idx, greatest(avg({near}(2 * (ab - a * b) + 0.0009) / (aa - a * a + bb - b * b + 0.0009)), 0) ** {weight} AS p{n} FROM c{n} GROUP BY sample_idx)")
    product = " * ".join(f"p{n}" for n in range(len(kernels.SCALES)))
    joins = " ".join(f"JOIN p{n} USING (sample_idx)" for n in range(1, len(kernels.SCALES)))
    return f"WITH {VECTOR_PIXELS}, {mosaic_pixels(_LARGE)}, {', '.join(ctes)} SELECT sample_idx, round({product}, 6) + 0.0::DOUBLE AS score FROM p0 {joins}"


@query("measure_ms_ssim", _sql_ms_ssim())
def measure_ms_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On images of 441 vectors each, 168 x 168 pixels."""
    return rounded(filters.ms_ssim(mosaics(spark, sf_dir, _LARGE), ["sample_idx"]), "score")


def _placed_sum(px: DataFrame, value: str) -> DataFrame:
    """A sum in which every place of an image counts differently."""
    place = F.col("y") * F.col("width") + F.col("x") + 1
    return rounded(px.groupBy("sample_idx").agg(F.sum(F.col(value) * place).cast("double").alias("score")), "score")


_PLANE = ["sample_idx", "c"]


def _vector_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.pixel_rows(vector_pairs(spark, sf_dir))


_MEDIAN = f"""WITH {VECTOR_PIXELS}, o(d) AS (VALUES (-2), (-1), (0), (1), (2)),
m AS (SELECT p.sample_idx, p.i, median(q.x) AS v FROM px p, o r, o c, px q WHERE q.sample_idx = p.sample_idx AND q.i = least(greatest(p.i // 8 + r.d, 0), 7) * 8 + least(greatest(p.i % 8 + c.d, 0), 7) GROUP BY ALL)
SELECT sample_idx, round(sum(v * (i + 1)), 6) + 0.0::DOUBLE AS score FROM m GROUP BY sample_idx"""
QUERIES["median5"], SQL["median5"] = lambda s, d: _placed_sum(filters.median_smoothed(_vector_pixels(s, d), _PLANE, ["src"]), "src"), _MEDIAN

_GAUSS = f"""WITH {VECTOR_PIXELS}, o(d) AS (VALUES (-2), (-1), (0), (1), (2)), k AS (SELECT d, exp(-0.5 * (d / 1.1) ** 2) / (SELECT sum(exp(-0.5 * (d / 1.1) ** 2)) FROM o) AS w FROM o),
m AS (SELECT p.sample_idx, p.i, sum(q.x * r.w * c.w) AS v FROM px p, k r, k c, px q WHERE q.sample_idx = p.sample_idx AND q.i = least(greatest(p.i // 8 + r.d, 0), 7) * 8 + least(greatest(p.i % 8 + c.d, 0), 7) GROUP BY ALL)
SELECT sample_idx, round(sum(v * (i + 1)), 6) + 0.0::DOUBLE AS score FROM m GROUP BY sample_idx"""
QUERIES["gaussian5"], SQL["gaussian5"] = lambda s, d: _placed_sum(filters.gaussian_smoothed(_vector_pixels(s, d), _PLANE, ["src"]), "src"), _GAUSS

_WHITE = f"""WITH {VECTOR_PIXELS}, t AS (SELECT sample_idx, quantile_cont(x * 255, 0.8) - 5 AS t FROM px GROUP BY sample_idx)
SELECT sample_idx, sum(CASE WHEN x * 255 < t THEN i + 1 ELSE 0 END)::DOUBLE AS score FROM px JOIN t USING (sample_idx) GROUP BY sample_idx"""
QUERIES["nonwhite_mask"], SQL["nonwhite_mask"] = lambda s, d: _placed_sum(filters.below_threshold(_vector_pixels(s, d).withColumn("src", F.col("src") * 255), ["sample_idx"], "src"), "mask"), _WHITE

_MATCH = f"""WITH {VECTOR_PIXELS}, s AS (SELECT sample_idx, x, any_value(cum) AS q FROM (SELECT sample_idx, x, count(*) OVER (PARTITION BY sample_idx ORDER BY x) / 64.0 AS cum FROM px) GROUP BY sample_idx, x),
t AS (SELECT sample_idx, y, any_value(cum) AS q FROM (SELECT sample_idx, y, count(*) OVER (PARTITION BY sample_idx ORDER BY y) / 64.0 AS cum FROM px) GROUP BY sample_idx, y),
f AS (SELECT s.sample_idx, s.x, any_value(s.q) AS q, max(t.q) FILTER (WHERE t.q <= s.q) AS q0, min(t.q) FILTER (WHERE t.q >= s.q) AS q1, max(t.y) FILTER (WHERE t.q <= s.q) AS y0, min(t.y) FILTER (WHERE t.q >= s.q) AS y1
  FROM s JOIN t USING (sample_idx) GROUP BY s.sample_idx, s.x),
h AS (SELECT sample_idx, x, CASE WHEN y0 IS NULL THEN y1 WHEN q1 = q0 THEN y1 ELSE y0 + (q - q0) / (q1 - q0) * (y1 - y0) END AS v FROM f)
SELECT sample_idx, round(sum(v * (i + 1)), 6) + 0.0::DOUBLE AS score FROM px JOIN h USING (sample_idx, x) GROUP BY sample_idx"""
QUERIES["hist_match"], SQL["hist_match"] = lambda s, d: _placed_sum(filters.matched(_vector_pixels(s, d), _PLANE), "src"), _MATCH


# CLAHE of images of 25 vectors: tiles of 5 x 5 pixels.
_TILE = _SIDE // 8
_CLAHE = f"""{_MOSAIC}, e AS (SELECT sample_idx, y, x, floor(least(greatest(src, 0), 1) * 255)::INT AS bin FROM mo),
h AS (SELECT sample_idx, y // {_TILE} AS ty, x // {_TILE} AS tx, bin, count(*) AS n FROM e GROUP BY ALL),
t AS (SELECT DISTINCT sample_idx, ty, tx FROM h),
a AS (SELECT t.*, b.bin, coalesce(n, 0) AS n, greatest(2 * {_TILE * _TILE} // 256, 1) AS most FROM t CROSS JOIN range(256) b(bin) LEFT JOIN h USING (sample_idx, ty, tx, bin)),
x AS (SELECT *, sum(greatest(n - most, 0)) OVER (PARTITION BY sample_idx, ty, tx) AS cut FROM a),
d AS (SELECT *, least(n, most) + cut // 256 + (cut % 256 > 0 AND bin % greatest(256 // greatest(cut % 256, 1), 1) = 0 AND bin // greatest(256 // greatest(cut % 256, 1), 1) < cut % 256)::INT AS m FROM x),
l AS (SELECT sample_idx, ty, tx, bin, least(greatest(round_even(sum(m) OVER (PARTITION BY sample_idx, ty, tx ORDER BY bin) * 255 / {_TILE * _TILE}, 0), 0), 255) AS v FROM d),
g AS (SELECT *, y / {_TILE} - 0.5 AS fy, x / {_TILE} - 0.5 AS fx FROM e),
q AS (SELECT sample_idx, y, x, bin, fy - floor(fy) AS fy, fx - floor(fx) AS fx, least(greatest(floor(fy), 0), 7)::BIGINT AS y0, least(greatest(floor(fy) + 1, 0), 7)::BIGINT AS y1,
  least(greatest(floor(fx), 0), 7)::BIGINT AS x0, least(greatest(floor(fx) + 1, 0), 7)::BIGINT AS x1 FROM g),
o AS (SELECT q.sample_idx, y, x, round_even((a.v * (1 - fx) + b.v * fx) * (1 - fy) + (c.v * (1 - fx) + d.v * fx) * fy, 0) / 255 AS v
  FROM q {' '.join(f'JOIN l {n} ON {n}.sample_idx = q.sample_idx AND {n}.bin = q.bin AND {n}.ty = y{i} AND {n}.tx = x{j}' for n, i, j in zip('abcd', (0, 0, 1, 1), (0, 1, 0, 1), strict=True))})
SELECT sample_idx, round(sum(v * (y * {_SIDE} + x + 1)), 6) + 0.0::DOUBLE AS score FROM o GROUP BY sample_idx"""
QUERIES["clahe"], SQL["clahe"] = lambda s, d: _placed_sum(filters.clahe(mosaics(s, d, _SIDE // 8), _PLANE, "src"), "src"), _CLAHE

_DENSITY = "ln(greatest({v}, 1e-6)) / ln(1e-6)"
_HED = f"""WITH {VECTOR_PIXELS}, p AS (SELECT sample_idx, i, greatest({' + '.join(f'{_DENSITY.format(v=v)} * {k!r}' for v, k in zip(('x', 'y', '(1 - x)'), np.linalg.inv(kernels.STAINS)[:, 0].tolist(), strict=True))}, 0) AS part FROM px),
t AS (SELECT sample_idx, quantile_cont(part, 0.99) AS top FROM p GROUP BY sample_idx)
SELECT sample_idx, round(sum((1 - CASE WHEN top > 0 THEN least(part / top, 1) ELSE 0 END) * (i + 1)), 6) + 0.0::DOUBLE AS score FROM p JOIN t USING (sample_idx) GROUP BY sample_idx"""
QUERIES["hed_channel"], SQL["hed_channel"] = lambda s, d: _placed_sum(filters.hematoxylin(_vector_pixels(s, d), ["sample_idx"], F.col("src"), F.col("trg"), 1 - F.col("src")), "stain"), _HED


_CROSS = f"""WITH {VECTOR_PIXELS}, f(flip) AS (VALUES (0), (1)), n(norm) AS (VALUES (0), (1)),
w AS (SELECT sample_idx, norm, flip, CASE flip WHEN 1 THEN 1 - x / (1 + 1e-8 * norm) ELSE x / (1 + 1e-8 * norm) END AS x, CASE flip WHEN 1 THEN 1 - y / (1 + 1e-8 * norm) ELSE y / (1 + 1e-8 * norm) END AS y FROM px, f, n),
g AS (SELECT sample_idx, norm, flip, avg(x) AS mx, avg(y) AS my, (stddev_samp(x) + 1e-8) * (stddev_samp(y) + 1e-8) * 63 AS d FROM w GROUP BY ALL)
SELECT sample_idx, 'ncc' AS metric, (norm * 2 + flip)::INT AS cfg_ordinal, round(sum((x - mx) * (y - my)) / any_value(d), 5) + 0.0::DOUBLE AS score FROM w JOIN g USING (sample_idx, norm, flip) GROUP BY sample_idx, norm, flip
UNION ALL SELECT sample_idx, 'psnr', (norm * 2 + flip)::INT, round(-10 * log10(avg((x - y) ** 2)), 5) + 0.0::DOUBLE FROM w GROUP BY sample_idx, norm, flip"""


@query("score_cross_join", _CROSS)
def score_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = registry.Registry(())
    own.register("ncc", channel_modes=("gray",), column=pixels.ncc)
    own.register("psnr", channel_modes=("gray",), column=pixels.psnr)
    search = {f: (False, True) if f in ("normalization", "flip_intensity") else (False,) for f in registry.SEARCH}
    return scores.score_pairs(vector_pairs(spark, sf_dir), own.chosen(), search).withColumn("score", F.round("score", 5) + 0.0)


# Folds and nested cross-validation.
_OUTER = f"o AS (SELECT DISTINCT pname, {oracle.hashed_fold(str(SEED), 5)} AS fold FROM c)"
_STRATIFIED = f"WITH RECURSIVE {ORDER_SAMPLES}, w AS (SELECT 0 AS one, pname, class3 FROM c), {oracle.stratified_folds('w', 'one', str(SEED), 5, 'o')}"
_STRATIFIED_INNER = (
    f"{_STRATIFIED}, tr AS (SELECT v.outer_fold, c.pname, c.class3 FROM c JOIN o USING (pname), (VALUES (0), (1), (2), (3), (4)) v(outer_fold) WHERE fold <> v.outer_fold), "
    + oracle.stratified_folds("tr", "outer_fold", f"({SEED} + outer_fold)", 4, "k")
)
_INNER_STATS = f"""{_STRATIFIED_INNER},
x AS (SELECT outer_fold, metric, cfg_ordinal, fold AS inner_fold, class3, expert_score, score FROM c JOIN k USING (pname) JOIN s USING (sample_idx)), {oracle.statistics('x', 'outer_fold, metric, cfg_ordinal, inner_fold')},
r AS (SELECT outer_fold, metric, cfg_ordinal, avg(spearman_class3) AS inner_sp_mean, stddev_samp(spearman_class3) AS inner_sp_std, avg(auc_bad_vs_rest) AS inner_auc_bad_mean, stddev_samp(auc_bad_vs_rest) AS inner_auc_bad_std
  FROM st GROUP BY ALL),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY outer_fold, metric ORDER BY round(inner_sp_mean, 9) DESC NULLS LAST, round(inner_auc_bad_mean, 9) DESC NULLS LAST, cfg_ordinal) = 1),
oof AS (SELECT sample_idx, metric, fold, cfg_ordinal, score AS similarity_score FROM c JOIN o USING (pname) JOIN b ON b.outer_fold = fold JOIN s USING (sample_idx, metric, cfg_ordinal))
"""
_INNER_COLUMNS = ("inner_sp_mean", "inner_sp_std", "inner_auc_bad_mean", "inner_auc_bad_std")


def _order_cv(spark: SparkSession, sf_dir: str):
    samples = order_samples(spark, sf_dir)
    outer, inner = folds.nested_folds(samples, SEED)
    return samples, order_scores(samples), outer, nested_cv.inner_results(order_scores(samples), samples, inner)


def _order_oof(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    samples, found, outer, results = _order_cv(spark, sf_dir)
    return samples, nested_cv.out_of_fold(found, samples, outer, nested_cv.select_best(results))


@query("hashed_folds", f"WITH {ORDER_SAMPLES}, {_OUTER} SELECT pname, fold FROM o")
def hashed_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.hashed_folds(order_samples(spark, sf_dir), 5, SEED)


@query("outer_folds", f"{_STRATIFIED} SELECT pname, fold FROM o")
def outer_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.nested_folds(order_samples(spark, sf_dir), SEED)[0]


@query("inner_folds", f"{_STRATIFIED_INNER} SELECT outer_fold, pname, fold FROM k")
def inner_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.nested_folds(order_samples(spark, sf_dir), SEED)[1]


@query("fold_report", f"{_STRATIFIED} SELECT fold, count(*) AS n_rows, count(DISTINCT pname) AS n_groups FROM c JOIN o USING (pname) GROUP BY fold")
def fold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = order_samples(spark, sf_dir)
    return folds.fold_report(samples, folds.nested_folds(samples, SEED)[0])


@query("inner_cv_summary", _INNER_STATS + f"SELECT outer_fold, metric, cfg_ordinal, {sql_rounded(*_INNER_COLUMNS)} FROM r")
def inner_cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_order_cv(spark, sf_dir)[3], *_INNER_COLUMNS)


@query("select_best", _INNER_STATS + f"SELECT outer_fold, metric, cfg_ordinal, {sql_rounded(*_INNER_COLUMNS)} FROM b")
def select_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nested_cv.select_best(_order_cv(spark, sf_dir)[3]), *_INNER_COLUMNS)


@query("oof_predictions", _INNER_STATS + "SELECT * FROM oof")
def oof_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_oof(spark, sf_dir)[1]


@query("oof_rank_norm", _INNER_STATS + f"SELECT sample_idx, metric, fold, cfg_ordinal, round(CASE WHEN count(*) OVER (PARTITION BY metric, fold) > 1 THEN ({oracle.average_rank('similarity_score', 'metric, fold')} - 1) / (count(*) OVER (PARTITION BY metric, fold) - 1) ELSE similarity_score END, 6) + 0.0::DOUBLE AS similarity_score FROM oof")
def oof_rank_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.rank_normalised(_order_oof(spark, sf_dir)[1], ["metric", "fold"]), "similarity_score")


_OOF_STATS = _INNER_STATS.rstrip() + f", e AS (SELECT metric, class3, expert_score, similarity_score AS score FROM oof JOIN c USING (sample_idx)), {oracle.statistics('e', 'metric', 'ev')}"


@query("oof_evaluate", _OOF_STATS + f" SELECT metric, n, {sql_rounded(*ranks.STATISTICS)} FROM ev")
def oof_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, oof = _order_oof(spark, sf_dir)
    return rounded(nested_cv.evaluate_oof(oof, samples), *ranks.STATISTICS)


# Bootstrap.
N_BOOT, BOOT_SEED = 20, 143
_DRAWS = f"""gr AS (SELECT pname, row_number() OVER (ORDER BY pname) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT pname FROM c)),
dr AS (SELECT b.boot::INT AS boot, ('0x' || substr(md5('{BOOT_SEED}:' || b.boot || ':' || j.place), 1, 8))::BIGINT % n AS place FROM range({N_BOOT}) b(boot), gr j),
dw AS (SELECT boot, pname FROM dr JOIN gr USING (place))"""


@query("bootstrap_draws", f"WITH {ORDER_SAMPLES}, {_DRAWS} SELECT boot, pname, count(*) AS times FROM dw GROUP BY boot, pname")
def bootstrap_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.group_draws(order_samples(spark, sf_dir), N_BOOT, BOOT_SEED)


_FULL = tuple(f"full_{s}" for s in ranks.STATISTICS)
_BOOT_COLUMNS = ("bs_sp_mean", "bs_sp_std", "bs_auc_bad_mean", "bs_auc_bad_std", "bs_auc_good_mean", "bs_auc_ovo_mean")
_BOOT_SHORT = (("sp", "spearman_class3"), ("auc_bad", "auc_bad_vs_rest"), ("auc_good", "auc_good_vs_rest"), ("auc_ovo", "auc_3class_ovo"))


@query(
    "bootstrap_ci",
    f"WITH {ORDER_SAMPLES}, {_DRAWS}, x AS (SELECT metric, boot, class3, expert_score, score FROM c JOIN s USING (sample_idx) JOIN dw USING (pname) WHERE cfg_ordinal = 0), {oracle.statistics('x', 'metric, boot')}, "
    f"y AS (SELECT metric, class3, expert_score, score FROM c JOIN s USING (sample_idx) WHERE cfg_ordinal = 0), {oracle.statistics('y', 'metric', 'fu')}, "
    "a AS (SELECT metric, " + ", ".join(f"round(avg({c}), 6) + 0.0::DOUBLE AS bs_{n}_mean, round(quantile_cont({c}, 0.025), 3) + 0.0::DOUBLE AS bs_{n}_lo, round(quantile_cont({c}, 0.975), 3) + 0.0::DOUBLE AS bs_{n}_hi" for n, c in _BOOT_SHORT)
    + ", " + ", ".join(f"round(stddev_samp({c}), 6) + 0.0::DOUBLE AS bs_{n}_std" for n, c in _BOOT_SHORT[:2]) + " FROM st GROUP BY metric) "
    + "SELECT a.*, " + ", ".join(f"round({s}, 6) + 0.0::DOUBLE AS full_{s}" for s in ranks.STATISTICS) + f", {N_BOOT}::INT AS n_boot, {BOOT_SEED}::BIGINT AS seed FROM a JOIN fu USING (metric)",
)
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = order_samples(spark, sf_dir)
    oof = order_scores(samples).where("cfg_ordinal = 0").withColumnRenamed("score", "similarity_score")
    return _bootstrapped(oof, samples, N_BOOT)


def _bootstrapped(oof: DataFrame, samples: DataFrame, n_boot: int) -> DataFrame:
    out = rounded(bootstrap.bootstrap(oof, samples, n_boot, BOOT_SEED), *_FULL, *_BOOT_COLUMNS)
    ends = {f"bs_{n}_{e}": F.col(f"bs_{n}_ci.{e}") + 0.0 for n, _ in _BOOT_SHORT for e in ("lo", "hi")}
    return out.withColumns(ends).drop(*(f"bs_{n}_ci" for n, _ in _BOOT_SHORT))


_PAIRS_BELOW = """q AS (SELECT DISTINCT pname AS h, class3 AS b FROM c), y AS (SELECT metric, pname, class3, expert_score, score FROM c JOIN s USING (sample_idx) WHERE cfg_ordinal = 0),
l AS (SELECT metric, y.pname AS g, y.class3, y.expert_score, h, b, sum((y.pname = h AND y.class3 = b)::INT) OVER (PARTITION BY metric, h, b ORDER BY score) - sum((y.pname = h AND y.class3 = b)::INT) OVER (PARTITION BY metric, h, b, score) / 2.0 AS below FROM y, q),
w AS (SELECT metric, score, pname, count(*)::DOUBLE AS w FROM y GROUP BY ALL)
"""
_FORMS_SQL = f"""WITH {ORDER_SAMPLES}, {_PAIRS_BELOW}
SELECT metric, 'U' AS kind, g, class3::DOUBLE AS x, h, b::DOUBLE AS y, NULL AS k, sum(below)::DOUBLE AS u FROM l GROUP BY ALL HAVING sum(below) > 0
UNION ALL SELECT metric, 'V', g, expert_score, h, -1.0, NULL, sum(below)::DOUBLE FROM l GROUP BY ALL HAVING sum(below) > 0
UNION ALL SELECT metric, 'C', pname, class3, NULL, expert_score, NULL, count(*)::DOUBLE FROM y GROUP BY ALL
UNION ALL SELECT metric, 'T', a.pname, -1.0, b.pname, -1.0, d.pname, sum(a.w * b.w * d.w * CASE WHEN a.pname = d.pname THEN 1 WHEN a.pname = b.pname OR b.pname = d.pname THEN 3 ELSE 6 END)
  FROM w a JOIN w b USING (metric, score) JOIN w d USING (metric, score) WHERE a.pname <= b.pname AND b.pname <= d.pname GROUP BY ALL"""


@query("bootstrap_forms", _FORMS_SQL)
def bootstrap_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms of which each replicate is a product, by the names of groups."""
    samples = order_samples(spark, sf_dir)
    oof = order_scores(samples).where("cfg_ordinal = 0").withColumnRenamed("score", "similarity_score")
    placed = bootstrap.numbered_groups(samples)
    out = rank_forms(oof.join(samples, "sample_idx"), placed)
    for column in ("g", "h", "k"):
        named = placed.select(F.col("place").cast("int").alias(column), F.col("pname").alias(f"{column}_name"))
        out = out.join(named, column, "left")
    return out.select("metric", "kind", F.col("g_name").alias("g"), "x", F.col("h_name").alias("h"), "y", F.col("k_name").alias("k"), "u")


#: The job's number of replicates; N_BOOT is that of the queries with SQL.
WHOLE_BOOT = 1000


@query("bootstrap_oof_draws")
def bootstrap_oof_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.group_draws(order_samples(spark, sf_dir), WHOLE_BOOT, BOOT_SEED)


@query("bootstrap_oof")
def bootstrap_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, oof = _order_oof(spark, sf_dir)
    return _bootstrapped(oof, samples, WHOLE_BOOT)


# Whole runs.
def _vector_cv(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pairs = vector_pairs(spark, sf_dir)
    measures = [registry.Measure("ncc", kernels.ncc, ("gray",)), registry.Measure("psnr", kernels.psnr, ("gray",))]
    oof, fold_meta = nested.nested_cv(pairs, pairs.drop("src", "trg"), measures, SEED)
    return oof, fold_meta, pairs.drop("src", "trg")


@query("nested_cv_full")
def nested_cv_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    oof, _, samples = _vector_cv(spark, sf_dir)
    return rounded(nested_cv.evaluate_oof(oof, samples), *ranks.STATISTICS).orderBy(F.desc_nulls_last("spearman_class3"), "metric")


_PLAIN_SCORES = f"""{VECTOR_PIXELS}, {VECTOR_LABELS}, f(flip) AS (VALUES (0), (1)), n(norm) AS (VALUES (0), (1)),
pw AS (SELECT sample_idx, norm, flip, CASE flip WHEN 1 THEN 1 - x / (1 + 1e-8 * norm) ELSE x / (1 + 1e-8 * norm) END AS x, CASE flip WHEN 1 THEN 1 - y / (1 + 1e-8 * norm) ELSE y / (1 + 1e-8 * norm) END AS y FROM px, f, n),
pg AS (SELECT sample_idx, norm, flip, avg(x) AS mx, avg(y) AS my, (stddev_samp(x) + 1e-8) * (stddev_samp(y) + 1e-8) * 63 AS d FROM pw GROUP BY ALL),
s AS (SELECT sample_idx, 'ncc' AS metric, (norm * 2 + flip)::INT AS cfg_ordinal, round(sum((x - mx) * (y - my)) / any_value(d), 7) AS score FROM pw JOIN pg USING (sample_idx, norm, flip) GROUP BY sample_idx, norm, flip
  UNION ALL SELECT sample_idx, 'psnr', (norm * 2 + flip)::INT, round(CASE avg((x - y) ** 2) WHEN 0 THEN 33.0 ELSE -10 * log10(avg((x - y) ** 2)) END, 5) FROM pw GROUP BY sample_idx, norm, flip)"""
_PLAIN_CV = _OOF_STATS.replace(ORDER_SAMPLES, _PLAIN_SCORES)


def _plain_cv(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A search without neighbourhoods, from pixels to out-of-fold statistics: two measures, four configurations each.

    Scores are rounded, so that ties are the same in any engine.
    """
    pairs = vector_pairs(spark, sf_dir)
    own = registry.Registry(())
    own.register("ncc", channel_modes=("gray",), column=lambda x, y: F.round(pixels.ncc(x, y), 7))
    own.register("psnr", channel_modes=("gray",), column=lambda x, y: F.round(pixels.psnr(x, y), 5))
    search = {f: (False, True) if f in ("normalization", "flip_intensity") else (False,) for f in registry.SEARCH}
    samples = pairs.drop("src", "trg")
    oof, meta = nested.nested_cv(pairs, samples, own.chosen(), SEED, search)
    return oof, meta, samples


@query("nested_cv_plain", _PLAIN_CV + f" SELECT metric, n, {sql_rounded(*ranks.STATISTICS)} FROM ev")
def nested_cv_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    oof, _, samples = _plain_cv(spark, sf_dir)
    return rounded(nested_cv.evaluate_oof(oof, samples), *ranks.STATISTICS)


@query("fold_meta_plain", _PLAIN_CV + f" SELECT outer_fold AS fold, metric, cfg_ordinal, cfg_ordinal >= 2 AS normalization, 'gray' AS channel_mode, cfg_ordinal % 2 = 1 AS flip_intensity, {sql_rounded(*_INNER_COLUMNS)} FROM b")
def fold_meta_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_plain_cv(spark, sf_dir)[1], *_INNER_COLUMNS).select("fold", "metric", "cfg_ordinal", "normalization", "channel_mode", "flip_intensity", *_INNER_COLUMNS)


@query("artifact_plain", _PLAIN_CV + " SELECT sample_idx, metric, fold, cfg_ordinal, round(similarity_score, 5) + 0.0::DOUBLE AS similarity_score FROM oof")
def artifact_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions as a committed artifact gives them back."""
    oof, meta, samples = _plain_cv(spark, sf_dir)
    path = new_folder(spark, "artifact")
    save_artifact(path, oof, meta, samples, SEED)
    return load_artifact(spark, path)[0].withColumn("similarity_score", F.round("similarity_score", 5) + 0.0)


def _colour_cv(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The job's default search: four measures on gray and stains, all flags, on pairs of colour images of three vectors each."""
    pairs = colour_search_pairs(spark, sf_dir)
    own = registry.Registry()
    own.register("ssim", kernels.ssim, ("gray", "hed"), {"win_size": (3, 7)}, takes_mask=True)  # 31 exceeds 8 x 8 pixels
    samples = saved(pairs.drop("src", "trg"), "samples")  # else the joins of pairs are made anew for each use
    oof, meta = nested.nested_cv(pairs, samples, own.chosen(["ncc", "psnr", "mi", "ssim"]), SEED)
    return oof, meta, samples


@query("nested_cv_search")
def nested_cv_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    oof, _, samples = _colour_cv(spark, sf_dir)
    return rounded(nested_cv.evaluate_oof(oof, samples), *ranks.STATISTICS).orderBy(F.desc_nulls_last("spearman_class3"), "metric")


@query("fold_meta")
def fold_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_vector_cv(spark, sf_dir)[1], *_INNER_COLUMNS).withColumn("params", scalars.parameter_key(F.col("params")))


@query("config_value_counts", _INNER_STATS + "SELECT metric, cfg_ordinal, count(*) AS n FROM b GROUP BY metric, cfg_ordinal")
def chosen_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = nested_cv.select_best(_order_cv(spark, sf_dir)[3])
    return best.groupBy("metric", "cfg_ordinal").agg(F.count("*").alias("n")).orderBy("metric", F.desc("n"), "cfg_ordinal")


@query("config_report")
def config_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return config_value_counts(_vector_cv(spark, sf_dir)[1])


@query("artifact_roundtrip")
def artifact_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    oof, meta, samples = _vector_cv(spark, sf_dir)
    path = new_folder(spark, "artifact")
    save_artifact(path, oof, meta, samples, SEED)
    return load_artifact(spark, path)[0]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
