"""Neighbourhood operations on pixel rows, as windows and aggregates.

A pixel row has the key of its image, height, width, c (channel), y, x and values.  Rows are dealt out by image once; the windows
of each step then lie within that partitioning, so an image's filters need one shuffle together.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import _TO_XYZ, _WHITE, SCALES, STAINS

C1, C2 = 0.01**2, 0.03**2
_AXES = (("y", "x", "height"), ("x", "y", "width"))


def pixel_rows(pairs: DataFrame, *kept: str, mask: str | None = None) -> DataFrame:
    """sample_idx, height, width, c, y, x, src and trg (and m, of a mask array) of pairs of arrays, dealt out by sample_idx."""
    arrays = [F.col("src").alias("src"), F.col("trg").alias("trg")]
    rows = pairs.select("sample_idx", "height", "width", "channels", *kept, *([F.col(mask).alias("mask")] if mask else []), F.posexplode(F.arrays_zip(*arrays)).alias("i", "p"))
    pixel = F.expr("i div channels").cast("int")
    places = {"c": (F.col("i") % F.col("channels")).cast("int"), "y": F.floor(pixel / F.col("width")).cast("int"), "x": (pixel % F.col("width")).cast("int")}
    if mask:
        places["m"] = F.when(F.col("mask").isNull(), 1).otherwise(F.get("mask", pixel)).cast("int")
    out = rows.withColumns(places).select("sample_idx", "height", "width", *kept, *places, F.col("p.src").cast("double").alias("src"), F.col("p.trg").cast("double").alias("trg"))
    return out.repartition("sample_idx")


def _padded(px: DataFrame, axis: str, size: str, r: int, mirrored: bool) -> DataFrame:
    """px with r more rows at both ends of an axis: the nearest ones in reverse, or the last one again and again."""
    at, n = F.col(axis), F.col(size)
    if mirrored:
        places = F.filter(F.array(at, -1 - at, 2 * n - 1 - at), lambda p: (p >= -r) & (p < n + r))
    else:
        none = F.array().cast("array<int>")
        places = F.concat(F.array(at), F.when(at == 0, F.sequence(F.lit(-r), F.lit(-1))).otherwise(none), F.when(at == n - 1, F.sequence(n, n + (r - 1))).otherwise(none))
    return px.withColumn(axis, F.explode(places)) if r else px


def _inside(axis: str, size: str) -> Column:
    return (F.col(axis) >= 0) & (F.col(axis) < F.col(size))


def box_means(px: DataFrame, keys: list[str], win: int, columns: list[str]) -> DataFrame:
    """px with each column's mean over a square of win x win pixels; borders are mirrored.  Fails if the window exceeds an image."""
    fits = F.assert_true((F.col("height") >= win) & (F.col("width") >= win), F.lit("the window exceeds the image")).isNull()
    px, r = px.where(fits), win // 2
    for axis, other, size in _AXES:
        frame = Window.partitionBy(*keys, other).orderBy(axis).rowsBetween(-r, r)
        px = _padded(px, axis, size, r, True).withColumns({c: F.avg(c).over(frame) for c in columns}).where(_inside(axis, size))
    return px


def weighted_means(px: DataFrame, keys: list[str], weights: list[float], columns: list[str], pad: bool) -> DataFrame:
    """px with each column's sum by separable weights of neighbours; borders are repeated, or without pad left out."""
    r = len(weights) // 2
    for axis, other, size in _AXES:
        line = Window.partitionBy(*keys, other).orderBy(axis)
        summed = {c: sum((F.lag(c, r - k).over(line) * w for k, w in enumerate(weights)), F.lit(0.0)) for c in columns}
        if pad:
            px = _padded(px, axis, size, r, False).withColumns(summed).where(_inside(axis, size))
        else:
            px = px.withColumns(summed).where(F.col(columns[0]).isNotNull())
    return px


def gaussian_weights(size: int, sigma: float) -> list[float]:
    k = np.exp(-0.5 * (np.arange(-(size // 2), size // 2 + 1) / sigma) ** 2)
    return (k / k.sum()).tolist()


def gaussian_smoothed(px: DataFrame, keys: list[str], columns: list[str], size: int = 5) -> DataFrame:
    return weighted_means(px, keys, gaussian_weights(2 * ((size - 1) // 2) + 1, 0.3 * ((size - 1) * 0.5 - 1) + 0.8), columns, True)


def median_smoothed(px: DataFrame, keys: list[str], columns: list[str], size: int = 5) -> DataFrame:
    """px with each column's median over size x size pixels; borders are repeated."""
    r = size // 2
    for axis, other, length in _AXES:
        frame = Window.partitionBy(*keys, other).orderBy(axis).rowsBetween(-r, r)
        px = _padded(px, axis, length, r, False).withColumns({c: F.collect_list(c).over(frame) for c in columns}).where(_inside(axis, length))
    return px.withColumns({c: F.sort_array(F.flatten(c))[(2 * r + 1) ** 2 // 2] for c in columns})


def _moments(px: DataFrame) -> DataFrame:
    s, t = F.col("src"), F.col("trg")
    return px.withColumns({"ss": s * s, "tt": t * t, "st": s * t})


_MOMENTS = ["src", "trg", "ss", "tt", "st"]


def _structure(scale: float) -> tuple[Column, Column]:
    """Similarity of means, and of spreads, of a pixel's neighbourhood; scale: of its variances."""
    a, b = F.col("src"), F.col("trg")
    both, own = scale * (F.col("st") - a * b), scale * (F.col("ss") - a * a + F.col("tt") - b * b)
    return (2 * a * b + C1) / (a * a + b * b + C1), (2 * both + C2) / (own + C2)


def ssim(px: DataFrame, image: list[str], win: int = 7) -> DataFrame:
    """image and score: the mean of the structural-similarity map, over pixels whose mask m is 1 if px has one."""
    near, alike = _structure(win**2 / (win**2 - 1))
    found = box_means(_moments(px), [*image, "c"], win, _MOMENTS)
    value = F.avg(F.when(F.col("m") == 1, near * alike)) if "m" in px.columns else F.avg(near * alike)
    return found.groupBy(*image).agg(value.alias("score"))


def ms_ssim(px: DataFrame, image: list[str], size: int = 11, sigma: float = 1.5) -> DataFrame:
    """image and score, over five scales of means of 2 x 2 pixels; sides need (size - 1) * 16 + 1 pixels."""
    least, keys, weights = (size - 1) * 2 ** (len(SCALES) - 1) + 1, [*image, "c"], gaussian_weights(size, sigma)
    fits = F.assert_true((F.col("height") >= least) & (F.col("width") >= least), F.lit("the images are too small for five scales")).isNull()
    px, scales = px.where(fits), None
    for n, weight in enumerate(SCALES):
        if n:
            half = {a: F.floor(F.col(a) / 2).cast("int") for a in ("y", "x")}
            px = px.withColumns(half).groupBy(*keys, "y", "x").agg(F.avg("src").alias("src"), F.avg("trg").alias("trg"))
        near, alike = _structure(1.0)
        value = near * alike if n == len(SCALES) - 1 else alike
        means = weighted_means(_moments(px), keys, weights, _MOMENTS, False).groupBy(*keys).agg(F.avg(value).alias("mean"))
        power = means.select(*keys, F.pow(F.greatest("mean", F.lit(0.0)), F.lit(weight)).alias("power"))
        scales = power if scales is None else scales.union(power)
    return scales.groupBy(*keys).agg(F.product("power").alias("power")).groupBy(*image).agg(F.avg("power").alias("score"))


def matched(px: DataFrame, keys: list[str]) -> DataFrame:
    """px with src's values replaced by those at their places in the distribution of trg, interpolated.

    Shares of both sides' values are merged in their order, and each of src's takes the last of trg's before and the first
    after it.
    """

    def shares(column: str) -> DataFrame:
        counts = px.groupBy(*keys, F.col(column).alias("v")).agg(F.count("*").alias("n"))
        by = Window.partitionBy(*keys)
        return counts.select(*keys, "v", (F.sum("n").over(by.orderBy("v")) / F.sum("n").over(by)).alias("q"))

    none = F.lit(None).cast("double")
    rows = shares("src").select(*keys, "q", F.col("v").alias("own"), none.alias("at"), none.alias("to")).union(shares("trg").select(*keys, "q", none, "q", "v"))
    up, down = (Window.partitionBy(*keys).orderBy(q, F.col("own").asc_nulls_first()) for q in (F.col("q"), F.col("q").desc()))
    last = lambda c, w: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumns({"q0": last("at", up), "v0": last("to", up), "q1": last("at", down), "v1": last("to", down)}).where("own is not null")
    share = (F.col("q") - F.col("q0")) / (F.col("q1") - F.col("q0"))
    value = F.when(F.col("q0").isNull() | (F.col("q0") == F.col("q1")), F.col("v1")).when(F.col("q1").isNull(), F.col("v0")).otherwise(F.col("v0") + share * (F.col("v1") - F.col("v0")))
    return px.join(found.select(*keys, F.col("own").alias("src"), value.alias("matched")), [*keys, "src"]).drop("src").withColumnRenamed("matched", "src")


def below_threshold(px: DataFrame, image: list[str], value: str, threshold: float | None = None, percentile: float = 0.8, buffer: float = 5) -> DataFrame:
    """px with mask: 1 where the value is below the threshold, or below the image's percentile less a buffer."""
    if threshold is not None:
        return px.withColumn("mask", (F.col(value) < threshold).cast("int"))
    limit = px.groupBy(*image).agg((F.percentile(value, percentile) - buffer).alias("limit"))
    return px.join(limit, image).withColumn("mask", (F.col(value) < F.col("limit")).cast("int")).drop("limit")


#: What a stain vector's inverse takes of red, green and blue for hematoxylin.
_HEMATOXYLIN = np.linalg.inv(STAINS)[:, 0].tolist()


def hematoxylin(px: DataFrame, image: list[str], r: Column, g: Column, b: Column) -> DataFrame:
    """px with stain: 1 minus the hematoxylin part of a pixel's colours, scaled by its 99th percentile in the image."""
    density = lambda v: F.log(F.greatest(v, F.lit(1e-6))) / math.log(1e-6)
    part = sum((density(v) * k for v, k in zip((r, g, b), _HEMATOXYLIN, strict=True)), F.lit(0.0))
    found = px.withColumn("part", F.greatest(part, F.lit(0.0)))
    top = found.groupBy(*image).agg(F.percentile("part", 0.99).alias("top"))
    scaled = F.when(F.col("top") > 0, F.least(F.col("part") / F.col("top"), F.lit(1.0))).otherwise(0.0)
    return found.join(top, image).withColumn("stain", 1 - scaled).drop("part", "top")


def equalised(px: DataFrame, keys: list[str], value: str, clip: float = 2.0, tiles: int = 8) -> DataFrame:
    """px with a value of whole numbers 0 to 255 equalised by histograms of tiles, with limited contrast.

    Images are padded to whole tiles by mirroring without the last row (by repeating it, if they are too small).  Each tile's
    histogram is cut at the limit, what is cut off is dealt out evenly, and its cumulative counts are a table; a pixel's value is
    interpolated between the tables of the four tiles around it.
    """
    h, w = F.col("height"), F.col("width")
    pad = {"y": F.pmod(-h, F.lit(tiles)), "x": F.pmod(-w, F.lit(tiles))}
    mirrored = F.least(h, w) > F.greatest(pad["y"], pad["x"])
    padded = px.select(*keys, "height", "width", "y", "x", F.col(value).cast("int").alias("bin"))
    for axis, size in (("y", h), ("x", w)):
        at, more = F.col(axis), pad[axis]
        again = F.when(mirrored & (at < size - 1) & (at >= size - 1 - more), F.array(2 * size - 2 - at)).when(~mirrored & (at == size - 1) & (more > 0), F.sequence(size, size + more - 1))
        padded = padded.withColumn(axis, F.explode(F.concat(F.array(at), F.coalesce(again, F.array().cast("array<int>")))))
    deep, wide = ((F.col(s) + pad[a]) / tiles for s, a in (("height", "y"), ("width", "x")))
    tile = (F.floor(F.col("y") / deep) * tiles + F.floor(F.col("x") / wide)).cast("int")
    bins = padded.groupBy(*keys, tile.alias("tile"), (deep * wide).cast("int").alias("area"), "bin").agg(F.count("*").cast("int").alias("n"))
    each = bins.groupBy(*keys, "tile", "area").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("counts"))
    all_bins = F.sequence(F.lit(0), F.lit(255))
    each = each.withColumn("counts", F.transform(all_bins, lambda b: F.coalesce(F.try_element_at("counts", b), F.lit(0))))
    limit = F.greatest(F.floor(clip * F.col("area") / 256), F.lit(1)).cast("int")
    each = each.withColumn("limit", limit).withColumn("cut", F.aggregate("counts", F.lit(0), lambda t, n: t + F.greatest(n - F.col("limit"), F.lit(0))))
    rest, step = F.col("cut") % 256, F.greatest(F.expr("256 div greatest(cut % 256, 1)"), F.lit(1)).cast("int")
    each = each.withColumns({"rest": rest, "step": step})
    dealt = F.transform("counts", lambda n, b: F.least(n, F.col("limit")) + F.expr("cut div 256").cast("int") + ((b % F.col("step") == 0) & (F.floor(b / F.col("step")) < F.col("rest"))).cast("int"))
    table = F.aggregate(dealt, F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1), F.lit(0)) + n)))
    each = each.withColumn("table", F.transform(table, lambda n: F.least(F.greatest(F.rint(n * 255 / F.col("area")), F.lit(0.0)), F.lit(255.0))))
    luts = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("tile", "table"))), lambda t: t["table"]).alias("luts"))

    def between(axis: str, size: Column) -> tuple[Column, Column, Column]:
        at = F.col(axis) / size - 0.5
        low = F.floor(at).cast("int")
        cut = lambda t: F.least(F.greatest(t, F.lit(0)), F.lit(tiles - 1))
        return cut(low), cut(low + 1), at - low

    (y0, y1, fy), (x0, x1, fx) = between("y", deep), between("x", wide)
    places = {"y0": y0, "y1": y1, "fy": fy, "x0": x0, "x1": x1, "fx": fx}
    at = lambda y, x: F.get(F.get("luts", F.col(y) * tiles + F.col(x)), F.col(value).cast("int"))
    row = lambda y: at(y, "x0") * (1 - F.col("fx")) + at(y, "x1") * F.col("fx")
    out = px.join(luts, keys).withColumns(places)
    return out.withColumn(value, F.rint(row("y0") * (1 - F.col("fy")) + row("y1") * F.col("fy"))).drop("luts", *places)


def clahe(px: DataFrame, keys: list[str], value: str) -> DataFrame:
    """px with a value from 0 to 1 of one channel equalised in 256 steps."""
    eight = F.floor(F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(1.0)) * 255)
    return equalised(px.withColumn(value, eight), keys, value).withColumn(value, F.col(value) / 255)


def _products(columns: list[Column], table: np.ndarray) -> list[Column]:
    return [sum((c * float(k) for c, k in zip(columns, row, strict=True)), F.lit(0.0)) for row in table]


def clahe_rgb(px: DataFrame, image: list[str], r: str, g: str, b: str) -> DataFrame:
    """px with one row for each pixel and its colours in three columns, of which the lightness is equalised."""
    linear = lambda v: F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, 2.4)).otherwise(v / 12.92)
    eight = [F.floor(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) * 255) / 255 for c in (r, g, b)]
    px = px.withColumns({f"_{k}": linear(v) for k, v in enumerate(eight)})
    xyz = _products([F.col(f"_{k}") for k in range(3)], _TO_XYZ / _WHITE[:, None])
    px = px.withColumns({f"_t{k}": v for k, v in enumerate(xyz)})
    cube = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)
    px = px.withColumns({f"_f{k}": cube(F.col(f"_t{k}")) for k in range(3)})
    light = F.when(F.col("_t1") > 0.008856, 116 * F.col("_f1") - 16).otherwise(903.3 * F.col("_t1"))
    px = px.withColumns({"_light": F.rint(light * 255 / 100), "_a": 500 * (F.col("_f0") - F.col("_f1")), "_b": 200 * (F.col("_f1") - F.col("_f2"))})
    px = equalised(px, image, "_light").withColumn("_fy", (F.col("_light") * 100 / 255 + 16) / 116)
    f = [F.col("_fy") + F.col("_a") / 500, F.col("_fy"), F.col("_fy") - F.col("_b") / 200]
    back = [F.when(v > 6 / 29, F.pow(v, 3.0)).otherwise((v - 16 / 116) / 7.787) for v in f]
    px = px.withColumns({f"_x{k}": v for k, v in enumerate(back)})
    rgb = _products([F.col(f"_x{k}") for k in range(3)], np.linalg.inv(_TO_XYZ) * _WHITE)
    px = px.withColumns({f"_l{k}": F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) for k, v in enumerate(rgb)})
    curve = lambda v: F.when(v > 0.0031308, 1.055 * F.pow(v, 1 / 2.4) - 0.055).otherwise(12.92 * v)
    px = px.withColumns({c: curve(F.col(f"_l{k}")) for k, c in enumerate((r, g, b))})
    return px.drop("_light", "_a", "_b", "_fy", *(f"_{p}{k}" for p in ("", "t", "f", "x", "l") for k in range(3)))
