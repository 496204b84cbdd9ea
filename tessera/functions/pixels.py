"""Pixel arrays as column expressions: scaling, channels, and measures that need no neighbourhood."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of red, green and blue in gray.
GRAY = (0.299, 0.587, 0.114)
EPSILON = 1e-8
IDENTICAL_PSNR = 33.0


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda t, v: t + v)


def _with(value: Column, body) -> Column:
    """body(value), with the value worked out once and not in every step of a lambda."""
    return F.transform(F.array(value), body)[0]


def scaled(x: Column) -> Column:
    """To [0, 1] if any value is above 1."""
    return _with(x, lambda a: F.when(F.array_max(a) > 1, F.transform(a, lambda v: v / 255.0)).otherwise(a))


def min_max(x: Column) -> Column:
    ends = F.struct(x.alias("x"), F.array_min(x).alias("low"), F.array_max(x).alias("high"))
    return _with(ends, lambda e: F.transform(e["x"], lambda v: (v - e["low"]) / (e["high"] - e["low"] + EPSILON)))


def flipped(x: Column) -> Column:
    return F.transform(x, lambda v: 1.0 - v)


def clipped(x: Column) -> Column:
    return F.transform(x, lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.zip_with(F.zip_with(r, g, lambda x, y: GRAY[0] * x + GRAY[1] * y), b, lambda x, y: x + GRAY[2] * y)


def of_channels(x: Column, channels: Column, body) -> Column:
    """An array of body(values of a channel), one for each channel of interleaved values."""
    return F.transform(F.sequence(F.lit(0), channels - 1), lambda c: body(F.filter(x, lambda _, i: i % channels == c)))


def preprocessed(x: Column, channels: Column, config: dict) -> Column:
    """Interleaved values under a configuration without neighbourhoods: scaling, min-max by channel, gray of three channels, flip."""
    x = scaled(x)
    if config.get("normalization"):
        ends = F.struct(x.alias("x"), of_channels(x, channels, F.array_min).alias("low"), of_channels(x, channels, F.array_max).alias("high"))
        low = lambda e, i: F.get(e["low"], (i % channels).cast("int"))
        high = lambda e, i: F.get(e["high"], (i % channels).cast("int"))
        x = _with(ends, lambda e: F.transform(e["x"], lambda v, i: (v - low(e, i)) / (high(e, i) - low(e, i) + EPSILON)))
    if config.get("channel_mode") == "gray":
        at = lambda v, p, k: F.get(v, (3 * p + k).cast("int")) * GRAY[k]
        of_three = lambda v: F.transform(F.sequence(F.lit(0), (F.size(v) / 3).cast("int") - 1), lambda p: at(v, p, 0) + at(v, p, 1) + at(v, p, 2))
        x = _with(x, lambda v: F.when(channels == 3, of_three(v)).otherwise(v))
    return flipped(x) if config.get("flip_intensity") else x


#: Flags that look at more than one place of an image, and the channel mode of stains.
def without_neighbourhood(config: dict) -> bool:
    return not any(config.get(f) for f in ("match_histogram", "clahe", "smoothing")) and config.get("channel_mode") != "hed"


def masked(x: Column, mask: Column) -> Column:
    """The values where the mask is 1; all without a mask."""
    return F.when(mask.isNull(), x).otherwise(F.transform(F.filter(F.arrays_zip(x.alias("x"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["x"]))


def mask_filled(x: Column, mask: Column, fill: float) -> Column:
    return F.when(mask.isNull(), x).otherwise(F.zip_with(x, mask, lambda v, m: v * m + fill * (1 - m)))


def ncc(x: Column, y: Column) -> Column:
    """Normalised cross-correlation, with 1e-8 added to each deviation; 0 for one value or none."""
    n = F.size(x)
    means = F.struct(x.alias("x"), y.alias("y"), (_sum(x) / n).alias("mx"), (_sum(y) / n).alias("my"))

    def of(e: Column) -> Column:
        spread = lambda v, m: F.sqrt(_sum(F.transform(e[v], lambda a: (a - e[m]) * (a - e[m]))) / (n - 1)) + EPSILON
        return _sum(F.zip_with(e["x"], e["y"], lambda a, b: (a - e["mx"]) * (b - e["my"]))) / (spread("x", "mx") * spread("y", "my") * (n - 1))

    return F.when(n > 1, _with(means, of)).otherwise(0.0)


def psnr(x: Column, y: Column) -> Column:
    mse = _sum(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))) / F.size(x)
    return F.when(mse == 0, IDENTICAL_PSNR).otherwise(-10 * F.log10(mse))


def bins(x: Column, n: int = 32) -> Column:
    """Equal bins between the smallest and the largest value, which is in the last; of equal values 0.5 to each side."""
    low, high = F.array_min(x), F.array_max(x)
    start = F.when(high > low, low).otherwise(low - 0.5)
    scale = F.struct(x.alias("x"), start.alias("start"), F.when(high > low, high - low).otherwise(1.0).alias("width"))
    return _with(scale, lambda e: F.transform(e["x"], lambda v: F.least(F.floor((v - e["start"]) / e["width"] * n), F.lit(n - 1)).cast("int")))


def _sum_of_logs(codes: Column) -> Column:
    """The sum of n ln n over the numbers n of equal codes, in one pass over the codes in order."""
    log = lambda n: F.when(n > 0, n * F.log(n)).otherwise(0.0)
    start = F.struct(F.lit(-1).alias("code"), F.lit(0.0).alias("n"), F.lit(0.0).alias("total"))
    step = lambda a, c: F.when(a["code"] == c, F.struct(c.alias("code"), (a["n"] + 1.0).alias("n"), a["total"].alias("total"))).otherwise(F.struct(c.alias("code"), F.lit(1.0).alias("n"), (a["total"] + log(a["n"])).alias("total")))
    return F.aggregate(F.array_sort(codes), start, step, lambda a: a["total"] + log(a["n"]))


def mutual_information(x: Column, y: Column, n: int = 32) -> Column:
    """Of both sides' bins: from the numbers of equal bins and of equal pairs of bins."""
    both = F.struct(bins(x, n).alias("x"), bins(y, n).alias("y"))
    size = F.size(x).cast("double")
    value = lambda e: (_sum_of_logs(F.zip_with(e["x"], e["y"], lambda a, b: a * n + b)) - _sum_of_logs(e["x"]) - _sum_of_logs(e["y"])) / size + F.log(size)
    return F.when(size > 0, _with(both, value))
