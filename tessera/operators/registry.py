"""Measures and their search spaces.

A measure is a function of two stacks of preprocessed images (and parameters) that gives one number for each pair.
Users register their own in the same way; a distance is registered with higher_is_better=False and is negated.  A measure
that takes masks gets one as `mask` where the pairs have them; one of whole inputs gets kernels.Inputs in place of two
stacks; one of colours gets stacks of one channel repeated to three.  A measure may also, or only, be a column expression
of two arrays of values, those outside the mask left out; it is planned without Python where its configuration allows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels, pixels
from ..functions.scalars import FLAGS

Kernel = Callable[..., np.ndarray]
CONFIG_SCHEMA = (
    "metric string, cfg_ordinal int, preproc_id int, normalization boolean, channel_mode string, flip_intensity boolean, match_histogram boolean, clahe boolean, smoothing boolean, params map<string,string>"
)


@dataclass(frozen=True)
class Measure:
    name: str
    kernel: Kernel | None
    channel_modes: tuple[str, ...] = ("gray", "hed")
    params: dict[str, tuple] = field(default_factory=dict)
    higher_is_better: bool = True
    learned: bool = False
    takes_mask: bool = False
    takes_inputs: bool = False
    three_channels: bool = False
    column: Callable[..., Column] | None = None

    def expression(self, src: Column, trg: Column, **params) -> Column:
        value = self.column(src, trg, **params)
        return value if self.higher_is_better else -value

    def __call__(self, src: np.ndarray, trg: np.ndarray, mask: np.ndarray | None = None, background: float = 1.0, **params) -> np.ndarray:
        if self.three_channels and src.shape[-1] == 1:
            src, trg = np.repeat(src, 3, axis=-1), np.repeat(trg, 3, axis=-1)
        if self.takes_inputs:
            value = self.kernel(kernels.Inputs(src, trg, mask, background), **params)
        elif mask is not None and self.takes_mask:
            value = self.kernel(src, trg, mask=mask, **params)
        else:
            value = self.kernel(src, trg, **params)
        return value if self.higher_is_better else -value


def _needs_model(name: str) -> Kernel:
    def kernel(src: np.ndarray, trg: np.ndarray, **params) -> np.ndarray:
        raise NotImplementedError(f"{name} needs a learned model: register a measure of this name whose kernel loads one")

    return kernel


_BOTH, _ALL = ("gray", "hed"), ("gray", "hed", "rgb")
_AGGREGATION = {"lpips_aggregation": ("lin", "avg")}
#: The measures, their channel modes and parameters.
BUILT_IN = (
    Measure("ncc", kernels.ncc, _BOTH, takes_mask=True, column=pixels.ncc),
    Measure("psnr", kernels.psnr, _BOTH, takes_mask=True, column=pixels.psnr),
    Measure("mi", kernels.mutual_information, _BOTH, takes_mask=True, column=pixels.mutual_information),
    Measure("ssim", kernels.ssim, _BOTH, {"win_size": (7, 31)}, takes_mask=True),
    Measure("ms-ssim", kernels.ms_ssim, _BOTH, takes_mask=True),
    Measure("fsim", kernels.fsim, _BOTH),
    Measure("fsimc", lambda x, y: kernels.fsim(x, y, chromatic=True), ("rgb",)),
    Measure("lpips_alex", _needs_model("lpips_alex"), _ALL, _AGGREGATION, False, True, three_channels=True),
    Measure("lpips_vgg", _needs_model("lpips_vgg"), _ALL, _AGGREGATION, False, True, three_channels=True),
    Measure("lpips_squeeze", _needs_model("lpips_squeeze"), _ALL, _AGGREGATION, False, True, three_channels=True),
    Measure("dists", _needs_model("dists"), _ALL, {}, False, True, three_channels=True),
)
#: The values of each flag, in the order of the search; channel modes come from the measure.
SEARCH = {flag: (False, True) for flag in FLAGS if flag != "channel_mode"}


class Registry(dict):
    """Measures by name, in the order of registration."""

    def __init__(self, measures=BUILT_IN):
        super().__init__((m.name, m) for m in measures)

    def register(self, name: str, kernel: Kernel | None = None, channel_modes=("rgb",), params: dict | None = None, higher_is_better: bool = True, column: Callable[..., Column] | None = None, **takes: bool) -> Measure:
        """takes: takes_mask, takes_inputs or three_channels, as in Measure.  A kernel, a column or both must be given."""
        if kernel is None and column is None:
            raise ValueError(f"{name} has neither a kernel nor a column")
        self[name] = Measure(name, kernel, tuple(channel_modes), {k: tuple(v) for k, v in (params or {}).items()}, higher_is_better, column=column, **takes)
        return self[name]

    def chosen(self, names: list[str] | None = None) -> list[Measure]:
        unknown = [n for n in names or [] if n not in self]
        if unknown:
            raise KeyError(f"unknown measures: {', '.join(unknown)}")
        return [self[n] for n in names or self]

    def learned(self, names: list[str] | None = None) -> list[str]:
        return [m.name for m in self.chosen(names) if m.learned]


def config_rows(measures: list[Measure], search: dict[str, tuple] | None = None) -> list[tuple]:
    """Rows of CONFIG_SCHEMA: for each measure the product of all flags and parameters, the last one running fastest.

    Configurations with equal flags share a preproc_id, whatever their measure.
    """
    search, preproc, out = search or SEARCH, {}, []
    for m in measures:
        axes = [m.channel_modes if f == "channel_mode" else search[f] for f in FLAGS]
        for n, values in enumerate(product(*axes, *m.params.values())):
            flags = values[: len(FLAGS)]
            params = {k: str(v) for k, v in zip(m.params, values[len(FLAGS) :], strict=True)}
            out.append((m.name, n, preproc.setdefault(flags, len(preproc)), *flags, params))
    return out


def config_grid(spark: SparkSession, measures: list[Measure], search: dict[str, tuple] | None = None) -> DataFrame:
    """The configurations of all measures; cfg_ordinal counts from 0 for each measure."""
    return spark.createDataFrame(config_rows(measures, search), CONFIG_SCHEMA)


def identities(spark: SparkSession, measures: list[Measure]) -> DataFrame:
    """ord, metric, channel_modes and params (array of name and values) of measures."""
    rows = [(i, m.name, list(m.channel_modes), [(k, [str(x) for x in v]) for k, v in m.params.items()]) for i, m in enumerate(measures)]
    return spark.createDataFrame(rows, "ord int, metric string, channel_modes array<string>, params array<struct<name:string,values:array<string>>>")


def grid_of(table: DataFrame, search: dict[str, tuple] | None = None) -> DataFrame:
    """The configurations of a table of identities (metric, channel_modes, params), as rows of CONFIG_SCHEMA.

    Each identity has the product of all flags and parameters; a configuration's ordinal is its number with the last one running
    fastest, and its values are the number's digits.  preproc_id numbers the different flags in their order.
    """
    search = search or SEARCH
    size = F.aggregate("params", F.lit(1), lambda n, p: n * F.size(p["values"]))
    sizes = {f: F.size("channel_modes") if f == "channel_mode" else F.lit(len(search[f])) for f in FLAGS}
    after, strides = F.col("size"), {}
    for f in reversed(FLAGS):
        strides[f], after = after, after * sizes[f]
    rows = table.withColumn("size", size).select("metric", "channel_modes", "params", "size", F.explode(F.sequence(F.lit(0), after - 1)).alias("cfg_ordinal"))
    digit = lambda stride, n: F.pmod(F.floor(F.col("cfg_ordinal") / stride), n).cast("int")
    flags = [F.get("channel_modes" if f == "channel_mode" else F.array(*map(F.lit, search[f])), digit(strides[f], sizes[f])).alias(f) for f in FLAGS]
    later = lambda i: F.aggregate(F.slice("params", i + 2, F.size("params")), F.lit(1), lambda n, p: n * F.size(p["values"]))
    params = F.map_from_entries(F.transform("params", lambda p, i: F.struct(p["name"], F.get(p["values"], digit(later(i), F.size(p["values"]))))))
    rows = rows.select("metric", F.col("cfg_ordinal").cast("int").alias("cfg_ordinal"), *flags, params.alias("params"))
    different = rows.select(*FLAGS).distinct()  # as many rows as there are combinations of flags
    numbered = different.withColumn("preproc_id", (F.row_number().over(Window.orderBy(*FLAGS)) - 1).cast("int"))
    return rows.join(numbered, list(FLAGS)).select("metric", "cfg_ordinal", "preproc_id", *FLAGS, "params")


def groups_of(table: DataFrame) -> DataFrame:
    """group_id, channel_modes, key and metrics of identities with equal channel modes and parameters, in the order of ord."""
    key = F.to_json(F.array_sort("params")).alias("key")
    df = table.groupBy("channel_modes", key).agg(F.min("ord").alias("group_id"), F.array_sort(F.collect_list(F.struct("ord", "metric"))).alias("m"))
    return df.select("group_id", "channel_modes", "key", F.col("m.metric").alias("metrics"))


def identity_groups(spark: SparkSession, measures: list[Measure]) -> DataFrame:
    """group_id and metrics of measures with equal channel modes and parameters, in the order of their first one."""
    return groups_of(identities(spark, measures))
