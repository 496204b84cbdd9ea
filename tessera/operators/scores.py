"""The score table: every pair under every configuration of every measure, computed once."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, pixels
from ..functions.ranks import not_nan
from ..functions.scalars import parameter_key
from .registry import Measure, config_grid, config_rows

PAIR_COLUMNS = ("sample_idx", "height", "width", "channels", "src", "trg")
#: Values of a stack of images that are preprocessed at once.
STACK = 1 << 18
SCORES = "sample_idx long, metric string, cfg_ordinal int, score double"


def _value(text: str):
    try:
        return int(text)
    except ValueError:
        return text


_NAMES = ("normalization", "channel_mode", "flip_intensity", "match_histogram", "clahe", "smoothing")


def score_pairs(pairs: DataFrame, measures: list[Measure], search: dict[str, tuple] | None = None) -> DataFrame:
    """sample_idx, metric, cfg_ordinal and score (null where it is not a number) of all pairs.

    pairs: sample_idx, height, width, channels, and src and trg as arrays of height * width * channels values, or as bytes
    that stand for values from 0 to 1.  A column
    mask, an array of height * width values 0 and 1 or null, is given to the measures that take one, and to those that are
    columns.  Configurations without neighbourhoods of measures that have a column are scored by expressions, unless the measure has
    a kernel too and kernels are needed anyway: arrays in expressions take far longer than one more kernel.  For the rest, a
    batch of pairs is preprocessed once for each set of flags, and all measures that use the set read the result; of a measure
    that is only a column, the preprocessed arrays come back and are scored by its expression.
    """
    by_name, masked, packed = {m.name: m for m in measures}, "mask" in pairs.columns, dict(pairs.dtypes)["src"] == "binary"
    here, kernels_of, arrays_of = defaultdict(list), defaultdict(list), defaultdict(list)
    rows = config_rows(measures, search)
    plain = lambda metric, flags: by_name[metric].column is not None and not packed and pixels.without_neighbourhood(dict(zip(_NAMES, flags, strict=True)))
    anyway = any(by_name[metric].kernel is not None and not plain(metric, flags) for metric, _, _, *flags, _ in rows)
    for metric, ordinal, _, *flags, params in rows:
        m = by_name[metric]
        to = here if plain(metric, flags) and not (anyway and m.kernel is not None) else kernels_of if m.kernel is not None else arrays_of
        to[tuple(flags)].append((metric, ordinal, {k: _value(v) for k, v in params.items()}))
    parts = []
    if here:
        parts.append(_by_columns(pairs, by_name, here, masked))
    if kernels_of:
        parts.append(_by_kernels(pairs, by_name, kernels_of, masked))
    if arrays_of:
        parts.append(_by_arrays(pairs, by_name, arrays_of, masked))
    if not parts:
        return pairs.sparkSession.createDataFrame([], SCORES)
    return reduce(DataFrame.union, parts)


def _scored(measure: Measure, src: Column, trg: Column, mask: Column | None, channels: Column, params: dict) -> Column:
    if mask is not None:  # a mask has a value for each pixel, an array one for each of its channels
        wide = lambda x: F.when(mask.isNull(), x).otherwise(F.filter(x, lambda _, i: F.get(mask, F.floor(i * F.size(mask) / F.size(x)).cast("int")) == 1))
        return pixels._with(F.struct(wide(src).alias("src"), wide(trg).alias("trg")), lambda e: F.when(F.size(e["src"]) > 0, measure.expression(e["src"], e["trg"], **params)))
    return measure.expression(src, trg, **params)


def _cells(by_name: dict, wanted: list, src: Column, trg: Column, mask: Column | None, channels: Column) -> Column:
    cell = lambda metric, ordinal, params: F.struct(F.lit(metric).alias("metric"), F.lit(ordinal).alias("cfg_ordinal"), not_nan(_scored(by_name[metric], src, trg, mask, channels, params).cast("double")).alias("score"))
    return F.array(*(cell(*w) for w in wanted))


def _by_columns(pairs: DataFrame, by_name: dict, by_flags: dict, masked: bool) -> DataFrame:
    mask, channels, found = F.col("mask") if masked else None, F.col("channels"), []
    values = {c: F.col(c).cast("array<double>") for c in ("src", "trg")}
    cells_of = lambda wanted: lambda e: _cells(by_name, wanted, e["src"], e["trg"], mask, channels)
    for flags, wanted in by_flags.items():
        config = dict(zip(_NAMES, flags, strict=True))
        both = F.struct(*(pixels.preprocessed(v, channels, config).alias(c) for c, v in values.items()))
        found.append(pixels._with(both, cells_of(wanted)))
    return pairs.select("sample_idx", F.inline(F.flatten(F.array(*found))))


def _by_arrays(pairs: DataFrame, by_name: dict, by_flags: dict, masked: bool) -> DataFrame:
    mask, channels = F.col("mask") if masked else None, F.col("channels")
    rows, out = preprocessed_pairs(pairs, list(by_flags)), None
    for n, wanted in enumerate(by_flags.values()):
        cells = _cells(by_name, wanted, F.col("src"), F.col("trg"), mask, channels)
        out = F.when(F.col("flags") == n, cells) if out is None else out.when(F.col("flags") == n, cells)
    return rows.select("sample_idx", F.inline(out))


def _values(column: pa.Array) -> np.ndarray:
    """All values of a column of arrays; bytes are from 0 to 1."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return (np.frombuffer(b"".join(column.to_pylist()), np.uint8) / np.float32(255)).astype(np.float64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _stacks(batch: pa.RecordBatch, masked: bool):
    """The rows of a batch by shape of image (and with and without a mask), as stacks of a bounded size."""
    shapes = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)], axis=1)
    for shape in np.unique(shapes, axis=0):  # images of one shape make one stack
        all_own = np.flatnonzero((shapes == shape).all(axis=1))
        groups = [all_own]
        if masked:
            null = batch.column(6).is_null().to_numpy(zero_copy_only=False)[all_own]
            groups = [all_own[null], all_own[~null]]
        each = max(1, STACK // max(int(np.prod(shape)), 1))
        for own in (g[at : at + each] for g in groups for at in range(0, len(g), each)):
            stack = lambda i, *shape: _values(batch.column(i).take(pa.array(own))).reshape(-1, *shape)  # noqa: E731, B023
            mask = stack(6, *shape[:2]) if masked and batch.column(6)[int(own[0])].is_valid else None
            yield own, stack(4, *shape), stack(5, *shape), mask


def preprocessed_pairs(pairs: DataFrame, flags: list[tuple]) -> DataFrame:
    """pairs with src and trg under each set of flags, whose place in the list is the column flags; channels as they then are."""
    masked = "mask" in pairs.columns
    columns, configs = [*PAIR_COLUMNS, *["mask"] * masked], [dict(zip(_NAMES, values, strict=True)) for values in flags]

    def run(batches):
        for batch in batches:
            for own, src, trg, _ in _stacks(batch, masked):
                for n, done in enumerate(kernels.preprocessed(src, trg, configs)):
                    arrays = [pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * x[0].size), pa.array(x.ravel())) for x in done]
                    kept = [batch.column(i).take(pa.array(own)) for i in (0, 1, 2)]
                    rest = [batch.column(6).take(pa.array(own))] if masked else []
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(len(own), done[0].shape[-1], np.int32)), *arrays, *rest, pa.array(np.full(len(own), n, np.int32))], [*columns, "flags"])

    schema = "sample_idx long, height int, width int, channels int, src array<double>, trg array<double>" + ", mask array<int>" * masked + ", flags int"
    return _dealt(pairs.select(*PAIR_COLUMNS, *[F.col("mask").cast("array<int>")] * masked)).mapInArrow(run, schema)


def _dealt(pairs: DataFrame) -> DataFrame:
    """Pairs dealt out anew, as scoring one takes far longer than moving it."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _by_kernels(pairs: DataFrame, by_name: dict, by_flags: dict, masked: bool) -> DataFrame:
    by_flags = dict(sorted(by_flags.items()))  # sets of flags that begin with the same steps follow each other
    configs = [dict(zip(_NAMES, flags, strict=True)) for flags in by_flags]

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for own, src, trg, mask in _stacks(batch, masked):
                for config, wanted, (a, b) in zip(configs, by_flags.values(), kernels.preprocessed(src, trg, configs), strict=True):
                    for metric, ordinal, params in wanted:
                        value, n = np.asarray(by_name[metric](a, b, mask, kernels.background(config), **params), np.float64), len(own)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array([metric] * n), pa.array(np.full(n, ordinal, np.int32)), pa.array(value, mask=np.isnan(value))], ["sample_idx", "metric", "cfg_ordinal", "score"])

    return _dealt(pairs.select(*PAIR_COLUMNS, *["mask"] * masked)).mapInArrow(run, SCORES)


def kept_scores(path: str, pairs: DataFrame, measures: list[Measure], search: dict[str, tuple] | None = None, key: str = "sample_idx") -> DataFrame:
    """The score table of pairs, of which what the folder at path has is read and only the rest is scored and added to it.

    key: a column of pairs that names a pair in every run.  A configuration is known by its measure, flags and parameters, so
    searches of other measures and values find what they share.  Result as of score_pairs.
    """
    spark, grid = pairs.sparkSession, config_grid(pairs.sparkSession, measures, search)
    config = F.concat_ws(" | ", *(F.col(f).cast("string") for f in _NAMES), parameter_key(F.col("params")))
    grid = grid.select("metric", "cfg_ordinal", config.alias("config"))  # one row for each configuration
    schema = f"pair {dict(pairs.dtypes)[key]}, metric string, config string, score double"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    stored = lambda: spark.read.schema(schema).parquet(path)
    wanted = stored().join(F.broadcast(grid), ["metric", "config"]).dropDuplicates(["pair", "metric", "config"])
    each = {m.name: n for m, n in ((m, len(config_rows([m], search))) for m in measures)}
    for some in [measures] if stored().isEmpty() else [[m] for m in measures]:
        need = sum(each[m.name] for m in some)
        whole = wanted.where(F.col("metric").isin([m.name for m in some])).groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n") == need)
        lacking = pairs.join(whole, pairs[key] == whole["pair"], "left_anti")
        if not lacking.isEmpty():
            made = score_pairs(lacking, some, search).join(F.broadcast(grid), ["metric", "cfg_ordinal"])
            made = made if key == "sample_idx" else made.join(pairs.select("sample_idx", key), "sample_idx")
            made = made.select(F.col(key).alias("pair"), "metric", "config", "score")
            made.join(wanted.select("pair", "metric", "config"), ["pair", "metric", "config"], "left_anti").select("pair", "metric", "config", "score").write.mode("append").parquet(path)
    found = stored().join(F.broadcast(grid), ["metric", "config"]).dropDuplicates(["pair", "metric", "config"])
    return found.join(pairs.select("sample_idx", F.col(key).alias("pair")), "pair").select("sample_idx", "metric", "cfg_ordinal", "score")
