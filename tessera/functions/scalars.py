"""Scalar expressions: numbers in texts, paths, keys of configurations, label flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the first number in a text.
NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
FLAGS = ("normalization", "channel_mode", "flip_intensity", "match_histogram", "clahe", "smoothing")


def extract_number(text: Column) -> Column:
    """The text as a double, else the first number in it, else null."""
    whole = text.try_cast("double")
    return F.coalesce(F.when(~F.isnan(whole), whole), F.nullif(F.regexp_extract(text, NUMBER, 0), F.lit("")).try_cast("double"))


def resolved_path(base: str, path: Column) -> Column:
    """A relative path below base; an absolute one as it is."""
    return F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.lit(base.rstrip("/")), path))


def config_key(params: Column) -> Column:
    """A configuration's values in their order, flags as 0 and 1, and then its measure's parameters."""
    flags = [F.col(c).cast("int").cast("string") if c != "channel_mode" else F.col(c) for c in FLAGS]
    extra = F.transform(F.array_sort(F.map_entries(params)), lambda e: e["value"])
    return F.concat_ws(" | ", *flags, extra)


def parameter_key(params: Column) -> Column:
    """Equal for maps with the same entries."""
    return F.to_json(F.array_sort(F.map_entries(params)))


def only_keys(params: Column, keys: Column) -> Column:
    return F.map_filter(params, lambda k, _: F.array_contains(keys, k))
