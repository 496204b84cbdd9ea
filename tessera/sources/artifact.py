"""The result of a run as a folder of four Parquet tables.

Each run is written to a folder of its own, and then named in the table of committed runs, whose rows Spark adds as a whole.
So a run that breaks between tables leaves the last one readable.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registry import SEARCH, Registry

PARTS = ("oof_predictions", "fold_meta", "meta", "run_info")
_COMMITTED = "run string, at timestamp"


def save_artifact(path: str, oof: DataFrame, fold_meta: DataFrame, meta: DataFrame, outer_seed: int, identities: list[str] | None = None, outer: int = 5, inner: int = 4) -> str:
    """Writes a run, commits it, and returns its name."""
    spark = oof.sparkSession
    measures = Registry().chosen() if identities is None else [Registry().get(n) for n in identities]
    names = [m.name for m in measures if m] if identities is None else identities
    space = " | ".join(f"{flag}:{list(values)}" for flag, values in SEARCH.items())
    space += "".join(f" | {m.name}:channel_mode={list(m.channel_modes)}" + "".join(f",{k}={list(v)}" for k, v in m.params.items()) for m in measures if m)
    now, run = datetime.datetime.now(), f"run-{uuid.uuid4().hex}"
    info = [(now, outer_seed, names, space, outer, inner)]
    run_info = spark.createDataFrame(info, "timestamp timestamp, outer_seed long, identities array<string>, configs string, n_outer_splits int, n_inner_splits int")
    for name, df in zip(PARTS, (oof, fold_meta, meta, run_info), strict=True):
        df.write.parquet(f"{path}/{run}/{name}")
    spark.createDataFrame([(run, now)], _COMMITTED).coalesce(1).write.mode("append").parquet(f"{path}/committed")
    return run


def load_artifact(spark: SparkSession, path: str, run: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """oof_predictions, fold_meta, meta and run_info of a run, or of the one that was committed last."""
    if run is None:
        last = spark.read.schema(_COMMITTED).parquet(f"{path}/committed").agg(F.max(F.struct("at", "run")).alias("last")).first()["last"]
        if last is None:
            raise ValueError(f"{path} has no committed run")
        run = last["run"]
    return tuple(spark.read.parquet(f"{path}/{run}/{name}") for name in PARTS)
