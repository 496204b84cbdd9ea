"""Tables written to the folder that driver and executors share.

A job that needs an intermediate result twice writes it here and reads it back.  The files survive lost executors
and cut the lineage, unlike cached blocks of which there is one copy.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where that is unset, as in local tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _LOCAL.setdefault("folder", "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return folder if "://" in folder or folder.startswith("file:") else "file://" + folder


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Lets Spark hand rows to Python in Arrow batches of this size, unless the session's user has set another one.

    A batch is held by the JVM and by Python at once; operators on whole texts gain nothing from large ones.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # Spark's default
        spark.conf.set(name, size)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own for each call, so two runs never share files."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back with the same schema.

    done: earlier results of this function that nothing reads any more; their files go once df's are written.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    dropped(*done)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of results of ``saved``."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(df))
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
