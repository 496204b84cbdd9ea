"""Files that tasks read and write by themselves, in the folder that driver and executors share."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import SparkSession

#: What pyarrow calls the stores that Hadoop knows by other schemes.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}


def resolved(spark: SparkSession, path: str) -> str:
    """The path behind one that only Hadoop's configuration explains, such as a mounted one; others as they are.

    Called on the driver, so that tasks need no Hadoop.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if not path.startswith("viewfs:"):
        return path
    found, more = jvm.org.apache.hadoop.fs.Path(path), []
    while True:  # the nearest folder that is there
        store = found.getFileSystem(conf)
        if store.exists(found) or found.getParent() is None:
            return "/".join([store.resolvePath(found).toString().rstrip("/"), *reversed(more)])
        more.append(found.getName())
        found = found.getParent()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of a path, and the path in it."""
    scheme, mark, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{mark}{rest}")
