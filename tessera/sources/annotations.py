"""Annotation tables: pairs of images with expert scores, classes and groups; and the images themselves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import resolved_path
from .tables import saved

REQUIRED = {"fixed_path": "string", "warped_path": "string", "Similarity_Score": "double", "class3": "int"}
#: Columns that may be missing, and then are null.
META = {"pname": "string", "patch_id": "string"}
IMAGES = "path string, height int, width int, channels int, data array<float>"
IMAGE_BYTES = "path string, height int, width int, channels int, data binary"
#: Pairs that one copy of an image is joined to; an image that more pairs use is copied.
PAIRS_OF_COPY = 1000
#: The number of a partition is above these bits of monotonically_increasing_id, and a row's place in it below.
PART_BITS = 33


def read_annotations(spark: SparkSession, path: str, base_dir: str = "", order: tuple[str, ...] = ("pname", "patch_id", "fixed_path", "warped_path")) -> DataFrame:
    """Rows of a CSV (with a header) or Parquet file, with sample_idx from 0 in the given order, and resolved paths.

    Columns are found by their names, in any order; others are not read.  A file without one of REQUIRED is refused.
    """
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    df = df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in (REQUIRED | META).items()))
    paths = {c: resolved_path(base_dir, F.col(c)) for c in ("fixed_path", "warped_path")} if base_dir else {}
    return with_ordinal(df.withColumns({"Similarity_Score": F.nullif("Similarity_Score", F.lit(float("nan")))} | paths), *order)


def with_ordinal(df: DataFrame, *order: str) -> DataFrame:
    """df with sample_idx: the place of a row in the given order, from 0.

    Counts of range partitions give each its first place, so no task sorts all rows.  The sorted ranges are written first:
    Spark draws the limits of ranges from a sample and joins small ranges, so two runs of one plan may cut them differently.
    """
    part = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordinal")
    part = part.withColumn("_part", F.shiftright("_at", PART_BITS))
    counts = part.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    within = F.col("_at") - F.shiftleft("_part", PART_BITS)
    return part.join(F.broadcast(offsets), "_part").withColumn("sample_idx", (F.col("_before") + within).cast("long")).drop("_part", "_at", "_before")


def plain_path(path: Column) -> Column:
    """A local path without its scheme, so that names from tables and from file listings are equal; others as they are."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_images(spark: SparkSession, path: str, as_bytes: bool = False) -> DataFrame:
    """path, height, width, channels and data of all images in a folder and the folders in it.

    Every image has three channels, red, green and blue from 0 to 1 (as_bytes: bytes from 0 to 255): gray ones repeat theirs,
    and alpha is left out.
    """
    image = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):  # an image is an array of bytes: blue, green, red, alpha
                height, width, channels = (batch.column(i)[row].as_py() for i in (1, 2, 3))
                x = np.frombuffer(batch.column(4)[row].as_buffer(), np.uint8).reshape(height, width, channels)
                rgb = np.repeat(x, 3, axis=2) if channels == 1 else x[..., 2::-1]
                if as_bytes:
                    data = pa.array([np.ascontiguousarray(rgb).tobytes()], pa.binary())
                else:
                    data = pa.ListArray.from_arrays(pa.array([0, rgb.size], pa.int32()), pa.array((rgb / np.float32(255)).ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), *(pa.array([v], pa.int32()) for v in (height, width, 3)), data], ["path", "height", "width", "channels", "data"])

    # The reader writes names as in a URI, but for plus signs.
    name = F.url_decode(F.replace(F.col("origin"), F.lit("+"), F.lit("%2B")))
    return image.select(plain_path(name), "height", "width", "nChannels", "data").mapInArrow(run, IMAGE_BYTES if as_bytes else IMAGES)


def image_pairs(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """sample_idx, shape, src (of warped_path) and trg (of fixed_path) for every annotation; fails if one lacks an image.

    Each side of a pair is a row that is joined to its image by the path; the two rows then meet by the pair.  Where the sides
    are few enough for Spark to broadcast them, pixels are shuffled once.  An image is decoded once, however many pairs use it,
    and one that very many use is joined in several copies.
    """
    named = annotations.select("sample_idx", plain_path(F.col("warped_path")).alias("warped"), plain_path(F.col("fixed_path")).alias("fixed"))
    side = lambda path, n: F.struct(F.col(path).alias("path"), F.lit(n).alias("side"))
    sides = named.select("sample_idx", F.inline(F.array(side("warped", 0), side("fixed", 1))))
    hot = sides.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > PAIRS_OF_COPY).select("path", F.expr(f"int((n - 1) div {PAIRS_OF_COPY}) + 1").alias("copies"))
    copies = F.coalesce("copies", F.lit(1))
    spread = images.join(hot, "path", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    dealt = sides.join(hot, "path", "left").withColumn("copy", F.pmod(F.xxhash64("sample_idx"), copies).cast("int")).drop("copies")
    found = spread.join(dealt, ["path", "copy"]).select("sample_idx", "side", "height", "width", "channels", "data", F.lit(None).cast("string").alias("names"))
    # A row for each pair, so that one without images is noticed.
    names = F.concat(F.coalesce("warped", F.lit("null")), F.lit(", "), F.coalesce("fixed", F.lit("null")))
    nothing = [F.lit(None).cast(images.schema[c].dataType).alias(c) for c in ("height", "width", "channels", "data")]
    rows = found.union(named.select("sample_idx", F.lit(-1).alias("side"), *nothing, names.alias("names")))
    pair = Window.partitionBy("sample_idx")  # three rows
    of = lambda n, c: F.first(F.when(F.col("side") == n, F.col(c)), True).over(pair)
    pairs = rows.select("sample_idx", "side", "names", *(of(0, c).alias(c) for c in ("height", "width", "channels")), of(0, "data").alias("src"), of(1, "data").alias("trg")).where("side = -1")
    whole = F.assert_true(F.col("src").isNotNull() & F.col("trg").isNotNull(), F.concat(F.lit("an image is missing: "), "names")).isNull()
    return pairs.where(whole).select("sample_idx", "height", "width", "channels", "src", "trg")
