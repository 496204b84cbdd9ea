"""Approximate nearest neighbours by additive quantisation and exact reranking.

Every vector is written as codes.  Codes and queries are dealt into blocks; each pair of blocks is one group, in which
look-up tables give all distances to the coded vectors, and the nearest of each query make its share of the shortlist.
Vectors are dealt by a hash, so a block holds a random part of a query's neighbours; it gives a multiple of the number
to expect.  The best of all shares are compared exactly, on the vectors themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import additive_codes as ac
from .scratch import saved


def usable(vector: Column, dimension: int | None = None) -> Column:
    """Whether a vector is not null or zero, has the dimension, and has finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok if dimension is None else ok & (F.size(vector) == dimension), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def nearest_neighbours(
    df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, books: int = 32, size: int = 256, beam: int = 4,
    sample_rows: int = 16_384, shortlist: int = 300, least_blocks: int = 64, block_vectors: int = 1_000_000, block_queries: int = 20_000,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of the k nearest rows of df found for each query.

    queries: rows with columns like df's; a query's own id is no candidate.  Ties go to the smaller id.  Vectors that are
    null, zero, hold null or non-finite components, or are not of the most usual length take no part, nor do rows without
    an id.  Rows with equal id and vector count once; of queries with one id and several vectors each gets its own
    ranks.  Other columns are not read.  No usable vectors or queries: no rows.

    sample_rows: the codebooks are fitted on at most so many vectors, those of the smallest hashes of their ids; all
    vectors are coded and searched.  shortlist: how many of a query's best by code are compared exactly (k at least).
    """
    spark = df.sparkSession
    shortlist = max(shortlist, k + 1)
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension = usual["d"]
    rows = rows.where(F.size("v") == dimension).withColumn("key", F.xxhash64("v"))
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), vector.alias("q")).where(F.col("query_id").isNotNull() & usable(F.col("q"), dimension))
    asked = asked.withColumn("query_key", F.xxhash64("q"))
    asked = saved(asked.groupBy("query_id", "query_key").agg(F.first("q").alias("q")), "queries")

    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "key").limit(sample_rows).select("v").collect()], np.float64)
    scale = float(np.abs(sample).max())  # of any size, they fit single precision
    model = spark.sparkContext.broadcast(ac.train(sample / scale, books, size))

    def encoded(batches):
        for batch in batches:
            codes, norms = ac.encode(_matrix(batch.column(2), dimension) / scale, model.value, beam)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)], ["vec_id", "key", "codes", "norm"])

    coded = saved(rows.select("vec_id", "key", "v").mapInArrow(encoded, "vec_id long, key long, codes binary, norm float"), "codes")
    n, n_queries = coded.count(), asked.count()
    vector_blocks = min(max(least_blocks, -(-n // block_vectors)), -(-n // 8))
    query_blocks = max(1, -(-n_queries // block_queries))
    share = min(shortlist, -(-4 * shortlist // vector_blocks) + 16)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.select(["vec_id", "key"]).slice(0, 0).append_column("query_id", pa.array([], pa.int64())).append_column("query_key", pa.array([], pa.int64())).append_column("near", pa.array([], pa.float32()))
        ids, keys = left["vec_id"].to_numpy(), left["key"].to_numpy()
        order = np.lexsort((keys, ids))
        new = np.ones(len(order), bool)
        new[1:] = (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])
        order = order[new]
        ids, keys, norms = ids[order], keys[order], left["norm"].to_numpy()[order]
        codes = np.frombuffer(b"".join(left["codes"].to_pylist()), np.uint8).reshape(-1, len(model.value))[order]
        q, q_ids, q_keys = (_matrix(right["q"], dimension) / scale).astype(np.float32), right["query_id"].to_numpy(), right["query_key"].to_numpy()
        found = []
        for at in range(0, len(q), 64):
            near = ac.scores(q[at : at + 64], model.value, codes, norms)
            near[q_ids[at : at + 64, None] == ids[None, :]] = np.inf
            places = ac.smallest(near, min(share, len(ids)))
            value = np.take_along_axis(near, places, axis=1)
            row, col = np.nonzero(np.isfinite(value))
            found.append((row + at, places[row, col], value[row, col] + (q[at + row] ** 2).sum(axis=1)))
        row, place, value = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"vec_id": ids[place], "key": keys[place], "query_id": q_ids[row], "query_key": q_keys[row], "near": value.astype(np.float32)})

    left = coded.withColumns({"vb": F.pmod(F.xxhash64("vec_id"), F.lit(vector_blocks)), "qb": F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))})
    right = asked.withColumns({"vb": F.explode(F.sequence(F.lit(0), F.lit(vector_blocks - 1))), "qb": F.pmod(F.xxhash64("query_id", F.lit(7)), F.lit(query_blocks))})
    left, right = left.withColumn("vb", F.col("vb").cast("int")), right.withColumn("qb", F.col("qb").cast("int"))
    pairs = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(search, "vec_id long, key long, query_id long, query_key long, near float")
    by_code = Window.partitionBy("query_id", "query_key").orderBy("near", "vec_id", "key")
    best = pairs.withColumn("place", F.row_number().over(by_code)).where(F.col("place") <= shortlist).drop("place", "near")
    once = rows.dropDuplicates(["vec_id", "key"])
    difference = F.aggregate(F.zip_with("q", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, x: total + x)
    exact = best.join(once, ["vec_id", "key"]).join(asked, ["query_id", "query_key"]).select("query_id", "query_key", "vec_id", "key", F.sqrt(difference).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id", "key"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each vector whose id is divisible by 100, among all other vectors."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest_neighbours(rows, rows.where("vec_id % 100 = 0"))
