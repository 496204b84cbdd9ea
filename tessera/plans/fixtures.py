"""Labelled samples and image pairs made of the given tables, for queries and tests; each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_idx (the document's id), pname, class3, expert_score, score."""
    df = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    cls = F.when(F.col("quality") == 0, 2).when(F.col("toxic") == 1, 1).otherwise(0)
    df = df.withColumn("class3", cls)
    return df.select(
        F.col("doc_id").alias("sample_idx"), F.col("source").alias("pname"), "class3", F.greatest(F.lit(1.0), (5 - 2 * F.col("class3") - F.col("doc_id") % 2).cast("double")).alias("expert_score"),
        (-F.log1p(F.col("n_chars").cast("double"))).alias("score"),
    )


LABELLED_DOCUMENTS = """a AS (
  SELECT doc_id AS sample_idx, source AS pname, class3, greatest(1.0::DOUBLE, (5 - 2 * class3 - doc_id % 2)::DOUBLE) AS expert_score, -ln(1 + n_chars::DOUBLE) AS score
  FROM (SELECT doc_id, source, n_chars, CASE WHEN quality = 0 THEN 2 WHEN toxic = 1 THEN 1 ELSE 0 END AS class3 FROM documents JOIN labels USING (doc_id)))"""


def order_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_idx (the order's key), pname, class3, expert_score, price, balance."""
    df = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cls = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    return df.select(
        F.col("o_orderkey").alias("sample_idx"), F.col("c_nationkey").cast("string").alias("pname"), cls.alias("class3"),
        (6 - F.substring("o_orderpriority", 1, 1).cast("double")).alias("expert_score"), F.col("o_totalprice").cast("double").alias("price"), F.col("c_acctbal").cast("double").alias("balance"),
    )


def order_scores(samples: DataFrame) -> DataFrame:
    """sample_idx, metric, cfg_ordinal, score: two measures, each as it is and negated."""
    cells = [F.struct(F.lit(m).alias("metric"), F.lit(i).alias("cfg_ordinal"), (F.col(m) * sign).alias("score")) for m in ("price", "balance") for i, sign in enumerate((1.0, -1.0))]
    return samples.select("sample_idx", F.inline(F.array(*cells)))


ORDER_SAMPLES = """c AS (
  SELECT o_orderkey AS sample_idx, c_nationkey::VARCHAR AS pname, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS class3,
    6 - substr(o_orderpriority, 1, 1)::DOUBLE AS expert_score, o_totalprice::DOUBLE AS price, c_acctbal::DOUBLE AS balance
  FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT sample_idx, metric, cfg_ordinal, CASE metric WHEN 'price' THEN price ELSE balance END * CASE cfg_ordinal WHEN 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS score
  FROM c, (VALUES ('price'), ('balance')) m(metric), (VALUES (0), (1)) k(cfg_ordinal))"""


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_idx, height, width, channels, src, trg (8 x 8, min-max scaled), pname, class3, expert_score."""
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    b = e.select(((F.col("vec_id") - 1 + n) % n).alias("vec_id"), F.col("embedding").alias("other"), F.col("label").alias("other_label"))
    far = F.abs(F.col("label") - F.col("other_label"))
    cls = F.when(far == 0, 0).when(far <= 2, 1).otherwise(2)
    values = {c: F.col(c).cast("array<double>") for c in ("embedding", "other")}
    ends = {f"{c}_{k}": f(v) for c, v in values.items() for k, f in (("low", F.array_min), ("high", F.array_max))}
    side = lambda c: F.transform(F.col(c), lambda v: (v - F.col(f"{c}_low")) / (F.col(f"{c}_high") - F.col(f"{c}_low")))
    return e.join(b, "vec_id").withColumns(values | ends).select(
        F.col("vec_id").alias("sample_idx"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), side("embedding").alias("src"), side("other").alias("trg"),
        F.concat(F.lit("w"), (F.col("vec_id") % 25).cast("string")).alias("pname"), cls.alias("class3"), (5.0 - F.least(F.lit(4), far)).alias("expert_score"),
    )


def colour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_idx, src_r, src_g, src_b: three vectors, one after the other, as the channels of an image."""
    p = vector_pairs(spark, sf_dir).select("sample_idx", "src", "trg")
    n = p.count()
    third = p.select(((F.col("sample_idx") - 2 + n) % n).alias("sample_idx"), F.col("src").alias("src_b"))
    return p.join(third, "sample_idx").select("sample_idx", F.col("src").alias("src_r"), F.col("trg").alias("src_g"), "src_b")


def colour_search_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns as of vector_pairs, with three channels: three vectors, one after the other, and the three from the next one on."""
    p = vector_pairs(spark, sf_dir)
    n = p.count()
    planes = p.select("sample_idx", F.col("src").alias("v"))
    for k in (1, 2, 3):
        planes = planes.join(p.select(F.pmod(F.col("sample_idx") - k, F.lit(n)).alias("sample_idx"), F.col("src").alias(f"v{k}")), "sample_idx")
    joined = lambda *of: F.flatten(F.transform(F.arrays_zip(*(F.col(c).alias(f"c{i}") for i, c in enumerate(of))), lambda z: F.array(z["c0"], z["c1"], z["c2"])))
    colours = planes.select("sample_idx", joined("v", "v1", "v2").alias("src"), joined("v1", "v2", "v3").alias("trg"))
    return p.drop("src", "trg").withColumn("channels", F.lit(3)).join(colours, "sample_idx")


#: Pixels (sample_idx, i, x, y) of the pairs, and the vectors scaled.
VECTOR_PIXELS = """v AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS raw FROM embeddings),
z AS (SELECT vec_id, i, (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) AS v FROM v WINDOW w AS (PARTITION BY vec_id)),
px AS (SELECT a.vec_id AS sample_idx, a.i, a.v AS x, b.v AS y FROM z a JOIN z b ON b.i = a.i AND b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings))"""


def mosaics(spark: SparkSession, sf_dir: str, tiles: int) -> DataFrame:
    """Pixel rows of square images of tiles x tiles vector pairs, by their order; the last image goes on with the first pairs."""
    p = vector_pairs(spark, sf_dir).select("sample_idx", F.posexplode(F.arrays_zip("src", "trg")).alias("i", "p"))
    n, each = table(spark, sf_dir, "embeddings").count(), tiles * tiles
    places = -(-n // each) * each
    again = F.transform(F.sequence(F.lit(0), F.lit((places - 1) // n)), lambda k: F.col("sample_idx") + k * n)
    rows = p.select(F.explode(F.filter(again, lambda k: k < places)).alias("k"), "i", "p")
    tile, side = F.col("k") % each, 8 * tiles
    y, x = F.expr(f"(k % {each}) div {tiles} * 8 + i div 8"), tile % tiles * 8 + F.col("i") % 8
    return rows.select(F.expr(f"k div {each}").alias("sample_idx"), F.lit(side).alias("height"), F.lit(side).alias("width"), F.lit(0).alias("c"), y.cast("int").alias("y"), x.cast("int").alias("x"), F.col("p.src").alias("src"), F.col("p.trg").alias("trg")).repartition("sample_idx")


def mosaic_pixels(tiles: int) -> str:
    """A CTE mo (sample_idx, y, x, src, trg) of the same rows."""
    each = tiles * tiles
    return f"""mo AS (SELECT (k // {each})::BIGINT AS sample_idx, ((k % {each}) // {tiles} * 8 + i // 8)::INT AS y, (k % {tiles} * 8 + i % 8)::INT AS x, px.x AS src, px.y AS trg
  FROM (SELECT k, k % (SELECT count(*) FROM embeddings) AS sample_idx FROM range((SELECT ((count(*) + {each} - 1) // {each} * {each})::BIGINT FROM embeddings)) r(k)) t JOIN px USING (sample_idx))"""


#: sample_idx, pname, class3 and expert_score of the same pairs.
VECTOR_LABELS = """c AS (SELECT sample_idx, pname, CASE WHEN far = 0 THEN 0 WHEN far <= 2 THEN 1 ELSE 2 END AS class3, (5 - least(4, far))::DOUBLE AS expert_score
  FROM (SELECT a.vec_id AS sample_idx, 'w' || (a.vec_id % 25) AS pname, abs(a.label - b.label) AS far FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)))"""
