"""Removal of passages that repeat, by windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import fresh
from .scratch import saved

LINES = 3
#: A line counts if it has a character outside space and U+0009..U+000D.
_WORD = r"[^\x20\x09-\x0D]"


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the later occurrences of passages of three lines and more; adds n_lines and n_removed.

    A text is cut at line feeds; lines without a word are passed over.  Each run of three lines is a window (all lines of
    a text with fewer than three).  Of the windows with the same lines the one with the smallest (id, place) is the
    first; the lines that others cover, overlapping ones merged, go from their texts.  Lines are compared exactly, by
    two 64-bit hashes.

    Null texts stay null with n_lines 0.  Rows without an id are returned as they are and count as no occurrence.  Rows
    equal in id and text are one occurrence.  All rows and columns are kept; only columns named n_lines or n_removed are
    replaced.  An empty df gives an empty result.
    """
    df = df.drop("n_lines", "n_removed")
    lines, row, key, removed = fresh(df, "lines", "row", "key", "removed")
    docs = df.withColumn(row, F.xxhash64(text_col))
    full = F.filter(F.transform(F.split(text_col, "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda x: x["line"].rlike(_WORD))
    runs = F.when(F.size("full") >= LINES, F.sequence(F.lit(0), F.size("full") - LINES)).when(F.size("full") > 0, F.array(F.lit(0)))

    def window(i):
        own = F.slice("full", i + 1, LINES)
        text = F.transform(own, lambda x: x["line"])
        return F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit("second"), text).alias("h2"), F.transform(own, lambda x: x["at"]).alias("at"))

    windows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(row).alias("row"), full.alias("full")).where(F.size("full") > 0)
    windows = windows.select("id", "row", F.explode(F.transform(runs, window)).alias("w")).select("id", "row", "w.*").withColumn("place", F.col("at")[0])
    occurrence = F.struct("id", "row", "place")
    # Written, so that a join deals out both sides by hash: Spark then splits a window that very many texts share.
    firsts = saved(windows.groupBy("h", "h2").agg(F.min(occurrence).alias("first"), F.max(occurrence).alias("last")).where("first < last").select("h", "h2", "first"), "windows")
    later = windows.join(firsts, ["h", "h2"]).where(occurrence > F.col("first"))
    # A document's windows are as many as its lines, so this group is no larger than a text.
    covered = later.groupBy(F.col("id").alias(key), F.col("row").alias(row)).agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias(removed))
    joined = docs.join(covered, (docs[id_col] == covered[key]) & (docs[row] == covered[row]), "left").drop(covered[row]).withColumn(lines, F.split(text_col, "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(removed))
    text = F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size(removed), F.lit(0)).cast("long").alias("n_removed"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document: number of lines, removed ones, and the digest of the text."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL
), f AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2, lead(pos, 1) OVER w AS a1, lead(pos, 2) OVER w AS a2
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), w AS (
  SELECT doc_id, pos, a1, a2, concat_ws(chr(10), line, l1, l2) AS key FROM f
  WHERE l2 IS NOT NULL OR n < 3 AND pos = (SELECT min(g.pos) FROM f g WHERE g.doc_id = f.doc_id)
), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS k FROM w
), c AS (SELECT DISTINCT doc_id, unnest([pos, a1, a2]) AS pos FROM o WHERE k > 1
), r AS (
  SELECT doc_id, count(c.pos) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '') AS text
  FROM l LEFT JOIN c USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(n_removed, 0) AS n_removed,
  length(r.text) AS n_chars, md5(r.text) AS text_md5
FROM documents d LEFT JOIN r USING (doc_id)
"""
