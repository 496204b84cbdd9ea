"""A corpus made ready for training, in stages of which each is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.language_id import identify_languages, training_rows
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.mixing import SHARES, mix_sources
from tessera.llm.ngram_join import ngram_jaccard_join
from tessera.llm.packing import pack_documents
from tessera.llm.scratch import saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document in which no language has this share of the words is left out.
LEAST_SHARE = 0.4
#: And one whose trigrams are less likely than this fence of its language's training rows (Tukey's far-out values).
FENCE = 3.0
WORD = r"[^\x20\x09-\x0D]"
#: Pieces that are packed together; sequences stray from the mixture by no more than a few such ranges.
RANGE_PIECES = 2_000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language, those like no learned language, and those in which none has LEAST_SHARE.

    Null and empty texts go.  Rows with null or repeated ids are documents like others.  Columns beyond those of
    documents are left out, whatever their names.  Without rows to learn from, or without rows, nothing stays.
    """
    out = identify_languages(docs.select(*COLUMNS), training_rows(docs), keep=("doc_id", "lang", "source", "n_chars", "text"), fence=FENCE)
    return out.where(F.col("known") & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of texts; a document of which nothing is left goes.

    Of equal passages that in the smallest (id, place) stays.  Null and empty texts, and rows without an id, stay as they
    are; rows equal in id and text do not count against each other.  n_chars is counted anew where a text changed.  Columns beyond those
    of documents are left out.  No rows give no rows.
    """
    out = dedup_lines(docs.select(*COLUMNS))
    changed = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return changed.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD)).select(*COLUMNS)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, Jaccard 0.8).

    Documents are told apart by a hash of id and text, so rows with one id and different texts are documents of their own,
    and of equal rows one stays.  Of a group the document with the smallest id stays (of several, by that hash).  Texts without words, null ones
    too, link with nothing and all stay.  Columns beyond those of documents are left out.  No rows give no rows.
    """
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("key"))
    groups = ngram_jaccard_join(rows, id_col="key", k=5, num=80, den=100).where("n_shingles > 0")
    groups = groups.groupBy("key", "component_id").agg(F.count("*").alias("copies")).join(rows.select("key", "doc_id").distinct(), "key")
    kept = saved(groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "key", "copies")).alias("first")).select("first.key", "first.copies"), "kept")
    worded = rows.where(F.col("text").rlike(WORD)).join(kept, "key")
    out = worded.where("copies = 1").select(*COLUMNS).union(rows.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False))).select(*COLUMNS))
    if not kept.where("copies > 1").isEmpty():  # rows equal in id and text
        out = out.union(worded.where("copies > 1").dropDuplicates(["key"]).select(*COLUMNS))
    return out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: within each file, and from file to file.

    Null and unlisted sources share one place.  Null ids come first in their source, equal ids in no certain order.  Texts
    may be null or empty.  Columns beyond those of documents are left out.  No rows give no rows.
    """
    mixed = mix_sources(docs.select(*COLUMNS), SHARES)
    return mixed.repartitionByRange("mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' tokens in sequences, which follow the mixture.

    Slots are taken anew from ids and sources, as the order of rows in files is not kept on reading.  A null or empty text
    has its end id only; rows with equal or null ids are documents of their own.  No rows give no pieces.
    """
    slots = mix_sources(docs.select("doc_id", "text", "source"), SHARES)
    return pack_documents(slots, place_col="mix_slot", partition_pieces=RANGE_PIECES)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_copy_stage),
    ("mix_sources", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Language inference, the join on hashes and best-fit packing have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
