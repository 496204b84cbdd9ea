"""Quality of documents by gradient-boosted trees over statistics of their texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .quality_rules import base_counts
from .scratch import saved, small_batches
from .textarrays import Words, chunks, mixed

FEATURES = (
    "bytes", "words", "word_bytes", "word_bytes_deviation", "short_words", "long_words", "symbols", "digits", "upper", "stops", "commas", "exclaims", "bars", "brackets", "beyond_ascii",
    "line_words", "dup_lines", "full_lines", "repeat_words", "next_same", "distinct", "distinct_hundred", "most_common", "capital_words", "letterless_words",
)
THRESHOLD = 0.7


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_DIGIT, _UPPER, _LETTER = _bytes("0123456789"), _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0x80:] = True
_STOP, _COMMA, _EXCLAIM, _BAR, _BRACKET, _SYMBOL = _bytes(".?"), _bytes(",;:"), _bytes("!"), _bytes("|"), _bytes("()[]{}<>"), _bytes("#*$%&@^~_=+\\/")


def statistics(w: Words) -> np.ndarray:
    """(texts, len(FEATURES)) numbers without NaN; all zero for a text without a word, but for its size."""
    base = base_counts(w)
    size, words = (w.text_end - w.text_start).astype(float), w.counts.astype(float)
    of_bytes, of_words = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)
    per_word = lambda x: np.bincount(w.doc, x, w.n_texts) * of_words
    long = (w.end - w.start).astype(float)
    mean = per_word(long)
    start, end, line_doc = w.lines()
    lines = np.bincount(line_doc, minlength=w.n_texts)
    of_lines = 1 / np.maximum(lines, 1)
    last = w.data[end - 1] if len(end) else w.data[:0]
    h = w.hashes()
    key = mixed(w.doc.astype(np.uint64)) ^ h
    same = np.zeros(len(h), bool)
    same[1:] = key[1:] == key[:-1]
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    distinct = np.bincount(w.doc[first], minlength=w.n_texts).astype(float)
    common = np.zeros(w.n_texts)
    np.maximum.at(common, w.doc[first], n)
    place = np.arange(len(h)) - np.repeat(w.first[:-1], w.counts)
    early = np.bincount(w.doc[first], place[first] < 100, w.n_texts)
    columns = [
        np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(per_word(long * long) - mean * mean, 0)), per_word(long <= 2), per_word(long >= 20),
        *(w.per_text(k[w.data]) * of_bytes for k in (_SYMBOL, _DIGIT, _UPPER, _STOP, _COMMA, _EXCLAIM, _BAR, _BRACKET)), w.per_text(w.data >= 0xC0) * of_bytes,
        words * of_lines, base["n_dup_lines"] * of_lines, np.bincount(line_doc, _STOP[last], w.n_texts) * of_lines, base["n_repeat_words"] * of_words, per_word(same),
        distinct * of_words, early / np.maximum(np.minimum(words, 100), 1), common * of_words,
        per_word(_UPPER[w.data[w.start]]), per_word(~w.some_byte(_LETTER[w.data])),
    ]
    return np.stack(columns, axis=1)


def text_statistics(docs: DataFrame) -> DataFrame:
    """id and x (array of the statistics) of each row of docs (id, text)."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for begin, texts in chunks(batch.column(1)):
                x = statistics(Words(texts)).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(begin, len(texts)), lists], ["id", "x"])

    return docs.mapInArrow(run, "id long, x array<float>")


def train(stats: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> Trees:
    """Trees from the labelled rows of stats; labels: (id, label), null labels are left out.

    most_rows: the trees are fitted on at most so many rows, those of the smallest hashes of their ids; of rows with the
    same id, labels and statistics decide, so the same rows are taken in every run.
    """
    order = [F.xxhash64("id"), "id", "label"]
    chosen = labels.where("id is not null and label is not null").orderBy(*order).limit(most_rows)
    rows = stats.join(F.broadcast(chosen), "id").orderBy(*order, F.xxhash64("x"), "x").limit(most_rows).select("x", "label").toPandas()
    rows = rows.iloc[np.lexsort((rows["label"], *np.stack(rows["x"]).T))] if len(rows) else rows  # ids may repeat; in one order, for equal sums
    x = np.stack(rows["x"]).astype(np.float32) if len(rows) else np.zeros((0, len(FEATURES)), np.float32)
    return fit(x, rows["label"].to_numpy(np.int64))


def classify_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 20_000) -> DataFrame:
    """id, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.7, else 0) of each row of df.

    labels: (id, label) rows to learn from, of which most_rows are used at most.  Null and empty texts are scored like
    others, by statistics that are all 0.  Without both labels every score is the share of label 1 (0.5 without labels).
    Repeated rows and rows without an id are rows like others.  Other columns are not read.  An empty df gives no rows.
    """
    small_batches(df.sparkSession)
    stats = saved(text_statistics(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))), "statistics")
    model = df.sparkSession.sparkContext.broadcast(train(stats, labels, most_rows))

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            score = model.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["id", "score", "predicted"])

    return stats.mapInArrow(run, "id long, score double, predicted int").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labels of rows whose id's crc32 modulo 4 is not 2."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(part != 2).select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label"))
    out = classify_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    return out.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "score", "predicted")
