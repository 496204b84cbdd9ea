"""Rules that reject documents: base counts, and perplexity outside the limits of the document's language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_model import SCORED_BYTES, Known, language_keys, score, train
from .scratch import saved, small_batches
from .textarrays import Words, chunks, mixed, repeated

WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 5, 10, 20
#: Tukey's fence, in distances between the quartiles: of normally spread texts it leaves out 0.7 %.
FENCE = 1.5
_MARKS = np.zeros(256, bool)
_MARKS[list(b"#*$%&|<>")] = True


def base_counts(w: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    start, end, doc = w.lines()
    later = repeated(w.span_hashes(start, end) ^ mixed(doc.astype(np.uint64))) == 2
    h, at = w.windows(WINDOW)
    twice = at[repeated(h ^ mixed(w.doc[at].astype(np.uint64))) > 0]
    edge = np.zeros(len(w.doc) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return {
        "n_words": w.counts,
        "word_chars": w.per_text(w.word & ((w.data & 0xC0) != 0x80)),
        "n_symbols": w.per_text(_MARKS[w.data]),
        "n_dup_lines": np.bincount(doc[later], minlength=w.n_texts),
        "n_repeat_words": np.bincount(w.doc[covered], minlength=w.n_texts),
    }


def with_limits(scored: DataFrame, fence: float = FENCE) -> DataFrame:
    """scored (language, n_words, log_perplexity) with low and high, and inside: whether the log perplexity is between them.

    A mean over n words spreads by 1 / sqrt(n), so distances from the language's median are taken times sqrt(n).  Each
    side has its own limit: `fence` times twice the distance from that side's quartile to the median, beyond the quartile.
    All texts with 10 words or more count, equal ones once.
    """
    texts = scored.where((F.col("n_words") >= LEAST_WORDS) & F.col("log_perplexity").isNotNull()).select("language", "n_words", "log_perplexity").distinct()
    middle = texts.groupBy("language").agg(F.percentile(F.round("log_perplexity", 4), 0.5).alias("middle"))  # of few distinct values
    root = F.sqrt(F.greatest("n_words", F.lit(1)))
    distance = F.round((F.col("log_perplexity") - F.col("middle")) * root, 3)
    q = [F.col("q")[i] for i in range(3)]
    limits = texts.join(F.broadcast(middle), "language").groupBy("language", "middle").agg(F.percentile(distance, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    limits = limits.select("language", "middle", (q[0] - (q[1] - q[0]) * 2 * fence).alias("below"), (q[2] + (q[2] - q[1]) * 2 * fence).alias("above"))
    # One row for each language.
    out = scored.join(F.broadcast(limits), "language", "left")
    inside = F.coalesce(distance.between(F.col("below"), F.col("above")), F.lit(False))
    return out.withColumns({"low": F.col("middle") + F.col("below") / root, "high": F.col("middle") + F.col("above") / root, "inside": inside})


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fence: float = FENCE) -> DataFrame:
    """One row for each row of df: id, the base counts, log_perplexity (for each character), low, high, base_failed, kept.

    Words are runs of characters outside space and U+0009..U+000D.  base_failed: fewer than 10 words, or more than 20 %
    of the words in five-word windows that the text repeats.  A document is kept if it passes and its log perplexity
    lies between low and high, the limits for its language and number of words (see `with_limits`).

    Texts are dealt into two halves by a hash of the text, and each is scored by the model of its language's texts in the
    other half: what only one text has, or its exact copies, does not make it likelier.

    Every value of the language column has a model and limits of its own, null too.  Null and empty texts have counts of 0
    and a null log perplexity, and fail.  Repeated rows and null ids are rows like others.  Other columns are not read.
    An empty df gives no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    language = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    half = lambda turned: F.pmod(F.xxhash64(text_col) + turned, F.lit(2)).cast("string")
    docs = df.select(F.col(id_col).cast("long").alias("id"), language.alias("language"), F.concat(language, half(1)).alias("model"), F.col(text_col).alias("text"))
    files = spark.sparkContext.broadcast(train(df.select(F.concat(language, half(0)).alias("lang"), F.col(text_col).alias("text"))))  # names of files, one for each million entries
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches):
        known = Known()
        for batch in batches:
            for begin, texts in chunks(batch.column(3), SCORED_BYTES):
                parts = [base_counts(Words(own)) for _, own in chunks(batch.column(3).slice(begin, len(texts)))]
                counts = {c: np.concatenate([x[c] for x in parts]) for c in base}
                part = batch.slice(begin, len(texts))
                names, of = np.unique(np.array(part.column(2).to_pylist(), object).astype(str), return_inverse=True)
                total, n = score(files.value, texts, language_keys(names.tolist())[of], known)
                arrays = [part.column(0), part.column(1), *(pa.array(counts[c].astype(np.int64)) for c in base), pa.array(-total / np.maximum(n, 1), mask=n == 0)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "language", *base, "log_perplexity"])

    scored = saved(docs.mapInArrow(run, f"id long, language string, {', '.join(f'{c} long' for c in base)}, log_perplexity double"), "perplexity")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    out = with_limits(scored, fence).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("inside"))
    return out.select(F.col("id").alias(id_col), *base, "log_perplexity", "low", "high", "base_failed", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules on all documents."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
