"""Languages of documents by a mixture of n-gram models.

Each word of a document is taken to be of one of the learned languages, by the likelihood of its trigrams of bytes.
Expectation-maximisation estimates the shares of the languages in each document.  Of the sets of the k languages with
the largest shares, that with the best likelihood less a penalty for each language is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import saved, small_batches
from .textarrays import PIECE, Words, chunks, mixed

NONE = "und"
#: Trigrams are counted by a hash of so many bits, or of fewer if languages are so many that counts would pass MOST_COUNTS.
BITS, MOST_COUNTS = 17, 1 << 25
#: EM ends when no share of any text changes by more than this; after MOST_TURNS in any case.
SETTLED, MOST_TURNS = 1e-3, 500
#: With more trigrams than this, texts differ by more than chance, so more do not sharpen a limit.
ENOUGH = 1000
#: Texts are taken in runs of so many bytes where fits are found, which takes more memory for each byte.
FIT_BYTES = 100_000
#: Added to every count.
ALPHA = 0.5
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _packed(w: Words, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each trigram of the given words, a space before and after each word included; and its word."""
    data, of = w.bytes_of(words)
    n = np.bincount(of, minlength=len(words))
    size = n + 2
    begin = np.cumsum(size) - size
    row = np.full(size.sum(), 0x20, np.uint64)
    row[np.repeat(begin + 1, n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)] = data
    packed = row[:-2] | row[1:-1] << np.uint64(8) | row[2:] << np.uint64(16) if len(row) > 2 else np.zeros(0, np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    inside = word[:-2] == word[2:] if len(row) > 2 else np.zeros(0, bool)
    return packed[inside], word[:-2][inside] if len(row) > 2 else word[:0]


def _hashed(packed: np.ndarray, size: int) -> np.ndarray:
    """A hash below size, a power of 2."""
    return (mixed(packed) >> np.uint64(64 - (size - 1).bit_length())).astype(np.int64)


def _in_runs(w: Words, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The given words in runs of at most PIECE // 8 bytes (one word at least), with the place of the first."""
    total = np.cumsum(w.end[words] - w.start[words])
    at = 0
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PIECE // 8, side="right")))
        yield at, words[at:end]
        at = end


def word_trigrams(w: Words, words: np.ndarray, size: int, lettered: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word of each trigram of bytes of the given words, a space before and after each word included.

    lettered: only trigrams without a digit or ASCII mark, which show a language and not the form of a text.
    """
    grams, of = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for at, some in _in_runs(w, words):
        packed, word = _packed(w, some)
        if lettered:
            kept = _lettered(packed)
            packed, word = packed[kept], word[kept]
        grams.append(_hashed(packed, size).astype(np.int32))
        of.append(word + at)
    return np.concatenate(grams), np.concatenate(of)


def _lettered(packed: np.ndarray) -> np.ndarray:
    """Whether each trigram has no digit and no ASCII mark."""
    usual = _LETTER.copy()
    usual[0x80:] = usual[0x20] = True
    return usual[packed & np.uint64(255)] & usual[packed >> np.uint64(8) & np.uint64(255)] & usual[packed >> np.uint64(16)]


def _worded(w: Words) -> np.ndarray:
    """Whether each word has a letter: one of a to z, or a character beyond ASCII."""
    return w.some_byte(_LETTER[w.data] | (w.data >= 0x80))


def counted(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages, and how often each hash occurs in each of them, from docs (text, lang) without nulls.

    Each task adds up its counts before they are shuffled; there are at most MOST_COUNTS of them in all.
    """
    names = sorted(r[0] for r in docs.select("lang").distinct().collect())
    size = 1 << min(BITS, max(2, (MOST_COUNTS // max(len(names), 1)).bit_length() - 1))

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for begin, texts in chunks(batch.column(0)):
                w = Words(texts, lower=True)
                names, lang = np.unique(np.array(langs[begin : begin + len(texts)], object).astype(str), return_inverse=True)
                use = np.flatnonzero(_worded(w))
                key = w.hashes()[use] ^ mixed(lang[w.doc[use]].astype(np.uint64))
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                gram, of = word_trigrams(w, use[first], size)
                own = lang[w.doc[use[first]]][of]
                for x, name in enumerate(names.tolist()):
                    counts = total.setdefault(name, np.zeros(size, np.int64))
                    counts += np.bincount(gram[own == x], n[of[own == x]], size).astype(np.int64)
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at])], ["lang", "gram", "n"])

    counts = docs.select("text", "lang").mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = np.zeros((size, len(names)))
    rows = counts.toPandas()
    table[rows["gram"].to_numpy(np.int64), np.searchsorted(names, rows["lang"].to_numpy(str)) if names else []] += rows["n"].to_numpy(np.float64)
    return names, table


def learned(table: np.ndarray) -> np.ndarray:
    """The log frequency of each hash in each language, from counts."""
    return np.log((table + ALPHA) / (table + ALPHA).sum(axis=0)).astype(np.float32)


def least_fits(docs: DataFrame, names: list[str], table: np.ndarray, fence: float) -> np.ndarray:
    """Median fit of each language's texts, and the least distance from it times the root of the number of trigrams.

    docs: the rows (text, lang) that the counts in table are of.  The fit (see `fits_of`) of each row is taken without the
    row's own counts, as other texts have none.  The least distance lies twice `fence` times the distance from the lower
    quartile to the median below that quartile.
    """
    shared = docs.sparkSession.sparkContext.broadcast((table, table.sum(axis=0)))  # at most MOST_COUNTS values
    n_hashes = len(table)

    def run(batches):
        seen, total = shared.value
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for begin, texts in chunks(batch.column(0), FIT_BYTES):
                w = Words(texts, lower=True)
                use = np.flatnonzero(_worded(w))
                if not len(use):
                    continue
                lang = np.searchsorted(names, np.array(langs[begin : begin + len(texts)], object).astype(str))
                gram, of = word_trigrams(w, use, n_hashes)
                key, own = np.unique(w.doc[use][of] * n_hashes + gram, return_counts=True)
                all_own = np.bincount(key // n_hashes, own, w.n_texts)
                use = use[np.sort(np.unique(w.hashes()[use] ^ mixed(w.doc[use].astype(np.uint64)), return_index=True)[1])]
                gram, of = word_trigrams(w, use, n_hashes, lettered=True)
                doc = w.doc[use][of]
                own = own[np.searchsorted(key, doc * n_hashes + gram)]
                best = np.full(len(use), -np.inf)
                for x in range(len(names)):
                    mine = lang[doc] == x
                    logs = np.log(seen[gram, x] - own * mine + ALPHA) - np.log(total[x] - all_own[doc] * mine + ALPHA * n_hashes)
                    best = np.maximum(best, np.bincount(of, logs, len(use)))
                size = np.bincount(doc, minlength=w.n_texts)
                some = np.flatnonzero(size)
                fit = np.bincount(w.doc[use], best, w.n_texts)[some] / size[some]
                yield pa.RecordBatch.from_arrays([pa.array(lang[some].astype(np.int32)), pa.array(fit), pa.array(size[some].astype(np.float64))], ["language", "fit", "size"])

    fits = saved(docs.select("text", "lang").mapInArrow(run, "language int, fit double, size double"), "fits")
    middle = fits.groupBy("language").agg(F.percentile(F.round("fit", 3), 0.5).alias("middle"))  # of few distinct values
    distance = F.round((F.col("fit") - F.col("middle")) * F.sqrt(F.least("size", F.lit(float(ENOUGH)))), 1)
    rows = fits.join(F.broadcast(middle), "language").groupBy("language", "middle").agg(F.percentile(distance, F.array(F.lit(0.25), F.lit(0.5))).alias("q")).collect()
    out = np.full((2, len(names)), -np.inf)
    for r in rows:  # one for each language
        low, half = r["q"]
        out[:, r["language"]] = r["middle"], low - 2 * fence * (half - low)
    return out


def fits_of(w: Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean log likelihood of a trigram of letters in the different words of each text; and their number.

    Each word counts in the language it is likeliest in, so a text of several languages fits as well as one of one.
    """
    use = np.flatnonzero(_worded(w))
    if not len(use):
        return np.zeros(w.n_texts), np.zeros(w.n_texts)
    _, first, of = np.unique(w.hashes()[use], return_index=True, return_inverse=True)
    gram, word = word_trigrams(w, use[first], len(table), lettered=True)
    best = np.max([np.bincount(word, table[gram, x], len(first)) for x in range(table.shape[1])], axis=0)
    entry = np.unique(w.doc[use] * np.int64(len(first)) + of)
    doc, of = entry // len(first), entry % len(first)
    size = np.bincount(doc, np.bincount(word, minlength=len(first))[of], w.n_texts)
    return np.bincount(doc, best[of], w.n_texts) / np.maximum(size, 1), size


def _mixture(like: np.ndarray, n: np.ndarray, start: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the allowed languages in each document, and its log likelihood, by expectation-maximisation.

    like: likelihood of each (document, word) entry in each language, of which the largest is 1; n: how often it occurs;
    start: first entry of each document, each of which has one at least.
    """
    share = allowed / allowed.sum(axis=1, keepdims=True)
    total = np.add.reduceat(n, start)[:, None]
    size = np.diff(np.append(start, len(n)))
    active, at, doc = np.arange(len(start)), np.arange(len(n)), np.repeat(np.arange(len(start)), size)
    for _ in range(MOST_TURNS if allowed.sum(axis=1).max(initial=1) > 1 else 0):
        part = share[active][doc] * like[at]
        part *= (n[at] / np.maximum(part.sum(axis=1), 1e-30))[:, None]
        new = np.add.reduceat(part, np.cumsum(size[active]) - size[active], axis=0) / total[active]
        moves = np.abs(new - share[active]).max(axis=1) > SETTLED
        share[active] = new
        if not moves.all():  # what has settled takes no more turns
            at, active = at[moves[doc]], active[moves]
            doc = np.repeat(np.arange(len(active)), size[active])
            if not len(active):
                break
    fit = np.add.reduceat(n * np.log(np.maximum((np.repeat(share, size, axis=0) * like).sum(axis=1), 1e-30)), start)
    return share, fit


def infer(w: Words, table: np.ndarray, penalty: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares (texts x languages) of each text's chosen set, how many languages it has, and which texts have any word.

    For every k the k languages with the largest shares in the mixture of all are a set; that with the best log likelihood
    less `penalty` times k times the log of the number of words is chosen, the smallest among equals.  Sets that could not
    be better even with the likelihood of all languages are not tried.
    """
    languages = table.shape[1]
    shares, count = np.zeros((w.n_texts, languages)), np.zeros(w.n_texts, np.int64)
    has = np.zeros(w.n_texts, bool)
    use = np.flatnonzero(_worded(w))
    if not len(use):
        return shares, count, has
    _, first, of = np.unique(w.hashes()[use], return_index=True, return_inverse=True)
    gram, word = word_trigrams(w, use[first], len(table))
    logs = np.add.reduceat(table[gram], np.searchsorted(word, np.arange(len(first))), axis=0)  # every word has a trigram
    like = np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -25)).astype(np.float64)
    entry, n = np.unique(w.doc[use] * np.int64(len(first)) + of, return_counts=True)
    n, like = n.astype(np.float64), like[entry % len(first)]
    texts, doc = np.unique(entry // len(first), return_inverse=True)
    size = np.bincount(doc)
    start = np.cumsum(size) - size
    share, fit = _mixture(like, n, start, np.ones((len(texts), languages)))
    cost = penalty * np.log(np.maximum(np.add.reduceat(n, start), 2))
    order = np.argsort(-share, axis=1, kind="stable")
    best, chosen, number = np.full(len(texts), -np.inf), share.copy(), np.full(len(texts), languages)
    for k in range(1, languages + 1):
        rest = np.flatnonzero(fit + 0.01 - k * cost > best)  # 0.01: what EM may be short of the maximum
        if not len(rest):
            break
        own = np.flatnonzero(np.isin(doc, rest))
        allowed = np.zeros((len(rest), languages))
        np.put_along_axis(allowed, order[rest, :k], 1.0, axis=1)
        found, value = _mixture(like[own], n[own], np.cumsum(size[rest]) - size[rest], allowed)
        value -= k * cost[rest]
        better = value > best[rest]
        at = rest[better]
        best[at], chosen[at], number[at] = value[better], found[better], k
    shares[texts], count[texts], has[texts] = chosen, number, True
    return shares, count, has


def _rows(batches: Iterator[pa.RecordBatch], text_at: int, names: list[str], table: np.ndarray, least: np.ndarray | None):
    for batch in batches:
        for begin, texts in chunks(batch.column(text_at), *([] if least is None else [FIT_BYTES])):
            w = Words(texts, lower=True)
            if names:
                shares, size, has = infer(w, table)
            else:
                shares, size, has = np.zeros((len(texts), 1)), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
            at, score = shares.argmax(axis=1), shares.max(axis=1)
            letters = [bool(h) and any(map(str.isalpha, t)) for h, t in zip(has.tolist(), texts, strict=True)]
            lang = [names[a] if x else NONE for a, x in zip(at.tolist(), letters, strict=True)]
            sets = [[names[i] for i in np.flatnonzero(s > 0)] if x else [] for s, x in zip(shares, letters, strict=True)] if names else [[] for _ in texts]
            known = np.array(letters, bool)
            if least is not None and names:
                fit, n = fits_of(Words([t if t is None else t.lower() for t in texts], lower=True), table)
                known &= (n > 0) & ((fit - least[0, at]) * np.sqrt(np.minimum(n, ENOUGH)) >= least[1, at])
            yield batch.slice(begin, len(texts)), lang, np.where(letters, np.minimum(score, 1.0), 0.0), sets, known


def identify_languages(df: DataFrame, training: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), fence: float | None = None) -> DataFrame:
    """The `keep` columns of each row of df with lang_pred, score (its share of the text's words) and lang_set.

    training: rows with columns text and lang to learn from; rows with a null in either are left out.  lang_pred is a
    learned language, or ``und`` with score 0 and an empty set for a null text, one without a letter, and all texts if
    nothing could be learned.  Equal shares go to the language first by name.  Repeated rows are rows like others.
    Columns of df that are not kept are not read; kept columns named like the operator's give way to them.  An empty df
    gives no rows.  Any number of languages may be learned (see MOST_COUNTS).

    The score compares languages with each other only.  With `fence` there is a column known too: whether the text has a
    language and its trigrams are as likely in the learned languages as those of the training rows of lang_pred (see
    `least_fits`).
    """
    small_batches(df.sparkSession)
    usable = training.where("text is not null and lang is not null")
    names, table = counted(usable)
    least = None if fence is None else least_fits(usable, names, table, fence)
    table = learned(table)
    shared = df.sparkSession.sparkContext.broadcast(table)  # at most MOST_COUNTS values
    found = ["lang_pred", "score", "lang_set"] + ([] if fence is None else ["known"])
    keep = tuple(c for c in keep if c not in found)
    docs = df.select(*keep, *([] if text_col in keep else [text_col]))
    text_at = docs.columns.index(text_col)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)

    def run(batches):
        for rows, lang, score, sets, known in _rows(batches, text_at, names, shared.value, least):
            kept = [rows.column(i) for i in range(len(keep))]
            made = [pa.array(lang, pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string())), pa.array(known)]
            yield pa.RecordBatch.from_arrays([*kept, *made[: len(found)]], [*keep, *found])

    return docs.mapInArrow(run, f"{types}, lang_pred string, score double, lang_set array<string>" + ("" if fence is None else ", known boolean"))


def training_rows(docs: DataFrame) -> DataFrame:
    """Text and language of the documents that may be learned from: those whose id's crc32 modulo 5 is not 0."""
    return docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).where("lang is not null").select("text", "lang")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify_languages(docs, training_rows(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "lang_set")
