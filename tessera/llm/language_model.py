"""Modified Kneser-Ney models of characters, one for each language, counted by Spark and stored in sorted hash arrays.

A text is taken as its code points, with one space for each run of white space; n-grams of five of them may cross words.
The models of all languages are one table of 64-bit hashes and numbers, cut into ranges of hashes: files of bounded size
with a sorted array each, in the folder that driver and executors share.  It grows with the corpus, so it is neither
broadcast nor collected.  A task looks up the different n-grams of a run of texts, in order, file by file.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import opened, resolved
from .scratch import dropped, new_folder, saved
from .textarrays import chunks, mixed

ORDER = 5
#: Entries of a file of the model; bytes of files that a Python worker keeps; n-grams that a task counts at once.
FILE_ENTRIES, CACHE_BYTES, RUN = 1 << 20, 96_000_000, 1 << 20
#: Rows that a task hands to Spark at once.
SENT = 1 << 16
#: N-grams whose log probability a task keeps.
MOST_KNOWN = 1 << 20
#: Places of texts that are handled at once.
STEP = 1 << 20
#: Texts are counted and scored in runs of so many bytes; the longer, the fewer n-grams are different.
TEXT_BYTES, SCORED_BYTES = 1_500_000, 750_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_SPACE = 0x20
#: Kinds of entries: what is left of an n-gram's count after the discount; a context's sums of counts and of discounts; the
#: share of a character that a language does not have.
LEFT, CONTEXT, UNSEEN = range(3)


def language_keys(names: list[str]) -> np.ndarray:
    """A 64-bit number for each language's name."""
    out = np.zeros(len(names), np.uint64)
    for i, name in enumerate(names):
        for c in name.encode("utf-8", "surrogatepass") + b"\xff":
            out[i : i + 1] = mixed(out[i : i + 1] * _ODD + np.uint64(c + 1))
    return out


def places(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of the texts, where in them places are (ORDER code points end in each), and the text of each, in runs of at most STEP.

    A text has a place for each character and one for its end, a space; before it come spaces.  Runs of white space are one
    character, so no two spaces in a row occur elsewhere.  A text without a word has no places.
    """
    before = " " * (ORDER - 1)
    raw = np.frombuffer(before.join(["", *[(t or "") + " " for t in texts], ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    word = (raw != _SPACE) & (raw - np.uint32(9) >= 5)
    place = word.copy()
    place[1:] |= word[:-1]  # the first space after a word
    size = np.fromiter((len(t) + ORDER if t else ORDER for t in texts), np.int64, len(texts))
    end = np.cumsum(size) + ORDER - 1
    taken = place.copy()
    taken[: ORDER - 1] = True
    for j in range(1, ORDER):
        taken[end - j] = True
    points, place_of = raw[taken], place[taken]
    points[points - np.uint32(9) < 5] = _SPACE
    points[points == 0] = 0xFFFD
    total = np.cumsum(np.add.reduceat(place, end - size, dtype=np.int64)) if len(texts) else np.zeros(0, np.int64)
    del raw, word, place, taken
    done = 0  # places in earlier runs
    for begin in range(0, len(points), STEP):
        at = np.flatnonzero(place_of[begin : begin + STEP])
        if len(at):
            low = max(0, begin - ORDER + 1)
            i, j = np.searchsorted(total, [done, done + len(at) - 1], side="right")
            doc = np.repeat(np.arange(i, j + 1), np.diff(np.minimum(total[i : j + 1], done + len(at)), prepend=done))
            yield points[low : begin + STEP], at + (begin - low), doc
            done += len(at)


def _columns(points: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The ORDER code points that end in each of the given places, first ones first."""
    return [points[at - j] for j in range(ORDER - 1, -1, -1)]


def _hashes(languages: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each n-gram with its language's key: a polynomial, so that those of its parts follow from it."""
    h = languages.copy()
    for column in columns:
        h += column
        h *= _ODD
    return h


def _place_hashes(points: np.ndarray, at: np.ndarray, languages: np.ndarray) -> np.ndarray:
    """The hash of the ORDER code points that end in each place."""
    h = np.zeros(len(points) - ORDER + 1, np.uint64)
    for j in range(ORDER):
        h += points[j : j + len(h)]
        h *= _ODD
    h = h[at - (ORDER - 1)]
    h += languages * np.uint64(pow(int(_ODD), ORDER, 1 << 64))
    return h


def _order(h: np.ndarray) -> np.ndarray:
    """Places of the hashes by size of their upper bits, as many as leave room for the place: sorting numbers is faster than places."""
    low = np.uint64((1 << len(h).bit_length()) - 1)
    packed = h & ~low
    packed |= np.arange(len(h), dtype=np.uint64)
    packed.sort()
    packed &= low
    return packed.view(np.int64)


def _groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that bring equal hashes together, and where in them each group begins.

    Hashes that differ in lower bits only may cut each other's groups into several, which are then handled apart.
    """
    order = _order(h)
    h = h[order]
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return order, np.flatnonzero(new)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different hash, and which of them each is."""
    order, begin = _groups(h)
    of = np.empty(len(h), np.int64)
    of[order] = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(h)))
    return order[begin], of


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n: how often each run of ORDER characters occurs in all texts of docs (lang, text)."""

    def run(batches):
        forget()
        names: dict[str, int] = {}
        found, n = [], 0  # hashes, code points, languages and counts of n-grams

        def merged():  # a column at a time, which then is no longer held in its parts
            columns = [list(x) for x in zip(*found, strict=True)]
            found.clear()
            whole = lambda: np.concatenate(columns.pop(0))
            h = whole()
            order, begin = _groups(h)
            first = order[begin]
            return h[first], np.add.reduceat(whole()[order], begin), whole()[first], whole()[first]

        def rows(_, count, lang, points):
            text = points.view(f"<U{ORDER}")[:, 0]
            for i in range(0, len(text), SENT):
                j = slice(i, i + SENT)
                yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()).take(pa.array(lang[j])), pa.array(text[j].tolist(), pa.string()), pa.array(count[j])], ["lang", "gram", "n"])

        for batch in batches:
            own = np.array([names.setdefault(x, len(names)) for x in batch.column(0).to_pylist()], np.int64)
            keys = language_keys(list(names))
            for begin, texts in chunks(batch.column(1), TEXT_BYTES):
                for points, at, doc in places(texts):
                    lang = own[begin + doc]
                    h = _place_hashes(points, at, keys[lang])
                    order, first = _groups(h)
                    count = np.diff(first, append=len(h))
                    first = order[first]
                    found.append((h[first], count, lang[first].astype(np.int32), np.stack(_columns(points, at[first]), axis=1)))
                    del h, order, lang
                    n += len(first)
                    if n > 2 * RUN:
                        found.append(merged())
                        n = len(found[0][0])
                        if n > RUN:
                            yield from rows(*found.pop())
                            n = 0
        if n:
            yield from rows(*merged())

    return docs.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(level: DataFrame) -> DataFrame:
    """lang and the discounts d1, d2, d3 of counts of 1, 2, and 3 or more, from how many n-grams have each count."""
    n = level.groupBy("lang").agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    raw = lambda k: F.when(F.col(f"n{k}") > 0, k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")).otherwise(0.5 * k)
    return n.select("lang", *[F.least(F.greatest(raw(k), F.lit(0.05)), F.lit(float(k))).alias(f"d{k}") for k in (1, 2, 3)])


def entries(docs: DataFrame) -> tuple[DataFrame, int, list[DataFrame]]:
    """kind, size, lang, gram, value and more of all entries of the models, an upper bound of their number, and saved tables.

    Of ORDER characters the occurrences are counted, of fewer the different characters before them.
    """
    level, out, most, levels = saved(count_grams(docs), "grams"), [], 0, []
    entry = lambda kind, size, df, value, more: df.select(F.lit(kind).alias("kind"), F.lit(size).alias("size"), "lang", "gram", value.cast("double").alias("value"), more.cast("double").alias("more"))
    for order in range(ORDER, 0, -1):
        levels.append(level)
        most += 2 * level.count()
        took = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        discounted = level.join(F.broadcast(_discounts(level)), "lang").withColumn("took", took)  # a row for each language
        sums = discounted.groupBy("lang", F.substring("gram", 1, order - 1).alias("gram")).agg(F.sum("n").alias("total"), F.sum("took").alias("weight"))
        out += [entry(LEFT, order, discounted, F.col("n") - F.col("took"), F.lit(0)), entry(CONTEXT, order - 1, sums, F.col("total"), F.col("weight"))]
        if order > 1:
            level = saved(level.groupBy("lang", F.substring("gram", 2, order - 1).alias("gram")).agg(F.count("*").alias("n")), "grams")
    out.append(entry(UNSEEN, 0, level.groupBy("lang").agg((1 / (F.count("*") + 1)).alias("value")).withColumn("gram", F.lit("")), F.col("value"), F.lit(0)))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole, most, levels


def _keys(kind: int, size: int, h: np.ndarray) -> np.ndarray:
    """Hashes of entries, as signed numbers, from those of n-grams of a size (of contexts: without the last character)."""
    return mixed(h + np.uint64(pow(int(_ODD), 8 * size + kind + 8, 1 << 64))).view(np.int64)


def _code_points(grams: list[str], size: int) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(grams), size)


def train(docs: DataFrame) -> list[tuple[str, int, int]]:
    """Writes the models of all languages of docs (lang, text); files with the smallest and largest hash of each, in order."""
    spark = docs.sparkSession
    rows, most, levels = entries(docs)

    def run(batches):
        for batch in batches:
            kind, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            names, of = np.unique(np.array(batch.column(2).to_pylist(), object).astype(str), return_inverse=True)
            keys, grams = language_keys(names.tolist())[of], np.array(batch.column(3).to_pylist(), object)
            out = np.zeros(len(kind), np.int64)
            for k, n in {(int(k), int(n)) for k, n in zip(kind, size, strict=True)}:
                own = np.flatnonzero((kind == k) & (size == n))
                out[own] = _keys(k, n, _hashes(keys[own], list(_code_points(grams[own].tolist(), n).T) if n else []))
            yield pa.RecordBatch.from_arrays([pa.array(out), batch.column(4), batch.column(5)], ["h", "value", "more"])

    path = new_folder(spark, "model")
    table = rows.mapInArrow(run, "h long, value double, more double").repartitionByRange(max(1, -(-most // FILE_ENTRIES)), "h").sortWithinPartitions("h")
    table.write.parquet(path)
    dropped(*levels)
    files = spark.read.schema("h long").parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("h").alias("low"), F.max("h").alias("high"))
    found = files.collect()  # one for each million entries
    real = resolved(spark, path)
    return sorted(((f"{real}/{r['file'].rsplit('/', 1)[1]}" if real != path else r["file"], r["low"], r["high"]) for r in found), key=lambda x: x[1])


_CACHE: OrderedDict[str, tuple[np.ndarray, np.ndarray]] = OrderedDict()


def _arrays(file: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and pairs of numbers of a file; a Python worker keeps those read last, up to CACHE_BYTES."""
    if file in _CACHE:
        _CACHE.move_to_end(file)
        return _CACHE[file]
    system, path = opened(file)
    table = pq.read_table(path, columns=["h", "value", "more"], filesystem=system)
    _CACHE[file] = table["h"].to_numpy(), np.stack([table["value"].to_numpy(), table["more"].to_numpy()], axis=1).astype(np.float32)
    while len(_CACHE) > 1 and sum(16 * len(h) for h, _ in _CACHE.values()) > CACHE_BYTES:
        _CACHE.popitem(last=False)
    return _CACHE[file]


def forget() -> None:
    """Lets a Python worker give up files of an earlier model."""
    _CACHE.clear()


def look_up(files: list[tuple[str, int, int]], keys: np.ndarray) -> np.ndarray:
    """The two numbers of each key, 0 for those that the model does not have."""
    order = _order(keys.view(np.uint64) ^ np.uint64(1 << 63))
    sorted_keys = keys[order]
    if (sorted_keys[1:] < sorted_keys[:-1]).any():  # keys that differ in lower bits only
        order = np.argsort(keys)
        sorted_keys = keys[order]
    found = np.zeros((len(keys), 2), np.float32)
    for file, low, high in files:
        a, b = np.searchsorted(sorted_keys, low), np.searchsorted(sorted_keys, high, side="right")
        if a < b:
            h, values = _arrays(file)
            at = np.minimum(np.searchsorted(h, sorted_keys[a:b]), len(h) - 1)
            found[a:b] = np.where((h[at] == sorted_keys[a:b])[:, None], values[at], 0)
    out = np.empty((len(keys), 2), np.float32)
    out[order] = found
    return out.astype(np.float64)


def log_probabilities(files: list[tuple[str, int, int]], languages: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of the probability of the last column's code points after the others, in the language of each key.

    A language that the model does not have gives every character the same small share.
    """
    wanted, orders = [], []  # of each order the different n-grams and contexts, the longest first
    h = _hashes(languages, columns)
    for size in range(ORDER, 0, -1):
        before = h * _INVERSE - columns[-1]
        first, context = _distinct(before)
        wanted += [_keys(LEFT, size, h), _keys(CONTEXT, size - 1, before[first])]
        power = np.uint64(pow(int(_ODD), size - 1, 1 << 64))
        after = h - ((languages + columns[0]) * _ODD - languages) * power
        shorter, of = _distinct(after)
        orders.append((context, of))
        h, languages, columns = after[shorter], languages[shorter], [x[shorter] for x in columns[1:]]
    wanted.append(_keys(UNSEEN, 0, h))
    found = np.split(look_up(files, np.concatenate(wanted)), np.cumsum([len(x) for x in wanted])[:-1])
    p = np.where(found[-1][:, 0] > 0, found[-1][:, 0], 1 / 0x110000)
    for k in range(ORDER - 1, -1, -1):
        context, of = orders[k]
        total, weight = found[2 * k + 1][context].T
        p = np.where(total > 0, (found[2 * k][:, 0] + weight * p[of]) / np.maximum(total, 1), p[of])
    return np.log(p)


class Known:
    """Log probabilities of n-grams that a task has looked up, by their hashes in order: up to MOST_KNOWN, then it starts anew with those just looked up."""

    def __init__(self):
        self.h, self.logs = np.zeros(0, np.uint64), np.zeros(0)

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log probability of each n-gram, and which are not known."""
        if not len(self.h):
            return np.zeros(len(h)), np.arange(len(h))
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return self.logs[at], np.flatnonzero(self.h[at] != h)

    def add(self, h: np.ndarray, logs: np.ndarray) -> None:
        if len(self.h) + len(h) <= MOST_KNOWN:
            h, logs = np.concatenate([self.h, h]), np.concatenate([self.logs, logs])
        order = np.argsort(h, kind="stable")  # merges what is in order already
        self.h, self.logs = h[order], logs[order]


def score(files: list[tuple[str, int, int]], texts: list[str | None], languages: np.ndarray, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the log probabilities of all places of each text in the language of its key, and the number of places.

    known: what earlier calls with the same files looked up; this one adds to it.
    """
    known = known or Known()
    total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for points, at, doc in places(texts):
        h = _place_hashes(points, at, languages[doc])
        first, of = _distinct(h)
        logs, new = known.of(h[first])
        if len(new):
            own = first[new]
            logs[new] = log_probabilities(files, languages[doc[own]], _columns(points, at[own]))
            known.add(h[own], logs[new])
        total += np.bincount(doc, logs[of], len(texts))
        n += np.bincount(doc, minlength=len(texts))
    return total, n
