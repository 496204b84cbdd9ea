"""Best-fit-decreasing packing of documents into token sequences, with certified numbers of sequences.

Pieces are dealt to partitions of bounded size by a hash, and each is packed by best-fit decreasing.  Dual-feasible
functions give a lower bound of each partition's number of bins; a partition that meets it is certified, another has a
gap.  Bins with room left, from all partitions with a gap and the emptier ones of the others, are then exchanged between
partitions and packed again, as long as that frees bins and the total is above the bound of all pieces.  When it frees
none, fuller bins take part as well.  A turn writes only the bins that moved; others stay in the tables of earlier turns.
"""

from __future__ import annotations

import logging
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import saved, small_batches
from .textarrays import chunks
from .tokens import END_ID, ids_crc32, tokenizer, vocabulary_path

CAPACITY = 4096
#: A bin's number is that of its turn, its group and its place there, of so many bits.
TURN_BITS, GROUP_BITS, PLACE_BITS = 15, 24, 24
#: Turns in a row without a freed bin after which fuller bins are exchanged too, or the packing ends.
IDLE = 3
log = logging.getLogger(__name__)
_PIECES = "id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", bin long, offset long, gap boolean, room long"


def pieces(docs: DataFrame, capacity: int, vocabulary: str) -> DataFrame:
    """Rows of docs (id, text, and place if they have one) as pieces of at most `capacity` ids; only longer ones are cut."""
    placed = "place" in docs.columns

    def run(batches):
        encode = tokenizer(vocabulary).encode
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows, of = [], []
            for begin, texts in chunks(batch.column(1)):
                for row, (key, text) in enumerate(zip(keys[begin : begin + len(texts)], texts, strict=True), begin):
                    ids = np.append(encode(text), np.uint32(END_ID))
                    rows += [(key, n, at, min(capacity, len(ids) - at), ids_crc32(ids[at : at + capacity])) for n, at in enumerate(range(0, len(ids), capacity))]
                    of += [row] * (len(rows) - len(of))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)]
            arrays += [batch.column(2).take(pa.array(of, pa.int64()))] if placed else []
            yield pa.RecordBatch.from_arrays(arrays, ["id", "piece", "start", "length", "ids_crc32"] + ["place"] * placed)

    return docs.mapInArrow(run, _PIECES + ", place long" * placed)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place of each piece, and the room left in each bin: the longest first, each to the fullest bin with room."""
    bins, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[int] = []
    at_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = at_room[r].pop()
            if not at_room[r]:
                some &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offset[i] = b, capacity - r
        room[b] = r - n
        if r > n:
            at_room[r - n].append(b)
            some |= 1 << (r - n)
    return bins, offset, np.array(room, np.int64)


def lower_bound(counts: np.ndarray, capacity: int, most: int = 200) -> int:
    """The largest bound of three families of dual-feasible functions; counts[n] pieces have length n.

    Such a function f has sum f(x) <= 1 over every set of lengths that fits one bin, so the sum over all pieces is a bound.
    Sizes and thresholds are whole numbers, so that bounds are exact.
    """
    x = np.flatnonzero(counts)
    n = counts[x].astype(object)
    if not len(x):
        return 0
    ceil = lambda total, unit: -(-int(total) // int(unit))
    best = ceil((n * x).sum(), capacity)
    for k in range(1, 21):  # rounding to multiples of 1 / k
        whole = (k + 1) * x % capacity == 0
        best = max(best, ceil((n * np.where(whole, k * x, (k + 1) * x // capacity * capacity)).sum(), k * capacity))
    small = x[2 * x <= capacity]
    for e in np.unique(small[np.linspace(0, len(small) - 1, min(most, len(small))).astype(int)]) if len(small) else ():
        # Pieces over capacity - e fill a bin, those under e count nothing.
        best = max(best, ceil((n * np.where(x > capacity - e, capacity, np.where(x < e, 0, x))).sum(), capacity))
        # Pieces over a half count the places of e that they take from a bin, others the places that they fill.
        places = capacity // e
        f = np.where(2 * x > capacity, 2 * (places - (capacity - x) // e), np.where(2 * x == capacity, places, 2 * (x // e)))
        best = max(best, ceil((n * f).sum(), 2 * places))
    return best


def _pack(capacity: int, turn: int, placed: bool = False):
    """applyInArrow function: packs a partition's pieces; leaves bins as they were if that takes no fewer and does not gather their room in fewer."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        bins, offset, room = best_fit_decreasing(lengths, capacity)
        used = len(room)
        gap = used > lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        ids = (turn << (GROUP_BITS + PLACE_BITS)) + (key[0].as_py() << PLACE_BITS) + bins
        gathered = (room**2).sum()
        room = room[bins] if len(room) else bins
        if turn:
            old, first = np.unique(table["bin"].to_numpy(), return_index=True)
            if (used, -gathered) >= (len(old), -(table["room"].to_numpy()[first] ** 2).sum()):
                old = table["bin"].to_numpy()
                ids, offset, room = old, table["offset"].to_numpy(), table["room"].to_numpy()
        columns = {c: table[c] for c in ("id", "piece", "start", "length", "ids_crc32") + ("place",) * placed}
        return pa.table(columns | {"bin": pa.array(ids), "offset": pa.array(offset), "gap": pa.array(np.full(len(ids), gap)), "room": pa.array(room)})

    return run


def _ranges(df: DataFrame, place: str, parts: int) -> DataFrame:
    """df with g: `parts` ranges of place (from 0) with about as many rows each, and with first: rows before each range.

    Rows are counted in 16 times as many ranges of equal width, so only that many counts go to the driver.
    """
    most = df.agg(F.max(place)).first()[0] or 0
    fine = F.floor(F.col(place) * (16 * parts) / F.lit(float(most + 1))).cast("int")
    counts = sorted((r[0], r[1]) for r in df.groupBy(fine).count().collect())
    total, before, first, rows = sum(n for _, n in counts), 0, {}, []
    for f, n in counts:
        g = before * parts // total
        rows.append((f, g, first.setdefault(g, before)))
        before += n
    table = df.sparkSession.createDataFrame(rows, "fine int, g long, first long")
    return df.withColumn("fine", fine).join(F.broadcast(table), "fine").drop("fine")


def _in_order(packed: DataFrame, parts: int) -> DataFrame:
    """packed with bins numbered from 0 by the mean place of their ids."""
    mean = F.round(F.sum(F.col("place") * F.col("length")) / F.sum("length"), 3)
    numbered = _ranges(packed.groupBy("bin").agg(mean.alias("middle")), "middle", parts)
    number = F.col("first") + F.row_number().over(Window.partitionBy("g").orderBy("middle", "bin")) - 1
    return packed.join(numbered.select("bin", number.cast("long").alias("number")), "bin").drop("bin").withColumnRenamed("number", "bin")


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, partition_pieces: int = 20_000, slack: int = 16, place_col: str | None = None) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are the tokenizer's and one end id; a null or empty text has the end id only.  Rows with the same id,
    and rows without one, are documents of their own.  Other columns are not read.  An empty df gives no pieces.

    Bins are exchanged turn by turn until the bound of all pieces is met, or IDLE turns free none even with all bins that have
    room; the number of bins and the bound are logged.  slack: bins with less room than this take part last.

    place_col: a whole number from 0 that sequences follow.  Pieces are then dealt by ranges of places and not by a hash,
    bins are exchanged between neighbouring ranges only, and sequences are numbered from 0 by the mean place of their ids.
    """
    small_batches(df.sparkSession)
    placed = place_col is not None
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *([F.col(place_col).cast("long").alias("place")] if placed else []))
    cut = saved(pieces(docs, capacity, vocabulary or vocabulary_path()), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    counts[list(histogram)] = list(histogram.values())
    least, n = lower_bound(counts, capacity), int(counts.sum())
    parts = lambda n: max(1, -(-n // partition_pieces))
    packed_type = _PACKED + ", place long" * placed
    if placed:
        dealt = _ranges(cut, "place", parts(n)).drop("first")
    else:
        dealt = cut.withColumn("g", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(parts(n))))
    ordered = ["id", "piece", "start", "length", "ids_crc32", "bin", "offset", "gap", "room"] + ["place"] * placed
    pack = lambda turn: lambda key, table: _pack(capacity, turn, placed)(key, table).select(ordered)
    packed = saved(dealt.groupBy("g").applyInArrow(pack(0), packed_type), "packed")
    # Each table with the bins that have left it: all that gave at that time.
    tables, left = [packed], [F.lit(False)]
    # Bins of partitions with a gap, and of certified ones, that have so much room take part; ever fuller ones.
    least_room = [(slack, capacity // 8), (slack, slack), (1, 1)]
    turn, idle, before = 0, 0, None
    while True:
        turn += 1
        give = F.when(F.col("gap"), F.col("room") >= least_room[0][0]).otherwise(F.col("room") >= least_room[0][1])
        here = [df.where(~gone) for df, gone in zip(tables, left, strict=True)]
        every = reduce(DataFrame.unionByName, here)
        used, opened, moving = every.agg(F.count_if(F.col("offset") == 0), F.count_if((F.col("offset") == 0) & give), F.count_if(give)).first()
        idle, before = idle + 1 if used == before else 0, used
        log.info("turn %d: %d bins, at least %d are needed", turn, used, least)
        alone = parts(n if placed else moving) == 1  # all that moves was packed together
        if used <= least or turn >= 1 << TURN_BITS or (placed and alone):
            break
        if opened < 2 or idle == (1 if alone else IDLE):
            if len(least_room) == 1:
                break
            least_room, idle, before = least_room[1:], 0, None
            continue
        if placed:  # ranges 2i and 2i + 1, then 2i - 1 and 2i, and so on; pairs keep the number of their first range
            range_of = F.expr(f"(bin >> {PLACE_BITS}) & {(1 << GROUP_BITS) - 1}")
            group = F.greatest(range_of - (range_of + turn + 1) % 2, F.lit(0))
        else:
            group = F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(parts(moving)))
        again = every.where(give).withColumn("g", group).groupBy("g").applyInArrow(pack(turn), packed_type)
        tables.append(saved(again, "packed"))
        left = [gone | give for gone in left] + [F.lit(False)]
    packed = every
    log.info("packed into %d bins, at least %d are needed", used, least)
    if placed:
        packed = _in_order(packed, parts(n))
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
