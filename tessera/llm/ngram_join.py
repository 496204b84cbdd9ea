"""Similarity self-join of documents on word shingles, by vertical partitioning.

Order and fragments.  Shingles are ordered by a mixed 64-bit hash.  Any total order serves the method; this one needs no
counting pass, and equal ranges of it hold equal shares of every set.  The order is cut at fixed places into fragments
of which each gets its part of each set.

Candidates.  Two sets that link differ in at most d elements.  Cut into k > d fragments they agree on at least k - d
whole fragments, so they share a fragment's hash.  Sets of other sizes than d was chosen for are covered by size
classes; a set emits hashes for its own class and for those of the smallest sets that it may link with.  A common line
or passage makes no candidates: the other shingles of each text fall among its shingles in the order.

Most hashes occur once.  To find the others, tasks send sorted runs of 32 bits of each hash, cut by its upper bits into
buckets of bounded size; what occurs twice in a bucket is a superset of the shared hashes, the same small share too
large at every size of the corpus.  Only shared hashes are then sent with their set.

Counting.  In each group of equal fragment hashes all members are candidates of the smallest one.  Pairs that differ too
much by size or by the bits of their bitmaps are passed over, which loses no link.  The overlap of each other pair is
counted in each fragment of the order by itself and summed per pair.  Pairs in a group that this leaves open (neither is
the smallest, and the links found do not join them) are compared in blocks of bounded size, again as the sum of the
fragments' overlaps, of which only links leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import saved, small_batches
from .textarrays import Words, chunks, mixed, run_hash

#: Bits of a bitmap by which tasks tell what they need not send: 16 for each value, 2 ** 28 (32 MB) at most.
LEAST_BITS, MOST_BITS = 20, 28
#: Hashes that a task sorts at once, and that a bucket has on average.
RUN, BUCKET = 1 << 19, 1 << 20
#: Bits of the bitmap of a set, as 64-bit words.
BITS = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)


def size_classes(num: int, den: int, largest: int, ratio: float = 1.25) -> np.ndarray:
    """Rows (smallest size, first size of the next class, skipped, fragments) for sets up to the largest size.

    The smaller of two linked sets has n elements, and then they differ in d <= (den - num) * n / num elements at most.
    Each set may leave out its `skipped` smallest fragments, which say least; k = d + 2 * skipped + 1 fragments leave
    one that agrees and that neither leaves out.
    """
    rows, low = [], 1
    while low <= largest:
        high = max(low + 1, int(low * ratio))
        d = (den - num) * (high - 1) // num
        skipped = 0 if d < 4 else 1 + (d * (den - num)) // (3 * den)
        rows.append((low, high, skipped, d + 2 * skipped + 1))
        low = high
    return np.array(rows, np.int64).reshape(-1, 4)


class Sets:
    """Shingle sets of a run of texts: elements ascending within each text, its number of them, its set's hash."""

    def __init__(self, texts: list[str | None], k: int):
        w = Words(texts, lower=True)
        h = w.hashes()
        out, at = w.windows(k, h)
        doc = w.doc[at]
        for m in range(1, k):  # fewer words than a shingle: the whole text is one
            few = np.flatnonzero(w.counts == m)
            if len(few):
                out = np.concatenate([out, run_hash(h, w.first[few], m) ^ np.uint64(m)])
                doc = np.concatenate([doc, few])
        if len(doc) and (np.diff(doc) < 0).any():
            order = np.argsort(doc, kind="stable")
            out, doc = out[order], doc[order]
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[a:b].sort()
        new = np.ones(len(out), bool)
        new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
        self.elements, self.doc = out[new], doc[new]
        self.size = np.bincount(self.doc, minlength=len(texts))
        self.bounds = np.concatenate([[0], np.cumsum(self.size)])
        self.hash = np.zeros(len(texts), np.uint64)
        full = np.flatnonzero(self.size)
        if len(full):
            self.hash[full] = mixed(np.add.reduceat(mixed(self.elements ^ _ODD), self.bounds[full]) + self.size[full].astype(np.uint64) * _ODD)

    def _taken(self, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each class that sets take part in, from their own down: which sets, and their rows of size_classes."""
        classes = size_classes(num, den, int(self.size.max()) if len(self.size) else 0)
        own = np.searchsorted(classes[:, 0], self.size, side="right") - 1
        for below in range(len(classes)):
            c = own - below
            takes = (self.size > 0) & (c >= 0)
            takes[takes] = den * (classes[c[takes], 1] - 1) >= num * self.size[takes]
            who = np.flatnonzero(takes)
            if not len(who):
                return
            yield who, np.column_stack([c[who], classes[c[who]]])

    def hash_counts(self, num: int, den: int) -> np.ndarray:
        """How many hashes fragment_hashes gives for each set."""
        out = np.zeros(len(self.size), np.int64)
        for who, rows in self._taken(num, den):
            out[who] += rows[:, 4] - rows[:, 3]
        return out

    def fragment_hashes(self, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of each fragment of each set, for all classes that it takes part in."""
        found = [self._of_class(who, rows[:, 0], rows[:, 3], rows[:, 4]) for who, rows in self._taken(num, den)]
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate([h for h, _ in found]), np.concatenate([d for _, d in found])

    def bitmaps(self, who: np.ndarray) -> np.ndarray:
        """(sets, BITS // 64) words: a bit for each element of each of the given sets."""
        size = self.size[who]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.bounds[who], size)
        out = np.zeros((len(who), BITS), bool)
        out[np.repeat(np.arange(len(who)), size), (mixed(self.elements[at]) >> np.uint64(64 - (BITS - 1).bit_length())).astype(np.int64)] = True
        return np.packbits(out, axis=1, bitorder="little").view(np.uint64)

    def _of_class(self, who: np.ndarray, c: np.ndarray, skipped: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[who]
        local = np.repeat(np.arange(len(who)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.bounds[who], size)
        e = self.elements[at]
        base = np.cumsum(k) - k
        slot = ((e >> np.uint64(32)) * k[local].astype(np.uint64) >> np.uint64(32)).astype(np.int64) + base[local]
        total = np.zeros(len(e) + 1, np.uint64)
        np.cumsum(mixed(e + _ODD), out=total[1:])
        edge = np.searchsorted(slot, np.arange(k.sum() + 1))
        count = np.diff(edge)
        doc = np.repeat(np.arange(len(who)), k)
        part = np.arange(k.sum()) - base[doc]
        rank = np.empty(len(doc), np.int64)
        rank[np.argsort((doc << 40) + (np.minimum(count, 0xFFFFF) << 20) + part, kind="stable")] = part
        label = (c[doc].astype(np.uint64) << np.uint64(32)) + part.astype(np.uint64)
        h = mixed((total[edge[1:]] - total[edge[:-1]]) + mixed(label) + count.astype(np.uint64) * _ODD)
        keep = rank >= skipped[doc]
        return h[keep], who[doc[keep]]


def _batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, Sets]]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for begin, texts in chunks(batch.column(1)):
            yield ids[begin : begin + len(texts)], Sets(texts, k)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def bitmap(df: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A bit for each value of a long column, at its low bits, packed in 64-bit words; and how many bits it has.

    Its size is bounded; where values share bits, tasks send more than needed, and a join follows.
    """
    bits = min(max((16 * df.count()).bit_length(), LEAST_BITS), MOST_BITS)
    word, bit = F.expr(f"({column} & {(1 << bits) - 1}L) >> 6"), F.expr(f"shiftleft(1L, cast({column} & 63 AS int))")
    rows = df.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()  # no Python object for each word
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return out, bits


def _has(found: tuple[np.ndarray, int], x: np.ndarray) -> np.ndarray:
    x = x & np.uint64((1 << found[1]) - 1)
    return (found[0][(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) != 0


def _runs(h: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """bucket and keys: the lower 32 bits of the hashes of each bucket, which has those of a range of upper bits; each twice at most."""
    h, n = np.unique(np.concatenate(h), return_counts=True)
    h = np.repeat(h, np.minimum(n, 2))
    bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(h) else np.zeros(0, np.int64)
    keys = (h & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
    ends = np.append(edge[1:], len(h))
    return pa.RecordBatch.from_arrays([pa.array(bucket[edge]), pa.array([keys[4 * a : 4 * b] for a, b in zip(edge.tolist(), ends.tolist(), strict=True)], pa.binary())], ["bucket", "keys"])


def _twice(table: pa.Table) -> pa.Table:
    """applyInArrow function: the keys that a bucket holds more than once."""
    keys = np.sort(np.frombuffer(b"".join(table["keys"].to_pylist()), "<u4"))
    return pa.table({"key": pa.array(np.unique(keys[1:][keys[1:] == keys[:-1]]).astype(np.int64))})


def _links_in_block(num: int, den: int):
    """applyInArrow function: links between members of two blocks that earlier links do not join, at most one fewer than members."""

    def run(table: pa.Table) -> pa.Table:
        rows, part = table["node"].to_numpy(), table["f"].to_numpy()
        node, first_row, own = np.unique(rows, return_index=True, return_inverse=True)
        side, comp, sizes = (table[c].to_numpy()[first_row] for c in ("block", "component", "n"))
        lists = table["elements"].combine_chunks()
        flat, edge = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        fragments = []  # postings of each fragment's elements
        for f in np.unique(part):
            at = np.flatnonzero(part == f)
            values = np.concatenate([flat[edge[i] : edge[i + 1]] for i in at])
            length = edge[at + 1] - edge[at]
            _, code = np.unique(values, return_inverse=True)
            owner = np.repeat(own[at], length)
            order = np.argsort(code, kind="stable")
            begin = np.full(len(node) + 1, 0)
            np.add.at(begin, own[at] + 1, length)
            by_owner = np.argsort(owner, kind="stable")
            fragments.append((owner[order], np.concatenate([[0], np.cumsum(np.bincount(code))]), code[by_owner], np.cumsum(begin)))
        parent = {int(c): int(c) for c in np.unique(comp)}

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        one_block = len(np.unique(side)) == 1
        least = side.min() if len(side) else 0
        out: list[tuple[int, int]] = []
        for i in np.flatnonzero(side == least):
            both = np.zeros(len(node), np.int64)
            for posting, first, codes, begin in fragments:  # overlaps counted by fragment, summed per pair
                mine = codes[begin[i] : begin[i + 1]]
                lengths = first[mine + 1] - first[mine]
                at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(first[mine], lengths)
                both += np.bincount(posting[at], minlength=len(node))
            hits = np.flatnonzero(den * both >= num * (sizes[i] + sizes - both))
            for j in hits[(side[hits] != least) | one_block].tolist():
                x, y = top(int(comp[i])), top(int(comp[j]))
                if x != y:
                    parent[x] = y
                    out.append((int(node[i]), int(node[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _may_link(num: int, den: int):
    """applyInArrow function: h and node of the members that may link with one of another component, by their bitmaps.

    Two sets differ in at least as many elements as their bitmaps differ in bits, so no link is passed over.
    """

    def run(table: pa.Table) -> pa.Table:
        comp, size, side = table["component"].to_numpy(), table["n"].to_numpy(), table["block"].to_numpy()
        bits = table["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(comp), -1)
        may = np.zeros(len(comp), bool)
        for i in np.flatnonzero(side == side.min()):
            apart = np.bitwise_count(bits ^ bits[i]).sum(axis=1, dtype=np.int64)
            hits = (apart * (den + num) <= (size + size[i]) * (den - num)) & (comp != comp[i])
            if hits.any():
                may |= hits
                may[i] = True
        return table.select(["h", "node"]).filter(pa.array(may))

    return run


def ngram_jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, fragments: int = 8, block: int = 600) -> DataFrame:
    """One row for each row of df: id, n_shingles, class_id (smallest id of those with the same set), component_id.

    Texts are lower-cased in A-Z and cut into words at white space; a text's set holds its distinct runs of k words, or
    its whole sequence of words if it has fewer.  Two texts link when den * |A & B| >= num * |A | B|; component_id is the
    smallest id that links reach, the row's own included.

    A text without words, or null, has no shingles and links with nothing: class_id and component_id are its own id.
    Rows with the same id are rows of their own.  A row without an id takes no part; its class_id and component_id are
    null.  Other columns of df are not read.  An empty df gives an empty result.

    Sets are told apart by 64-bit hashes; N different sets give N * N / 2**65 mistaken ones to expect.
    """
    spark = df.sparkSession
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def summaries(batches):
        for ids, s in _batches(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), from_pandas=True), pa.array(s.size), pa.array(s.hash.view(np.int64), mask=s.size == 0), pa.array(s.hash_counts(num, den))], ["id", "n", "node", "hashes"])

    rows = saved(docs.mapInArrow(summaries, "id long, n long, node long, hashes long"), "sets")
    some = docs.where("id is not null")
    buckets = -(-(rows.agg(F.sum("hashes")).first()[0] or 1) // BUCKET)

    def all_hashes(batches):
        run, n = [], 0
        for _, s in _batches(batches, k):
            run.append(s.fragment_hashes(num, den)[0])
            n += len(run[-1])
            if n >= RUN:
                yield _runs(run, buckets)
                run, n = [], 0
        if n:
            yield _runs(run, buckets)

    twice = saved(some.mapInArrow(all_hashes, "bucket long, keys binary").groupBy("bucket").applyInArrow(_twice, "key long"), "twice")
    bits = spark.sparkContext.broadcast(bitmap(twice, "key"))

    def shared_hashes(batches):
        for _, s in _batches(batches, k):
            h, doc = s.fragment_hashes(num, den)
            keep = _has(bits.value, h)
            order = np.argsort(doc[keep], kind="stable")
            h, doc = h[keep][order], doc[keep][order]
            who, first = np.unique(doc, return_index=True)
            for at in range(0, len(who), 2000):
                own, edge = who[at : at + 2000], np.append(first, len(doc))[at : at + 2001]
                words = s.bitmaps(own)
                lists = pa.ListArray.from_arrays(pa.array(edge - edge[0], pa.int32()), _signed(h[edge[0] : edge[-1]]))
                maps = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * words.shape[1], pa.int32()), _signed(words.ravel()))
                yield pa.RecordBatch.from_arrays([_signed(s.hash[own]), pa.array(s.size[own]), maps, lists], ["node", "n", "bits", "hashes"])

    # One row for each set with a hash that may be shared.
    shared = saved(some.mapInArrow(shared_hashes, "node long, n long, bits array<long>, hashes array<long>").dropDuplicates(["node"]), "shared", twice)
    hashes = shared.select("node", F.explode(F.array_distinct("hashes")).alias("h"))
    groups = saved(hashes.groupBy("h").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("h", "hub"), "groups")
    shares = saved(hashes.join(groups, "h").where("node <> hub"), "shares", groups)

    apart = F.aggregate(F.zip_with("bits", "hub_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda total, x: total + x)
    maps = shared.select("node", "n", "bits")
    pairs = shares.select("hub", "node").distinct().join(maps, "node").join(maps.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("bits").alias("hub_bits")), "hub")
    pairs = pairs.where(f"{den} * least(n, hub_n) >= {num} * greatest(n, hub_n)").where(apart * (den + num) <= (F.col("n") + F.col("hub_n")) * (den - num))
    pairs = saved(pairs.select("hub", "node", "n", "hub_n"), "pairs")

    classes = rows.where("node is not null and id is not null").groupBy("node").agg(F.min("id").alias("class_id"))
    classes = saved(classes, "classes")
    step = np.uint64(64 - (fragments - 1).bit_length()) if fragments > 1 else None

    def segments(nodes: DataFrame) -> DataFrame:
        """node, n, f and elements: the parts of the given sets in each fragment of the order, of one text of each set."""
        nodes = saved(nodes.distinct(), "nodes")
        wanted = spark.sparkContext.broadcast(bitmap(classes.join(nodes, "node"), "class_id"))

        def run(batches):
            for ids, s in _batches(batches, k):
                keep = _has(wanted.value, ids.astype(np.int64).view(np.uint64)) & (s.size > 0)
                d, e = s.doc[keep[s.doc]], s.elements[keep[s.doc]]
                if len(d):
                    f = (e >> step).astype(np.int64) if step is not None else np.zeros(len(e), np.int64)
                    at = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (f[1:] != f[:-1])]))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(e)), pa.int32()), _signed(e))
                    yield pa.RecordBatch.from_arrays([_signed(s.hash[d[at]]), pa.array(s.size[d[at]]), pa.array(f[at], pa.int32()), lists], ["node", "n", "f", "elements"])

        parts = some.mapInArrow(run, "node long, n long, f int, elements array<long>")
        return saved(parts.join(nodes, "node", "left_semi").dropDuplicates(["node", "f"]), "segments", nodes)

    parts = segments(pairs.select("node").union(pairs.select("hub")))
    in_parts = F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))).alias("f")
    # The second join has another key than its sides lie by, so both are dealt out, and Spark can split a hub with many candidates.
    place = F.xxhash64("hub", "f").alias("place")
    left = pairs.select("hub", "node", "n", "hub_n", in_parts).join(parts.drop("n"), ["node", "f"]).select("*", place)
    right = parts.select(F.col("node").alias("hub"), "f", F.col("elements").alias("hub_elements")).join(pairs.select("hub").distinct(), "hub", "left_semi").select("*", place)
    partial = left.join(right, ["place", "hub", "f"]).select("hub", "node", "n", "hub_n", F.size(F.array_intersect("elements", "hub_elements")).cast("long").alias("both"))
    links = partial.groupBy("hub", "node", "n", "hub_n").agg(F.sum("both").alias("both")).where(f"{den} * both >= {num} * (n + hub_n - both)")
    links = saved(links.select(F.col("hub").alias("a"), F.col("node").alias("b")), "links", parts, pairs)

    # What the pairs with the smallest leave open: groups whose other members lie in several components.  Of groups of the
    # same members, as a pair that shares several fragments makes them, one is compared.
    joined = connected_components(links)
    state = saved(shares.select("h", "node").join(joined, "node", "left").select("h", "node", F.coalesce("component", "node").alias("component")), "state")

    def different(rows: DataFrame) -> DataFrame:
        """h and members of the groups with several components, one of those with the same members."""
        sizes = rows.groupBy("h").agg(F.count("*").alias("members"), F.min("component").alias("x"), F.max("component").alias("y"), F.min("node").alias("first"), F.bit_xor(F.xxhash64("node")).alias("mark"))
        return sizes.where("x < y").groupBy("members", "first", "mark").agg(F.min("h").alias("h")).select("h", "members")

    def in_blocks(members: DataFrame, rows: int) -> DataFrame:
        """Every pair of a group's blocks, (h, i, j), with the members of both."""
        own = members.withColumn("blocks", F.ceil(F.col("members") / rows).cast("int")).withColumn("block", F.expr("pmod(xxhash64(node), blocks)").cast("int"))
        return own.withColumn("against", F.explode(F.expr("sequence(0, blocks - 1)"))).select("h", "node", "component", "block", F.least("block", "against").alias("i"), F.greatest("block", "against").alias("j"))

    members = saved(state.join(different(state), "h"), "members", shares)
    may = in_blocks(members, 4 * block).join(maps, "node").groupBy("h", "i", "j").applyInArrow(_may_link(num, den), "h long, node long").distinct()
    left_over = saved(state.join(may, ["h", "node"]), "left-over", members, state, shared)
    reached = joined
    if not left_over.isEmpty():
        # What is left is in many groups together; groups that share members are compared as one, so each set is sent once.
        least_of = left_over.groupBy("h").agg(F.min("node").alias("least"))
        together = connected_components(left_over.join(least_of, "h").select("least", "node"), "least", "node").select("node", F.col("component").alias("h"))
        counted = left_over.select("node", "component").distinct().join(together, "node")
        counted = saved(counted.join(counted.groupBy("h").agg(F.count("*").alias("members")), "h"), "counted")
        more = in_blocks(counted, block).join(segments(counted.select("node")), "node").groupBy("h", "i", "j").applyInArrow(_links_in_block(num, den), "a long, b long")
        reached = connected_components(links.union(more))

    least = reached.join(classes, "node").groupBy("component").agg(F.min("class_id").alias("component_id"))
    label = reached.join(least, "component").select("node", "component_id")
    named = classes.join(label, "node", "left").select("node", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    whole_rows = rows.where("node is not null and id is not null").join(named, "node").select("id", "n", "class_id", "component_id")
    alone = rows.where("node is null or id is null").select("id", "n", F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    return whole_rows.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents linked on 3-word shingles at a similarity of 90 %."""
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=90, den=100).select("doc_id", "n_shingles", "component_id", "class_id")
