"""Token ids in binary files with a shared zstandard dictionary.

A folder holds ``dictionary``, ``manifest`` (Parquet, a row for each shard) and ``shards``.  A shard is

    8 bytes  b"TESSTOK1"
    frames   each document's ids, little-endian, as one zstandard frame that needs the dictionary
    index    int64 arrays, one entry for each document: id, whether the id is null, first id's place in the shard, number
             of ids, place of the frame; then the end of the last frame
    footer   JSON: number of documents and ids, width of an id, SHA-256 of the dictionary, place of the index
    4 bytes  length of the footer, little-endian

so that one document is read by the footer, its index entry and its frame.  Shards are named in the order of ids.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import opened, resolved
from .scratch import new_folder, small_batches
from .textarrays import chunks
from .tokens import END_ID, ids_crc32, tokenizer, vocabulary_path

MAGIC = b"TESSTOK1"
_MANIFEST = "shard string, n_docs long, n_tokens long"


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def train_dictionary(docs: DataFrame, vocabulary: str, width: int, sample_docs: int = 1000, text_samples: int = 10, size: int = 65_536) -> bytes:
    """A dictionary from samples of 2,000 ids of texts with any; b"" if there are none.

    Samples come from sample_docs texts, those of the smallest hashes of id and text, and of a text from its text_samples
    runs of 2,000 ids with the smallest hashes.  They only set how well frames compress; what is written comes from all
    rows.  Samples too few to train on are the dictionary themselves.
    """
    chosen = docs.where("text <> ''").orderBy(F.xxhash64("id", "text"), "id", F.length("text")).limit(sample_docs)

    def run(batches):
        encode = tokenizer(vocabulary).encode
        for batch in batches:
            for _, texts in chunks(batch.column("text")):
                parts = []  # frames of short documents gain from a dictionary, so long ones are samples by runs
                for ids in map(encode, texts):
                    runs = [ids[at : at + 2000].astype(f"<u{width}").tobytes() for at in range(0, len(ids), 2000)]
                    parts += sorted(runs, key=zlib.crc32)[:text_samples]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["ids"])

    sample = sorted(bytes(r[0]) for r in chosen.select("text").mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(size, sample).as_bytes() if sample else b""
    except zstandard.ZstdError:
        return b"".join(sample)[-size:]


class _Shard:
    """Collects frames up to a bounded size, and writes them as one file."""

    def __init__(self, folder: str, name: str, width: int, digest: str):
        self.folder, self.name, self.width, self.digest = folder, name, width, digest
        self.frames, self.bytes, self.ids, self.counts = [], len(MAGIC), [], []
        self.places = []

    def add(self, key: int | None, ids: np.ndarray, frame: bytes) -> None:
        self.ids.append(key)
        self.counts.append(len(ids))
        self.places.append(self.bytes)
        self.frames.append(frame)
        self.bytes += len(frame)

    def write(self) -> dict:
        counts = np.array(self.counts, "<i8")
        keys = np.array([k or 0 for k in self.ids], "<i8")
        index = [keys, np.array([k is None for k in self.ids], "<i8"), np.cumsum(counts) - counts, counts, np.array([*self.places, self.bytes], "<i8")]
        footer = json.dumps({"docs": len(counts), "tokens": int(counts.sum()), "width": self.width, "dictionary": self.digest, "index": self.bytes}).encode()
        system, path = opened(f"{self.folder}/shards")
        system.create_dir(path, recursive=True)
        # Under a name of its own first: a task that runs twice never leaves half a shard under the final one.
        draft = f"{path}/_{self.name}-{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as out:
            out.write(b"".join([MAGIC, *self.frames, *(a.astype("<i8").tobytes() for a in index), footer, len(footer).to_bytes(4, "little")]))
        system.move(draft, f"{path}/{self.name}")
        return {"shard": self.name, "n_docs": len(counts), "n_tokens": int(counts.sum())}


def write_token_files(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, level: int = 3, shard_bytes: int = 8_000_000) -> DataFrame:
    """Writes the ids of all texts, each with an end id, in ascending order of id, and returns the manifest.

    Null ids come first.  Null and empty texts have the end id only.  Rows with equal ids are written each, in the
    order of a hash of their texts.  Other columns are not read.  An empty df gives no shards.
    """
    spark = df.sparkSession
    small_batches(df.sparkSession)
    vocabulary = vocabulary or vocabulary_path()
    width = 2 if tokenizer(vocabulary).tokenizer.get_vocab_size() <= 1 << 16 else 4
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    data = train_dictionary(docs, vocabulary, width)
    digest = hashlib.sha256(data).hexdigest()
    own = resolved(spark, folder)
    system, path = opened(own)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/dictionary") as out:
        out.write(data)
    shared = spark.sparkContext.broadcast(data)

    def run(batches):
        encode = tokenizer(vocabulary).encode
        codec = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(shared.value), write_checksum=True)
        name = lambda n: f"{TaskContext.get().partitionId():08d}-{n:06d}"
        shard, done = None, 0
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), []
            for begin, texts in chunks(batch.column(1)):
                for key, text in zip(keys[begin : begin + len(texts)], texts, strict=True):
                    shard = shard or _Shard(own, name(done), width, digest)
                    ids = np.append(encode(text), np.uint32(END_ID))
                    shard.add(key, ids, codec.compress(ids.astype(f"<u{width}").tobytes()))
                    if shard.bytes >= shard_bytes:
                        rows.append(shard.write())
                        shard, done = None, done + 1
            if rows:
                yield pa.RecordBatch.from_pylist(rows)
        if shard:
            yield pa.RecordBatch.from_pylist([shard.write()])

    # Rows of one id by a hash of the text, so that a task that runs again cuts the same shards.
    order = ["id", "h"]
    ordered = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("h")
    ordered.mapInArrow(run, _MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _parsed(tail: bytes, offset: int, size: int) -> tuple[dict, list[np.ndarray]]:
    """Footer and index from the end of a shard; offset: where in the shard `tail` begins."""
    n = int.from_bytes(tail[-4:], "little")
    footer = json.loads(bytes(tail[-4 - n : -4]))
    docs, at, index = footer["docs"], footer["index"] - offset, []
    for k in range(5):
        index.append(np.frombuffer(tail, "<i8", docs + (k == 4), at))
        at += 8 * docs
    return footer, index


def read_document(folder: str, shard: str, n: int) -> np.ndarray:
    """The ids of the n-th document of a shard; reads the end of the shard, one frame and the dictionary."""
    system, path = opened(folder)
    with system.open_input_file(f"{path}/dictionary") as f:
        data = f.read()
    with system.open_input_file(f"{path}/shards/{shard}") as f:
        size = f.size()
        f.seek(size - 4)
        length = int.from_bytes(f.read(4), "little")
        f.seek(size - 4 - length)
        begin = json.loads(f.read(length))["index"]
        f.seek(begin)
        footer, index = _parsed(f.read(size - begin), begin, size)
        if footer["dictionary"] != hashlib.sha256(data).hexdigest():
            raise ValueError(f"{shard} was written with another dictionary")
        f.seek(int(index[4][n]))
        frame = f.read(int(index[4][n + 1] - index[4][n]))
    raw = zstandard.ZstdDecompressor(dict_data=_dictionary(data)).decompress(frame)
    return np.frombuffer(raw, f"<u{footer['width']}").astype(np.uint32)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files."""
    system, path = opened(resolved(spark, folder))
    with system.open_input_file(f"{path}/dictionary") as f:
        data = f.read()
    digest = hashlib.sha256(data).hexdigest()
    shared = spark.sparkContext.broadcast(data)
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    # A shard is named by its task and its number in it: counts of tasks are added up first, then those of a task's shards.
    task, earlier = F.substring_index("shard", "-", 1), lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = manifest.groupBy(task.alias("task")).agg(F.sum("n_tokens").alias("n_tokens"))
    tasks = tasks.select("task", earlier(Window.orderBy("task")).alias("task_before"))
    starts = manifest.select("shard", task.alias("task"), earlier(Window.partitionBy(task).orderBy("shard")).alias("own_before")).join(tasks, "task")
    starts = starts.select("shard", (F.col("task_before") + F.col("own_before")).alias("before"))
    if manifest.isEmpty():
        return spark.createDataFrame([], "id long, start long, n_tokens long, ids_crc32 long, shard string, place int")

    def run(batches):
        codec = zstandard.ZstdDecompressor(dict_data=_dictionary(shared.value))
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_buffer()
                footer, (keys, null, start, count, place) = _parsed(memoryview(raw), 0, raw.size)
                if raw[:8].to_pybytes() != MAGIC or footer["dictionary"] != digest:
                    raise ValueError(f"{name} is no shard of this dictionary")
                view, kind = memoryview(raw), f"<u{footer['width']}"
                crc = [ids_crc32(np.frombuffer(codec.decompress(view[a:b]), kind).astype("<u4")) for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(n), pa.int32()), pa.array(keys, mask=null != 0), pa.array(start), pa.array(count), pa.array(crc, pa.int64())], ["shard", "place", "id", "own", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(f"{folder}/shards").select(F.substring_index("path", "/", -1).alias("shard"), "content")
    docs = files.mapInArrow(run, "shard string, place int, id long, own long, n_tokens long, ids_crc32 long")
    return docs.join(starts, "shard").select("id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32", "shard", "place")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to token files and read back from them."""
    folder = new_folder(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_token_files(spark, folder).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
