"""Byte-pair encoding and decoding by a deterministic automaton over tokens, compiled from the merges of a vocabulary file.

The automaton begins as one state that every byte leads back to.  Each merge (u, v), in order, is one gadget: the state
that u leads to is copied without its arc v, u leads to the copy from now on, and the new token uv gets an arc wherever u
has one, to the state that v led to.  A path of the finished automaton is a sequence of tokens that the merges give, and of
all ways to cut a word into tokens exactly one is a path.

All arcs of a token end in one state.  So a state is stored as the token that leads to it and its number, by which later
copies are told from earlier ones.  Arcs that texts have taken are kept in a table.  The encoder reads a word's bytes by a
table of the longest token that ends at each byte, and takes at each place the one token that has an arc from the state
at its beginning.  The decoder writes the labels of arcs.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .scratch import small_batches
from .textarrays import chunks
from .tokens import _byte_letters, _Chunks, vocabulary_path

#: Fixed value: where byte-level vocabularies cut a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: What a worker keeps at most: words with their ids, ids of them, and entries of each table.
MOST_WORDS, MOST_IDS, MOST_ENTRIES = 250_000, 8_000_000, 2_000_000
#: Words of a text that are held at once.
RUN = 100_000


@dataclass(frozen=True)
class Automaton:
    """The tables of a vocabulary; tokens are ids, states are numbered in the order in which gadgets made them.

    labels: each token's bytes (none if no path has it); left: its left part; made: the state made with it, 0 for bytes;
    target: the state it leads to; entry: the one it led to before any copy; owner: the token that leads to a state;
    copies: by u * len(labels) + v the state made without the arc v of u; specials: texts that are tokens by themselves.
    """

    labels: list[bytes]
    left: list[int]
    made: list[int]
    target: list[int]
    entry: list[int]
    owner: list[int]
    copies: dict[int, int]
    specials: dict[str, int]

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the state has an arc of this token.

        The state is followed back to what it is a copy of, and the token to its left part, whichever was made later first;
        the arc is missing if a copy on the way was made without it.
        """
        n, a, last, bound = len(self.labels), self.owner[state], state, len(self.owner)
        while a >= 0:
            if self.copies.get(a * n + token, bound + 1) <= min(last, bound):
                return False
            if self.made[token] and self.made[token] >= self.made[a]:
                bound, token = self.made[token], self.left[token]
            else:
                last = self.entry[a]
                a = self.owner[last]
        return True


def compiled(path: str) -> Automaton:
    """The automaton of a byte-level vocabulary file; one that encodes in another way is refused."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, pre, decoder = file["model"], file["pre_tokenizer"] or {}, file["decoder"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    byte_level = pre.get("type") == decoder.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex")
    exact = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in file["added_tokens"])
    if not (plain and byte_level and exact and not file["normalizer"]):
        raise ValueError(f"{path} is no plain byte-level vocabulary")
    specials, vocab = {t["content"]: t["id"] for t in file["added_tokens"]}, model["vocab"]
    of_letter = {letter: b for b, letter in _byte_letters().items()}
    size = max([*vocab.values(), *specials.values()]) + 1
    labels, known = [b""] * size, [False] * size
    for token, i in vocab.items():
        labels[i] = bytes(of_letter[c] for c in token) if token not in specials else b""
        known[i] = len(labels[i]) == 1
    out = Automaton(labels, [-1] * size, [0] * size, [0] * size, [0] * size, [-1], {}, specials)
    for merge in model["merges"]:
        u_text, v_text = merge.split(" ") if isinstance(merge, str) else merge
        u, v, token = vocab[u_text], vocab[v_text], vocab[u_text + v_text]
        if known[token] or out.left[token] >= 0 or len(labels[u]) + len(labels[v]) != len(labels[token]):
            raise ValueError(f"{path}: a token is made twice, or before its parts")
        out.left[token] = u
        if known[u] and known[v] and out.has_arc(out.target[u], v):  # else other merges never leave u before v
            known[token], out.made[token] = True, len(out.owner)
            out.target[token] = out.entry[token] = out.target[v]
            out.target[u] = out.copies[u * size + v] = len(out.owner)
            out.owner.append(u)
    for i in range(size):
        if not known[i]:
            labels[i] = b""
    for content, i in specials.items():
        labels[i] = content.encode()
    return out


class Encoder:
    """ids(text) gives the ids of a text."""

    #: Characters that every version of Unicode classes alike.
    _settled = re.compile("[\x00-ԯ]*")

    def __init__(self, automaton: Automaton):
        self.automaton, self.size = automaton, len(automaton.labels)
        special = set(automaton.specials.values())
        self.ids_of = {label: i for i, label in enumerate(automaton.labels) if label and i not in special}
        self.length = [len(label) for label in automaton.labels]
        self._places()
        self.arcs: dict[int, int] = {}
        self.words, self.split = _Chunks(self.word), regex.compile(SPLIT)
        names = sorted(automaton.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def _places(self) -> None:
        """Places are beginnings of tokens.  steps: by place * 256 + byte the next one; back: the longest place that ends another; ends: the longest token that ends a place; shorter: the next one that ends a token."""
        steps: dict[int, int] = {}
        ends = [-1]
        for label, i in self.ids_of.items():
            at = 0
            for b in label:
                to = steps.setdefault(at << 8 | b, len(ends))
                if to == len(ends):
                    ends.append(-1)
                at = to
            ends[at] = i
        self.steps, self.ends, self.back, self.shorter = steps, ends, [0] * len(ends), [-1] * self.size
        below: dict[int, list[tuple[int, int]]] = {}
        for key, to in steps.items():
            below.setdefault(key >> 8, []).append((key & 255, to))
        order = [0]
        for at in order:  # shorter places first
            for b, to in below.get(at, ()):
                self.back[to] = self._next(self.back[at], b) if at else 0
                longest = ends[self.back[to]]
                if ends[to] < 0:
                    ends[to] = longest
                else:
                    self.shorter[ends[to]] = longest
                order.append(to)
        self.table = dict(steps)

    def _next(self, at: int, b: int) -> int:
        while at and (at << 8 | b) not in self.steps:
            at = self.back[at]
        return self.steps.get(at << 8 | b, 0)

    def _stepped(self, key: int) -> int:
        if len(self.table) > MOST_ENTRIES:
            self.table = dict(self.steps)
        self.table[key] = to = self._next(key >> 8, key & 255)
        return to

    def _arc(self, key: int) -> int:
        """By state * size + token: the state it leads to, or -1."""
        state, token = divmod(key, self.size)
        if len(self.arcs) > MOST_ENTRIES:
            self.arcs.clear()
        self.arcs[key] = to = self.automaton.target[token] if self.automaton.has_arc(state, token) else -1
        return to

    def word(self, word: str) -> list[int]:
        """The labels' ids of the one path that spells the word."""
        data = word.encode()
        whole = self.ids_of.get(data)
        if whole is not None:
            return [whole]
        # Of a long word these are kept as 4-byte numbers.
        states, tokens = ([0], [-1]) if len(data) < RUN else (array("i", [0]), array("i", [-1]))
        at, step, ends, length, arcs, size = 0, self.table.get, self.ends, self.length, self.arcs.get, self.size
        for j, b in enumerate(data, 1):
            key = at << 8 | b
            at = step(key)
            if at is None:
                at, step = self._stepped(key), self.table.get
            token = ends[at]
            while True:
                arc = states[j - length[token]] * size + token
                to = arcs(arc)
                if to is None:
                    to = self._arc(arc)
                if to >= 0:
                    break
                token = self.shorter[token]
            states.append(to)
            tokens.append(token)
        out, j = [], len(data)
        while j:
            out.append(tokens[j])
            j -= self.length[tokens[j]]
        return out[::-1]

    def _runs(self, text: str) -> Iterator[list[str]]:
        """The words of a text, a bounded number at once."""
        if not self._settled.fullmatch(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            # Characters that not all versions of Unicode know: cut by the tokenizers library's own rule.
            from tokenizers.pre_tokenizers import ByteLevel

            cut = iter([text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)])
        else:
            cut = (m.group() for m in self.split.finditer(text)) if len(text) > 4 * RUN else iter(self.split.findall(text))
        while run := list(islice(cut, RUN)):
            yield run

    def ids(self, text: str | None) -> np.ndarray:
        """A null text has none."""
        parts = [np.zeros(0, np.uint32)]
        for k, piece in enumerate((self.special.split(text) if self.special else [text]) if text else []):
            if k % 2:
                parts.append(np.array([self.automaton.specials[piece]], np.uint32))
                continue
            for run in self._runs(piece):
                if len(self.words) > MOST_WORDS or len(self.words.flat) > MOST_IDS:
                    self.words = self.words.followed(self.word)
                parts.append(self.words.ids(run))
        return np.concatenate(parts)


_READY: dict[str, tuple[Automaton, Encoder | None]] = {}


def _shared(spark: SparkSession, path: str):
    """The compiled automaton, whose size the vocabulary sets, sent to the executors once; and its name."""
    if path not in _READY:
        _READY[path] = (compiled(path), None)
    return spark.sparkContext.broadcast(_READY[path][0])


def _encoder(path: str, automaton) -> Encoder:
    """One for each Python worker."""
    if path not in _READY or _READY[path][1] is None:
        _READY[path] = (automaton.value, Encoder(automaton.value))
    return _READY[path][1]


def _mapped(df: DataFrame, name: str, out: StructField, drop: bool, run_of) -> DataFrame:
    """df with a column made from another's values, run by run; drop: without that one.  A column with the new one's name is replaced."""
    names = [c for c in df.columns if c.lower() != out.name.lower() or c == name]
    at = names.index(name)
    kept = [i for i, c in enumerate(names) if (i != at or not drop) and c.lower() != out.name.lower()]
    # Numbered, as names may hold dots.
    df = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    schema = StructType([*(df.schema.fields[i] for i in kept), StructField("made", out.dataType)])

    def run(batches):
        of = run_of()
        for batch in batches:
            column = batch.column(at)
            listed = pa.types.is_list(column.type)
            for begin, values in [(0, column)] if listed else chunks(column):
                made = of(values)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(begin, len(made)) for i in kept), made], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema).toDF(*(names[i] for i in kept), out.name)


def encode_texts(df: DataFrame, text_col: str = "text", ids_col: str = "ids", vocabulary: str | None = None, drop_text: bool = False) -> DataFrame:
    """df with the ids of each text, an array of int; texts of special tokens become these tokens.

    Null and empty texts have no ids.  All rows and columns are kept, but for one named ids_col, which is replaced, and the
    texts with drop_text.  An empty df gives an empty result.
    """
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")
    small_batches(df.sparkSession)
    automaton = _shared(df.sparkSession, path)

    def run_of():
        ids = _encoder(path, automaton).ids

        def of(texts):
            found = [ids(t) for t in texts]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.int32)))

        return of

    return _mapped(df, text_col, StructField(ids_col, ArrayType(IntegerType())), drop_text, run_of)


def decode_ids(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", vocabulary: str | None = None, drop_ids: bool = False) -> DataFrame:
    """df with the text of each array of ids; bytes that are no UTF-8 are written as U+FFFD.

    Null and empty arrays give an empty text; a null among ids, or an id that the vocabulary lacks, fails.  Rows and columns
    are kept as by encode_texts.
    """
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")
    small_batches(df.sparkSession)
    automaton = _shared(df.sparkSession, path)

    def run_of():
        labels = automaton.value.labels

        def of(arrays):
            ends = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(arrays), 0).to_numpy(zero_copy_only=False))])
            flat = arrays.flatten().to_numpy(zero_copy_only=False)
            if len(flat) and not (0 <= flat.min() and flat.max() < len(labels)):
                raise ValueError("an id is not in the vocabulary")
            texts = (b"".join([labels[i] for i in flat[a:b].tolist()]).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True))
            return pa.array(texts, pa.string())

        return of

    return _mapped(df, ids_col, StructField(text_col, StringType()), drop_ids, run_of)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded from its ids."""
    coded = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), drop_text=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    out = coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"))
    return decode_ids(out, drop_ids=True).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
