"""Token ids of texts by a public tokenizer, with the ids of each distinct word kept in the Python worker.

A tokenizer that drops white space and never joins what white space separates gives a text the ids of its chunks between
white space, one after the other.  Most chunks of a corpus have been seen before; only new ones are encoded.  This is
done where the vocabulary file says that the tokenizer works so; texts are encoded whole by any other one.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np

END_ID = 1
_MOST_WORDS = 600_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself where it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class _Chunks(dict):
    """Number of each chunk seen; a new one is encoded on the way, or taken over from the last such table, which is full."""

    def __init__(self, ids_of, full: _Chunks | None = None):
        super().__init__()
        self.ids_of = ids_of if full is None else lambda chunk: full.own(chunk) if chunk in full else ids_of(chunk)
        self.flat, self.edge = array("I"), array("q", [0])

    def own(self, chunk: str) -> array:
        n = self[chunk]
        return self.flat[self.edge[n] : self.edge[n + 1]]

    def followed(self, ids_of) -> _Chunks:
        """An empty table that takes words over from this one, which lets go of the one before it."""
        self.ids_of = ids_of
        return _Chunks(ids_of, self)

    def __missing__(self, chunk: str) -> int:
        self.flat.extend(self.ids_of(chunk))
        self.edge.append(len(self.flat))
        self[chunk] = n = len(self)
        return n

    def ids(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        edge, flat = np.frombuffer(self.edge, np.int64), np.frombuffer(self.flat, np.uint32) if self.flat else np.zeros(0, np.uint32)
        begin = edge[at]
        size = edge[at + 1] - begin
        end = np.cumsum(size)
        return flat[np.arange(end[-1] if len(end) else 0) + np.repeat(begin - (end - size), size)]


def opened(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: What a vocabulary file says of a tokenizer whose chunks WordTokenizer may keep.
_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "model": {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False},
}


def cuts_at_space(path: str) -> bool:
    """Whether the file's normaliser, pre-tokeniser and model are those that WordTokenizer is written for."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model = {k: file["model"].get(k) for k in _WORDS["model"]}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in file["added_tokens"])
    return file["normalizer"] == _WORDS["normalizer"] and file["pre_tokenizer"] == _WORDS["pre_tokenizer"] and model == _WORDS["model"] and plain and not file["truncation"] and not file["padding"]


class WholeTokenizer:
    """encode(text) gives the ids of the whole text by the library."""

    def __init__(self, path: str):
        self.tokenizer = opened(path)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text; a null text has none."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids if text else [], np.uint32)


class WordTokenizer:
    """encode(text) gives the ids that the tokenizer gives, for files of which cuts_at_space is true."""

    #: Texts of these characters are their own normal form, and lower-casing them needs no context.
    _plain = re.compile("[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
    #: Where the tokenizer cuts a lower-cased chunk of these.
    _cut = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^a-z0-9À-ÖØ-öø-ÿ]+")
    #: Characters that str.split() takes for white space and the tokenizer does not.
    _other_space = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        self.tokenizer = opened(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.marks: dict[str, list[int]] = {}
        self.plain, self.other = _Chunks(self._plain_ids), _Chunks(self._other_ids)

    def _plain_ids(self, chunk: str) -> list[int] | array:
        if chunk.isalpha():
            return self._model_ids(chunk)
        out = array("I")
        for unit in self._cut.findall(chunk):
            if unit.isalpha():  # a chunk by itself elsewhere
                out.extend(self.plain.own(unit))
                continue
            ids = self.marks.get(unit)
            if ids is None:
                ids = self.marks[unit] = self._model_ids(unit)
            out.extend(ids)
        return out

    def _model_ids(self, unit: str) -> list[int]:
        letters = unit if unit.isascii() else unit.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(letters)]

    def _other_ids(self, chunk: str) -> list[int]:
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text; a null text has none."""
        if not text:
            return np.zeros(0, np.uint32)
        if self._other_space.search(text):
            return np.array(self._other_ids(text), np.uint32)
        if len(self.plain) + len(self.other) > _MOST_WORDS:
            self._clear()
        if self._plain.fullmatch(text) and not any(s in text for s in self.specials):
            return self.plain.ids(text.lower().split())
        return self.other.ids(text.split())


_READY: dict[str, WordTokenizer | WholeTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer | WholeTokenizer:
    """One tokenizer, with its words, for each Python worker."""
    if path not in _READY:
        _READY[path] = WordTokenizer(path) if cuts_at_space(path) else WholeTokenizer(path)
    return _READY[path]


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
