"""The language model's runs of places, sorted hashes and look-ups against plain versions, and what scoring costs."""

import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.llm import language_model as lm


@pytest.mark.parametrize("step", [7, 1 << 20])
def test_places_by_hand(monkeypatch, step):
    monkeypatch.setattr(lm, "STEP", step)
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab\t\n \r\x0b\x0c\0é漢\U0001f600\xa0\udc80"), n)) for n in rng.integers(0, 30, 80)]
    texts[3:3] = [None, "", " \t ", "a", " a ", "ab" * 40]
    wanted = []
    for i, t in enumerate(texts):
        t = re.sub(r"[\x20\x09-\x0D]+", " ", t or "").strip(" ").replace("\0", "�")
        padded = " " * (lm.ORDER - 1) + t + " "
        wanted += [(i, [ord(c) for c in padded[j - lm.ORDER + 1 : j + 1]]) for j in range(lm.ORDER - 1, len(padded) if t else 0)]
    found, keys = [], lm.language_keys([str(i) for i in range(len(texts))])
    for points, at, doc in lm.places(texts):
        assert len(at) == len(doc) <= step
        columns = lm._columns(points, at)
        found += zip(doc.tolist(), np.stack(columns, axis=1).tolist(), strict=True)
        assert (lm._place_hashes(points, at, keys[doc]) == lm._hashes(keys[doc], columns)).all()
    assert found == wanted
    assert list(lm.places([])) == list(lm.places([None, " "])) == []


def test_hashes_that_differ_in_lower_bits_only(tmp_path):
    rng = np.random.default_rng(4)
    entries = np.sort(np.concatenate([np.arange(-500, 500), rng.integers(-(1 << 62), 1 << 62, 500)]))
    pq.write_table(pa.table({"h": entries, "value": entries % 1009 + 1.0, "more": entries % 7 + 1.0}), tmp_path / "model.parquet")
    files = [(f"file://{tmp_path}/model.parquet", int(entries[0]), int(entries[-1]))]
    keys = rng.permutation(np.concatenate([entries, entries[:300], np.arange(500, 600)]))
    there = np.isin(keys, entries)
    wanted = np.where(there[:, None], np.stack([keys % 1009 + 1.0, keys % 7 + 1.0], axis=1), 0)
    assert (lm.look_up(files, keys) == wanted).all() and 100 <= (~there).sum()
    h = rng.permutation(np.repeat(np.arange(1000, dtype=np.uint64), 3))
    first, of = lm._distinct(h)
    assert (h[first][of] == h).all()
    order, begin = lm._groups(h)
    assert sorted(order.tolist()) == list(range(3000)) and begin[0] == 0


def test_scoring_costs_a_few_sorts():
    """CPU time of 1.5 MB of text as a multiple of a stable sort of as many random numbers by place: 1.8 before, 0.8 since."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("etaoinshrdlu"), n)) for n in rng.integers(2, 9, 4000)]
    texts = [" ".join(words[i] for i in rng.integers(0, 4000, 400)) for _ in range(620)]
    keys, numbers = np.repeat(lm.language_keys(["a", "b"]), 310), rng.integers(0, 1 << 62, sum(map(len, texts)))

    def least(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: lm.score([], texts, keys)) < 1.3 * least(lambda: np.argsort(numbers, kind="stable"))


@pytest.mark.parametrize("most", [1 << 20, 300])
def test_ngrams_are_looked_up_once_in_a_task(spark, monkeypatch, most):
    monkeypatch.setattr(lm, "MOST_KNOWN", most)
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcd e"), 200)) for _ in range(30)]
    files = lm.train(spark.createDataFrame([(x, t) for t in texts[:20] for x in "pq"[len(t.split()) % 2 :]], "lang string, text string"))
    keys = lm.language_keys(["p", "q", "new"])[rng.integers(0, 3, 30)]
    wanted, known, asked = lm.score(files, texts, keys), lm.Known(), []
    plain = lm.look_up
    monkeypatch.setattr(lm, "look_up", lambda files, keys: asked.append(len(keys)) or plain(files, keys))
    for _ in range(2):
        parts = [lm.score(files, texts[i : i + 5], keys[i : i + 5], known) for i in range(0, 30, 5)]
        assert np.concatenate([x[0] for x in parts]).tolist() == wanted[0].tolist()
        assert np.concatenate([x[1] for x in parts]).tolist() == wanted[1].tolist()
    assert (len(asked) == 6) == (most == 1 << 20) and (np.diff(known.h.astype(object)) > 0).all()


def test_counting_gives_up_files_of_an_earlier_model(spark, monkeypatch):
    df = spark.createDataFrame([("p", "some words of a text")], "lang string, text string")
    lm.score(lm.train(df), ["some words"], lm.language_keys(["p"]))
    assert lm._CACHE
    taken = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: taken.append(run) or self.selectExpr("lang", "text as gram", "1L as n"))
    lm.count_grams(df)
    assert list(taken[0](iter([]))) == [] and not lm._CACHE
