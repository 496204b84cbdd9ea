"""Every registered query on small tables: against its SQL, or against a plain version of what it promises."""

import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import catalogue, files, language_id, language_model, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, textarrays, token_files
from tessera.llm.quality_classifier import FEATURES, statistics
from tessera.llm.scratch import new_folder
from tessera.llm.textarrays import Words
from tessera.llm.tokens import END_ID, WholeTokenizer, WordTokenizer, ids_crc32, tokenizer, vocabulary_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(int(v[i])) if isinstance(v[i], bool) else str(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    df = catalogue.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns) and rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, found.fetchall())


def held_out(doc_id, n, remainder):
    return zlib.crc32(str(doc_id).encode()) % n == remainder


def test_op2(spark, documents):
    out = packing.query(spark, SF).collect()
    encode, wanted = tokenizer(vocabulary_path()).tokenizer.encode, set()
    for i, r in documents.items():
        ids = np.array([*(encode(r["text"], add_special_tokens=False).ids if r["text"] else []), END_ID], np.uint32)
        wanted |= {(i, n, at, min(4096, len(ids) - at), ids_crc32(ids[at : at + 4096])) for n, at in enumerate(range(0, len(ids), 4096))}
    assert {tuple(r)[:5] for r in out} == wanted and len(out) == len(wanted)
    sequences = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert sequences.get(r["sequence_id"], 0) == r["offset"]
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values()) <= 4096
    assert len(sequences) == packing.lower_bound(np.bincount([r["length"] for r in out], minlength=4097), 4096)


def least_bins(lengths, capacity):
    """By trying all ways: the fewest bins of so many pieces."""
    best = len(lengths)

    def place(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(lengths):
            best = len(room)
            return
        for b in range(len(room)):
            if room[b] >= lengths[i]:
                place(i + 1, room[:b] + [room[b] - lengths[i]] + room[b + 1 :])
        place(i + 1, [*room, capacity - lengths[i]])

    place(0, [])
    return best


def test_bound_is_below_the_fewest_bins():
    rng = np.random.default_rng(3)
    tight = 0
    for _ in range(60):
        lengths = sorted(rng.integers(5, 60, 8).tolist(), reverse=True)
        least = least_bins(lengths, 100)
        bound = packing.lower_bound(np.bincount(lengths, minlength=101), 100)
        assert bound <= least <= len(packing.best_fit_decreasing(np.array(lengths), 100)[2])
        tight += bound == least
    assert tight > 40


def test_exchange_between_partitions_frees_bins(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, "a " * int(n)) for i, n in enumerate(rng.integers(20, 90, 900))], "doc_id long, text string")
    out = packing.pack_documents(df, capacity=100, partition_pieces=60, slack=1).collect()
    by_bin = {k: sum(r["length"] for r in g) for k, g in itertools.groupby(sorted(out, key=lambda r: r["sequence_id"]), key=lambda r: r["sequence_id"])}
    one = len(packing.best_fit_decreasing(np.array([r["length"] for r in out]), 100)[2])
    assert max(by_bin.values()) <= 100 and len(by_bin) <= 1.03 * one


def test_bins_of_any_turn_have_numbers_of_their_own():
    table = pa.table({"id": [1, 2], "piece": [0, 0], "start": [0, 0], "length": [60, 70], "ids_crc32": [0, 0], "bin": [8, 8], "offset": [0, 60], "room": [40, 40]})
    for turn in (1, 127, 128, 300, (1 << packing.TURN_BITS) - 1):
        found = packing._pack(100, turn)((pa.scalar((1 << packing.GROUP_BITS) - 1),), table.slice(0, 1).set_column(5, "bin", pa.array([8])))
        assert found["bin"].to_pylist()[0] == 8  # no fewer bins, and as much room: as they were
        two = table.set_column(5, "bin", pa.array([8, 9])).set_column(3, "length", pa.array([60, 30]))
        number = packing._pack(100, turn)((pa.scalar(5),), two)["bin"].to_pylist()
        assert number[0] == number[1] == (turn << 48) + (5 << 24)


def test_exchange_of_many_partitions_comes_near_the_bound(spark, caplog):
    rng = np.random.default_rng(4)
    lengths = np.concatenate([rng.integers(5, 60, 6000), rng.integers(300, 400, 200)])
    df = spark.createDataFrame([(i, "a " * int(n)) for i, n in enumerate(lengths)], "doc_id long, text string")
    with caplog.at_level("INFO", logger=packing.__name__):
        out = packing.pack_documents(df, capacity=400, partition_pieces=62).collect()
    assert len(out) == len(lengths)
    bins = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert bins.get(r["sequence_id"], 0) == r["offset"]
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    least = packing.lower_bound(np.bincount([r["length"] for r in out], minlength=401), 400)
    assert max(bins.values()) <= 400 and len(bins) <= least + 2
    assert caplog.records[-1].getMessage() == f"packed into {len(bins)} bins, at least {least} are needed"


@pytest.fixture()
def mounted(spark, monkeypatch, tmp_path):
    """A shared folder whose scheme only Hadoop's configuration explains."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tests.link./shared", f"file://{tmp_path}")
    for module in (token_files, language_model):
        monkeypatch.setattr(module, "new_folder", lambda spark, name: f"viewfs://tests/shared/{name}")
    return tmp_path


def test_files_in_a_mounted_store(spark, mounted, documents):
    assert {r["doc_id"] for r in token_files.query(spark, SF).collect()} == set(documents)
    assert any(mounted.glob("token-files/shards/*"))
    found = {r["doc_id"]: tuple(r) for r in quality_rules.query(spark, SF).collect()}
    assert set(found) == set(documents) and any(mounted.glob("model/*.parquet"))


def test_schemes_of_stores():
    system, path = files.opened("file:///tmp/x")
    assert path == "/tmp/x" and files.SCHEMES["s3a"] == "s3"


def test_op3(spark, documents):
    out = sorted(token_files.query(spark, SF).collect(), key=lambda r: r["doc_id"])
    encode, at = tokenizer(vocabulary_path()).tokenizer.encode, 0
    assert [r["doc_id"] for r in out] == sorted(documents)
    for r in out:
        text = documents[r["doc_id"]]["text"]
        ids = np.array([*(encode(text, add_special_tokens=False).ids if text else []), END_ID], np.uint32)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), ids_crc32(ids))
        at += len(ids)


def test_few_documents_have_a_dictionary_too(spark):
    for n in (1, 40):
        df = spark.createDataFrame([(i, f"text number {i} of a few, and more of it " * 3) for i in range(n)], "doc_id long, text string")
        folder = new_folder(spark, "tokens")
        token_files.write_token_files(df, folder)
        with open(folder.removeprefix("file://") + "/dictionary", "rb") as f:
            assert f.read()
        assert token_files.read_token_files(spark, folder).count() == n


def test_other_vocabularies_are_encoded_whole():
    import public_tokenizers

    assert isinstance(tokenizer(vocabulary_path()), WordTokenizer)
    other = tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert isinstance(other, WholeTokenizer)
    rng, pool = np.random.default_rng(4), list("aAbB'st 01\t\n\x0b\x1c\x85\xa0éÉßü漢Σςİıﬁ́ <|endoftext|>.,!?_")
    for t in (other, tokenizer(vocabulary_path())):
        for _ in range(1500):
            text = "".join(rng.choice(pool, rng.integers(0, 25)))
            assert t.encode(text).tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids


def statistics_by_hand(text):
    """The statistics of one text, each by its meaning."""
    raw, words = text.encode(), WORD.findall(text)
    share = lambda chars: sum(raw.count(c.encode()) for c in chars) / max(len(raw), 1)
    of_words = lambda x: sum(x) / max(len(words), 1)
    sizes = [len(w.encode()) for w in words]
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    letter = lambda w: bool(re.search("[a-zA-Z\x80-\U0010ffff]", w))
    return {
        "bytes": np.log1p(len(raw)), "words": np.log1p(len(words)), "word_bytes": of_words(sizes), "word_bytes_deviation": np.std(sizes) if sizes else 0,
        "short_words": of_words(n <= 2 for n in sizes), "long_words": of_words(n >= 20 for n in sizes), "symbols": share("#*$%&@^~_=+\\/"), "digits": share("0123456789"),
        "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "stops": share(".?"), "commas": share(",;:"), "exclaims": share("!"), "bars": share("|"), "brackets": share("()[]{}<>"),
        "beyond_ascii": sum(ord(c) >= 128 for c in text) / max(len(raw), 1), "line_words": len(words) / max(len(lines), 1),
        "dup_lines": (len(lines) - len(set(lines))) / max(len(lines), 1), "full_lines": sum(x[-1] in ".?" for x in lines) / max(len(lines), 1), "repeat_words": len(covered) / max(len(words), 1),
        "next_same": of_words(a == b for a, b in itertools.pairwise(words)), "distinct": len(set(words)) / max(len(words), 1), "distinct_hundred": len(set(words[:100])) / max(min(len(words), 100), 1),
        "most_common": max(map(words.count, set(words)), default=0) / max(len(words), 1), "capital_words": of_words("A" <= w[0] <= "Z" for w in words), "letterless_words": of_words(not letter(w) for w in words),
    }


def test_statistics_by_hand(documents):
    texts = [None, "", " \n", "a", "Ab ab ab. | [x] 12 $$\n\nAb ab ab. | [x] 12 $$\n漢字 é!", *[r["text"] for r in list(documents.values())[:25] if r["text"] and len(r["text"]) < 4000]]
    found = statistics(Words(texts))
    for text, x in zip(texts, found, strict=True):
        wanted = statistics_by_hand(text or "")
        assert dict(zip(FEATURES, x, strict=True)) == pytest.approx({f: float(wanted[f]) for f in FEATURES}, abs=1e-6)


def area(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    p = label.sum()
    return (rank[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p))


def test_op4_on_labels_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    out = {r["doc_id"]: r for r in quality_classifier.query(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == held_out(i, 4, 2) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for i, r in out.items())
    own = [i for i in labels if held_out(i, 4, 2) and labels[i] is not None]
    assert area(np.array([out[i]["score"] for i in own]), np.array([labels[i] for i in own])) > 0.95


def test_classifier_takes_the_same_rows_of_repeated_ids(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(int(i), " ".join(rng.choice(list("abcdef"), rng.integers(1, 40)))) for i in np.repeat(np.arange(30), 20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "id long, label int")
    got = [sorted((r["doc_id"], r["score"]) for r in quality_classifier.classify_quality(df.repartition(n), labels, most_rows=50).collect()) for n in (1, 7)]
    assert got[0] == got[1]


def test_op6(spark, documents):
    out = {r["doc_id"]: r for r in quality_rules.query(spark, SF).collect()}
    assert set(out) == set(documents)
    for i, r in out.items():
        text = documents[i]["text"] or ""
        words, n = WORD.findall(text), {}
        for w in zip(*(words[k:] for k in range(5)), strict=False):
            n[w] = n.get(w, 0) + 1
        covered = {j for k, w in enumerate(zip(*(words[k:] for k in range(5)), strict=False)) if n[w] > 1 for j in range(k, k + 5)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(covered))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert r["kept"] == (not r["base_failed"] and r["low"] - 1e-3 <= r["log_perplexity"] <= r["high"] + 1e-3) or abs(r["log_perplexity"] - r["low"]) < 2e-3 or abs(r["log_perplexity"] - r["high"]) < 2e-3


def test_op7(spark, documents):
    out = {r["doc_id"]: r for r in ngram_join.query(spark, SF).collect()}
    ids = sorted(documents)
    sets = {}
    for i in ids:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), documents[i]["text"] or ""))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    label = {i: i for i in ids}
    links = [(a, b) for a, b in itertools.combinations(ids, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    for _ in ids:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in out.items()} == {i: (len(sets[i]), label[i]) for i in ids}


def test_op8_digests(spark):
    out = {r["conv_id"]: r for r in catalogue.queries()["op8_chat_format"](spark, SF).collect()}
    turns = {-7: [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    for c, own in turns.items():
        loss = "".join(t for role, t in own if role == "assistant")
        assert out[c]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in own).encode()).hexdigest()
        assert (out[c]["loss_chars"], out[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_op9_recall(spark):
    out = {}
    for r in catalogue.queries()["op9_nearest_neighbours"](spark, SF.replace("0.001", "0.1")).collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    table = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet").toPandas()
    x, ids = np.stack(table["embedding"]).astype(float), table["vec_id"].to_numpy()
    hits = 0
    for q, found in out.items():
        away = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        away[ids == q] = np.inf
        assert all(s == pytest.approx(away[ids == v][0], abs=1e-9) for v, s in found.values()) and sorted(found) == list(range(1, 11))
        hits += len({v for v, _ in found.values()} & set(ids[np.lexsort((ids, away))[:10]].tolist()))
    assert set(out) == set(ids[ids % 100 == 0].tolist()) and hits >= 0.9 * 10 * len(out)


def test_op10_on_languages_held_out(spark, documents):
    out = {r["doc_id"]: r for r in language_id.query(spark, SF.replace("0.001", "0.01")).collect()}
    langs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").collect()}
    assert all(r["held_out"] == held_out(i, 5, 0) and 0 <= r["score"] <= 1 for i, r in out.items())
    assert all((r["lang_pred"] == "und") == (not any(map(str.isalpha, langs[i]["text"] or ""))) for i, r in out.items())
    own = [i for i, r in out.items() if r["held_out"] and langs[i]["lang"] and r["lang_pred"] != "und"]
    assert np.mean([out[i]["lang_pred"] == langs[i]["lang"] for i in own]) > 0.97


def mixture_by_hand(like, n, turns=3000):
    """Shares of a mixture by plain expectation-maximisation, one document, all languages allowed."""
    share = [1 / len(like[0])] * len(like[0])
    for _ in range(turns):
        new = [0.0] * len(share)
        for row, count in zip(like, n, strict=True):
            total = sum(s * v for s, v in zip(share, row, strict=True))
            for x in range(len(share)):
                new[x] += count * share[x] * row[x] / total
        share = [v / sum(n) for v in new]
    return share, sum(c * np.log(sum(s * v for s, v in zip(share, row, strict=True))) for row, c in zip(like, n, strict=True))


def test_mixtures_by_hand():
    rng = np.random.default_rng(2)
    like, n = rng.random((60, 5)), rng.integers(1, 6, 60).astype(float)
    like /= like.max(axis=1, keepdims=True)
    start = np.array([0, 10, 40])
    share, fit = language_id._mixture(like, n, start, np.ones((3, 5)))
    for d, (a, b) in enumerate(itertools.pairwise([*start, 60])):
        wanted, best = mixture_by_hand(like[a:b].tolist(), n[a:b].tolist())
        assert fit[d] == pytest.approx(best, abs=0.05) and np.abs(share[d] - wanted).max() < 0.1
        assert share[d].sum() == pytest.approx(1)


def test_sets_of_many_languages(spark):
    rng = np.random.default_rng(3)
    letters = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx", "yzäö", "éèàç"]
    vocabulary = [["".join(rng.choice(list(x), rng.integers(3, 7))) for _ in range(40)] for x in letters]
    train = [(" ".join(rng.choice(v, 200)), f"l{i}") for i, v in enumerate(vocabulary) for _ in range(5)]
    mixed = " ".join(w for v in vocabulary[:6] for w in rng.choice(v, 80))
    df = spark.createDataFrame([(1, mixed, "mine"), (2, " ".join(rng.choice(vocabulary[7], 50)), "mine")], "doc_id long, text string, lang_pred string")
    out = {r["doc_id"]: r for r in language_id.identify_languages(df, spark.createDataFrame(train, "text string, lang string"), keep=("doc_id", "lang_pred")).collect()}
    assert out[1]["lang_set"] == [f"l{i}" for i in range(6)] and abs(out[1]["score"] - 1 / 6) < 0.03
    assert out[2]["lang_set"] == ["l7"] and out[2]["score"] == 1


CLASH = ("digest", "part", "count", "before", "number", "phases", "phase", "lines", "row", "key", "removed", "id", "h", "h2", "place", "mix_slot", "n_lines", "full", "w")


def test_names_with_dots(spark):
    df = spark.createDataFrame([(i % 2, "a\nb\nc", "src0", i) for i in range(4)], "doc_id long, text string, source string, `a.b` int")
    for out in (mixing.mix_sources(df, {"src0": 1}), line_dedup.dedup_lines(df)):
        assert sorted(r["a.b"] for r in out.collect()) == [0, 1, 2, 3]


def test_columns_that_clash_are_kept(spark):
    text = "a\nb\nc\nd"
    df = spark.createDataFrame([(i, text, "src0", *(f"{c}{i}" for c in CLASH)) for i in range(4)], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASH))
    for out, own in ((mixing.mix_sources(df, {"src0": 1}), {"mix_slot"}), (line_dedup.dedup_lines(df), {"n_lines"})):
        found = out.collect()
        assert len(found) == 4 and all(r[c] == f"{c}{r['doc_id']}" for r in found for c in CLASH if c not in own)
    assert sorted(r["n_removed"] for r in line_dedup.dedup_lines(df).collect()) == [0, 4, 4, 4]


def test_join_stage_keeps_rows_of_one_id_apart(spark):
    import corpus_pipeline

    x, y = " ".join(f"x{i}" for i in range(50)), " ".join(f"y{i}" for i in range(50))
    rows = [(1, x), (5, y), (5, x), (7, None), (7, None), (8, " "), (9, y), (9, y), (None, "z z z z z z")]
    docs = spark.createDataFrame([(i, t, "en", "s", 3, "more") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string")
    out = corpus_pipeline.near_copy_stage(spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(1, x), (5, y), (7, None), (7, None), (8, " "), (None, "z z z z z z")], key=str)


@pytest.mark.parametrize("stage", range(5))
def test_stages_with_nulls_repeats_and_nothing(spark, stage):
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    rows = [(None, None, None, None, None, "e", "e"), (1, "", "en", "src0", 0, "e", "e"), (1, None, None, None, None, "e", "e"), (2, "the cat " * 40, "en", "src1", 9, "e", "e"), (2, "the cat " * 40, "en", "src1", 9, "e", "e")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, number string, bin string"
    docs = spark.createDataFrame(rows, schema)
    found = {"language_id": 2, "line_dedup": 5, "ngram_jaccard_join": 4, "mix_sources": 5, "best_fit_packing": 5}
    out = run(spark, docs, SF)
    assert out.count() == found[name]
    assert name == "best_fit_packing" or out.columns == corpus_pipeline.COLUMNS
    assert run(spark, docs.where(F.lit(False)), SF).count() == 0


def test_hashes_of_spans_in_several_pieces(monkeypatch):
    texts = ["one two  three", None, "", "x" * 500, "a line\nanother\n\nlast " + "y" * 70]
    whole = textarrays.Words(texts, lower=True)
    expected = whole.hashes(), whole.span_hashes(*whole.lines()[:2])
    monkeypatch.setattr(textarrays, "PIECE", 64)
    textarrays._powers.cache_clear()
    parts = whole.hashes(), whole.span_hashes(*whole.lines()[:2])
    textarrays._powers.cache_clear()
    assert all((a == b).all() for a, b in zip(expected, parts, strict=True)) and len(expected[0]) == 9
    assert whole.per_text(whole.word).tolist() == [11, 0, 0, 500, 86]


#: With 330,000 lines the texts have 20 MB, and the test below takes over three minutes.
LONG_LINES = 60_000


def test_very_long_texts(spark):
    """One text of words, one of a single word, and a copy of the first; each operator takes them whole."""
    words = [f"w{i}" for i in range(3000)]
    rng = np.random.default_rng(3)
    long = "\n".join(" ".join(words[i] for i in row) for row in rng.integers(len(words), size=(LONG_LINES, 12)))
    single = "ab" * (len(long) // 2)
    docs = spark.createDataFrame([(1, long, "en"), (2, single, "en"), (3, long, "en"), (4, "a short text of some words", "en")], "doc_id long, text string, lang string").repartition(4)
    joined = {r["doc_id"]: r for r in ngram_join.ngram_jaccard_join(docs).collect()}
    tokens = [line.split(" ") for line in long.split("\n")]
    flat = [w for line in tokens for w in line]
    shingles = len({tuple(flat[i : i + 5]) for i in range(len(flat) - 4)})
    assert [(joined[i]["n_shingles"], joined[i]["component_id"]) for i in (1, 2, 3, 4)] == [(shingles, 1), (1, 2), (shingles, 1), (2, 4)]
    rules = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert [(rules[i]["n_words"], rules[i]["word_chars"]) for i in (1, 2)] == [(len(flat), len("".join(flat))), (1, len(single))]
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify_languages(docs, docs.where("doc_id = 4")).collect()}
    assert set(found.values()) == {"en"}
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed").collect()}
    assert (out[1]["n_lines"], out[1]["n_removed"], out[3]["n_removed"]) == (LONG_LINES, 0, LONG_LINES)
    ids = {r["id"]: r["n"] for r in packing.pieces(docs.where("doc_id <> 2").select(F.col("doc_id").alias("id"), "text"), 4096, vocabulary_path()).groupBy("id").agg(F.sum("length").alias("n")).collect()}
    assert ids[1] == ids[3] == len(tokenizer(vocabulary_path()).tokenizer.encode(long, add_special_tokens=False).ids) + 1
