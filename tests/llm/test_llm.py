import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import additive_codes, boosting, language_id, line_dedup, mixing, nearest, ngram_join, packing, quality_classifier, quality_rules, token_files
from tessera.llm.chat_format import format_conversations, formatted_text, read_back
from tessera.llm.scratch import new_folder
from tessera.llm.tokens import END_ID, ids_crc32, tokenizer, vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, extra string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
TEXTS = [None, "", " \n\t", "a", "A b", "one two three four five six", "one two three four five six", "one two THREE four five seven", LONG, LONG + " end", "x\ny\nz\nx\ny\nz\nq", "π ü 漢字 ok", "x\ny\nz\nx\ny\nz\nq"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None, "fr"][i % 3], f"src{i % 4}" if i % 5 else None, "e") for i, t in enumerate(TEXTS)] + [(None, "no id here", "en", "src1", "e"), (3, "a", "en", "src3", "e")]
    return spark.createDataFrame(rows, DOCS).repartition(3).persist()


def test_period_keeps_every_source_within_one_block():
    shares = {"a": 5, "b": 3, "c": 1, "d": 1}
    order = mixing.period(shares)
    for t in range(1, len(order) + 1):
        for s, p in shares.items():
            assert abs(order[:t].count(s) - t * p / 10) < 1


def test_mixing(spark, docs):
    out = mixing.mix_sources(docs, {"src0": 2, "src1": 1, "src2": 1}, block_rows=2).collect()
    assert len(out) == docs.count()
    assert len({(r["mix_slot"], r["mix_place"]) for r in out}) == len(out)
    assert mixing.mix_sources(docs.limit(0), {"src0": 1}).count() == 0


def test_packing(spark, docs):
    out = packing.pack_documents(docs, capacity=512, partition_pieces=40).collect()
    encode, wanted = tokenizer(vocabulary_path()).encode, {}
    for i, t in enumerate(TEXTS):
        ids = np.append(encode(t), np.uint32(END_ID))
        wanted[i] = [(n, at, min(512, len(ids) - at), ids_crc32(ids[at : at + 512])) for n, at in enumerate(range(0, len(ids), 512))]
    for i, pieces in wanted.items():
        assert sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out if r["doc_id"] == i}) == pieces
    for _, own in itertools.groupby(sorted(out, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 512
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_bounds_of_bins():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = rng.integers(1, 101, 40)
        bins, _, room = packing.best_fit_decreasing(lengths, 100)
        assert packing.lower_bound(np.bincount(lengths, minlength=101), 100) <= len(room)
        assert np.bincount(bins, lengths).max() <= 100


def test_token_files(spark, docs):
    folder = new_folder(spark, "tokens")
    token_files.write_token_files(docs, folder, shard_bytes=5000)
    back = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r["start"])
    assert len(back) == docs.count() and [r["id"] for r in back] == sorted((r["id"] for r in back), key=lambda x: (x is not None, x))
    at, encode = 0, tokenizer(vocabulary_path()).encode
    for r in back:
        assert r["start"] == at
        at += r["n_tokens"]
        if r["id"] is not None:
            ids = np.append(encode(TEXTS[r["id"]]), np.uint32(END_ID))
            assert r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids.astype("<u4").tobytes())
            assert (token_files.read_document(folder, r["shard"], r["place"]) == ids).all()
    empty = new_folder(spark, "tokens")
    token_files.write_token_files(docs.limit(0), empty)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_encoding_is_the_tokenizers():
    t = tokenizer(vocabulary_path())
    for text in [x for x in TEXTS if x] + ["don't 12ab <|endoftext|> É́ \x1c end", "ÀÉ's it's"]:
        assert t.encode(text).tolist() == t.tokenizer.encode(text, add_special_tokens=False).ids


def test_trees_learn_and_constant_labels():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(int)
    assert ((boosting.fit(x, y).score(x) > 0.5) == y).mean() > 0.98
    assert boosting.fit(x, np.ones(2000, int)).score(x[:2]).tolist() == pytest.approx([0.999, 0.999])
    assert boosting.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality_classifier(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (4, None)], "id long, label int")
    out = quality_classifier.classify_quality(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert quality_classifier.classify_quality(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality_classifier.classify_quality(docs, labels.limit(0)).collect()} == {0.5}


def base_by_hand(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered))


def test_quality_rules(spark):
    texts = [t for t in TEXTS if t is None or len(t) < 1000] + ["a b c d e f a b c d e g # | <x>\na\na", "the cat sat on the mat and the dog ran to the cat on the mat"]
    df = spark.createDataFrame([(i, t, None if i % 2 else "en", i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words long")
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base_by_hand(t)
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def test_perplexity_alone_rejects_junk(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 8))) for _ in range(60)]
    text = lambda n: [words[i] for i in rng.integers(0, 60, n)]
    clean = [" ".join(text(n)) for n in rng.integers(20, 300, 400)]
    junk = []
    for n in rng.integers(60, 300, 12):  # every fourth word is of any letters
        w = text(n)
        w[::4] = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in w[::4]]
        junk.append(" ".join(w))
    rows = [(i, t, "en") for i, t in enumerate(clean + junk)] + [(-i, clean[0], "en") for i in range(1, 900)]  # copies move no limit
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(out[i]["base_failed"] for i in range(len(clean) + len(junk)))
    assert not any(out[i]["kept"] for i in range(len(clean), len(clean) + len(junk)))
    assert sum(out[i]["kept"] for i in range(len(clean))) >= 0.96 * len(clean)

def kneser_ney_by_hand(texts, order=5):
    """Probability of a character after the others: the formula on dictionaries, interpolated from the shortest order up."""
    counts = [{} for _ in range(order + 1)]
    for t in texts:
        t = re.sub(r"[\x20\x09-\x0D]+", " ", t or "").strip(" ")
        padded = " " * (order - 1) + t + " "
        for i in range(order - 1, len(padded) if t else 0):
            g = padded[i - order + 1 : i + 1]
            counts[order][g] = counts[order].get(g, 0) + 1
    for o in range(order - 1, 0, -1):
        for g in counts[o + 1]:
            counts[o][g[1:]] = counts[o].get(g[1:], 0) + 1
    discounts = {}
    for o in range(1, order + 1):
        n = [sum(c == k for c in counts[o].values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k for k in (1, 2, 3)]
        discounts[o] = [0.0] + [min(max(d, 0.05), k) for k, d in zip((1, 2, 3), raw, strict=True)]

    def p(gram):
        if not gram:
            return 1 / (len(counts[1]) + 1)
        o = len(gram)
        after = {g: c for g, c in counts[o].items() if g[:-1] == gram[:-1]}
        total = sum(after.values())
        if not total:
            return p(gram[1:])
        took = lambda c: discounts[o][min(c, 3)]
        c = after.get(gram, 0)
        return (c - took(c) + sum(map(took, after.values())) * p(gram[1:])) / total

    return p


def test_model_is_kneser_ney(spark):
    from tessera.llm import language_model as lm

    rng = np.random.default_rng(1)
    texts = {x: ["".join(rng.choice(list(letters), rng.integers(1, 60))) for _ in range(40)] for x, letters in (("a", "abc é漢 \n"), ("b", "ab\U0001f600  "))}
    texts["a"] += [None, "", " \t", "a" * 50]
    rows = [(x, t) for x, own in texts.items() for t in own]
    files = lm.train(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    keys = lm.language_keys(["a", "b", "new"])
    for n, x in enumerate(("a", "b")):
        p = kneser_ney_by_hand(texts[x])
        assert abs(sum(p("abc " + c) for c in {c for t in texts[x] for c in (t or "").replace("\n", " ").replace("\t", " ")}) + p("abc ?") - 1) < 1e-9
        for t in [*texts[x][:8], "zab c", "é漢 \U0001f600 ab"]:
            padded = "    " + re.sub(r"\s+", " ", t).strip(" ") + " "
            wanted = [np.log(p(padded[i - 4 : i + 1])) for i in range(4, len(padded))] if t.strip() else []
            total, places = lm.score(files, [t], keys[n : n + 1])
            assert places[0] == len(wanted) and np.isclose(total[0], sum(wanted), rtol=1e-5)
    assert lm.score(files, ["ab"], keys[2:])[0][0] == pytest.approx(-3 * np.log(0x110000))
    assert lm.train(spark.createDataFrame([], "lang string, text string")) == [] and lm.score([], ["ab", None], keys[:2])[1].tolist() == [3, 0]


def test_languages_have_models_and_limits_of_their_own(spark):
    rng = np.random.default_rng(5)
    vocabulary = {x: ["".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(50)] for x, letters in (("xx", "абвгдежз"), ("yy", "etaoin"), (None, "一二三四五"))}
    text = lambda x, n: " ".join(rng.choice(vocabulary[x], n))
    rows = [(i, text(x, int(n)), x) for i, (x, n) in enumerate((x, n) for x in vocabulary for n in rng.integers(20, 200, 200))]
    rows += [(1000 + i, text(other, 60), x) for i, (x, other) in enumerate((("xx", "yy"), ("yy", None), (None, "xx")))]  # of another language than they say
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(out[i]["kept"] for i in range(600)) >= 580
    for i in range(3):
        assert not out[1000 + i]["kept"] and out[1000 + i]["log_perplexity"] > out[1000 + i]["high"]


def jaccard_by_hand(texts, k, num, den):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(sets)))
    for _ in sets:
        for i, j in itertools.combinations(range(len(sets)), 2):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                label[i] = label[j] = min(label[i], label[j])
    return [(len(s), c) for s, c in zip(sets, label, strict=True)]


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_ngram_join(spark, k, num):
    rng = np.random.default_rng(k)
    base = [f"w{x}" for x in rng.integers(0, 40, 120)]
    texts = list(TEXTS)
    for _ in range(60):  # near copies of copies, so that links chain
        w = list(base if rng.random() < 0.3 else texts[-1].split())
        w[rng.integers(len(w))] = f"n{rng.integers(9)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_shingles int").repartition(3)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(df, k=k, num=num, block=8).collect()}
    assert [out[i] for i in range(len(texts))] == jaccard_by_hand(texts, k, num, 100)


def test_ngram_join_of_nothing(spark, docs):
    assert ngram_join.ngram_jaccard_join(docs.limit(0)).count() == 0
    assert ngram_join.ngram_jaccard_join(docs).where("doc_id is null and component_id is null").count() == 1


def test_line_dedup(spark, docs):
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert len(out) == len(TEXTS) + 1 and out[0]["text"] is None and out[0]["n_lines"] == 0
    assert out[10]["text"] == "x\ny\nz\nq" and out[10]["n_removed"] == 3 and out[12]["n_removed"] == 7
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a <b> \\l"), (1, 1, "assistant", "</turn>\n<turn user>"), (1, 2, None, None), (2, None, "system", ""), (None, 0, "user", "x")]
    out = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = out.select("conv_id", "n_turns", "valid", read_back(formatted_text(F.col("segments"))).alias("turns")).collect()
    turns = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in back}
    assert turns == {1: [("user", "a <b> \\l"), ("assistant", "</turn>\n<turn user>"), ("", "")], 2: [("system", "")], None: [("user", "x")]}
    assert not any(r["valid"] for r in back)


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist(), 0) for i in range(15)]
    rows += [(2000, None, 0), (2100, [0.0] * 16, 0), (2200, [float("nan")] * 16, 0), (2300, [None] * 16, 0), (2400, [1.0], 0), (None, x[1].tolist(), 0), (5, x[5].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    out = nearest.nearest_neighbours(df, df.where("vec_id % 100 = 0"), sample_rows=300, size=32).collect()
    ids = np.array([*range(600), *range(1000, 1015)])
    all_x = np.concatenate([x, np.repeat(x[:1], 15, axis=0)])
    hits = 0
    for q in (0, 100, 200, 300, 400, 500, 1000):
        own = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
        away = np.sqrt(((all_x - all_x[ids == q]) ** 2).sum(axis=1))
        away[ids == q] = np.inf
        hits += len({r["vec_id"] for r in own} & set(ids[np.lexsort((ids, away))[:10]].tolist()))
        assert [r["rank"] for r in own] == list(range(1, 11)) and np.allclose([r["score"] for r in own], [away[ids == r["vec_id"]][0] for r in own])
    assert hits >= 63
    assert nearest.nearest_neighbours(df.limit(0), df).count() == 0


def test_codes_keep_norms():
    x = np.random.default_rng(1).normal(size=(500, 8)).astype(np.float32)
    books = additive_codes.train(x, 4, 16)
    codes, norms = additive_codes.encode(x, books)
    whole = sum(b[codes[:, m]] for m, b in enumerate(books))
    assert np.allclose((whole**2).sum(axis=1), norms, rtol=1e-3, atol=1e-3)
    assert ((x - whole) ** 2).sum() < ((x - books[0][additive_codes._nearest(x, books[0])]) ** 2).sum()


def test_language_id(spark):
    en, de = "the house of the river and the tree was there with them", "der Fluss und das Haus mit dem Baum ist nicht weit von der Stadt"
    train = spark.createDataFrame([(en, "en"), (de, "de"), (None, "xx"), ("x", None)], "text string, lang string")
    df = spark.createDataFrame([(1, en), (2, de), (3, None), (4, "12 ++ ..."), (5, ""), (6, f"{en} {de}"), (6, f"{en} {de}"), (None, "the river")], "doc_id long, text string")
    out = {(r["doc_id"]): r for r in language_id.identify_languages(df, train).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3, 4, 5, None)] == ["en", "de", "und", "und", "und", "en"]
    assert out[6]["lang_set"] == ["de", "en"] and 0.3 < out[6]["score"] < 0.7 and out[3]["score"] == 0
    assert {r["lang_pred"] for r in language_id.identify_languages(df, train.limit(0)).collect()} == {"und"}
    assert language_id.identify_languages(df.limit(0), train).count() == 0


def test_packing_stage_follows_the_mixture(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "RANGE_PIECES", 150, raising=False)
    rng = np.random.default_rng(4)
    sources = ["src0"] * 1200 + ["src5"] * 1200 + ["src10"] * 600  # shares 8, 4, 2: src0 ends first
    docs = spark.createDataFrame([(i, "a b c " * int(rng.integers(20, 500)), "en", s, 9) for i, s in enumerate(sources)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(docs.select("doc_id", "source"), corpus_pipeline.SHARES).orderBy("mix_slot", "mix_place").collect()
    rows = corpus_pipeline.packing_stage(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["piece"]) for r in rows) == sorted({(r["doc_id"], r["piece"]) for r in rows}) and {r["doc_id"] for r in rows} == set(range(3000))
    assert {r["sequence_id"] for r in rows} == set(range(max(r["sequence_id"] for r in rows) + 1))
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= packing.CAPACITY and len(fill) <= 1.02 * sum(fill.values()) / packing.CAPACITY + 1
    order = {r["doc_id"]: (r["sequence_id"], r["offset"]) for r in rows}
    found = [sources[i] for i in sorted(order, key=order.get)]
    for n in range(300, 3001, 50):
        for s in ("src0", "src5", "src10"):
            assert abs(found[:n].count(s) - [r["source"] for r in mixed[:n]].count(s)) < 0.05 * n


def test_language_stage_rejects_what_is_like_no_language(spark):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    vocabulary = {x: ["".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(80)] for x, letters in (("en", "etaoinshr"), ("fr", "aeiuolnsd"))}
    text = lambda x, n: " ".join(rng.choice(vocabulary[x], n))
    rows = [(i, text(x, int(n)), x) for i, (x, n) in enumerate(zip(rng.choice(["en", "fr"], 300), rng.integers(15, 200, 300), strict=True))]
    rows += [(1000 + i, text("en", 60) + " " + text("fr", 50), "en") for i in range(20)]
    junk = ["".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 80)) for _ in range(5)] + ["".join(chr(c) if c % 7 else " " for c in rng.integers(0x430, 0x450, 400)) for _ in range(5)]
    junk += [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 7)) for _ in range(50)) for _ in range(10)]
    rows += [(2000 + i, t, "en") for i, t in enumerate(junk)]
    docs = spark.createDataFrame([(i, t, x, "s", len(t)) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r[0] for r in corpus_pipeline.language_stage(spark, docs, "").select("doc_id").collect()}
    assert not {i for i in kept if i >= 2000}
    assert len({i for i in kept if i < 1000}) >= 297 and len({i for i in kept if 1000 <= i < 2000}) >= 20


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf)
        assert after.columns == docs.columns
        assert 0 < after.count() <= kept.count()
        kept = spark.createDataFrame(after.toPandas(), docs.schema)
    assert {r[0] for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()} == {r["doc_id"] for r in kept.collect()}
