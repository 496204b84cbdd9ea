"""Turn repair, Merkle manifests and the token automaton against plain versions, on odd rows, and on nothing."""

import hashlib
import itertools
import random
import zlib

import pytest
from tokenizers import Tokenizer

from tessera.llm import merkle, token_automaton, turn_repair
from tessera.llm.scratch import new_folder
from tessera.llm.tokens import vocabulary_path

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# Turn repair.
def plain_damage(rows):
    space = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        text = "" if code == 1 else "".join(c for c in space(text) if code != 2 or c not in ".!?")
        yield from [(conv, turn, "user" if code == 4 else space(role), text)] * (0 if code == 0 else 2 if code == 3 else 1)


def plain_faults(rows):
    seen = set()
    for _, _, role, text in rows:
        worded = text.rstrip(BLANK)
        yield 1 if not worded else 2 if (role, text) in seen else 3 if worded[-1] not in ".!?" else 0
        seen.add((role, text))


def plain_repair(rows, faults):
    """Every state with its whole audit and output; inserts are tried anywhere."""
    full = turn_repair.ROLES

    def inserted(states):
        out = now = list(states)
        for _ in range(2):
            now = [(NEXT[s, r], (c + 2, a + "I", o + ((full[r], ""),))) for s, (c, a, o) in now for r in "ua" if (s, r) in NEXT]
            out = out + now
        return out

    best = {"": (0, "", ())}
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        found = []
        for state, (cost, audit, out) in inserted(best.items()):
            found.append((state, (cost + 3, audit + "D", out)))
            if fault not in (1, 2):
                more = cost + (fault == 3)
                if (state, role[:1]) in NEXT:
                    found.append((NEXT[state, role[:1]], (more, audit + "K", out + ((role, text),))))
                found += [(NEXT[state, r], (more + 2, audit + "R", out + ((full[r], text),))) for r in "ua" if (state, r) in NEXT]
        best = {s: min((v for t, v in found if t == s), key=lambda v: v[:2]) for s in {t for t, _ in found}}
    cost, audit, out = min((v for s, v in inserted(best.items()) if s in ("", "a")), key=lambda v: v[:2])
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def plain_summaries(rows):
    by = {r[0]: [] for r in rows}
    for r in plain_damage(rows):
        by[r[0]].append(r)
    for conv, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, turns = list(plain_faults(own)), [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        yield (conv, gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, *plain_repair(own, faults))


def random_turns(seed, n):
    r = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", None, "user", "assistant", ""], ["a.", "b.", "c", "", "  ", "d!", "e?\n", None, "x y", "z. "]
    return [(r.choice([1, 2, 3, None, 5, 6]), r.choice([None, *range(30)]), r.choice(roles), r.choice(texts)) for _ in range(n)] + [(9, 0, "user", "a."), (10, 7, "user", "a.")]


@pytest.mark.parametrize("sizes", [{}, {"piece": 2, "task": 2, "fan": 1}])
def test_repair_of_odd_conversations(spark, sizes):
    rows = random_turns(3, 300)
    df = spark.createDataFrame(rows, TURNS)
    edited = turn_repair.edited_turns(turn_repair.damaged(df), **sizes)
    out = turn_repair.summaries(edited, df.select(turn_repair._key(df["conv_id"]).alias("conv")).distinct())
    found = {(int(r[0][1:]) if r[0] else None, *r[1:]) for r in out.collect()}
    assert found == set(plain_summaries(rows))
    turns = {}
    for r in turn_repair.repaired_turns(edited).orderBy("conv", "at", "place").collect():
        turns.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
    for r in out.collect():
        assert hashlib.sha256("\n".join(turns.get(r["conv"], [])).encode()).hexdigest() == r["repaired_sha256"]


def test_repair_of_one_conversation_in_many_tasks(spark):
    rows = [(1, i, ("user", "assistant", "system")[zlib.crc32(b"%d" % i) % 3], f"text {i}" + "." * (i % 4)) for i in range(3000)] + [(2, 0, "user", "x" * 200_000), (2, 1, "assistant", "y " * 100_000 + ".")]
    folder = new_folder(spark, "conversations")
    spark.createDataFrame(rows, TURNS).repartition(7).write.parquet(f"{folder}/conversations.parquet")
    assert {tuple(r) for r in turn_repair.query(spark, folder).collect()} == set(plain_summaries(rows))


def test_repair_of_repeated_rows_and_of_nothing(spark):
    assert spark.createDataFrame([], TURNS).transform(turn_repair.edited_turns).collect() == []
    rows = [(1, None, "user", "same.")] * 50 + [(1, 3, "assistant", "b.")] * 2
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], TURNS + ", conv string, at int")  # clashing names are not read
    out = turn_repair.summaries(turn_repair.edited_turns(df), spark.createDataFrame([("=1",), ("=2",)], "conv string"))
    first, second = sorted(map(tuple, out.collect()))
    assert first[1:8] == (0, 0, 50, 0, 50, 150, "K" + "D" * 49 + "KD") and second[1:8] == (0, 0, 0, 0, 0, 0, "") and second[8] == hashlib.sha256(b"").hexdigest()


# Merkle manifests.
def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes, fan):
    """The last node, and for each node the sides of its way up."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // fan * fan : i // fan * fan + fan]
            ways[k].append(("".join(run[: i % fan]), "".join(run[i % fan + 1 :])))
            at[k] = i // fan
        nodes = [h(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
    return nodes[0], ways


def plain_manifest(docs, fan=3):
    """docs: rows of DOCS.  Rows (doc_id, leaf, subroot, root, proof digest), as a sorted list."""
    groups = {}
    for doc_id, text, lang, source, n_chars in docs:
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, plain_leaf([doc_id, source, lang, n_chars, text]), doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([r[2] for r in sorted(groups[s], key=lambda r: r[:3])], fan) for s in names]
    root, above = plain_tree([t[0] for t in trees], fan)
    out = []
    for s, (subroot, ways), up in zip(names, trees, above, strict=True):
        for r, way in zip(sorted(groups[s], key=lambda r: r[:3]), ways, strict=True):
            out.append((r[3], r[2], subroot, root, h(*(x for side in way + up for x in side))))
    return sorted(out, key=str)


def odd_documents():
    r = random.Random(5)
    docs = [(i, f"text {i}\nline", "en", "hot" if i % 3 else f"s{i % 11}", i) for i in range(200)]
    docs += [(None, None, None, None, None), (None, "a", "x", None, 1), (7, "", None, "hot", None), (7, "", None, "hot", None), (7, "zwei", None, "hot", None), (5, "é\U0001f600", "", "é", -3), (6, "y" * 300_000, "en", "", 2), (8, "b\nb", "en", "\U0001f600", 0)]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("fan", [2, 3, 5])
def test_manifest_of_odd_documents(spark, fan):
    docs = odd_documents()
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    out = merkle.merkle_manifest(df, merkle.COLUMNS, fan=fan)
    rows = out.withColumn("sum", merkle.proof_digest(out["proof"])).withColumn("end", merkle.folded(out["leaf"], out["proof"])).collect()
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["sum"]) for r in rows), key=str) == plain_manifest(docs, fan)
    assert all(r["end"] == r["root"] for r in rows)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_manifest_of_few_rows_and_clashing_columns(spark, n):
    docs = odd_documents()[:n]
    df = spark.createDataFrame([(*d, 1, 2, 3, 4) for d in docs], DOCS + ", leaf int, at int, `a.b` int, i int")
    out = merkle.merkle_manifest(df, merkle.COLUMNS)
    assert out.columns == ["doc_id", "source", "at", "a.b", "i", "leaf", "subroot", "root", "proof"]
    rows = out.withColumn("sum", merkle.proof_digest(out["proof"])).collect()
    assert [(r["at"], r["a.b"], r["i"]) for r in rows] == [(2, 3, 4)] * n
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["sum"]) for r in rows), key=str) == (plain_manifest(docs) if n else [])


def test_tampering_shows(spark):
    rows = merkle.query(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (texts[r["doc_id"]] or "")
        assert r["verified"] == (not changed) and (r["folded_root"] == r["root"]) == r["verified"]


# The token automaton.
@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encoder():
    return token_automaton.Encoder(token_automaton.compiled(vocabulary_path("byte_bpe_50k.json")))


def test_ids_are_the_library_s(library, encoder):
    r = random.Random(1)
    letters = "aaabetthhe  n\n\n'srl.-_=0123<|>éß中՘\U0001f600႑\x1c\x85  \t　"
    vocab = [x for x in (t.decode("utf-8", "ignore") for t in encoder.automaton.labels) if x]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(r.choice(vocab) for _ in range(r.randint(1, 4))) for _ in range(20_000)]
    texts += ["a" * 1000, " " * 777 + "x", "-" * 500, "<|endoftext|>a<|endoftext|> b", "<|endoftext", "aaa" * 333, "﻿", "\x00\x01", "é", "I'll he'S"]
    assert [encoder.ids(t).tolist() for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_paths_are_exactly_what_merges_give(library, encoder):
    """A sequence of two tokens is a path if and only if the library cuts its text in the same way."""
    r, a = random.Random(2), encoder.automaton
    words = [i for i, t in enumerate(a.labels) if t.isalpha() and t.isascii()]
    for _ in range(5000):
        u, v = r.choice(words), r.choice(words)
        ids = library.encode((a.labels[u] + a.labels[v]).decode(), add_special_tokens=False).ids
        assert a.has_arc(a.target[u], v) == (ids == [u, v])


def test_op13(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = token_automaton.query(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_coding_of_odd_rows(spark, library):
    texts = [None, "", "same", "same", "x" * 300_000, "word " * 200_000, "<|endoftext|>é", "\U0001f600" * 3]
    df = spark.createDataFrame([(i % 4, t, "kept", 5) for i, t in enumerate(texts)], "doc_id long, text string, `a.b` string, IDS int")
    out = token_automaton.encode_texts(df)
    assert out.columns == ["doc_id", "text", "a.b", "ids"]
    rows = token_automaton.decode_ids(out).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == (r["text"] or "") and r["a.b"] == "kept"
    assert token_automaton.decode_ids(token_automaton.encode_texts(df.limit(0))).collect() == []


def test_decoding_of_parts_of_characters(spark, library):
    ids = [[0, 158, 225], [158], None, [], [50256, 0]]
    rows = token_automaton.decode_ids(spark.createDataFrame([(i,) for i in ids], "ids array<int>"), drop_ids=True).collect()
    assert [r["decoded"] for r in rows] == [library.decode(i or [], skip_special_tokens=False) for i in ids]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_automaton.compiled(vocabulary_path())
