"""Parts of operators against plain versions that follow their definitions row by row."""

import numpy as np
import pytest

from tessera.llm import boosting, chat_format, mixing, quality_rules


def plain_trees(x, y, trees, depth, rate, bins, least_rows, ridge):
    """Boosting with a loop over rows, features and cuts; the score of each training row."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    total = np.full(len(x), np.log(share / (1 - share)))
    edges = [boosting._edges(c, bins) for c in x.T]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        nodes = [np.arange(len(x))]
        for _ in range(depth):
            below = []
            for rows in nodes:
                best = (1e-6, None, None)
                for f in range(x.shape[1]):
                    for cut in edges[f]:
                        left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                        if min(len(left), len(right)) < least_rows:
                            continue
                        part = lambda r: g[r].sum() ** 2 / (h[r].sum() + ridge)  # noqa: E731, B023
                        gain = part(left) + part(right) - part(rows)
                        if gain > best[0] + 1e-9:
                            best = (gain, f, cut)
                goes = np.ones(len(rows), bool) if best[1] is None else x[rows, best[1]] <= best[2]
                below += [rows[goes], rows[~goes]]
            nodes = below
        for rows in nodes:
            total[rows] += -rate * g[rows].sum() / (h[rows].sum() + ridge)
    return 1 / (1 + np.exp(-total))


def test_trees_are_those_of_a_plain_search():
    r = np.random.default_rng(0)
    x = np.round(r.random((300, 4)), 2)
    y = (x[:, 0] + 0.3 * r.random(300) > 0.6).astype(float)
    sizes = {"trees": 5, "depth": 3, "rate": 0.2, "bins": 16, "least_rows": 10, "ridge": 2.0}
    np.testing.assert_allclose(boosting.fit(x, y, **sizes).score(x), plain_trees(x, y, **sizes), atol=1e-9)


def test_limits_by_hand(spark):
    r = np.random.default_rng(1)
    rows = [("en" if i % 3 else "de", int(r.integers(1, 400)), float(r.normal(3, 0.3))) for i in range(400)] + [("en", 50, 3.0)] * 5 + [("en", 5, 9.0), ("fr", 3, 1.0), ("en", 40, None)]
    out = quality_rules.with_limits(spark.createDataFrame(rows, "language string, n_words int, log_perplexity double"), 1.5).collect()
    limits = {}
    for language in ("en", "de"):
        own = sorted({(n, v) for name, n, v in rows if name == language and n >= quality_rules.LEAST_WORDS and v is not None})
        middle = np.percentile([round(v, 4) for _, v in own], 50)
        d = [round((v - middle) * np.sqrt(n), 3) for n, v in own]
        q = np.percentile(d, [25, 50, 75])
        limits[language] = middle, q[0] - (q[1] - q[0]) * 3, q[2] + (q[2] - q[1]) * 3
    assert len(out) == len(rows)
    for row in out:
        if row["language"] not in limits or row["log_perplexity"] is None:
            assert not row["inside"]
            continue
        middle, below, above = limits[row["language"]]
        d = round((row["log_perplexity"] - middle) * np.sqrt(row["n_words"]), 3)
        assert row["inside"] == (below <= d <= above)
        assert row["low"] == pytest.approx(middle + below / np.sqrt(row["n_words"])) and row["high"] == pytest.approx(middle + above / np.sqrt(row["n_words"]))


def test_chats_and_mixtures_of_nothing_and_of_nulls(spark):
    turns = "conv_id long, turn long, role string, text string"
    assert chat_format.format_conversations(spark.createDataFrame([], turns)).collect() == []
    (one,) = chat_format.format_conversations(spark.createDataFrame([(None, None, None, None), (None, 0, "user", "x")], turns)).collect()
    assert one["conv_id"] is None and one["n_turns"] == 2 and not one["valid"]
    rows = [(None, None), (None, "a"), (1, None), (1, "a"), (1, "a"), (2, "b")]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), {"a": 2}, block_rows=1).collect()
    assert len({(r["mix_slot"], r["mix_place"]) for r in out}) == len(rows) and {r["mix_group"] for r in out} == {"a", mixing.OTHER}
    texts = mixing.mix_sources(spark.createDataFrame([("x", "a"), ("y", "a")], "doc_id string, source string"), {"a": 1}).collect()
    assert sorted(r["doc_id"] for r in texts) == ["x", "y"]
