import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from landshift.llm import quality

SCHEMA = "doc_id long, text string, score string"


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _corpus(n=600, seed=2):
    rng = np.random.default_rng(seed)
    words = ["plain", "words", "make", "a", "line", "of", "the", "text", "over", "there"]
    docs, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words, rng.integers(1, 60)))
        bad = i % 3 == 0
        if bad:
            text = text.upper().replace(" ", "!! ") if i % 2 else " | ".join(text.split())
        docs.append((i, text, None))
        labels.append((i, int(not bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = _corpus()
    df = _rows(spark, docs)
    model = quality.learned(df, spark.createDataFrame(labels[:400], "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in quality.scored(df, model).collect()}
    held = [(got[i], y) for i, y in labels[400:] if len(docs[i][1].split()) > 3]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.random((500, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no feature tells anything alone
    m = quality.fitted(x, y, rounds=20, pair_rounds=60, pairs=2)
    assert (0, 1) in m.grids
    assert ((m.score(x) > 0.5) == (y > 0.5)).mean() > 0.9
    one = x[:1]
    total = m.intercept + sum(t[np.searchsorted(c, one[0, f], "right")] for f, (c, t) in enumerate(zip(m.cuts, m.tables)))
    total += sum(g[np.searchsorted(m.coarse[a], one[0, a], "right"), np.searchsorted(m.coarse[b], one[0, b], "right")] for (a, b), g in m.grids.items())
    assert np.isclose(m.margin(one)[0], total)


def test_nulls_empty_long_texts_and_repeats(spark):
    docs, labels = _corpus(60)
    model = quality.learned(_rows(spark, docs), spark.createDataFrame([*labels, (5, None)], "doc_id long, quality int"))
    odd = [(1, None, "x"), (1, None, "x"), (2, "", None), (None, "a", None), (3, "word " * 200_000, None), (4, "é\U0001f600" * 3, None)]
    got = quality.scored(_rows(spark, odd), model).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert quality.scored(_rows(spark, []), model).count() == 0


def test_without_labels_or_with_one_kind(spark):
    docs, _ = _corpus(9)
    none = quality.learned(_rows(spark, docs), spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.scored(_rows(spark, docs[:2]), none).collect()] == [0.5, 0.5]
    ones = quality.learned(_rows(spark, docs), spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int"))
    assert all(r.score > 0.8 for r in quality.scored(_rows(spark, docs), ones).collect())


def test_learning_is_bounded_and_repeatable(spark):
    docs, labels = _corpus(200)
    df, lab = _rows(spark, docs).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int")
    one, two = (quality.learned(d, lab, max_rows=120) for d in (df, df.repartition(3)))
    x = np.random.default_rng(0).random((20, len(quality.FEATURES)))
    assert np.array_equal(one.score(x), two.score(x))


def _plain(text):
    """The features of a text in their order, by plain Python on its bytes."""
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, size = max(1, len(words)), max(1, len(raw))
    share = lambda chars: sum(b in chars for b in raw) / size
    upper = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    high = bytes(range(128, 256))
    kinds = [upper + upper.lower() + high, upper, b"0123456789", b" \t\n\v\f\r", high, b".?", b",;:", b"!", b"|", b"#$%&*@^~=+_/\\", b"()[]{}<>", b"\"'`"]
    lines = [tuple(re.findall(rb"[^\x20\x09-\x0D]+", line)) for line in raw.split(b"\n")]
    full = [line for line in lines if line]
    return [
        math.log1p(len(raw)), math.log1p(len(words)), (len(raw) - raw.count(b" ") - raw.count(b"\n")) / n, *map(share, kinds), math.log1p(len(raw) / len(lines)),
        sum(len(w) <= 3 for w in words) / n, sum(len(w) >= 14 for w in words) / n, len(set(words)) / n, max(Counter(words).values(), default=0) / n, sum(w[0] in upper for w in words) / n,
        sum(w[-1] in b"#$%&*@^~=+_|!\\" for w in words) / n, 1 - len({tuple(sorted(line)) for line in full}) / max(1, len(full)),
    ]


def test_features_as_by_plain_python():
    rng = random.Random(4)
    bits = ["the", "A", "Words!", "straße", "x|", "12.5", "(a)", "internationalisation", "#tag_", "\n", "\n\n", "\t", " ", "'q'", "même", "same line\nsame line\n"]
    texts = ["", " ", "\n", "one", *("".join(rng.choice(bits) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(1, 60))) for _ in range(120))]
    raw = [t.encode() for t in texts]
    got = quality.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert got.shape == (len(texts), len(quality.FEATURES))
    for row, text in zip(got, texts, strict=True):
        assert row == pytest.approx(_plain(text), rel=1e-5, abs=1e-6), text


def _stump(groups, ridge, least):
    """The best single cut of ordered groups [(g, h)] by trying each; values per group."""
    leaf = lambda part: sum(g for g, _ in part) ** 2 / (sum(h for _, h in part) + ridge)
    tries = [(leaf(groups[:k]) + leaf(groups[k:]) - leaf(groups), -k) for k in range(1, len(groups)) if min(sum(h for _, h in groups[:k]), sum(h for _, h in groups[k:])) >= least]
    gain, k = max(tries, default=(-1, 0))
    return gain, -k


def test_boosting_as_by_plain_loops():
    rng = np.random.default_rng(6)
    x = rng.random((300, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.random(300) > 0.9).astype(float)
    how = {"rounds": 4, "bins": 8, "rate": 0.15, "ridge": 2.0, "least": 4.0}
    m = quality.fitted(x, y, pair_rounds=0, **how)
    margin = [m.intercept] * 300
    where = [[sum(c <= v for c in m.cuts[f]) for v in x[:, f]] for f in range(3)]
    tables = [[0.0] * (len(c) + 1) for c in m.cuts]
    for _ in range(how["rounds"]):
        for f in range(3):
            q = [1 / (1 + math.exp(-v)) for v in margin]
            groups = [(sum(y[i] - q[i] for i in range(300) if where[f][i] == b), sum(q[i] * (1 - q[i]) for i in range(300) if where[f][i] == b)) for b in range(len(tables[f]))]
            parts = [(0, len(groups))]
            while len(parts) < 3:  # three leaves: the part whose cut gains most is cut
                gain, k, a, b = max((*_stump(groups[a:b], how["ridge"], how["least"]), a, b) for a, b in parts)
                if gain <= 0:
                    break
                parts = [p for p in parts if p != (a, b)] + [(a, a + k), (a + k, b)]
            for a, b in parts:
                step = how["rate"] * sum(g for g, _ in groups[a:b]) / (sum(h for _, h in groups[a:b]) + how["ridge"])
                tables[f][a:b] = [v + step for v in tables[f][a:b]]
                margin = [v + step * (a <= where[f][i] < b) for i, v in enumerate(margin)]
    for f in range(3):
        assert m.tables[f] == pytest.approx(tables[f])
    assert m.margin(x) == pytest.approx(margin)
