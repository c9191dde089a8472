import hashlib
import random
import re

import numpy as np
import pytest

from landshift.llm import substrings

SCHEMA = "doc_id long, text string, key string, at int"


def _brute(rows, window):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            k = tuple(words[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def _got(spark, rows, window, **how):
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA).repartition(5)
    return {r.doc_id: tuple(r)[1:] for r in substrings.deduplicated(df, window=window, with_text=True, **how).collect()}


@pytest.mark.parametrize("window,anchor,hot", [(20, 6, 4096), (8, 3, 40), (8, 3, 1)])
def test_as_by_brute_force(spark, monkeypatch, window, anchor, hot):
    monkeypatch.setattr(substrings, "HOT_KEYS", hot)
    rng = random.Random(window)
    word = lambda: rng.choice(["an", "of", "x", "é", "the", "9"]) + str(rng.randint(0, 30))
    passages = [[word() for _ in range(rng.randint(5, 60))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(p) + 1), 2))
            words += p[a:b] if rng.random() < 0.6 else p
            words += [word() for _ in range(rng.randint(0, 9))]
        rows.append((i * 3, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(1, None), (2, ""), (4, "a " * 90), (5, "a " * 90), (7, rows[3][1]), (10, "w " * 15), (None, rows[5][1])]
    assert _got(spark, rows, window, anchor=anchor) == _brute(rows, window)


def test_long_text_and_empty_table(spark):
    rng = random.Random(1)
    long = " ".join(str(rng.randint(0, 10**6)) for _ in range(300_000))
    rows = [(1, long), (2, "x " + long[: len(long) // 2]), (3, "nothing here")]
    got = _got(spark, rows, 20)
    assert got[1][1] == 0 and got[3][1] == 0 and got[2][0] - got[2][1] <= 2
    assert _got(spark, [], 20) == {}


def test_factors_point_to_earlier_equal_words(spark):
    rng = random.Random(9)
    texts = [[str(rng.randint(0, 999)) for _ in range(80)] for _ in range(3)]
    rows = [(1, texts[0]), (2, texts[1]), (3, texts[0][10:50] + ["new"] + texts[1][5:45]), (4, texts[2])]
    df = spark.createDataFrame([(i, " ".join(t), None, None) for i, t in rows], SCHEMA)
    got = {r.key: [tuple(f) for f in r.factors] for r in substrings.factors(df).collect()}
    assert got == {3: [(0, 40, 1, 10), (41, 40, 2, 5)]}


def test_blocks_cover_every_window_once_and_alike():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    both = np.concatenate([words, rng.integers(0, 1 << 63, 50, dtype=np.uint64), words])
    doc = np.repeat([0, 1], [400, 450])
    first, n, anchor, content = substrings.cut(both, doc)
    covered = np.concatenate([np.arange(a, a + k) for a, k in zip(first, n)])
    assert sorted(covered) == [i for i in range(len(both) - 19) if doc[i] == doc[i + 19]]
    a = {(int(x), int(c)) for f, x, c in zip(first, anchor, content) if f < 360}
    b = {(int(x), int(c)) for f, x, c in zip(first, anchor, content) if f >= 480}
    assert len(a & b) > 0.8 * len(a)


def test_repeated_rows(spark):
    rows = [(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (2, "a b c d e f g h i j")]
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    assert sorted((r.doc_id, r.n_removed) for r in substrings.deduplicated(df, window=5, anchor=2).collect()) == [(1, 0), (1, 0), (2, 10)]
