import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from landshift.llm import neardup
from landshift.operators.graph import components

SCHEMA = "doc_id long, text string, node string, class_id string"


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def _shingles(t, n=5):
    w = _words(t)
    out = defaultdict(int)
    for k in range(max(1, len(w) - n + 1) if w else 0):
        out[tuple(w[k : k + n])] += 1
    return out


def _df(spark, rows):
    return spark.createDataFrame([(i, t, "x", None) for i, t in rows], SCHEMA).repartition(4)


def _classes(spark, rows, **how):
    got = neardup.near_classes(_df(spark, rows), **how).collect()
    assert len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    return {r.doc_id: r.class_id for r in got}


def _union(pairs, ids):
    at = {i: i for i in ids}

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        at[b] = a
    return {i: top(i) for i in ids}


def _weights(texts):
    """Weights of each text's shingles by plain counting, as the module's docstring has them."""
    bags = [_shingles(t) for t in texts]
    df = Counter(x for bag in bags for x in bag)
    n, least = sum(map(bool, bags)), max(2, -(-sum(map(len, bags)) // neardup.FREQUENT))
    rare = math.log(min(least, n) / n) if n else 0

    def idf(x):
        return 1.0 if df[x] < least or not rare else max(neardup.LEAST_IDF, min(1.0, neardup.LEAST_IDF + (1 - neardup.LEAST_IDF) * math.log(df[x] / n) / rare))

    step = lambda w: 2 ** (round(16 * math.log2(w)) / 16)
    return [{x: step((1 + math.log(tf)) * idf(x) / neardup.LEAST_IDF) for x, tf in bag.items()} for bag in bags]


def _jaccard(x, y):
    both = sum(min(w, y[k]) for k, w in x.items() if k in y)
    return both / (sum(x.values()) + sum(y.values()) - both)


def _alike(texts, least=0.8):
    own = _weights(texts)
    held = defaultdict(list)
    for i, bag in enumerate(own):
        for x in bag:
            held[x].append(i)
    met = {(i, j) for who in held.values() for i in who for j in who if i > j}
    return [p for p in met if _jaccard(own[p[0]], own[p[1]]) >= least]


def _brute(rows, least=0.8):
    return _union([(rows[i][0], rows[j][0]) for i, j in _alike([t for _, t in rows], least)], [r[0] for r in rows])


def _edited(rng, words, share):
    return [w if rng.random() > share else f"e{rng.randint(0, 9999)}" for w in words]


def test_as_by_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for g in range(25):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(30, 200))]
        rows += [(len(rows) + k, " ".join(_edited(rng, base, 0.01 * (k % 3)))) for k in range(rng.randint(1, 5))]
    rows = [(i, t) for i, (_, t) in enumerate(rows)] + [(900, None), (901, ""), (902, " \n"), (903, "two words"), (904, "two  words"), (905, "word " * 3000), (906, "word " * 3000)]
    got, want = _classes(spark, rows), _brute(rows)
    differ = [i for i in got if got[i] != want[i]]
    assert len(differ) <= 0.01 * len(rows), differ
    assert got[904] == 903 and got[906] == 905 and len({got[900], got[901], got[902]}) == 3


def _group(rng, n):
    base = [f"w{k}" for k in range(120)]
    return [(i, " ".join(base[:k] + ["edit", str(i)] + base[k + 1 :])) for i, k in ((i, rng.randint(3, 110)) for i in range(n))]


def test_a_large_group_of_near_copies_stays_together(spark):
    rng = random.Random(3)
    rows = _group(rng, 300) + [(1000 + i, " ".join(f"o{rng.randint(0, 10**6)}" for _ in range(80))) for i in range(60)]
    got = _classes(spark, rows)
    assert {got[i] for i in range(300)} == {0} and all(got[1000 + i] == 1000 + i for i in range(60))


def _family(rng, pairs, own, edits, words=300):
    """Pairs of near copies, all in the same boilerplate: a share ``own`` of a page's words is its own."""
    base = [f"w{k}" for k in range(words)]
    size, out = int(words * own), []
    for p in range(pairs):
        page = base[: words - size] + [f"p{p}x{k}" for k in range(size)]
        out += [page, [*page[: -edits], *(f"e{p}x{k}" for k in range(edits))]]
    return [(i, " ".join(page)) for i, page in enumerate(out)]


@pytest.mark.parametrize(("own", "edits"), [(0.125, 20), (0.15, 15)])
def test_near_copies_within_boilerplate(spark, own, edits):
    rows = _family(random.Random(11), 120, own, edits)
    want = _alike([t for _, t in rows])
    assert sorted(want) == [(i + 1, i) for i in range(0, 240, 2)]
    plain = lambda i, j: len(_shingles(rows[i][1]).keys() & _shingles(rows[j][1]).keys()) / len(_shingles(rows[i][1]).keys() | _shingles(rows[j][1]).keys())
    assert 0.7 < plain(0, 2) < 0.8 < plain(0, 1) < 0.92
    got = _classes(spark, rows)
    assert sum(got[i] == got[j] for i, j in want) >= 0.98 * len(want) and all(got[i] >= i - 1 for i in got)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Every pair of a bucket that is alike ends in one class, with blocks far smaller than the bucket."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng, s = random.Random(12), neardup.Settings()
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(_edited(rng, base, rng.choice([0.01, 0.02, 0.03])))) for i in range(150)]
    keyed = neardup._keyed(_df(spark, rows), "doc_id", "text")
    bands = {r.key: r.bands for r in neardup._signatures(keyed, neardup.weights(keyed, s), s).collect()}
    alike = [(i, j) for i, j in _alike([t for _, t in rows]) if any(x == y for x, y in zip(bands[i], bands[j], strict=True))]
    assert 50 < len(alike) < 0.5 * 150 * 149 / 2
    assert _classes(spark, rows) == _union(alike, [i for i, _ in rows])


def test_centre_pairs_grow_with_rows_not_with_their_square(spark):
    def pairs(n):
        rare = neardup.Weights(np.zeros(0, np.uint64), np.zeros(0), np.zeros(neardup.DF_BUCKETS, bool))
        nodes = neardup._signatures(neardup._keyed(_df(spark, _group(random.Random(4), n)), "doc_id", "text"), rare, neardup.Settings())
        return neardup.candidates(neardup.buckets(nodes.select(nodes.key.alias("node"), "size", "bands"), neardup.Settings())).count()

    few, many = pairs(800), pairs(3200)
    assert many < 6 * few  # four times the rows; all pairs would be 16 times as many
    assert many < 3200 * neardup.Settings().bands * (neardup.CENTRES + neardup.FEW)


def _enc(*texts):
    return np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])


def test_weights_and_similarities_by_definition(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["a b c d e f", "x y z x y z x y", f"u{rng.randint(0, 5)}", "q q q q q q q"]) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    own = neardup.weights(_df(spark, list(enumerate(texts))), neardup.Settings())
    want = [[_jaccard(x, y) for y in _weights(texts)] for x in _weights(texts)]
    got = neardup.block_similarities(own, 5, _enc(*texts), _enc(*texts), columns=16)
    assert np.allclose(got, want)
    assert np.allclose(neardup.similarities(own, 5, _enc(*texts[:20]), _enc(*texts[20:])), [want[i][20 + i] for i in range(20)])
    assert not neardup.block_similarities(own, 5, _enc("", " "), _enc("a b")).any()


def test_full_buckets_without_a_frequent_shingle(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FREQUENT", 2)
    own = neardup.weights(_df(spark, [(1, "a b c d e"), (2, "f g h i j"), (3, "k l m n o")]), neardup.Settings())
    assert not len(own.hashes) and not own.hot.any()
    assert list(own.levels(np.array([5, 1 << 60], np.uint64), np.array([1, 1]))) == [7, 7]


def test_words_that_sums_of_powers_confuse():
    turn = "a"
    while len(turn) < 4096:
        turn += turn.translate(str.maketrans("ab", "ba"))
    other = turn.translate(str.maketrans("ab", "ba"))
    hashes = neardup.word_hashes(_enc(turn)[0], np.array([0]), np.array([4096])), neardup.word_hashes(_enc(other)[0], np.array([0]), np.array([4096]))
    assert hashes[0] != hashes[1]


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(2)
    settings = neardup.Settings(bands=400, rows=1)
    sampler, hashes = neardup.Sampler(settings), rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    la, lb = rng.integers(0, 20, 150), rng.integers(0, 20, 150)
    one = lambda lv: sampler.bands(np.zeros(150, int), hashes, lv)[1][0]
    wa, wb = 2.0 ** (la / neardup._STEPS), 2.0 ** (lb / neardup._STEPS)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((one(la) == one(lb)).mean() - want) < 0.1


def test_repeats_null_ids_empty_table_and_stage(spark):
    t = " ".join(f"w{k}" for k in range(40))
    got = neardup.near_classes(_df(spark, [(5, t), (5, t), (None, t), (7, "other words entirely here now")])).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.kept) for r in got) == [("5", "None", False)] * 2 + [("7", "7", True), ("None", "None", True)]
    assert neardup.near_classes(_df(spark, [])).count() == 0
    docs = _df(spark, [(1, t), (2, t + " more"), (3, None)]).withColumnsRenamed({"node": "gone", "class_id": "row"})
    kept = neardup.without_near_copies(docs)
    assert kept.columns == ["doc_id", "text", "gone", "row"] and sorted(r.doc_id for r in kept.collect()) == [1, 3]


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(i, (i * 7) % 31) for i in range(31)] + [(100, 101), (101, 100)]])
def test_components(spark, links):
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    ids = {x for p in links if p[0] != p[1] for x in p}
    assert got == _union([p for p in links if p[0] != p[1]], ids)
