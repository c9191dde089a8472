import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from landshift.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def _brute(rows, most=200, least=3):
    terms = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in terms}:
        df = Counter(t for la, _, ts in terms if la == lang for t in set(ts))
        kept = sorted((t for t in df if df[t] >= least), key=lambda t: t.encode())
        by = defaultdict(Counter)
        for la, s, ts in terms:
            if la == lang:
                by[s].update(t for t in ts if df[t] >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in by.items()}
        q = share(sum(by.values(), Counter()))
        for s in by:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in by if o != s]
            over = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if by[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(over)[:most], 1)]
    return sorted(out)


def _got(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


def _table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "clash", 5) for i, (t, lang, s) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["the", "The", "été", "ÉTÉ", "x" * 3000, "日本", "\U0001f600a", "ab", "abc", "a b", "z"] + ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", "1", "\x00"]) for _ in range(n))
    made = [(say(rng.randint(0, 40)), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", None, "c" * 40])) for _ in range(160)]
    made += [(None, "en", "only null"), ("", "en", "only empty"), ("12 34", "fr", "x"), ("rare words here", "fr", "y"), ("the " * 40_000, "en", "b")]
    return made + made[:9] + [("same same", "tie", s) for s in "pqrst"]


def test_against_brute_force(spark, rows):
    assert _got(divergence.divergences(_table(spark, rows).repartition(5))) == _brute(rows)


@pytest.mark.parametrize("audit", [divergence.Audit(chunk_terms=7, block_sources=2, most_terms=4), divergence.Audit(chunk_terms=1, block_sources=1, least_docs=1)])
def test_chunks_blocks_and_ranks_change_nothing(spark, rows, audit):
    assert _got(divergence.divergences(_table(spark, rows[-60:]), audit)) == _brute(rows[-60:], audit.most_terms, audit.least_docs)


def test_terms_with_more_sources_than_a_portion(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PORTION_ROWS", 8)
    made = [(f"same w{i % 3} q{i % 5}", "en" if i % 4 else "de", f"s{i % 30}") for i in range(150)]
    assert _got(divergence.divergences(_table(spark, made))) == _brute(made)


def test_empty_table(spark):
    assert divergence.divergences(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_counts_are_exact():
    counts = np.array([0, 10**10, 7 * 10**12, 3 * 10**13], np.int64)
    total = int(counts.sum()) + 4
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]
    p, q = np.array([10**9 + 1, 1, 5]), np.array([1, 10**9 + 1, 5])
    assert divergence.excess(p, q).tolist() == [(int(a) - int(b)) ** 2 // int(b) for a, b in zip(p, q, strict=True)]
