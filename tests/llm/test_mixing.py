from collections import Counter

import numpy as np
import pytest

from landshift.llm import mixing

SCHEMA = "doc_id long, text string, source string, taken string, lang string"
SMALL = mixing.Mixture(block_words=8, shard_slots=64, chunk_rows=50)


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, s, None, None) for i, t, s in rows], SCHEMA)


def _corpus():
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(rng.integers(0, 60))), ["a", "b", "c", None, "d"][min(4, i % 8)]) for i in range(600)]
    return [*rows, (900, None, "a"), (901, "", "e"), (902, "x\t y\x0b z\n", "f"), (903, "long " * 5000, "b")]


def _size(t):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_targets_by_hand():
    # 150 % of 100 words; by weight 5:2:1 the last would get 18.75 of its 10 at most 20, the first is stopped at 20.
    assert mixing.targets([10, 80, 10], [5, 2, 1], 1.5, 2) == pytest.approx([20, 2 / 3 * 130 + 0, 130 / 3][:1] + [110, 20])
    assert mixing.targets([0, 0], [5, 2], 1.5, 2) == [0, 0]
    sizes, weights = [100, 100, 100, 100], [5, 2, 1, 5]
    got = mixing.targets(sizes, weights, 1.5, 2)
    assert sum(got) == pytest.approx(600) and got[0] == got[3] == 200 and got[1] == pytest.approx(2 * got[2])


@pytest.mark.parametrize("mixture", [SMALL, mixing.Mixture()])
def test_words_taken(spark, mixture):
    rows = _corpus()
    got = {r.doc_id: r for r in mixing.taken_words(_docs(spark, rows).repartition(7), mixture).collect()}
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for i, t, s in rows:
        assert got[i].size == _size(t) and 0 <= got[i].taken <= 2 * got[i].size
        sizes[s] += got[i].size
        taken[s] += got[i].taken
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 1.5, 2)))
    for i, _, s in rows:
        assert got[i].source_size == sizes[s] and got[i].target == pytest.approx(want[s])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= mixture.block_words, s
    again = {r.doc_id: r.taken for r in mixing.taken_words(_docs(spark, rows).coalesce(2), mixture).collect()}
    assert again == {i: r.taken for i, r in got.items()}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 65, 1000])
def test_permutations(size):
    index = np.arange(size)
    a, b = (mixing.permuted(index, np.full(size, size), np.full(size, key)) for key in (1, 2))
    assert sorted(a) == sorted(b) == list(index)
    if size >= 64:
        assert list(a) != list(b) and list(a) != list(index)


M64 = (1 << 64) - 1


def _mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def _place(i, n, key):
    """The permutation by plain whole numbers."""
    half = 1
    while 1 << (2 * half) < n:
        half += 1
    mask = (1 << half) - 1
    while True:
        left, right = i >> half, i & mask
        for turn in range(4):
            left, right = right, left ^ (_mix((right + _mix((key + turn) & M64)) & M64) & mask)
        i = (left << half) | right
        if i < n:
            return i


def test_the_draw_as_by_loops(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 4)
    mixture, rows = SMALL, _corpus()
    plan = mixing.planned(_docs(spark, rows), mixture)
    placed = sorted(map(tuple, plan.placed.where("size > 0").select("source_no", "offset", "size", "doc_id").collect()))
    sources = {r.source_no: r for r in plan.sources.collect()}
    blocks, at = {}, Counter()
    for s, offset, size, doc in placed:  # streams without a gap, cut into blocks
        assert offset == at[s]
        at[s] += size
        for w in range(offset, offset + size):
            blocks.setdefault((s, w // mixture.block_words), Counter())[doc] += 1
    assert at == Counter({s: r.source_size for s, r in sources.items() if r.source_size})
    quota = np.array([sources[s].quota for s in sorted(sources)], float)
    drawn, taken = Counter(), Counter()
    for shard in range(int(quota.sum()) // mixture.shard_slots + 1):
        last = shard == int(quota.sum()) // mixture.shard_slots
        counts = quota.astype(int) if last else np.random.default_rng([mixture.seed, shard]).multinomial(mixture.shard_slots, quota / quota.sum())
        for s, n in enumerate(counts):
            for _ in range(int(min(n, quota[s] - drawn[s]))):
                turn, r = divmod(drawn[s], sources[s].blocks)
                taken += blocks[s, _place(r, sources[s].blocks, ((mixture.seed << 40) ^ (s << 8) ^ turn) & M64)]
                drawn[s] += 1
    got = {r.doc_id: r.taken for r in mixing.taken_words(_docs(spark, rows).repartition(5), mixture).collect()}
    assert {i: n for i, n in got.items() if n} == dict(taken)


def test_blocks_hold_the_taken_words(spark):
    rows = _corpus()[:200]
    docs = _docs(spark, rows)
    words = Counter(w for r in mixing.mixed_blocks(docs, SMALL).collect() for w in r.words)
    taken = {r.doc_id: r.taken for r in mixing.taken_words(docs, SMALL).collect()}
    by_doc = Counter()
    for w, n in words.items():
        by_doc[int(w[1:].split("_")[0])] += n
        assert n <= 2
    assert {i: n for i, n in taken.items() if n} == dict(by_doc)


def test_shards_follow_the_targets(spark):
    docs = _docs(spark, _corpus())
    plan = mixing.planned(docs, SMALL)
    counts = plan.slots.groupBy("shard").count().collect()
    assert {r["count"] for r in counts if r["shard"] < max(c["shard"] for c in counts)} <= set(range(1, 65)) and len(counts) > 3
    quota = {r.source_no: r.quota for r in plan.sources.collect()}
    assert {r.source_no: r["count"] for r in plan.slots.groupBy("source_no").count().collect()} == {k: v for k, v in quota.items() if v}


def test_documents_of_the_mix(spark):
    rows = _corpus()[:300]
    docs = _docs(spark, rows)
    out = mixing.mixed_documents(docs, SMALL)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += _size(r.text)
        assert r.n_chars == len(r.text)
    assert dict(got) == {r.doc_id: r.taken for r in mixing.taken_words(docs, SMALL).collect() if r.taken}


def test_repeats_null_ids_and_empty_table(spark):
    rows = [(1, "a b c", "s")] * 2 + [(None, "d e", "s"), (None, None, None)]
    got = mixing.taken_words(_docs(spark, rows)).collect()
    assert len(got) == 4 and sum(r.size for r in got) == 8 and all(r.taken <= 2 * r.size for r in got)
    assert mixing.taken_words(_docs(spark, [])).count() == 0
    assert mixing.mixed_documents(_docs(spark, [])).count() == 0


def test_a_mix_of_less_than_a_shard_is_drawn_too(spark):
    rows = [(i, "word " * 64, "ab"[i % 2]) for i in range(60)]
    plan = mixing.planned(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = {(r.shard, r.source_no): r["count"] for r in plan.slots.groupBy("shard", "source_no").count().collect()}
    quotas = {r.source_no: r.quota for r in plan.sources.collect()}
    assert sum(n for (shard, _), n in got.items() if shard == 0) >= 0.8 * sum(quotas.values())
    assert {s: sum(n for (_, k), n in got.items() if k == s) for s in quotas} == quotas
