import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from landshift.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """(A tokens, B tokens) of a whole text as (id, bytes), by the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in visible]
    letters = {chr(x): x for x in visible} | {chr(256 + k): x for k, x in enumerate(hidden)}

    def run(text):
        if not text:
            return [], []
        left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        want = (" " + text).encode()
        return (left, right) if b"".join(x for _, x in left) == want == b"".join(x for _, x in right) else ([], [])

    return run


def _spans(tokens):
    out, at = [], 0
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def _document(left, right):
    left, right = _spans(left), _spans(right)
    links = [(i, j) for i, s, e in left for j, t, f in right if s < f and t < e] if len(left) < 400 else None
    if links is None:  # the same by two pointers
        links, x, y = [], 0, 0
        while x < len(left) and y < len(right):
            links.append((left[x][0], right[y][0]))
            e, f = left[x][2], right[y][2]
            x, y = x + (e <= f), y + (f <= e)
    common = {e for _, _, e in left} & {e for _, _, e in right}
    groups, a, b = [], [], []
    cut = sorted(common)
    low = 0
    for high in cut:
        a = [str(i) for i, s, e in left if low <= s and e <= high] if len(left) < 400 else None
        if a is None:
            break
        b = [str(i) for i, s, e in right if low <= s and e <= high]
        groups.append(",".join(a) + "|" + ",".join(b))
        low = high
    return len(left), len(right), len(cut), links, ";".join(groups) if a is not None else None


def _brute(plain, texts):
    docs = [_document(*plain(t)) for t in texts]
    count = Counter(p for *_, links, _ in docs for p in set(links))
    top = defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    return [(na, nb, ng, len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), None if s is None else hashlib.sha256(s.encode()).hexdigest() if na else "") for na, nb, ng, links, s in docs]


def _texts():
    rng = random.Random(9)
    words = ["the", "Ünïcode", "don't", "x1y22", "日本語", "\U0001f600", "foo\tbar", "a\n\n b", "\n", "  ", "antidisestablishment", " ", "é", "1234567", "<|endoftext|>", "</s>", "<0x41>", "\x1c a", "tail\t "]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    return [*made, None, "", " ", "   ", "\n", "a ", " a", "a\t", "▁mark", "x▁y", "w" * 3000, "\x00", "a\x00 b", made[0], made[0], "the the the the"]


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 8, 1])
def test_against_the_libraries(spark, plain, frequent):
    texts = _texts()
    rows = [(i, t, "clash", 5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pairs string, n_a long").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in FIELDS) for r in alignment.aligned(df, A, B, frequent=frequent).collect()}
    want = dict(enumerate(_brute(plain, texts)))
    for i in want:
        assert got[i][: 6 if want[i][6] is None else 7] == want[i][: 6 if want[i][6] is None else 7], texts[i]
    assert len(got) == len(texts) and got[texts.index(None)] == (0, 0, 0, 0, 0, 0, "")
    assert got[texts.index("▁mark")] == (0, 0, 0, 0, 0, 0, "")


def test_long_text_repeats_null_ids_and_empty_table(spark, plain):
    text = "some words and 12 more, " * 20_000
    rows = [(1, text), (1, text), (None, "abc"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r[c] for c in FIELDS[:6]) for r in alignment.aligned(df, A, B).collect())
    assert got == sorted(x[:6] for x in _brute(plain, [t for _, t in rows]))
    assert alignment.aligned(df.limit(0), A, B).count() == 0
    broken = spark.sql("SELECT 1L AS doc_id, CAST(unhex('61FF62') AS STRING) AS text")
    assert tuple(alignment.aligned(broken, A, B).first()[c] for c in FIELDS) == _brute(plain, ["a�b"])[0]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aethns rn.,'\"\n\t \x1c　▁<0x>/sé日\U0001f600\x00129")), max_size=60))
def test_units_give_the_tokens_of_whole_texts(plain_, text):
    own = alignment.aligner(A, B)
    got = own.align([text])
    na, nb, ng, links, shown = _document(*plain_(text))
    assert [got[c][0].as_py() for c in FIELDS[:4]] == [na, nb, ng, len(links)]
    assert got["groups_sha256"][0].as_py() == (hashlib.sha256(shown.encode()).hexdigest() if na else "")
    want = Counter(i * own.tokens.kinds_b + j for i, j in links)
    assert dict(zip(got["pairs"][0].as_py(), got["times"][0].as_py(), strict=True)) == want


@pytest.fixture(scope="module")
def plain_(plain):
    return plain


def test_forgetting_changes_nothing():
    small, large = alignment.Aligner(A, B, remembered=2), alignment.aligner(A, B)
    for texts in [["a b c", "d " + "e" * 100], ["a b", "x" * 70], ["y" * 80 + " z"], ["c d e f", None, ""]] * 2:
        assert {k: v.to_pylist() for k, v in small.align(texts).items()} == {k: v.to_pylist() for k, v in large.align(texts).items()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
def test_roots_are_the_least_connected_nodes(links):
    least = list(range(31))
    while True:
        after = list(least)
        for u, v in links:
            after[u] = after[v] = min(after[u], after[v])
        if after == least:
            break
        least = after
    u, v = (np.array([x[k] for x in links], np.int64) for k in (0, 1))
    assert alignment.roots(31, u, v).tolist() == least
