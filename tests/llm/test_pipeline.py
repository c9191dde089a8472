import hashlib
import random
import re

import public_tokenizers
import pytest

import corpus_pipeline
from landshift.llm import mixing

WORDS = {"en": "the and over there with some plain words here then".split(), "fr": "le et la avec pour une très déjà été où".split()}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, rows = random.Random(6), []
    for i in range(90):
        lang = "en" if i % 3 else "fr"
        rows.append((i, " ".join(rng.choice(WORDS[lang]) + (str(rng.randint(0, 99)) if k % 4 == 0 else "") for k in range(rng.randint(40, 90))), lang, ["a", "b", None][i % 3]))
    rows += [(100 + k, rows[k][1].upper() if k % 2 else rows[k][1], rows[k][2], "a") for k in range(10)]  # exact copies
    rows += [(200 + k, rows[20 + k][1] + " more words", rows[20 + k][2], "b") for k in range(8)]  # near copies
    rows += [(300, "12 34 !!", "en", "a"), (301, None, None, "a"), (302, "", "fr", None)]
    path = str(tmp_path_factory.mktemp("tables"))
    df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x") for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, row string")
    df.repartition(4).write.parquet(f"{path}/documents.parquet")
    return path, rows


def _stage(spark, tables, n):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:n]:
        docs = stage(spark, docs, tables[0])
    return docs


def test_stages_against_brute_force(spark, tables):
    rows = {i: (t, lang, s) for i, t, lang, s in tables[1]}
    after = [{r.doc_id for r in _stage(spark, tables, n).collect()} for n in (1, 2, 3)]
    lettered = {i for i, (t, _, _) in rows.items() if t and re.search(r"[^\W\d_]", t)}
    assert after[0] == lettered
    groups = {}
    for i in after[0]:
        groups.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in rows[i][0]), set()).add(i)
    assert after[1] == {max(g) for g in groups.values()}
    assert after[2] == after[1] - {200 + k for k in range(8)}


def test_columns_and_the_mix(spark, tables):
    before = _stage(spark, tables, 3)
    assert before.columns == list(corpus_pipeline.COLUMNS)
    mixed = _stage(spark, tables, 4)
    assert mixed.columns == list(corpus_pipeline.COLUMNS)
    taken = {r.doc_id: r.taken for r in mixing.taken_words(before).collect() if r.taken}
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == taken


def test_tokens_of_the_whole_run(spark, tables):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = sorted((r.doc_id, r.text) for r in _stage(spark, tables, 4).collect())
    want = sorted((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), tuple(ids)) for i, t in texts for ids in [sp.encode(t, add_eos=True)])
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in corpus_pipeline.run(spark, tables[0]).collect())
    assert got == want


def test_an_empty_table_runs_through(spark, tables, tmp_path):
    spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_long_texts_shared_and_missing_ids(spark, tmp_path):
    rng = random.Random(2)
    say = lambda n, lang="en": " ".join(rng.choice(WORDS[lang]) + str(rng.randint(0, 9999)) for _ in range(n))
    same = say(60)
    rows = [(1, say(120_000), "en", "a"), (2, say(50), "en", "a"), (2, say(50), "fr", None), (None, say(50), "en", "b"), (None, same, "en", "b"), (7, same, "en", "a"), (8, "x" * 300_000, "en", "a"), *((10 + i, say(40), "en", "a") for i in range(20))]
    spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.exact_dedup(spark, docs, str(tmp_path))
    assert kept.count() == len(rows) - 1 and sum(r.text == same for r in kept.collect()) == 1
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {r[0] for r in rows}


def test_rows_repeated_in_full_and_clean_text_beside_a_copy_of_its_id(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(WORDS["en"]) + str(rng.randint(0, 9999)) for _ in range(n))
    a, b, c = say(60), say(60), say(50)
    near = a + " more words"
    rows = [(1, a, "en", "s"), (1, a, "en", "s"), (1, a, "en", "s"), (None, b, "en", "s"), (None, b, "en", "s"), (None, b.upper(), "en", "t"), (5, near, "en", "s"), (5, c, "en", "s"), (6, None, "en", "s"), (6, None, "fr", "s")]
    docs = spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    once = corpus_pipeline.exact_dedup(spark, docs, "")
    kept = [(r.doc_id, (r.text or "").lower()) for r in once.collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (None, b), (5, near), (5, c), (6, "")], key=str)
    left = [(r.doc_id, (r.text or "").lower()) for r in corpus_pipeline.near_dedup(spark, once, "").collect()]
    # The near copy goes; the clean text of the same id stays.
    assert sorted(left, key=str) == sorted([(1, a), (None, b), (5, c), (6, "")], key=str)
