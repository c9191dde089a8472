import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from landshift.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def _library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aeth rn.,'\"\n\t▁<0x>/sé日\U0001f600\x00")), max_size=60))
def test_any_text_as_the_library(text):
    sp, own = _library(), pieces.codec(PATH)
    ids = own.encode(text)
    assert ids == " ".join(map(str, sp.encode(text, add_eos=True)))
    assert own.vocabulary.decode(list(map(int, ids.split()))) == sp.decode(list(map(int, ids.split()))).encode()


def test_table_against_library(spark):
    sp, rng = _library(), random.Random(5)
    rows = [(i, " ".join("".join(rng.choice("theandiorü") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 80))), None) for i in range(300)]
    rows += [(900, None, "x"), (901, "", None), (902, "a" * 50_000, None), (903, "  x  ", None), (904, "</s><s> \n\n", None), (906, "x ", None), (907, " ", None), (908, "a\n \n  b", None), (905, "w " * 200_000, None), (1, rows[1][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.encoded(df, PATH, with_ids=True).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    text = dict((r[0], r[1] or "") for r in rows)
    for r in got:
        ids = sp.encode(text[r.doc_id], add_eos=True)
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded == sp.decode(ids) == text[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert pieces.encoded(df.limit(0), PATH).count() == 0


def test_malformed_utf8_and_null_ids(spark):
    df = spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, CAST(unhex('61FF62') AS STRING) AS text")
    assert pieces.encoded(df, PATH, with_ids=True).first().decoded == "a�b"


def test_a_difference_in_any_text_fails():
    own = pieces.Codec(PATH)
    assert own.checked(["of the", ""])[2] == [b"of the", b""]
    own.words["the"] = "1"
    with pytest.raises(ValueError, match="ids differ"):
        own.checked(["fine", "of the"])
    own = pieces.Codec(PATH)
    own.vocabulary.surface[own.vocabulary.encode(pieces.MARK + "the")[0]] = b" thee"
    with pytest.raises(ValueError, match="decoded text differs"):
        own.checked(["fine", "of the"])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aethrnisod▁é日")), min_size=1, max_size=40))
def test_both_forms_of_the_agenda_merge_alike(word):
    own = pieces.codec(PATH).vocabulary
    assert own._listed(list(word)) == own._heaped(list(word))


def test_forgetting_changes_nothing():
    small, large = pieces.Codec(PATH, remembered=3), pieces.Codec(PATH)
    for text in ["a b c d e f g", "h i\nj k", "a b c"] * 3:
        assert small.encode(text) == large.encode(text)
