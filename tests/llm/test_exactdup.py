import pytest
from pyspark.sql import functions as F

from landshift.llm import exactdup

SCHEMA = "doc_id long, text string, keep_id string"


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _brute(rows):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(lower(t), []).append(i)
    return sorted((i, max(groups[lower(t)]), len(groups[lower(t)]), i == max(groups[lower(t)])) for i, t, _ in rows)


ROWS = [(1, "Same TEXT", "x"), (2, "same text", None), (3, "same text ", None), (4, None, None), (5, "", None), (6, "É", None), (7, "é", None), (8, "x" * 300_000, None), (9, "X" * 300_000, None)]


def test_groups_and_clashing_columns(spark):
    got = exactdup.exact_groups(_rows(spark, ROWS)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == _brute(ROWS)
    import hashlib

    assert {r.doc_id: r.text_sha256 for r in got}[2] == hashlib.sha256(b"same text").hexdigest()


def test_a_digest_that_texts_share_merges_nothing(spark):
    weak = lambda content: F.encode((F.length(content) % 2).cast("string"), "UTF-8")
    got = exactdup.exact_groups(_rows(spark, ROWS).repartition(5), digest=weak).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == _brute(ROWS)


@pytest.mark.parametrize("salts", [1, 7])
def test_hot_group_over_many_partitions(spark, salts):
    rows = [(i, "hot" if i % 3 else f"t{i}", None) for i in range(600)]
    got = exactdup.exact_groups(_rows(spark, rows).repartition(16), salts=salts).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == _brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    got = exactdup.exact_groups(_rows(spark, [(1, "a", None), (1, "a", None), (None, "b", None)])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == [("1", "1", 2, True)] * 2 + [("None", "None", 1, True)]
    assert exactdup.exact_groups(_rows(spark, [])).count() == 0


def test_rows_that_stay_keep_their_columns(spark):
    got = exactdup.without_copies(_rows(spark, ROWS))
    assert got.columns == ["doc_id", "text", "keep_id"]
    assert sorted(r.doc_id for r in got.collect()) == [2, 3, 5, 6, 7, 9]


def test_no_python_runs(spark):
    plan = exactdup.exact_groups(_rows(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
