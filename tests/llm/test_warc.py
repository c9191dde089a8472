import gzip
import hashlib

import pytest

from landshift.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string"


def test_round_trip_with_quoted_headers_nulls_and_repeats(spark):
    long, quoted = "é" * 700, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc" * 40
    rows = [(1, "http://a/x?y", long, None), (2, "http://b/", long, None), (3, None, None, "x"), (4, "http://c/\r\nX: 1", "short", None), (5, "http://d", "short", None), (6, "http://e", quoted, None), (7, "u", "z" * 500_000, None), (8, "http://f", "", None), (9, "http://b/", long, None)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(got) == [r[0] for r in rows]
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 9) if i in (1, 2) else ("response", None))
        assert got[i].n_requests == 1


def test_repeated_and_null_ids_and_empty_table(spark):
    rows = [(1, "u", "x" * 2000, None)] * 3 + [(1, "v", "x" * 2000, None), (None, "w", "y", None), (None, "w", "y", "z")]
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [("1", "response", None)] + [("1", "revisit", 1)] * 3 + [("None", "response", None)] * 2
    assert all(r.payload_bytes == (2000 if r.page_id else 1) and r.n_requests == 1 for r in got) and len({r.capture_id for r in got}) == 6
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_archives_are_cut_by_size(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"{i} " * 2000, None) for i in range(40)], SCHEMA).repartition(1)
    warc.archive_pages(pages, str(tmp_path / "w"), file_bytes=40_000)
    assert len(list((tmp_path / "w").glob("*.gz"))) > 4
    assert warc.read_records(spark, str(tmp_path / "w")).count() == 120


def _record(kind, ident, block, *more):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", *more, f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


RECORDS = [
    _record("warcinfo", "<i>", b"software: x\r\n"),
    _record("response", "<r1>", b"HTTP/1.1 200 OK\r\n\r\nbody", "Content-Type: application/http", "WARC-Target-URI: http://a"),
    _record("request", "<q1>", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <r1>"),
    _record("metadata", "<m1>", b"a: 1\r\n", "WARC-Concurrent-To: <q1>", "Content-Type: application/warc-fields"),  # two steps
    _record("response", "<r2>", b"HTTP/1.1 200 OK\r\n\r\n", "Content-Type: application/http", "WARC-Concurrent-To: <m2>"),  # the other way round
    _record("metadata", "<m2>", b"b: 2\r\n", "Content-Type: application/warc-fields"),
    _record("request", "<q9>", b"", "WARC-Concurrent-To: <gone>"),
]


@pytest.mark.parametrize("form", ["plain", "one", "members"])
def test_reading_and_assembly(spark, tmp_path, form):
    raw = {"plain": b"".join(RECORDS), "one": gzip.compress(b"".join(RECORDS)), "members": b"".join(map(gzip.compress, RECORDS))}[form]
    (tmp_path / "a.warc").write_bytes(raw)
    records = warc.read_records(spark, str(tmp_path)).where("record_type != 'warcinfo'").cache()
    assert records.count() == len(RECORDS) - 1
    got = {r.capture_id: r for r in warc.assemble(records).collect()}
    assert set(got) == {"<r1>", "<r2>", "<gone>"}
    assert bytes(got["<r1>"].response.payload) == b"body" and len(got["<r1>"].requests) == 1 and dict(map(tuple, got["<r1>"].metadata[0].fields))["a"] == "1"
    assert got["<r2>"].metadata[0].record_id == "<m2>" and got["<r2>"].requests == []
    assert got["<gone>"].response is None and got["<gone>"].requests[0].record_id == "<q9>"


def test_damaged_archives_fail(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(RECORDS[1][:-20])
    with pytest.raises(Exception, match="cut short"):
        warc.read_records(spark, str(tmp_path)).count()


def test_every_link_however_many_steps_away(spark):
    schema = "record_type string, record_id string, concurrent_to array<string>, capture_id string"
    rows = [("response", "r1", []), ("response", "r2", []), ("resource", "r3", ["m9"]), ("request", "q", ["r1", "r2"])]
    rows += [("metadata", "m1", ["q"]), ("metadata", "m2", ["m1"]), ("metadata", "m3", ["m2", "m4"]), ("metadata", "m4", ["m3"])]  # a chain, and a circle at its end
    rows += [("metadata", "m9", []), ("metadata", "m8", ["m9"]), ("request", "lost", ["gone"]), ("metadata", "far", ["lost"]), ("request", "q", ["r1", "r2"])]
    got = warc.capture_ids(spark.createDataFrame([(*r, "x") for r in rows], schema).drop("capture_id")).collect()
    want = {(m, r) for m in ("q", "m1", "m2", "m3", "m4") for r in ("r1", "r2")} | {("m9", "r3"), ("m8", "r3")}
    assert sorted(map(tuple, got)) == sorted(want)
