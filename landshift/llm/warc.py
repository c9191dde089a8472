"""WARC archives: write records, read archives back, and assemble transactions.

``archive_pages`` writes a response (or revisit), a request and a metadata record per page with Spark's own
text writer -- one gzip stream per file, committed like any table -- so archives reach every store Spark
reaches. ``read_records`` reads WARC files (plain, one gzip stream, or a gzip member per record), framing by
Content-Length alone, so payloads may quote WARC headers. ``assemble`` joins request, response and metadata
records through WARC-Concurrent-To, however many steps away and to every capture they reach, and returns one
nested row per capture.

Archives are cut after so many records as make ``FILE_BYTES`` at the mean size of a page; a file is read by one
task, so files of others may have 2 GB at most.

Defined results: a null html is an empty payload; a null url has no target; each row of ``pages`` is a record
and a row, also if it repeats another in full (of those with the largest id, one is the response); records
that reach no capture form captures without response, named by what they are concurrent to, else by themselves;
an empty table gives no archive and no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landshift.sources.shared import new_path, written
from landshift.llm.texts import in_arrow

REVISIT_FROM = 1000
FILE_BYTES, MOST_PAGES = 32 << 20, 3000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = ("response", "revisit", "resource")

RECORD = "record_type string, record_id string, target_uri string, warc_date string, concurrent_to array<string>, refers_to string, content_type string, fields map<string,string>, payload_bytes bigint, payload_digest string"
_ARROW = {
    "record_type": pa.string(), "record_id": pa.string(), "target_uri": pa.string(), "warc_date": pa.string(), "concurrent_to": pa.list_(pa.string()), "refers_to": pa.string(),
    "content_type": pa.string(), "fields": pa.map_(pa.string(), pa.string()), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(),
}


def _urn(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}\n"), key))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _keyed(pages: DataFrame) -> DataFrame:
    """Pages with payload, digests, and ``rid``, the id that a row's record has unless another row is the same."""
    rows = pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("sha256"), F.length("payload").alias("size"))
    key = F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.coalesce("url", F.lit("")), "sha256")
    return rows.withColumn("key", key).withColumn("rid", _urn("response", F.col("key")))


def page_records(pages: DataFrame, known: DataFrame, revisit_from: int = REVISIT_FROM, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One row per page with its payload, record ids, and -- for revisits -- the response it refers to.

    ``known``: a written table (sha256, rid, page_id, url, size, n) of the rows of ``_keyed``.
    """
    rows = _keyed(pages)
    same = known.where(F.col("size") >= revisit_from).groupBy("sha256").agg(F.max(F.struct("page_id", "rid", "url")).alias("top"), F.sum("n").alias("n")).where("n > 1").drop("n")
    # Written first, so that Spark knows its size: payloads are shuffled only if repeats are too many to broadcast.
    same = written(same, "warc-repeats")
    rows = rows.join(same, (rows.sha256 == same.sha256) & (rows["size"] >= revisit_from), "left").drop(same.sha256)
    double = known.where("n > 1").select("rid")
    if not double.isEmpty():
        # Rows that are the same in all: the first keeps the id, the others get one each.
        again = rows.join(double, "rid", "left_semi").withColumn("turn", F.row_number().over(Window.partitionBy("rid").orderBy("size")))
        later = F.when(F.col("turn") > 1, F.concat("key", F.lit("\n"), F.col("turn").cast("string"))).otherwise(F.col("key"))
        again = again.withColumn("key", later).withColumn("rid", _urn("response", F.col("key"))).drop("turn")
        rows = rows.join(double, "rid", "left_anti").unionByName(again)
    other = F.col("top").isNotNull() & (F.col("top.rid") != F.col("rid"))
    return rows.select("page_id", "url", "payload", F.sha1("payload").alias("sha1"), "size", "key", "rid", F.when(other, F.col("top")).alias("refers"), F.lit(date).alias("date"))


def _record(head: list[tuple[str, Column]], block: Column) -> Column:
    lines = F.concat_ws("\r\n", F.lit("WARC/1.1"), *[F.concat(F.lit(f"{name}: "), value) for name, value in head], F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(lines, F.lit("\r\n\r\n"), block)


def archive_pages(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM, file_bytes: int = FILE_BYTES) -> str:
    """Write the archives of ``pages`` to the folder ``path`` and return it."""
    known = written(_keyed(pages).groupBy("sha256", "rid", "page_id", "url", "size").agg(F.count("*").alias("n")), "warc-keys")
    rows = page_records(pages, known, revisit_from)
    mean = known.agg(F.sum(F.col("size") * F.col("n")) / F.sum("n")).first()[0] or 0
    per_file = 3 * max(1, min(MOST_PAGES, int(file_bytes // (mean + 1500))))
    revisit, rid, date = F.col("refers").isNotNull(), F.col("rid"), F.col("date")
    base = lambda kind, ident: [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", date), ("WARC-Target-URI", F.col("url"))]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1")))
    kind_http = ("Content-Type", F.lit("application/http; msgtype=response"))
    full = _record([*base(F.lit("response"), rid), digest, kind_http], F.concat(http, F.col("payload").cast("string")))
    again = _record([*base(F.lit("revisit"), rid), digest, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", F.col("refers.rid")), ("WARC-Refers-To-Target-URI", F.col("refers.url")), kind_http], http)
    asked = F.concat(F.lit("GET "), F.coalesce(F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^\x20]*)", 1), F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(F.regexp_extract("url", r"^[a-z]+://([^/]*)", 1), F.lit("")), F.lit("\r\n\r\n"))
    request = _record([*base(F.lit("request"), _urn("request", F.col("key"))), ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/http; msgtype=request"))], asked)
    note = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record([*base(F.lit("metadata"), _urn("metadata", F.col("key"))), ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/warc-fields"))], note)
    lines = rows.select(F.explode(F.array(F.when(revisit, again).otherwise(full), request, metadata)).alias("value"))
    # Every record ends with two line breaks, which is what this separator writes after each row.
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    return path


def _inflated(content: memoryview, step: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of a file, decompressed member by member if it is gzip."""
    if bytes(content[:2]) != b"\x1f\x8b":
        for at in range(0, len(content), step):
            yield bytes(content[at : at + step])
        return
    at, member, pending = 0, zlib.decompressobj(31), b""
    while at < len(content) or pending:
        if not pending:
            pending, at = bytes(content[at : at + step]), at + step
        if member.eof:
            pending = pending.lstrip(b"\0")  # padding between members
            if not pending:
                continue
            member = zlib.decompressobj(31)
        yield member.decompress(pending, 4 * step)
        pending = member.unused_data if member.eof else member.unconsumed_tail
    if not member.eof:
        raise ValueError("a gzip member is cut short")


def parsed_records(content: memoryview) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(header fields, block) of each record; framing is by Content-Length."""
    chunks, have = _inflated(content), bytearray()

    def more() -> bool:
        for chunk in chunks:
            if chunk:
                have.extend(chunk)
                return True
        return False

    while True:
        while have[:1] in (b"\r", b"\n") or not have:
            if have:
                del have[: len(have) - len(have.lstrip(b"\r\n"))]
            if not have and not more():
                return
        while (end := have.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("a record's header is cut short")
        version, *lines = bytes(have[:end]).decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields: list[tuple[str, str]] = []
        for line in lines:
            if line[:1] in (" ", "\t") and fields:
                fields[-1] = (fields[-1][0], fields[-1][1] + " " + line.strip())
            else:
                name, _, value = line.partition(":")
                fields.append((name.strip(), value.strip()))
        size = int(next(v for k, v in fields if k.lower() == "content-length"))
        while len(have) < end + 4 + size:
            if not more():
                raise ValueError("a record's block is cut short")
        yield fields, bytes(have[end + 4 : end + 4 + size])
        del have[: end + 4 + size]


def _payload(kind: str, content_type: str, block: bytes) -> bytes:
    if "application/http" in content_type.lower():
        return block.partition(b"\r\n\r\n")[2]
    return block


def read_records(spark: SparkSession, path: str, with_payload: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per record of all archives under ``path``; digest and size are those of the payload as read.

    For revisits, whose block has no payload, size is null and the digest is the one the record states.
    Small fields of metadata blocks are added to ``fields``. A file is read by one task, in bounded batches.
    """
    schema = RECORD + (", payload binary" if with_payload else "")
    names = [n for n in _ARROW if with_payload or n != "payload"]
    arrow = pa.schema([(n, _ARROW[n]) for n in names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list] = {n: [] for n in names}
        held = 0

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(rows[n], _ARROW[n]) for n in names], schema=arrow)
            for n in names:
                rows[n].clear()
            return out

        for batch in batches:
            for content in batch.column(0):
                for fields, block in parsed_records(memoryview(content.as_buffer())):
                    low = {k.lower(): v for k, v in fields}
                    kind, ctype = low.get("warc-type", ""), low.get("content-type", "")
                    payload = _payload(kind, ctype, block)
                    extra = [tuple(x.strip() for x in line.split(":", 1)) for line in block.decode("utf-8", "replace").splitlines() if ":" in line] if kind == "metadata" and "warc-fields" in ctype else []
                    row = {
                        "record_type": kind, "record_id": low.get("warc-record-id"), "target_uri": low.get("warc-target-uri"), "warc_date": low.get("warc-date"),
                        "concurrent_to": [v for k, v in fields if k.lower() == "warc-concurrent-to"], "refers_to": low.get("warc-refers-to"), "content_type": ctype or None,
                        "fields": list({**low, **dict(extra)}.items()), "payload_bytes": None if kind == "revisit" else len(payload),
                        "payload_digest": low.get("warc-payload-digest", "").removeprefix("sha1:") or None if kind == "revisit" else hashlib.sha1(payload).hexdigest(), "payload": payload,
                    }
                    for n in names:
                        rows[n].append(row[n])
                    held += 2000 + len(payload)
                    if held >= batch_bytes:
                        yield flushed()
                        held = 0
        yield flushed()

    return in_arrow(spark.read.format("binaryFile").load(path).select("content"), read, schema)


def capture_ids(records: DataFrame) -> DataFrame:
    """(record_id, capture_id): each request and metadata record with every capture it reaches.

    A record reaches what it is concurrent to, what names it as concurrent, and what those requests and
    metadata records reach; each round follows the links found last by one step more, until none is new.
    """
    anchor = F.col("record_type").isin(*CAPTURES)
    anchors = records.where(anchor).select(F.col("record_id").alias("capture_id"))
    edges = records.where(~anchor).select("record_id", F.explode("concurrent_to").alias("target")).distinct()
    back = records.where(anchor).select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("record_id"))
    direct = edges.join(anchors, edges.target == anchors.capture_id, "left")
    direct = written(direct.select("record_id", "target", "capture_id"), "warc-links")
    found = direct.where("capture_id IS NOT NULL").select("record_id", "capture_id").unionByName(back.select("record_id", "capture_id")).distinct()
    steps = direct.where("capture_id IS NULL").select("record_id", "target")
    if steps.isEmpty():
        return found
    found = last = written(found, "warc-reached")
    while True:
        new = steps.join(last.select(F.col("record_id").alias("target"), "capture_id"), "target").select("record_id", "capture_id").distinct()
        new = written(new.join(found, ["record_id", "capture_id"], "left_anti"), "warc-reached")
        if new.isEmpty():
            return found
        found, last = written(found.unionByName(new), "warc-reached"), new


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response (or revisit or resource), requests, metadata.

    Give it records read back from a table (``shared.written``), as it reads them several times.
    """
    anchor = F.col("record_type").isin(*CAPTURES)
    found = capture_ids(records)
    body = F.struct(*[F.col(c) for c in records.columns if c != "fields"], F.sort_array(F.map_entries("fields")).alias("fields"))
    heads = records.where(anchor).select(F.col("record_id").alias("capture_id"), F.col("record_type").alias("kind"), body.alias("body"))
    parts = records.where(~anchor).join(found, "record_id", "left")
    own = F.coalesce("capture_id", F.try_element_at("concurrent_to", F.lit(1)), "record_id")
    parts = parts.select(own.alias("capture_id"), F.col("record_type").alias("kind"), body.alias("body"))
    of = lambda kind: F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("body"))))
    return heads.unionByName(parts).groupBy("capture_id").agg(F.max(F.when(F.col("kind").isin(*CAPTURES), F.col("body"))).alias("response"), of("request").alias("requests"), of("metadata").alias("metadata"))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Archive ``pages``, read the archives back, assemble captures, and resolve revisits; one row per page.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, n_requests, capture_id.
    """
    spark = pages.sparkSession
    path = archive_pages(pages, path or new_path(spark, "warc"))
    captures = assemble(written(read_records(spark, path, with_payload=False), "warc-records"))
    stated = F.element_at(F.map_from_entries(F.element_at("metadata", 1)["fields"]), "pageId")
    flat = captures.select(
        "capture_id", F.nullif(stated, F.lit("")).cast("long").alias("page_id"), F.col("response.payload_bytes"), F.col("response.payload_digest"), F.col("response.record_type"), F.col("response.refers_to").alias("refers_id"), F.col("response.target_uri"), F.size("requests").alias("n_requests")
    )
    flat = written(flat, "warc-captures")
    whole = flat.where("record_type = 'response'").select(F.col("capture_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"))
    # Responses refer to nothing; they stay out of the join, where their nulls would meet in one task.
    again = flat.where("record_type = 'revisit'").join(whole, "refers_id", "left")
    own = flat.where("record_type != 'revisit'").withColumns({"refers_to": F.lit(None).cast("long"), "full_bytes": F.col("payload_bytes")})
    out = again.unionByName(own)
    return out.select("page_id", F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "target_uri", F.col("n_requests").cast("long").alias("n_requests"), "capture_id")
