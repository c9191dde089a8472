"""Substring deduplication by relative Lempel-Ziv parsing against indexed reference blocks.

A window is ``window`` consecutive words of one document. Every document is cut into blocks: runs of windows
that share their anchor, the n-gram with the smallest hash inside the window. Cuts depend on the words alone,
so a repeated passage is cut alike wherever it stands, and each window lies in exactly one block. All blocks
of all documents are the reference, indexed by anchor:

1. anchors that occur once are dropped; their windows cannot repeat;
2. a block whose words stand earlier as a block is a copy: one factor, with its reference;
3. at the ends of factors a passage meets other words, so blocks differ while windows may still agree: the
   first occurrences of blocks that share an anchor are compared window by window.

Copies that continue each other are merged greedily into factors, which are at least one window long; words
under factors are removed. "Earlier" is a smaller id, or the same document and an earlier start.

Keys are 128 bits of hash (anchor and content). Groups are counted or reduced to their first occurrence on
the map side before any shuffle. On the way back, keys that hold at least one ``HOT_KEYS``-th of all rows -- so
there are at most that many -- are broadcast and their rows stay where they are; the others are joined by key.

Defined results: a null text has no words; rows that share an id are one document; a null id sorts before
all others; texts shorter than a window lose nothing; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.sources.shared import written
from landshift.llm.texts import gram_hashes, in_arrow, mix, powers, slices, word_bounds, word_hashes

WINDOW = 20
ANCHOR = 6
HOT_KEYS = 4096
_Q = np.uint64(0xD6E8FEB86659FD93)
_Q_BACK = np.uint64(pow(int(_Q), -1, 1 << 64))
_PLACE = np.uint64((1 << 24) - 1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have, span = values, 1
    while 2 * span <= width:
        have, span = np.minimum(have[:-span], have[span:]), 2 * span
    rest = width - span
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def cut(words: np.ndarray, doc: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Blocks of concatenated documents: index of the first window, number of windows, anchor and content hash."""
    if len(words) < window:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    grams = gram_hashes(words, anchor)
    at = np.arange(len(grams), dtype=np.uint64) & _PLACE
    least = _least((grams & ~_PLACE) | at, window - anchor + 1)  # leftmost of equals
    start = np.arange(len(least), dtype=np.int64)
    place = start + (((least & _PLACE).astype(np.int64) - start) & np.int64(_PLACE))
    inside = doc[: len(least)] == doc[window - 1 :]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    ends = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
    n = ends - first + 1
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(_Q, len(words)))])
    content = (upto[first + n + window - 1] - upto[first]) * powers(_Q_BACK, len(words))[first]
    return first, n, mix(grams[place[first]]), mix(content + n.astype(np.uint64))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, firsts = word_bounds(data, offsets)
    return word_hashes(data, starts, ends), np.repeat(np.arange(len(offsets) - 1), np.diff(firsts)), firsts


def _anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, n): how often each anchor occurs, by Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in slices(batch, "text"):
                words, doc, _ = _words(data, offsets)
                key, n = np.unique(cut(words, doc, window, anchor)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    return in_arrow(docs.select("text"), run, "anchor long, n long")


def _blocks(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, content, key, at, n): every block, its document, first window and number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                words, doc, firsts = _words(data, offsets)
                first, n, a, c = cut(words, doc, window, anchor)
                d = doc[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), rows.column(0).take(pa.array(d)), pa.array((first - firsts[d]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["anchor", "content", "key", "at", "n"]
                )

    return in_arrow(docs.select("key", "text"), run, "anchor long, content long, key long, at int, n int")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, content, key, at) of each window in the blocks that column ``ask`` lists for a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                words, _, firsts = _words(data, offsets)
                hashes = gram_hashes(words, window)
                ask = rows.column(2)
                flat, upto = ask.flatten(), np.concatenate([[0], np.cumsum([len(x) for x in ask])])
                row = np.repeat(np.arange(rows.num_rows), np.diff(upto))
                at, n, anchor = (flat.field(i).to_numpy() for i in range(3))
                each = np.repeat(np.arange(len(at)), n)
                start = at[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                content = hashes[firsts[row[each]] + start]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[each]), pa.array(content.view(np.int64)), rows.column(0).take(pa.array(row[each])), pa.array(start.astype(np.int32))], names=["anchor", "content", "key", "at"])

    return in_arrow(docs.select("key", "text", "ask"), run, "anchor long, content long, key long, at int")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key is never null, so both joins by it plan the same exchange of texts, which Spark then reuses."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    return docs.select(key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _repeats(rows: DataFrame, firsts: DataFrame, n) -> DataFrame:
    """Rows (anchor, content, key, at, n) whose key has an earlier row; ``firsts``: a written table (anchor, content, ref, times)."""
    total = firsts.agg(F.sum("times")).first()[0] or 0
    least = max(2, -(-total // HOT_KEYS))
    again = firsts.where("times > 1").select("anchor", "content", "ref", (F.col("times") >= least).alias("hot"))
    hot = F.broadcast(again.where("hot").select("anchor", "content", F.col("ref").alias("hot_ref")))
    seen = rows.join(hot, ["anchor", "content"], "left")
    near = seen.where("hot_ref IS NOT NULL").select("key", "at", n.alias("n"), F.col("hot_ref").alias("ref"))
    far = seen.where("hot_ref IS NULL").drop("hot_ref").join(again.where("NOT hot").drop("hot"), ["anchor", "content"]).select("key", "at", n.alias("n"), "ref")
    out = near.unionByName(far).where("key != ref.key OR at != ref.at")
    return out.select("key", "at", "n", F.col("ref.key").alias("ref_key"), F.col("ref.at").alias("ref_at"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(key, at, n, ref_key, ref_at): n consecutive windows from ``at`` that stand earlier, at the reference."""
    base = _keyed(docs, id_col, text_col)
    # Written, so that the join below has an exchange on both sides and AQE may split an anchor with many blocks.
    shared = written(_anchors(base, window, anchor).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "rlz-anchors")
    blocks = written(_blocks(base, window, anchor).join(shared, "anchor", "left_semi"), "rlz-blocks")
    place = F.struct("key", "at")
    firsts = written(blocks.groupBy("anchor", "content").agg(F.min(place).alias("ref"), F.first("n").alias("n"), F.count("*").alias("times")), "rlz-firsts")
    whole = _repeats(blocks, firsts, F.col("n"))
    meet = firsts.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    edge = firsts.join(meet, "anchor", "left_semi").select(F.col("ref.key").alias("key"), F.struct(F.col("ref.at").alias("at"), "n", "anchor").alias("part"))
    asked = edge.groupBy("key").agg(F.collect_list("part").alias("ask"))
    single = written(_windows(base.join(asked, "key"), window), "rlz-edges")
    lead = written(single.groupBy("anchor", "content").agg(F.min(place).alias("ref"), F.count("*").alias("times")).where("times > 1"), "rlz-leads")
    part = _repeats(single, lead, F.lit(1))
    return whole.unionByName(part)


def merged(at: np.ndarray, n: np.ndarray, ref: np.ndarray, ref_at: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, words, ref_key, ref_start) of one document from its copied runs of windows."""
    out: list[list[int]] = []
    for i in np.lexsort((-n, at)):
        a, k, r, s = int(at[i]), int(n[i]), int(ref[i]), int(ref_at[i])
        if out and out[-1][2] == r and out[-1][3] - out[-1][0] == s - a and a <= out[-1][0] + out[-1][1] - window + 1:
            out[-1][1] = max(out[-1][1], a + k - 1 + window - out[-1][0])
        else:
            out.append([a, k - 1 + window, r, s])
    return [tuple(f) for f in out]


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per document with a copy: key and its factors, array<struct<start,words,ref_key,ref_start>>."""
    runs = copies(docs, id_col, text_col, window, anchor)
    grouped = runs.groupBy("key").agg(F.collect_list(F.struct("at", "n", "ref_key", "ref_at")).alias("runs"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("ref_key", pa.int64()), ("ref_start", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column(1):
                at, n, ref, ref_at = (x.values.field(i).to_numpy() for i in range(4))
                found.append([dict(zip(("start", "words", "ref_key", "ref_start"), f, strict=True)) for f in merged(at, n, ref, ref_at, window)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["key", "factors"])

    return in_arrow(grouped, run, "key long, factors array<struct<start:long,words:long,ref_key:long,ref_start:long>>")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text."""
    base = _keyed(docs.select(id_col, text_col), id_col, text_col)
    rows = base.join(factors(docs, id_col, text_col, window, anchor), "key", "left")
    schema = "key long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                starts, ends, firsts = word_bounds(data, offsets)
                gone = np.zeros(len(starts) + 1, np.int64)
                spans = part.column(2)
                for i, x in enumerate(spans):
                    if x.is_valid:
                        begin, size = (x.values.field(k).to_numpy() for k in (0, 1))
                        np.add.at(gone, firsts[i] + begin, 1)
                        np.add.at(gone, firsts[i] + begin + size, -1)
                keep = np.cumsum(gone[:-1]) == 0
                raw, texts = data.tobytes(), []
                for i in range(part.num_rows):
                    k = np.flatnonzero(keep[firsts[i] : firsts[i + 1]]) + firsts[i]
                    texts.append(b" ".join([raw[a:b] for a, b in zip(starts[k].tolist(), ends[k].tolist(), strict=True)]))
                total = np.concatenate([[0], np.cumsum(keep)])
                n = np.diff(firsts)
                columns = [part.column(0), pa.array(n), pa.array(n - (total[firsts[1:]] - total[firsts[:-1]])), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                if with_text:
                    columns.append(pa.array([t.decode("utf-8", "replace") for t in texts]))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n_words", "n_removed", "kept_sha256", "kept"][: len(columns)])

    out = in_arrow(rows.select("key", "text", "factors"), run, schema)
    return out.select(F.nullif("key", F.lit(-(1 << 63)).cast("long")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else []))
