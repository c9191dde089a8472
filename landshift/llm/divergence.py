"""Audit of how far the sources of a language diverge in their terms, in exact arithmetic.

1. Each text slice gives its counts: (lang, source, term, occurrences, documents); Spark adds them up.
2. The counts are laid out by range of (lang, term), so the rows of a term lie together. Terms in at least
   ``least_docs`` documents of their language are kept and cut into chunks: a chunk is the sorted array of its kept
   terms, and a term's id is its place there, found with ``searchsorted``. Chunks are ranges and ids places in
   them, so (chunk, id) follows the UTF-8 order of the terms and a tie is broken by comparing ids.
3. Sources of a language are dealt into blocks. A task takes a chunk and two blocks, lays the counts of each source
   out as a dense vector of the chunk (``bincount``), turns them into shares and compares each source of one block
   with each of the other. Divergences are added up over chunks; of the terms, each chunk passes its first
   ``most_terms`` of each source on to the final ranking.

No task holds more than a chunk of terms for two blocks of sources, whatever a language, a source or a term holds;
rows that say the same were added up before. Sums are whole numbers: shares are at most 10^9 + 1, so a square fits in
64 bits, and the sum of a pair is below the square of the sum of shares.

Defined results: null text, lang and source are empty strings; a repeated row counts again; a group whose documents
hold no term is compared like any other; a language without kept terms has pairs of value 0 and no terms; ties in value
go by item in UTF-8 order; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from landshift.llm.texts import in_arrow, slices
from landshift.sources.shared import written

#: Bytes of terms: A-Z, a-z and all of other scripts; A-Z are lower-cased.
_TERM = np.zeros(256, bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

SLICE_BYTES = 4 << 20
UNIT = 1_000_000_000
#: Rows of counts that are encoded at a time; more only where a single term has more sources.
PORTION_ROWS = 100_000


@dataclasses.dataclass(frozen=True)
class Audit:
    least_docs: int = 3
    most_terms: int = 200
    chunk_terms: int = 4096
    block_sources: int = 32


def term_counts(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, term code, group, occurrences, documents) of texts in one slice, ``group`` being a number of each text."""
    inside = _TERM[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begin[first] = inside[first]
    compact = _LOWER[data[inside]]
    at = np.append(np.flatnonzero(begin[inside]), len(compact)).astype(np.int32)
    none = np.zeros(0, np.int64)
    if len(at) == 1:
        return pa.array([], pa.string()), none, none, none, none
    found = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(compact)).dictionary_encode()
    codes, kinds = found.indices.to_numpy().astype(np.int64), len(found.dictionary)
    doc = np.searchsorted(offsets, np.flatnonzero(begin), "right") - 1
    pairs, times = np.unique(doc * kinds + codes, return_counts=True)
    key = group[pairs // kinds] * kinds + pairs % kinds
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    run = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    docs = np.diff(np.append(run, len(key)))
    return found.dictionary, key[run] % kinds, key[run] // kinds, np.add.reduceat(times, run), docs


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in slices(batch, "text", SLICE_BYTES):
            lang, source = (rows.column(rows.schema.get_field_index(c)).dictionary_encode() for c in ("lang", "source"))
            both = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            named, group = np.unique(both, return_inverse=True)
            langs, sources = lang.dictionary.take(pa.array(named // len(source.dictionary))), source.dictionary.take(pa.array(named % len(source.dictionary)))
            terms, code, of, n, docs = term_counts(data, offsets, group)
            none = np.zeros(len(named), np.int64)
            of = pa.array(np.append(of, np.arange(len(named))))
            held = pa.concat_arrays([terms.take(pa.array(code)), pa.nulls(len(named), pa.string())])
            yield pa.RecordBatch.from_arrays([langs.take(of), sources.take(of), held, pa.array(np.append(n, none)), pa.array(np.append(docs, none))], names=["lang", "source", "term", "n", "docs"])


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs), and a row without a term for each group that occurs."""
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    found = in_arrow(plain, _counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


_ENCODED = "lang string, chunk long, source string, ids array<int>, counts array<long>, terms array<string>"


def _lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _encoded(audit: Audit):
    """Rows of counts in the order of (lang, term) as chunks: a row with the kept terms and the counts of the language
    (source null), and a row with ids and counts for each source that has any."""

    def portion(table: pa.Table, lang: str, terms: np.ndarray, run: np.ndarray, docs: np.ndarray, numbers: Iterator[int]) -> Iterator[pa.RecordBatch]:
        keep = np.add.reduceat(docs, run) >= audit.least_docs
        kept = terms[run[keep]]
        source = table.column("source").combine_chunks().dictionary_encode()
        of, n = source.indices.to_numpy(), table.column("n").to_numpy()
        place = np.searchsorted(kept, terms)
        known = place < len(kept)
        known[known] = kept[place[known]] == terms[known]
        for low in range(0, len(kept), audit.chunk_terms):
            own = kept[low : low + audit.chunk_terms]
            rows = np.flatnonzero(known & (place >= low) & (place < low + len(own)))
            rows = rows[np.argsort(of[rows], kind="stable")]  # ids stay ascending in each source
            ids, each = (place[rows] - low).astype(np.int32), n[rows]
            begin = np.flatnonzero(np.append(True, of[rows][1:] != of[rows][:-1]))
            names = source.dictionary.take(pa.array(of[rows[begin]]))
            whole = np.bincount(ids, weights=each, minlength=len(own)).astype(np.int64)  # whole numbers below 2^53
            size = len(names) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * size, pa.string()),
                    pa.array(np.full(size, next(numbers))),
                    pa.concat_arrays([pa.nulls(1, pa.string()), names]),
                    _lists(pa.array(ids), np.concatenate([[0, 0], begin[1:], [len(ids)]])),
                    _lists(pa.array(np.append(whole, each)), len(own) + np.concatenate([[-len(own), 0], begin[1:], [len(ids)]])),
                    _lists(pa.array(own, pa.string()), np.array([0] + [len(own)] * size)),
                ],
                names=["lang", "chunk", "source", "ids", "counts", "terms"],
            )

    def finished(table: pa.Table, last: bool, numbers: Iterator[int]) -> Iterator[pa.RecordBatch | pa.Table]:
        """Batches of whole terms, then the rows of the last term unless there is no more to come."""
        table = table.combine_chunks()
        lang, term = table.column("lang").combine_chunks(), table.column("term").combine_chunks()
        n = len(table)
        new = np.ones(n, bool)
        new_lang = np.ones(n, bool)
        if n > 1:
            new_lang[1:] = pc.not_equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)
            new[1:] = pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False) | new_lang[1:]
        runs = np.flatnonzero(new)
        end = n if last else int(runs[-1])
        starts = [int(x) for x in np.flatnonzero(new_lang) if x < end]
        for low, high in zip(starts, [*starts[1:], end], strict=True):
            terms = np.empty(high - low, object)
            terms[:] = term.slice(low, high - low).cast(pa.binary()).to_pylist()
            own = runs[(runs >= low) & (runs < high)] - low
            part = table.slice(low, high - low)
            yield from portion(part, lang[low].as_py(), terms, own, part.column("docs").to_numpy(), numbers)
        yield table.slice(end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        numbers = iter(range(first, first + (1 << 32)))
        held: list[pa.RecordBatch] = []
        size, wait = 0, PORTION_ROWS
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= wait:
                *out, rest = finished(pa.Table.from_batches(held), False, numbers)
                yield from out
                held, size = rest.to_batches(), len(rest)
                wait = max(PORTION_ROWS, 2 * size)  # one term has them all: wait for as many again
        if size:
            *out, _ = finished(pa.Table.from_batches(held), True, numbers)
            yield from out

    return run


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), exactly: a long division by thousands where the product would not fit."""
    above = counts.astype(np.int64) + 1
    if not len(above) or int(above.max()) < (1 << 63) // UNIT:
        return 1 + (above * UNIT) // total
    whole, rest = np.divmod(above, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return 1 + whole


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    apart = p - q
    return (apart * apart) // q


_FOUND = "lang string, source string, part string, item string, value long"


def _compared(audit: Audit):
    def run(task: pa.Table, vectors: pa.Table) -> pa.Table:
        if not len(task):  # the other block holds no source
            return pa.table([pa.array([], kind) for kind in (*[pa.string()] * 4, pa.int64())], names=["lang", "source", "part", "item", "value"])
        head = task.to_pylist()[0]
        width, vocabulary = head["width"], head["v"]
        rows = {s: (i.values.to_numpy(zero_copy_only=False), c.values.to_numpy(zero_copy_only=False)) for s, i, c in zip(vectors.column("source").to_pylist(), vectors.column("ids"), vectors.column("counts"), strict=True)}

        def dense(members: list[dict]) -> tuple[list[str], np.ndarray, np.ndarray]:
            names = [m["source"] for m in members]
            held = np.zeros((len(names), width), np.int64)
            for k, name in enumerate(names):
                if name in rows:
                    ids, n = rows[name]
                    held[k] = np.bincount(ids, weights=n, minlength=width)
            return names, held, np.array([shares(held[k], m["n"] + vocabulary) for k, m in enumerate(members)]).reshape(len(names), width)

        names, held, own = dense(head["left"])
        out: list[tuple[str, str, str, int]] = []
        same = head["i"] == head["j"]
        others, theirs = (names, own) if same else dense(head["right"])[::2]
        for a, p in zip(names, own, strict=True):
            out += [(a, "pair", b, int(v)) for b, v in zip(others, excess(p, theirs).sum(axis=1), strict=True) if a != b]
        if not same:
            for b, p in zip(others, theirs, strict=True):
                out += [(b, "pair", a, int(v)) for a, v in zip(names, excess(p, own).sum(axis=1), strict=True)]
        else:
            lang = shares(np.array(head["counts"], np.int64), head["lang_n"] + vocabulary)
            for a, n, p in zip(names, held, own, strict=True):
                ids = np.flatnonzero((n > 0) & (p > lang))
                value = excess(p[ids], lang[ids])
                best = np.lexsort((ids, -value))[: audit.most_terms]
                out += [(a, "term", head["terms"][ids[k]], int(value[k])) for k in best]
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        arrays = [pa.array([head["lang"]] * len(out), pa.string())] + [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
        return pa.table(arrays, names=["lang", "source", "part", "item", "value"])

    return run


def divergences(docs: DataFrame, audit: Audit = Audit(), **columns: str) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence from each other source of the language (part ``pair``), and
    the terms that a source has more of than its language (part ``term``, first ``most_terms``)."""
    known = written(counts(docs, **columns), "term-counts")
    laid = known.where("term IS NOT NULL").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source")
    chunks = written(in_arrow(laid, _encoded(audit), _ENCODED), "term-chunks")
    words, vectors = chunks.where("source IS NULL"), chunks.where("source IS NOT NULL").select("lang", "chunk", "source", "ids", "counts")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    langs = words.groupBy("lang").agg(F.sum(F.size("terms")).cast("long").alias("v"), F.sum(total("counts")).alias("lang_n"))
    of_source = vectors.groupBy("lang", "source").agg(F.sum(total("counts")).alias("n"))
    groups = known.where("term IS NULL").select("lang", "source")
    sized = groups.groupBy("lang").agg(F.ceil(F.count("*") / audit.block_sources).alias("blocks"))
    # Sources by block; every count of rows from here on is one of sources, blocks or chunks.
    groups = written(
        groups.join(sized, "lang").join(of_source, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "blocks", F.pmod(F.xxhash64("source"), F.col("blocks")).alias("block")), "term-groups"
    )
    blocks = groups.groupBy("lang", "block").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("members"))
    left, right = (blocks.select("lang", F.col("block").alias(b), F.col("members").alias(side)) for b, side in (("i", "left"), ("j", "right")))
    pairs = left.join(right, "lang").where("i <= j")
    tasks = words.select("lang", "chunk", F.size("terms").alias("width"), "counts", "terms").join(langs, "lang").join(pairs, "lang")
    own = F.col("i") == F.col("j")
    tasks = tasks.withColumn("terms", F.when(own, F.col("terms"))).withColumn("counts", F.when(own, F.col("counts"))).withColumn("right", F.when(~own, F.col("right")))
    dealt = vectors.join(groups.select("lang", "source", "block", "blocks"), ["lang", "source"])
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("lang", "chunk", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "source", "ids", "counts")
    keys = ("lang", "chunk", "i", "j")
    dealt = dealt.toDF(*dealt.columns)  # columns of its own: both sides come from the same tables
    found = written(tasks.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_compared(audit), _FOUND), "term-found")
    ordered = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    every = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source != item")
    pair = every.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    pair = pair.withColumn("rank", F.row_number().over(ordered))
    term = found.where("part = 'term'").withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= audit.most_terms)
    return pair.unionByName(term)
