"""Whole texts as numpy arrays inside Arrow batches: words, hashes of words and of word n-grams.

A word is ``[^\\x20\\x09-\\x0D]+``. All separators are ASCII, so words are found on UTF-8 bytes.
Work arrays are made for a megabyte of text at a time; only a single longer text exceeds that.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Sums of powers collide for certain words of 1,024 letters and more, whatever the base.
LONG_WORD = 512


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with memory in mind: texts are long, so the session's Arrow batches are held to
    ``BATCH_ROWS`` rows, and a worker, which lives on between tasks, gives free memory back after each."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH, "10000")) <= BATCH_ROWS:
        conf.set(_BATCH, BATCH_ROWS)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return df.mapInArrow(lean, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows with about ``most`` bytes of text; a null text is empty."""
    column = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (one more entry at the end)."""
    apart = _SEPARATOR[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:] = apart if len(data) else edge[1:]
    edge[offsets[offsets < len(data)]] = True
    starts = np.flatnonzero(edge[:-1] & ~apart)
    last = np.ones(len(data), bool)
    if len(data):
        last[:-1] = apart[1:]
        inner = offsets[(offsets > 0) & (offsets <= len(data))]
        last[inner - 1] = True
    ends = np.flatnonzero(last & ~apart) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    within = np.arange(total) - np.repeat(first, lengths)
    letters = data[within + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    sums = np.add.reduceat(letters * powers(_BASE, int(lengths.max()))[within], first)
    out = mix(sums + lengths.astype(np.uint64) * _STEP)
    for i in np.flatnonzero(lengths >= LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, at the place of the first; shorter by n - 1 than ``words``."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    have, total, scale = words, 1, int(_STEP)
    for bit in bin(n)[3:]:
        have = have[: len(have) - total] + np.uint64(pow(scale, total, 1 << 64)) * have[total:]
        total *= 2
        if bit == "1":
            have = words[: len(have) - 1] + _STEP * have[1:]
            total += 1
    return mix(have + np.uint64(n))
