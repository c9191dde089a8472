"""Quality classification by a generalised additive model with pairwise interactions.

Features come from whole texts, vectorised over Arrow batches. Learning: features are cut into quantile bins;
in each round every feature in turn gets a shallow tree over its bins, fitted to the logistic gradient and
added, damped, to the feature's lookup table; then the pairs whose coarse grid explains most of what is left
get tables of their own, boosted in the same cyclic way. Scoring looks bins up and adds.

The model is fitted on at most ``max_rows`` labelled rows, those with the smallest hash of their id (a stated
bound); scoring covers all rows.

Defined results: a null text is empty; an empty text is scored like any other; without labels, or with labels
of one kind only, the score is the share of 1 (0.5 without any); rows with a null label are not learned from;
order and repeats of rows are kept; further columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.llm.texts import in_arrow, slices, word_bounds, word_hashes

MAX_ROWS = 40_000

FEATURES = (
    "log_bytes", "log_words", "word_length", "letters", "upper", "digits", "space", "not_ascii", "ends", "commas", "bangs", "bars",
    "marks", "brackets", "quotes", "line_length", "short_words", "long_words", "distinct_words", "top_word", "capital_words", "marked_words", "repeated_lines",
)


def _set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER = _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _set("abcdefghijklmnopqrstuvwxyz")
_LETTER[128:] = True
_KINDS = [_LETTER, _UPPER, _set("0123456789"), _set(" \t\n\v\f\r"), np.arange(256) >= 128, _set(".?"), _set(",;:"), _set("!"), _set("|"), _set("#$%&*@^~=+_/\\"), _set("()[]{}<>"), _set("\"'`")]
_BITS = np.zeros((256, len(_KINDS)), np.float32)
for _i, _k in enumerate(_KINDS):
    _BITS[:, _i] = _k
_MARK = _set("#$%&*@^~=+_|!\\")
_LINE_END = 10


def _sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of runs [firsts[i], firsts[i + 1]), which may be empty."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[firsts[1:]] - total[firsts[:-1]]


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: number of distinct values, and of the most frequent one."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])])) if len(d) else np.zeros(0, np.int64)
    runs = np.diff(np.append(new, len(d)))
    most = np.zeros(n)
    np.maximum.at(most, d[new], runs)
    return np.bincount(d[new], minlength=n).astype(float), most


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of each text, as columns in the order of ``FEATURES``."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    hist = np.bincount(np.repeat(np.arange(n), np.diff(offsets)) * 256 + data, minlength=n * 256).reshape(n, 256)
    kinds = (hist @ _BITS) / np.maximum(size, 1)[:, None]
    starts, ends, firsts = word_bounds(data, offsets)
    words = np.diff(firsts).astype(float)
    some = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    doc = np.repeat(np.arange(n), np.diff(firsts))
    distinct, most = _distinct(doc, word_hashes(data, starts, ends), n)
    first, last = data[starts], data[ends - 1]
    lines = hist[:, _LINE_END] + 1.0
    # A line is known by the words it holds: a rolling sum over each line's word hashes.
    hashes = word_hashes(data, starts, ends) >> np.uint64(20)
    at_end = np.concatenate([[0], np.cumsum(data == _LINE_END)])[starts] if len(starts) else np.zeros(0, np.int64)
    key = at_end * n + doc
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sums = np.add.reduceat(hashes, new) if len(new) else np.zeros(0, np.uint64)
    different, _ = _distinct(doc[new], sums, n)
    full = np.bincount(doc[new], minlength=n).astype(float)
    return np.column_stack([
        np.log1p(size), np.log1p(words), (size - hist[:, 32] - hist[:, 10]) / some, kinds, np.log1p(size / lines),
        _sums(length <= 3, firsts) / some, _sums(length >= 14, firsts) / some, distinct / some, most / some, _sums(_UPPER[first], firsts) / some, _sums(_MARK[last], firsts) / some,
        1 - different / np.maximum(full, 1),
    ])


@dataclasses.dataclass
class Model:
    """score = logistic(intercept + sum of tables[f][bin of f] + sum of grids[(f, g)][coarse bins of f and g])"""

    intercept: float
    cuts: list[np.ndarray] = dataclasses.field(default_factory=list)
    tables: list[np.ndarray] = dataclasses.field(default_factory=list)
    coarse: list[np.ndarray] = dataclasses.field(default_factory=list)
    grids: dict[tuple[int, int], np.ndarray] = dataclasses.field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            out += table[np.searchsorted(self.cuts[f], x[:, f], "right")]
        rough = {f: np.searchsorted(self.coarse[f], x[:, f], "right") for pair in self.grids for f in pair}
        for (f, g), grid in self.grids.items():
            out += grid[rough[f], rough[g]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _split(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """Best gain of one cut of bins with gradient sums g and curvature sums h, and the first bin right of it."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain = np.where((left_h >= least) & (right_h >= least), gain, -1.0)
    if not len(gain):
        return -1.0, 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> float:
    return float(g.sum() / (h.sum() + ridge))


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float, leaves: int = 3) -> np.ndarray:
    """A tree of a few leaves over ordered bins, as a value per bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*_split(g[a:b], h[a:b], ridge, least), a, b) for a, b in parts]
        gain, at, a, b = max(found)
        if gain <= 0:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b], h[a:b], ridge)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> np.ndarray:
    """A tree of four leaves over two features' bins: one cut of one feature, then one of the other on each side."""
    best, out = -1.0, np.zeros_like(g)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        gain, at = _split(a.sum(1), b.sum(1), ridge, least)
        if gain <= best:
            continue
        best, values = gain, np.zeros_like(a)
        for rows in (slice(0, at), slice(at, None)):
            below, cut = _split(a[rows].sum(0), b[rows].sum(0), ridge, least)
            sides = (slice(0, cut), slice(cut, None)) if below > 0 else (slice(None),)
            for cols in sides:
                values[rows, cols] = _leaf(a[rows, cols], b[rows, cols], ridge)
        out = values if axis == 0 else values.T
    return out


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, pairs: int = 6, bins: int = 48, coarse: int = 12, rate: float = 0.15, ridge: float = 2.0, least: float = 4.0) -> Model:
    """A model of labels y (0 or 1) by cyclic boosting."""
    if not len(y) or y.min() == y.max():
        return Model(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0)
    quantile = lambda f, k: np.unique(np.quantile(x[:, f], np.linspace(0, 1, k + 1)[1:-1]))
    p = y.mean()
    m = Model(float(np.log(p / (1 - p))), [quantile(f, bins) for f in range(x.shape[1])], coarse=[quantile(f, coarse) for f in range(x.shape[1])])
    b = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(m.cuts)]
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    margin = np.full(len(y), m.intercept)
    for _ in range(rounds):
        for f, table in enumerate(m.tables):
            q = 1 / (1 + np.exp(-margin))
            step = rate * _tree(np.bincount(b[f], y - q, len(table)), np.bincount(b[f], q * (1 - q), len(table)), ridge, least)
            table += step
            margin += step[b[f]]
    rough = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(m.coarse)]
    wide = [len(c) + 1 for c in m.coarse]

    def sums(f: int, g: int) -> tuple[np.ndarray, np.ndarray]:
        q, at, shape = 1 / (1 + np.exp(-margin)), rough[f] * wide[g] + rough[g], (wide[f], wide[g])
        return np.bincount(at, y - q, shape[0] * shape[1]).reshape(shape), np.bincount(at, q * (1 - q), shape[0] * shape[1]).reshape(shape)

    gains = []
    for f in range(x.shape[1]):
        for g in range(f + 1, x.shape[1]):
            a, h = sums(f, g)
            tree = _grid_tree(a, h, ridge, least)
            gains.append((float((tree * a - 0.5 * tree**2 * h).sum()), f, g))
    m.grids = {(f, g): np.zeros((wide[f], wide[g])) for gain, f, g in sorted(gains, reverse=True)[:pairs] if gain > 0}
    for _ in range(pair_rounds):
        for (f, g), grid in m.grids.items():
            step = rate * _grid_tree(*sums(f, g), ridge, least)
            grid += step
            margin += step[rough[f], rough[g]]
    return m


def featured(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep`` of ``docs`` and their text's features as an array of doubles."""
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", features array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                x = features(data, offsets)
                flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
                yield pa.RecordBatch.from_arrays([*[rows.column(rows.schema.get_field_index(c)) for c in keep], flat], names=[*keep, "features"])

    return in_arrow(docs.select(*keep, "text"), run, schema)


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = MAX_ROWS, **how) -> Model:
    """A model of ``labels`` (id, 0 or 1) by the texts of ``docs``; at most ``max_rows`` labels, so they may be broadcast."""
    pick = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y"))
    pick = pick.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), "text").join(F.broadcast(pick), "doc_id")
    table = featured(rows, "doc_id", "y").orderBy("doc_id").toArrow()
    x = np.array(table.column("features").to_pylist()).reshape(-1, len(FEATURES))
    return fitted(x, table.column("y").to_numpy(), **how)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(shared.value.score(features(data, offsets)))], names=["doc_id", "score"])

    return in_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {id_type}, score double")
