"""Language identification as inference of a mixture of languages.

Learning counts hashed n-grams (three neighbouring byte classes around each letter, so word edges take part)
per language in Spark; the model is a table of log-probabilities, ``BUCKETS`` by languages, whatever the
size of the corpus. Inference takes each word as one draw from a mixture of languages: expectation-
maximisation over the words' n-gram likelihoods gives the document's language proportions. Language sets,
nested by proportion, compete by likelihood less ``penalty * log(words)`` for each further language; the
largest language of the chosen set is the prediction, its proportion the score.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where nothing was learned;
ties go to the language first in order; order and repeats of rows are kept; further columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landshift.llm.texts import in_arrow, slices

BUCKETS = 1 << 16
MAX_LANGUAGES = 512
UNDETERMINED = "und"

_CLASS = np.zeros(256, np.uint32)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)


@dataclasses.dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_p: np.ndarray  # float32 [BUCKETS, languages]
    penalty: float = 8.0
    rounds: int = 12


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each letter's n-gram, index of each word's first letter, and of each text's first word."""
    kind = np.zeros(len(data) + len(offsets) + 1, np.uint32)  # a gap before each text and one after all
    gap = np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    kind[np.arange(len(data)) + gap] = _CLASS[data]
    letters = np.flatnonzero(kind)
    before, here, after = kind[letters - 1], kind[letters], kind[letters + 1]
    code = (before * np.uint32(155) + here) * np.uint32(155) + after
    bucket = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    words = np.flatnonzero(before == 0)
    begins = offsets + np.arange(1, len(offsets) + 1)  # where each text begins, with its gap, and where one more would
    return bucket, words, np.searchsorted(letters[words], begins)


def _lowered_one(text: pa.Array) -> pa.Array:
    try:
        return pc.utf8_lower(text)
    except pa.ArrowInvalid:
        return text


def _lowered(batch: pa.RecordBatch) -> pa.RecordBatch:
    at = batch.schema.get_field_index("text")
    text = pc.fill_null(batch.column(at), "")
    try:
        text = pc.utf8_lower(text)
    except pa.ArrowInvalid:  # malformed UTF-8: its bytes are counted as they are; ASCII letters fold anyway
        text = pa.chunked_array([_lowered_one(text.slice(i, 1)) for i in range(len(text))]).combine_chunks()
    return batch.set_column(at, "text", text)


def learned(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", penalty: float = 8.0, smoothing: float = 0.1) -> Model:
    """The model of all rows of ``docs`` that have a language; all texts count whole."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows, data, offsets in slices(_lowered(batch), "text"):
                bucket, words, firsts = _grams(data, offsets)
                edges = np.append(words, len(bucket))[firsts]
                for i, lang in enumerate(rows.column(rows.schema.get_field_index("lang")).to_pylist()):
                    if lang not in held:
                        if len(held) >= MAX_LANGUAGES:
                            raise ValueError(f"more than {MAX_LANGUAGES} languages")
                        held[lang] = np.zeros(BUCKETS, np.int64)
                    held[lang] += np.bincount(bucket[edges[i] : edges[i + 1]], minlength=BUCKETS) if edges[i + 1] - edges[i] > BUCKETS // 4 else 0
                    if edges[i + 1] - edges[i] <= BUCKETS // 4:
                        np.add.at(held[lang], bucket[edges[i] : edges[i + 1]], 1)
        for lang, n in held.items():
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit), pa.array(n[hit])], names=["lang", "bucket", "n"])

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = in_arrow(rows, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # at most BUCKETS rows per language
    names = sorted(set(table.column("lang").to_pylist()))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    n = np.full((BUCKETS, len(names)), smoothing)
    if names:
        column = np.searchsorted(np.array(names), np.array(table.column("lang").to_pylist()))
        n[table.column("bucket").to_numpy(), column] += table.column("n").to_numpy()
    return Model(tuple(names), np.log(n / n.sum(0, keepdims=True) if names else n).astype(np.float32), penalty)


def _em(like: np.ndarray, top: np.ndarray, first: np.ndarray, doc: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood per text; like: words by languages, scaled by exp(-top)."""
    share = start
    for _ in range(rounds):
        part = like * share[doc]
        part /= np.maximum(part.sum(1, keepdims=True), 1e-30)
        share = np.add.reduceat(part, first, axis=0) / counts[:, None]
    fit = np.log(np.maximum((like * share[doc]).sum(1), 1e-30)) + top
    return share, np.add.reduceat(fit, first)


def mixtures(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: proportions of languages in the chosen set (a row of zeros where there is no word), and its number of words."""
    bucket, words, firsts = _grams(data, offsets)
    n = len(offsets) - 1
    counts = np.diff(firsts)
    out = np.zeros((n, len(model.languages)), np.float32)
    some = np.flatnonzero(counts)
    if not len(some) or not model.languages:
        return out, counts
    fit = np.add.reduceat(model.log_p[bucket], words, axis=0)
    first, size = firsts[:-1][some], counts[some].astype(np.float32)
    single = np.add.reduceat(fit, first, axis=0, dtype=np.float64)
    best = single.argmax(1)
    out[some, best] = 1
    if len(model.languages) == 1:
        return out, counts
    top = fit.max(1)
    # What any mixture could gain over the best single language is bounded by each word taking its own best.
    price = model.penalty * np.log(size + 1)
    open_ = np.flatnonzero(np.add.reduceat(top, first, dtype=np.float64) - single[np.arange(len(some)), best] > price)
    if not len(open_):
        return out, counts
    inside = np.concatenate([np.arange(firsts[some[k]], firsts[some[k] + 1]) for k in open_])
    doc = np.repeat(np.arange(len(open_)), counts[some[open_]])
    first = np.concatenate([[0], np.cumsum(counts[some[open_]])[:-1]])
    size, price, top = size[open_], price[open_], top[inside]
    like = np.exp(fit[inside] - top[:, None])
    even = np.full((len(open_), len(model.languages)), 1 / len(model.languages), np.float32)
    share, _ = _em(like, top, first, doc, size, even, model.rounds)
    order = np.argsort(-share, axis=1, kind="stable")
    value, most = single[open_, best[open_]], np.add.reduceat(top, first, dtype=np.float64)
    chosen = out[some[open_]]
    for k in range(2, len(model.languages) + 1):
        # No set of k or more can be better than each word's own best; this bound is each text's own, too.
        hope = most - (k - 1) * price > value
        if not hope.any():
            break
        allowed = np.zeros_like(even)
        np.put_along_axis(allowed, order[:, :k], np.take_along_axis(share, order[:, :k], 1) + 1e-6, 1)
        allowed /= allowed.sum(1, keepdims=True)
        part, fits = _em(like, top, first, doc, size, allowed, 4)
        gain = fits - (k - 1) * price
        better = hope & (gain > value)
        chosen[better], value[better] = part[better], gain[better]
    out[some[open_]] = chosen
    return out, counts


def with_language(docs: DataFrame, model: Model, text_col: str = "text", with_mixture: bool = False) -> DataFrame:
    """Each row of ``docs`` as column ``row``, with lang_pred, score and, if asked for, the proportions of the chosen set."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if with_mixture:
        schema = schema.add("mixture", T.MapType(T.StringType(), T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.languages, UNDETERMINED], object)
        for batch in batches:
            for rows, data, offsets in slices(_lowered(batch), "text"):
                share, words = mixtures(own, data, offsets)
                letters = rows.column(2).to_numpy(zero_copy_only=False).astype(bool) & (words > 0)
                known = letters & (len(own.languages) > 0)
                best = np.where(known, share.argmax(1) if share.shape[1] else 0, len(own.languages))
                score = np.where(known, share.max(1) if share.shape[1] else 0.0, 0.0).astype(float)
                columns = [rows.column(0), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))]
                if with_mixture:
                    kinds = pa.map_(pa.string(), pa.float64())
                    columns.append(pa.array([[(own.languages[j], float(s[j])) for j in np.flatnonzero(s > 0)] if k else [] for s, k in zip(share, known, strict=True)], kinds))
                yield pa.RecordBatch.from_arrays(columns, names=["row", "lang_pred", "score", "mixture"][: len(columns)])

    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return in_arrow(docs.select(row.alias("row"), text.alias("text"), text.rlike(r"\p{L}").alias("letters")), run, schema)


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_mixture: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score and, if asked for, the proportions of the chosen set."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = with_language(slim, model, with_mixture=with_mixture)
    return found.select("row.doc_id", "lang_pred", "score", *(["mixture"] if with_mixture else []))


def with_known_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in learned languages, one or more; only ``und`` goes."""
    found = with_language(docs, model, text_col).where(F.col("lang_pred") != UNDETERMINED)
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns])
