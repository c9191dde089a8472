"""Near-duplicate classes by improved consistent weighted sampling (ICWS) over TF-IDF word shingles.

1. Document frequencies, exact for each frequent shingle. A shingle is frequent if it makes up at least one
   ``FREQUENT``-th of all pairs of a document and one of its distinct shingles, so there are at most that many,
   whatever the size of the corpus. First all shingles are counted in ``DF_BUCKETS`` hashed buckets; what lies
   in buckets that hold enough for a frequent one is then counted by its own hash.
2. Per document, weights of its distinct shingles: (1 + ln tf) * idf, in steps of 2 ** (1/16). The idf falls with
   the logarithm of a shingle's share of the documents, from 1 where it is not frequent to ``LEAST_IDF`` where
   every document has it. That least value is what keeps a copy found whose words are all boilerplate but for its
   edits: at a plain similarity of 0.85 it is at 0.81 by these weights.
   ICWS draws ``bands * rows`` samples (shingle, t); its Gamma and uniform variates come from a table
   indexed by a hash of shingle and draw, so the value of a sample is one lookup by (weight, index).
3. Texts with the same words are one node. Nodes that share a band meet in its bucket. In a bucket of at most
   ``FEW`` nodes all are compared with each other. In a larger one each is compared with a few centres, nodes
   with the least hash for that bucket, so each bucket has others. Every such pair is verified by the weighted
   Jaccard similarity of the whole texts. Groups of copies gather here without expanding into pairs.
4. What the centres leave: nodes of a large bucket that are in different components of the links so far are
   all compared, block by block. A task holds two blocks, bounded in texts and bytes, takes the similarities of
   all their texts as products of matrices, and returns only the links that join components. So any two nodes
   that share a band and are alike end in one class, no pairs are emitted, and no task holds a bucket. A large
   bucket of texts that are related but no copies takes work with its square.
5. Classes are the components of all verified links.

Result: one row per document with class_id, the least id of its class, and kept (it is that document).

Defined results: a text without words is a class of its own; texts of fewer words than a shingle are one
shingle; rows that share an id are one document; a null id counts as less than all others; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.operators.graph import components
from landshift.sources.shared import written
from landshift.llm.texts import gram_hashes, in_arrow, mix, slices, word_bounds, word_hashes

DF_BUCKETS, FREQUENT = 1 << 18, 1 << 16
LEAST_IDF = 0.75
FEW, CENTRES = 8, 4
BLOCK, BLOCK_BYTES = 256, 2 << 20
_BUCKET = np.uint64(64 - 18)
_TABLE = 1 << 15
_LEVELS, _STEPS = 72, 16
_NULL_ID = -(1 << 63)


@dataclasses.dataclass(frozen=True)
class Settings:
    shingle: int = 5
    similarity: float = 0.8
    bands: int = 10
    rows: int = 4
    seed: int = 5


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number, hash, frequency (sorted by text), and the words per text."""
    starts, ends, firsts = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    count = np.diff(firsts)
    doc = np.repeat(np.arange(len(count)), count)
    grams = gram_hashes(words, size)
    whole = doc[: len(grams)] == doc[size - 1 :] if len(grams) else np.zeros(0, bool)
    d, h = doc[: len(grams)][whole], grams[whole]
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        short = [mix(np.bitwise_xor.reduce(mix(words[firsts[i] : firsts[i + 1]] + np.arange(1, count[i] + 1, dtype=np.uint64)), keepdims=True))[0] for i in few]
        d, h = np.concatenate([d, few]), np.concatenate([h, np.array(short, np.uint64)])
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])) if len(d) else np.zeros(0, np.int64)
    return d[new], h[new], np.diff(np.append(new, len(d))), count


def identity(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each text's sequence of words."""
    starts, ends, firsts = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    place = (np.arange(len(words)) - np.repeat(firsts[:-1], np.diff(firsts))).astype(np.uint64)
    out = []
    for salt in (1, 2):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words ^ mix(place * np.uint64(2) + np.uint64(salt))))])
        out.append(mix((total[firsts[1:]] - total[firsts[:-1]]) + np.diff(firsts).astype(np.uint64)))
    return out[0], out[1]


@dataclasses.dataclass
class Weights:
    """idf of the frequent shingles, sorted by hash; all others have 1. ``hot`` marks the buckets they lie in."""

    hashes: np.ndarray
    idf: np.ndarray
    hot: np.ndarray

    def levels(self, hashes: np.ndarray, tf: np.ndarray) -> np.ndarray:
        weight = (1 + np.log(tf)) / LEAST_IDF  # at least 1 with the idf; similarity does not depend on the scale
        some = np.flatnonzero(self.hot[hashes >> _BUCKET])
        if len(some):
            at = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
            weight[some] *= np.where(self.hashes[at] == hashes[some], self.idf[at], 1.0)
        return np.clip(np.rint(_STEPS * np.log2(weight)).astype(np.int64), 0, _LEVELS - 1)


def _counted(docs: DataFrame, settings: Settings, hot: np.ndarray | None) -> DataFrame:
    """(h, n): documents by bucket and, as bucket -1, all with words; or by shingle, for those in hot buckets."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, wanted = np.zeros(DF_BUCKETS, np.int64), 0, shared.value
        for batch in batches:
            for _, data, offsets in slices(batch, "text"):
                _, h, _, words = shingles(data, offsets, settings.shingle)
                if wanted is None:
                    df += np.bincount((h >> _BUCKET).astype(np.int64), minlength=DF_BUCKETS)
                    n += int((words > 0).sum())
                else:
                    key, times = np.unique(h[wanted[h >> _BUCKET]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(times.astype(np.int64))], names=["h", "n"])
        if wanted is None:
            hit = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(df[hit], n))], names=["h", "n"])

    return in_arrow(docs.select("text"), count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def weights(docs: DataFrame, settings: Settings) -> Weights:
    """idf of the frequent shingles over all rows of ``docs`` (text); at most ``FREQUENT`` at any size."""
    buckets = _counted(docs, settings, None).toArrow()  # DF_BUCKETS rows and one
    at, n = buckets.column("h").to_numpy(), buckets.column("n").to_numpy()
    documents, pairs = int(n[at < 0].sum()), int(n[at >= 0].sum())
    least = max(2, -(-pairs // FREQUENT))
    hot = np.zeros(DF_BUCKETS, bool)
    hot[at[(at >= 0) & (n >= least)]] = True
    if not hot.any():
        return Weights(np.zeros(0, np.uint64), np.zeros(0), hot)
    found = _counted(docs, settings, hot).where(F.col("n") >= least).toArrow()
    h, df = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    hot = np.zeros(DF_BUCKETS, bool)
    hot[h >> _BUCKET] = True
    rare = np.log(min(least, documents) / documents) or -1.0
    idf = LEAST_IDF + (1 - LEAST_IDF) * np.log(np.minimum(df, documents) / documents) / rare
    return Weights(h[order], np.clip(idf, LEAST_IDF, 1)[order], hot)


class Sampler:
    """ICWS draws. For weight w: t = floor(ln w / r + b), ln a = ln c - r * (t - b + 1); the shingle with least a is
    drawn, and the sample is (shingle, t): the rank of ln a stands for t, as no two (index, t) have the same."""

    def __init__(self, settings: Settings):
        rng = np.random.default_rng(settings.seed)
        r, c = rng.gamma(2.0, 1.0, _TABLE), rng.gamma(2.0, 1.0, _TABLE)
        b = rng.random(_TABLE)
        ln_w = np.log(2.0) / _STEPS * np.arange(_LEVELS)[:, None]
        ln_a = np.log(c) - r * (np.floor(ln_w / r + b) - b + 1)
        # Only order matters: ranks, equal values equal, in the upper half of a key whose lower half names the shingle.
        _, rank = np.unique(ln_a, return_inverse=True)
        self.table = (rank.reshape(-1).astype(np.uint64) << np.uint64(32))
        self.odd = rng.integers(0, 1 << 63, settings.bands * settings.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.settings = settings

    def bands(self, doc: np.ndarray, hashes: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text numbers, and the hash of each of their bands."""
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        base = levels * _TABLE
        name = hashes & np.uint64(0xFFFFFFFF)
        out = np.zeros((len(first), self.settings.bands), np.uint64)
        for j, odd in enumerate(self.odd):
            at = ((hashes * odd) >> np.uint64(51)).astype(np.int64)
            drawn = np.minimum.reduceat(self.table[base + at] | name, first)
            band = j // self.settings.rows
            out[:, band] = mix(out[:, band] * np.uint64(3) + drawn + np.uint64(j + 1))
        return doc[first], out


@functools.cache
def _sampler(settings: Settings) -> Sampler:
    """One per worker process."""
    return Sampler(settings)


def _signatures(docs: DataFrame, own: Weights, settings: Settings) -> DataFrame:
    """(key, c1, c2, size, bands) of every row that has words; size in bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(settings)
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                doc, h, tf, _ = shingles(data, offsets, settings.shingle)
                if not len(doc):
                    continue
                who, bands = sampler.bands(doc, h, shared.value.levels(h, tf))
                c1, c2 = identity(data, offsets)
                flat = pa.ListArray.from_arrays(np.arange(len(who) + 1, dtype=np.int32) * settings.bands, bands.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(who)), pa.array(c1[who].view(np.int64)), pa.array(c2[who].view(np.int64)), pa.array(np.diff(offsets)[who]), flat], names=["key", "c1", "c2", "size", "bands"])

    return in_arrow(docs, run, "key long, c1 long, c2 long, size long, bands array<long>")


def similarities(own: Weights, size: int, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weighted Jaccard similarity of the texts of two slices, row by row."""
    d1, h1, t1, n1 = shingles(*left, size)
    d2, h2, t2, _ = shingles(*right, size)
    w1, w2 = (2.0 ** (own.levels(h, t) / _STEPS) for h, t in ((h1, t1), (h2, t2)))
    doc, h, w = np.concatenate([d1, d2]), np.concatenate([h1, h2]), np.concatenate([w1, w2])
    order = np.lexsort((h, doc))
    doc, h, w = doc[order], h[order], w[order]
    same = np.flatnonzero((doc[1:] == doc[:-1]) & (h[1:] == h[:-1])) if len(doc) else np.zeros(0, np.int64)
    both = np.bincount(doc[same], np.minimum(w[same], w[same + 1]), len(n1))
    total = np.bincount(doc, w, len(n1))
    return both / np.maximum(total - both, 1e-12)


def _verified(pairs: DataFrame, texts: DataFrame, own: Weights, settings: Settings) -> DataFrame:
    """(u, v, sim) for pairs (u, v); v may be in many pairs, so its text is joined first, by rows of two numbers."""
    shared = pairs.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text_u", 1 << 19):
                for part, data_v, offsets_v in slices(rows, "text_v", 1 << 19):
                    at = (part.column(0).offset - rows.column(0).offset) if part.num_rows < rows.num_rows else 0
                    mine = offsets[at : at + part.num_rows + 1]
                    sim = similarities(shared.value, settings.shingle, (data[mine[0] : mine[-1]], mine - mine[0]), (data_v, offsets_v))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sim)], names=["u", "v", "sim"])

    withv = pairs.join(texts.select(F.col("key").alias("v"), F.col("text").alias("text_v")).hint("merge"), "v")
    both = withv.join(texts.select(F.col("key").alias("u"), F.col("text").alias("text_u")).hint("merge"), "u")
    return in_arrow(both.select("u", "v", "text_u", "text_v"), run, "u long, v long, sim double")


def buckets(nodes: DataFrame, settings: Settings) -> DataFrame:
    """Buckets with more than one node: (key, node, size, n, centres) from (node, size, bands)."""
    rows = nodes.select("node", "size", F.posexplode("bands").alias("band", "hash"))
    rows = rows.select(F.xxhash64("band", "hash").alias("key"), "node", "size")
    least = lambda j: F.min(F.struct(F.xxhash64("node", "key", F.lit(j)), F.col("node").alias("node")))["node"]
    met = rows.groupBy("key").agg(F.count("*").alias("n"), F.array_distinct(F.array(*[least(j) for j in range(CENTRES)])).alias("centres")).where("n > 1")
    return written(rows.join(met, "key"), "near-buckets")


def candidates(met: DataFrame) -> DataFrame:
    """(u, v), u > v: the pairs of nodes to compare first, from ``buckets``."""
    few = met.where(F.col("n") <= FEW).select("key", "node")
    near = few.select("key", F.col("node").alias("u")).join(few.select("key", F.col("node").alias("v")), "key").where("u > v").select("u", "v")
    star = met.where(F.col("n") > FEW).select("node", F.explode("centres").alias("centre")).where("node != centre")
    return near.unionByName(star.select(F.greatest("node", "centre").alias("u"), F.least("node", "centre").alias("v"))).distinct()


def in_steps(d: np.ndarray, h: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted shingles of texts as plain features (text, feature) with weights by feature.

    A shingle that occurs with several weights is as many features, one per step between them, and a text has
    those up to its own weight; so the shared weight of two texts is the sum over the features both have.
    """
    order = np.lexsort((level, h))
    d, h, level = d[order], h[order], level[order]
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new = new_h | np.concatenate([[True], level[1:] != level[:-1]])
    at = np.cumsum(new) - 1
    first = np.maximum.accumulate(np.where(new_h, at, 0))
    weight = 2.0 ** (level[new] / _STEPS)
    step = weight - np.where(new_h[new], 0.0, np.concatenate([[0.0], weight[:-1]]))
    n = at - first + 1
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(d, n), np.repeat(first, n) + inner, step, np.bincount(d, weight[at])


def block_similarities(own: Weights, size: int, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], columns: int = 2048) -> np.ndarray:
    """Weighted Jaccard similarity of every text of one slice with every text of another."""
    d1, h1, t1, n1 = shingles(*left, size)
    d2, h2, t2, n2 = shingles(*right, size)
    if not len(d1) or not len(d2):
        return np.zeros((len(n1), len(n2)))
    h, tf = np.concatenate([h1, h2]), np.concatenate([t1, t2])
    doc, feature, step, total = in_steps(np.concatenate([d1, d2 + len(n1)]), h, own.levels(h, tf))
    total = np.concatenate([total, np.zeros(len(n1) + len(n2) - len(total))])
    mine = doc < len(n1)
    shared = np.zeros(len(step), np.int64)
    shared[feature[mine]] |= 1
    shared[feature[~mine]] |= 2
    keep = shared[feature] == 3
    doc, feature = doc[keep], feature[keep]
    order = np.argsort(feature, kind="stable")
    doc, feature = doc[order], feature[order]
    place = np.cumsum(np.concatenate([[0], feature[1:] != feature[:-1]])) if len(feature) else feature
    both = np.zeros((len(n1), len(n2)))
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        part = slice(np.searchsorted(place, at), np.searchsorted(place, at + columns))
        a, b = np.zeros((len(n1), columns)), np.zeros((len(n2), columns))
        who, col, w = doc[part], place[part] - at, step[feature[part]]
        ours = who < len(n1)
        a[who[ours], col[ours]] = w[ours]
        b[who[~ours] - len(n1), col[~ours]] = 1
        both += a @ b.T
    return both / np.maximum(total[: len(n1), None] + total[None, len(n1) :] - both, 1e-12)


def _spanning(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Of links, those that join what the ones before have not."""
    top: dict[int, int] = {}

    def of(x: int) -> int:
        while (up := top.get(x, x)) != x:
            top[x] = top.get(up, up)
            x = up
        return x

    out = []
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        x, y = of(a), of(b)
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def across(met: DataFrame, joined: DataFrame, base: DataFrame, own: Weights, settings: Settings) -> DataFrame:
    """(u, v): links between nodes of a large bucket in different components, as few as join what they join.

    met: ``buckets``; joined: (node, component). One of such a pair is outside its bucket's largest component, so
    blocks of those nodes meet blocks of all nodes.
    """
    labels = joined.select(F.col("node").alias("l_node"), "component")
    large = met.where(F.col("n") > FEW).join(labels, F.col("node") == F.col("l_node"), "left")
    large = large.select("key", "node", "size", F.coalesce("component", "node").alias("class"))
    sizes = large.groupBy("key", "class").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    most = F.max_by(F.struct("class", "n", "bytes"), F.struct("n", "class"))
    per = sizes.groupBy("key").agg(most.alias("most"), F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("classes > 1")
    per = per.select("key", F.col("most.class").alias("most"), blocks(F.col("n"), F.col("bytes")).alias("every"), blocks(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")).alias("outer"))
    rows = written(large.join(per, "key"), "near-open")
    block = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = rows.where("class != most").select("key", "node", "class", block(F.col("outer")).alias("i"), to("every").alias("j"), F.lit(True).alias("outside"))
    inside = rows.select("key", "node", "class", to("outer").alias("i"), block(F.col("every")).alias("j"), F.lit(False).alias("outside"))
    texts = base.join(rows.select(F.col("node").alias("key")).distinct().hint("merge"), "key", "left_semi")
    texts = written(texts.select(F.col("key").alias("node"), "text"), "near-texts")
    held = written(outside.unionByName(inside), "near-blocks").join(texts.hint("merge"), "node")
    shared = base.sparkSession.sparkContext.broadcast(own)

    def compare(table: pa.Table) -> pa.Table:
        sides = []
        for flag in (True, False):
            part = table.filter(pc.equal(table.column("outside"), flag)).combine_chunks()
            batch = part.to_batches(max_chunksize=max(part.num_rows, 1))
            node, label = (part.column(c).to_numpy() for c in ("node", "class"))
            sides.append((node, label, next(slices(batch[0], "text", 1 << 40))[1:] if batch else None))
        (u, cu, left), (v, cv, right) = sides
        links = []
        if left is not None and right is not None:
            sim = block_similarities(shared.value, settings.shingle, left, right)
            a, b = np.nonzero((sim >= settings.similarity) & (cu[:, None] != cv[None, :]))
            links = _spanning(u[a], v[b])
        return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], names=["u", "v"])

    return held.groupBy("key", "i", "j").applyInArrow(compare, "u long, v long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def near_classes(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, kept."""
    base = _keyed(docs, id_col, text_col)
    own = weights(base, settings)
    signed = written(_signatures(base, own, settings), "near-signatures")
    # Texts with the same words become one node, named by its least id; first on the map side.
    nodes = written(signed.groupBy("c1", "c2").agg(F.min("key").alias("node"), F.min("size").alias("size"), F.min("bands").alias("bands")), "near-nodes")
    met = buckets(nodes, settings)
    joined = written(components(_compared(written(candidates(met), "near-pairs"), base, own, settings)), "near-components")
    rest = written(across(met, joined, base, own, settings), "near-links")
    # The components so far stand for their links.
    joined = written(components(rest.unionByName(joined.select(F.col("node").alias("u"), F.col("component").alias("v")))), "near-components")
    named = _named(nodes, joined)
    found = signed.select("key", "c1", "c2").join(named, ["c1", "c2"]).select("key", "class_key")
    empty = base.where(~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("key", F.col("key").alias("class_key"))
    out = found.unionByName(empty)
    real = lambda c: F.nullif(F.col(c), F.lit(_NULL_ID).cast("long"))
    return out.select(real("key").alias("doc_id"), real("class_key").alias("class_id"), (F.col("key") == F.col("class_key")).alias("kept"))


def _compared(pairs: DataFrame, base: DataFrame, own: Weights, settings: Settings) -> DataFrame:
    """(u, v) of those ``pairs`` that are links, by the texts of ``base`` that they name."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    texts = written(base.join(wanted.hint("merge"), "key", "left_semi"), "near-texts")
    return written(_verified(pairs, texts, own, settings).where(F.col("sim") >= settings.similarity).select("u", "v"), "near-links")


def _named(nodes: DataFrame, joined: DataFrame) -> DataFrame:
    """(c1, c2, class_key): the class of each node; without links a node is its own."""
    labels = joined.select(F.col("node").alias("l_node"), "component")
    return nodes.join(labels, F.col("node") == F.col("l_node"), "left").select("c1", "c2", F.coalesce("component", "node").alias("class_key"))


def without_near_copies(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Of each class the row with the least doc_id (one without an id comes last), with the columns of ``docs``.

    Rows are told apart by a number of their own, written with them, so a text that shares its id with a copy of
    another one stays, and of rows that share both one stays."""
    number = "_near_row"
    rows = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias(number)), "near-rows")
    classes = written(near_classes(rows.select(number, F.col("row.text").alias("text")), settings, number).select(F.col("doc_id").alias(number), "class_id"), "near-classes")
    shared = classes.where(F.col(number) != F.col("class_id")).select("class_id").distinct()
    members = classes.join(shared, "class_id", "left_semi").join(rows.select(number, F.col("row.doc_id").alias("doc_id")), number)
    first = members.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", number))[number].alias("first"))
    gone = written(members.join(first, "class_id").where(F.col(number) != F.col("first")).select(F.col(number).alias("gone")), "near-gone")
    kept = rows.join(gone, F.col(number) == F.col("gone"), "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
