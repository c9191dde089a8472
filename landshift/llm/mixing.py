"""Mixing sources to target weights, in fixed-length blocks of words.

1. Words of each source form one stream (documents in a fixed order); the stream is packed into blocks of
   ``block_words`` words, the last one shorter.
2. Each output shard has ``shard_slots`` slots; how many go to which source is a multinomial draw seeded by
   the shard's number, the last and shorter shard included. Slots of a source are numbered through all shards.
3. Slot r of a source takes the block that a keyed permutation of the source's block numbers gives for
   ``r mod blocks`` (another key for each pass), so a block comes a second time only after all came once.
   Slots and blocks are joined by (source, block).
4. One more shard balances the draws: slots beyond a source's quota take nothing, missing ones are added
   there. A quota is the target over the source's mean block length; as no target exceeds ``max_repeats``
   times its source's size, no block is taken more often than that.

Stream offsets are prefix sums in three levels (groups of chunks, chunks, rows), and a source has a chunk for
every ``chunk_rows`` of its rows, so chunks are alike and a source with a third of all rows is spread over many
tasks. Slots are numbered likewise over shards and groups of them, and dealt out by shard before each becomes a
row. Only the directory of sources, checked to be at most ``MAX_SOURCES`` rows, is collected and broadcast.

Defined results: a null text has no words; a null source is a source of its own, last in order; each repeated
row is mixed as a row of its own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landshift.sources.shared import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_SOURCES = 100_000
GROUP = 1024


@dataclasses.dataclass(frozen=True)
class Mixture:
    """weights repeat over the sources by code point; the mix takes ``share`` of all words."""

    weights: tuple[float, ...] = WEIGHTS
    share: float = 1.5
    max_repeats: int = 2
    block_words: int = 64
    shard_slots: int = 4096
    chunk_rows: int = 500
    seed: int = 17


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Shares of ``share * sum(sizes)`` by weight; what lies above ``most`` times a size is shared out again."""
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), list(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..size-1 at ``index``: a four-round Feistel network with cycle walking."""
    from landshift.llm.texts import mix

    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(float))).astype(np.int64) + 1) // 2)
    half = np.where((np.int64(1) << (2 * half)) < size, half + 1, half).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    size, key = size.astype(np.uint64), key.astype(np.int64).view(np.uint64)
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for turn in range(4):
            left, right = right, left ^ (mix(right + mix(k + np.uint64(turn))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text).alias("h"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))


@dataclasses.dataclass
class Plan:
    """placed: rows with their source number and stream offset; sources: the directory; slots: drawn slots."""

    placed: DataFrame
    sources: DataFrame
    slots: DataFrame
    mixture: Mixture


def _directory(spark: SparkSession, slim: DataFrame, mixture: Mixture) -> tuple[DataFrame, list[tuple]]:
    found = slim.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them before mixing")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    weights = [mixture.weights[i % len(mixture.weights)] for i in range(len(found))]
    aims = targets([r["size"] for r in found], weights, mixture.share, mixture.max_repeats)
    rows = []
    for i, (r, aim) in enumerate(zip(found, aims, strict=True)):
        blocks = -(-r["size"] // mixture.block_words)
        quota = min(mixture.max_repeats * blocks, round(aim * blocks / r["size"])) if blocks else 0
        rows.append((i, r.source, r["size"], aim, blocks, quota, -(-r["n"] // mixture.chunk_rows)))
    schema = "source_no int, source string, source_size long, target double, blocks long, quota long, chunks long"
    return spark.createDataFrame(rows, schema), rows


def _before(sums: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """(source_no, order, name): the sum of ``value`` over the rows of a source before each, in two levels;
    ``sums`` has one row per source and place in the order."""
    grouped = sums.withColumn("group", F.floor(F.col(order) / GROUP))
    line = Window.partitionBy("source_no").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("source_no", "group").agg(F.sum(value).alias("n")).select("source_no", "group", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("group_from"))
    inside = Window.partitionBy("source_no", "group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = grouped.withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(groups, ["source_no", "group"])
    return rows.select("source_no", order, (F.col("group_from") + F.col("inside")).alias(name))


def _slots(spark: SparkSession, rows: list[tuple], mixture: Mixture) -> DataFrame:
    """(shard, source_no, slot, block, pass): every slot that takes a block."""
    quotas = np.array([r[5] for r in rows], float)
    total = int(quotas.sum())
    empty = "shard long, source_no int, slot long, block long, pass long"
    if not total:
        return spark.createDataFrame([], empty)
    shards = -(-total // mixture.shard_slots)
    share, seed, size = quotas / total, mixture.seed, mixture.shard_slots

    def drawn(batches):
        for pdf in batches:
            for shard in pdf["id"]:
                counts = np.random.default_rng([seed, int(shard)]).multinomial(min(size, total - int(shard) * size), share)
                hit = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": np.int64(shard), "source_no": hit.astype(np.int32), "n": counts[hit].astype(np.int64)})

    sources = F.broadcast(spark.createDataFrame([(r[0], r[4], r[5]) for r in rows], "source_no int, blocks long, quota long"))
    counts = spark.range(shards).mapInPandas(drawn, "shard long, source_no int, n long")
    # The balancing shard comes last; it asks for the whole quota, of which what is not yet drawn remains.
    last = sources.select(F.lit(shards).cast("long").alias("shard"), "source_no", F.col("quota").alias("n"))
    runs = counts.unionByName(last)
    runs = runs.join(_before(runs, "shard", "n", "from"), ["source_no", "shard"]).join(sources, "source_no")
    runs = runs.withColumn("to", F.least("quota", F.col("from") + F.col("n"))).where("from < to")
    # Dealt out by shard while it is a row per shard and source, before each slot becomes one.
    runs = runs.repartition("shard", "source_no")
    slots = runs.select("shard", "source_no", "blocks", F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("slot"))

    @F.pandas_udf("long")
    def block_of(slot: pd.Series, blocks: pd.Series, source_no: pd.Series) -> pd.Series:
        r, n = slot.to_numpy(), blocks.to_numpy()
        key = (np.int64(seed) << np.int64(40)) ^ (source_no.to_numpy().astype(np.int64) << np.int64(8)) ^ (r // n)
        return pd.Series(permuted(r % n, n, key))

    return slots.select("shard", "source_no", "slot", block_of("slot", "blocks", "source_no").alias("block"), F.floor(F.col("slot") / F.col("blocks")).alias("pass"))


def planned(docs: DataFrame, mixture: Mixture = Mixture(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Plan:
    spark = docs.sparkSession
    slim = written(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    sources, rows = _directory(spark, slim, mixture)
    numbered = slim.join(F.broadcast(sources), slim.source.eqNullSafe(sources.source)).drop(sources.source)
    numbered = numbered.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "h"), F.col("chunks")))
    by_chunk = _before(numbered.groupBy("source_no", "chunk").agg(F.sum("size").alias("words")), "chunk", "words", "chunk_from")
    inside = Window.partitionBy("source_no", "chunk").orderBy("doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    placed = numbered.withColumn("row_from", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(by_chunk, ["source_no", "chunk"])
    placed = placed.select("doc_id", "h", "source", "source_no", "size", "source_size", "target", (F.col("chunk_from") + F.col("row_from")).alias("offset"))
    return Plan(placed, sources, _slots(spark, rows, mixture), mixture)


def segments(plan: Plan) -> DataFrame:
    """The parts of documents that lie in one block: (doc_id, h, source_no, offset, size, block, first, n)."""
    size = plan.mixture.block_words
    low, high = F.col("offset"), F.col("offset") + F.col("size")
    rows = plan.placed.where("size > 0").select("doc_id", "h", "source_no", "offset", "size", F.explode(F.sequence(F.floor(low / size), F.floor((high - 1) / size))).alias("block"))
    begin = F.greatest(F.col("block") * size, low)
    return rows.select("*", (begin - low).alias("first"), (F.least((F.col("block") + 1) * size, high) - begin).alias("n"))


def taken_segments(plan: Plan) -> DataFrame:
    """``segments`` of drawn blocks with ``times``, joined to the slots by source and block index."""
    times = plan.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    return segments(plan).join(times, ["source_no", "block"])


def taken_words(docs: DataFrame, mixture: Mixture = Mixture(), **columns: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    plan = planned(docs, mixture, **columns)
    taken = taken_segments(plan).groupBy("source_no", "offset").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    full = plan.placed.where("size > 0").join(taken, ["source_no", "offset"], "left")
    none = plan.placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return full.unionByName(none).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_blocks(docs: DataFrame, mixture: Mixture = Mixture(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: (shard, source_no, slot, block, words), one row per slot, words in stream order."""
    plan = planned(docs, mixture, id_col, text_col, source_col)
    parts = segments(plan).join(_texts(docs, id_col, text_col), (F.col("doc_id").eqNullSafe(F.col("t_id"))) & (F.col("h") == F.col("t_h")))
    parts = parts.select("source_no", "block", "offset", F.slice("words", F.col("first").cast("int") + 1, F.col("n").cast("int")).alias("words"))
    blocks = parts.groupBy("source_no", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "words"))), lambda x: x["words"])).alias("words"))
    return plan.slots.join(blocks, ["source_no", "block"]).select("shard", "source_no", "slot", "block", "words")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return docs.select(F.col(id_col).alias("t_id"), F.xxhash64(text).alias("t_h"), words.alias("words")).dropDuplicates(["t_id", "t_h"])


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def mixed_documents(docs: DataFrame, mixture: Mixture = Mixture()) -> DataFrame:
    """The mix laid back into documents: for each row and pass, the words that the mix takes, as a document.

    Returns the columns of ``documents``; a row taken in two passes gives two rows, one not taken none.
    """
    plan = planned(docs, mixture)
    # The key is never null, so rows made distinct by it are dealt as the join needs them: texts move once.
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")
    got = taken_segments(plan).select(key, "h", "source_no", "offset", F.struct("first", "n", "times").alias("part"))
    got = got.groupBy("key", "h", "source_no", "offset").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.col("text"), "lang", "source", key, F.xxhash64(text).alias("h")).dropDuplicates(["key", "h"])
    both = base.join(got, ["key", "h"])
    both = both.withColumn("words", F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)))
    turn = both.select("*", F.explode(F.sequence(F.lit(1), F.lit(mixture.max_repeats))).alias("turn"))
    chosen = F.flatten(F.transform(F.filter("parts", lambda p: p["times"] >= F.col("turn")), lambda p: F.slice(F.col("words"), p["first"].cast("int") + 1, p["n"].cast("int"))))
    out = turn.select("doc_id", _joined(chosen).alias("text"), "lang", "source").where("text != ''")
    return out.withColumn("n_chars", F.length("text").cast("long"))
