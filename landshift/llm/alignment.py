"""Alignment of two tokenizers: which tokens of one lie over which tokens of the other, corpus-wide.

1. Texts are cut into units where neither tokenizer's tokens can cross: before a space or line end that follows
   another character. A unit's tokens depend on the unit alone, so each worker remembers units.
2. Tokens of a unit are the nodes of a bipartite graph, overlaps of byte ranges its links. Union-find over many
   units at once (the larger root is hooked to the smaller, then all paths are shortened) gives its connected components: the
   minimal groups of tokens that cover the same bytes. Members of a component expand to its links.
3. Each document keeps its distinct linked id pairs and how often each occurs. Pairs are counted over documents,
   first in each Arrow batch, then by Spark; the largest count of each A id is a maximum over the pairs.
4. Each document looks its pairs up. Pairs of at least a ``FREQUENT``-th of all (document, pair) rows, of which
   there can be at most ``FREQUENT`` whatever the corpus, are broadcast; the others are joined by pair, and as each
   of them makes up less than that share of the rows, no key is hot.

Defined results: null and empty texts, and texts that either tokenizer does not give back byte for byte, have no
tokens: zeros and an empty string. Repeated rows count as documents of their own; ties for the highest count are all
best; malformed UTF-8 is read as replacement characters; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.llm.texts import in_arrow
from landshift.sources.shared import written

MARK = "▁"
#: Whitespace and what follows it, on to the next space or line end after another character.
UNIT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+")
FREQUENT = 1 << 19
REMEMBERED = 500_000
REMEMBERED_CHARS = 64
SLICE_CHARS = 2 << 20
#: Units encoded as one text.
JOINED = 2000


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node connected to each of ``n`` nodes by links (u, v), by union-find over all links at a time."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(shorter := root[root], root):
            root = shorter


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (A token, B token) between tokens that end at these bytes of the same text, in order.

    Every stretch between two neighbouring ends lies in one token of each side, and no two stretches in the same two."""
    stretch = np.sort(np.append(ends_a, ends_b))
    stretch = stretch[np.append(True, stretch[1:] != stretch[:-1])[: len(stretch)]]
    return np.searchsorted(ends_a, stretch), np.searchsorted(ends_b, stretch)


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        # The alphabet of byte-level pieces: printable bytes stand for themselves, the others follow from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
        assert set(byte_of) == set(pre_tokenizers.ByteLevel.alphabet())
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.mark = b.piece_to_id(MARK)
        text = [p for i, p in enumerate(pieces) if not (b.is_byte(i) or b.is_control(i) or b.is_unknown(i))]
        #: Whether no piece reaches over the start of a unit.
        self.cuts = not any("\n" in p or MARK in p.lstrip(MARK) for p in text)
        self.kinds_b = len(pieces)
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        if len(self.bytes_a) * self.kinds_b >= 1 << 31:
            raise ValueError("a pair of ids has to fit in 31 bits")

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B, and how many each unit has; units that do not come back byte for byte have none.

        Units that end in a character join to a text in which each of them is a unit again, so many are encoded at a
        time. Where a text is not given back, or a unit ends in whitespace, its halves are encoded, down to single units."""
        done: list[tuple[tuple[np.ndarray, np.ndarray], np.ndarray]] = []
        todo = [units[low : low + JOINED] for low in range(0, len(units), JOINED)][::-1]
        while todo:
            part = todo.pop()
            joins = len(part) == 1 or not any(u[-1].isspace() for u in part)
            if joins and (got := self._together(part)):
                done.append(got)
            elif len(part) == 1:
                done.append(((np.zeros(0, np.int64),) * 2, np.zeros((2, 1), np.int64)))
            else:
                todo += [part[len(part) // 2 :], part[: len(part) // 2]]
        a, b = (np.concatenate([np.zeros(0, np.int64), *[ids[side] for ids, _ in done]]) for side in (0, 1))
        n_a, n_b = np.concatenate([np.zeros((2, 0), np.int64), *[counts for _, counts in done]], axis=1)
        return a, b, n_a, n_b

    def _together(self, units: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray] | None:
        """Ids of units as one text, and how many belong to each unit; None unless every unit comes back."""
        text = "".join(units)
        raw = text.encode()
        until = np.cumsum([len(u.encode()) for u in units]) if len(raw) != len(text) else np.cumsum([len(u) for u in units])
        # B puts a space of its own in front, which replaces that of the unit; without one it is taken away.
        own = text[0] == " "
        b = self.b.encode(text[1:] if own else text, num_threads=1)
        if len(text) == 1 and own:  # B adds nothing to an empty string
            b = [self.mark]
        if not own:
            if b[:1] != [self.mark]:
                return None
            b = b[1:]
        both, counts = [], []
        for ids, table, length in ((self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.bytes_a, self.length_a), (b, self.bytes_b, self.length_b)):
            if b"".join(map(table.__getitem__, ids)) != raw:
                return None
            both.append(np.array(ids, np.int64))
            place = np.searchsorted(np.cumsum(length[both[-1]]), until, "right")
            counts.append(np.diff(place, prepend=0))
        return (both[0], both[1]), np.stack(counts)


class Aligner:
    """Units and what is known of each: tokens, groups, links."""

    def __init__(self, path_a: str, path_b: str, remembered: int = REMEMBERED):
        self.tokens = Tokenizers(path_a, path_b)
        self.remembered = remembered
        names = [str(i) for i in range(max(len(self.tokens.bytes_a), self.tokens.kinds_b))]
        #: Ids with what follows them: within a side of a group, at the end of A's side, at the end of a group.
        self.names = np.array([n + mark for mark in ",|;" for n in names], object)
        self.many = len(names)
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 5), np.int64)  # A tokens, B tokens, groups, links, whether both give the bytes back
        self.keys = np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int64)

    def units(self, text: str) -> list[str]:
        text = " " + text
        return UNIT.findall(text) if self.tokens.cuts else [text]

    def learn(self, units: list[str]) -> None:
        """Add units that are not known yet."""
        ids_a, ids_b, n_a, n_b = self.tokens.encode(units)
        ends_a, ends_b = np.cumsum(self.tokens.length_a[ids_a]), np.cumsum(self.tokens.length_b[ids_b])
        i, j = overlaps(ends_a, ends_b)
        root = roots(len(ids_a) + len(ids_b), i, len(ids_a) + j)
        # Tokens by group, A's side first; the end of each side is where the next token is of another one.
        side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
        order = np.lexsort((side, root))
        group, side, ids = root[order], side[order], np.append(ids_a, ids_b)[order]
        closes = np.append(group[1:] != group[:-1], True)[: len(group)]
        turns = np.append(side[1:] != side[:-1], True)[: len(side)]
        shown = self.names[ids + self.many * np.where(closes, 2, np.where(turns, 1, 0))].tolist()
        unit_a, unit_b = np.repeat(np.arange(len(units)), n_a), np.repeat(np.arange(len(units)), n_b)
        unit = np.append(unit_a, unit_b)[order]
        n_groups = np.bincount(unit[closes], minlength=len(units))
        n_links = np.bincount(unit_a[i], minlength=len(units))
        until = np.cumsum(n_a + n_b).tolist()
        start = 0
        for k, end in enumerate(until):
            self.at[units[k]] = len(self.groups)
            self.groups.append("".join(shown[start:end]))
            start = end
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, n_groups, n_links, n_a > 0], axis=1)])
        self.keys = np.append(self.keys, (ids_a[i] * self.tokens.kinds_b + ids_b[j]).astype(np.int32))
        self.first = np.append(self.first, self.first[-1] + np.cumsum(n_links))

    def align(self, texts: list[str]) -> dict[str, pa.Array]:
        """For each text its sizes, the digest of its groups, and its distinct linked pairs with how often each occurs."""
        if len(self.at) > self.remembered:
            self._forget()
        found = [self.units(t) if t else [] for t in texts]
        new = [u for u in set(chain.from_iterable(found)) if u not in self.at]
        # Long units are not worth remembering: they come last and are taken out again.
        new.sort(key=lambda u: len(u) > REMEMBERED_CHARS)
        for k in range(0, len(new), 20_000):
            self.learn(new[k : k + 20_000])
        counts = np.fromiter(map(len, found), np.int64, len(found))
        places = list(map(self.at.__getitem__, chain.from_iterable(found)))
        entries = np.array(places, np.int64)
        doc = np.repeat(np.arange(len(texts)), counts)
        bad = np.zeros(len(texts), bool)
        bad[doc[self.sizes[entries, 4] == 0]] = True
        keep = ~bad[doc]
        entries, doc = entries[keep], doc[keep]
        sizes = np.stack([np.bincount(doc, weights=self.sizes[entries, c], minlength=len(texts)) for c in range(4)], axis=1).astype(np.int64)
        until = np.cumsum(counts).tolist()
        shown = self.groups.__getitem__
        digests = [hashlib.sha256("".join(map(shown, places[low:high]))[:-1].encode()).hexdigest() if low < high and not gone else "" for low, high, gone in zip([0, *until], until, bad, strict=False)]
        n = self.first[entries + 1] - self.first[entries]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[entries], n)
        every = np.sort((np.repeat(doc, n) << 31) | self.keys[place])
        begin = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
        pairs, times = every[begin], np.diff(np.append(begin, len(every)))
        offsets = np.searchsorted(pairs >> 31, np.arange(len(texts) + 1)).astype(np.int32)
        for k, u in enumerate(reversed(new)):
            if len(u) <= REMEMBERED_CHARS:
                break
            del self.at[u]
        else:
            k = len(new)
        if new and k:
            self.groups = self.groups[:-k]
            self.sizes, self.first = self.sizes[:-k], self.first[:-k]
            self.keys = self.keys[: self.first[-1]]
        lists = lambda values: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))
        named = {name: pa.array(sizes[:, c]) for c, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
        return named | {"groups_sha256": pa.array(digests, pa.string()), "pairs": lists(pairs & ((1 << 31) - 1)), "times": lists(times)}


_KNOWN: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of this worker, which keeps what it remembers between tasks."""
    if (path_a, path_b) not in _KNOWN:
        _KNOWN[path_a, path_b] = Aligner(path_a, path_b)
    return _KNOWN[path_a, path_b]


def _text(value: bytes | None) -> str:
    return (value or b"").decode("utf-8", "replace")


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``SLICE_CHARS`` together."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > SLICE_CHARS:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


_LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


def linked(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's sizes, groups and distinct linked pairs (A id times the size of B's vocabulary, plus B id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in batches:
            ids = batch.column("doc_id")
            texts = [_text(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for low, high in _parts(texts):
                found = own.align(texts[low:high])
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), *found.values()], names=["doc_id", *found])

    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, _LINKED)


def pair_counts(rows: DataFrame, kinds_b: int) -> DataFrame:
    """(pair, n, best): how many documents hold each pair, and whether no pair of the same A id is in more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n = np.unique(pc.list_flatten(batch.column("pairs")).to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int32)), pa.array(n.astype(np.int64))], names=["pair", "n"])

    counts = written(in_arrow(rows.select("pairs"), run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    a = F.floor(F.col("pair") / kinds_b).alias("a")
    # A row for each id of A's vocabulary at most, so its size is bounded by that.
    top = F.broadcast(counts.groupBy(a).agg(F.max("n").alias("most")))
    return counts.withColumn("a", a).join(top, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


_SCORED = "row long, pair int, times long, n_best long, count_sum long"


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    rows = written(linked(docs, path_a, path_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "linked-texts")
    kinds_b = len(Tokenizers(path_a, path_b).bytes_b)
    counts = written(pair_counts(rows, kinds_b), "linked-pairs")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where(F.col("n") * frequent >= total).orderBy("pair").toArrow()
    held = spark.sparkContext.broadcast(tuple(often.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = held.value
        for batch in batches:
            pairs, times = (pc.list_flatten(batch.column(c)).to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            row = np.repeat(batch.column("row").to_numpy(), pc.list_value_length(batch.column("pairs")).to_numpy())
            place = np.searchsorted(known, pairs)
            there = place < len(known)
            there[there] = known[place[there]] == pairs[there]
            at, often = place[there], times[there].astype(np.int64)
            begin = np.flatnonzero(np.append(True, row[there][1:] != row[there][:-1])) if len(at) else np.zeros(0, np.int64)
            sums = [np.add.reduceat(x, begin) if len(at) else x for x in (often * best[at], often * n[at])]
            rare = len(pairs) - len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(row[there][begin], row[~there])),
                    pa.concat_arrays([pa.nulls(len(begin), pa.int32()), pa.array(pairs[~there])]),
                    pa.array(np.append(np.zeros(len(begin), np.int64), times[~there])),
                    *(pa.array(np.append(x, np.zeros(rare, np.int64))) for x in sums),
                ],
                names=["row", "pair", "times", "n_best", "count_sum"],
            )

    scored = written(in_arrow(rows.select("row", "pairs", "times"), run, _SCORED), "linked-scores")
    rare = scored.where("pair IS NOT NULL").select("row", "pair", "times").join(counts, "pair")
    rare = rare.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    sums = scored.where("pair IS NULL").select("row", "n_best", "count_sum").unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return rows.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
