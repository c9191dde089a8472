"""SentencePiece encoding and decoding for merge-type vocabularies, checked against the library.

Encoding keeps an agenda of adjacent symbol pairs, highest score first (leftmost of equals), and merges until
no pair of neighbours is a piece; characters without a piece become bytes. As no piece has a word mark after
another character -- checked when the vocabulary is loaded -- merges never cross the start of a word, so a
word's pieces depend on that word alone and are remembered in a table of bounded size in each worker. Short
words keep the agenda as a list of scores beside their symbols, which is then the faster form; longer ones as
a heap.

Ids and decoded text of every whole text are held against the sentencepiece library, in every Arrow batch; a
difference fails the job.

Defined results: a null text is empty, its only id is the end id; malformed UTF-8 is read as replacement
characters; order and repeats of rows are kept; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from landshift.llm.texts import in_arrow

MARK = "▁"
REMEMBERED = 350_000
CHECK_CHARS = 1 << 20
SHORT = 40
_NEVER = float("inf")


class Vocabulary:
    """Pieces, scores and byte pieces of a model file; only these come from the library."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(self.pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.costs = {self.pieces[i]: -sp.get_score(i) for i in plain}
        self.names = [str(i) for i in range(len(self.pieces))]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        self.end, self.unknown = sp.eos_id(), sp.unk_id()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces of this vocabulary reach over word starts")
        self.surface = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]

    def encode(self, symbols: str) -> list[int]:
        """Ids of a normalised string by the agenda."""
        ids = self.ids
        out: list[int] = []
        for p in self._listed(list(symbols)) if len(symbols) <= SHORT else self._heaped(list(symbols)):
            if (i := ids.get(p)) is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in p.encode())
            else:
                out.append(self.unknown)
        return out

    def _listed(self, part: list[str]) -> list[str]:
        """Merged symbols; the agenda is the list of what each pair costs, its least entry the next to merge."""
        cost = self.costs.get
        agenda = [cost(a + b, _NEVER) for a, b in zip(part, part[1:], strict=False)]
        while agenda and (least := min(agenda)) != _NEVER:
            i = agenda.index(least)
            part[i] += part.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(part[i] + part[i + 1], _NEVER)
            if i:
                agenda[i - 1] = cost(part[i - 1] + part[i], _NEVER)
        return part

    def _heaped(self, part: list[str]) -> list[str]:
        """Merged symbols; the agenda is a heap of (cost, place, place of the right neighbour, pair)."""
        costs = self.costs.get
        n = len(part)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(cost, i, i + 1, pair) for i, pair in enumerate(map(str.__add__, part, part[1:])) if (cost := costs(pair)) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, pair = heapq.heappop(agenda)
            # Symbols that were merged since are told by their place or their length.
            if after[left] != right or part[left] + part[right] != pair:
                continue
            part[left], part[right] = pair, ""
            nxt = after[left] = after[right]
            after[right] = -1
            if nxt < n:
                before[nxt] = left
                wide = pair + part[nxt]
                if (cost := costs(wide)) is not None:
                    heapq.heappush(agenda, (cost, left, nxt, wide))
            prev = before[left]
            if prev >= 0:
                wide = part[prev] + pair
                if (cost := costs(wide)) is not None:
                    heapq.heappush(agenda, (cost, prev, left, wide))
        return [p for p in part if p]

    def decode(self, ids: list[int]) -> bytes:
        """The UTF-8 text of ids."""
        out = b"".join(map(self.surface.__getitem__, ids))
        return out[1:] if out[:1] == b" " else out


class _Units(dict):
    """Unit -> its ids as text. A unit is a word with the word marks before it, or without any after a line end."""

    def __init__(self, vocabulary: Vocabulary, mark: str = ""):
        self.vocabulary, self.mark = vocabulary, mark
        self.older: dict[str, str] = {}

    def __missing__(self, unit: str) -> str:
        found = self.older.get(unit)
        if found is None:
            found = " ".join(map(self.vocabulary.names.__getitem__, self.vocabulary.encode(self.mark + unit)))
        if len(unit) <= 64:
            self[unit] = found
        return found

    def age(self, most: int) -> None:
        """At ``most`` units, keep them aside as the older half; those used again come back, others go next time."""
        if len(self) > most:
            self.older = dict(self)
            self.clear()


class Codec:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.vocabulary = Vocabulary(path)
        # Words with one mark before them, by far the most, are kept without it.
        self.words, self.units, self.remembered = _Units(self.vocabulary, MARK), _Units(self.vocabulary), remembered
        self.apart = "\n" not in "".join(self.vocabulary.ids)  # then no merge crosses a line end either
        self.line_end = " ".join(map(str, self.vocabulary.encode("\n")))

    def word_ids(self, text: str) -> list[str]:
        """The ids of each unit of a text, as text."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        self.words.age(self.remembered)
        self.units.age(self.remembered)
        if not self.apart or "\n" not in text:
            return self._line(" " + text)
        first, *rest = text.split("\n")
        out = self._line(" " + first)
        for line in rest:
            out.append(self.line_end)
            if line:
                out += self._line(line)
        return out

    def _line(self, line: str) -> list[str]:
        head, *words = line.split(" ")
        out = [self.units[head]] if head else []
        if "" in words:  # of a run of marks, all but the last stand before the mark of the next word
            marks = ""
            for w in words[:-1]:
                if w:
                    out.append(self.units[marks + MARK + w] if marks else self.words[w])
                    marks = ""
                else:
                    marks += MARK
            out.append(self.units[marks + MARK + words[-1]])
            return out
        out += map(self.words.__getitem__, words)
        return out

    def encode(self, text: str) -> str:
        """All ids, the end id last, joined by one space."""
        return " ".join([*self.word_ids(text), str(self.vocabulary.end)])

    def checked(self, texts: list[str]) -> tuple[list[str], list[list[int]], list[bytes]]:
        """Of each text: ids as text, ids, and the text they decode to; all as the library has them."""
        own, sp = self.vocabulary, self.vocabulary.library
        names = own.names.__getitem__
        ids = [self.encode(t) for t in texts]
        listed = sp.encode(texts, add_eos=True, num_threads=1)
        decoded = []
        for text, mine, their in zip(texts, ids, listed, strict=True):
            if mine != " ".join(map(names, their)):
                raise ValueError(f"ids differ from the library's for a text of {len(text)} characters")
            decoded.append(own.decode(their))
            if decoded[-1] != sp.decode(their).encode():
                raise ValueError(f"decoded text differs from the library's for a text of {len(text)} characters")
        return ids, listed, decoded


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and model file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded."""
    id_type = dict(docs.dtypes)[id_col]
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, held, begin = [], 0, at
                while at < batch.num_rows and (not texts or held < CHECK_CHARS):
                    raw = batch.column(1)[at].as_buffer()
                    texts.append("" if raw is None else _text(raw.to_pybytes()))
                    held += len(texts[-1])
                    at += 1
                ids, listed, decoded = own.checked(texts)
                columns = [batch.column(0).slice(begin, at - begin), pa.array(map(len, listed), pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array(listed, pa.list_(pa.int32())), pa.array([x.decode() for x in decoded])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_arrow(docs.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{text_col}` AS BINARY) AS text"), run, schema)
