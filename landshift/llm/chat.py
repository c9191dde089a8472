"""Conversations as training text, by a compiled template, and back.

1. Turns are laid out by range of (conversation, turn, role, text) and sorted, so a conversation of any length lies
   in as many partitions as it needs; runs of its turns become parts of about ``part_chars``, numbered in order.
2. A part knows whether it begins and ends its conversation in its partition. Only a conversation that runs over the
   border of two partitions may go on elsewhere; there are fewer of these than partitions, and they are told to all.
3. Each part is rendered by the template's closures on its own: the head goes before the first message, the tail
   after the last. A part has its text and, in code points of that text, the spans under the loss mask.
4. Reading back, each part is parsed at its control strings into turns, and its masked spans are unescaped.
5. Digests run over the parts of a conversation in order. A conversation of one part is digested where it is. SHA-256
   is a chain, so the parts of a longer one pass through one task; they are streamed in sorted order and only the
   state of the hash is held.

Control strings inside roles and texts are escaped: a backslash goes before each control string and before each
backslash. A reader that takes a backslash with the character after it therefore never sees a control string
inside a text, and dropping those backslashes gives the text back.

Defined results: null roles and texts are empty; turns of a conversation go by (turn, role, text), null turns first;
repeated rows are turns of their own; rows without a conversation id form one conversation, whose id is null; an empty table
gives no rows; further columns are ignored; malformed UTF-8 is read as replacement characters.
"""

from __future__ import annotations

import dataclasses
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from landshift.llm.templates import Template, compiled
from landshift.llm.texts import in_arrow
from landshift.sources.shared import written

BEGIN, NAMED, END = "### ", ":\n", "</turn>\n"
SOURCE = (
    "{% for message in messages %}{{ begin }}{{ message.role | escape }}{{ named }}"
    "{% if message.role == trained %}{% generation %}{{ message.text | escape }}{% endgeneration %}{% else %}{{ message.text | escape }}{% endif %}"
    "{{ end }}{% endfor %}"
)


@dataclasses.dataclass(frozen=True)
class ChatFormat:
    """A template and the control strings by which its output is read back: a turn is ``begin`` role ``named`` text ``end``."""

    source: str = SOURCE
    begin: str = BEGIN
    named: str = NAMED
    end: str = END
    trained: str = "assistant"
    part_chars: int = 1 << 16
    part_turns: int = 256

    @property
    def controls(self) -> tuple[str, ...]:
        # The end of a turn is escaped without its line end as well, so a reader may split at either.
        return (self.begin, self.named, self.end.rstrip("\n"))

    def escape(self, text: str) -> str:
        return self._found().sub(r"\\\g<0>", text)

    def _found(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, ("\\", *self.controls))))

    def compiled(self) -> Template:
        found = self._found()
        return compiled(self.source, {"begin": self.begin, "named": self.named, "end": self.end, "trained": self.trained}, {"escape": lambda text: found.sub(r"\\\g<0>", text)})


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def turns(text: str, form: ChatFormat) -> list[tuple[str, str]]:
    """(role, text) of each turn in rendered text."""
    out: list[tuple[str, str]] = []
    role, at = None, 0
    for m in re.finditer(r"\\.|" + "|".join(map(re.escape, (form.begin, form.named, form.end))), text, re.DOTALL):
        sign = m[0]
        if sign == form.begin and role is None:
            at = m.end()
        elif sign == form.named and role is None:
            role, at = unescaped(text[at : m.start()]), m.end()
        elif sign == form.end and role is not None:
            out.append((role, unescaped(text[at : m.start()])))
            role = None
    return out


_PACKED = "conv_id long, part long, first boolean, last boolean, roles array<string>, texts array<string>"
_PART = "conv_id long, part long, first boolean, last boolean, text string, mask array<struct<start:int,end:int>>"
_READ = "conv_id long, part long, first boolean, last boolean, turns array<struct<role:string,text:string>>, loss array<string>, chars long"
_KEYS = ("conv_id", "part", "first", "last")


def packed(conversations: DataFrame, form: ChatFormat, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, part, first, last, roles, texts): turns in order, in parts; numbers of parts ascend within a conversation,
    and first and last tell of its parts in this partition."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    order = ("conv_id", "turn", "role", "text")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[str, str]] = []
        size, conv, first = 0, None, True

        def part(last: bool) -> pa.RecordBatch:
            roles, texts = zip(*held, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip((conv, number, first, last, list(roles), list(texts)), kinds, strict=True)], names=[*_KEYS, "roles", "texts"])

        for batch in batches:
            strings = [[(x or b"").decode("utf-8", "replace") for x in batch.column(c).cast(pa.binary()).to_pylist()] for c in ("role", "text")]
            for own, role, text in zip(batch.column("conv_id").to_pylist(), *strings, strict=True):
                if held and (own != conv or size >= form.part_chars or len(held) >= form.part_turns):
                    yield part(own != conv)
                    number, first = number + 1, own != conv
                    held, size = [], 0
                conv = own
                held.append((role, text))
                size += len(text)
        if held:
            yield part(True)

    return in_arrow(rows.select("conv_id", "role", "text"), run, _PACKED)


def formatted(conversations: DataFrame, form: ChatFormat = ChatFormat(), **columns: str) -> DataFrame:
    """(conv_id, part, first, last, text, mask): the training text in parts, to be joined in their order."""
    parts = written(packed(conversations, form, **columns), "chat-turns")
    ends = parts.groupBy(F.col("conv_id").alias("of")).agg(F.min("part").alias("from"), F.max("part").alias("to"))
    # Fewer rows than partitions: two neighbouring partitions share one conversation at most.
    split = F.broadcast(ends.where(F.shiftright("from", 32) != F.shiftright("to", 32)))
    placed = parts.join(split, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    whole = F.col("from").isNull()
    placed = placed.select("conv_id", "part", F.when(whole, F.col("first")).otherwise(F.col("part") == F.col("from")).alias("first"), F.when(whole, F.col("last")).otherwise(F.col("part") == F.col("to")).alias("last"), "roles", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = form.compiled()
        for batch in batches:
            texts, masks = [], []
            for row in batch.to_pylist():
                texts.append((out := rendered(template, list(zip(row["roles"], row["texts"], strict=True)), row["first"], row["last"])).text())
                masks.append([{"start": s, "end": e} for s, e in out.spans])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*map(batch.column, _KEYS), pa.array(texts, pa.string()), pa.array(masks, kind)], names=[*_KEYS, "text", "mask"])

    return in_arrow(placed, run, _PART)


def rendered(template: Template, messages: list[tuple[str, str]], first: bool, last: bool):
    """A part of a conversation; ``first`` and ``last`` say whether it begins and ends it."""
    from landshift.llm.templates import Output

    out = Output()
    if first:
        template.head(out, {}, False, False)
    for k, (role, text) in enumerate(messages):
        template.message(out, {"role": role, "text": text}, first and k == 0, last and k == len(messages) - 1)
    if last:
        template.tail(out, {}, False, False)
    return out


def read_back(parts: DataFrame, form: ChatFormat = ChatFormat()) -> DataFrame:
    """(conv_id, part, first, last, turns, loss, chars): what each part of formatted text says, from its text and mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, loss, chars = [], [], []
            for text, mask in zip(batch.column("text").to_pylist(), batch.column("mask").to_pylist(), strict=True):
                found.append([{"role": r, "text": t} for r, t in turns(text, form)])
                loss.append([unescaped(text[m["start"] : m["end"]]) for m in mask])
                chars.append(len(text))
            kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([*map(batch.column, _KEYS), pa.array(found, kind), pa.array(loss, pa.list_(pa.string())), pa.array(chars, pa.int64())], names=[*_KEYS, "turns", "loss", "chars"])

    return in_arrow(parts, run, _READ)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(read: DataFrame) -> DataFrame:
    """One row per conversation: its number of turns and digests of its turns and of the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        conv, state, done = None, None, []

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        def close() -> None:
            n, said, chars, loss, size = state
            done.append((conv, n, said.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["first"] or row["conv_id"] != conv:
                    if state is not None:
                        close()
                    conv, state = row["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += len(row["turns"])
                state[1].update("".join(f"{t['role']}\n{t['text']}\n" for t in row["turns"]).encode())
                state[2] += sum(map(len, row["loss"]))
                state[3].update("".join(row["loss"]).encode())
                state[4] += row["chars"]
            if done:
                yield out()
                done = []
        if state is not None:
            close()
            yield out()

    columns = ("conv_id", "part", "first", "turns", "loss", "chars")
    single = F.col("first") & F.col("last")
    # A salt would not help the others: the digest of a conversation is one chain over its text.
    laid = read.where(~single).select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return in_arrow(read.where(single).select(*columns), run, _DIGEST).unionByName(in_arrow(laid, run, _DIGEST))


def chat_report(conversations: DataFrame, form: ChatFormat = ChatFormat(), **columns: str) -> DataFrame:
    """Format all conversations, then read the output back into one row per conversation."""
    output = written(formatted(conversations, form, **columns), "chat-formatted")
    return digests(written(read_back(output, form), "chat-read"))
