"""Conversations to training text with a loss mask, and back.

Rows are dealt out by conversation and sorted by turn; each task formats its conversations one after
the other while it reads, with a compiled template, so the longest conversation needs no more memory
than its longest turn and a part of output. Reading back goes the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.chat_template import BEGIN, END, compile_template, escaper, streams, unescaper
from parlance.llm.common import mapped

#: Marks of a turn, in order, and all strings that texts must not say by themselves.
TURN, TEXT, STOP = "<|turn|>", "<|text|>", "<|end|>"
CONTROLS = (TURN, TEXT, STOP, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
#: What the assistant says is generated; everything else is given.
TEMPLATE = (
    "{% for m in messages %}"
    "{{ '<|turn|>' }}{{ m.role | escape }}{{ '<|text|>' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|end|>' }}{{ '\\n' }}"
    "{% endfor %}"
)
#: Characters after which a part of a conversation's text ends (at the next piece).
PART = 1 << 20

_ROWS = "conv_id long, part int, text string, loss array<struct<start:long,end:long>>"
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _formatted(template: str, controls: tuple[str, ...]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, one_by_one = compile_template(template, {"escape": escaper(controls)}), streams(template, "messages")
        turns = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        held: list[tuple] = []
        size = 0
        for conv_id, own in groupby(turns, key=itemgetter(0)):
            messages = ({"role": role or "", "text": text or "", "content": text or "", "turn": turn} for _, turn, role, text in own)
            part, texts, loss, at, since, begun = 0, [], [], 0, 0, None
            for piece in render({"messages": messages if one_by_one else list(messages)}):
                if piece is BEGIN:
                    begun = at
                elif piece is END:
                    if at > begun:
                        loss.append({"start": begun, "end": at})
                    begun = None
                else:
                    texts.append(piece)
                    at += len(piece)
                    if at - since >= PART:
                        if begun is not None and at > begun:
                            loss.append({"start": begun, "end": at})
                            begun = at
                        held.append((conv_id, part, "".join(texts), loss))
                        size += at - since
                        part, texts, loss, since = part + 1, [], [], at
                        if size >= 4 * PART:
                            yield _batch(held)
                            held, size = [], 0
            held.append((conv_id, part, "".join(texts), loss))
            size += at - since
            if size >= 4 * PART or len(held) >= 20_000:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.string()), pa.array(d, _LOSS)], ["conv_id", "part", "text", "loss"])


def format_conversations(turns: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """conv_id, part, text and loss of each conversation (conv_id, turn, role, text).

    text: the rendered conversation, in parts of about PART characters, mostly one; loss: spans of
    characters of the whole text that are generated. Turns go by turn, then role and text, nulls first;
    a null role or text counts as empty, rows without conv_id are one conversation. No rows, no text. A
    conversation goes through one task, a message at a time; whole in memory only for a template that does more
    with messages than loop over them once.
    """
    narrow = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    dealt = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return mapped(dealt, _formatted(template, controls), _ROWS)


class _Reading:
    """One conversation, read part by part."""

    def __init__(self) -> None:
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self._rest = ""

    def part(self, text: str, loss: list[dict], unescape) -> None:
        for span in loss:
            said = unescape(text[span["start"] - self.chars : span["end"] - self.chars])
            self.loss_chars += len(said)
            self.loss.update(said.encode("utf-8", "surrogatepass"))
        self.chars += len(text)
        text, at = self._rest + text, 0
        while (stop := text.find(STOP, at)) >= 0:
            if not text.startswith(TURN, at):
                raise ValueError(f"no turn at {text[at:at + 20]!r}")
            role, mark, said = text[at + len(TURN) : stop].partition(TEXT)
            if not mark or text[stop + len(STOP) : stop + len(STOP) + 1] not in ("\n", ""):
                raise ValueError("a turn without its text")
            if stop + len(STOP) == len(text):
                break  # its last character comes with the next part
            self.turns += 1
            self.all.update(f"{unescape(role)}\n{unescape(said)}\n".encode("utf-8", "surrogatepass"))
            at = stop + len(STOP) + 1
        self._rest = text[at:]

    def row(self, conv_id: int | None) -> tuple:
        if self._rest:
            raise ValueError(f"text behind the last turn: {self._rest[:20]!r}")
        return conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    unescape, out = unescaper(), []
    parts = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for conv_id, own in groupby(parts, key=itemgetter(0)):
        reading = _Reading()
        for _, _, text, loss in own:
            reading.part(text, loss, unescape)
        out.append(reading.row(conv_id))
        if len(out) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def read_back(formatted: DataFrame) -> DataFrame:
    """What format_conversations() wrote with TEMPLATE, read from text and loss alone.

    conv_id, n_turns, turns_sha256 (of role, line feed, text, line feed for each turn), loss_chars,
    loss_sha256 (of the unescaped text under the loss mask), formatted_chars. The parts of a
    conversation must come together and in order, as they do from format_conversations() or after a
    sort by conv_id and part.
    """
    return mapped(formatted, _read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
