"""Operator 4: chat formatting, by event-sourced reconstruction.

A log has one row an event: (conv_id, seq, event, role, text, target). Events are
`message` (a whole message), `start` (an empty one), `delta` (text added to the message open since the last
message or start), `edit` (new text of message number `target`, null: the last one; messages after it go, as a
user's edit of an earlier turn makes them stale) and `regenerate` (the last assistant message is dropped and opened anew;
deltas that follow fill it). Logs are dealt by conversation, sorted by sequence, and folded as they stream by.

Rendering: a turn is `<|im_start|>role`, a line feed, its text, `<|im_end|>` and a line feed. Control strings of this and of common
other templates that occur inside a text or role get a backslash after their first character, and a backslash there gets another, so the text can be read
back exactly. The loss mask holds the spans (start, end in code points) of assistant texts.

A conversation's events are folded in one task, since each depends on those before; that task holds its messages
only (and streaming them past needs no more than the open one when `edit` and `regenerate` are absent). Null text
is empty, null role is "user", null event is `message`; rows of null conv_id are one conversation. Events of equal sequence go by event, role, text, then target; repeated
rows count each. Conversations without messages give no row, nor does an empty log; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.common import in_slices, table

#: Control strings that texts must not be able to form, our own first.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "<unk>", "<pad>")
START, END = CONTROLS[:2]
_CONTROL = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROLS))
_TURN = re.compile(re.escape(START) + "([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    """A backslash more after the first character of each control string, or of what would read as an escaped one."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """What escape() was given."""
    return _CONTROL.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def _role(role: str | None) -> str:
    return (role if role is not None else "user").replace("\\", "\\\\").replace("\n", "\\n")


def _role_back(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


@dataclass
class Fold:
    """The messages of one conversation, as its events arrive in order."""

    messages: list[list] = field(default_factory=list)

    def take(self, event: str | None, role: str | None, text: str | None, target: int | None) -> None:
        text, event = text or "", event or "message"
        if event in ("message", "start"):
            self.messages.append([role, [text] if event == "message" else []])
        elif event == "delta":
            if not self.messages:
                self.messages.append([role, []])
            self.messages[-1][1].append(text)
        elif event == "edit":
            k = len(self.messages) - 1 if target is None else target
            if 0 <= k < len(self.messages):
                self.messages[k][1] = [text]
                del self.messages[k + 1 :]
        elif event == "regenerate":
            k = max((i for i, m in enumerate(self.messages) if m[0] == "assistant"), default=None)
            if k is not None:
                del self.messages[k:]
                self.messages.append(["assistant", [text] if text else []])
        else:
            raise ValueError(f"unknown event {event!r}")

    def final(self) -> list[tuple[str | None, str]]:
        return [(r, "".join(t)) for r, t in self.messages]


def render(messages: list[tuple[str | None, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask."""
    out, mask, at = [], [], 0
    for role, text in messages:
        head, body = f"{START}{escape(_role(role))}\n", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(_role_back(unescape(m[1])), unescape(m[2])) for m in _TURN.finditer(formatted)]


_FORMATTED = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def format_log(log: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) of each conversation of the log."""
    keys = ["conv_id", "seq", "event", "role", "text", "target"]
    have = [F.col(c) if c in log.columns else F.lit(None).alias(c) for c in keys]
    kinds = {"conv_id": "long", "seq": "long", "target": "int"}
    log = log.select(*have).select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in keys))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, rows, held, some = None, Fold(), [], 0, False

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows, held
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FORMATTED.types)], schema=_FORMATTED)
            rows, held = [], 0

        def close() -> None:
            nonlocal held
            if some and state.messages:
                text, mask = render(state.final())
                rows.append((conv, text, [{"start": a, "end": b} for a, b in mask]))
                held += len(text)

        for batch in in_slices(batches, "text"):
            for c, event, role, text, target in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "event", "role", "text", "target"))):
                if not some or c != conv:
                    close()
                    conv, state, some = c, Fold(), True
                    if held > 1 << 22:
                        yield from flush()
                state.take(event, role, text, target)
        close()
        yield from flush()

    dealt = log.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "event", "role", "text", "target")
    return dealt.mapInArrow(folded, "conv_id long, formatted string, loss_mask array<struct<start: long, end: long>>")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations and their loss masks say, read back from them."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "formatted"):
            rows = []
            for conv, text, mask in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_mask"))):
                turns = read_back(text)
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_log(turns: DataFrame) -> DataFrame:
    """The log by which conversations (conv_id, turn, role, text) may have come about: an assistant's turn is begun with a draft, regenerated, and streamed in two deltas; others are sent with a draft and edited.

    format_log() folds it back to the turns. Turns of equal number go by role, then text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    draft = F.concat(F.lit("draft: "), F.reverse("text"))
    event = lambda kind, role=None, text=None: F.struct(F.lit(kind).alias("event"), (F.lit(None).cast("string") if role is None else role).alias("role"), (F.lit(None).cast("string") if text is None else text).alias("text"))
    said = F.array(event("start", F.col("role")), event("delta", None, draft), event("regenerate"), event("delta", None, F.substring("text", F.lit(1), half)), event("delta", None, F.substring("text", half + 1, F.length("text"))))
    sent = F.array(event("message", F.col("role"), draft), event("edit", None, F.col("text")))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.row_number().over(order))
    rows = rows.select("conv_id", "n", F.posexplode(F.when(F.col("role") == "assistant", said).otherwise(sent)).alias("k", "e"))
    return rows.select("conv_id", (F.col("n") * 8 + F.col("k")).cast("long").alias("seq"), "e.event", "e.role", "e.text")


def op4_chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return conversation_digests(format_log(as_log(turns.unionByName(more))))
