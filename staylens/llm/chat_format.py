"""Chat formatting: typed content parts, a reversible template, and the loss mask.

A turn is a role and an ordered list of typed parts. A visitor flattens the parts of a
turn into text: text parts are escaped, other parts become placeholders whose
attachment and expanded token count are recorded. Turns are formatted row by row; only
the running state of a conversation (counters and digests) passes from row to row, in
sorted order, so a conversation of any length needs no more memory than one turn.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import bound_batches

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
IMAGE, AUDIO, DOCUMENT = "<|image|>", "<|audio|>", "<|document|>"
# Control strings, of this template and of others that a text may carry: escaped in texts.
CONTROLS = (TURN, BODY, END, IMAGE, AUDIO, DOCUMENT, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ANY = "|".join(map(re.escape, CONTROLS))
_ESCAPE = re.compile(rf"\\|{_ANY}")
_UNESCAPE = re.compile(rf"\\(\\|{_ANY})")
_SCAN = re.compile(rf"\\(?:\\|{_ANY})|({_ANY})")

PATCH, TEXT_PER_PAGE, AUDIO_PER_SECOND = 14, 512, 25
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENT = "struct<turn:bigint,at:int,type:string,ref:string,tokens:bigint>"


def escape(text: str) -> str:
    """Put a backslash before every control string and every backslash."""
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def text_part(text: Column) -> Column:
    """A list of one text part, for tables that hold plain turns."""
    nulls = [F.lit(None).alias(n) for n in ("ref", "width", "height", "seconds", "pages")]
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *nulls)).cast(PARTS)


@dataclass
class Flattener:
    """Visits the parts of a turn in order and gathers text, placeholders and attachments."""

    turn: int | None
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part["type"] or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part["text"] or ""))

    def visit_image(self, part: dict) -> None:
        tokens = math.ceil((part["width"] or 0) / PATCH) * math.ceil((part["height"] or 0) / PATCH)
        self._attach(part, IMAGE, tokens)

    def visit_audio(self, part: dict) -> None:
        seconds = part["seconds"] or 0.0
        # a length that is no number, or endless, is unknown
        self._attach(part, AUDIO, math.ceil(seconds * AUDIO_PER_SECOND) if math.isfinite(seconds) else 0)

    def visit_document(self, part: dict) -> None:
        self._attach(part, DOCUMENT, (part["pages"] or 0) * TEXT_PER_PAGE)

    def visit_other(self, part: dict) -> None:
        raise ValueError(f"unknown content part: {part['type']}")

    def _attach(self, part: dict, mark: str, tokens: int) -> None:
        self.attachments.append({
            "turn": self.turn, "at": len(self.attachments), "type": part["type"], "ref": part["ref"], "tokens": max(1, tokens),
        })
        self.pieces.append(mark)


def format_turn(turn: int | None, role: str | None, parts) -> tuple[str, list[dict]]:
    """A turn as text with its attachments; a missing role, list or text is empty."""
    flat = Flattener(turn)
    for part in [] if parts is None else parts:
        if part is not None:
            flat.visit(part if isinstance(part, dict) else part.asDict())
    return f"{TURN}{escape(role or '')}{BODY}{''.join(flat.pieces)}{END}", flat.attachments


def read_turn(formatted: str) -> tuple[str, str, str]:
    """Role, body as it stands (escaped) and body read back, of one formatted turn."""
    marks = [(m.start(), m.end(), m[1]) for m in _SCAN.finditer(formatted) if m[1]]
    if not marks or marks[0][2] != TURN or marks[0][0] or marks[1][2] != BODY or marks[-1][2] != END or marks[-1][1] != len(formatted):
        raise ValueError("not a formatted turn")
    body = formatted[marks[1][1]:marks[-1][0]]
    return unescape(formatted[marks[0][1]:marks[1][0]]), body, unescape(body)


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """Each turn as text: conv, turn, ``formatted``, ``attachments``, ``loss_start``, ``loss_end``.

    Row by row and without a shuffle. The loss mask of a turn is its body when the role
    is ``assistant`` (offsets in code points of ``formatted``), else empty. Rows with a
    missing conversation, turn or role are formatted like others; repeated rows give
    repeated results; other columns are not read. An unknown kind of part is an error.
    """
    bound_batches(turns.sparkSession)
    source = turns.select(*[F.col(f"`{c}`").alias(a) for c, a in ((conv, "conv"), (turn, "turn"), (role, "role"), (parts, "parts"))])
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    source = source.withColumns({"turn": F.col("turn").cast("bigint"), "parts": F.col("parts").cast(PARTS)})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            turn_of = [None if pd.isna(t) else int(t) for t in batch["turn"]]
            done = [format_turn(t, r, p) for t, r, p in zip(turn_of, batch["role"], batch["parts"])]
            start = [len(t) - len(t.partition(BODY)[2]) if r == "assistant" else 0 for (t, _), r in zip(done, batch["role"])]
            end = [len(t) - len(END) if r == "assistant" else 0 for (t, _), r in zip(done, batch["role"])]
            yield pd.DataFrame({
                "conv": batch["conv"], "turn": pd.array(turn_of, "Int64"), "formatted": [t for t, _ in done],
                "attachments": [a for _, a in done], "loss_start": start, "loss_end": end,
            })

    schema = f"conv {kinds['conv']}, turn bigint, formatted string, attachments array<{ATTACHMENT}>, loss_start int, loss_end int"
    return source.mapInPandas(work, schema).withColumnsRenamed({"conv": conv, "turn": turn})


class _Summary:
    """Running state of one conversation, read back from its formatted turns."""

    def __init__(self, conv) -> None:
        self.conv = conv
        self.turns = self.loss_chars = self.chars = self.attachments = self.tokens = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, end: int, attachments: int, tokens: int) -> None:
        role, _, text = read_turn(formatted)
        self.turns += 1
        self.all.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        learned = unescape(formatted[start:end])
        self.loss_chars += len(learned)
        self.loss.update(learned.encode("utf-8", "replace"))
        self.chars += len(formatted)
        self.attachments += attachments
        self.tokens += tokens

    def row(self) -> tuple:
        return (
            self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars,
            self.attachments, self.tokens,
        )


def summarize(formatted: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Counts and digests of each conversation, read back from :func:`format_turns`.

    Turns go in order of ``turn``; a missing turn comes first and ties follow the
    formatted text. The rows of a conversation meet in one task because a digest is
    sequential, but they stream through it in sorted order: the sort spills, and the
    state is a few counters. A missing conversation id is a conversation of its own.
    """
    bound_batches(formatted.sparkSession)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attachment_tokens"]
    source = formatted.select(
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        "formatted", "loss_start", "loss_end",
        F.size("attachments").alias("n"),
        F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]).alias("tokens"),
    )
    kind = source.schema["conv"].dataType.simpleString()
    ordered = source.repartition(F.col("conv")).sortWithinPartitions("conv", "turn", "formatted").drop("turn")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: _Summary | None = None
        for batch in batches:
            done = []
            keys = [None if pd.isna(k) else k for k in batch["conv"]]
            for key, row in zip(keys, batch.itertuples(index=False)):
                if now is None or key != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Summary(key)
                now.add(row.formatted, row.loss_start, row.loss_end, row.n, row.tokens)
            yield frame(done)
        if now is not None:
            yield frame([now.row()])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        if kind in ("bigint", "int"):
            out["conv_id"] = pd.array(out["conv_id"].tolist(), "Int64")
        return out

    schema = (
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, n_attachments bigint, attachment_tokens bigint"
    )
    return ordered.mapInPandas(work, schema).withColumnRenamed("conv_id", conv)
