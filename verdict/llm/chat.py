"""Chat formatting of messages whose content may be typed parts.

A visitor walks the parts of a message in order: text is escaped and kept, an image, audio or document
becomes a placeholder, its reference goes to the attachments, and the tokens it stands for are
counted: images by tiles, audio by time, documents by pages. A turn is written as

    <|turn|>role<|text|>content<|end|>

Control strings inside roles, texts and references are escaped: a backslash goes behind
their first character, behind any backslashes that already stand there, and reading back takes
one away. So the format can be read back exactly, whatever the texts hold, and marks of other
common templates stay text as well.

Turns are formatted row by row, so a conversation of any length is spread over tasks; only its
digest, which has to be made in order, passes through one task as a stream of sorted rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Marks of this format and of other common ones, none of which may appear in a text unescaped.
CONTROLS = (
    TURN, TEXT, END, *PLACEHOLDERS.values(), "<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
TILE = 512
TOKENS_PER_TILE, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 170, 25, 800

_TAILS = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
_PLAIN = re.compile(rf"([<\[])(\\*)({_TAILS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_TAILS})")

PARTS = "array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


@dataclass
class Flattened:
    """Content under construction: escaped pieces, loss spans, attachments, their tokens."""

    pieces: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def add(self, piece: str, loss: bool = False) -> None:
        if loss and piece:
            self.spans.append((self.length, self.length + len(piece)))
        self.pieces.append(piece)
        self.length += len(piece)


class Visitor:
    """One method for each type of part; unknown types raise."""

    def __init__(self, loss: bool):
        self.loss, self.out = loss, Flattened()

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['type']}", self.unknown)(part)

    def unknown(self, part: dict) -> None:
        raise ValueError(f"unknown type of part: {part['type']!r}")

    def visit_text(self, part: dict) -> None:
        self.out.add(escape(part.get("text") or ""), self.loss)

    def attach(self, part: dict, tokens: int) -> None:
        self.out.attachments.append({"type": part["type"], "ref": part.get("ref"), "at": self.out.length, "tokens": tokens})
        self.out.add(PLACEHOLDERS[part["type"]])

    def visit_image(self, part: dict) -> None:
        self.attach(part, math.ceil(max(part.get("width") or 1, 1) / TILE) * math.ceil(max(part.get("height") or 1, 1) / TILE) * TOKENS_PER_TILE)

    def visit_audio(self, part: dict) -> None:
        self.attach(part, math.ceil(max(part.get("seconds") or 0, 0) * TOKENS_PER_SECOND))

    def visit_document(self, part: dict) -> None:
        self.attach(part, max(part.get("pages") or 1, 1) * TOKENS_PER_PAGE)


def format_turn(role: str | None, parts: list[dict], trained: tuple[str, ...] = ("assistant",)) -> Flattened:
    """A turn; the loss covers the text parts of trained roles."""
    visitor = Visitor(role in trained)
    visitor.out.add(f"{TURN}{escape(role or '')}{TEXT}")
    for part in parts:
        visitor.visit(part)
    visitor.out.add(END)
    return visitor.out


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and content of a formatted turn, unescaped; attachments stay placeholders."""
    head, _, rest = formatted.partition(TEXT)
    return unescape(head.removeprefix(TURN)), unescape(rest.removesuffix(END))


_FORMATTED = (
    "conv_id long, turn long, formatted string, loss array<struct<begin: int, end: int>>, "
    "attachments array<struct<type: string, ref: string, at: int, tokens: long>>, attachment_tokens long"
)


def format_turns(messages: DataFrame) -> DataFrame:
    """The formatted turn, its loss spans and attachments for each row (conv_id, turn, role, text or parts).

    ``parts`` is an array of structs such as PARTS; where it is null or missing, the text is the
    only part, and a null text is empty. A null role is empty. Spans count code points
    of the turn. Repeated rows stay repeated. Unknown types of parts raise. Other columns
    are not read.
    """
    parts = F.col("parts").cast(PARTS) if "parts" in messages.columns else F.lit(None).cast(PARTS)
    text = F.col("text").cast("string") if "text" in messages.columns else F.lit(None).cast("string")
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text"), parts.alias("parts"))

    def run(frames):
        for pdf in frames:
            out = []
            for role, text, content in zip(pdf["role"], pdf["text"], pdf["parts"], strict=True):
                given = [{"type": "text", "text": text}] if content is None else [p if isinstance(p, dict) else p.asDict() for p in content]
                out.append(format_turn(role, given))
            yield pd.DataFrame(
                {
                    "conv_id": pdf["conv_id"], "turn": pdf["turn"],
                    "formatted": pd.Series(["".join(f.pieces) for f in out], dtype=object),
                    "loss": pd.Series([[{"begin": a, "end": b} for a, b in f.spans] for f in out], dtype=object),
                    "attachments": pd.Series([f.attachments for f in out], dtype=object),
                    "attachment_tokens": [sum(a["tokens"] for a in f.attachments) for f in out],
                }
            )

    return rows.mapInPandas(run, _FORMATTED)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted turns.

    Turns of a conversation are streamed in order of turn, ties in order of the formatted text; null
    turns come first, and rows of null conv_id are one conversation.
    """

    def run(frames):
        key, state, out = None, None, []

        def close():
            n, all_, loss, chars, total = state
            out.append((key[0], n, all_.hexdigest(), chars, loss.hexdigest(), total))

        for pdf in frames:
            for conv, formatted, spans in zip(pdf["conv_id"], pdf["formatted"], pdf["loss"], strict=True):
                now = (None if pd.isna(conv) else int(conv),)
                if key != now:
                    if key is not None:
                        close()
                    key, state = now, [0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                role, text = read_turn(formatted)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in spans:
                    kept = unescape(formatted[span["begin"] : span["end"]])
                    state[2].update(kept.encode("utf-8", "surrogatepass"))
                    state[3] += len(kept)
                state[4] += len(formatted)
            if out:
                yield _frame(out)
                out = []
        if key is not None:
            close()
            yield _frame(out)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.select("conv_id", "formatted", "loss").mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64", "turns_sha256": object, "loss_sha256": object})
