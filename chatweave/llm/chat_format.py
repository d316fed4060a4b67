"""Chat formatting (operator 3): typed content parts become one text with a loss mask.

A conversation is formatted turn by turn into pieces; the formatted text is its pieces in order.
A visitor flattens the parts of a turn: text is escaped, an image, audio or document part becomes
a placeholder, is listed as an attachment and counts as many tokens as it will be expanded to.

    <turn assistant>\\n escaped text and <image 0> placeholders </turn>\\n

All marks begin with ``<``, and inside texts and roles ``\\`` and ``<`` get a backslash in front
(in roles also ``>`` and the line break), so any text comes back unchanged.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatweave.llm.common import ship_package

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PIECE_SCHEMA = (
    "conv_id long, turn long, piece string, loss_start int, loss_length int, "
    "attachments array<struct<place:int,kind:string,ref:string,tokens:long>>, media_tokens long"
)
_ROLE_ESCAPES = {"\\": "\\\\", "<": "\\<", ">": "\\>", "\n": "\\n"}
_PIECE = re.compile(r"<turn ((?:[^\\<>\n]|\\.)*)>\n((?:[^\\<]|\\.|<(?:image|audio|document) \d+>)*)</turn>\n", re.S)
_MARK = re.compile(r"\\(.)|<(?:image|audio|document) \d+>", re.S)


@dataclass(frozen=True)
class TokenCosts:
    """Tokens that a placeholder stands for."""

    image_patch: int = 14
    image_default: int = 256
    audio_per_second: float = 25.0
    document_per_page: int = 512


@dataclass
class PartVisitor:
    """Visits the parts of one turn in order and gathers text, attachments and token counts."""

    costs: TokenCosts
    out: list[str] = field(default_factory=list)
    attachments: list[tuple[int, str, str | None, int]] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = (part.get("type") or "text").lower()
        getattr(self, f"visit_{kind}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        width, height, patch = part.get("width"), part.get("height"), self.costs.image_patch
        known = _is_number(width) and _is_number(height)
        self._attach("image", part, math.ceil(width / patch) * math.ceil(height / patch) if known else self.costs.image_default)

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds")
        self._attach("audio", part, math.ceil(seconds * self.costs.audio_per_second) if _is_number(seconds) else 0)

    def visit_document(self, part: dict) -> None:
        pages = part.get("pages")
        self._attach("document", part, int(pages) * self.costs.document_per_page if _is_number(pages) else 0)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.out.append(f"<{kind} {len(self.attachments)}>")
        self.attachments.append((len(self.attachments), kind, part.get("ref"), tokens))


def _is_number(x: object) -> bool:
    return x is not None and not math.isnan(x)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str) -> str:
    """The text without placeholders and escapes."""
    if "\\" not in text and "<" not in text:
        return text
    return _MARK.sub(lambda m: m[1] or "", text)


def _escape_role(role: str) -> str:
    return "".join(_ROLE_ESCAPES.get(c, c) for c in role)


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def format_turns(turns: DataFrame, costs: TokenCosts = TokenCosts(), loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Formatted pieces (``PIECE_SCHEMA``) of ``turns`` (conv_id, turn, role, parts array of ``PART``).

    ``loss_start`` and ``loss_length`` give the part of the piece that the loss covers, length 0
    for other roles. Null parts: no text. Null role: empty role. A part of an unknown type is read
    as text. Repeated turns stay, each as a piece; pieces of one (conv_id, turn) are in the order of
    their text. Other columns are ignored.
    """
    ship_package(turns.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, turn, role, parts in zip(batch["conv_id"], batch["turn"], batch["role"], batch["parts"], strict=True):
                visitor = PartVisitor(costs)
                for part in parts if parts is not None else ():
                    if part is not None:
                        visitor.visit(part)
                role, body = role or "", "".join(visitor.out)
                head = f"<turn {_escape_role(role)}>\n"
                rows.append((
                    conv, turn, f"{head}{body}</turn>\n", len(head), len(body) if role in loss_roles else 0,
                    [dict(zip(("place", "kind", "ref", "tokens"), a, strict=True)) for a in visitor.attachments],
                    sum(a[3] for a in visitor.attachments),
                ))
            out = pd.DataFrame(rows, columns=["conv_id", "turn", "piece", "loss_start", "loss_length", "attachments", "media_tokens"])
            out[["conv_id", "turn"]] = out[["conv_id", "turn"]].astype("Int64")
            yield out

    return turns.select("conv_id", "turn", "role", "parts").mapInPandas(run, PIECE_SCHEMA)


def parse_piece(piece: str) -> tuple[str, str]:
    """(role, text without placeholders) of a formatted piece."""
    found = _PIECE.fullmatch(piece)
    if not found:
        raise ValueError(f"not a formatted turn: {piece[:80]!r}")
    return _unescape_role(found[1]), unescape(found[2])


class _Reader:
    """Running digests of one conversation: its pieces are never held together."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = self.n_attachments = self.media_tokens = 0

    def add(self, piece: str, start: int, length: int, attachments: int, tokens: int) -> None:
        role, text = parse_piece(piece)
        self.turns.update(f"{role}\n{text}\n".encode())
        under_loss = unescape(piece[start : start + length])
        self.loss.update(under_loss.encode())
        self.n_turns += 1
        self.loss_chars += len(under_loss)
        self.formatted_chars += len(piece)
        self.n_attachments += attachments
        self.media_tokens += tokens

    def row(self, conv: int | None) -> tuple:
        return (
            conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
            self.formatted_chars, self.n_attachments, self.media_tokens,
        )


DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, n_attachments long, media_tokens long"
)


def read_back(pieces: DataFrame) -> DataFrame:
    """One row per conversation, read from its formatted pieces alone (``DIGEST_SCHEMA``).

    Pieces stream through in order and only running digests are kept, so a conversation of any
    length takes constant memory. A null conv_id counts as one conversation.
    """
    ship_package(pieces.sparkSession)
    names = [c.split(" ")[0] for c in DIGEST_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})

        now, reader = None, None
        for batch in batches:
            done = []
            conv = batch["conv_id"].astype("Int64")
            for c, *rest in zip(conv, batch["piece"], batch["loss_start"], batch["loss_length"], batch["n"], batch["media_tokens"], strict=True):
                c = None if c is pd.NA else int(c)
                if reader is None or c != now:
                    if reader is not None:
                        done.append(reader.row(now))
                    now, reader = c, _Reader()
                reader.add(*rest)
            if done:
                yield frame(done)
        if reader is not None:
            yield frame([reader.row(now)])

    return (
        pieces.select("conv_id", "turn", "piece", "loss_start", "loss_length", F.size("attachments").alias("n"), "media_tokens")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "piece")
        .mapInPandas(run, DIGEST_SCHEMA)
    )
