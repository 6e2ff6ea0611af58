r"""Chat formatting with typed content parts.

A message is a list of parts: text, image, audio or document. A visitor walks the parts in order: text is
escaped, every other part becomes a numbered placeholder, its reference is recorded as an attachment with
the number of tokens it will take once expanded. Turns read ``<|turn|>role<|text|>body<|end|>``.

All control strings start with ``<|``. Inside roles and texts a backslash is doubled and ``<|`` becomes
``<\|``, so no text can forge a control string and ``unescape`` gives every text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import batches, groups_of, rows_of

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Tokens that one unit of a part expands to: an image tile, a second of audio, a page of a document.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 1200}

_PARTS = "array<struct<kind:string,text:string,ref:string,units:long>>"
RENDERED = (
    "conv_id long, turn long, role string, rendered string, loss array<struct<start:long,end:long>>, "
    "attachments array<struct<ordinal:int,kind:string,ref:string,start:long,tokens:long>>"
)
_PLACEHOLDER = re.compile(r"<\|(?:image|audio|document|other):[0-9]+\|>")
_RENDERED_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*)<\|end\|>", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


@dataclass
class PartVisitor:
    """Flattens the parts of one message; ``pieces`` is the body so far, ``length`` its code points."""

    base: int = 0
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    texts: list[tuple[int, int]] = field(default_factory=list)
    length: int = 0

    def _put(self, piece: str) -> int:
        start = self.base + self.length
        self.pieces.append(piece)
        self.length += len(piece)
        return start

    def visit(self, part: dict) -> None:
        """An unknown kind with a text counts as text, without one as an attachment of kind ``other``."""
        kind = part["kind"] or "text"
        if kind == "text" or (kind not in TOKENS_PER_UNIT and part["text"] is not None):
            self.visit_text(part["text"] or "")
        else:
            self.visit_attachment(kind if kind in TOKENS_PER_UNIT else "other", part["ref"], part["units"])

    def visit_text(self, text: str) -> None:
        body = escape(text)
        start = self._put(body)
        self.texts.append((start, start + len(body)))

    def visit_attachment(self, kind: str, ref: str | None, units: int | None) -> None:
        ordinal = len(self.attachments)
        start = self._put(f"<|{kind}:{ordinal}|>")
        tokens = TOKENS_PER_UNIT.get(kind, 1) * max(1, units or 1)
        self.attachments.append({"ordinal": ordinal, "kind": kind, "ref": ref or "", "start": start, "tokens": tokens})


def render_turn(role: str | None, parts: list[dict] | None, learn_from: str = "assistant") -> tuple[str, list[dict], list[dict]]:
    """The turn's text, the spans under the loss mask (its texts, if its role is ``learn_from``), its attachments."""
    head = f"{TURN}{escape(role or '')}{TEXT}"
    visitor = PartVisitor(base=len(head))
    for part in parts or []:
        if part is not None:
            visitor.visit(part)
    loss = [{"start": a, "end": b} for a, b in visitor.texts] if role == learn_from else []
    return head + "".join(visitor.pieces) + END, loss, visitor.attachments


def text_part(text: Column) -> Column:
    """A plain text column as a list of one text part; null text: one empty part."""
    none = F.lit(None)
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), none.alias("ref"), none.alias("units"))
    return F.array(part).cast(_PARTS)


def format_turns(messages: DataFrame, parts: str = "parts", learn_from: str = "assistant") -> DataFrame:
    """One row per message: ``rendered``, loss spans and attachments, offsets in code points of ``rendered``.

    Reads conv_id, turn, role and ``parts``; other columns are left out. Row-local, so a conversation of any
    length costs no gathering. Null role: empty; null parts or null in them: nothing; repeated rows stay.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for conv, turn, role, items in rows_of(frames):
                yield conv, turn, role, *render_turn(role, items, learn_from)

        yield from batches(rows(), _RENDERED_ARROW)

    chosen = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.col(parts).cast(_PARTS).alias("parts"),
    )
    return chosen.mapInArrow(run, RENDERED)


_RENDERED_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("rendered", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("attachments", pa.list_(pa.struct([("ordinal", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("start", pa.int64()), ("tokens", pa.int64())]))),
])


def parse_turn(rendered: str) -> tuple[str, str]:
    """Role and text of a rendered turn, placeholders left out."""
    found = _RENDERED_TURN.fullmatch(rendered)
    if found is None:
        raise ValueError("not a rendered turn")
    return unescape(found[1]), unescape(_PLACEHOLDER.sub("", found[2]))


_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_attachments", pa.int64()), ("attachment_tokens", pa.int64()),
])


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, all read back from the rendered text and its loss spans.

    Turns are taken by (turn, role, rendered), nulls first; rows without conv_id form one conversation. A
    conversation streams through its task turn by turn into running digests, so its length costs no memory.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (conv,), members in groups_of(rows_of(frames)):
                turns, learned = hashlib.sha256(), hashlib.sha256()
                n = loss_chars = chars = attached = tokens = 0
                for _, rendered, loss, attachments in members:
                    role, text = parse_turn(rendered)
                    turns.update(f"{role}\n{text}\n".encode())
                    for span in loss:
                        part = unescape(rendered[span["start"] : span["end"]])
                        learned.update(part.encode())
                        loss_chars += len(part)
                    n, chars, attached = n + 1, chars + len(rendered), attached + len(attachments)
                    tokens += sum(a["tokens"] for a in attachments)
                yield conv, n, turns.hexdigest(), loss_chars, learned.hexdigest(), chars, attached, tokens

        yield from batches(rows(), _DIGEST)

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "rendered")
    return dealt.select("conv_id", "rendered", "loss", "attachments").mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
        "n_attachments long, attachment_tokens long",
    )
