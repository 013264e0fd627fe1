"""Chat formatting checked by a grammar round trip.

Grammar of the rendered text::

    conversation := turn*
    turn         := "### " role ":\n" body "\n</turn>\n"

``### `` and ``</turn>`` are control strings. Inside a body a run of k >= 1 backslashes before a
control string stands for k - 1 backslashes and the control string as plain text; a bare control
string is never text. In a role a backslash and a line feed are written ``\\\\`` and ``\\n``.

Each turn is rendered plainly first and parsed again. Where the parser does not give back exactly
the source turn, the control string in conflict is escaped and the turn is rendered anew, until
both are identical. Texts without control strings are therefore never changed.

Defined results: null text or role is empty; a null ``conv_id`` is a conversation of its own; rows
of one conversation go by turn (null first), ties by their rendered text, repeated rows are kept;
other columns are ignored; an empty table gives an empty result. Only one turn is held in memory at
a time, so a conversation may be of any length; its hash is a running one and thus the work of one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>"
TRAINED_ROLE = "assistant"
_CONTROL = re.compile(r"(\\*)(### |</turn>)")
_ROLE_ESCAPE = re.compile(r"\\(.)")

PIECES = "conv_id long, turn long, piece string, loss_start long, loss_end long"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class Conflict(ValueError):
    """A control string stands where the grammar allows none."""

    def __init__(self, control: str):
        super().__init__(control)
        self.control = control


def escape(text: str, controls: set[str]) -> str:
    return _CONTROL.sub(lambda m: ("\\" if m[2] in controls else "") + m[0], text) if controls else text


def unescape(body: str) -> str:
    return _CONTROL.sub(lambda m: m[1][1:] + m[2], body)


def parse_turn(text: str, at: int) -> tuple[str, str, int, int, int] | None:
    """Role, text, start and end of the body, end of the turn that starts at ``at``; None if it is not yet complete."""
    line = text.find("\n", at)
    if line < 0:
        return None
    if not text.startswith(HEAD, at) or text[line - 1] != ":":
        raise Conflict(HEAD)
    role = _ROLE_ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text[at + len(HEAD) : line - 1])
    start = line + 1
    for m in _CONTROL.finditer(text, start):
        if m[1]:
            continue
        if m[2] != END or m.start() <= start - 1 or text[m.start() - 1] != "\n" or text[m.end() : m.end() + 1] != "\n" or m.start() - 1 < start:
            raise Conflict(m[2])
        return role, unescape(text[start : m.start() - 1]), start, m.start() - 1, m.end() + 1
    return None


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    turns, at = [], 0
    while at < len(text):
        turn = parse_turn(text, at)
        if turn is None:
            raise Conflict(END)
        turns.append(turn[:2])
        at = turn[4]
    return turns


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn and the span of its body; escapes until the parser recovers the source."""
    head = HEAD + role.replace("\\", "\\\\").replace("\n", "\\n") + ":\n"
    controls: set[str] = set()
    while True:
        body = escape(text, controls)
        piece = f"{head}{body}\n{END}\n"
        try:
            found = None if parse(piece) != [(role, text)] else ""
        except Conflict as conflict:
            found = conflict.control if conflict.control not in controls else None
        if found == "":
            return piece, len(head), len(head) + len(body)
        controls.add(found or next(c for c in (END, HEAD) if c in text and c not in controls))


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles = [r or "" for r in batch.column(2).to_pylist()]
        made = [render_turn(role, text or "") for role, text in zip(roles, batch.column(3).to_pylist(), strict=True)]
        trained = [role == TRAINED_ROLE for role in roles]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.string()),
            pa.array([m[1] if t else None for m, t in zip(made, trained, strict=True)], pa.int64()),
            pa.array([m[2] if t else None for m, t in zip(made, trained, strict=True)], pa.int64()),
        ], names=["conv_id", "turn", "piece", "loss_start", "loss_end"])


def format_conversations(turns: DataFrame) -> DataFrame:
    """One rendered piece per turn; the pieces of a conversation, by turn and piece, are its text.

    ``loss_start`` and ``loss_end`` are code-point offsets in the piece of the text under the loss mask
    (the bodies of assistant turns), null elsewhere.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(_render, PIECES)


class _Reading:
    """Running hashes of the conversation that is being read back."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.buffer = conv_id, ""
        self.turns, self.loss, self.formatted = 0, 0, 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, loss_start: int | None, loss_end: int | None) -> None:
        self.formatted += len(piece)
        self.buffer += piece
        at = 0
        while at < len(self.buffer) and (turn := parse_turn(self.buffer, at)):
            role, text, _, _, at = turn
            self.turns += 1
            self.turns_hash.update(f"{role}\n{text}\n".encode())
        self.buffer = self.buffer[at:]
        if loss_start is not None:
            trained = unescape(piece[loss_start:loss_end])
            self.loss += len(trained)
            self.loss_hash.update(trained.encode())

    def row(self) -> tuple:
        if self.buffer:
            raise Conflict(END)
        return self.conv_id, self.turns, self.turns_hash.hexdigest(), self.loss, self.loss_hash.hexdigest(), self.formatted


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in READ.split(", ")]
    types = [pa.string() if "sha256" in n else pa.int64() for n in names]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    now, rows = None, []
    for batch in batches:
        for conv_id, piece, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
            if now is None or now.conv_id != conv_id:
                rows += [now.row()] if now else []
                now = _Reading(conv_id)
            now.add(piece, start, end)
        if len(rows) >= 1000:
            yield out(rows)
            rows = []
    yield out(rows + ([now.row()] if now else []))


def read_conversations(pieces: DataFrame) -> DataFrame:
    """Parses the rendered pieces again: turns, digests, text under the loss mask of each conversation."""
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece").mapInArrow(_read, READ)
