"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text is cut into pieces at line feeds and after a full stop followed by a space (one-paragraph texts would
else be a single element); empty pieces don't count. Each piece hashes to ``LANES`` words of 64 bits and ``SIGNS``
signs; a fingerprint is the sum of these over all pieces, lanes modulo 2^64, signs modulo 2^32 (a text has
fewer than 2^31 pieces, so its signs never wrap). So it does not
depend on order, and pieces are inserted or deleted by adding or subtracting their sums.

Equality: equal texts, or equal multisets of pieces, have equal fingerprints; others differ but for a collision of
384 bits. Likeness: the sums of signs estimate inner products of the multisets (a tug-of-war sketch), so their cosine
estimates the share of common pieces; it is 1 for equal fingerprints only, and between 0 and 1 else.

Edits: the documents in order of ``doc_id`` (null first, ties by text); each borrows the first quarter-length of
the next, the last of the first. Documents are dealt into ranges whose lower bounds are ids that occur; the first
document of a range goes to the range before it as well, so no task asks for another's rows and only narrow ids
are looked at to find the bounds. The text is shuffled once.

Defined results: null text is empty, its fingerprint the zero sum; two empty texts are alike (1), an empty and another
are not (0); a single document is its own next; repeated rows follow each other; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANES = 6
SIGNS = 128
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Fingerprint:
    """Sums of the hashed pieces; add and subtract to insert and delete pieces."""

    __slots__ = ("lanes", "signs")

    def __init__(self, lanes: np.ndarray, signs: np.ndarray):
        self.lanes, self.signs = lanes, signs

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.lanes + other.lanes, self.signs + other.signs)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.lanes - other.lanes, self.signs - other.signs)

    def hex(self) -> str:
        return (self.lanes.astype("<u8").tobytes() + self.signs.astype("<u4").tobytes()).hex()

    def likeness(self, other: Fingerprint) -> float:
        if (self.lanes == other.lanes).all() and (self.signs == other.signs).all():
            return 1.0
        a, b = self.signs.view(np.int32).astype(float), other.signs.view(np.int32).astype(float)
        norm = float(np.sqrt((a @ a) * (b @ b)))
        return min(max(float(a @ b) / norm, 0.0), 1.0 - 1e-9) if norm else 0.0


def pieces(text: str) -> list[str]:
    return [p for p in text.replace(". ", ".\n").split("\n") if p]


def fingerprint(text: str) -> Fingerprint:
    """The sum over the pieces of a text."""
    parts = pieces(text)
    lanes, signs = np.zeros(LANES, np.uint64), np.zeros(SIGNS, np.uint32)
    for at in range(0, len(parts), 4096):
        some = parts[at : at + 4096]
        rows = np.frombuffer(b"".join([hashlib.blake2b(p.encode(), digest_size=64).digest() for p in some]), dtype=np.uint8).reshape(len(some), 64)
        lanes = lanes + np.ascontiguousarray(rows[:, : 8 * LANES]).view("<u8").sum(0, dtype=np.uint64)
        ones = np.unpackbits(np.ascontiguousarray(rows[:, 8 * LANES :]), axis=1).sum(0, dtype=np.int64)
        signs = signs + (2 * ones - len(some)).astype(np.uint32)
    return Fingerprint(lanes, signs)


def boundary(text: str, end: int) -> int:
    """Start of the last piece whose beginning lies, with what marks it, inside text[:end]."""
    return max(text.rfind("\n", 0, end) + 1, text.rfind(". ", 0, end) + 2 if ". " in text[:end] else 0)


def edited(text: str, following: str) -> tuple[str, int]:
    """The text with its last quarter replaced by as much of the next text, and the length that stays."""
    cut = len(text) - len(text) // 4
    return text[:cut] + following[: len(text) // 4], cut


def edited_fingerprint(text: str, whole: Fingerprint, new: str, cut: int) -> Fingerprint:
    """Deletes the pieces behind the cut and inserts the new ones."""
    start = boundary(text, cut - 1) if cut else 0
    return whole - fingerprint(text[start:]) + fingerprint(new[start:])


def _row(doc_id: int | None, text: str, own: Fingerprint, following: str, other: Fingerprint) -> tuple:
    new, cut = edited(text, following)
    changed = own if new == text else edited_fingerprint(text, own, new, cut)
    return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), own.hex(), changed.hex(), own.likeness(changed), own.likeness(other)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by range, then guests (the first document of the next range), then id: each row meets the one after it."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    now, ended, rows = None, None, []
    for batch in batches:
        for part, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if part == ended:
                continue  # a second guest: the first is the next document
            if guest and (now is None or now[0] != part):
                raise ValueError("a range without documents")
            sums = fingerprint(text)
            if now is not None:
                rows.append(_row(*now[1:], text, sums))
            now = (part, doc_id, text, sums)
            if guest:
                now, ended = None, part
            if len(rows) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
                rows = []
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and its edit, and the likeness to the edit and to the next document."""
    ids = docs.select(F.col("doc_id").cast("long"))
    # as many ranges as the text has input splits: one row per range comes back, the smallest id in it
    splits = docs.rdd.getNumPartitions()
    least = ids.repartitionByRange(splits, "doc_id").groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("low")).collect()
    bounds = np.array(sorted({r["low"] for r in least if r["low"] is not None}), dtype=np.int64)
    count = max(1, len(bounds))
    lows = docs.sparkSession.sparkContext.broadcast(bounds)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(0).to_pylist()
            values = np.array([0 if d is None else d for d in given], dtype=np.int64)
            null = np.array([d is None for d in given], dtype=bool)
            part = np.maximum(np.searchsorted(lows.value, values, side="right") - 1, 0)
            part[null] = 0
            first = np.isin(values, lows.value) & ~null
            if nulls:
                first = np.where(values == (lows.value[0] if len(lows.value) else 0), null, first) | null
            at = np.concatenate([np.arange(len(given)), np.flatnonzero(first)])
            guest = np.arange(len(at)) >= len(given)
            home = np.where(guest, (part[at] - 1) % count, part[at])
            yield pa.RecordBatch.from_arrays([
                pa.array(home.astype(np.int32)), pa.array(guest), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)),
            ], names=["part", "guest", "doc_id", "text"])

    nulls = any(r["low"] is None for r in least) or bool(ids.filter("doc_id IS NULL").take(1))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.mapInArrow(deal, "part int, guest boolean, doc_id long, text string")
    spread = dealt.repartitionById(count, F.col("part")).sortWithinPartitions("part", "guest", "doc_id", "text")
    return spread.mapInArrow(_compare, RESULT)
