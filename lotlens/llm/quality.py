"""Quality rules: text rules, then the log-likelihood ratio of hashed n-grams between trusted documents and the raw corpus.

Words are runs of characters other than ASCII white space. A word's hash is the first 32 bits of the MD5 of its UTF-8; a word falls into
bucket hash mod ``BUCKETS``, two neighbouring words into (31 * hash + next hash) mod ``BUCKETS``. The raw multinomial counts the buckets of all
documents, the target one those of trusted documents; both add one to each bucket. A bucket weighs the logarithm of the ratio of its two
probabilities in whole millionths, and a document scores the sum over its n-grams divided by their number, rounded down: whole numbers only,
so that no order of adding changes a verdict.

Trusted: documents that a label calls good (quality 1) and none calls bad or toxic, all of them. Those whose id has an MD5 below "8" make the target multinomial, the others set the threshold: the score that all but a
share ``LOSS`` of them reach, of those that pass the text rules. So the threshold is held out from the counts. No such document: no threshold, and the rules alone decide.

A document fails the text rules with fewer than ``LEAST_WORDS`` words or with over half of them in repeated windows of three words. It is kept
if it passes them and scores the threshold or more. All statistics are over all documents and whole texts; nothing is drawn by chance.

Memory: one document and ``BUCKETS`` counts per task; the driver holds the counts, and numbers of scores by steps of ``STEP`` and within one step.

Defined results: null text has no words and fails; repeated rows count as often as they occur and each give a row; null ids are never trusted; labels of ids that no
document has, or with null quality, do nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.operators.relational import checked_broadcast
from lotlens.session import stored

BUCKETS = 1 << 16
LOSS = 0.001
LEAST_WORDS = 50
#: The characters that count as symbols, a fixed value.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MICRO = 1_000_000
#: Scores lie within 50 million of 0, so they fall into some 12,000 steps.
STEP = 1 << 12
KNOWN_WORDS = 200_000
RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score long"


class Hashes(dict):
    """MD5 hashes of words; a task remembers ``KNOWN_WORDS`` of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = int.from_bytes(hashlib.md5(word).digest()[:4], "big")
        return value


def buckets(hashes: np.ndarray) -> np.ndarray:
    """The buckets of all words and of all neighbouring pairs."""
    return np.concatenate([hashes, 31 * hashes[:-1] + hashes[1:]]) % BUCKETS


def repeated_words(hashes: np.ndarray, words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more."""
    if len(words) < 4:
        return 0
    # hashes pick the candidates, words decide
    mixed = (hashes[:-2] * 0x9E3779B1 + hashes[1:-1]) * 0x85EBCA77 + hashes[2:]
    _, place, count = np.unique(mixed, return_inverse=True, return_counts=True)
    rows = np.flatnonzero(count[place] > 1).tolist()
    if not rows:
        return 0
    seen: dict[tuple, int] = {}
    held = np.zeros(len(words), dtype=bool)
    for i in rows:
        first = seen.setdefault((words[i], words[i + 1], words[i + 2]), i)
        if first != i:
            held[first : first + 3] = held[i : i + 3] = True
    return int(held.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def _hashed(words: list[bytes], known: Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))


def _counter():
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, raw, target, held = Hashes(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), [[], []]

        def add() -> None:
            for counts, parts in zip((raw, target), held, strict=True):
                if parts:
                    counts += np.bincount(np.concatenate(parts), minlength=BUCKETS)
                    parts.clear()

        for batch in batches:
            size = 0
            for text, trusted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = buckets(_hashed((text.as_py() or "").encode().split(), known))
                held[0].append(found)
                if trusted:
                    held[1].append(found)
                size += len(found)
                if size > BUCKETS:
                    add()
                    size = 0
            add()
        rows = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(raw[rows]), pa.array(target[rows])], names=["bucket", "raw", "target"])

    return count


def _scorer(weights):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text in batch.column(1):
                text = text.as_py() or ""
                words = text.encode().split()
                hashes = _hashed(words, known)
                found = buckets(hashes)
                row = (
                    len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), repeated_lines(text),
                    repeated_words(hashes, words), int(weights.value[found].sum()) // len(found) if words else None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out)], names=[c.split()[0] for c in RULES.split(", ")])

    return score


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of all trusted documents, and ``held_out``: for the threshold, else for the counts."""
    good = (F.max("quality") == 1) & (F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)
    ids = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(good.alias("good")).filter("good")
    return ids.select("doc_id", (F.md5(F.col("doc_id").cast("string").cast("binary")) >= "8").alias("held_out"))


def ratio_weights(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Millionths of the log ratio of each bucket; ``trusted`` holds the ids of the target."""
    marked = docs.join(checked_broadcast(trusted.select("doc_id", F.lit(True).alias("trusted"))), "doc_id", "left").select("text", "trusted")
    counts = marked.mapInArrow(_counter(), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counts.collect():  # BUCKETS rows at most
        raw[row.bucket], target[row.bucket] = row.raw, row.target
    logs = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    return np.round(MICRO * logs).astype(np.int64)


def threshold(scores: DataFrame, loss: float) -> int | None:
    """The least score with more than a share ``loss`` of all scores up to it; null without scores."""
    steps = scores.groupBy(F.floor(F.col("score") / STEP).alias("step")).count().orderBy("step").collect()
    left = int(loss * sum(r["count"] for r in steps))
    for step in steps:
        if step["count"] > left:
            break
        left -= step["count"]
    else:
        return None
    within = scores.filter(F.floor(F.col("score") / STEP) == step["step"])
    for row in within.groupBy("score").count().orderBy("score").collect():  # STEP rows at most
        if row["count"] > left:
            return row["score"]
        left -= row["count"]


def verdicts(docs: DataFrame, labels: DataFrame, loss: float = LOSS) -> DataFrame:
    """doc_id, the counts of the text rules, base_failed, score (null without words) and kept, one row per row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    trusted = stored(trusted_ids(labels), "trusted")
    weights = spark.sparkContext.broadcast(ratio_weights(docs, trusted.filter("NOT held_out")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = stored(docs.mapInArrow(_scorer(weights), RULES).withColumn("base_failed", failed), "quality")
    passed = scored.filter(~F.col("base_failed")).join(checked_broadcast(trusted.filter("held_out").select("doc_id")), "doc_id", "left_semi")
    limit = threshold(passed.select("score"), loss)
    kept = ~F.col("base_failed") if limit is None else ~F.col("base_failed") & (F.col("score") >= limit)
    return scored.withColumn("kept", kept)
