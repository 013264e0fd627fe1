"""Hard negatives by a vertical scan with branch and bound (BOND).

Rows: those with an id, a label and a vector of finite components only. Of rows that share an id one counts, the least by label and vector. A component x
is floor(256 * x), held to +-2^26; a vector that is shorter than others is filled up with zeros. A score is the whole inner product.

Positives of an anchor: the ``POSITIVES`` best other rows of its label. Negatives of an anchor and a positive: the ``NEGATIVES`` best rows of other
labels with LOW * p <= 100 * score <= HIGH * p, p the positive's score. Ties go by id.

Scan: rows lie in segments, one array per dimension. An anchor reads the dimensions in descending order of its own magnitudes. After some of them each
candidate's score lies between its partial sum plus the least and plus the greatest that the remaining dimensions can add, known from
each dimension's minimum and maximum in the segment. The bitmap of candidates shrinks: a positive needs an upper bound of the fifth-best
lower bound or more; a negative needs bounds that meet a window in which fewer than three rows surely lie above it. What is left is
summed to the end and ranked. One scan serves all windows of an anchor.

Cells: anchors are dealt into blocks, rows into groups, and each block meets each group once, so that a task holds one block (``BLOCK`` anchors), one
segment and a few best rows per anchor. Rows travel once per block, of which there are 1 / (50 * ``BLOCK``) of the rows. Nothing is broadcast or collected. Rows are
dealt by place, not by key, so equal labels and equal vectors are no hot key. Per anchor, the few best rows of each group are ranked at last.

Defined results: anchors without another row of their label give nothing, nor do windows without a row, nor negative positive scores (their window is empty); empty vectors
score 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotlens.session import stored

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
ANCHORS = 50
BLOCK = 2_048
GROUP = 8_192
SEGMENT = 4_096
#: Dimensions read before bounds are looked at again; a bitmap of this size or less is summed to the end at once.
STEP, FEW = 8, 32
LIMIT = 2**26
FOUND = "anchor_id long, positive_id long, positive_score long, other_id long, score long"
PAIRS = "array<struct<score:long,id:long>>"


def whole_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label and whole components of the rows that take part, one per id."""
    x = F.col("embedding")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("embedding"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(~odd)
    cut = F.transform(x, lambda v: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(256 * v.cast("double")))).cast("int"))
    rows = rows.select("vec_id", "label", cut.alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")


class Segment:
    """Rows as one array per dimension, with the minimum and maximum of each."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.labels = ids[order], labels[order]
        self.columns = np.ascontiguousarray(vectors[order].T)
        self.low, self.high = self.columns.min(1, initial=0), self.columns.max(1, initial=0)

    def scan(self, anchor: np.ndarray, candidates: np.ndarray, alive: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places and whole scores of the candidates that stay; ``alive`` says which do, from lower and upper bounds."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        order = order[: np.count_nonzero(anchor)]
        ends = np.stack([anchor * self.low, anchor * self.high])[:, order]
        # what the dimensions from each place on can add
        least, most = (np.append(np.cumsum(e[::-1])[::-1], 0) for e in (ends.min(0), ends.max(0)))
        sums, at = np.zeros(len(candidates), dtype=self.columns.dtype), 0
        while at < len(order) and len(candidates):
            upto = len(order) if len(candidates) <= FEW else min(len(order), at + STEP)
            dims = order[at:upto]
            part = self.columns[dims] if len(candidates) == len(self.ids) else self.columns[dims[:, None], candidates[None, :]]
            sums, at = sums + anchor[dims] @ part, upto
            stay = alive(sums + least[at], sums + most[at])
            if not stay.all():
                candidates, sums = candidates[stay], sums[stay]
        return candidates, sums


def _kth_best(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def best_of_label(segment: Segment, anchor_id: int, label: int, anchor: np.ndarray, known: list[tuple]) -> list[tuple]:
    """The best (-score, id) of the label among those ``known`` and the segment's, ``POSITIVES`` at most."""
    places = np.flatnonzero((segment.labels == label) & (segment.ids != anchor_id))
    if not len(places):
        return known
    floor = -known[-1][0] if len(known) == POSITIVES else -np.inf

    def alive(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return upper >= max(floor, _kth_best(lower, POSITIVES))

    left, scores = segment.scan(anchor, places, alive)
    least = max(floor, _kth_best(scores, POSITIVES))
    good = scores >= least
    return sorted(known + list(zip((-scores[good]).astype(np.int64).tolist(), segment.ids[left[good]].tolist(), strict=True)))[:POSITIVES]


def windows(positives: list[int]) -> np.ndarray:
    """First and last score of the negatives of each positive score; the last is below the first if there is none."""
    return np.array([(-(-p * LOW // 100), p * HIGH // 100) for p in positives], dtype=np.int64).reshape(-1, 2)


def best_in_windows(segment: Segment, label: int, anchor: np.ndarray, spans: np.ndarray, known: list[list[tuple]]) -> list[list[tuple]]:
    """For each window the best (-score, id) of other labels among those ``known`` and the segment's, ``NEGATIVES`` at most."""
    places = np.flatnonzero(segment.labels != label)
    floors = [-k[-1][0] if len(k) == NEGATIVES else -np.inf for k in known]

    def alive(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(lower), dtype=bool)
        for (low, high), floor in zip(spans, floors, strict=True):
            sure = lower[(lower >= low) & (upper <= high)]
            stay |= (upper >= max(low, floor, _kth_best(sure, NEGATIVES))) & (lower <= high)
        return stay

    if not len(places):
        return known
    left, scores = segment.scan(anchor, places, alive)
    out = []
    for (low, high), floor, old in zip(spans, floors, known, strict=True):
        rows = np.flatnonzero((scores >= max(low, floor)) & (scores <= high))
        rows = rows[scores[rows] >= _kth_best(scores[rows], NEGATIVES)]
        new = zip((-scores[rows]).astype(np.int64).tolist(), segment.ids[left[rows]].tolist(), strict=True)
        out.append(sorted(old + list(new))[:NEGATIVES])
    return out


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width), dtype=np.int64)
    flat = vectors.flatten().to_numpy()
    out[np.repeat(np.arange(len(vectors)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Cell:
    """The anchors of one block and the best found for them in one group of rows."""

    def __init__(self, number: int):
        self.number = number
        self.anchors: list[tuple] = []
        self.rows: list[pa.RecordBatch] = []
        self.held = 0
        self.found: list[list[list[tuple]]] = []

    def add(self, part: pa.RecordBatch) -> None:
        """Rows in order: anchors first."""
        guests = int(np.count_nonzero(part.column("kind").to_numpy() == 0))
        for row in part.slice(0, guests).to_pylist():
            self.anchors.append((row["vec_id"], row["label"], np.array(row["v"], dtype=np.int64), [(p["score"], p["id"]) for p in row["positives"] or []]))
            self.found.append([[] for _ in row["positives"] or [None]])
        at = guests
        while at < part.num_rows:
            some = part.slice(at, SEGMENT - self.held)
            self.rows.append(some)
            self.held, at = self.held + some.num_rows, at + some.num_rows
            if self.held == SEGMENT:
                self.scan()

    def scan(self) -> None:
        """Searches the rows held, as one segment, for every anchor."""
        if not self.held:
            return
        rows = pa.Table.from_batches(self.rows).combine_chunks()
        vectors = rows.column("v").combine_chunks()
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        sizes = np.diff(vectors.offsets.to_numpy())
        width = max(int(sizes.max(initial=0)), *(len(a[2]) for a in self.anchors), 0)
        whole, flat = np.zeros((len(sizes), width), dtype=np.int64), vectors.flatten().to_numpy()
        whole[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        # floats add whole numbers exactly below 2^53, and faster
        most = int(np.abs(whole).max(initial=0)) * max(int(np.abs(a[2]).max(initial=0)) for a in self.anchors) * max(1, width)
        segment = Segment(rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), whole.astype(np.float64 if most < 2**53 else np.int64))
        for n, (anchor_id, label, vector, positives) in enumerate(self.anchors):
            anchor = np.zeros(width, dtype=segment.columns.dtype)
            anchor[: len(vector)] = vector
            if positives:
                self.found[n] = best_in_windows(segment, label, anchor, windows([p for p, _ in positives]), self.found[n])
            else:
                self.found[n][0] = best_of_label(segment, anchor_id, label, anchor, self.found[n][0])
        self.rows, self.held = [], 0

    def results(self) -> list[tuple]:
        """(anchor, positive or null, its score or null, other row, its score)."""
        self.scan()
        return [
            (anchor[0], pair[1], pair[0], other, -score)
            for anchor, lists in zip(self.anchors, self.found, strict=True)
            for pair, best in zip(anchor[3] or [(None, None)], lists, strict=True) for score, other in best]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cell: Cell | None = None

    def rows(done: Cell) -> pa.RecordBatch:
        found = done.results()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(5)], names=[c.split()[0] for c in FOUND.split(", ")])

    for batch in batches:
        numbers = batch.column("cell").to_numpy()
        edges = np.flatnonzero(np.diff(numbers)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if a == b:
                continue
            if cell is None or cell.number != numbers[a]:
                if cell is not None:
                    yield rows(cell)
                cell = Cell(int(numbers[a]))
            cell.add(batch.slice(a, b - a))
    if cell is not None:
        yield rows(cell)


def _search(anchors: DataFrame, rows: DataFrame, counts: tuple[int, int]) -> DataFrame:
    """Each block of anchors against each group of rows; ``anchors`` with their positives, or null."""
    blocks, groups = counts
    # dealt by place: the numbers of a stored table's rows are the same in every run over its files
    place = F.monotonically_increasing_id()

    def cells(count: int, number: Callable[[Column], Column]) -> Column:
        return F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda n: number(n).cast("int"))).alias("cell")

    dealt = anchors.withColumn("place", place).select(
        cells(groups, lambda g: F.pmod("place", F.lit(blocks)) * groups + g), F.lit(0).alias("kind"), "vec_id", "label", "v", "positives")
    held = rows.withColumn("place", place).select(
        cells(blocks, lambda b: b * groups + F.pmod("place", F.lit(groups))), F.lit(1).alias("kind"), "vec_id", "label", "v",
        F.lit(None).cast(PAIRS).alias("positives"))
    both = dealt.unionByName(held).repartitionById(blocks * groups, F.col("cell")).sortWithinPartitions("cell", "kind", "vec_id")
    return both.mapInArrow(_scan, FOUND)


def mined(vectors: DataFrame, every: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; anchors are the rows with an id divisible by ``every``."""
    rows = stored(whole_rows(vectors), "vectors")
    asked = stored(rows.filter(F.col("vec_id") % every == 0), "anchors")
    counts = max(1, -(-asked.count() // BLOCK)), max(1, -(-rows.count() // GROUP))
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    found = _search(asked.withColumn("positives", F.lit(None).cast(PAIRS)), rows, counts)
    positives = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= POSITIVES)
    # POSITIVES pairs per anchor
    pairs = positives.groupBy(F.col("anchor_id").alias("p")).agg(F.collect_list(F.struct("score", F.col("other_id").alias("id"))).alias("positives"))
    asked = stored(asked.join(pairs, F.col("vec_id") == F.col("p")).select("vec_id", "label", "v", "positives"), "anchors")
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "other_id")
    ranked = _search(asked, rows, counts).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= NEGATIVES)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
