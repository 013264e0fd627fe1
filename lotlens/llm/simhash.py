"""SimHash near-duplicates through vantage-point trees.

Fingerprint: words are runs of characters other than ASCII white space, A-Z lower-cased; shingles are
three words, repeats included (fewer words: all of them; none: fingerprint 0). A bit is 1 if it is set in over half of
the shingles' XXH64 (seed 42).

Search: distinct fingerprints only. The 64 bits are cut into ``radius + 1`` blocks; two fingerprints
within ``radius`` bits agree on one block at least, so there is one tree per block. A node of a tree holds a vantage
point, a metric (Hamming distance on the block or on all bits), a bound and the radius that counts in this
metric: 0 on the block, ``radius`` on all bits. A member goes to the side of its distance; a query also goes to the
other side if the triangle inequality leaves room for a partner there. Block metrics split first; where a block
can split no more (many fingerprints that share it), the full metric goes on, and queries near a bound
visit the overlapping shards too. The trees are fitted on a bounded sample (``SAMPLE``); every fingerprint is indexed
and asked. Inside a shard a vantage-point tree in the full metric finds all partners; a shard hands on one link per
fingerprint (to the smallest of its local component), never all pairs. Components of these links come from
alternating large and small stars.

Wide fingerprints (``wide``: 256 bits over a set of hashes) serve likeness far below 2 bits: sets of Jaccard likeness 0.8 differ in some 15 % of the bits
(19 % if they are tiny), unlike ones in half. No triangle inequality prunes at such a radius, so each node of a tree uses the distance on a single bit, each tree
begins at a bit of its own, and nobody visits a second shard: a pair parts from a tree of depth d with probability 1 - 0.85^d. There are as many trees as
make a pair of likeness 0.8 share a shard with probability 0.999 (``n_trees``); their number grows as rows^0.23, the rows of a shard don't grow.
Inside a shard all pairs are compared, but those within a ball of half the radius, which are near by the triangle inequality.

Defined results: null text is empty text; documents without words share fingerprint 0 and are linked;
equal fingerprints are linked; a component is named by its smallest ``doc_id`` (null ids never name one unless there
is no other); repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotlens.session import stored

RADIUS = 2
WORDS = 3
SAMPLE = 32_768
SHARD_ROWS = 20_000
LEAF = 256
#: Wide fingerprints: bits, radius, rows of a shard, the share of bits that a pair at the bound differs in, and how often it may miss all shards.
WIDE, WIDE_RADIUS, WIDE_ROWS, WIDE_PART, WIDE_MISS = 256, 68, 4_096, 0.15, 0.001
_WIDE_SALT = np.random.default_rng(256).integers(0, 2**63, WIDE // 64, dtype=np.uint64)


def simhash(text: str | None) -> int:
    """The fingerprint as an unsigned number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line, starts, ends, at = b" ".join(words), [], [], 0
    for n in map(len, words):
        starts.append(at)
        ends.append(at := at + n)
        at += 1
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(line, 42)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends[WORDS - 1 :], strict=False)), dtype=">u8", count=len(words) - WORDS + 1)
    ones = np.zeros(64, dtype=np.int64)
    for part in range(0, len(hashes), 16_384):
        ones += np.unpackbits(hashes[part : part + 16_384].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def wide(found: np.ndarray) -> bytes:
    """The wide fingerprint of a set of 64-bit hashes: a bit is set if it is set in over half of them."""
    ones = np.zeros(WIDE, dtype=np.int64)
    for part in range(0, len(found), 255):
        mixed = (found[part : part + 255, None] ^ _WIDE_SALT) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(found)).tobytes()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((simhash(t) for t in batch.column(1).to_pylist()), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints.view(np.int64))], names=["doc_id", "row_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (hash of id and text) and fp (the fingerprint as a signed long)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("doc_id", "text").alias("row_key"))
    return rows.mapInArrow(_hashed, "doc_id long, row_key long, fp long")


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _in_words(points: np.ndarray) -> np.ndarray:
    return points if points.ndim == 2 else points[:, None]


class Tree:
    """Top of a vantage-point tree: nodes as (vantage, word, mask, bound, radius, inner, outer), leaves as shard numbers.

    Points are numbers of 64 bits, or rows of several; a metric is the distance on the bits of ``mask`` of one word, with the radius that counts there.
    """

    def __init__(self, sample: np.ndarray, metrics: list[tuple[int, int, int]], weight: float, shard_rows: int, least: int = 16):
        self.shards, self.least = 0, least
        self.root = self._grow(_in_words(sample), [(word, np.uint64(mask), radius) for word, mask, radius in metrics], weight, shard_rows, 0)

    def _leaf(self) -> int:
        self.shards += 1
        return self.shards - 1

    def _grow(self, points: np.ndarray, metrics: list, weight: float, shard_rows: int, depth: int):
        if len(points) * weight <= shard_rows or len(points) < self.least or depth > 40:
            return self._leaf()
        for word, mask, radius in metrics:
            best, seen = None, points[:, word] & mask
            for vantage in seen[:: max(1, len(points) // 8)][:8]:
                d = distance(seen, vantage)
                for bound in np.unique(d)[:-1]:
                    size = max((d <= bound + radius).sum(), (d > int(bound) - radius).sum())
                    if best is None or size < best[0]:
                        best = size, vantage, int(bound), d
            if best and best[0] <= 0.9 * len(points):
                _, vantage, bound, d = best
                inner = self._grow(points[d <= bound], metrics, weight, shard_rows, depth + 1)
                outer = self._grow(points[d > bound], metrics, weight, shard_rows, depth + 1)
                return vantage, word, mask, bound, radius, inner, outer
        return self._leaf()

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Shard, indexes of the points that ask it, and whether they live there."""
        points = _in_words(points)
        stack = [(self.root, np.arange(len(points)), np.ones(len(points), dtype=bool))]
        while stack:
            node, rows, home = stack.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                yield node, rows, home
                continue
            vantage, word, mask, bound, radius, inner, outer = node
            d = distance(points[rows, word] & mask, vantage).astype(np.int16)
            near, far = d <= bound + radius, d > bound - radius
            stack.append((inner, rows[near], (home & (d <= bound))[near]))
            stack.append((outer, rows[far], (home & (d > bound))[far]))


def forest(sample: np.ndarray, total: int, radius: int = RADIUS, blocks: int | None = None, shard_rows: int = SHARD_ROWS) -> list[Tree]:
    """One tree per block of bits. The radius in a block metric is 0, as blocks outnumber the radius; a single block is the plain tree."""
    blocks = radius + 1 if blocks is None else blocks
    if blocks not in (1, radius + 1):
        raise ValueError("one block, or one more than the radius")
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    weight, full = total / max(1, len(sample)), (0, 2**64 - 1, radius)
    block = [[(0, (1 << high) - (1 << low), 0)] if radius and blocks > 1 else [] for low, high in zip(cuts, cuts[1:], strict=False)]
    return [Tree(sample, [*first, full], weight, shard_rows) for first in block]


def n_trees(total: int, shard_rows: int = WIDE_ROWS) -> int:
    """Trees over wide fingerprints of which a pair at the bound shares a shard of one, but for ``WIDE_MISS``."""
    together = (1 - WIDE_PART) ** math.ceil(max(0.0, math.log2(max(1, total) / shard_rows)))
    return 1 if together == 1 else math.ceil(math.log(WIDE_MISS) / math.log(1 - together))


def wide_forest(sample: np.ndarray, total: int, shard_rows: int = WIDE_ROWS) -> list[Tree]:
    """Trees over rows of ``WIDE`` bits; they take single bits in turn, each tree from a place of its own."""
    trees, bits = n_trees(total, shard_rows), np.random.default_rng(64).permutation(WIDE).tolist()
    starts = [round(WIDE * i / trees) % WIDE for i in range(trees)]
    return [Tree(sample, [(b // 64, 1 << (b % 64), 0) for b in bits[at:] + bits[:at]], total / max(1, len(sample)), shard_rows, 2) for at in starts]


def components(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``count`` points the smallest point it is linked to."""
    label = np.arange(count)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(label, high[open_], low[open_])
        while (label[label] != label).any():
            label = label[label]
    return label


def _leaf_links(points: np.ndarray, members: np.ndarray, asking: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the pairs of a leaf: fewer than its rows, even if all pairs are close."""
    step = max(1, 1_000_000 // max(1, len(members)))
    for part in range(0, len(asking), step):
        rows = asking[part : part + step]
        close = distance(points[rows][:, None], points[members][None, :]) <= radius
        close &= rows[:, None] != members[None, :]
        rows, columns, close = rows[close.any(1)], members[close.any(0)], close[close.any(1)][:, close.any(0)]
        if not len(rows):
            continue
        far = len(columns)
        label = np.arange(far)
        while True:
            by_row = np.where(close, label[None, :], far).min(1)
            merged = np.minimum(label, np.where(close, by_row[:, None], far).min(0))
            if (merged == label).all():
                break
            label = merged
        yield rows, columns[by_row]
        yield columns, columns[label]


def local_links(members: np.ndarray, visitors: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest of its local component) for all that have a partner among ``members``."""
    points = np.concatenate([members, visitors])
    order = np.argsort(points, kind="stable")
    points = points[order]
    own = np.flatnonzero(order < len(members))
    links: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(own, np.arange(len(points)), 0)]
    while stack:
        rows, asking, depth = stack.pop()
        if not len(rows) or not len(asking):
            continue
        split = None
        if len(rows) > leaf and depth < 40:
            for vantage in points[rows[:: max(1, len(rows) // 3)][:3]]:
                d = distance(points[rows], vantage)
                bound = int(np.median(d))
                bound -= bound == int(d.max())
                if (d <= bound).any() and (split is None or abs((d <= bound).mean() - 0.5) < split[3]):
                    split = vantage, bound, d, abs((d <= bound).mean() - 0.5)
        if split is None:
            links += _leaf_links(points, rows, asking, radius)
            continue
        vantage, bound, d, _ = split
        asked = distance(points[asking], vantage).astype(np.int16)
        stack.append((rows[d <= bound], asking[asked <= bound + radius], depth + 1))
        stack.append((rows[d > bound], asking[asked > bound - radius], depth + 1))
    if not links:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    label = components(len(points), np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links]))
    moved = np.flatnonzero(label != np.arange(len(points)))
    return points[moved], points[label[moved]]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which each row of ``a`` differs from each row of ``b``."""
    out = np.zeros((len(a), len(b)), dtype=np.uint16)
    for word in range(a.shape[1]):
        out += distance(a[:, word][:, None], b[:, word][None, :])
    return out


def wide_links(points: np.ndarray, radius: int = WIDE_RADIUS) -> np.ndarray:
    """For each row the first row of its component by pairs within ``radius``; rows of one ball are not compared with each other."""
    ball, label = np.full(len(points), -1), np.arange(len(points))
    for center in range(0, len(points), max(1, len(points) // 8)):
        inside = (ball < 0) & (_apart(points, points[center : center + 1])[:, 0] <= radius // 2)
        if inside.sum() >= 64:
            ball[inside] = center
            label[inside] = np.flatnonzero(inside)[0]
    order = np.argsort(ball, kind="stable")
    ends = np.searchsorted(ball[order], ball[order], side="right")
    sorted_points, at = points[order], 0
    while at < len(order):
        # rows outside all balls meet all that follow, rows of a ball those behind the ball
        loose = ball[order[at]] < 0
        start = at if loose else int(ends[at])
        stop = min(int(ends[at]), at + max(1, 2_000_000 // max(1, len(order) - start)))
        i, j = np.nonzero(_apart(sorted_points[at:stop], sorted_points[start:]) <= radius)
        open_ = label[order[at + i]] != label[order[start + j]]
        a, b = order[at + i[open_]], order[start + j[open_]]
        if len(a):
            linked = np.flatnonzero(label != np.arange(len(label)))
            label = components(len(points), np.concatenate([linked, a]), np.concatenate([label[linked], b]))
        at = stop
    return label


def _router(trees: Callable[[], list[Tree]]):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for number, tree in enumerate(trees()):
                for shard, rows, home in tree.route(points):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(rows), number * 2**32 + shard, dtype=np.int64)),
                        pa.array(points[rows].view(np.int64)), pa.array(home),
                    ], names=["shard", "fp", "home"])

    return route


def _search(radius: int):
    def search(shard: pa.Table) -> pa.Table:
        points = shard.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        home = shard.column("home").to_numpy(zero_copy_only=False).astype(bool)
        a, b = local_links(points[home], points[~home], radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return search


def links(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links a -> b that connect exactly the fingerprints (distinct column fp) within ``radius`` bits of each other."""
    spark = prints.sparkSession
    total = prints.count()
    share = min(1.0, SAMPLE / max(1, total))
    picked = prints.filter(F.pmod(F.xxhash64("fp"), F.lit(2**30)) < int(share * 2**30) + (share == 1.0))
    sample = np.array([r[0] for r in picked.limit(2 * SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    trees = spark.sparkContext.broadcast(forest(np.sort(sample), total, radius, blocks, shard_rows))
    routed = prints.select("fp").mapInArrow(_router(lambda: trees.value), "shard long, fp long, home boolean")
    return routed.groupBy("shard").applyInArrow(_search(radius), "a long, b long")


def _wide_points(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, WIDE // 64)


def _wide_router(trees: Callable[[], list[Tree]]):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, shards = _wide_points(batch.column(1)), np.zeros(batch.num_rows, dtype=np.int64)
            for number, tree in enumerate(trees()):
                for shard, rows, _ in tree.route(points):
                    shards[rows] = number * 2**32 + shard
                yield pa.RecordBatch.from_arrays([pa.array(shards), *batch.columns], names=["shard", "fp", "print"])

    return route


def _wide_search(shard: pa.Table) -> pa.Table:
    shard = shard.sort_by("fp")
    label = wide_links(_wide_points(shard.column("print")))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"a": shard.column("fp").take(moved), "b": shard.column("fp").take(label[moved])})


def wide_classes(prints: DataFrame, shard_rows: int = WIDE_ROWS) -> DataFrame:
    """(a, b): the smallest key b of the component of a, for all a but the smallest; ``prints`` has distinct keys fp (binary) and their wide fingerprints print."""
    spark, total = prints.sparkSession, prints.count()
    share = min(1.0, SAMPLE / max(1, total))
    picked = prints.filter(F.pmod(F.xxhash64("fp"), F.lit(2**30)) < int(share * 2**30) + (share == 1.0)).select("print")
    sample = _wide_points(picked.limit(2 * SAMPLE).toArrow().column(0))
    trees = spark.sparkContext.broadcast(wide_forest(sample, total, shard_rows))
    routed = prints.select("fp", "print").mapInArrow(_wide_router(lambda: trees.value), "shard long, fp binary, print binary")
    return roots(routed.groupBy("shard").applyInArrow(_wide_search, "a binary, b binary"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step; edges (a, b) with a > b."""
    ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = ends.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.first("a")).alias("low"))
    joined = ends.join(least, F.col("a") == F.col("c"))
    if large:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    moved = joined.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.select(F.col("c").alias("a"), F.col("low").alias("b"))).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(a, b): the smallest member b of the component of a, for all a but the smallest."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, before = stored(edges.distinct(), "links"), None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            return edges
        before = state
        edges = stored(_star(_star(edges, large=True), large=False), "links")


def classes(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """fp, first_id (smallest doc_id with it), root: the component's smallest fingerprint; ``prints`` as of ``fingerprints``."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    linked = roots(links(distinct, radius, blocks, shard_rows))
    return distinct.join(linked, F.col("fp") == F.col("a"), "left").select("fp", "first_id", F.coalesce("b", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, one row per document."""
    prints = stored(fingerprints(docs), "fingerprints")
    known = stored(classes(prints, radius), "classes")
    named = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = known.join(named.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select(F.col("fp").alias("p"), "component_id")
    return prints.join(by_print, F.col("fp") == F.col("p")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each_group(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each component the document with the smallest id (null last)."""
    prints = stored(fingerprints(docs), "fingerprints")
    return one_of_each(docs, prints, stored(classes(prints, radius), "classes"))


def one_of_each(docs: DataFrame, prints: DataFrame, known: DataFrame) -> DataFrame:
    """Of each component the row with the smallest id; ``known`` holds fp and root."""
    known = known.select(F.col("fp").alias("p"), "root")
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("row_key"))
    kept = prints.join(known, F.col("fp") == F.col("p")).groupBy("root").agg(F.min(place).alias("least"))
    kept = kept.select(F.col("least.row_key").alias("kept_key"))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.xxhash64("doc_id", "text").alias("row_key"))
    # repeated rows have one key; the join has brought them together already
    own = Window.partitionBy("row_key").orderBy("row_key")
    once = rows.join(kept, F.col("row_key") == F.col("kept_key"), "left_semi").withColumn("n", F.row_number().over(own))
    return once.filter("n = 1").select("doc.*")
