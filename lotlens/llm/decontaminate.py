"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and underscores, lower-cased. Seeds (five words, or a whole shorter item) of the
benchmark are matched against all windows of all documents by Karp-Rabin hashes; a document that shares a seed
with an item is tiled with it: the longest common runs of words that are not yet marked are marked first, down to the
length of a seed, found by running Karp-Rabin hashes of decreasing window length and checked word by word. Marked
runs don't overlap, so a passage is found however its parts are reordered. Coverage is the marked share of the
item's words; at ``COVERAGE`` or more the document leaks the item.

An item is tiled only if its words inside shared seeds are enough for the coverage, so items that share but an opening with a document cost no tiling.

The benchmark is taken in blocks of some 20,000 items or 64 MB, one pass over the documents per block, so any size gives
whole results. With several blocks, a block's result is written before the next is read (``clean`` then writes its
documents once per block). Documents are never grouped or moved. Equal rows (id and text) of the benchmark share a block.

Defined results: null or wordless items match nothing; null text has no words; equal items are matched each; repeated
rows give repeated rows; an empty table gives an empty result; other columns are ignored or, in ``clean``, kept.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.session import stored

SEED = 5
COVERAGE = 0.8
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 64 * 2**20
_WORD = re.compile(r"\w+")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
LEAKS = "doc_id long, item_id long, item_words long, n_tiles long, covered long, coverage double"


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _powers(base: int, count: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(0, count - 1), base, dtype=np.uint64))])[:count]


class Rolling:
    """Karp-Rabin hashes modulo 2^64 of all windows of any length, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(_BASE, len(values)), dtype=np.uint64)])
        self.back = _powers(_INVERSE, len(values))

    def windows(self, length: int) -> np.ndarray:
        if len(self.values) < length:
            return np.zeros(0, np.uint64)
        return (self.prefix[length:] - self.prefix[:-length]) * self.back[: len(self.values) - length + 1]


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(marked)])
    return sums[length:] == sums[:-length]


def _inside(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Positions that lie in a window of the length at one of the starts, which are distinct."""
    ends = np.zeros(size + 1, int)
    ends[starts] += 1
    ends[starts + length] -= 1
    return np.cumsum(ends)[:size] > 0


def greedy_tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length): longest first, never overlapping, ``least`` words at least."""
    a, b = Rolling(item), Rolling(text)
    in_item, in_text = np.zeros(len(item), bool), np.zeros(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    length = min(len(item), len(text))
    while length >= least:
        starts = defaultdict(list)
        ha, hb = a.windows(length), b.windows(length)
        for i in np.flatnonzero(_free(in_item, length)):
            starts[ha[i]].append(int(i))
        where = np.flatnonzero(_free(in_text, length) & np.isin(hb, ha))
        runs = set()
        for j in map(int, where):
            for i in starts.get(hb[j], ()):
                if i and j and item[i - 1] == text[j - 1] and not in_item[i - 1] and not in_text[j - 1]:
                    continue  # found from its left end
                n = length
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not in_item[i + n] and not in_text[j + n]:
                    n += 1
                if (item[i : i + n] == text[j : j + n]).all():
                    runs.add((i, j, n))
        marked = False
        for i, j, n in sorted(runs, key=lambda r: (-r[2], r[0], r[1])):
            if not in_item[i : i + n].any() and not in_text[j : j + n].any():
                in_item[i : i + n] = in_text[j : j + n] = True
                tiles.append((i, j, n))
                marked = True
        # a run that was overlapped may have free parts of this length still
        if not marked:
            if length == least:
                break
            length = max(least, length // 2)
    return tiles


class Benchmark:
    """One block of items: vocabulary, items as word codes, seeds and their items."""

    def __init__(self, items: list[tuple[int | None, str | None]], seed: int):
        self.seed, self.code, self.items = seed, {}, []
        for item_id, text in items:
            found = words(text)
            if found:
                self.items.append((item_id, np.array([self.code.setdefault(w, xxhash.xxh64_intdigest(w, 7) | 1) for w in found], dtype=np.uint64)))
        # seed length -> seed -> item -> how often the item holds the seed
        self.by_seed: dict[int, dict[int, dict[int, int]]] = defaultdict(lambda: defaultdict(dict))
        for number, (_, codes) in enumerate(self.items):
            length = min(seed, len(codes))
            for h in Rolling(codes).windows(length).tolist():
                holders = self.by_seed[length][h]
                holders[number] = holders.get(number, 0) + 1
        self.by_seed = {n: dict(x) for n, x in self.by_seed.items()}
        self.hashes = {n: np.sort(np.fromiter(x, dtype=np.uint64, count=len(x))) for n, x in self.by_seed.items()}

    def leaks(self, text: str | None, least_coverage: float) -> Iterator[tuple]:
        get = self.code.get
        codes = np.array([get(w, 0) for w in words(text)], dtype=np.uint64)
        # only runs of benchmark words can hold a seed; a zero keeps the others apart
        known = codes != 0
        keep = known | np.concatenate([[False], known[:-1]]) if len(codes) else known
        codes = codes[keep]
        if not len(codes):
            return
        rolling, reach, hits = Rolling(codes), defaultdict(int), {}
        for length, hashes in self.hashes.items():
            windows = rolling.windows(length)
            at = np.flatnonzero(_free(codes == 0, length)) if len(windows) else windows[:0].astype(int)
            at = at[hashes[np.minimum(np.searchsorted(hashes, windows[at]), len(hashes) - 1)] == windows[at]]
            hits[length] = at, windows[at]
            for h in np.unique(windows[at]).tolist():
                for number, times in self.by_seed[length][h].items():
                    reach[number] += times * length
        for number in sorted(reach):
            item_id, item = self.items[number]
            least = least_coverage * len(item)
            if reach[number] < least:
                continue
            length = min(self.seed, len(item))
            own, (at, found) = Rolling(item).windows(length), hits[length]
            # tiles lie in shared seeds, so an item with fewer words in them can't reach the coverage
            if _inside(np.flatnonzero(np.isin(own, found)), length, len(item)).sum() < least:
                continue
            inside = np.append(_inside(at[np.isin(found, own)], length, len(codes)), False)
            edge = inside | np.concatenate([[False], inside[:-1]])
            text_part = np.where(inside[:-1], codes, np.uint64(0))[edge[:-1]]
            tiles = greedy_tiles(item, text_part, min(self.seed, len(item)))
            covered = sum(t[2] for t in tiles)
            if covered >= least:
                yield item_id, len(item), len(tiles), covered, covered / len(item)


def _blocks(benchmark: DataFrame, seed: int) -> Iterator[tuple[Broadcast, int]]:
    """The benchmark's blocks, each with the number of blocks; one is read when the one before has been worked off."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    items, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    count = max(1, -(-items // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for block in range(count):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Benchmark([tuple(r) for r in part], seed)), count


def leaks(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """One row per document and item that it leaks: words, tiles, covered words and coverage of the item."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def finder(block):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(d, *leak) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for leak in block.value.leaks(t, coverage)]
                types = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names=[c.split()[0] for c in LEAKS.split(", ")])

        return find

    found = None
    for block, count in _blocks(benchmark, seed):
        part = rows.mapInArrow(finder(block), LEAKS)
        if count > 1:
            part = stored(part, "leaks")
            block.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that leak no item, all columns kept."""
    at = docs.columns.index("text")

    def keeper(block):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([next(block.value.leaks(t, coverage), None) is None for t in batch.column(at).to_pylist()], pa.bool_()))

        return keep

    kept = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names may hold dots
    for block, count in _blocks(benchmark, seed):
        kept = kept.mapInArrow(keeper(block), kept.schema)
        if count > 1:
            kept = stored(kept, "clean")
            block.destroy()
    return kept.toDF(*docs.columns)
