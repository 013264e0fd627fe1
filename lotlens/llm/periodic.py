"""Periodic runs of words, by minimizers at many scales.

Words are runs of characters other than ASCII white space, told apart by every byte. A run is a stretch with smallest period q (words
q apart are equal) of ``LEAST_WORDS`` words and ``LEAST_PERIODS`` periods at least that no neighbouring word extends.

Short periods, up to ``LAGS``: the words are compared with those q places on, for each q.

Longer periods: scales cut the periods into ranges (low, high] that grow by a half. On a scale, each stretch of ``high`` words has a hash, and
of each 2 * (low + 1) - high + 1 neighbouring stretches the one with the least hash is picked (a minimizer; ties: the first).
Inside a run with a period of this scale the hashes recur with the period, two windows one period apart lie in the run
since it has three periods, and so their minimizers are equal and one period apart. A stretch as long as the period occurs once per
period only; so the two are neighbours among the minimizers of equal hash, and these neighbours are the seeds: linear in number. A seed is
extended to both sides by the longest common extension, which goes down a table of hashes of 1, 2, 4, .. words.

Documents of a task are searched together, some ``CHUNK`` bytes at a time, with a word of its own behind each; a longer text is a chunk of its own,
never cut. Time is n log n for n words. Hashes have 64 bits; equal hashes count as equal words.

Defined results: null text and text without words have no words and no runs, and collapse to the empty text; repeated rows give repeated rows; an
empty table gives an empty result; null ids stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Periods found by direct comparison; LAGS * LEAST_PERIODS is LEAST_WORDS at most, so three periods rule on all scales.
LAGS = 8
CHUNK = 1_000_000
RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
WORD = r"[^\x20\x09-\x0D]+"


class Numbers(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mixed(left * np.uint64(0x9E3779B97F4A7C15) + _mixed(right + np.uint64(0xD1B54A32D192ED03)))


def _lag_runs(words: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the stretches in which words ``lag`` apart are equal, if long enough for a run."""
    same = np.zeros(max(0, len(words) - lag) + 2, dtype=np.int8)
    same[1:-1] = words[lag:] == words[:-lag]
    edges = np.flatnonzero(np.diff(same))
    starts, ends = edges[::2], edges[1::2] + lag
    long = ends - starts >= max(LEAST_WORDS, LEAST_PERIODS * lag)
    return starts[long], ends[long]


def _tables(words: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of the stretches of 1, 2, 4, .. words, over the documents that are long enough; the longest documents come first."""
    tables = [_mixed(words.astype(np.uint64) + np.uint64(1))]
    step = 1
    while 2 * step <= sizes[0]:
        upto = int(ends[np.searchsorted(-sizes, -2 * step, side="right") - 1])
        tables.append(_joined(tables[-1][: max(0, upto - 2 * step + 1)], tables[-1][step : max(step, upto - step + 1)]))
        step *= 2
    return tables


def _window_minimizers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the first least hash of each ``window`` neighbours."""
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    least, width = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64), 1
    while 2 * width <= window:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < window:
        least = np.minimum(least[: width - window], least[window - width :])
    picked = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return picked[np.flatnonzero(np.diff(picked, prepend=-1))]


def _seeds(table: list[np.ndarray], upto: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring equal minimizers whose distance is in (low, high]."""
    level = high.bit_length() - 1
    hashes, rest, count = table[level], high - (1 << level), upto - high + 1
    window = 2 * (low + 1) - high + 1
    none = np.zeros(0, dtype=np.int64)
    if count < window:
        return none, none
    grams = _joined(hashes[:count], hashes[rest : rest + count])
    picked = _window_minimizers(grams, window)
    picked = picked[np.argsort(grams[picked], kind="stable")]
    a, b = picked[:-1], picked[1:]
    near = (grams[a] == grams[b]) & (b - a > low) & (b - a <= high)
    return a[near], b[near]


def _extension(tables: list[np.ndarray], a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
    """Number of equal words from a and b on, or before them; a < b."""
    done = np.zeros(len(a), dtype=np.int64)
    for level in reversed(range(len(tables))):
        table, step = tables[level], 1 << level
        x, y = (a + done, b + done) if forward else (a - done - step, b - done - step)
        inside = (x >= 0) & (y < len(table))
        equal = np.zeros(len(a), dtype=bool)
        equal[inside] = table[x[inside]] == table[y[inside]]
        done += step * equal
    return done


def find_runs(docs: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each document of word numbers (0 and up), by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    order = sorted((i for i, d in enumerate(docs) if len(d) >= LEAST_WORDS), key=lambda i: -len(docs[i]))
    if not order:
        return found
    parts: list[np.ndarray] = []
    for n, i in enumerate(order):
        parts += [docs[i], np.array([-2 - n])]
    words = np.concatenate(parts)
    sizes = np.array([len(docs[i]) for i in order])
    ends = np.cumsum(sizes + 1)
    runs = [(*_lag_runs(words, lag), lag) for lag in range(1, LAGS + 1)]
    starts, stops, periods = [r[0] for r in runs], [r[1] for r in runs], [np.full(len(r[0]), r[2]) for r in runs]
    low, tables = LAGS, None
    while LEAST_PERIODS * (low + 1) <= sizes[0]:
        high = low * 3 // 2
        tables = tables or _tables(words, sizes, ends)
        upto = int(ends[np.searchsorted(-sizes, -LEAST_PERIODS * (low + 1), side="right") - 1])
        a, b = _seeds(tables, upto, low, high)
        period = b - a
        start, stop = a - _extension(tables, a, b, False), b + _extension(tables, a, b, True)
        long = stop - start >= LEAST_PERIODS * period
        starts.append(start[long])
        stops.append(stop[long])
        periods.append(period[long])
        low = high
    start, stop, period = np.concatenate(starts), np.concatenate(stops), np.concatenate(periods)
    at = np.lexsort((period, stop, start))
    start, stop, period = start[at], stop[at], period[at]
    # a stretch is found with multiples of its period as well
    least = np.flatnonzero((np.diff(start, prepend=-1) != 0) | (np.diff(stop, prepend=-1) != 0))
    start, stop, period = start[least], stop[least], period[least]
    at = np.lexsort((period, start))
    owner = np.searchsorted(ends, start, side="right")
    first = ends - sizes - 1
    for k in at.tolist():
        n = int(owner[k])
        found[order[n]].append((int(start[k] - first[n]), int(stop[k] - start[k]), int(period[k])))
    return found


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _chunks(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[list, list[list[bytes]]]]:
    keys, words, held = [], [], 0
    for key, text in zip(ids, texts, strict=True):
        value = (text.as_py() or "").encode()
        keys.append(key.as_py())
        words.append(value.split())
        held += len(value)
        if held >= CHUNK:
            yield keys, words
            keys, words, held = [], [], 0
    if keys:
        yield keys, words


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "runs", "collapsed"]
    for batch in batches:
        for keys, words in _chunks(batch.column(0), batch.column(1)):
            number = Numbers().__getitem__
            runs = find_runs([np.fromiter(map(number, w), dtype=np.int64, count=len(w)) for w in words])
            collapsed = [b" ".join(kept_words(w, r)).decode() for w, r in zip(words, runs, strict=True)]
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array(rows, RUNS), pa.array(collapsed, pa.string()),
            ], names=names)


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, all runs, and the text without repeated periods (words joined by one space), one row per row of ``docs``."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_search, RESULT)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or for every tenth id by crc32 the text made periodic behind a word that the id names; null ids: the text."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def periodic(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        # constants of the row are bound once, not once per word
        return F.transform(F.array(F.struct(words.alias("w"), a.alias("a"), p.alias("p"))), lambda s: F.transform(
            F.sequence(F.lit(0).cast("long"), F.size(s["w"]).cast("long") - 1),
            lambda i: F.get(s["w"], F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]).cast("int"))))[0]

    words = F.transform(F.array(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), periodic)[0]
    return F.when((h % 10 == 0) & text.rlike(WORD), F.concat_ws(" ", words)).otherwise(text)


def summary(found: DataFrame) -> DataFrame:
    """doc_id, number of runs, the run of the greatest exponent (ties: least start, then period), and digests of all runs and of the collapsed text."""
    # greater exponent first: lengths and periods are compared as fractions
    def before(x: Column, y: Column) -> Column:
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        return F.when(left > right, -1).when(left < right, 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(
            F.signum(x["period"] - y["period"]).cast("int"))

    best = F.get(F.array_sort("runs", before), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size("runs") == 0, "").otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
