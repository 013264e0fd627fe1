"""Near-duplicates by the Jaccard likeness of five-word shingle sets: ``LEAST`` or more.

Words as in ``simhash``; a text's set holds the XXH64 of its distinct runs of ``WORDS`` words (fewer words: all of them; none: the
empty set). Equal sets count once (``fp``, 128 bits of hash over the set), and so does a text for all its copies.

Candidates: the operator of ``simhash`` gives each set a wide SimHash, searches the vantage-point trees for fingerprints within its radius and
joins them to components; a component is a bucket. Two sets of likeness 0.8 come together with a probability of 0.999 or more
(always, but for the radius, while one shard holds all). Sets that are less alike come together too, so a bucket is only where the exact rounds look.
A set's sketch holds the parities of the numbers of its shingles in 4 to 8 times as many places as it has shingles. Sketches differ in at most as many bits as the sets in
shingles, and sets of likeness 0.8 differ in a ninth of both sizes at most; so the sketch drops no such pair, and few others pass. A sketch is
folded to half its length to meet one of half the length.

Verification counts the common shingles of whole sets, in rounds that follow the components found so far. First each set of a bucket
meets the bucket's smallest one, so that a group of near copies costs one pair per member. Then, where a bucket still holds several components, each
set proposes the sets nearest to it by sketch, of other components, that sketch and size allow, and that it has not met before: one in the first
round, four times as many in each round that follows, until nobody has one left. No pair of a bucket whose sketches allow the likeness stays unmet unless its
two sets are of one component already, and pairs unlike by sketch are never written down. A bucket of more than ``CELL`` sets is compared
in cells, part against part, so that no task holds a whole bucket.

Skew: buckets and hubs (sets that many propose) may hold a third of the rows. Buckets are joined to their members with hot keys apart
(``lookup_join``), hubs are repeated under ``SALTS`` salts, all other steps are aggregates that combine before the shuffle.

Defined results: null text is empty text; documents without words are linked; rows that agree in id and text are one row, the one whose other columns are
least as JSON; an empty table gives an empty result; other columns are ignored, or kept by ``first_of_each_group``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.llm import simhash
from lotlens.operators.relational import checked_broadcast, lookup_join
from lotlens.session import passing, scratch, stored

WORDS = 5
#: Likeness as a fraction.
LEAST = (4, 5)
#: Min-hash buckets: the yardstick of the tests for the trees.
BANDS, ROWS = 20, 5
HASHES = BANDS * ROWS
#: Bits of the shortest sketch.
SHORT = 256
CELL = 4_096
#: A set with more pairs than this is a hub.
HUB, SALTS = 1_000, 32
#: Rows of one bucket or set above which its rows are spread.
HOT = 100_000
_DRAW = np.random.default_rng(6)
_SCALE = _DRAW.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _DRAW.integers(0, 2**63, HASHES, dtype=np.uint64)
PRINTS = "doc_id long, k long, l long, fp binary, size long, sketch array<long>, print binary"


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line, starts, ends, at = b" ".join(words), [], [], 0
    for n in map(len, words):
        starts.append(at)
        ends.append(at := at + n)
        at += 1
    if len(words) <= WORDS:
        return np.array([xxhash.xxh64_intdigest(line, 42)], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends[WORDS - 1 :], strict=False)), dtype=np.uint64, count=len(words) - WORDS + 1))


def set_key(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes(), 42)


def min_hashes(found: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.uint64(2**64 - 1))
    for part in range(0, len(found), 1024):
        least = np.minimum(least, (found[part : part + 1024, None] * _SCALE + _SHIFT).min(0))
    return least


def sketch(found: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each place, as signed numbers."""
    bits = max(SHORT, 1 << (4 * len(found)).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def bands(least: np.ndarray) -> np.ndarray:
    """The buckets, as signed numbers."""
    rows = least.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for column in range(ROWS):
        out = (out ^ rows[:, column]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lists = pa.list_(pa.int64())
    for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
        keys, sizes, sketches, prints = [], [], [], []
        for text in batch.column(1):
            found = shingles(text.as_py())
            keys.append(set_key(found))
            sizes.append(len(found))
            sketches.append(sketch(found))
            # smaller sets have no partner but their equals
            prints.append(simhash.wide(found) if len(found) > 3 else None)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(2), batch.column(3), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, lists), pa.array(prints, pa.binary()),
        ], names=["doc_id", "k", "l", "fp", "size", "sketch", "print"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.binary()), pa.array([shingles(text.as_py()).view(np.int64)], pa.list_(pa.int64()))], names=["fp", "found"])


def _keys() -> list[Column]:
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return [F.xxhash64(doc_id, text).alias("k"), F.xxhash64(F.lit("row"), text, doc_id).alias("l")]


def _rows(docs: DataFrame) -> DataFrame:
    """Id and text, with 128 bits of hash over both."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *_keys())


def set_prints(docs: DataFrame) -> DataFrame:
    """doc_id, k and l (hash of id and text), fp (hash of the shingle set), and the set's size, sketch and wide SimHash (null: no partner but its equals)."""
    return _rows(docs).mapInArrow(_keyed, PRINTS)


def distinct_sets(prints: DataFrame) -> DataFrame:
    """fp, own (the row whose text stands for the set), size, sketch and print; one row per set."""
    return prints.groupBy("fp").agg(F.min(F.struct("k", "l")).alias("own"), *[F.any_value(c).alias(c) for c in ("size", "sketch", "print")])


def _folded(one: str, other: str) -> Column:
    """The sketch at half its length if the other is that short; sizes of partners are too near for more."""
    words = F.size(other)
    return F.when(F.size(one) > words, F.zip_with(F.slice(one, 1, words), F.slice(one, words + 1, words), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(one))


def whole_sets(docs: DataFrame, sets: DataFrame, members: DataFrame) -> DataFrame:
    """fp and found (the shingles) of the sets that share a bucket with another one."""
    asked = sets.join(members.select(F.col("fp").alias("p")).distinct(), F.col("fp") == F.col("p"), "left_semi")
    asked = stored(asked.select("fp", F.col("own.k").alias("ok"), F.col("own.l").alias("ol")), "asked")
    texts = _rows(docs).join(asked, (F.col("k") == F.col("ok")) & (F.col("l") == F.col("ol"))).select("fp", "text")
    # equal rows give a set more than once
    return texts.mapInArrow(_sets, "fp binary, found array<long>").groupBy("fp").agg(F.any_value("found").alias("found"))


def alike(whole: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are as alike as ``LEAST``; b may be a hub; ``whole`` as of ``whole_sets``."""
    least, of = LEAST
    for end, n, bits in (("a", "m", "v"), ("b", "n", "w")):
        asked = sets.select(F.col("fp").alias("p"), F.col("size").alias(n), F.col("sketch").alias(bits))
        pairs = pairs.join(asked, F.col(end) == F.col("p")).drop("p")
    differ = F.aggregate(F.zip_with(_folded("v", "w"), _folded("w", "v"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    sized = pairs.filter(F.least("m", "n") * of >= F.greatest("m", "n") * least)
    pairs = stored(sized.filter(differ * (of + least) <= (F.col("m") + F.col("n")) * (of - least)).select("a", "b"), "close")
    left, right = (whole.join(pairs.select(F.col(end).alias("p")).distinct(), F.col("fp") == F.col("p"), "left_semi") for end in ("a", "b"))
    hubs = checked_broadcast(stored(pairs.groupBy(F.col("b").alias("hub")).count().filter(F.col("count") > HUB).select("hub"), "hubs"))
    salted = pairs.join(hubs, F.col("b") == F.col("hub"), "left").select("a", "b", F.when(F.col("hub").isNotNull(), F.pmod(F.xxhash64("a"), F.lit(SALTS))).otherwise(0).alias("salt"))
    many = right.join(hubs, F.col("fp") == F.col("hub"), "left").select(
        F.col("fp").alias("p"), F.col("found").alias("y"), F.explode(F.sequence(F.lit(0), F.when(F.col("hub").isNotNull(), SALTS - 1).otherwise(0))).alias("s"))
    joined = salted.join(many, (F.col("b") == F.col("p")) & (F.col("salt") == F.col("s"))).drop("p")
    joined = joined.join(left.select(F.col("fp").alias("p"), F.col("found").alias("x")), F.col("a") == F.col("p"))
    both = F.size(F.array_intersect("x", "y"))
    return joined.filter(both * of >= (F.size("x") + F.size("y") - both) * least).select("a", "b")


def proposals(fps: list[bytes], roots: np.ndarray, sizes: np.ndarray, sketches: list[np.ndarray], parts: np.ndarray, met: list[frozenset], most: int) -> Iterator[tuple]:
    """(a, b) with b among the ``most`` nearest of other components that a may be alike to; two parts are compared with each other only."""
    least, of = LEAST
    lengths = np.array([len(x) for x in sketches])
    apart = parts.min() != parts.max()
    best: dict[int, list[tuple[int, int]]] = {}
    for length in np.unique(lengths).tolist():
        here = np.flatnonzero((lengths == length) | (lengths == 2 * length))
        folded = np.stack([x if len(x) == length else x[:length] ^ x[length:] for x in (sketches[i] for i in here.tolist())])
        own, size, root, part = lengths[here] == length, sizes[here], roots[here], parts[here]
        step = max(1, 2_000_000 // len(here))
        for at in range(0, len(here), step):
            rows = slice(at, at + step)
            differ = np.zeros((len(own[rows]), len(here)), dtype=np.int32)
            for word in range(length):
                differ += np.bitwise_count(folded[rows, word][:, None] ^ folded[None, :, word])
            low, high = np.minimum(size[rows][:, None], size[None, :]), np.maximum(size[rows][:, None], size[None, :])
            close = (differ * (of + least) <= (low + high) * (of - least)) & (low * of >= high * least) & (root[rows][:, None] != root[None, :])
            close &= own[rows][:, None] | own[None, :]
            if apart:
                close &= part[rows][:, None] != part[None, :]
            for i in np.flatnonzero(close.any(1)).tolist():
                columns = np.flatnonzero(close[i])
                best.setdefault(int(here[at + i]), []).extend(zip(differ[i, columns].tolist(), here[columns].tolist(), strict=True))
    for i, near in best.items():
        left = (j for _, j in sorted(near) if fps[j] not in met[i])
        for _, j in zip(range(most), left, strict=False):
            yield fps[i], fps[j]


def _proposer(most: int):
    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come cell by cell."""
        held: list[pa.RecordBatch] = []

        def found() -> pa.RecordBatch:
            rows = sorted(pa.Table.from_batches(held).to_pylist(), key=lambda r: r["fp"])
            numbers: dict[bytes, int] = {}
            pairs = list(proposals(
                [r["fp"] for r in rows], np.array([numbers.setdefault(r["root"], len(numbers)) for r in rows]), np.array([r["size"] for r in rows]),
                [np.array(r["sketch"], dtype=np.int64).view(np.uint64) for r in rows], np.array([r["part"] for r in rows]), [frozenset(r["met"] or ()) for r in rows], most))
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = pa.Table.from_batches([batch]).select(["key", "low", "high"]).to_pandas()
            edges = np.flatnonzero((names != names.shift()).any(axis=1).to_numpy()).tolist()
            for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                name = tuple(names.iloc[a])
                if held and name != last:
                    yield found()
                    held = []
                last = name
                held.append(batch.slice(a, b - a))
        if held:
            yield found()

    return propose


def _proposed(members: DataFrame, sets: DataFrame, links: DataFrame, met: DataFrame, most: int) -> DataFrame:
    """The proposals of one round; ``links`` leads from sets to the smallest of their component."""
    known = links.select(F.col("a").alias("p"), F.col("b").alias("r"))
    rooted = members.join(known, F.col("fp") == F.col("p"), "left").select("key", "fp", F.coalesce("r", "fp").alias("root"))
    # a bucket of two has had its one pair
    mixed = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n")).filter("least < most AND n > 2").select("key", "n")
    open_ = lookup_join(rooted, mixed, ["key"], "n", HOT).filter("n IS NOT NULL")
    partners = met.groupBy(F.col("a").alias("p")).agg(F.collect_set("b").alias("met"))
    rows = open_.join(sets.select(F.col("fp").alias("q"), "size", "sketch"), F.col("fp") == F.col("q")).join(partners, F.col("fp") == F.col("p"), "left")
    parts = F.ceil(F.col("n") / CELL).cast("int")
    part = F.pmod(F.xxhash64("fp"), parts).cast("int")
    cells = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cells = cells.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "fp", "root", "size", "sketch", "part", "met")
    cells = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return cells.mapInArrow(_proposer(most), "a binary, b binary").distinct()


@contextmanager
def sized(spark: SparkSession, rows: int, per_task: int = 20_000) -> Iterator[None]:
    """As many shuffle partitions as so many rows need, at most those set; for the jobs that run inside."""
    name = "spark.sql.shuffle.partitions"
    old = spark.conf.get(name)
    spark.conf.set(name, str(max(1, min(int(old), -(-rows // per_task)))))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links a -> b between sets of likeness ``LEAST`` or more; ``sets`` as of ``distinct_sets``."""
    pairs = simhash.wide_classes(sets.filter("print IS NOT NULL").select("fp", "print"))
    members = pairs.select(F.col("b").alias("key"), F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("key"), F.col("b").alias("fp")).distinct())
    members = stored(members, "members")
    whole = stored(whole_sets(docs, sets, members), "whole")
    spark, n_members, n_pairs = docs.sparkSession, members.count(), pairs.count()
    found, met, most = None, pairs, 1
    while n_pairs:
        # whole sets travel with the pairs
        with sized(spark, n_pairs, 2_000):
            near = stored(alike(whole, sets, pairs), "near")
        found = near if found is None else found.unionByName(near)
        with sized(spark, found.count()):
            known = simhash.roots(found)
        with sized(spark, n_members):
            pairs = stored(_proposed(members, sets, known, met, most), "pairs")
        met, most, n_pairs = met.unionByName(pairs), 4 * most, pairs.count()
    return pairs if found is None else found


def first_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each component the document with the smallest id (null last)."""
    spark = docs.sparkSession
    path = scratch(spark, "kept")
    with passing(spark):
        prints = stored(set_prints(docs), "fingerprints")
        sets = stored(distinct_sets(prints), "sets")
        linked = links(docs, sets)
        with sized(spark, linked.count()):
            known = simhash.roots(linked).select(F.col("a").alias("p"), F.col("b").alias("r"))
        place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("k"), F.col("l"))
        # one row per set first, so that copies don't meet in a join
        first = prints.groupBy("fp").agg(F.min(place).alias("first"))
        kept = first.join(known, F.col("fp") == F.col("p"), "left").groupBy(F.coalesce("r", "fp").alias("root")).agg(F.min("first").alias("first"))
        kept = stored(kept.select(F.col("first.k").alias("kk"), F.col("first.l").alias("kl")), "kept", path)
    names = docs.columns
    rest = F.to_json(F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in names if c != "text"]))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), rest.alias("rest"), *_keys())
    once = rows.join(kept, (F.col("k") == F.col("kk")) & (F.col("l") == F.col("kl")), "left_semi").groupBy("k", "l").agg(F.min_by("doc", "rest").alias("doc"))
    return once.select("doc.*")
